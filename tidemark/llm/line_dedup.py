"""Line dedup by levelled sorted runs of line hashes; DataFrame functions only.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased; it is held as two 64-bit hashes (128 bits) and its
length. Documents come in batches. A batch's keys are merge-anti-joined with the runs: a key that the runs already hold as
settled (in `min_docs` documents or more, one of them with a doc_id no smaller) adds nothing; all others go into the batch's own
sorted run with the number of documents and the largest doc_id. When a level holds `fanout` runs they are merged into one run
of the next level. In the end the runs' sums tell which keys go from which documents.

Defined results: a null or empty text is one empty line. Rows with one doc_id count as one document; each is cut by its own
lines and kept. Rows with a null doc_id count as no document and stay whole. Lines whose key is shorter than `min_chars` always stay; in
the largest doc_id that holds a key, all its lines stay. Extra columns go through untouched. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MADE, drop_path, lower_ascii, read, shared_dir, written

KEY = ["h1", "h2"]
HOT_ROWS, HOT_KEYS = 5_000, 100_000


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")))


def _bit(pos: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (pos % 64).cast("int"))


class LineRuns:
    """Levelled sorted runs of (h1, h2, n, top): a key's hashes, the documents counted and their largest doc_id."""

    def __init__(self, spark: SparkSession, min_docs: int = 3, fanout: int = 2):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.folder = f"{shared_dir(spark)}/line-runs-{uuid.uuid4().hex}"
        MADE.append(self.folder)
        self.levels: list[list[str]] = []
        self.made = 0

    def _write(self, rows: DataFrame, level: int) -> None:
        path = f"{self.folder}/run-{self.made}"
        self.made += 1
        rows.select(*KEY, "n", "top").sortWithinPartitions(*KEY).write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("h1 bigint, h2 bigint, n bigint, top bigint").parquet(*paths)

    @staticmethod
    def _merged(runs: DataFrame) -> DataFrame:
        return runs.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("top").alias("top"))

    def add(self, batch: DataFrame) -> None:
        """batch: one row (h1, h2, doc) for each key and document."""
        own = batch.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("doc").alias("top"))
        held = [p for level in self.levels for p in level]
        if held:
            settled = self._merged(self._read(held)).where(F.col("n") >= self.min_docs).withColumnRenamed("top", "held_top").drop("n")
            own = own.alias("o").join(settled.alias("s").hint("merge"), (F.col("o.h1") == F.col("s.h1")) & (F.col("o.h2") == F.col("s.h2")) & (F.col("o.top") <= F.col("s.held_top")), "left_anti")
        self._write(own, 0)
        self._compact()

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            full = self.levels[level]
            if len(full) >= self.fanout:
                self._write(self._merged(self._read(full)), level + 1)
                self.levels[level] = []
                for p in full:
                    drop_path(self.spark, p)
            level += 1

    def settled(self) -> DataFrame:
        """h1, h2, n, top of the keys found in `min_docs` documents or more; n counts no more documents than the runs took in."""
        held = [p for level in self.levels for p in level]
        if not held:
            return self.spark.createDataFrame([], "h1 bigint, h2 bigint, n bigint, top bigint")
        return self._merged(self._read(held)).where(F.col("n") >= self.min_docs)


def _outdone(table: DataFrame, settled: DataFrame) -> DataFrame:
    """The rows (key, doc, at) whose key is settled in a document with a larger doc_id.

    Keys of very many rows would meet in one task. They are few, as each makes up at least 1 / `HOT_KEYS` of the rows (or `HOT_ROWS` rows): at most
    HOT_KEYS of them, three numbers each, are broadcast, and their rows stay where they are. All other keys are merge-joined.
    """
    held = table.count()
    if held >= HOT_ROWS:
        rows = table.groupBy(*KEY).agg(F.count("*").alias("rows")).where(F.col("rows") >= max(HOT_ROWS, held // HOT_KEYS))
        hot = written(rows.join(settled, KEY).select(*KEY, F.col("top").alias("hot_top")), "line-hot", slim=True)
        marked = table.join(F.broadcast(hot), KEY, "left")
        cold = marked.where("hot_top is null").join(settled.hint("merge"), KEY).where("doc < top")
        return marked.where("doc < hot_top").select(*KEY, "doc", "at").unionByName(cold.select(*KEY, "doc", "at"))
    return table.join(settled.hint("merge"), KEY).where("doc < top").select(*KEY, "doc", "at")


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 2, counts: str = "_lines") -> DataFrame:
    """docs with the shared lines cut from `text`, and the struct `counts` of n_lines and n_dropped as the last column."""
    spark = docs.sparkSession
    # other columns travel packed, so that none can clash with the columns made here
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"), F.struct(*docs.columns).alias("row"))
    rows = rows.withColumn("form", F.xxhash64("body"))  # tells the texts of one doc_id apart
    lines = F.split("body", "\n", -1)
    keys = rows.select("doc", "form", F.posexplode(lines).alias("pos", "line")).where("doc is not null").select("doc", "form", "pos", line_key(F.col("line")).alias("key"))
    keys = keys.where(F.char_length("key") >= min_chars).select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key", F.char_length("key")).alias("h2"), "doc", F.struct("form", "pos").alias("spot"))
    low, high = rows.agg(F.min("doc"), F.max("doc")).first()
    # one row for each key and document; the documents with the largest ids come first
    table = written(keys.groupBy(*KEY, "doc").agg(F.collect_set("spot").alias("at")), "line-keys")
    runs = LineRuns(spark, min_docs, fanout)
    if low is not None:
        width = (high - low) // batches + 1
        for i in reversed(range(batches)):
            start = low + i * width
            runs.add(table.where((F.col("doc") >= start) & (F.col("doc") < start + width)).select(*KEY, "doc"))
    out = _outdone(table, runs.settled())
    # positions to drop, as bits of one number for each 64 lines
    bits = out.select("doc", F.explode("at").alias("at")).groupBy("doc", "at.form", F.floor(F.col("at.pos") / 64).alias("block")).agg(F.bit_or(_bit(F.col("at.pos"))).alias("mask"))
    masks = bits.groupBy("doc", "form").agg(F.map_from_entries(F.collect_list(F.struct("block", "mask"))).alias("masks"))
    joined = rows.join(masks, ["doc", "form"], "left")
    n = F.size(lines)
    dense = F.when(F.col("masks").isNotNull(), F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 64).cast("int")), lambda b: F.coalesce(F.try_element_at("masks", b.cast("bigint")), F.lit(0).cast("bigint"))))
    kept = F.filter(lines, lambda _, i: F.get(F.col("dense"), F.floor(i / 64).cast("int")).bitwiseAND(_bit(i)) == 0)
    cut = joined.withColumn("dense", dense).select("row", F.when(F.col("masks").isNotNull(), kept).alias("kept"), n.cast("bigint").alias("n"))
    return cut.select(
        *[F.when(F.col("kept").isNotNull(), F.array_join("kept", "\n")).otherwise(F.col("row.text").cast("string")).alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns],
        F.struct(F.col("n").alias("n_lines"), F.when(F.col("kept").isNotNull(), F.col("n") - F.size("kept")).otherwise(F.lit(0)).cast("bigint").alias("n_dropped")).alias(counts),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "_lines.n_lines", "_lines.n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, coalesce(k.doc_id < s.top, false) AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY r, doc_id
"""
