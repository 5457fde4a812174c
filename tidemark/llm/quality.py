"""Quality rules: counts of words, symbols and repeats, and a hashed n-gram log-likelihood ratio. DataFrame functions only.

A text's tokens are runs of letters and digits and runs of other marks; its features are the hashed tokens and pairs of tokens.
Two multinomials over the hash buckets are counted: one over all documents (raw corpus) and one over a trusted target, the
documents labelled as of good quality. A text's ratio is the sum of its features' log(target / raw), divided by their number;
a document is kept if it passes the base rules and its ratio is `threshold` or more, the same for every document.

Both are counted over all rows; a document counts to the target if one of its labels says good.

Defined results: a null text has no words and fails the base rules. A text without tokens has ratio 0. Without a labelled document
of good quality every ratio is 0. Rows that repeat are counted and judged alike and all kept; extra columns are dropped. An empty
table gives an empty result. Windows of three words are compared by 64-bit hashes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

WORD_GAP = r"[\x20\x09-\x0D]+"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
BUCKETS = 16384
THRESHOLD = -0.4


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WORD_GAP, -1))


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and the four counts of every row."""
    d = docs.select(F.col("doc_id"), _text().alias("text"))
    d = d.withColumn("words", words_of(F.col("text")))
    n = F.size("words")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        "doc_id",
        n.cast("bigint").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.char_length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        lines.alias("lines"),
        windows.alias("windows"),
    )
    # a window's hash with its place, sorted: windows found twice or more stand side by side
    placed = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    d = d.select("doc_id", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"), placed.alias("placed"))
    twice = F.filter("placed", lambda x, k: (x["h"] == F.get("placed", k + 1)["h"]) | (x["h"] == F.get("placed", k - 1)["h"]))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.when(F.size("placed") > 0, F.size(covered)).otherwise(0).cast("bigint").alias("n_repeat_words"))


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def _features() -> Column:
    """Buckets of the tokens and of pairs of neighbours, from the column `tokens`."""
    one = F.transform("tokens", lambda t: F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int"))
    two = F.transform("tokens", lambda t, i: F.pmod(F.xxhash64(t, F.coalesce(F.get("tokens", i + 1), F.lit(""))), F.lit(BUCKETS)).cast("int"))
    return F.concat(one, two)


def ratios(docs: DataFrame, labels: DataFrame) -> list[float]:
    """log(target / raw) of each bucket, counted over all rows; the result has BUCKETS numbers whatever the corpus."""
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("bigint").alias("id")).where("id is not null").distinct().withColumn("good", F.lit(1))
    # a merge join at every size: labels grow with the corpus, and a broadcast of them below some size would change the plan's cost there
    tokens = docs.select(F.col("doc_id").cast("bigint").alias("id"), _text().alias("text")).join(good.hint("merge"), "id", "left").select("good", _tokens(F.col("text")).alias("tokens"))
    counts = tokens.select("good", F.explode(_features()).alias("f")).groupBy("f").agg(F.count("*").alias("raw"), F.count("good").alias("target")).collect()
    raw, target = [1.0] * BUCKETS, [1.0] * BUCKETS
    for r in counts:
        raw[r["f"]] += r["raw"]
        target[r["f"]] += r["target"]
    if sum(target) == BUCKETS:
        return [0.0] * BUCKETS
    shift = math.log(sum(raw) / sum(target))
    return [math.log(t / r) + shift for t, r in zip(target, raw, strict=True)]


def _ratio(table: list[float]) -> Column:
    """The length-normalised ratio, from the column `tokens`."""
    values = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")
    total = F.aggregate(_features(), F.lit(0.0), lambda a, f: a + F.get(values, f))
    return F.when(F.size("tokens") > 0, total / (2 * F.size("tokens"))).otherwise(0.0)


def judge(docs: DataFrame, table: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """The base counts of every row, its ratio, base_failed and kept."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    d = docs.select("doc_id", _text().alias("text"), _tokens(_text()).alias("tokens"))
    d = d.select(F.struct("doc_id", _ratio(table).alias("ratio")).alias("doc_id"), "text")
    return base_counts(d).select("doc_id.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("doc_id.ratio") >= threshold)).alias("kept"), F.col("doc_id.ratio").alias("ratio"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return judge(docs, ratios(docs, read(spark, sf_dir, "labels")))
