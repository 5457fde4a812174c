"""Pipeline over documents: toxicity, line dedup, near duplicates, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs. All but the
last return the columns of documents, in their order and types, whatever further columns there are and however they are named.

Defined results, for every stage: a null text counts as empty, and stays null where it is kept; empty texts are clean, share nothing
and are encoded to no ids. A text from which line dedup cuts every line stays as an empty text. Texts are worked on whole, of any
length. Rows that repeat with one doc_id are judged each by its own text; in the third stage they go or stay together, with the
smallest doc_id of their group (of ties the smaller doc_id stays). Rows with a null doc_id stay in every stage that their own text
passes, and are no copies of anything. An empty table gives an empty result with the same columns; empty labels reject nothing, an
empty benchmark finds nothing.

The third stage links at five-word shingles and a similarity of 0.8, so that near copies with more changes than that stay (see README).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, jaccard_join, line_dedup, toxicity
from tidemark.llm.common import MADE, read, sweep, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5, by a classifier trained on the labelled rows among them."""
    return toxicity.keep_clean(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def cut_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that three or more of them share, which stay in the largest doc_id alone; n_chars follows."""
    counts = "_lines" + "_" * max(map(len, docs.columns))  # no column's name
    cut = line_dedup.dedup_lines(docs, counts=counts)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col(f"{counts}.n_dropped") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles at a similarity of 0.8 or more join: the smallest doc_id."""
    return jaccard_join.keep_representatives(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of ids, and digests of the ids and of the text that decoding them gives."""
    return bpe.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_shared_lines),
    ("ngram_jaccard_join", keep_one_of_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("bpe", encode_and_decode),
]
#: SQL expresses neither the trained classifier nor BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        since = [p for p in MADE if before is None or p != before._written_at]
        docs = before = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        sweep(spark, since, docs)  # what the stage wrote on its way, and its input
    return STAGES[-1][1](spark, docs, sf_dir)
