"""The pipeline's stages on a small folder of tables, against plain Python."""

import hashlib
import random
from collections import Counter

import pytest

import corpus_pipeline
from tidemark.llm import bpe

from .test_operators import cut_lines, linked


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(500)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    item = text(40)
    data, toxic = [], {}
    for i in range(160):
        t = text(rnd.choice((20, 80, 200))) + "\nthe line that many texts share\n" * (i % 9 == 0)
        if i % 10 == 3:
            t += " stinker" * 3
        if i % 20 == 5:
            t += " " + item
        if i % 8 == 7:
            t = data[-3][1]
        data.append((i, t))
        toxic[i] = int("stinker" in t)
    data += [(900, None), (901, "")]
    at = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in data]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in toxic.items()], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, data, item


def test_stages(spark, folder):
    at, data, item = folder
    kept = {i: t for i, t in data if "stinker" not in (t or "")}
    kept = {i: t for i, _, _, t in cut_lines(list(kept.items()))}
    first = {i: c for i, _, c in linked(list(kept.items()), 5, corpus_pipeline.jaccard_join.Fraction(4, 5))}
    kept = {i: t for i, t in kept.items() if first[i] == i}
    kept = {i: t for i, t in kept.items() if item not in t}
    enc = bpe.encoding(bpe.VOCABULARY)
    want = {i: (len(x := enc.encode_ordinary(t)), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in kept.items()}
    got = {r["doc_id"]: tuple(r)[1:] for r in corpus_pipeline.run(spark, at).collect()}
    assert got == want


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder[0])
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
    cut = corpus_pipeline.cut_shared_lines(spark, docs, folder[0])
    assert cut.where("n_chars != char_length(text)").count() == 0


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "decontamination", "bpe"]


def test_odd_rows_and_empty_tables(spark, odd_docs, tmp_path):
    """Nulls, repeats, a long text and clashing columns pass through; empty tables give empty results."""
    from .conftest import DOCS

    at = str(tmp_path)
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    odd_docs.write.parquet(f"{at}/documents.parquet")
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, at)
        assert docs.columns == odd_docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    assert got == Counter((i, None if t is None else cut[3]) for (i, t), cut in zip(DOCS, cut_lines(DOCS), strict=True))
    assert corpus_pipeline.run(spark, at).count() == len(DOCS)
    spark.createDataFrame([], "doc_id bigint, text string, n_chars bigint").write.parquet(f"{at}/none/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{at}/{t}.parquet").write.parquet(f"{at}/none/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{at}/none").collect() == []


def test_tables_made_on_the_way_are_dropped(spark, folder):
    from tidemark.llm import common

    before = list(common.MADE)
    corpus_pipeline.run(spark, folder[0]).collect()
    assert [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in common.MADE if p not in before] == ["pipeline-decontamination"]
