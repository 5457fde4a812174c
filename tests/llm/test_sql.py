"""Operators that SQL can express, against DuckDB: on the smallest driver tables, and on odd rows."""

import random
import re
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tidemark.llm import licenses
from tidemark.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


def same(df, made):
    names = [d[0] for d in made.description]
    assert sorted(df.columns) == sorted(names)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(made.fetchall(), names)


@pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_duckdb(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    same(QUERIES[name](spark, SF), duck.execute(ORACLE_SQL[name]))


def test_licences_of_odd_texts(spark):
    """Every template whole, cut, in capitals, overlapping, at both ends of a text, and beside letters beyond ASCII."""
    texts = [None, "", " ", "...", "MIT", "under the mit license under the MIT-License", "cc by nc cc by nc", "écc by nc", "cc by ncé", "cc by sa/cc by nc"]
    for _, _, text, key in licenses.TEMPLATES:
        texts += [text, text.upper() + "!", "x " + text.replace(" ", ", "), key or text, " ".join(text.split()[1:]), text[: len(text) // 2], text.replace(" ", "\n", 1) + " " + text]
    rows = [(i, t) for i, t in enumerate(texts)]
    duck = duckdb.connect()
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841, read by name
    same(licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")), duck.execute(licenses.ORACLE))


def test_licences_of_many_templates(spark):
    """Five hundred templates with shared words, some repeated words, all found at their places."""
    rnd = random.Random(6)
    vocab = ["".join(rnd.choice("abcde") for _ in range(rnd.randrange(1, 5))) for _ in range(300)]
    templates = []
    for n in range(500):
        words = [rnd.choice(vocab) for _ in range(rnd.randrange(3, 20))]
        key = words[1 : 1 + rnd.randrange(2, 6)]
        templates.append((f"l{n % 40}", n % 3 == 0, " ".join(words), " ".join(key) if n % 2 else ""))
    rows = [(i, " ".join(rnd.choice(vocab) for _ in range(30)) + " " + (rnd.choice(templates)[2] if i % 2 else rnd.choice(templates)[3]) + " " + rnd.choice(vocab)) for i in range(200)]
    duck = duckdb.connect()
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841, read by name
    same(licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), templates), duck.execute(licenses._oracle(templates)))


def test_pattern_of_words():
    words = ["a", "ab", "abc", "b", "c.d", "xyz"]
    assert all(re.fullmatch(licenses.any_of(words), w) for w in words)
    assert not any(re.fullmatch(licenses.any_of(words), w) for w in ("", "ac", "cxd", "xy", "bb"))
