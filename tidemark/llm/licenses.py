"""License scans by a positional rare-token index; DataFrame functions only.

The index holds, for each template, its words of the highest IDF over the templates (its anchors) with their places. A text is
split into words, its anchors are looked up, and each posting votes for the place where its template would start. Where all
anchors of a template agree on a start, the template's mandatory key phrase is verified word by word; the score is the share of
the template's words that stand at their places.

The base phrases are templates that are their own key phrase. Further templates are known sentences of licences. The index is a
hash table, an array literal of buckets, so that a word costs one look whatever the number of templates; the text goes to the index
only if a pattern of the anchors, shared beginnings once, finds one in it. Index and templates travel with the plan: tables of more
than `MOST_BYTES` are refused.

Defined results: a null text has no words. `first_word` and `last_word` are null and the labels empty where nothing is found; the
score is then 0. Rows that repeat are scanned alike and all kept; extra columns are dropped. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, read

GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: (label, base, template, key phrase); fixed values. Base templates are counted as places; an empty key phrase is the template.
TEMPLATES = [
    ("mit", True, "under the mit license", ""),
    ("apache-2", True, "apache license version 2", ""),
    ("cc-by-nc", True, "cc by nc", ""),
    ("gpl-2", False, "gnu general public license version 2", ""),
    ("gpl-3", False, "gnu general public license version 3", ""),
    ("lgpl", False, "gnu lesser general public license", ""),
    ("agpl-3", False, "gnu affero general public license version 3", ""),
    ("mit", False, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge"),
    ("apache-2", False, "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "you may not use this file except in compliance with the license"),
    ("bsd", False, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("isc", False, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    ("mpl-2", False, "this source code form is subject to the terms of the mozilla public license v 2 0", "terms of the mozilla public license v 2 0"),
    ("unlicense", False, "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
    ("cc-by-sa", False, "cc by sa", ""),
    ("cc-by", False, "creative commons attribution 4 0 international license", ""),
    ("cc0", False, "cc0 1 0 universal", ""),
]
ANCHORS = 2
SHIFT = 1 << 40
BUCKETS = 4096
MOST_BYTES = 16_000_000


def index(templates: list[tuple] = TEMPLATES, anchors: int = ANCHORS) -> dict[str, list[tuple[int, int]]]:
    """Postings (template, place) of the anchors: each template's words of the highest IDF, at the places inside its key phrase."""
    df = Counter(w for t in templates for w in set(t[2].split()))
    out: dict[str, list[tuple[int, int]]] = {}
    for n, (_, _, text, key) in enumerate(templates):
        words, part = text.split(), (key or text).split()
        start = _find(words, part)
        best = sorted(set(part), key=lambda w: (-math.log(len(templates) / df[w]), w))[:anchors]
        for w in best:
            out.setdefault(w, []).append((n, start + part.index(w)))
    return out


def _find(words: list[str], part: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(part)] == part)


def any_of(words: list[str]) -> str:
    """A pattern of the words in which shared beginnings are written once; the longest word is tried first."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def written(at: dict) -> str:
        parts = [re.escape(c) + written(at[c]) for c in sorted(at) if c]
        if not parts:
            return ""
        whole = parts[0] if len(parts) == 1 and "" not in at else f"(?:{'|'.join(parts)})"
        return whole + "?" if "" in at else whole

    return written(tree)


def _literal(value: list, kind: str) -> Column:
    """A constant that the optimizer folds once, whatever its size."""
    raw = json.dumps(value)
    if len(raw) > MOST_BYTES:
        raise ValueError(f"{len(raw)} bytes of templates, more than {MOST_BYTES}")
    return F.from_json(F.lit(raw), kind)


def scan(docs: DataFrame, templates: list[tuple] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row."""
    postings = index(templates)
    votes = Counter(n for p in postings.values() for n, _ in p)
    any_word = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]"
    # in `\b`, letters beyond ASCII are no word characters; so the neighbours are named
    pattern = f"(?i)(?<!{any_word}){any_of(sorted(postings))}(?!{any_word})"
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select("doc_id", F.split(text, GAP, -1).alias("raw"), text.rlike(pattern).alias("hit"))
    n = F.size("raw")
    ends = F.when(n == 1, (F.get("raw", F.lit(0)) == "").cast("int")).otherwise((F.get("raw", F.lit(0)) == "").cast("int") + (F.get("raw", n - 1) == "").cast("int"))
    words = F.when(F.col("hit"), F.filter(F.transform("raw", lower_ascii), lambda w: w != ""))
    d = d.select("doc_id", (n - ends).cast("bigint").alias("n_words"), words.alias("words"))
    buckets: list[list] = [[] for _ in range(BUCKETS)]
    for w, p in postings.items():
        buckets[zlib.crc32(w.encode()) % BUCKETS] += [{"w": w, "t": t, "o": o} for t, o in p]
    table = _literal(buckets, "array<array<struct<w:string,t:bigint,o:int>>>")

    def looked_up(w: Column) -> Column:
        return F.get(table, (F.crc32(w.cast("binary")) % BUCKETS).cast("int"))

    found = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.exists(looked_up(x["w"]), lambda p: p["w"] == x["w"]))
    # template and start as one number: sorted, equal votes stand side by side
    cast = F.transform(found, lambda x: F.transform(F.filter(looked_up(x["w"]), lambda p: (p["w"] == x["w"]) & (x["i"] >= p["o"])), lambda p: p["t"] * SHIFT + (x["i"] - p["o"])))
    d = d.select("doc_id", "n_words", "words", F.sort_array(F.flatten(cast)).alias("votes"))
    wanted = _literal([votes[n] for n in range(len(templates))], "array<int>")

    def template(x: Column) -> Column:
        return (x / SHIFT).cast("bigint")

    first = F.filter("votes", lambda x, k: (F.coalesce(F.get("votes", k - 1), F.lit(-1)) != x) & (F.get("votes", k + F.get(wanted, template(x).cast("int")) - 1) == x))
    d = d.withColumn("starts", first)
    texts = _literal([t[2].split() for t in templates], "array<array<string>>")
    keys = _literal([(t[3] or t[2]).split() for t in templates], "array<array<string>>")
    offsets = _literal([_find(t[2].split(), (t[3] or t[2]).split()) for t in templates], "array<int>")

    def verified(x: Column) -> Column:
        t, start = template(x).cast("int"), (x % SHIFT).cast("int")
        return F.slice("words", start + F.get(offsets, t) + 1, F.size(F.get(keys, t))) == F.get(keys, t)

    def hit(x: Column) -> Column:
        t, start = template(x).cast("int"), (x % SHIFT).cast("int")
        own = F.get(texts, t)
        same = F.filter(own, lambda w, j: F.get("words", start + j) == w)
        return F.struct(t.alias("t"), start.alias("start"), (F.size(same) / F.size(own)).alias("share"))

    d = d.select("doc_id", "n_words", F.coalesce(F.transform(F.filter("starts", verified), hit), F.array().cast("array<struct<t:int,start:int,share:double>>")).alias("hits"))
    names = _literal([t[0] for t in templates], "array<string>")
    is_base = _literal([t[1] for t in templates], "array<boolean>")
    d = d.withColumn("base", F.filter("hits", lambda h: F.get(is_base, h["t"])))

    def labels(c: str) -> Column:
        return F.array_join(F.sort_array(F.array_distinct(F.transform(c, lambda h: F.get(names, h["t"])))), ",")

    starts = F.transform("base", lambda h: h["start"])
    return d.select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(starts).cast("bigint").alias("first_word"),
        F.array_max(starts).cast("bigint").alias("last_word"),
        labels("base").alias("base_labels"),
        labels("hits").alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["share"])), F.lit(0.0)).alias("score"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def _oracle(templates: list[tuple] = TEMPLATES) -> str:
    """SQL that tries every template at every word, without an index."""
    rows = ",\n  ".join(f"({n}, '{label}', {base}, '{text}', '{key or text}', {_find(text.split(), (key or text).split())})" for n, (label, base, text, key) in enumerate(templates))
    return rf"""
WITH t(t, label, base, words, key, skip) AS (
  SELECT t, label, base, string_split(words, ' '), string_split(key, ' '), skip FROM (VALUES
  {rows}) AS v(t, label, base, words, key, skip)),
d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
p AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
h AS (
  SELECT d.r, t.label, t.base, i - skip AS start,
    len(list_filter(range(1, len(words) + 1), lambda j: words[j] = w[i - skip + j])) / len(words) AS share
  FROM p JOIN t ON p.word = t.key[1] JOIN d ON d.r = p.r
  WHERE i >= skip AND w[i + 1:i + len(key)] = key)
SELECT any_value(d.doc_id) AS doc_id, any_value(len(w)) AS n_words, count(label) FILTER (WHERE base) AS n_base,
  min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(share), 0.0::DOUBLE) AS score
FROM d LEFT JOIN h ON h.r = d.r GROUP BY d.r
"""


ORACLE = _oracle()
