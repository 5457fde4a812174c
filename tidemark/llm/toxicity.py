"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A document's features are the distinct hashed n-grams of 3 to 5 characters of its lower-cased whole text. Each feature's value
is its log-count ratio between toxic and other training texts; a logistic regression is fitted over those values. N-grams of fewer
than `SUPPORT` texts, or whose ratio is within `SURE` standard errors of 0, tell nothing and have the value 0. The sample's features
are a table; each round of the fit sums gradients over its parts in the executors, and the driver holds arrays of 2^BITS numbers
alone, however long the texts are.

Bound of the fit (documented parameter): the labelled doc_ids with the smallest hashes, at most `per_class[1]` toxic and `per_class[0]`
others; all rows with a chosen doc_id are used. Every document is scored by its whole text.

Defined results: a row with a null doc_id is not held out, and has no label. a null text counts as empty and scores by the intercept alone. Labels that are null are no labels; a document
labelled twice is toxic if one label says so. Without labelled rows of both classes the score is the share of toxic labels (0 if
there are none). Rows that repeat are scored alike and all kept; extra columns are never read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, read, small_batches, trimmed, written

SIZES = (3, 4, 5)
BITS = 20
SUPPORT = 3
SURE = 3.0
PARTS = 4
SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"


def features(text: str | None) -> np.ndarray:
    """Hashes (BITS wide, repeats included) of the text's character n-grams."""
    c = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    out, h = [], c * np.uint32(2654435761)
    for n in range(2, SIZES[-1] + 1):
        if len(c) < n:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(2246822519) + c[n - 1 :] * np.uint32(2654435761)
        if n in SIZES:
            m = (h ^ (h >> np.uint32(13))) * np.uint32(3266489917) + np.uint32(n)
            out.append((m >> np.uint32(32 - BITS)).astype(np.int32))
    return np.concatenate(out) if out else np.empty(0, np.int32)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Model:
    """Weights by hashed n-gram (already times the log-count ratio) and the intercept."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights.astype(np.float32), float(intercept)

    def score(self, texts: list[str | None]) -> np.ndarray:
        z = np.full(len(texts), self.intercept)
        for i, t in enumerate(texts):
            h = features(t)
            z[i] += self.weights[np.unique(h[self.weights[h] != 0])].sum(dtype=np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [np.unique(features(t)).astype(np.int32).tobytes() for t in b.column("text").to_pylist()]
        yield pa.record_batch([b.column("toxic"), pa.array(found, pa.binary())], names=["toxic", "found"])


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    return batch.column("toxic").to_numpy(), [np.frombuffer(raw, np.int32) for raw in batch.column("found").to_pylist()]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each class that hold each feature, as one array, and the number of texts."""
    counts, n = np.zeros((2, 1 << BITS), np.int32), [0, 0]
    for b in batches:
        for y, x in zip(*_rows(b), strict=True):
            counts[y][x] += 1
            n[y] += 1
    yield pa.record_batch([pa.array([counts.tobytes()], pa.binary()), pa.array([n], pa.list_(pa.int64()))], names=["counts", "n"])


def gradient(y: np.ndarray, x: list[np.ndarray], wr: np.ndarray, b: float, each: tuple[float, float], block: int = 1_000_000) -> tuple[np.ndarray, float]:
    """Gradient of the weighted loss by feature and by the intercept, over blocks of about `block` entries."""
    g, shift = np.zeros(len(wr)), 0.0
    start = 0
    while start < len(x):
        end, held = start, 0
        while end < len(x) and (held == 0 or held + len(x[end]) <= block):
            held += max(1, len(x[end]))
            end += 1
        idx, own = np.concatenate(x[start:end]), y[start:end]
        row = np.repeat(np.arange(end - start), [len(v) for v in x[start:end]])
        z = np.bincount(row, wr[idx], end - start) + b
        e = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - own) * np.where(own == 1, each[1], each[0])
        g += np.bincount(idx, e[row], len(wr))
        shift += e.sum()
        start = end
    return g, shift


def _gradients(shared, each: tuple[float, float]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wr, b = shared.value
        g, shift = np.zeros(len(wr)), 0.0
        for batch in batches:
            own = gradient(*_rows(batch), wr, b, each)
            g += own[0]
            shift += own[1]
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([g.astype(np.float32).tobytes()], pa.binary()), pa.array([shift])], names=["part", "g", "shift"])

    return run


class Descent:
    """Adagrad on the mean loss over both classes alike, over features whose values are r."""

    def __init__(self, r: np.ndarray, l2: float = 3e-3, rate: float = 0.5):
        self.r, self.l2, self.rate = r, l2, rate
        self.w, self.b = np.zeros(len(r)), 0.0
        self.gw, self.gb = np.full(len(r), 1e-8), 1e-8

    def scaled(self) -> np.ndarray:
        return self.w * self.r

    def step(self, g: np.ndarray, shift: float) -> None:
        g = g * self.r + self.l2 * self.w
        self.gw += g * g
        self.gb += shift**2
        self.w -= self.rate * g / np.sqrt(self.gw)
        self.b -= self.rate * shift / np.sqrt(self.gb)


def log_ratios(counts: np.ndarray, n: list[int]) -> np.ndarray:
    r = np.log((counts[1] + 1) / (n[1] + 1.0)) - np.log((counts[0] + 1) / (n[0] + 1.0))
    sure = np.abs(r) >= SURE * np.sqrt(1 / (counts[1] + 1) + 1 / (counts[0] + 1))
    return np.where((counts.sum(0) >= SUPPORT) & sure, r, 0.0)


def _picked(place: np.ndarray) -> Callable:
    """The features that have a value, by their places among these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(p := place[x])[p >= 0].tobytes() for x in _rows(b)[1]]
            yield pa.record_batch([b.column("toxic"), pa.array(found, pa.binary())], names=["toxic", "found"])

    return run


def train(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = (4000, 2000), rounds: int = 60) -> Model:
    """Fits on a bounded sample of labelled rows outside the held-out fold; see the module's text for the bounds."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = dict.fromkeys((0, 1), 0) | {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    zero = np.zeros(1 << BITS)

    def logit(a: float, b: float) -> float:
        return float(np.log((a + 1e-9) / (b + 1e-9)))

    if not totals[0] or not totals[1]:
        return Model(zero, logit(totals[1], totals[0]) if sum(totals.values()) else -500.0)
    sample = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class[label])
        sample = part if sample is None else sample.unionByName(part)
    # at most sum(per_class) ids and flags: a bounded broadcast
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    table = written(rows.mapInArrow(trimmed(_featured), "toxic int, found binary"), "toxic-features")
    parts = table.coalesce(PARTS)
    counts, n = np.zeros((2, 1 << BITS), np.int64), [0, 0]
    for r in parts.mapInArrow(trimmed(_counted), "counts binary, n array<bigint>").collect():
        counts += np.frombuffer(r["counts"], np.int32).reshape(2, -1)
        n = [n[0] + r["n"][0], n[1] + r["n"][1]]
    if not n[0] or not n[1]:
        drop(table)
        return Model(zero, logit(totals[1], totals[0]))
    ratios = log_ratios(counts, n)
    chosen = np.flatnonzero(ratios)
    place = np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    picked = written(parts.mapInArrow(trimmed(_picked(place)), "toxic int, found binary"), "toxic-picked")
    drop(table)
    fit, each, parts = Descent(ratios[chosen]), (0.5 / n[0], 0.5 / n[1]), picked.coalesce(PARTS)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((fit.scaled(), fit.b))
        g, shift = np.zeros(len(chosen)), 0.0
        for r in sorted(parts.mapInArrow(_gradients(shared, each), "part int, g binary, shift double").collect(), key=lambda r: r["part"]):
            g += np.frombuffer(r["g"], np.float32)
            shift += r["shift"]
        fit.step(g, shift)
        shared.destroy()
    drop(picked)
    weights = zero.copy()
    weights[chosen] = fit.scaled()
    return Model(weights, fit.b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.score(b.column("text").to_pylist())
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), SCHEMA)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that score under 0.5, with the columns as they are."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.score(b.column(at).to_pylist()) < 0.5))

    return docs.mapInArrow(trimmed(run), docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))
