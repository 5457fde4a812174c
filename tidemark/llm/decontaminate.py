"""Benchmark decontamination by SimHash of windows and exact verification.

Words are lower-cased (A-Z) and stripped of ASCII marks at their ends. A fingerprint is the 64-bit SimHash of a window's words, weighted
by their rarity among the items. A benchmark item is fingerprinted at every start along its whole length, a text at every fourth word. The
windows of an item of L words have the largest size of `SIZES` that fits into 0.6 L - 3 words, from 35 words on into (L - 3) / 2:
a near copy at the threshold can lose a fifth at an end, or, in longer items, a word in about 45, so that some run of a window and
three words is left as it was, and of the item's fingerprints there one meets the text's.

Multi-index: a fingerprint is cut into 4 blocks of 16 bits, each block is looked up in a table, and what agrees in a block is compared
whole. Two fingerprints at a distance of up to `RADIUS` (3) agree in a block, so every pair within it is found. A candidate fixes where
the item would stand; around there, all starts are compared by weighted multisets of 5-word shingles: sum of minima over sum of
maxima, `threshold` (0.8) or more is a leak.

What fingerprints cannot prove (edits that leave no run whole, as a few light words of a short item allow) has an exact way: the item's
rarest shingles that make up more than 1 - threshold of its weight are looked up in the text as well. A place at the threshold or
above shares at least `threshold` of the item's weight and thus one of them; every start whose window holds one is compared.

The benchmark is shared with the executors in slices of at most `SLICE_WORDS` words; a larger benchmark takes one pass a slice.

Defined results: null or blank items and texts match nothing. An item or text with fewer than five words has one shingle, all its
words. Rows with one doc_id are judged each; a null doc_id is carried through. Extra columns of the documents stay in keep_clean()
and are dropped in leaks(). Empty tables give an empty result (keep_clean: the documents as they are). Whole texts are searched.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches, trimmed

SHINGLE = 5
RADIUS = 3
BLOCKS = 4
GRID = 4
SIZES = (4, 8, 12, 16, 20, 24)
SLICE_WORDS = 500_000
CHUNK = 16_384
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
WEIGHTS = np.array([1, 2, 4, 4], np.int8)
SCHEMA = "doc_id bigint, item_id bigint, start_word bigint, similarity double"
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Raw word to hash; the two lowest bits are the weight's class: the rarer among the items, the higher."""

    def __init__(self, classes: dict[bytes, int]):
        super().__init__()
        self.classes = classes

    def __missing__(self, raw: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        w = raw.strip(MARKS) or raw
        self[raw] = h = xxhash.xxh3_64_intdigest(w) & ~3 | self.classes.get(w, 3)
        return h


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _signed(h: np.ndarray) -> np.ndarray:
    """The 64 weighted signs of each word."""
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1).view(np.int8)
    return (bits * np.int8(2) - np.int8(1)) * WEIGHTS[(h & np.uint64(3)).astype(np.intp)][:, None]


def _sums(x: np.ndarray, wide: int) -> np.ndarray:
    """Sums of `wide` rows at every row, put together from sums of powers of two of rows."""
    n, at, size, out = len(x) - wide + 1, 0, 1, None
    while True:
        if wide & size:
            part = x[at : at + n]
            out, at = part if out is None else out + part, at + size
        size *= 2
        if size > wide:
            return out
        x = x[: len(x) - size // 2] + x[size // 2 :]


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view("<u8").ravel()


def _hashed(h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and weight of each run of k words."""
    m = len(h) - k + 1
    x, w = np.zeros(m, np.uint64), np.zeros(m, np.int64)
    weight = WEIGHTS[(h & np.uint64(3)).astype(np.intp)].astype(np.int64)
    for i in range(k):
        x = (x ^ h[i : i + m]) * _MIX
        x ^= x >> np.uint64(29)
        w += weight[i : i + m]
    return x, w


def _shingles(h: np.ndarray) -> dict[int, tuple[int, int]]:
    """Count and weight of each shingle of the words."""
    x, w = _hashed(h, min(SHINGLE, len(h)))
    n = Counter(x.tolist())
    return {s: (n[s], v) for s, v in zip(x.tolist(), w.tolist(), strict=True)}


def similarity(a: dict, b: dict) -> float:
    both = sum(min(n, b[s][0]) * w for s, (n, w) in a.items() if s in b)
    total = sum(n * w for n, w in a.values()) + sum(n * w for n, w in b.values())
    return both / (total - both) if total else 0.0


def window(n: int) -> tuple[int, int]:
    """Window size and grid of the texts' windows for an item of n words; what is too short for a grid takes every word."""
    room = int(0.6 * n) - GRID + 1 if n < 35 else (n - GRID + 1) // 2
    fit = [s for s in SIZES if s <= max(room, min(SIZES[0], n - GRID + 1))]
    return (fit[-1], GRID) if fit else (n, 1)


class Index:
    """Fingerprints of a benchmark slice by window size, with block tables, and its rare shingles by shingle size."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = 0.8, exact: bool = True):
        self.exact = exact  # False leaves fingerprints alone, to measure what they find
        split = [(i, [w.strip(MARKS) or w for w in _words(t)]) for i, t in items]
        split = [(i, w) for i, w in split if w]
        df = Counter(x for _, w in split for x in set(w))
        n = max(1, len(split))
        self.classes = {w: 0 if c > 0.1 * n else 1 if c > 0.03 * n else 2 for w, c in df.items() if n > 20}
        known = _Hashes(self.classes)
        self.known = known
        self.ids = [i for i, _ in split]
        self.words = [np.fromiter(map(known.__getitem__, w), np.uint64, len(w)) for _, w in split]
        self.shingles = [_shingles(h) for h in self.words]
        found: dict[tuple[int, int], list] = {}
        for k, h in enumerate(self.words):
            key = size, _ = window(len(h))
            sums = np.vstack([np.zeros((1, 64), np.int32), np.cumsum(_signed(h), axis=0, dtype=np.int32)])
            prints = _packed(sums[size:] - sums[:-size])
            found.setdefault(key, []).append((prints, np.full(len(prints), k), np.arange(len(prints))))
        self.prints = {key: tuple(map(np.concatenate, zip(*rows, strict=True))) for key, rows in found.items()}
        self._tables()
        self._probes(threshold)

    def _tables(self) -> None:
        """Of each window size and block: the fingerprints by the block's value, and where each value starts."""
        self.tables = {}
        for key, (prints, _, _) in self.prints.items():
            parts = prints.view("<u2").reshape(-1, BLOCKS)
            blocks = []
            for b in range(BLOCKS):
                count = np.bincount(parts[:, b], minlength=1 << 16)
                blocks.append((np.argsort(parts[:, b], kind="stable").astype(np.int32), (np.cumsum(count) - count).astype(np.int32), count.astype(np.int32)))
            self.tables[key] = blocks

    def _probes(self, threshold: float) -> None:
        held = Counter(x for s in self.shingles for x in s)
        self.sorted, found = [], {}
        for k, s in enumerate(self.shingles):
            keys = sorted(s)
            self.sorted.append((np.array(keys, np.uint64), np.array([s[x][0] for x in keys], np.int64), np.array([s[x][1] for x in keys], np.int64)))
            left = (1 - threshold) * sum(n * w for n, w in s.values()) + 1e-6
            for x in sorted(keys, key=lambda x: (held[x], -s[x][0] * s[x][1], x)):
                if left < 0:
                    break
                left -= s[x][0] * s[x][1]
                found.setdefault(min(SHINGLE, len(self.words[k])), []).append((x, k))
        self.probes = {}
        for k, pairs in found.items():
            pairs.sort()
            keys = np.array([p[0] for p in pairs], np.uint64)
            shift = np.uint64(64 - max(16, (16 * len(keys)).bit_length()))
            gate = np.zeros(1 << (64 - int(shift)), bool)
            gate[(keys >> shift).astype(np.intp)] = True
            self.probes[k] = keys, np.array([p[1] for p in pairs]), gate, shift

    def __reduce__(self) -> tuple:
        state = {k: v for k, v in self.__dict__.items() if k not in ("known", "tables")}  # each worker makes its own
        return _restored, (state,)

    def near(self, x: np.ndarray, key: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs (window, fingerprint) within RADIUS; they agree in a block, as RADIUS is below the number of blocks."""
        prints = self.prints[key][0]
        parts = x.view("<u2").reshape(-1, BLOCKS)
        out = []
        for b, (by, start, count) in enumerate(self.tables[key]):
            which = np.flatnonzero(count[parts[:, b]])
            v = parts[which, b]
            n = count[v]
            w = np.repeat(which, n)
            f = by[np.repeat(start[v] - np.cumsum(n) + n, n) + np.arange(len(w))]
            ok = np.bitwise_count(x[w] ^ prints[f]) <= RADIUS
            out.append(w[ok] * len(prints) + f[ok])
        pairs = np.unique(np.concatenate(out))
        return pairs // len(prints), pairs % len(prints)

    def candidates(self, h: np.ndarray) -> np.ndarray:
        """Rows (item, the word where it would start, the middle of the window that tells it) over a run of words."""
        found = [np.empty((0, 3), np.int64)]
        signed = _signed(h)
        steps: dict[int, np.ndarray] = {}
        for (size, grid), (_, item, offset) in self.prints.items():
            if grid not in steps:
                rows = signed[: len(signed) // grid * grid].astype(np.int16)
                steps[grid] = rows if grid == 1 else rows[0::4] + rows[1::4] + rows[2::4] + rows[3::4]
            wide = size // grid
            if len(steps[grid]) >= wide:
                w, f = self.near(_packed(_sums(steps[grid], wide)), (size, grid))
                found.append(np.stack([item[f], w * grid - offset[f], w * grid + size // 2], axis=1))
        return np.concatenate(found)

    def likely(self, flat: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first and last start) around the places that fingerprints tell."""
        hits = []
        for low in range(0, max(1, len(flat)), CHUNK):  # a longer text in pieces that overlap by a window and a grid step
            rows = self.candidates(flat[low : low + CHUNK + SIZES[-1] + GRID])
            hits.append(rows + np.array([0, low, low]))
        rows = np.unique(np.concatenate(hits), axis=0)
        text = np.searchsorted(ends, rows[:, 2], "right")
        for t, i, a in np.unique(np.stack([text, rows[:, 0], rows[:, 1]], axis=1), axis=0).tolist():
            slack = len(self.words[i]) // 8 + GRID
            yield t, i, a - slack, a + slack

    def ranges(self, flat: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first and last start) of the places whose windows hold a rare shingle of the item."""
        hits = []
        for k, (keys, items, gate, shift) in self.probes.items():
            for low in range(0, len(flat) - k + 1, CHUNK):
                x, _ = _hashed(flat[low : low + CHUNK + k - 1], k)
                at = np.flatnonzero(gate[(x >> shift).astype(np.intp)])
                i = np.searchsorted(keys, x[at], "left")
                n = np.searchsorted(keys, x[at], "right") - i
                q = np.repeat(at + low, n)
                item = items[np.repeat(i - np.cumsum(n) + n, n) + np.arange(len(q))]
                r = np.searchsorted(ends, q, "right")
                ok = q + k <= ends[r]  # not from one text into the next
                hits.append(np.stack([r[ok], item[ok], q[ok]]))
        if not hits:
            return
        for t, i, p in np.unique(np.concatenate(hits, axis=1).T, axis=0).tolist():
            n = len(self.words[i])
            yield t, i, p - n + min(SHINGLE, n), p

    def best(self, item: int, flat: np.ndarray, first: int, end: int, low: int, high: int, threshold: float) -> tuple[float, int]:
        """Similarity and place of the best start from low to high in the text from first to end; (0, first) if all are below the threshold."""
        keys, counts, weights = self.sorted[item]
        n = len(self.words[item])
        k, a = min(SHINGLE, n), max(first, low)
        x, w = _hashed(flat[a : min(end, high + n)], k)
        i = np.searchsorted(keys, x)
        i[i == len(keys)] = 0
        p = np.flatnonzero(keys[i] == x)
        i = i[p]
        own = int(counts @ weights)
        if np.minimum(np.bincount(i, minlength=len(keys)), counts) @ weights < threshold * own - 1e-6:
            return 0.0, first
        # a window counts the last of its equal shingles, as many as the item has: each over one run of starts
        by = np.argsort(i, kind="stable")
        i, p = i[by], p[by] + a
        start, stop = p - n + k, p.copy()
        later = np.arange(len(i)) + counts[i]
        more = later < len(i)
        more[more] = i[later[more]] == i[more]
        stop[more] = np.minimum(stop[more], p[later[more]] - n + k - 1)
        start, stop = np.maximum(start, low), np.minimum(stop, high)
        live = stop >= start
        size = high - low + 2
        steps = np.bincount(start[live] - low, weights[i[live]], size) - np.bincount(stop[live] + 1 - low, weights[i[live]], size)
        both = np.cumsum(np.rint(steps).astype(np.int64))[:-1]
        starts = np.arange(low, high + 1)
        sums = np.concatenate([[0], np.cumsum(w)])
        left = np.clip(np.maximum(starts, first) - a, 0, len(w))
        right = np.maximum(left, np.clip(np.minimum(starts + n, end) - k + 1 - a, 0, len(w)))
        s = both / (own + sums[right] - sums[left] - both)
        j = int(np.argmax(s))
        return float(s[j]), max(first, int(starts[j]))

    def search(self, texts: list[str | None], threshold: float) -> Iterator[tuple[int, int, int, float]]:
        """(text, item, start, similarity) of the best place of each item in each text where it reaches the threshold."""
        known = self.known
        runs = [np.fromiter(map(known.__getitem__, w), np.uint64, len(w)) for w in map(_words, texts)]
        group: list[int] = []
        held = 0
        for i, h in enumerate([*runs, None]):
            if group and (h is None or held + len(h) > CHUNK):
                yield from self._search(group, [runs[j] for j in group], threshold)
                group, held = [], 0
            if h is not None:
                group.append(i)
                held += len(h)

    def _search(self, which: list[int], runs: list[np.ndarray], threshold: float) -> Iterator[tuple[int, int, int, float]]:
        flat = np.concatenate(runs)
        ends = np.cumsum([len(r) for r in runs])
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for r, item, low, high in joined(self.likely(flat, ends), self.ranges(flat, ends) if self.exact else ()):
            first = int(ends[r]) - len(runs[r])
            n = len(self.words[item])
            low, high = max(low, first - n + 1), min(high, int(ends[r]) - 1)
            s, a = self.best(item, flat, first, int(ends[r]), low, high, threshold)
            if s >= threshold and ((r, item) not in best or (-s, a - first) < (-best[r, item][0], best[r, item][1])):
                best[r, item] = (s, a - first)
        for (r, item), (s, a) in sorted(best.items()):
            yield which[r], self.ids[item], a, s


def joined(*found: Iterable[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """Ranges (text, item, first, last) that touch become one."""
    at = None
    for r in sorted(chain(*found)):
        if at and at[:2] == r[:2] and r[2] <= at[3] + 1:
            at = (*at[:3], max(at[3], r[3]))
            continue
        if at:
            yield at
        at = r
    if at:
        yield at


def _restored(state: dict) -> Index:
    index = Index.__new__(Index)
    index.__dict__.update(state, known=_Hashes(state["classes"]))
    index._tables()
    return index


def _slices(benchmark: DataFrame) -> list[DataFrame]:
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    words = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n = -(-words // SLICE_WORDS)
    return [items] if n <= 1 else [items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i) for i in range(n)]


def _indexes(benchmark: DataFrame, threshold: float) -> Iterator:
    small_batches(benchmark.sparkSession)
    for part in _slices(benchmark):
        yield benchmark.sparkSession.sparkContext.broadcast(Index(sorted((r["item_id"], r["text"]) for r in part.collect()), threshold))


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, item_id, start_word and similarity of each item found in each row."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def found(index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hits = list(index.value.search(b.column("text").to_pylist(), threshold))
                yield pa.record_batch([b.column("doc_id").take(pa.array([h[0] for h in hits], pa.int64())), pa.array([h[1] for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.int64()), pa.array([h[3] for h in hits], pa.float64())], names=["doc_id", "item_id", "start_word", "similarity"])

        return rows.mapInArrow(trimmed(run), SCHEMA)

    return reduce(DataFrame.unionByName, map(found, _indexes(benchmark, threshold)))


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows in which no item is found, with the columns as they are."""
    at = docs.columns.index("text")

    def clean(rows: DataFrame, index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ok = np.ones(b.num_rows, bool)
                ok[[h[0] for h in index.value.search(b.column(at).to_pylist(), threshold)]] = False
                yield b.filter(pa.array(ok))

        return rows.mapInArrow(trimmed(run), docs.schema)

    return reduce(clean, _indexes(benchmark, threshold), docs)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
