"""N-gram Jaccard join: rare-first prefix filtering, then length, positional and suffix filters, one verification per pair.

1. A text's set is the hashes of its distinct word n-grams. Texts with equal sets share a signature and count once.
2. Hashes travel packed, dealt by hash range, to the task that holds all texts of a hash. A hash held by one text alone can link
   nothing; each text gets back only its shared hashes, with the number of texts that hold each (its frequency).
3. Rare first: a text's order is its unshared hashes, then its shared ones by (frequency, hash). Two texts with a similarity of at
   least t share one of their first n - ceil(t * n) + 1 hashes. A text whose unshared hashes fill this prefix is linked to nothing.
4. A posting (hash, text, size, position) meets the other postings of its hash. In the first round only with the hash's pivot,
   the posting of the text with the smallest share of unshared hashes; so a group of copies costs its size, not its square.
   After the links found are joined into components, the second round takes every pair of postings of a hash from different
   components. Pairs pass the length filter, the positional filter and the suffix filter (histograms of the shared hashes bound
   the overlap), are made distinct, and are verified on the whole sets. What is left unpaired lies in one component already, and
   components are exact. Texts of one signature stay one, with their number of rows.
5. Links lie inside components. join_counts() deals each component's texts into blocks of about BLOCK_HASHES hashes; a task takes a
   pair of blocks, joins the prefixes there with the same filters, verifies each pair once on the whole sets and gives one count for
   a text. So every link between different signatures counts, and no pair leaves a task: rows grow with the group, not its square
   (a component of b blocks is read b times). join_links() gives the links as rows: its second round takes every pair of
   postings of a hash, within components too.

Defined results: a null, empty or blank text has the empty set, links with nothing and is its own component. A text with fewer
than n words has one n-gram, its whole word sequence. Rows with one doc_id are one document each in the result, but name one
component; keep_representatives() lets them go together. Extra columns are dropped. An empty table gives an empty result. Sets are 64-bit hashes of n-grams.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, read, small_batches, trimmed, written

BATCH_HASHES = 1_000_000
BINS = 32
BLOCK_HASHES = 1_000_000
SALTS = 64
SCHEMA = "doc_id bigint, n_shingles bigint, component_id bigint"
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)]


class _Words(dict):
    def __missing__(self, w: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        self[w] = h = xxhash.xxh3_64_intdigest(w)
        return h


def shingles(text: str | None, n: int, words: _Words) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, w), np.uint64, len(w))
    k = min(n, len(w))
    m = len(h) - k + 1
    out = np.full(m, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + m]) * _M[0]
        out ^= out >> np.uint64(29)
    return np.unique(out * _M[3])


def signature(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else 0


def need(a: int, b: int, num: int, den: int) -> int:
    """The least overlap of sets of a and b elements whose similarity is num/den or more."""
    return -(-num * (a + b) // (num + den))


def _sets(n: int) -> Callable:
    """doc_id, signature, size and set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for b in batches:
            found = [shingles(t, n, words) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array([signature(s) for s in found], pa.int64()), pa.array([len(s) for s in found], pa.int64())], names=["doc_id", "sig", "n"])

    return run


def _dealt(n: int, buckets: int) -> Callable:
    """The hashes of a few thousand texts, by hash range: one packed row for each range."""

    def flush(sigs: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
        bucket = (flat >> np.uint64(32)).astype(np.int64) * buckets >> 32
        by = np.argsort(bucket, kind="stable")  # so owners ascend within a bucket
        for own in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
            who, count = np.unique(owner[own], return_counts=True)
            meta = np.array([sigs[i] for i in who], np.int64), np.array([len(sets[i]) for i in who], np.int32), count.astype(np.int32)
            yield pa.record_batch([pa.array([int(bucket[own[0]])], pa.int32())] + [pa.array([zstandard.compress(x.tobytes(), 1)], pa.binary()) for x in meta] + [pa.array([flat[own].tobytes()], pa.binary())], names=["bucket", "sigs", "sizes", "counts", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sigs, sets, seen, held = _Words(), [], [], set(), 0
        for b in batches:
            for text in b.column("text").to_pylist():
                s = shingles(text, n, words)
                sig = signature(s)
                if not len(s) or sig in seen:
                    continue
                seen.add(sig)
                sigs.append(sig)
                sets.append(s)
                held += len(s)
                if held >= BATCH_HASHES:
                    yield from flush(sigs, sets)
                    sigs, sets, seen, held = [], [], set(), 0
        if sets:
            yield from flush(sigs, sets)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one bucket after the other; out goes, for each text, the shared hashes of the bucket with their frequencies."""
    at, parts = None, []

    def close() -> Iterator[pa.RecordBatch]:
        hashes, sigs = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        sizes = np.concatenate([p[2] for p in parts])
        by = np.lexsort((sigs, hashes))
        hashes, sigs, sizes = hashes[by], sigs[by], sizes[by]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (sigs[1:] != sigs[:-1])  # equal texts of two batches are one
        hashes, sigs, sizes = hashes[new], sigs[new], sizes[new]
        _, inverse, df = np.unique(hashes, return_inverse=True, return_counts=True)
        df = df[inverse]
        keep = df > 1
        hashes, sigs, sizes, df = hashes[keep], sigs[keep], sizes[keep], df[keep]
        by = np.argsort(sigs, kind="stable")
        own = np.split(by, np.flatnonzero(np.diff(sigs[by])) + 1) if len(by) else []
        for i in range(0, len(own), 20_000):
            piece = own[i : i + 20_000]
            yield pa.record_batch(
                [pa.array([int(sigs[x[0]]) for x in piece], pa.int64()), pa.array([int(sizes[x[0]]) for x in piece], pa.int32()), pa.array([hashes[x].tobytes() for x in piece], pa.binary()), pa.array([df[x].astype(np.int32).tobytes() for x in piece], pa.binary())],
                names=["sig", "n", "hashes", "dfs"],
            )

    for b in batches:
        for bucket, sigs, sizes, counts, hashes in zip(*(b.column(c).to_pylist() for c in ("bucket", "sigs", "sizes", "counts", "hashes")), strict=True):
            if bucket != at and parts:
                yield from close()
                parts = []
            at = bucket
            count = np.frombuffer(zstandard.decompress(counts), np.int32)
            parts.append((np.frombuffer(hashes, np.uint64), np.repeat(np.frombuffer(zstandard.decompress(sigs), np.int64), count), np.repeat(np.frombuffer(zstandard.decompress(sizes), np.int32), count)))
    if parts:
        yield from close()


def _text_rows(num: int, den: int) -> Callable:
    """Sorted rows of a text after each other: its candidate row, if its prefix reaches a shared hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, size, parts = None, 0, []
        out: list[tuple] = []

        def close() -> None:
            hashes = np.frombuffer(b"".join(p[0] for p in parts), np.uint64)
            df = np.frombuffer(b"".join(p[1] for p in parts), np.int32)
            alone = size - len(hashes)
            # at least num/den of the text must be shared with any partner
            if len(hashes) < -(-num * size // den):
                return
            prefix = size - -(-num * size // den) + 1 - alone
            first = np.lexsort((hashes, df))[:prefix]
            bins = np.bincount((hashes >> np.uint64(59)).astype(np.int64), minlength=BINS).astype(np.int32)
            out.append((at, size, alone, hashes[first].astype(np.uint64).view(np.int64), bins.tobytes(), np.sort(hashes).tobytes()))

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["sig", "n", "alone", "prefix", "bins", "shared"])

        for b in batches:
            for sig, n, hashes, dfs in zip(*(b.column(c).to_pylist() for c in ("sig", "n", "hashes", "dfs")), strict=True):
                if sig != at and parts:
                    close()
                    parts = []
                at, size = sig, n
                parts.append((hashes, dfs))
            if len(out) > 500:
                yield batch()
                out.clear()
        if parts:
            close()
        yield batch()

    return run


def _suffix(num: int, den: int) -> Callable:
    """Pairs whose histograms of shared hashes allow the overlap that their sizes need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.int32).reshape(-1, BINS) for c in ("bins_a", "bins_b"))
                total = b.column("n_a").to_numpy().astype(np.int64) + b.column("n_b").to_numpy()
                ok = np.minimum(x, y).sum(1) * (num + den) >= num * total
                yield b.select(["a", "b"]).filter(pa.array(ok))

    return run


def _verified(num: int, den: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y, n, m in zip(b.column("set_a"), b.column("set_b"), b.column("n_a").to_pylist(), b.column("n_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum()) if len(y) else 0
                ok.append(den * both >= num * (n + m - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices of all ranges, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def partners(n: np.ndarray, side: np.ndarray, alone: np.ndarray, prefixes: list[np.ndarray], bins: np.ndarray, sets: list[np.ndarray], num: int, den: int, across: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Texts in order of size, each with the later ones it links with; across: with those of the other side."""
    sizes = np.array([len(x) for x in sets], np.int64)
    _, local = np.unique(np.concatenate(sets), return_inverse=True)
    starts, mark = np.cumsum(sizes) - sizes, np.zeros(local.max(initial=-1) + 1, np.uint8)
    # postings of the prefixes: by hash, in a hash by text
    lengths = np.array([len(x) for x in prefixes], np.int64)
    text = np.repeat(np.arange(len(n)), lengths)
    at = _ranges(alone, lengths)
    hashes = np.concatenate(prefixes)
    by = np.argsort(hashes, kind="stable")
    text_by, at_by = text[by], at[by]
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    ends = np.searchsorted(hashes[by], hashes, side="right")
    first = np.cumsum(lengths) - lengths
    for x in range(len(n)):
        own = slice(first[x], first[x] + lengths[x])
        later = ends[own] - place[own] - 1
        found = _ranges(place[own] + 1, later)
        y = text_by[found]
        needed = num * (n[x] + n[y])
        room = np.minimum(n[x] - np.repeat(at[own], later), n[y] - at_by[found])
        ok = (n[x] * den >= n[y] * num) & (room * (num + den) >= needed)
        if across:
            ok &= side[y] != side[x]
        y = np.flatnonzero(np.bincount(y[ok], minlength=1))
        y = y[np.minimum(bins[x], bins[y]).sum(1) * (num + den) >= num * (n[x] + n[y])]
        if len(y):
            mine = local[starts[x] : starts[x] + sizes[x]]
            mark[mine] = 1
            hit = mark[local[_ranges(starts[y], sizes[y])]]
            mark[mine] = 0
            both = np.add.reduceat(hit, np.cumsum(sizes[y]) - sizes[y], dtype=np.int64)
            y = y[den * both >= num * (n[x] + n[y] - both)]
        yield x, y


def _block_counts(num: int, den: int) -> Callable:
    """Sorted rows of a pair of blocks after each other: for each text the number of rows that its links hold there."""

    def count(rows: list[tuple], across: bool) -> tuple[np.ndarray, np.ndarray]:
        rows.sort(key=lambda r: (r[2], r[1]))  # by size, then signature
        side, sig, n, alone, held = (np.array([r[i] for r in rows], np.int64) for i in (0, 1, 2, 3, 4))
        prefixes = [np.array(r[5], np.int64) for r in rows]
        bins = np.frombuffer(b"".join(r[6] for r in rows), np.int32).reshape(-1, BINS)
        others = np.zeros(len(rows), np.int64)
        for x, y in partners(n, side, alone, prefixes, bins, [np.frombuffer(r[7], np.uint64) for r in rows], num, den, across):
            others[x] += held[y].sum()
            others[y] += held[x]
        return sig, others

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, out, size = None, [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array(np.concatenate([o[i] for o in out]), pa.int64()) for i in range(2)], names=["sig", "others"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("component", "low", "high", "side", "sig", "n", "alone", "held", "prefix", "bins", "shared")), strict=True):
                if row[:3] != at and rows:
                    out.append(count(rows, at[1] != at[2]))
                    size, rows = size + len(rows), []
                    if size > 20_000:
                        yield batch()
                        out, size = [], 0
                at = row[:3]
                rows.append(row[3:])
        if rows:
            out.append(count(rows, at[1] != at[2]))
        if out:
            yield batch()

    return run


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes of the edges (a, b): alternating large-star and small-star steps until nothing changes."""
    edges = written(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").distinct(), "links", slim=True)
    for _ in range(rounds):
        # large star: every node's larger neighbours go to the smallest of its neighbourhood
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        # small star: every node and its smaller neighbours go to the smallest of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v")
        moved = small.select(F.col("m").alias("x"), F.col("u").alias("y")).union(small.select(F.col("m").alias("x"), F.col("v").alias("y")))
        after = written(moved.where("x < y").select(F.col("x").alias("u"), F.col("y").alias("v")).distinct(), "links", slim=True)
        # done when every node has one parent and no parent has one itself, which holds if nothing changed
        marks = [d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for d in (edges, after)]
        drop(edges)
        edges = after
        if marks[0] == marks[1]:
            break
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).union(edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def _pairs(left: DataFrame, right: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs a < b of postings of one hash that pass the length and the positional filter."""
    return left.alias("l").join(right.alias("r"), F.col("l.hash") == F.col("r.hash")).where(_reach("l", "r", num, den))


def _reach(l: str, r: str, num: int, den: int) -> Column:
    la, lb = F.col(f"{l}.n").cast("bigint"), F.col(f"{r}.n").cast("bigint")
    needed = num * (la + lb)  # over (num + den)
    # of the pair's first common hash: all that may overlap is this hash and what follows it in both orders
    room = F.least(F.col(f"{l}.n") - F.col(f"{l}.at"), F.col(f"{r}.n") - F.col(f"{r}.at")).cast("bigint")
    return (F.least(la, lb) * den >= F.greatest(la, lb) * num) & (room * (num + den) >= needed)


def _all_pairs(postings: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (l, r) of postings of one hash, l the smaller text, that pass the length and the positional filter.

    The room behind a posting bounds the size of its partners. The smaller text looks for them in bands of sizes up to its bound, and
    not at all where the bound is below its own size; so texts that share a passage which is too small a part of them do not meet.
    """
    n = F.col("n").cast("bigint")
    most = F.least(F.floor((n - F.col("at")) * (num + den) / num) - n, F.floor(n * den / num)).cast("bigint")

    def band(size: Column) -> Column:
        return F.floor(F.log(size.cast("double")) / math.log(den / num)).cast("int")

    seek = postings.withColumn("most", most).where(F.col("most") >= n).withColumn("band", F.explode(F.sequence(band(n), band(F.col("most"))))).drop("most")
    own = postings.withColumn("band", band(n))
    pairs = seek.alias("l").join(own.alias("r"), (F.col("l.hash") == F.col("r.hash")) & (F.col("l.band") == F.col("r.band")))
    first = (F.col("l.n") < F.col("r.n")) | (F.col("l.n") == F.col("r.n")) & (F.col("l.sig") < F.col("r.sig"))
    return pairs.where(first & _reach("l", "r", num, den))


def linked(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5), whole: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(doc_id, sig, n) of every row, (sig, component) of the signatures that have links, links (a, b), if `whole` all of them, and candidate rows."""
    spark, (num, den) = docs.sparkSession, (threshold.numerator, threshold.denominator)
    small_batches(spark)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = written(rows.mapInArrow(trimmed(_sets(n)), "doc_id bigint, sig bigint, n bigint"), "jaccard-sets", slim=True)
    buckets = 4 * width
    dealt = rows.select("text").mapInArrow(trimmed(_dealt(n, buckets)), "bucket int, sigs binary, sizes binary, counts binary, hashes binary").repartition(width, "bucket").sortWithinPartitions("bucket")
    shared = dealt.mapInArrow(trimmed(_shared), "sig bigint, n int, hashes binary, dfs binary").repartition(width, "sig").sortWithinPartitions("sig")
    cand = written(shared.mapInArrow(trimmed(_text_rows(num, den)), "sig bigint, n int, alone int, prefix array<bigint>, bins binary, shared binary"), "jaccard-texts")
    postings = cand.select("sig", "n", "alone", F.posexplode("prefix").alias("pos", "hash")).select("sig", "n", "alone", (F.col("alone") + F.col("pos")).alias("at"), "hash")
    sets = cand.select("sig", "n", "bins", "shared")

    def verify(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that hold the threshold; the histograms are compared before the sets are fetched."""
        slim = sets.select("sig", "n", "bins")
        near = pairs.join(slim.select(F.col("sig").alias("a"), F.col("n").alias("n_a"), F.col("bins").alias("bins_a")), "a").join(slim.select(F.col("sig").alias("b"), F.col("n").alias("n_b"), F.col("bins").alias("bins_b")), "b")
        near = near.mapInArrow(trimmed(_suffix(num, den)), "a bigint, b bigint")
        whole = near.join(sets.select(F.col("sig").alias("a"), F.col("n").alias("n_a"), F.col("shared").alias("set_a")), "a").join(sets.select(F.col("sig").alias("b"), F.col("n").alias("n_b"), F.col("shared").alias("set_b")), "b")
        return whole.mapInArrow(trimmed(_verified(num, den)), "a bigint, b bigint")

    # round 1: each posting with the pivot of its hash; a is the pivot
    order = F.struct((F.col("alone") / F.col("n")).alias("share"), F.col("sig").alias("sig"), F.col("n").alias("n"), F.col("alone").alias("alone"), F.col("at").alias("at"))
    pivots = postings.groupBy("hash").agg(F.min(order).alias("p"), F.count("*").alias("held")).where("held > 1").select("hash", "p.sig", "p.n", "p.at")
    tried = written(_pairs(pivots, postings, num, den).where("l.sig != r.sig").select(F.col("l.sig").alias("a"), F.col("r.sig").alias("b")).distinct(), "jaccard-pairs", slim=True)
    links = written(verify(tried), "jaccard-links", slim=True)
    first = components(links)
    # round 2: what postings are left, of different components or all
    if whole:
        rest = _all_pairs(postings, num, den)
    else:
        named = postings.join(first.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "n", "at", "hash", F.coalesce("component", "sig").alias("c"))
        named = written(named, "jaccard-postings")
        mixed = named.groupBy("hash").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 < c2").select("hash")
        left = named.join(mixed, "hash", "left_semi")
        rest = _all_pairs(left, num, den).where("l.c != r.c")
    rest = rest.select(F.least("l.sig", "r.sig").alias("a"), F.greatest("l.sig", "r.sig").alias("b")).distinct()
    rest = rest.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    found = written(verify(rest), "jaccard-links", slim=True)
    every = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().union(found)
    return texts, components(every).withColumnRenamed("node", "sig"), every, cand


def _named(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """(sig, component_id) of every signature; one row for each, so that no group of equal texts is gathered anywhere."""
    least = texts.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least"))
    named = written(least.join(parts, "sig", "left").withColumn("component", F.coalesce("component", "sig")), "jaccard-names", slim=True)
    roots = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return named.join(roots, "component").select("sig", "component_id")


def join_components(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id that links reach, of every row."""
    texts, parts, _, _ = linked(docs, n, threshold)
    return _rows(texts, parts)


def _rows(texts: DataFrame, parts: DataFrame, *more: str) -> DataFrame:
    ids = _named(texts, parts)
    return texts.join(ids, (texts["sig"] == ids["sig"]) & (texts["n"] > 0), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *[texts[c] for c in more])


def join_links(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5)) -> tuple[DataFrame, DataFrame]:
    """The rows of join_components with sig and n_links, the number of other rows that a row is linked with, and the links.

    Links (sig_a, sig_b) are all pairs of different signatures at the threshold or above; rows of one signature are linked, too.
    """
    texts, parts, links, _ = linked(docs, n, threshold, whole=True)
    held = _held(texts)
    both = links.union(links.select("b", "a")).toDF("sig", "other")
    others = both.join(held.toDF("other", "held"), "other").groupBy("sig").agg(F.sum("held").alias("others"))
    return _with_counts(texts, parts, held, others), links.toDF("sig_a", "sig_b")


def join_counts(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5), block_hashes: int = BLOCK_HASHES) -> DataFrame:
    """The rows that join_links() gives, counted block by block inside components, so that no pairs are made as rows."""
    num, den = threshold.numerator, threshold.denominator
    texts, parts, _, cand = linked(docs, n, threshold)
    held, parts = _held(texts), written(parts, "jaccard-parts", slim=True)
    salt = F.pmod(F.xxhash64("sig"), F.lit(SALTS))
    members = cand.join(held, "sig").join(parts, "sig").withColumn("salt", salt)
    sizes = cand.select("sig", F.length("shared").alias("bytes")).join(parts, "sig").groupBy("component").agg(F.ceil(F.sum("bytes") / (8 * block_hashes)).cast("int").alias("blocks"))
    # only components of several blocks have a row, once for each salt, as one component may hold most texts
    large = sizes.where("blocks > 1").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    dealt = members.join(large, ["component", "salt"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("side", F.pmod(F.hash("sig"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("side", "other")).withColumn("high", F.greatest("side", "other"))
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select("component", "low", "high", "side", "sig", "n", "alone", "held", "prefix", "bins", "shared").repartition(width, "component", "low", "high").sortWithinPartitions("component", "low", "high")
    others = dealt.mapInArrow(trimmed(_block_counts(num, den)), "sig bigint, others bigint").groupBy("sig").agg(F.sum("others").alias("others"))
    return _with_counts(texts, parts, held, others)


def _held(texts: DataFrame) -> DataFrame:
    return texts.where("n > 0").groupBy("sig").agg(F.count("*").alias("held"))


def _with_counts(texts: DataFrame, parts: DataFrame, held: DataFrame, others: DataFrame) -> DataFrame:
    counts = held.join(others, "sig", "left").select(F.col("sig").alias("s"), (F.col("held") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    counted = texts.join(counts, (F.col("sig") == F.col("s")) & (F.col("n") > 0), "left").select("doc_id", "sig", "n", F.coalesce("links", F.lit(0)).alias("n_links"))
    return _rows(written(counted, "jaccard-counts", slim=True), parts, "sig", "n_links")


def keep_representatives(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """The rows whose doc_id is the smallest of its component, and those with an empty set or a null doc_id; columns as they are."""
    gone = join_components(docs, n, threshold).where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(gone, docs["doc_id"].cast("bigint") == gone["doc_id"], "left_anti")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_counts(read(spark, sf_dir, "documents"), 4, Fraction(85, 100)).drop("sig")


#: All pairs that share a shingle, counted and compared; components by reachability. For small tables: copies are paired with copies.
ORACLE = r"""
with recursive worded as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s
  from worded),
shingles as (select doc_id, len(s) as n, unnest(s) as g from sets),
links as (
  select l.doc_id as a, r.doc_id as b from shingles l join shingles r on l.g = r.g and l.doc_id != r.doc_id
  group by l.doc_id, r.doc_id, l.n, r.n having 100 * count(*) >= 85 * (l.n + r.n - count(*))),
reached as (select doc_id as a, doc_id as b from sets union select reached.a, links.b from reached join links on reached.b = links.a),
parts as (select a, min(b) as component_id from reached group by a),
counts as (select a, count(*) as n_links from links group by a)
select sets.doc_id, cast(len(s) as bigint) as n_shingles, component_id, cast(coalesce(n_links, 0) as bigint) as n_links
from sets join parts on sets.doc_id = parts.a left join counts on sets.doc_id = counts.a
"""
