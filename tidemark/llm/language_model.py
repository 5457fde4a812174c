"""LM scoring by online logistic context mixing over the bits of a word code.

A text is a sequence of units: its words as they are written, white-space characters other than single spaces, and an end; units()
loses nothing. A Huffman code of the `LEAVES` most frequent units and one leaf for all others turns a unit into binary decisions,
some nine where its bytes would take fifty. Four predictors give each decision a probability. Three look up the counts of
zeros and ones that the training texts had at this node of the code in a context: none, the nearest of the last 3 units that
is in the code and how near it is, or the last 3 units of the text (fewer at its start). The fourth learns while it codes the text: it
expects the unit that followed the last place of the same text with the same unit (better: the same 3) before it. Three sets of
weights, gated by how many orders know the context, by how often the longest context was seen, and by what the fourth expects, each
with the depth in the code, mix the predictions in the logistic domain; a table of adaptive probability maps, by depth, refines the
result. Weights and maps learn online: a task codes its training texts one after the other, then moves the weights and counts each
decision. Meanwhile the first two orders know what the task counted before, the last one what all other places of the training texts
say. Counts are summed over the tasks, states averaged by the number of decisions behind each weight. A unit outside the code is
named by a mixture of its exact training count (what is learnt grows with the corpus) and of its spelling, byte after byte given the
last 1, 2 and 3 bytes, weighed by how many such units came once. The parts add up to score, the log10 probability of the text. It
depends on the text and on the state alone, not on where or after which texts it is scored; the state depends on the split of the
training texts over tasks and blocks, as averages do.

Texts are read once and written in blocks, as numbers of the block's distinct units. Two shuffles then ask for what all blocks know of
a block's units (by the unit: exact counts, from which the code's units are chosen) and of its events, a context of 3 units and the
leaf that follows (by the context). An answer holds for each step of the leaf's path how often the context came and went on along it:
no context shares its counts with another, but for 53-bit hashes that collide. The orders before have a slot for each
context and node. The answers come to the blocks by a third shuffle; then two passes learn and score. The fourth predictor's memory
is the present stretch of `STRETCH` units of the text. (Decisions without answers, in tests, hash the last order into slots.)

Defined results: a null or empty text is one end. Rows with a null doc_id are training rows. Rows that
repeat are counted and scored each. Extra columns are dropped. An empty table gives an empty result; without training rows every
count is 0, and the tables have no contexts.
"""

from __future__ import annotations

import contextlib
import heapq
import itertools
import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import planes, unpack, unplanes
from .common import drop, read, small_batches, trimmed, written

ORDERS = (0, 1, 3)
INPUTS = len(ORDERS) + 1
LEAVES = 2047
LEAD = ORDERS[-1]
BITS = 22  # of the slots of the last order where no exact counts are given
STARTS = np.cumsum([0, LEAVES, (1 + LEAD * LEAVES) * LEAVES, 1 << BITS])  # one slot for each node and context of the first two orders
PLACES = np.uint64(LEAVES)  # the low 11 bits of an event hold its leaf's place, all others its context
STRETCH = 8_192
PIECE_UNITS = 1 << 14  # hashed at once, so that what is in between stays in the cache
CHUNK_UNITS = 3_000  # after which the counts are moved
SCORED_UNITS = 10_000  # worked on at once where nothing is learnt; no result depends on it
BLOCK_BYTES = 5_000_000
BATCH_BYTES = 4_000_000  # of packed values, which are large: the JVM and Python each hold a batch
EVENTS = 200_000  # worked on at once
ROWS = 1 << 14  # of contexts of 2 and of 3 bytes; those that share a row share its counts
PRIOR = 4.0
END = b" "  # no unit holds a space
NO_WORDS = (b"", END, b"\n", b"\t", b"\r", b"\x0b", b"\x0c")
BLOCK = "block bigint, payload binary"
PACKED = "dest int, kind int, block bigint, n bigint, payload binary"
JOINED = "payload binary, words binary, contexts binary"
PIECE = "slice int, payload binary"
SCHEMA = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
_MIX, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
MAPS = 33
SLICES = 64  # of the tables and of the weights, summed by different tasks


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))


def _numbers() -> defaultdict[bytes, int]:
    """Numbers units in the order in which they are looked up first."""
    return defaultdict(itertools.count().__next__)


def pack(*parts: np.ndarray | bytes) -> bytes:
    """As bpe.pack(), with less time spent on compression."""
    raw = [p if isinstance(p, bytes) else p.tobytes() for p in parts]
    return zstandard.compress(np.array([len(raw), *map(len, raw)], np.int64).tobytes() + b"".join(raw), 1)


def _record(rows: list[tuple]) -> pa.RecordBatch:
    dest, kind, block, n, payload = zip(*rows, strict=True)
    return pa.record_batch([pa.array(dest, pa.int32()), pa.array(kind, pa.int32()), pa.array(block, pa.int64()), pa.array(n, pa.int64()), pa.array(payload, pa.binary())], names=["dest", "kind", "block", "n", "payload"])


def units(raw: bytes) -> list[bytes]:
    """Words, single white-space characters other than the space, and an empty unit for a space after a space; joined by spaces they
    give the text, with a space to take away on both sides of every white-space unit. The end is a unit, too. numbered() finds the same."""
    for space in NO_WORDS[2:]:
        if space in raw:
            raw = raw.replace(space, b" " + space + b" ")
    out = raw.split(b" ") if raw else []
    out.append(END)
    return out


class Hashes(dict):
    def __missing__(self, unit: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        self[unit] = h = xxhash.xxh3_64_intdigest(unit)
        return h


def hashed(found: list[bytes], hashes: Hashes) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))


class Code:
    """A Huffman code of units and of one leaf for all others: for each leaf the nodes from the root and the bits taken there."""

    def __init__(self, words: list[bytes], counts: list[float]):
        self.words, self.counts = words, counts  # one count more, for all others
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        self.order = np.argsort(h)
        self.hashes = np.append(h[self.order], np.uint64(2**64 - 1))
        self.order = np.append(self.order, len(words))
        n = len(counts)
        heap = [(float(c) + 1, i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        up, side, top = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int64), n
        below, under = [()] * n, [1] * n
        while len(heap) > 1:
            (x, i), (y, j) = heapq.heappop(heap), heapq.heappop(heap)
            up[i] = up[j] = top
            side[j] = 1
            heapq.heappush(heap, (x + y, top))
            below.append((i, j))
            under.append(under[i] + under[j])
            top += 1
        first = [0] * (2 * n - 1)
        for k in range(2 * n - 2, n - 1, -1):
            i, j = below[k]
            first[i], first[j] = first[k], first[k] + under[i]
        self.place = np.array(first[:n], np.uint64)  # leaves below a node have neighbouring places
        self.at_place = np.argsort(self.place)
        self.first, self.last = np.array(first[n:], np.uint64), np.array([a + b - 1 for a, b in zip(first[n:], under[n:], strict=True)], np.uint64)
        depth = np.zeros(2 * n - 1, np.int64)
        for i in range(2 * n - 3, -1, -1):
            depth[i] = depth[up[i]] + 1
        self.sizes = depth[:n]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.nodes, self.bits = np.empty(self.sizes.sum(), np.int64), np.empty(self.sizes.sum(), np.int64)
        at, below = np.arange(n), np.arange(n)
        left = self.sizes.copy()
        while len(at):
            left[at] -= 1
            self.nodes[self.starts[at] + left[at]] = up[below] - n
            self.bits[self.starts[at] + left[at]] = side[below]
            go = left[at] > 0
            at, below = at[go], up[below][go]

        step = np.arange(len(self.bits)) - np.repeat(self.starts, self.sizes)
        self.gates, self.rows = np.minimum(step, 7), np.minimum(step, Mixer.ROWS - 1) * MAPS  # of the depth
        self.cells, self.ways = 2 * self.rows + self.bits, 2 * self.nodes + self.bits
        self.expects = (6 * self.bits - 3).astype(np.float32)
        self.signs, self.ones, self.zeros = ((2 * self.bits - 1).astype(np.float32), self.bits.astype(np.float32), (1 - self.bits).astype(np.float32))

    def __reduce__(self) -> tuple:
        return Code, (self.words, self.counts)  # made again where it is used: these are smaller

    def leaf(self, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, h)
        return np.where(self.hashes[at] == h, self.order[at], len(self.words))


def chunks(texts: Iterator[tuple[int, np.ndarray]], units: int = CHUNK_UNITS) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Stretches of the texts' unit hashes, some at once: the text's number, the place of the first unit coded, the hashes from LEAD before it."""
    held, size = [], 0
    for number, h in texts:
        for at in range(0, len(h), STRETCH):
            held.append((number, at, h[max(0, at - LEAD) : at + STRETCH]))
            size += len(held[-1][2])
            if size >= units:
                yield held
                held, size = [], 0
    if held:
        yield held


def runs(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n numbers from each start on."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def contexts(flat: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A hash of the LEAD units before each unit, fewer where its place in the text is smaller."""
    out = np.zeros(len(flat), np.uint64)
    for a in range(0, len(flat), PIECE_UNITS):
        h, at = out[a : a + PIECE_UNITS], place[a : a + PIECE_UNITS]
        for back in range(1, LEAD + 1):
            none = min(max(0, back - a), len(h))
            before = np.zeros(len(h), np.uint64)
            before[none:] = flat[a + none - back : a + len(h) - back]
            before *= at >= back
            before += np.array([back], np.uint64) * _TURN
            h ^= before
            h *= _MIX
            h ^= h >> np.uint64(31)
    return out


class Followers:
    """Exact training counts after the contexts of a block: how often each event's context came, and went on along its leaf's path.

    `leaf` and `far` are each unit's leaf and its context's hash, `starts` is where the texts start. `seen` holds what a mixer makes of counts:
    the stretched prediction in the high bits, its part of the gates' number in the low ones. A unit's are in `own`, one for all steps of its path, where
    nothing else follows (stride 0); else (`STEPS`) `own` holds where in `seen` those of the steps start (stride 1: one for each step and one more).
    """

    STEPS = np.uint64(1 << 31)

    def __init__(self, found: Events, code: Code, stride: np.ndarray, counts: np.ndarray, less: int):
        self.leaf, self.far, self.starts = found.leaf, found.far, found.starts
        some = np.flatnonzero(stride)
        kept = np.ones(len(found.keys), np.int64)
        kept[some] += code.sizes[code.at_place[(found.keys[some] & PLACES).astype(np.int64)]]
        first = np.cumsum(kept) - kept
        now = counts.astype(np.float32)
        then = np.append(now[1:], np.float32(0))  # past an event's last count of its own it is never looked up
        then[first] = np.where(stride, then[first], now[first])
        now -= np.float32(less)
        gates = _GATES.take(level(now))
        now -= then
        now += np.float32(less)
        then -= np.float32(less)
        self.seen = stretch(then, now).view(np.uint32).astype(np.uint64)
        self.seen <<= np.uint64(32)
        self.seen |= gates
        own = self.seen[first]
        own[some] = first[some].astype(np.uint64) << np.uint64(32) | self.STEPS
        self.own = np.empty(len(found.by), np.uint64)
        self.own[found.by] = np.repeat(own, np.diff(found.first, append=len(found.by)))


def stretch(one: np.ndarray, zero: np.ndarray) -> np.ndarray:
    return odds(np.maximum(one, 0) + np.float32(0.02), np.maximum(zero, 0) + np.float32(0.02))


def odds(one: np.ndarray, zero: np.ndarray) -> np.ndarray:
    x = one / zero
    np.log(x, out=x)
    return np.clip(x, -12, 12, out=x)


def level(seen: np.ndarray) -> np.ndarray:
    """One more than the whole part of a count's binary logarithm, 0 for 0, 15 at most."""
    return np.clip((seen.view(np.int32) >> 23) - 126, 0, 15)


#: The part of the gates' number that is due to the level of the last order.
_GATES = np.array([last * 24 + (last > 1) * 384 for last in range(16)], np.uint64)


class Events:
    """Distinct events of a block's texts in order (53 bits of the context's hash, 11 for the leaf), the order of its units by event (`by`), and each event's first place there."""

    def __init__(self, h: np.ndarray, leaf: np.ndarray, sizes: np.ndarray, code: Code):
        self.leaf, self.starts = leaf.astype(np.int16), np.cumsum(sizes) - sizes
        self.far = contexts(h, runs(np.zeros(len(sizes), np.int64), sizes))
        self.far &= ~PLACES
        key = self.far | code.place[leaf]
        self.by = np.argsort(key)
        key = key[self.by]
        self.first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        self.keys = key[self.first]


def followed(keys: np.ndarray, counts: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray]:
    """For distinct events in order and their training counts: strides and counts as Followers holds them."""
    leaf = code.at_place[(keys & PLACES).astype(np.int64)]
    start = np.flatnonzero(np.append(True, (keys[1:] | PLACES) != (keys[:-1] | PLACES)))
    came = np.repeat(np.add.reduceat(counts, start), np.diff(np.append(start, len(keys))))
    stride = came != counts
    some = np.flatnonzero(stride)
    kept = np.ones(len(keys), np.int64)
    kept[some] += code.sizes[leaf[some]]
    first = np.cumsum(kept) - kept
    out = np.empty(kept.sum(), np.int64)
    out[first] = came
    out[first[some] + kept[some] - 1] = counts[some]
    inner = kept[some] - 2
    step = np.arange(inner.sum()) - np.repeat(np.cumsum(inner) - inner, inner) + 1
    node = code.nodes[np.repeat(code.starts[leaf[some]], inner) + step]
    context = np.repeat(keys[some] & ~PLACES, inner)
    up_to = np.append(0, np.cumsum(counts))
    out[np.repeat(first[some], inner) + step] = up_to[np.searchsorted(keys, context | code.last[node], "right")] - up_to[np.searchsorted(keys, context | code.first[node])]
    return stride, out


class Decisions:
    """The decisions of a chunk's units: places in the code's paths, slots by order, what the match expects and where, gates.

    With exact counts of the last order they hold what these predict (`stretched`; their levels are in the gates) and no slots of it.
    """

    def __init__(self, chunk: list[tuple[int, int, np.ndarray]], code: Code, exact: Followers | None = None):
        flat = np.concatenate([h for _, _, h in chunk])
        sizes = np.array([len(h) for _, _, h in chunk], np.int64)
        lead = np.array([min(at, LEAD) for _, at, _ in chunk], np.int64)
        place = runs(np.zeros(len(sizes), np.int64), sizes)  # from LEAD before the stretch, or from the text's start
        coded = place >= np.repeat(lead, sizes)
        if exact is None:
            leaves, far = code.leaf(flat), contexts(flat, place)
        else:
            where = [slice(a := exact.starts[k] + max(0, at - LEAD), a + len(h)) for k, at, h in chunk]
            leaves, far = np.concatenate([exact.leaf[w] for w in where]).astype(np.int64), np.concatenate([exact.far[w] for w in where])
        near = self._frequent(leaves, len(code.words), place)
        leaf = leaves[coded]
        n = code.sizes[leaf]
        begin = np.cumsum(n) - n  # of each unit's decisions
        self.code, self.texts = code, np.array([k for k, _, _ in chunk], np.int64)
        self.begin = begin[np.cumsum(sizes - lead) - (sizes - lead)]  # of each stretch's
        of = np.repeat(np.arange(len(n)), n)
        self.at = (code.starts[leaf] - begin).take(of)
        self.at += np.arange(len(of))
        self.slots = np.empty((len(ORDERS) - (exact is not None), len(of)), np.int64)
        node = code.nodes.take(self.at, out=self.slots[0], mode="clip")
        np.add((STARTS[1] + near[coded] * LEAVES).take(of), node, out=self.slots[1])
        self.gate = code.gates.take(self.at)
        if exact is None:
            x = (far[coded].take(of) ^ ((node.astype(np.uint64) + np.uint64(1)) * _TURN)) * _MIX
            self.slots[2] = STARTS[2] + (x >> np.uint64(64 - BITS)).astype(np.int64)
            self.stretched = None
        else:
            own = np.concatenate([exact.own[w] for w in where])[coded]
            some = np.flatnonzero(own & exact.STEPS)
            seen = own.take(of)
            seen[runs(begin[some], n[some])] = exact.seen.take(runs((own[some] >> np.uint64(32)).astype(np.int64), n[some]))
            self.stretched = seen.view(np.float32)[1::2] * code.signs.take(self.at)
            seen &= np.uint64(0xFFFFFFFF)
            self.gate += seen.view(np.int64)
        again, before, fits = self._match(flat, far, place)
        own = coded[again]
        own, other, fits = (np.cumsum(coded) - 1)[again[own]], leaves[before[own]], fits[own]
        both = np.minimum(n[own], code.sizes[other])
        to, there = runs(begin[own], both), runs(code.starts[other], both)
        way = code.nodes.take(there) == node.take(to)  # both paths are one so far
        self.again, self.expects = to[way], code.expects.take(there[way])
        self.gate[self.again] += np.repeat(8 * fits, both)[way]

    @property
    def seen(self) -> tuple[np.ndarray, np.ndarray]:
        """Stretched predictions and levels of exact counts."""
        return self.stretched, self.gate % 384 // 24

    @staticmethod
    def _frequent(leaves: np.ndarray, others: int, place: np.ndarray) -> np.ndarray:
        """The nearest of the last LEAD units that is in the code, and how far before it is, as one number; 0: there is none."""
        at = np.arange(len(leaves))
        last = np.maximum.accumulate(np.where(leaves != others, at, -LEAD - 1))
        last = np.append(-LEAD - 1, last[:-1])
        back = at - last
        return np.where(back <= np.minimum(place, LEAD), leaves.take(last, mode="clip") * LEAD + back, 0)

    @staticmethod
    def _match(flat: np.ndarray, far: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places after a unit that the text had before, the last place after that, and how well it fits: 2 after the same LEAD units, or 1."""
        if flat.dtype == np.uint64:  # hashes
            flat = np.unique(flat, return_inverse=True)[1]
        bits = np.uint64(max(1, len(flat).bit_length()))
        key = np.arange(len(flat), dtype=np.uint64)
        key[1:] |= flat[:-1].astype(np.uint64) << bits
        key.sort()
        by, unit = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), key >> bits
        same = np.flatnonzero(unit[1:] == unit[:-1])
        now, then = by[same + 1], by[same]
        there = place[then]
        same = (there >= ORDERS[-2]) & (place[now] - there == now - then)  # of one text
        last = np.full(len(flat), -1)
        last[now[same]] = then[same]
        now = np.flatnonzero(last >= 0)
        then = last[now]
        return now, then, 1 + ((far[then] == far[now]) & (place[then] >= LEAD))


class Stretched:
    """What a mixer makes of the zeros and ones counted in slots: the stretched prediction, its lowest bit set where there is more than one."""

    def __init__(self, table: np.ndarray):
        n = table.reshape(-1, 2)
        self.stretched = np.empty(len(n), np.float32)
        for i in range(0, len(n), 1 << 16):
            part = n[i : i + (1 << 16)].astype(np.float32)
            known = part[:, 0] + part[:, 1] > 1
            part += np.float32(0.02)
            self.stretched.view(np.uint32)[i : i + (1 << 16)] = odds(part[:, 1], part[:, 0]).view(np.uint32) & np.uint32(0xFFFFFFFE) | known

    @classmethod
    def joined(cls, parts: Iterator[np.ndarray], size: int) -> Stretched:
        """Of a table of that size, a part of which is there at once."""
        out, at = cls(np.zeros(0, np.float32)), 0
        out.stretched = np.empty(size // 2, np.float32)
        for part in parts:
            out.stretched[at : at + len(part) // 2] = cls(part).stretched
            at += len(part) // 2
        return out

    def look(self, slots: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Writes the predictions of slots; returns 1 where there is more than one."""
        self.stretched.take(slots, out=out, mode="clip")
        return out.view(np.uint32) & np.uint32(1)


class Mixer:
    """Gated weights and adaptive probability maps over the predictions of a chunk's decisions."""

    STEP, RATE, MAP_RATE, ROWS = 8192, 0.01, 0.01, 32
    SHAPE = (INPUTS, 16, 3, 8)  # orders that know the context, level of the last one, fit of the match, depth
    CELLS = int(np.prod(SHAPE))
    SETS = np.cumsum([0, *(8 * n for n in SHAPE[:-1])])
    SET_ROWS = SETS[:-1, None] + 8 * np.indices(SHAPE).reshape(4, -1)[:-1] + np.indices(SHAPE)[-1].ravel()

    def __init__(self):
        self.sets, self.behind = np.full((self.SETS[-1], INPUTS), 1.0 / INPUTS, np.float32), np.zeros(self.SETS[-1])
        self.gates, self.used = np.split(self.sets, self.SETS[1:-1]), np.split(self.behind, self.SETS[1:-1])  # views
        grid = np.linspace(-12, 12, MAPS)
        self.maps = np.tile((1 / (1 + np.exp(-grid))).astype(np.float32), (self.ROWS, 1))
        self.mapped = np.zeros(self.maps.shape)

    def inputs(self, d: Decisions, table: np.ndarray | Stretched) -> tuple[np.ndarray, np.ndarray]:
        """Stretched predictions by order and decision, and the three gates as one number."""
        st = np.empty((len(ORDERS), len(d.at)), np.float32)
        if isinstance(table, Stretched):
            known = table.look(d.slots[0], st[0])
            for o in range(1, len(d.slots)):
                known += table.look(d.slots[o], st[o])
        else:
            known = Stretched(table[: 2 * LEAVES]).look(d.slots[0], st[0])
            pairs = table.view(np.uint64)
            for o in range(1, len(d.slots)):
                n = pairs.take(d.slots[o]).view(table.dtype).reshape(-1, 2).astype(np.float32)
                seen = n[:, 0] + n[:, 1]
                n += np.float32(0.02)
                st[o] = odds(n[:, 1], n[:, 0])
                if o < len(ORDERS) - 1:
                    known += seen > 1
        if d.stretched is None:
            return st, d.gate + 384 * known.astype(np.int64) + _GATES.take(level(seen)).astype(np.int64)
        st[-1] = d.stretched
        return st, d.gate + 384 * known.astype(np.int64)

    def weights(self) -> np.ndarray:
        """The mean of the three sets' weights for each combination of gates, by input."""
        a, b, c = (self.sets.take(rows, axis=0) for rows in self.SET_ROWS)
        a += b
        a += c
        return np.ascontiguousarray(a.T) / np.float32(3)

    @staticmethod
    def mix(st: np.ndarray, gate: np.ndarray, again: np.ndarray, expects: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The mixed probabilities, the knot of the maps below each, and how far above it is."""
        z = weights[0].take(gate)
        z *= st[0]
        for w, x in zip(weights[1:], st[1:], strict=False):
            w = w.take(gate)
            w *= x
            z += w
        z[again] += weights[-1].take(gate.take(again)) * expects
        np.clip(z, -11.99, 11.99, out=z)
        part = z + np.float32(12)
        part *= np.float32((MAPS - 1) / 24)
        low = part.astype(np.int64)
        part -= np.floor(part)
        np.negative(z, out=z)
        np.exp(z, out=z)
        z += np.float32(1)
        return np.reciprocal(z, out=z), low, part

    def learn(self, d: Decisions, table: np.ndarray) -> None:
        """Codes the decisions by what was counted before them, moves weights and maps, and counts them."""
        all_st, all_gates = self.inputs(d, table)
        y, ones, flat, mapped = d.code.bits.take(d.at), d.code.ones.take(d.at), self.maps.ravel(), self.mapped.ravel()
        cells = d.code.cells.take(d.at)
        cuts = np.searchsorted(d.again, np.arange(0, len(y) + self.STEP, self.STEP))
        for i in range(0, len(y), self.STEP):
            s, a = slice(i, i + self.STEP), slice(cuts[i // self.STEP], cuts[i // self.STEP + 1])
            st, gate, again, expects = all_st[:, s], all_gates[s], d.again[a] - i, d.expects[a]
            plain, low, part = self.mix(st, gate, again, expects, self.weights())
            e = np.subtract(ones[s], plain, out=plain)
            moves = np.empty((1 + INPUTS, self.CELLS))
            moves[0] = np.bincount(gate, minlength=self.CELLS)
            for o, x in enumerate(st, 1):
                moves[o] = np.bincount(gate, e * x, self.CELLS)
            moves[-1] = np.bincount(gate.take(again), e.take(again) * expects, self.CELLS)
            moves = moves.reshape(1 + INPUTS, *self.SHAPE)
            first = moves[:, :, :, 0] + moves[:, :, :, 1] + moves[:, :, :, 2]
            own = np.concatenate([x.reshape(1 + INPUTS, -1) for x in (first.sum(2), first.sum(1), moves.reshape(1 + INPUTS, -1, 24).sum(1))], axis=1)
            self.behind += own[0]
            self.sets += (self.RATE * own[1:] / np.sqrt(np.maximum(own[0], 1))).T.astype(np.float32)
            low *= 2
            low += cells[s]
            n, share = np.bincount(low, minlength=2 * flat.size), np.bincount(low, part, 2 * flat.size)
            for x, ahead in ((n - share, 0), (share, 1)):
                zero, one = x[: x.size - 2 * ahead].reshape(-1, 2).T
                both = zero + one
                mapped[ahead:] += both
                flat[ahead:] += self.MAP_RATE * (one - flat[ahead:] * both)
            np.clip(flat, 1e-6, 1 - 1e-6, out=flat)
        table[: 2 * LEAVES] += np.bincount(d.code.ways.take(d.at), minlength=2 * LEAVES).astype(np.uint32)
        for o in range(1, len(d.slots)):
            np.add.at(table, 2 * d.slots[o] + y, np.uint32(1))  # of the table's type: else some twenty times slower

    def cost(self, d: Decisions, table: np.ndarray | Stretched, texts: int, weights: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of the decisions of each text."""
        plain, low, part = self.mix(*self.inputs(d, table), d.again, d.expects, self.weights() if weights is None else weights)
        low += d.code.rows.take(d.at)
        flat = self.maps.ravel()
        p = flat.take(low)
        part *= flat[1:].take(low) - p
        p += part
        p *= np.float32(3)
        p += plain
        p /= np.float32(4)
        np.clip(p, 1e-7, 1 - 1e-7, out=p)
        np.subtract(p, d.code.zeros.take(d.at), out=p)  # a zero's probability is one less p
        np.abs(p, out=p)
        return np.bincount(d.texts, np.add.reduceat(np.log(p, out=p), d.begin, dtype=np.float64), texts) / math.log(10)

    def sums(self) -> np.ndarray:
        """The state times what is behind each of its numbers, and what is behind: sums of these are averaged states."""
        used = [np.repeat(u, INPUTS) for u in self.used] + [self.mapped.ravel()]
        state = [w.ravel() for w in self.gates] + [self.maps.ravel()]
        return np.stack([np.concatenate([s * u for s, u in zip(state, used, strict=True)]), np.concatenate(used)])

    @classmethod
    def averaged(cls, sums: np.ndarray) -> Mixer:
        out = cls()
        state = np.concatenate([w.ravel() for w in out.gates] + [out.maps.ravel()])
        state = np.where(sums[1] > 0, sums[0] / np.maximum(sums[1], 1e-9), state).astype(np.float32)
        at = 0
        for w in [*out.gates, out.maps]:
            w[:] = state[at : at + w.size].reshape(w.shape)
            at += w.size
        return out


def _sparse(i: int, x: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(x)
    return pa.record_batch([pa.array([i], pa.int32()), pa.array([pack(planes(np.diff(at, prepend=0)), planes(x[at].astype(np.float32).view(np.uint32)), np.array([len(x)], np.int64))], pa.binary())], names=["slice", "payload"])


def _cells(payload: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    steps, values, size = unpack(payload)
    return np.cumsum(unplanes(steps), dtype=np.int64), unplanes(values).view(np.float32), int(np.frombuffer(size, np.int64)[0])


def _dense(payload: bytes) -> np.ndarray:
    at, values, size = _cells(payload)
    out = np.zeros(size, np.float32)
    out[at] = values
    return out


def _sliced(x: np.ndarray, first: int = 0) -> Iterator[pa.RecordBatch]:
    """x[..., n] in SLICES parts along its last axis, all-zero ones left out."""
    for i, part in enumerate(np.array_split(x, SLICES, axis=-1)):
        if part.any():
            yield _sparse(first + i, part.ravel())


def letters(words: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The bytes of all units, each with an end (256); the row of each one's context of 1, 2 and 3 bytes; the units' starts."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.append(0, ends[:-1])
    flat = np.frombuffer(b" ".join([*words, b""]), np.uint8).astype(np.int64)
    flat[ends - 1] = 256
    rows, key = [], np.zeros(len(flat), np.uint64)
    for back in (1, 2, 3):
        before = np.full(len(flat), 256, np.int64)
        before[back:] = flat[:-back]
        for place in range(back - 1):  # the place after these follows the end of the unit before
            before[np.minimum(starts + place, len(flat) - 1)] = 256
        key *= np.uint64(257)
        key += before.view(np.uint64)
        rows.append(before if back == 1 else 257 + (back - 2) * ROWS + ((key + np.uint64(1)) * _MIX >> np.uint64(64 - 14)).view(np.int64))
    return flat, rows, starts


def letter_counts(words: list[bytes]) -> np.ndarray:
    if not words:
        return np.zeros((257 + 2 * ROWS) * 257)
    flat, rows, _ = letters(words)
    return np.bincount(np.concatenate([row * 257 + flat for row in rows]), minlength=(257 + 2 * ROWS) * 257)


class Speller:
    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.shares = 1 / (counts.reshape(-1, 257).sum(1, dtype=np.float64) + PRIOR)

    def spelt(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of each unit; every context's part is weighed against the shorter one's."""
        if len(words) > 20_000:
            return np.concatenate([self.spelt(words[i : i + 20_000]) for i in range(0, len(words), 20_000)])
        if not words:
            return np.zeros(0)
        flat, rows, starts = letters(words)
        p = np.full(len(flat), 1 / 257)
        for row in rows:
            p *= PRIOR
            p += self.counts.take(row * 257 + flat)
            p *= self.shares.take(row)
        return np.add.reduceat(np.log10(p, out=p), starts)


class Counts:
    """A summed table; sent compressed by slices, and unpacked once in a process that reads the broadcast, to `made` of them."""

    def __init__(self, table: np.ndarray, made: Callable | None = None):
        self.table, self.made = table, made

    def __getstate__(self) -> tuple:
        rows = self.table.reshape(-1, 2 if self.made else 1)  # no pair of counts is cut
        return self.made, self.table.size, [_sparse(0, x.ravel()).column("payload")[0].as_py() for x in np.array_split(rows, SLICES)]

    def __setstate__(self, state: tuple) -> None:
        self.made, size, slices = state
        if self.made:
            self.table = self.made(map(_dense, slices), size)
        else:
            self.table = np.concatenate([_dense(x) for x in slices])


def _learnt(code: Code) -> Callable:
    """The counts of all decisions of this task's training texts in the first orders, and the state learnt on the way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = Mixer(), np.zeros(2 * STARTS[2], np.uint32)
        for block in _each(batches, Joined):
            exact = block.followers(code, 1)
            for chunk in chunks((i, block.numbers[exact.starts[i] : exact.starts[i] + block.sizes[i]]) for i in np.flatnonzero(block.flags == 0)):
                model.learn(Decisions(chunk, code, exact), table)
        yield from _sliced(table)
        yield from _sliced(model.sums(), SLICES)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for i, payload in zip(b.column("slice").to_pylist(), b.column("payload").to_pylist(), strict=True):
            at, values, size = _cells(payload)
            if i not in held:
                held[i] = np.zeros(size)
            held[i][at] += values  # a cell is there once
    for i, x in held.items():
        yield _sparse(i, x)


def _total(pieces: DataFrame, *like: np.ndarray) -> tuple[np.ndarray, ...]:
    """The sums of arrays of fixed sizes that _sliced() cut, by slices over the executors."""
    for r in pieces.repartition(SLICES, "slice").mapInArrow(trimmed(_summed), PIECE).collect():  # of a fixed size
        part = np.array_split(like[r["slice"] // SLICES], SLICES, axis=-1)[r["slice"] % SLICES]
        part[:] = _dense(r["payload"]).reshape(part.shape)
    return like


def numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """units() of all texts as numbers, one after the other, how many each text has, and the distinct units by number."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    for space in NO_WORDS[2:]:
        if pc.any(pc.match_substring(texts, space)).as_py():
            texts = pc.replace_substring(texts, space, b" " + space + b" ")
    of = pc.split_pattern(texts, b" ")
    found, sizes = of.flatten(), pc.list_value_length(of).to_numpy().astype(np.int64)
    empty = pc.binary_length(texts).to_numpy() == 0  # of one empty unit now, of none in units()
    if empty.any():
        found = found.filter(pa.array(~np.repeat(empty, sizes)))
        sizes[empty] = 0
    found = found.dictionary_encode()
    numbers = np.insert(found.indices.to_numpy(), np.cumsum(sizes), len(found.dictionary))
    return numbers, sizes + 1, pa.concat_arrays([found.dictionary, pa.array([END], pa.large_binary())])


def _block(block: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
    ids, flags, texts = (pa.concat_arrays([r.column(c) for r in rows]) for c in ("doc_id", "held_out", "text"))
    flat, sizes, words = numbered(texts)
    flags = flags.to_numpy(zero_copy_only=False).astype(np.uint8)
    order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
    rank = np.empty(len(words), np.uint32)
    rank[order] = np.arange(len(words), dtype=np.uint32)
    flat, words = rank[flat], words.take(pa.array(order))
    counts = np.bincount(flat[np.repeat(flags == 0, sizes)], minlength=len(words))
    _, ends, raw = words.buffers()
    ends = np.frombuffer(ends, np.int64, len(words) + 1, 8 * words.offset)
    raw = raw.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes()
    known, given = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8), ids.cast(pa.int64()).fill_null(0).to_numpy()
    payload = pack(given, known, flags, sizes, planes(flat), planes(counts), np.diff(ends).astype(np.uint32), raw)
    return pa.record_batch([pa.array([block], pa.int64()), pa.array([payload], pa.binary())], names=["block", "payload"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts by block as numbers of its distinct units, the most frequent first, and these with their training counts."""
    block, rows, held = TaskContext.get().partitionId() << 24, [], 0
    for b in batches:
        up_to = np.cumsum(pc.fill_null(pc.binary_length(b.column("text").cast(pa.large_binary())), 0).to_numpy() + 1)
        start = before = 0
        while start < b.num_rows:
            end = min(b.num_rows, int(np.searchsorted(up_to, before + BLOCK_BYTES - held)) + 1)
            rows.append(b.slice(start, end - start))
            held += int(up_to[end - 1]) - before
            start, before = end, int(up_to[end - 1])
            if held >= BLOCK_BYTES:
                yield _block(block, rows)
                block, rows, held = block + 1, [], 0
    if rows:
        yield _block(block, rows)


def _cut(sizes: np.ndarray, raw: bytes) -> list[bytes]:
    ends = np.cumsum(sizes).tolist()
    return [raw[a:e] for a, e in zip([0, *ends], ends, strict=False)]


class Block:
    def __init__(self, payload: bytes):
        ids, known, flags, sizes, numbers, counts, lengths, raw = unpack(payload)
        self.ids, self.known, self.flags = np.frombuffer(ids, np.int64), np.frombuffer(known, np.uint8), np.frombuffer(flags, np.uint8)
        self.sizes, self.numbers, self.counts = np.frombuffer(sizes, np.int64), unplanes(numbers), unplanes(counts)
        self.lengths = np.frombuffer(lengths, np.uint32)
        self.words = _cut(self.lengths, raw)

    def events(self, code: Code) -> Events:
        """The texts' events; keeps the leaf of each distinct unit."""
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))
        self.leaf = code.leaf(h)
        return Events(h[self.numbers], self.leaf[self.numbers], self.sizes, code)


class Joined(Block):
    """A block with what the other blocks know of its units and contexts."""

    def __init__(self, payload: bytes, words: bytes, contexts: bytes):
        super().__init__(payload)
        self.tokens, self.exact = np.empty(len(self.words), np.int64), np.empty(len(self.words), np.int64)
        for part in _parts(words):
            own, tokens, exact = unpack(part)
            own = np.cumsum(unplanes(own).astype(np.int64))
            self.tokens[own], self.exact[own] = unplanes(tokens).astype(np.int64) - 1, unplanes(exact)
        self.contexts = contexts

    def followers(self, code: Code, less: int = 0) -> Followers:
        found = self.events(code)
        parts = [unpack(x) for x in _parts(self.contexts)]
        stride, counts = np.concatenate([np.frombuffer(a, bool) for a, _ in parts]), np.concatenate([unplanes(b) for _, b in parts])
        return Followers(found, code, stride, counts, less)


def _each(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[Block]:
    names = [x.split()[0] for x in JOINED.split(", ")] if kind is Joined else ["payload"]
    for b in batches:
        for i in range(b.num_rows):
            yield kind(*(b.column(c)[i].as_py() for c in names))


def _parts(joined: bytes) -> list[bytes]:
    n = int(np.frombuffer(joined, np.int64, 1)[0])
    return _cut(np.frombuffer(joined, np.int64, n, 8), joined[8 * (n + 1) :])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block, of rows in the order of blocks, kinds and dests."""
    at, held = None, ([], [], [])

    def close() -> pa.RecordBatch:
        columns = [held[0][0], *(np.array([len(x), *map(len, x)], np.int64).tobytes() + b"".join(x) for x in held[1:])]
        return pa.record_batch([pa.array([c], pa.binary()) for c in columns], names=["payload", "words", "contexts"])

    for b in batches:
        for i, (block, kind) in enumerate(zip(b.column("block").to_pylist(), b.column("kind").to_pylist(), strict=True)):
            if block != at:
                if held[0]:
                    yield close()
                at, held = block, ([], [], [])
            held[kind].append(b.column("payload")[i].as_py())
    if held[0]:
        yield close()


def _unit_rows(buckets: int) -> Callable:
    """Distinct units of each block with their training counts, by the hash of their lower-cased form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, at in enumerate(b.column("block").to_pylist()):
                block = Block(b.column("payload")[i].as_py())
                bucket = (np.fromiter(map(xxhash.xxh3_64_intdigest, map(bytes.lower, block.words)), np.uint64, len(block.words)) % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                words, lengths, counts = [block.words[j] for j in by.tolist()], block.lengths[by], block.counts[by]
                ends = [*(np.flatnonzero(np.diff(bucket[by])) + 1).tolist(), len(by)]
                for a, e in zip([0, *ends], ends, strict=False):
                    yield _record([(int(bucket[by[a]]), 0, at, 0, pack(planes(np.diff(by[a:e], prepend=0)), planes(counts[a:e]), lengths[a:e], b"".join(words[a:e])))])

    return run


def _packed_top(words: list[bytes], counts: np.ndarray) -> bytes:
    """The LEAVES most frequent units of these, of ties the smaller ones."""
    least = np.partition(counts, -LEAVES)[-LEAVES] if len(counts) > LEAVES else 0
    best = sorted((-int(counts[i]), words[i]) for i in np.flatnonzero(counts >= least).tolist())[:LEAVES]
    return pack(np.array([-c for c, _ in best], np.int64), np.array([len(w) for _, w in best], np.uint32), b"".join(w for _, w in best))


def _top(payloads: list[bytes]) -> list[tuple[bytes, int]]:
    """The LEAVES most frequent units of all tasks: exact, as a unit is in one task, so that it is among that one's, too."""
    parts = [unpack(x) for x in payloads]
    counts = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(c, np.int64) for c, _, _ in parts)])
    words = [w for _, lengths, raw in parts for w in _cut(np.frombuffer(lengths, np.uint32), raw)]
    counts, lengths, raw = unpack(_packed_top(words, counts))
    return list(zip(_cut(np.frombuffer(lengths, np.uint32), raw), np.frombuffer(counts, np.int64).tolist(), strict=True))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    payloads = [x for b in batches for x in b.column("payload").to_pylist()]
    if payloads:
        best = _top(payloads)
        yield pa.record_batch([pa.array([_packed_top([w for w, _ in best], np.array([c for _, c in best], np.int64))], pa.binary())], names=["payload"])


def _known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 1: for each block's units its word's training count (-1: no word) and its own. Kind 2: sum and number of this task's words,
    of its units, of those that came once, and of texts' ends. Kind 3: its most frequent units, packed. Kind 4: which bytes follow which in its training units, by slice."""
    held, numbers, lows = [], _numbers(), _numbers()
    for b in batches:
        for block, payload in zip(b.column("block").to_pylist(), b.column("payload").to_pylist(), strict=True):
            own, counts, lengths, raw = unpack(payload)
            words = _cut(np.frombuffer(lengths, np.uint32), raw)
            held.append((block, own, np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)), unplanes(counts)))
    if not held:
        return
    words = list(numbers)
    exact = np.zeros(len(words), np.int64)
    for _, _, at, counts in held:
        exact[at] += counts  # a block has a unit once
    is_word = np.ones(len(words), bool)
    is_word[[numbers[w] for w in NO_WORDS if w in numbers]] = False
    low = np.fromiter((lows[w.lower()] for w in words), np.int64, len(words))
    total = np.bincount(low, exact * is_word, len(lows)).astype(np.int64)
    tokens = np.where(is_word, total[low], -1)
    ends = int(exact[numbers[END]]) if END in numbers else 0
    yield _record([(0, 2, -1, 0, pack(np.array([total.sum(), (total > 0).sum(), exact.sum(), (exact == 1).sum(), ends], np.int64)))])
    there = np.flatnonzero(exact)
    words = [words[i] for i in there.tolist()]
    yield _record([(0, 3, -1, 0, _packed_top(words, exact[there]))])
    for piece in _sliced(letter_counts(words)):
        yield _record([(piece.column("slice")[0].as_py(), 4, -1, 0, piece.column("payload")[0].as_py())])
    for block, own, at, _ in held:
        yield _record([(0, 1, block, 0, pack(own, planes(tokens[at] + 1), planes(exact[at])))])


def _event_rows(buckets: int, code: Code) -> Callable:
    """Distinct events of each block with their training counts, by ranges of the contexts' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, at in enumerate(b.column("block").to_pylist()):
                block = Block(b.column("payload")[i].as_py())
                found = block.events(code)
                keys, counts = found.keys, np.add.reduceat(np.repeat(block.flags == 0, block.sizes)[found.by], found.first, dtype=np.int64)
                del found
                bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # a context's events have one bucket
                ends = np.append(np.flatnonzero(np.diff(bucket)) + 1, len(keys)).tolist()
                for a, e in zip([0, *ends], ends, strict=False):
                    steps = np.diff(keys[a:e], prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
                    yield _record([(int(bucket[a]), 0, at, 0, pack(np.ascontiguousarray(steps.T), planes(counts[a:e])))])

    return run


def _follow(code: Code) -> Callable:
    """For each block's events strides and counts over all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, keys, counts = [], [], []
        for b in batches:
            for i, (dest, block) in enumerate(zip(b.column("dest").to_pylist(), b.column("block").to_pylist(), strict=True)):
                steps, c = unpack(b.column("payload")[i].as_py())
                heads.append((dest, block))
                keys.append(np.cumsum(np.ascontiguousarray(np.frombuffer(steps, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64))
                counts.append(unplanes(c))
            del b
        if not heads:
            return
        ranges = 1 + sum(map(len, keys)) // EVENTS
        longest = max(keys, key=len)
        edges = np.unique(longest[np.arange(1, ranges) * len(longest) // ranges] & ~PLACES)  # no context is cut
        at = [[0, *np.searchsorted(k, edges).tolist(), len(k)] for k in keys]
        done = [([], []) for _ in keys]
        for r in range(len(edges) + 1):
            own = [k[x[r] : x[r + 1]] for k, x in zip(keys, at, strict=True)]
            every, place = np.unique(np.concatenate(own), return_inverse=True)
            if not len(every):
                continue
            there = np.bincount(place, np.concatenate([c[x[r] : x[r + 1]] for c, x in zip(counts, at, strict=True)]), len(every)).astype(np.int64)
            stride, out = followed(every, there, code)
            kept = np.ones(len(every), np.int64)
            kept[stride] += code.sizes[code.at_place[(every[stride] & PLACES).astype(np.int64)]]
            first, n = (np.cumsum(kept) - kept)[place], kept[place]
            out, stride = out.astype(np.uint32)[runs(first, n)], stride[place]
            ends, to = np.cumsum([0, *map(len, own)]), np.append(0, np.cumsum(n))
            for (strides, values), a, e, i, j in zip(done, ends.tolist(), ends[1:].tolist(), to[ends].tolist(), to[ends[1:]].tolist(), strict=False):
                strides.append(stride[a:e])
                values.append(out[i:j])
        for (dest, block), (strides, values) in zip(heads, done, strict=True):
            yield _record([(dest, 2, block, 0, pack(np.concatenate(strides), planes(np.concatenate(values))))])

    return run


def within(c: np.ndarray, of: float, once: float, spelling: np.ndarray) -> np.ndarray:
    """log10 probability of units outside the code: c of the `of` training units outside it are this unit, and `once` more are spelt."""
    known = np.log(c, out=np.full(len(c), -np.inf), where=c > 0)
    return np.logaddexp(known, math.log(once) + spelling * math.log(10)) / math.log(10) - math.log10(of + once)


def _scored(code: Code, shared, model: Mixer, speller, n: int, v: int, ends: int, rest: int, once: int) -> Callable:
    def log(c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (n + 0.1 * (v + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, spell, weights = shared.value.table, Speller(speller.value.table), model.weights()
        for block in _each(batches, Joined):
            exact, m = block.followers(code), len(block.sizes)
            scores = np.zeros(m)
            for c in chunks(((i, block.numbers[a : a + k]) for i, (a, k) in enumerate(zip(exact.starts.tolist(), block.sizes.tolist(), strict=True))), SCORED_UNITS):
                scores += model.cost(Decisions(c, code, exact), table, m, weights)
            del exact
            apart, outside = np.flatnonzero(block.leaf == len(code.words)), np.zeros(len(block.words))
            outside[apart] = within(block.exact[apart].astype(np.float64), rest, once + 1, spell.spelt([block.words[i] for i in apart.tolist()]))
            owner, word = np.repeat(np.arange(m), block.sizes), block.tokens >= 0
            sums = [np.bincount(owner, row[block.numbers], m) for row in (word, block.tokens > 0, np.where(word, log(np.maximum(block.tokens, 0)), 0), outside)]
            yield pa.record_batch(
                [
                    pa.array(block.ids, mask=block.known == 0),
                    pa.array(block.flags.astype(bool)),
                    pa.array(sums[0].astype(np.int64) + 1),
                    pa.array(sums[1].astype(np.int64) + int(ends > 0)),
                    pa.array(np.full(m, n)),
                    pa.array(sums[2] + log(np.array(float(ends)))),
                    pa.array(scores + sums[3]),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


@contextlib.contextmanager
def _freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the action that made them ends: everything that is read again is written. Batches hold few payloads at once."""
    conf = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {key: spark.conf.get(key) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def score_texts(docs: DataFrame) -> DataFrame:
    """Learns from the rows outside the held-out fold and scores all rows; see SCHEMA for the columns."""
    spark = docs.sparkSession
    small_batches(spark)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    blocks = written(rows.mapInArrow(trimmed(_blocks), BLOCK), "lm-blocks")
    with _freed(spark):
        known = written(blocks.mapInArrow(trimmed(_unit_rows(width)), PACKED).repartitionById(width, F.col("dest")).mapInArrow(trimmed(_known), PACKED), "lm-words")
    sums = (np.frombuffer(unpack(r["payload"])[0], np.int64) for r in known.where("kind = 2").select("payload").collect())
    n, v, every, once, ends = (int(x) for x in sum(sums, np.zeros(5, np.int64)))
    top = _top([r["payload"] for r in known.where("kind = 3").select("payload").repartition(16).mapInArrow(trimmed(_merged), "payload binary").collect()])
    frequent = top or [(END, 1)]
    rest, once = every - sum(c for _, c in top), once - sum(c == 1 for _, c in top)
    code = Code([w for w, _ in frequent], [*(c for _, c in frequent), max(1, rest)])
    (spelling,) = _total(known.where("kind = 4").select(F.col("dest").alias("slice"), "payload"), np.zeros((257 + 2 * ROWS) * 257, np.float32))
    speller = spark.sparkContext.broadcast(Counts(spelling))
    with _freed(spark):
        after = written(blocks.mapInArrow(trimmed(_event_rows(width, code)), PACKED).repartitionById(width, F.col("dest")).mapInArrow(trimmed(_follow(code)), PACKED), "lm-contexts")
        parts = after.unionByName(known.where("kind = 1")).select("block", "kind", "dest", "payload").unionByName(blocks.selectExpr("block", "0 as kind", "0 as dest", "payload"))
        texts = written(parts.repartition(width, "block").sortWithinPartitions("block", "kind", "dest").mapInArrow(trimmed(_joined), JOINED), "lm-texts")
        for table in (blocks, known, after):
            drop(table)
        table, state = _total(texts.mapInArrow(trimmed(_learnt(code)), PIECE), np.zeros(2 * STARTS[2], np.float32), Mixer().sums().astype(np.float32))
    shared = spark.sparkContext.broadcast(Counts(table, Stretched.joined))
    return texts.mapInArrow(trimmed(_scored(code, shared, Mixer.averaged(state), speller, n + ends, v + int(ends > 0), ends, rest, once)), SCHEMA)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read(spark, sf_dir, "documents"))
