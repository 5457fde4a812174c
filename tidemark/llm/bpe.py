"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Each task splits its texts into pre-tokens and numbers them: a text becomes the positions' word numbers, and each block of texts
(at most about `BLOCK_CHARS` characters) sends each of its distinct words once, dealt by the word's hash, so that equal words of
all blocks meet and each is encoded once there. The ids go back to the blocks, which are put together again by position. Decoding
joins the ids to the table of token bytes, which has one row per rank of the vocabulary and is shared whole.

Rows that travel are packed: many words, or the numbers of many texts, in one compressed value. A word that half of the corpus
holds is still sent once per block only, and no group is larger than a block.

Defined results: a null or empty text has no ids and decodes to nothing. Rows that repeat are all kept, also with one doc_id; a
null doc_id stays null. Extra columns are dropped. An empty table gives an empty result. Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches, trimmed

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
BLOCK_CHARS = 24_000_000
ROW_CHARS = 1_000_000
PACKED = "dest int, kind int, block bigint, part int, payload binary"
DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
IDS = "doc_id bigint, ids array<int>"


@cache
def splitter() -> regex.Pattern:
    return regex.compile(public_tokenizers.PATTERN)


@cache
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each rank; gaps in the ranks are empty."""
    ranks = encoding(path)._mergeable_ranks
    out = [b""] * (max(ranks.values()) + 1)
    for raw, i in ranks.items():
        out[i] = raw
    return out


def pack(*parts: np.ndarray | bytes) -> bytes:
    raw = [p if isinstance(p, bytes) else p.tobytes() for p in parts]
    return zstandard.compress(np.array([len(raw), *map(len, raw)], np.int64).tobytes() + b"".join(raw), 6)


def unpack(payload: bytes) -> list[bytes]:
    raw = zstandard.decompress(payload)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ends = np.cumsum(np.frombuffer(raw, np.int64, n, 8)) + 8 * (n + 1)
    return [raw[a:b] for a, b in zip([8 * (n + 1), *ends[:-1]], ends, strict=True)]


def planes(x: np.ndarray) -> np.ndarray:
    """The bytes of 32-bit numbers, lowest bytes first: like bytes together compress better."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)


def unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    dest, kind, block, part, payload = zip(*rows, strict=True)
    return pa.record_batch([pa.array(dest, pa.int32()), pa.array(kind, pa.int32()), pa.array(block, pa.int64()), pa.array(part, pa.int32()), pa.array(payload, pa.binary())], names=["dest", "kind", "block", "part", "payload"])


def _block_rows(block: int, numbers: dict[str, int], ids: list, nulls: list, found: list[np.ndarray], buckets: int) -> Iterator[tuple]:
    """Kind 0: words by bucket. Kind 1: the texts as word numbers; the most frequent words have the lowest."""
    words = list(numbers)
    flat = np.concatenate(found) if found else np.empty(0, np.uint32)
    order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
    rank = np.empty(len(words), np.uint32)
    rank[order] = np.arange(len(words), dtype=np.uint32)
    flat = rank[flat] if len(flat) else flat
    raw = [words[i].encode() for i in order]
    bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in raw), np.int64, len(raw))
    by = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[by])) + 1
    for own in np.split(by, cuts) if len(by) else []:
        mine = [raw[i] for i in own]
        yield int(bucket[own[0]]), 0, block, -1, pack(planes(np.diff(own, prepend=0)), np.array([len(w) for w in mine], np.uint32), b"".join(mine))
    sizes = np.array([len(x) for x in found], np.int64)
    ends = np.cumsum(sizes)
    start = part = 0
    for i in range(len(ids)):
        if i + 1 == len(ids) or ends[i] - (ends[start] - sizes[start]) > ROW_CHARS // 4:
            piece = flat[ends[start] - sizes[start] : ends[i]]
            yield (block + part) % buckets, 1, block, part, pack(np.array(ids[start : i + 1], np.int64), np.array(nulls[start : i + 1], np.uint8), sizes[start : i + 1], planes(piece))
            start, part = i + 1, part + 1


def _numbered(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter().findall
        block = TaskContext.get().partitionId() << 24
        numbers, ids, nulls, found, chars = _Numbers(), [], [], [], 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                text = text.as_py() or ""
                ids.append(doc_id or 0)
                nulls.append(doc_id is None)
                found.append(np.fromiter(map(numbers.__getitem__, split(text)), np.uint32))
                chars += len(text)
                if chars >= BLOCK_CHARS:
                    for row in _block_rows(block, numbers, ids, nulls, found, buckets):
                        yield _batch([row])
                    block, numbers, ids, nulls, found, chars = block + 1, _Numbers(), [], [], [], 0
        if ids:
            for row in _block_rows(block, numbers, ids, nulls, found, buckets):
                yield _batch([row])

    return run


def _encoded(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the distinct words dealt to this task: its share of the vocabulary, which more shuffle partitions make smaller
        piece, known = encoding(SparkFiles.get(path))._core_bpe.encode_single_piece, {}
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("dest", "kind", "block", "part", "payload")), strict=True):
                if row[1] == 0:
                    own, sizes, raw = unpack(row[4])
                    ends = np.cumsum(np.frombuffer(sizes, np.uint32)).tolist()
                    out = []
                    for a, e in zip([0, *ends], ends, strict=False):
                        w = raw[a:e]
                        x = known.get(w)
                        if x is None:
                            x = known[w] = np.array(piece(w), np.uint32).tobytes()
                        out.append(x)
                    ids = np.frombuffer(b"".join(out), np.uint32)
                    row = (*row[:4], pack(own, np.array([len(x) // 4 for x in out], np.uint32), planes(ids)))
                yield _batch([row])

    return run


def _digests(path: str) -> Callable:
    def make(doc_ids: list, ids: list[np.ndarray]) -> pa.RecordBatch:
        table = token_bytes(SparkFiles.get(path))
        shown = [str(i).encode() for i in range(len(table))]
        sizes, a, d = [], [], []
        for x in ids:
            x = x.tolist()
            sizes.append(len(x))
            a.append(hashlib.sha256(b" ".join([shown[i] for i in x])).hexdigest())
            d.append(hashlib.sha256(b"".join([table[i] for i in x])).hexdigest())
        return pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(a), pa.array(d)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return make


def _id_lists(doc_ids: list, ids: list[np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])


def _together(make: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, gathered, table = None, [], None
        for b in batches:
            for block, kind, payload in zip(*(b.column(c).to_pylist() for c in ("block", "kind", "payload")), strict=True):
                if block != at:
                    at, gathered, table = block, [], None
                if kind == 0:
                    own, sizes, ids = unpack(payload)
                    gathered.append((np.cumsum(unplanes(own).astype(np.int32)), np.frombuffer(sizes, np.uint32).astype(np.int64), unplanes(ids)))
                    continue
                if table is None:
                    own = np.concatenate([g[0] for g in gathered]) if gathered else np.empty(0, np.int64)
                    sizes, flat = (np.concatenate([g[i] for g in gathered]) if gathered else np.empty(0, np.int64) for i in (1, 2))
                    size, start = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
                    size[own], start[own] = sizes, np.cumsum(sizes) - sizes
                    table, gathered = (size, start, flat), []
                doc_ids, nulls, counts, numbers = unpack(payload)
                size, start, flat = table
                numbers = unplanes(numbers)
                ends = np.cumsum(np.frombuffer(counts, np.int64))
                out = []
                for a, e in zip([0, *ends[:-1]], ends, strict=True):
                    own = numbers[a:e]
                    n = size[own]
                    out.append(flat[np.repeat(start[own] - np.cumsum(n) + n, n) + np.arange(n.sum())])
                yield make([None if z else i for i, z in zip(np.frombuffer(doc_ids, np.int64).tolist(), nulls, strict=True)], out)

    return run


def shipped(spark: SparkSession, path: str) -> str:
    """Sends the driver's vocabulary file with the job; returns its name for SparkFiles.get in the tasks."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def _run(docs: DataFrame, make: Callable, schema: str, path: str) -> DataFrame:
    """path: the vocabulary's name among the shipped files."""
    small_batches(docs.sparkSession)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = rows.mapInArrow(trimmed(_numbered(n)), PACKED).repartition(n, "dest")
    encoded = packed.mapInArrow(trimmed(_encoded(path)), PACKED).repartition(n, "block").sortWithinPartitions("block", "kind", "part")
    return encoded.mapInArrow(trimmed(_together(make)), schema)


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and ids of every text."""
    return _run(docs, _id_lists, IDS, shipped(docs.sparkSession, path))


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and bytes of every list of ids; an id that the vocabulary lacks raises."""
    name = shipped(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(SparkFiles.get(name))
        for b in batches:
            out = [b"".join([table[i] for i in x or ()]) for x in b.column("ids").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "raw"])

    return encoded.select("doc_id", "ids").mapInArrow(trimmed(run), "doc_id bigint, raw binary")


def digests(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded bytes of every text."""
    name = shipped(docs.sparkSession, path)
    return _run(docs, _digests(name), DIGESTS, name)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
