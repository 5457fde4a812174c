"""Series ids: XXH64 with seed 0 over `series|tags`, kept as signed 64-bit numbers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

try:
    import xxhash
except ImportError:  # the pure form below gives the same ids
    xxhash = None

_MASK = (1 << 64) - 1
#: Primes of XXH64; fixed values.
_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261


def _rotl(x: int, n: int) -> int:
    return (x << n | x >> 64 - n) & _MASK


def _round(acc: int, lane: int) -> int:
    return _rotl(acc + lane * _P2 & _MASK, 31) * _P1 & _MASK


def xxh64(data: bytes, seed: int = 0) -> int:
    """XXH64 after its public specification."""
    n, at = len(data), 0
    if n >= 32:
        acc = [(seed + _P1 + _P2) & _MASK, (seed + _P2) & _MASK, seed & _MASK, (seed - _P1) & _MASK]
        while at + 32 <= n:
            acc = [_round(a, int.from_bytes(data[at + 8 * i : at + 8 * i + 8], "little")) for i, a in enumerate(acc)]
            at += 32
        h = sum(_rotl(a, r) for a, r in zip(acc, (1, 7, 12, 18), strict=True)) & _MASK
        for a in acc:
            h = ((h ^ _round(0, a)) * _P1 + _P4) & _MASK
    else:
        h = (seed + _P5) & _MASK
    h = (h + n) & _MASK
    while at + 8 <= n:
        h = (_rotl(h ^ _round(0, int.from_bytes(data[at : at + 8], "little")), 27) * _P1 + _P4) & _MASK
        at += 8
    if at + 4 <= n:
        h = (_rotl(h ^ int.from_bytes(data[at : at + 4], "little") * _P1 & _MASK, 23) * _P2 + _P3) & _MASK
        at += 4
    for b in data[at:]:
        h = _rotl(h ^ b * _P5 & _MASK, 11) * _P1 & _MASK
    h = (h ^ h >> 33) * _P2 & _MASK
    h = (h ^ h >> 29) * _P3 & _MASK
    return h ^ h >> 32


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def series_id(series: str, tags: str = "{}") -> int:
    raw = f"{series}|{tags}".encode()
    return signed(xxhash.xxh64_intdigest(raw, 0) if xxhash else xxh64(raw))


@F.pandas_udf(LongType())
def series_ids(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ids of (series, tags text) in Arrow batches; each distinct pair of a batch is hashed once."""
    known: dict[tuple[str, str], int] = {}
    for names, tags in parts:
        if len(known) > 200_000:
            known.clear()
        out = []
        for pair in zip(names, tags, strict=True):
            if pair not in known:
                known[pair] = series_id(*pair)
            out.append(known[pair])
        yield pd.Series(out, dtype="int64")


def unsigned(c: Column) -> Column:
    """The id as the unsigned number it stands for."""
    return c.cast("decimal(20,0)") + F.when(c < 0, F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(20,0)"))
