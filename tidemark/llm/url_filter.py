"""URL filters over a sorted digest array.

The rules' keys (host then path) are hashed with 64-bit xxhash and kept as one sorted array of digests, with the strings behind it, in a
file that every executor memory-maps; nothing of the rules travels with a task. A URL is probed under every host suffix at a label boundary, joined with every prefix of its path that has
the length of some rule's path; all probes of a batch go through one vectorised binary search, and each hit is confirmed
against the stored string, so that two keys with one digest are told apart.

Defined results: a null URL, or one without "://", has an empty host and path and meets no rule. Repeated rows are judged
alike and all kept. Extra columns are dropped. An empty table gives an empty result. A URL of any length is read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from .common import UPPER, read, shared_dir, write_bytes

#: (verdict, host, path); fixed values of the query's contract.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
SCHEMA = "page_id bigint, host string, path string, rule string, verdict string"
_LOWER = str.maketrans(UPPER, UPPER.lower())


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path, without query or fragment."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def digest(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key)


def rules_file(rules: list[tuple[str, str, str]]) -> bytes:
    """The rules as one file: digests in order, then where each rule's strings begin, the lengths of its host and path, its verdict, the
    path lengths that occur, and all strings, host then path. Of equal keys the last rule holds."""
    by = {}
    for verdict, host, path in rules:
        host = host.translate(_LOWER)
        by[host + path] = (verdict, host.encode("utf-8", "surrogatepass"), path.encode("utf-8", "surrogatepass"))
    kept = sorted(((digest(h + p), h, p, v) for v, h, p in by.values()), key=lambda r: r[:3])
    verdicts = sorted({r[3] for r in kept})
    sizes = np.array([(len(r[1]), len(r[2])) for r in kept], np.int64).reshape(-1, 2)
    starts = np.cumsum(sizes.sum(1)) - sizes.sum(1)
    lengths = np.array(sorted({len(p.decode("utf-8", "surrogatepass")) for _, _, p, _ in kept}), np.int64)
    names = "\n".join(verdicts).encode()
    columns = [np.array([r[0] for r in kept], np.uint64), starts, sizes[:, 0].copy(), sizes[:, 1].copy(), np.array([verdicts.index(r[3]) for r in kept], np.int64), lengths]
    head = np.array([len(kept), len(lengths), len(names)], np.int64)
    return b"".join([head.tobytes(), *[c.tobytes() for c in columns], names, *[r[1] + r[2] for r in kept]])


class DigestRules:
    """A rules file, mapped into memory: workers share its pages, and only what a probe touches is read."""

    def __init__(self, raw: np.ndarray):
        n, m, named = (int(x) for x in raw[:24].view(np.int64))
        body = raw[24 : 24 + 8 * (5 * n + m)]
        self.digests = body[: 8 * n].view(np.uint64)
        self.starts, self.hosts, self.paths, self.verdict = (body[8 * n * k : 8 * n * (k + 1)].view(np.int64) for k in range(1, 5))
        self.path_lengths = body[40 * n :].view(np.int64).tolist()
        at = 24 + len(body)
        self.verdicts = raw[at : at + named].tobytes().decode().split("\n")
        self.strings = raw[at + named :]

    @classmethod
    def mapped(cls, name: str) -> DigestRules:
        return cls(np.memmap(name, np.uint8, "r"))

    def key(self, k: int) -> bytes:
        start = int(self.starts[k])
        return self.strings[start : start + int(self.hosts[k] + self.paths[k])].tobytes()


def share(spark: SparkSession, rules: list[tuple[str, str, str]]) -> str:
    """Hands the rules file to every executor, also to those that start later; returns its name there."""
    raw = rules_file(rules)
    name = f"rules-{hashlib.sha256(raw).hexdigest()[:24]}.bin"
    path = f"{shared_dir(spark)}/{name}"
    write_bytes(spark, path, raw)
    spark.sparkContext.addFile(path)
    return name


def probe(rules: DigestRules, urls: list[str | None]) -> list[tuple]:
    """(host, path, rule, verdict) of each URL; rule and verdict are None where no rule fits."""
    parts = [split_url(u) for u in urls]
    keys: list[bytes] = []
    owner: list[int] = []
    for i, (host, path) in enumerate(parts):
        at = 0
        prefixes = [path[:n].encode("utf-8", "surrogatepass") for n in rules.path_lengths if n <= len(path)]
        while prefixes and host:
            own = host[at:].encode("utf-8", "surrogatepass")
            for p in prefixes:
                keys.append(own + p)
                owner.append(i)
            at = host.find(".", at) + 1
            if not at:
                break
    best: dict[int, tuple[int, int, int]] = {}
    if keys and len(rules.digests):
        wanted = np.fromiter(map(digest, keys), np.uint64, len(keys))
        lo, hi = np.searchsorted(rules.digests, wanted, "left"), np.searchsorted(rules.digests, wanted, "right")
        for j in np.flatnonzero(hi > lo):
            for k in range(lo[j], hi[j]):
                if rules.key(k) == keys[j]:
                    mark = len(keys[j].decode("utf-8", "surrogatepass")), int(rules.hosts[k]), k
                    best[owner[j]] = max(best.get(owner[j], mark), mark)
    return [(h, p, rules.key(best[i][2]).decode("utf-8", "surrogatepass"), rules.verdicts[int(rules.verdict[best[i][2]])]) if i in best else (h, p, None, None) for i, (h, p) in enumerate(parts)]


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every row. Longest rule wins; where none fits, the verdict is `default`."""
    name = share(pages.sparkSession, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = DigestRules.mapped(SparkFiles.get(name))
        for b in batches:
            found = probe(made, b.column("url").to_pylist())
            host, path, rule, verdict = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.record_batch(
                [b.column("page_id"), pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(rule, pa.string()), pa.array([v or default for v in verdict], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    return pages.select(pages["page_id"].cast("bigint").alias("page_id"), pages["url"].cast("string").alias("url")).mapInArrow(run, SCHEMA)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"))


ORACLE = """
WITH r(verdict, host, path) AS (VALUES ('block','com','/en/'), ('allow','example.com','/en/7'), ('allow','net','/de/'),
  ('block','example.net','/de/8'), ('block','org','/es/')),
a AS (SELECT page_id, row_number() OVER () AS n, CASE WHEN url IS NOT NULL AND strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, n, regexp_extract(rest, '^[^?#]*') AS rest FROM a),
c AS (SELECT page_id, n, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM b),
d AS (SELECT c.n, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY c.n ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
  FROM c JOIN r ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path))
SELECT c.page_id, c.host, c.path, d.rule, coalesce(d.verdict, 'allow') AS verdict FROM c LEFT JOIN d ON c.n = d.n AND d.k = 1
"""
