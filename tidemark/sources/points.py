"""Points: (series_id, series, tags, time, value, seq), and sources that push time bounds and series down to their own columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .series import series_id

POINTS = "series_id bigint, series string, tags map<string,string>, time bigint, value double, seq bigint"
COLUMNS = ["series_id", "series", "tags", "time", "value", "seq"]


@dataclass(frozen=True)
class Bounds:
    """Inclusive bounds of time in epoch seconds; None is open."""

    low: int | None = None
    high: int | None = None

    def empty(self) -> bool:
        return self.low is not None and self.high is not None and self.low > self.high


class PointSource:
    """Anything that yields points. `scan` may use bounds and series to read less; the caller still filters."""

    def scan(self, bounds: Bounds = Bounds(), series: str | None = None, series_number: int | None = None) -> DataFrame:
        raise NotImplementedError


@dataclass
class FrameSource(PointSource):
    """A DataFrame that already has the columns of points; time is a column of its own, so filters reach its files as they are."""

    frame: DataFrame

    def scan(self, bounds: Bounds = Bounds(), series: str | None = None, series_number: int | None = None) -> DataFrame:
        df = self.frame
        if "hour_bucket" in df.columns:  # prunes partitions of the stored layout
            if bounds.low is not None:
                df = df.where(F.col("hour_bucket") >= bounds.low // 3600 * 3600)
            if bounds.high is not None:
                df = df.where(F.col("hour_bucket") <= bounds.high // 3600 * 3600)
        if series is not None and "namespace" in df.columns:
            df = df.where(F.col("namespace") == series.partition(".")[0])
        return df.select(*COLUMNS)


@dataclass
class TableSource(PointSource):
    """Points made from another table's columns.

    `prefix` and `key` name the series (prefix.key); `clock` is the table's own timestamp column, on which bounds are also put, as a
    filter on a column computed from it would not reach the files.
    """

    frame: DataFrame
    prefix: str
    key: str
    clock: str
    value: Column
    seq: Column
    tags: Callable[[], Column]
    keys: tuple[str, ...] = ()

    def scan(self, bounds: Bounds = Bounds(), series: str | None = None, series_number: int | None = None) -> DataFrame:
        df = self.frame
        own = df.schema[self.clock].dataType
        for bound, later in ((bounds.low, True), (bounds.high, False)):
            if bound is not None:
                edge = F.timestamp_seconds(F.lit(bound if later else bound + 1)).cast(own)
                df = df.where(F.col(self.clock) >= edge if later else F.col(self.clock) < edge)
        names = {f"{self.prefix}.{k}": k for k in self.keys}
        if series is not None:
            head, _, tail = series.partition(".")
            df = df.where(F.col(self.key) == tail if head == self.prefix else F.lit(False))
        if series_number is not None:
            df = df.where(F.col(self.key).isin([k for n, k in names.items() if series_id(n) == series_number]))
        ids = F.create_map(*[F.lit(x) for n, k in names.items() for x in (k, series_id(n))])
        return df.select(
            F.try_element_at(ids, F.col(self.key)).alias("series_id"),
            F.concat(F.lit(f"{self.prefix}."), F.col(self.key)).alias("series"),
            self.tags().alias("tags"),
            F.unix_seconds(F.col(self.clock).cast("timestamp")).alias("time"),
            self.value.cast("double").alias("value"),
            self.seq.cast("bigint").alias("seq"),
        )


#: Columns of the tables that are read as points; given, they save a job that reads footers before each query.
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
LINEITEM = "l_orderkey bigint, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
ORDERS = "o_orderkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


def events(spark: SparkSession, sf_dir: str) -> TableSource:
    return TableSource(
        spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet"), "events", "event_type", "ts", F.col("value"), F.col("event_id"),
        lambda: F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("k"), F.get_json_object("props", "$.k")),
        ("click", "error", "purchase", "signup", "view"),
    )


def lineitem(spark: SparkSession, sf_dir: str) -> TableSource:
    """No column orders its points, so only aggregates that need no order are exact on it."""
    return TableSource(
        spark.read.schema(LINEITEM).parquet(f"{sf_dir}/lineitem.parquet"), "lineitem", "l_returnflag", "l_shipdate", F.col("l_extendedprice") * (1 - F.col("l_discount")), F.col("l_orderkey"),
        lambda: F.create_map(F.lit("status"), F.col("l_linestatus")), ("A", "N", "R"),
    )


def orders(spark: SparkSession, sf_dir: str) -> TableSource:
    return TableSource(
        spark.read.schema(ORDERS).parquet(f"{sf_dir}/orders.parquet"), "orders", "o_orderstatus", "o_orderdate", F.col("o_totalprice"), F.col("o_orderkey"),
        lambda: F.create_map(F.lit("priority"), F.col("o_orderpriority")), ("F", "O", "P"),
    )


@dataclass
class Tables(PointSource):
    """Several sources as one; a series' prefix names its source, and only that one is opened."""

    parts: dict[str, Callable[[], PointSource]]

    def scan(self, bounds: Bounds = Bounds(), series: str | None = None, series_number: int | None = None) -> DataFrame:
        chosen = list(self.parts.values())
        if series is not None:
            head = series.partition(".")[0]
            chosen = [self.parts[head]] if head in self.parts else chosen[:1]
        return reduce(DataFrame.unionByName, (make().scan(bounds, series, series_number) for make in chosen))


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables({f.__name__: partial(f, spark, sf_dir) for f in (events, lineitem, orders)})


def in_range(source: PointSource, low: int, high: int, series: str | None = None, series_number: int | None = None) -> DataFrame:
    """(time, value) of one series between two times, both inclusive."""
    df = source.scan(Bounds(low, high), series, series_number).where(F.col("time").between(low, high))
    df = df.where(F.col("series") == series) if series is not None else df.where(F.col("series_id") == series_number)
    return df.select("time", "value")


def tag_index(points: DataFrame) -> DataFrame:
    """(tag_key, tag_value, series_id), one row each."""
    return points.select("series_id", F.explode("tags").alias("tag_key", "tag_value")).where("tag_value is not null").distinct()


def find(index: DataFrame, tags: dict[str, str], op: str = "and") -> DataFrame:
    """series_id of the series with all (and) or any (or) of the tags; no tags, no series."""
    wanted = F.lit(False)
    for k, v in tags.items():
        wanted = wanted | ((F.col("tag_key") == k) & (F.col("tag_value") == v))
    hit = index.where(wanted)
    if op == "or":
        return hit.select("series_id").distinct()
    return hit.groupBy("series_id").agg(F.count_distinct("tag_key").alias("n")).where(F.col("n") == len(tags)).select("series_id")
