"""Stored points: Parquet by namespace and hour, with insert, delete, compaction, retention, rollups and snapshot.

Layout: <root>/points/namespace=.../hour_bucket=.../*.parquet and <root>/rollups/step=.../namespace=.../*.parquet. A rewrite (delete,
compaction) writes whole new partitions beside the old ones and then lists them; what is listed replaces the old ones, one
partition after the other, and recover() ends a replacement that a crash cut off. One writer at a time. Rollups are dropped by
any change of the points and made again by roll_up(), so that a stale one is never read.
"""

from __future__ import annotations

import json
import time as clock
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.language import Delete, Insert
from .points import COLUMNS, POINTS, Bounds, FrameSource, PointSource
from .series import series_id

HOUR = 3600
LISTED, COMPACTED = "_listed", "_compacted"


def placed(points: DataFrame) -> DataFrame:
    """With the partition columns: the text before the first dot, and the hour, floored."""
    return points.withColumn("namespace", F.substring_index("series", ".", 1)).withColumn("hour_bucket", F.col("time") - F.pmod(F.col("time"), F.lit(HOUR)))


def last_wins(points: DataFrame) -> DataFrame:
    """One point for each series and time: that of the largest seq. Aggregated map-side before it moves."""
    return points.groupBy("series_id", "time").agg(F.max_by(F.struct("series", "tags", "value", "seq"), "seq").alias("_p")).select("series_id", "_p.series", "_p.tags", "time", "_p.value", "_p.seq")


@dataclass
class Store(PointSource):
    spark: SparkSession
    root: str

    @property
    def path(self) -> str:
        return f"{self.root}/points"

    # -- files
    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self) -> bool:
        fs, p = self._fs(self.path)
        return fs.exists(p)

    def frame(self) -> DataFrame:
        schema = f"{POINTS}, namespace string, hour_bucket bigint"
        return self.spark.read.schema(schema).parquet(self.path) if self.exists() else self.spark.createDataFrame([], schema)

    def scan(self, bounds: Bounds = Bounds(), series: str | None = None, series_number: int | None = None) -> DataFrame:
        return FrameSource(self.frame()).scan(bounds, series, series_number)

    # -- rollups
    def roll_up(self, steps: tuple[int, ...] = (60, 3600)) -> None:
        """Stores a rollup for each step, each from the finest one before it whose step divides its own."""
        from ..plans import rollup

        self._drop("rollups")
        made: dict[int, DataFrame] = {}
        for step in sorted(steps):
            finer = [s for s in made if step % s == 0]
            rows = rollup.coarser(made[max(finer)], step) if finer else rollup.build(self.scan(), step)
            path = f"{self.root}/rollups/step={step}"
            rows.withColumn("namespace", F.substring_index("series", ".", 1)).write.partitionBy("namespace").parquet(path)
            made[step] = self._rollup(path)

    def _rollup(self, path: str) -> DataFrame:
        return self.spark.read.schema("series_id bigint, series string, bucket bigint, points bigint, sum double, n bigint, min double, max double, namespace string").parquet(path).drop("namespace")

    def rollups(self):
        """The stored rollups, for the planner; empty after a change until roll_up() is called."""
        from ..plans.rollup import Rollups

        fs, p = self._fs(f"{self.root}/rollups")
        steps = [x.getPath().getName().partition("=")[2] for x in fs.listStatus(p)] if fs.exists(p) else []
        return Rollups({int(s): self._rollup(f"{self.root}/rollups/step={s}") for s in steps if s})

    def _drop(self, folder: str) -> None:
        fs, p = self._fs(f"{self.root}/{folder}")
        fs.delete(p, True)

    # -- writes
    def append(self, points: DataFrame) -> None:
        """New files in the partitions of the points. Rows of one partition meet in a few tasks, hot partitions in more."""
        self.recover()
        self._drop("rollups")
        self._written(points, self.path, "append")

    def _written(self, points: DataFrame, path: str, mode: str) -> None:
        rows = placed(points.select(*COLUMNS))
        rows.hint("rebalance", "namespace", "hour_bucket").sortWithinPartitions("namespace", "hour_bucket", "series_id", "time").write.mode(mode).partitionBy("namespace", "hour_bucket").parquet(path)

    def append_once(self, points: DataFrame, source: str, number: int) -> bool:
        """Appends the batch `number` of a source unless that was done before; False if it was.

        The files are written aside, whole, and then moved one by one under names of their own. A repeat after a crash moves
        what is left; so every batch is in the store once, whenever the crash was.
        """
        done, aside = f"{self.root}/commits/{source}/{number}", f"{self.root}/staging/{source}/{number}"
        fs, mark = self._fs(done)
        if fs.exists(mark):
            return False
        self.recover()
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        if not fs.exists(path(f"{aside}/_SUCCESS")):
            self._written(points, aside, "overwrite")
        self._drop("rollups")
        files = fs.listFiles(path(aside), True)
        while files.hasNext():  # the files of one batch
            old = files.next().getPath()
            if old.getName().endswith(".parquet"):
                hour = old.getParent()
                folder = path(f"{self.path}/{hour.getParent().getName()}/{hour.getName()}")
                fs.mkdirs(folder)
                fs.rename(old, path(folder, f"{source}-{number}-{old.getName()}"))
        fs.create(mark, True).close()
        fs.delete(path(aside), True)
        return True

    def insert(self, statement: Insert) -> int:
        from ..plans.builder import PlanError, Scope

        names = statement.columns or ("time", "value")
        if len(statement.values) > len(names) or statement.columns and len(statement.values) != len(names):
            raise PlanError(f"{len(names)} values are needed, {len(statement.values)} given")
        given = {n.lower(): Scope().column(v) for n, v in zip(names, statement.values, strict=False)}
        row = self.spark.range(1).select(
            F.lit(series_id(statement.series)).alias("series_id"),
            F.lit(statement.series).alias("series"),
            F.create_map().cast("map<string,string>").alias("tags"),
            given.get("time", given.get("ts", F.unix_seconds(F.current_timestamp()))).cast("bigint").alias("time"),
            given.get("value", F.lit(0.0)).cast("double").alias("value"),
            F.lit(clock.time_ns()).alias("seq"),
        )
        self.append(row)
        return 1

    def delete(self, statement: Delete) -> int:
        from ..plans.builder import Scope, time_bounds

        scope = Scope(names={c: F.col(c) for c in ("series_id", "series", "tags", "time", "value")})
        return self.delete_where(F.col("series") == statement.series, scope.column(statement.where), time_bounds(statement.where), statement.series)

    def delete_where(self, series: Column, condition: Column, bounds: Bounds = Bounds(), name: str | None = None) -> int:
        """Drops the matching points; a condition that is null keeps its point. Only partitions within the bounds are read."""
        self.recover()
        df = self._within(bounds, name)
        hit = series & F.coalesce(condition, F.lit(False))
        n = df.where(hit).count()
        if n:
            touched = [(r["namespace"], r["hour_bucket"]) for r in df.where(hit).select("namespace", "hour_bucket").distinct().collect()]  # one pair for each partition, as a listing has
            self._rewrite(self._of(touched).where(~hit), touched)
        return n

    def _within(self, bounds: Bounds, name: str | None) -> DataFrame:
        df = self.frame()
        if bounds.low is not None:
            df = df.where(F.col("hour_bucket") >= bounds.low // HOUR * HOUR)
        if bounds.high is not None:
            df = df.where(F.col("hour_bucket") <= bounds.high // HOUR * HOUR)
        return df if name is None else df.where(F.col("namespace") == name.partition(".")[0])

    def _rewrite(self, rows: DataFrame, touched: list[tuple[str, int]], compact: bool = False) -> None:
        """Puts the rows in place of the touched partitions' files; a partition without rows goes."""
        fresh = f"{self.root}/rewrite-{clock.time_ns()}"
        rows.select(*COLUMNS, "namespace", "hour_bucket").hint("rebalance", "namespace", "hour_bucket").write.partitionBy("namespace", "hour_bucket").parquet(fresh)
        fs, _ = self._fs(fresh)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        listed = [[f"namespace={n}/hour_bucket={h}", fs.exists(path(f"{fresh}/namespace={n}/hour_bucket={h}"))] for n, h in touched]
        for at, held in listed:
            if held and compact:
                fs.create(path(f"{fresh}/{at}/{COMPACTED}"), True).close()
        part = path(f"{fresh}/{LISTED}.part")
        out = fs.create(part, True)
        out.write(json.dumps(listed).encode())
        out.close()
        fs.rename(part, path(f"{fresh}/{LISTED}"))
        self.recover()

    def recover(self) -> None:
        """Ends replacements of partitions that were cut off, and drops what was written but not listed."""
        if self._cut_off():
            self._drop("rollups")
        for status in self._cut_off():
            fresh = status.getPath()
            fs, _ = self._fs(self.root)
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
            listed = path(fresh, LISTED)
            if fs.exists(listed):
                raw = fs.open(listed)
                parts = json.loads(bytes(raw.readAllBytes()))
                raw.close()
                for at, held in parts:
                    old, new = path(f"{self.path}/{at}"), path(fresh, at)
                    if not held:
                        fs.delete(old, True)
                    elif fs.exists(new):  # else it was moved before the crash
                        fs.delete(old, True)
                        fs.mkdirs(old.getParent())
                        fs.rename(new, old)
            fs.delete(fresh, True)

    def _cut_off(self) -> list:
        fs, p = self._fs(f"{self.root}/rewrite-*")
        return list(fs.globStatus(p) or [])

    # -- upkeep
    def partitions(self) -> list[tuple[str, int, list[str]]]:
        """(namespace, hour, files) of each partition, as the listing has them."""
        found: dict[tuple[str, int], list[str]] = {}
        for file in self.frame().inputFiles():
            namespace, hour = file.rsplit("/", 3)[1:3]
            found.setdefault((unquote(unquote(namespace.partition("=")[2])), int(hour.partition("=")[2])), []).append(file)
        return [(*k, v) for k, v in sorted(found.items())]

    def compact(self, bounds: Bounds = Bounds()) -> None:
        """Leaves one point for each series and time, the last written, and one set of files. Partitions compacted before are not read."""
        self.recover()
        fs, marks = self._fs(f"{self.path}/*/*/{COMPACTED}")
        clean = {tuple(str(x.getPath().getParent()).rsplit("/", 2)[1:]) for x in fs.globStatus(marks) or []}
        within = lambda hour: (bounds.low is None or hour >= bounds.low // HOUR * HOUR) and (bounds.high is None or hour <= bounds.high)
        touched = [(n, h) for n, h, files in self.partitions() if within(h) and (len(files) > 1 or (f"namespace={n}", f"hour_bucket={h}") not in clean)]
        if touched:
            self._rewrite(placed(last_wins(self._of(touched))), touched, compact=True)

    def _of(self, parts: list[tuple[str, int]]) -> DataFrame:
        """The points of some partitions; only their folders are opened."""
        schema = f"{POINTS}, namespace string, hour_bucket bigint"
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*[f"{self.path}/namespace={n}/hour_bucket={h}" for n, h in parts])

    def retain(self, now: int, days: float, by_namespace: dict[str, float] | None = None) -> int:
        """Drops the partitions whose last point is older than the days allowed (0: for ever); returns how many.

        The hour tells the answer for all partitions but those in the hour of the limit, which alone are read.
        """
        self.recover()
        old, edge = [], []
        for namespace, hour, _ in self.partitions():
            seconds = (by_namespace or {}).get(namespace, days) * 86400
            if seconds > 0 and now - (hour + HOUR - 1) > seconds:
                old.append((namespace, hour))
            elif seconds > 0 and now - hour > seconds:
                edge.append((namespace, hour))
        if edge:
            ends = self._of(edge).groupBy("namespace", "hour_bucket").agg(F.max("time").alias("end")).collect()
            old += [(r["namespace"], r["hour_bucket"]) for r in ends if now - r["end"] > (by_namespace or {}).get(r["namespace"], days) * 86400]
        if old:
            self._drop("rollups")
        for namespace, hour in old:
            fs, p = self._fs(f"{self.path}/namespace={namespace}/hour_bucket={hour}")
            fs.delete(p, True)
        return len(old)

    def snapshot(self, to: str) -> None:
        self._copy(self.path, f"{to}/points")

    def restore(self, snapshot: str) -> None:
        self._drop("rollups")
        fs, p = self._fs(self.path)
        fs.delete(p, True)
        self._copy(f"{snapshot}/points", self.path)

    def _copy(self, a: str, b: str) -> None:
        fs, source = self._fs(a)
        other, target = self._fs(b)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, other, target, False, True, conf)

    def stats(self) -> dict:
        """Counts of points, series, partitions and files."""
        df = self.frame()
        r = df.agg(F.count(F.lit(1)).alias("points"), F.approx_count_distinct("series_id").alias("series"), F.count_distinct("namespace", "hour_bucket").alias("partitions")).first()
        return {**r.asDict(), "files": len(df.inputFiles())}


def retained(points: DataFrame, now: int, days: float, by_namespace: dict[str, float] | None = None) -> DataFrame:
    """The rule of retain() on rows: points in (namespace, hour) partitions whose last point is young enough."""
    allowed = F.lit(float(days))
    for name, own in (by_namespace or {}).items():
        allowed = F.when(F.col("namespace") == name, F.lit(float(own))).otherwise(allowed)
    df = placed(points)
    keep = df.groupBy("namespace", "hour_bucket").agg(F.max("time").alias("_end")).where((allowed <= 0) | (F.lit(now) - F.col("_end") <= allowed * 86400))
    return df.join(keep, ["namespace", "hour_bucket"], "left_semi").select(*COLUMNS)
