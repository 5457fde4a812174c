"""Counters of streams and batches, also in the text form that metric scrapers read."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


@dataclass
class Metrics:
    counters: dict[str, float] = field(default_factory=dict)

    def add(self, name: str, by: float) -> None:
        self.counters[name] = self.counters.get(name, 0) + by

    def text(self, prefix: str = "tidemark") -> str:
        return "".join(f"# TYPE {prefix}_{k} counter\n{prefix}_{k} {v:g}\n" for k, v in sorted(self.counters.items()))


class StreamMetrics(StreamingQueryListener):
    """Adds every micro-batch to the counters; register with spark.streams.addListener()."""

    def __init__(self, metrics: Metrics):
        self.metrics = metrics

    def onQueryStarted(self, event) -> None:
        self.metrics.add("streams_started", 1)

    def onQueryProgress(self, event) -> None:
        self.metrics.add("batches", 1)
        self.metrics.add("points_in", event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.metrics.add("streams_ended", 1)


def observed(points: DataFrame, name: str = "points") -> tuple[DataFrame, Observation]:
    """points, whose count, bounds of time and mean are known once an action has run."""
    seen = Observation(name)
    return points.observe(seen, F.count(F.lit(1)).alias("n"), F.min("time").alias("first"), F.max("time").alias("last"), F.avg("value").alias("mean")), seen
