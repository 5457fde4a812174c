"""The engine: statements in, DataFrames out."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .plans import builder, checks, language
from .plans.rollup import Rollups
from .sources.points import PointSource


@dataclass
class Engine:
    """`store` (see sources.storage) takes inserts and deletes; without one only selects and explain run."""

    spark: SparkSession
    source: PointSource
    rollups: Rollups | None = None
    store: object = None

    def query(self, text: str) -> DataFrame:
        """The result of a statement; the plan of EXPLAIN and the counts of INSERT and DELETE are rows, too."""
        return self.run(checks.checked(language.parse(text)))

    def run(self, statement: language.Statement) -> DataFrame:
        match statement:
            case language.Select():
                return builder.Planner(self.spark, self.source, self.rollups).select(statement)
            case language.Explain(target):
                if not isinstance(target, language.Select):
                    return self.spark.createDataFrame([(repr(target),)], "plan string")
                return self.spark.createDataFrame([(builder.explain(self.run(target)),)], "plan string")
            case language.Insert():
                n = self._stored().insert(statement)
            case language.Delete():
                n = self._stored().delete(statement)
        return self.spark.createDataFrame([(n,)], "rows bigint")

    def _stored(self):
        if self.store is None:
            raise builder.PlanError("this engine has no store to write to")
        return self.store

    def execute(self, text: str) -> dict:
        """Columns, rows and timings of a query, as one JSON-ready result. Rows come to the driver; meant for small results."""
        marks = [time.perf_counter()]
        parsed = language.parse(text)
        marks.append(time.perf_counter())
        checks.checked(parsed)
        marks.append(time.perf_counter())
        df = self.run(parsed)
        marks.append(time.perf_counter())
        rows = [list(r) for r in df.toLocalIterator()]
        marks.append(time.perf_counter())
        spans = dict(zip(("parse_us", "validate_us", "plan_us", "execute_us"), (round(1e6 * (b - a)) for a, b in zip(marks, marks[1:], strict=False)), strict=True))
        return {"columns": [{"name": n, "type": "value", "nullable": True} for n in df.columns], "rows": rows, "stats": {**spans, "rows_emitted": len(rows), "trace_id": uuid.uuid4().hex[:16]}}
