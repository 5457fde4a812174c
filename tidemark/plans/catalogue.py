"""Registered queries, most of them texts of the language over the driver's tables, and their DuckDB equivalents.

Doubles are rounded to six places on both sides, as sums may differ in their last bits with the order of rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..engine import Engine
from ..operators.align import align, as_of
from ..sources import binary, catalog, ndjson, points, storage, text
from ..sources.points import Bounds, in_range
from ..sources.series import series_id, unsigned
from ..sources.shared import shared_dir
from ..streaming import ingest
from . import rollup
from .checks import CheckError
from .language import LanguageError
from .translate import translate

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

E = """WITH p AS (SELECT event_type, 'events.' || event_type AS series, CAST(floor(epoch(ts)) AS BIGINT) AS time, value, event_id AS seq,
 CAST(user_id AS VARCHAR) AS user_tag, json_extract_string(props, '$.k') AS k FROM events), c AS (SELECT * FROM p WHERE series = 'events.click')
"""
LO, HI = 1704067200, 1704672000  # a week
WEEK = f"time >= {LO} and time < {HI}"
CLICK = f"SELECT * FROM c WHERE {WEEK}"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def add(name: str, query: str | Query, sql: str | None) -> None:
    if isinstance(query, str):
        QUERIES[name] = lambda spark, sf_dir: rounded(Engine(spark, points.tables(spark, sf_dir)).query(query))
    else:
        QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


# -- scans, projection, filters
add(
    "flagship_hourly",
    f"select time_bucket(3600, time) as bucket, avg(value) as v, count() as n from events.click where time >= 0 group by time_bucket(3600, time) order by bucket",
    E + "SELECT time - time % 3600 AS bucket, round(avg(value), 6) AS v, count(*) AS n FROM c GROUP BY 1 ORDER BY 1",
)
add("scan_range", f"select time, value from events.click where {WEEK}", E + f"SELECT time, round(value, 6) AS value FROM c WHERE {WEEK}")
add("scan_by_id", f"select time, value from by_id({series_id('events.click') & (1 << 64) - 1}) where {WEEK}", E + f"SELECT time, round(value, 6) AS value FROM c WHERE {WEEK}")
add("scan_star", f"select * from events.view where {WEEK}", E + f"SELECT time, round(value, 6) AS value FROM p WHERE series = 'events.view' AND {WEEK}")
add("select_const", "select 1 as one, 'it''s' as text, 1.5 as half, true as yes", "SELECT CAST(1 AS INTEGER) AS one, 'it''s' AS text, CAST(1.5 AS DOUBLE) AS half, true AS yes")
add("filter_logic", "select time, value from events.click where time >= 0 and (value < 10 or value > 90) and not (value = 95)", E + "SELECT time, round(value, 6) AS value FROM c WHERE (value < 10 OR value > 90) AND NOT value = 95")
add("filter_symbols", "select time, value from events.click where time >= 0 && (value < 5 || value >= 99)", E + "SELECT time, round(value, 6) AS value FROM c WHERE value < 5 OR value >= 99")
add("filter_regex", "select time, tag.k as k from events.click where time >= 0 and tag.k =~ '^[12]' and tag.user !~ '7'", E + "SELECT time, k FROM c WHERE regexp_matches(k, '^[12]') AND NOT regexp_matches(user_tag, '7')")
add("filter_tag", "select time, value, tag.user as u from events.view where time >= 0 and tag.user = '17'", E + "SELECT time, round(value, 6) AS value, user_tag AS u FROM p WHERE series = 'events.view' AND user_tag = '17'")
add("filter_null_eq", "select time from events.click where time >= 0 and (tag.none = null) = true and value != null", E + "SELECT time FROM c WHERE value IS DISTINCT FROM NULL")
add("filter_between_iso", "select time, value from events.click where time between '2024-01-03' and '2024-01-04T12:00:00'", E + "SELECT time, round(value, 6) AS value FROM c WHERE time BETWEEN 1704240000 AND 1704369600")
add("filter_duration", f"select time from events.click where time >= {LO} and time < {LO} + 12h", E + f"SELECT time FROM c WHERE time >= {LO} AND time < {LO} + 43200")
add("arith_float", "select time, value + 1 as a, value - 2 as b, value * 3 as c, value / 4 as d, -value as e, 1 + 2 * 3 as f from events.click where time >= 0", E + "SELECT time, round(value + 1, 6) AS a, round(value - 2, 6) AS b, round(value * 3, 6) AS c, round(value / 4, 6) AS d, round(-value, 6) AS e, CAST(7 AS DOUBLE) AS f FROM c")
add("mod_floor", "select time, time % 7 as a from events.click where time >= 0", E + "SELECT time, time % 7 AS a FROM c")
add(
    "math_scalars",
    "select time, abs(value - 50) as a, ceil(value) as b, floor(value) as c, round(value) as d, pow(value, 2) as e, ln(value + 1) as f, sqrt(value) as g from events.click where time >= 0",
    E + "SELECT time, round(abs(value - 50), 6) AS a, CAST(ceil(value) AS DOUBLE) AS b, CAST(floor(value) AS DOUBLE) AS c, round(value) AS d, round(pow(value, 2), 6) AS e, round(ln(value + 1), 6) AS f, round(sqrt(value), 6) AS g FROM c",
)
add("coalesce_tag", "select time, coalesce(tag.none, tag.k, 'x') as k from events.click where time >= 0", E + "SELECT time, coalesce(k, 'x') AS k FROM c")
add("column_names", f"select time_bucket(86400, time), avg(value), count() from events.click where time >= 0 group by time_bucket(86400, time)", E + f"SELECT time - time % 86400 AS time_bucket_0, round(avg(value), 6) AS avg_1, count(*) AS count_2 FROM c GROUP BY 1")

# -- aggregates
add("agg_global", f"select avg(value) as a, sum(value) as s, count() as n, count(value) as m from events.click where time >= 0", E + f"SELECT round(avg(value), 6) AS a, round(sum(value), 6) AS s, count(*) AS n, count(value) AS m FROM c")
add("agg_global_empty", "select avg(value) as a, count() as n from events.click where time < 0", E + "SELECT avg(value) AS a, count(*) AS n FROM c WHERE time < 0 HAVING count(*) > 0")
add("agg_expression", f"select sum(value) / count() * 2 as x, max(value) - min(value) as spread from events.click where time >= 0", E + f"SELECT round(sum(value) / count(*) * 2, 6) AS x, round(max(value) - min(value), 6) AS spread FROM c")
add("agg_group_tag", "select tag.user as u, count() as n, avg(value) as a from events.click where time >= 0 group by tag.user", E + "SELECT user_tag AS u, count(*) AS n, round(avg(value), 6) AS a FROM c GROUP BY 1")
add("agg_bucket", "select time_bucket(60, time) as b, avg(value) as a, count() as n from events.click where time >= 0 group by time_bucket(60, time)", E + "SELECT time - time % 60 AS b, round(avg(value), 6) AS a, count(*) AS n FROM c GROUP BY 1")
add("agg_bucket_tag", "select time_bucket(1d, time) as b, tag.k as k, sum(value) as s from events.view where time >= 0 group by time_bucket(1d, time), tag.k", E + "SELECT time - time % 86400 AS b, k, round(sum(value), 6) AS s FROM p WHERE series = 'events.view' GROUP BY 1, 2")
add("bucket_origin", "select time_bucket(3600, time, 1800) as b, count() as n from events.click where time >= 0 group by time_bucket(3600, time, 1800)", E + "SELECT time - (time - 1800) % 3600 AS b, count(*) AS n FROM c GROUP BY 1")
add("bucket_negative", "select time_bucket(60, -61) as a, time_bucket(60, 59) as b, time_bucket(60, 60) as c", "SELECT CAST(-120 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(60 AS BIGINT) AS c")
add("min_max", "select time_bucket(86400, time) as b, min(value) as lo, max(value) as hi from events.click where time >= 0 group by time_bucket(86400, time)", E + "SELECT time - time % 86400 AS b, round(min(value), 6) AS lo, round(max(value), 6) AS hi FROM c GROUP BY 1")
add(
    "first_last",
    "select time_bucket(86400, time) as b, first(value) as f, last(value) as l from events.click where time >= 0 group by time_bucket(86400, time)",
    E + "SELECT time - time % 86400 AS b, round(first(value ORDER BY time, seq), 6) AS f, round(last(value ORDER BY time, seq), 6) AS l FROM c GROUP BY 1",
)
add("percentile", "select time_bucket(86400, time) as b, percentile(value, 0.5) as p50, percentile(value, 0.95) as p95 from events.click where time >= 0 group by time_bucket(86400, time)", E + "SELECT time - time % 86400 AS b, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM c GROUP BY 1")

# -- the rate family
PAIRS = E + ", w AS (SELECT *, {b} AS b, lag(value) OVER g AS pv, lag(time) OVER g AS pt FROM c WINDOW g AS (PARTITION BY {b} ORDER BY time, seq))"
RATE = "sum(CASE WHEN pv IS NULL THEN NULL WHEN value >= pv THEN value - pv ELSE value END) / nullif(max(time) - min(time), 0)"
INTEGRAL = "sum((value + pv) / 2 * (time - pt))"
IRATE = "last((value - pv) / nullif(time - pt, 0) ORDER BY time, seq)"
DELTA = "CASE WHEN count(*) >= 2 THEN last(value ORDER BY time, seq) - first(value ORDER BY time, seq) END"
for _name, _sql in (("rate", RATE), ("irate", IRATE), ("delta", DELTA), ("integral", INTEGRAL)):
    add(_name, f"select {_name}(value) as x from events.click where time >= 0", PAIRS.format(b="0") + f" SELECT round({_sql}, 6) AS x FROM w")
    add(f"{_name}_bucket", f"select time_bucket(3600, time) as b, {_name}(value) as x from events.click where time >= 0 group by time_bucket(3600, time)", PAIRS.format(b="time - time % 3600") + f" SELECT b, round({_sql}, 6) AS x FROM w GROUP BY b")

# -- windows
add("lag_lead", "select time, value, lag(value) as a, lag(value, 2) as b, lead(value) as c from events.click where time >= 0", E + "SELECT time, round(value, 6) AS value, round(lag(value) OVER w, 6) AS a, round(lag(value, 2) OVER w, 6) AS b, round(lead(value) OVER w, 6) AS c FROM c WINDOW w AS (ORDER BY time, seq)")
add("lag_bucket", "select time_bucket(86400, time) as b, avg(value) as a, avg(value) - lag(avg(value)) as d from events.click where time >= 0 group by time_bucket(86400, time)", E + "SELECT b, round(a, 6) AS a, round(a - lag(a) OVER (ORDER BY b), 6) AS d FROM (SELECT time - time % 86400 AS b, avg(value) AS a FROM c GROUP BY 1)")
add("moving_avg", "select time, value, moving_avg(value, 1h) as m from events.click where time >= 0", E + "SELECT time, round(value, 6) AS value, round(avg(value) OVER (ORDER BY time RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW), 6) AS m FROM c")
EMA = "SELECT {t}, round(e, 6) AS e FROM r"
add(
    "ema_points",
    "select time, ema(value, 0, 0.25) as e from events.click where time >= 0",
    E.replace("WITH", "WITH RECURSIVE") + ", n AS (SELECT time, value, row_number() OVER (ORDER BY time, seq) AS i FROM c), r AS (SELECT i, time, value AS e FROM n WHERE i = 1 UNION ALL SELECT n.i, n.time, 0.25 * n.value + 0.75 * r.e FROM r JOIN n ON n.i = r.i + 1) " + EMA.format(t="time"),
)
add(
    "ema_bucket",
    "select time_bucket(3600, time) as b, ema(avg(value), 3600, 0.5) as e from events.click where time >= 0 group by time_bucket(3600, time)",
    E.replace("WITH", "WITH RECURSIVE") + ", a AS (SELECT time - time % 3600 AS b, avg(value) AS v FROM c GROUP BY 1), n AS (SELECT b, v, row_number() OVER (ORDER BY b) AS i FROM a), r AS (SELECT i, b, v AS e FROM n WHERE i = 1 UNION ALL SELECT n.i, n.b, 0.5 * n.v + 0.5 * r.e FROM r JOIN n ON n.i = r.i + 1) " + EMA.format(t="b"),
)
add("fill_forward", f"select time_bucket(600, time) as b, avg(value) as a, fill_forward(avg(value)) as f from events.click where time >= 0 group by time_bucket(600, time) fill(null)", None)

# -- gap filling
GRID = (
    E
    + f", a AS (SELECT time - time % 600 AS b, avg(value) AS v FROM c GROUP BY 1), g AS (SELECT unnest(generate_series((SELECT min(b) FROM a), (SELECT max(b) FROM a), 600)) AS b), j AS (SELECT g.b, a.v FROM g LEFT JOIN a USING (b))"
)
FILLED = "select time_bucket(600, time) as b, avg(value) as v from events.click where time >= 0 group by time_bucket(600, time) "
ORACLE_SQL["fill_forward"] = GRID + " SELECT b, round(v, 6) AS a, round(last_value(v IGNORE NULLS) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS f FROM j"
add("fill_null", FILLED + "fill(null)", GRID + " SELECT b, round(v, 6) AS v FROM j")
add("fill_previous", FILLED + "fill(previous)", GRID + " SELECT b, round(last_value(v IGNORE NULLS) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS v FROM j")
add("fill_const", FILLED + "fill(-1)", GRID + " SELECT b, round(coalesce(v, -1), 6) AS v FROM j")
add(
    "fill_linear",
    FILLED + "fill(linear)",
    GRID
    + """, k AS (SELECT b, v, last_value(CASE WHEN v IS NOT NULL THEN b END IGNORE NULLS) OVER u AS b0, last_value(v IGNORE NULLS) OVER u AS v0,
 first_value(CASE WHEN v IS NOT NULL THEN b END IGNORE NULLS) OVER d AS b1, first_value(v IGNORE NULLS) OVER d AS v1 FROM j
 WINDOW u AS (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), d AS (ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT b, round(CASE WHEN v IS NOT NULL THEN v ELSE v0 + (v1 - v0) * (b - b0) / (b1 - b0) END, 6) AS v FROM k""",
)
add(
    "fill_by_tag",
    "select time_bucket(1d, time) as b, tag.k as k, count() as n from events.signup where time >= 0 group by time_bucket(1d, time), tag.k fill(0)",
    E + ", a AS (SELECT time - time % 86400 AS b, k, count(*) AS n FROM p WHERE series = 'events.signup' GROUP BY 1, 2), g AS (SELECT k, unnest(generate_series(min(b), max(b), 86400)) AS b FROM a GROUP BY k) SELECT g.b, g.k, coalesce(a.n, 0) AS n FROM g LEFT JOIN a ON a.b = g.b AND a.k IS NOT DISTINCT FROM g.k",
)

# -- order and limits
add("order_nulls", "select time, lag(value) as l from events.signup where time >= 0 order by l, time limit 5", E + "SELECT time, round(l, 6) AS l FROM (SELECT time, lag(value) OVER (ORDER BY time, seq) AS l FROM p WHERE series = 'events.signup') ORDER BY l ASC NULLS FIRST, time LIMIT 5")
add("topn", "select time, value, tag.user as u from events.click where time >= 0 order by value desc, time, u limit 10", E + "SELECT time, round(value, 6) AS value, user_tag AS u FROM c ORDER BY value DESC, time, user_tag LIMIT 10")
add("topn_offset", "select time, value, tag.user as u from events.click where time >= 0 order by value desc, time, u limit 10 offset 5", E + "SELECT time, round(value, 6) AS value, user_tag AS u FROM c ORDER BY value DESC, time, user_tag LIMIT 10 OFFSET 5")
add("order_hidden", f"select value from events.click where time >= 0 order by time, value limit 20", E + f"SELECT round(value, 6) AS value FROM c ORDER BY time, value LIMIT 20")

# -- other tables as series
add(
    "lineitem_daily_revenue",
    "select time_bucket(1d, time) as day, sum(value) as revenue, count() as n from lineitem.R where time >= 0 group by time_bucket(1d, time)",
    "SELECT CAST(floor(epoch(l_shipdate) / 86400) * 86400 AS BIGINT) AS day, round(sum(l_extendedprice * (1 - l_discount)), 6) AS revenue, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1",
)
add(
    "orders_weekly",
    "select time_bucket(1w, time) as week, tag.priority as priority, avg(value) as a, max(value) as m from orders.O where time >= 0 group by time_bucket(1w, time), tag.priority",
    "SELECT CAST(floor(epoch(o_orderdate) / 604800) * 604800 AS BIGINT) AS week, o_orderpriority AS priority, round(avg(o_totalprice), 6) AS a, round(max(o_totalprice), 6) AS m FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2",
)


# -- the DataFrame interface
def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.events(spark, sf_dir).scan()


add("range_endpoint", lambda s, d: rounded(in_range(points.events(s, d), LO, LO + 86400, "events.click")), E + f"SELECT time, round(value, 6) AS value FROM c WHERE time BETWEEN {LO} AND {LO + 86400}")
add("series_ids", lambda s, d: _events(s, d).groupBy("series").agg(F.min(unsigned(F.col("series_id")).cast("string")).alias("id")), "SELECT * FROM (VALUES " + ", ".join(f"('events.{k}', '{series_id(f'events.{k}') & (1 << 64) - 1}')" for k in ("click", "error", "purchase", "signup", "view")) + ") AS t(series, id) WHERE series IN (SELECT 'events.' || event_type FROM events)")


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series by user, so that tags tell them apart."""
    return points.tag_index(_events(spark, sf_dir).withColumn("series_id", F.try_element_at("tags", F.lit("user")).cast("bigint")))


add("tag_index", _tagged, E + "SELECT DISTINCT 'user' AS tag_key, user_tag AS tag_value, CAST(user_tag AS BIGINT) AS series_id FROM p UNION SELECT DISTINCT 'k', k, CAST(user_tag AS BIGINT) FROM p WHERE k IS NOT NULL")
add("find_and", lambda s, d: points.find(_tagged(s, d), {"user": "17", "k": "3"}), E + "SELECT DISTINCT CAST(user_tag AS BIGINT) AS series_id FROM p WHERE user_tag = '17' AND EXISTS (SELECT 1 FROM p q WHERE q.user_tag = '17' AND q.k = '3')")
add("find_or", lambda s, d: points.find(_tagged(s, d), {"user": "17", "k": "3"}, "or"), E + "SELECT DISTINCT CAST(user_tag AS BIGINT) AS series_id FROM p WHERE user_tag = '17' OR k = '3'")
add(
    "compact_last_wins",
    lambda s, d: rounded(storage.last_wins(_events(s, d).withColumn("time", F.col("time") - F.pmod("time", F.lit(600)))).select("series", "time", "value", "seq")),
    E + "SELECT series, b AS time, round(value, 6) AS value, seq FROM (SELECT *, time - time % 600 AS b, row_number() OVER (PARTITION BY series, time - time % 600 ORDER BY seq DESC) AS n FROM p) WHERE n = 1",
)
add(
    "retention_ttl",
    lambda s, d: rounded(storage.retained(_events(s, d), 1706700000, 7).select("series", "time", "value")),
    E + "SELECT series, time, round(value, 6) AS value FROM (SELECT *, max(time) OVER (PARTITION BY time - time % 3600) AS e FROM p) WHERE 1706700000 - e <= 7 * 86400",
)


def _stored(spark: SparkSession, sf_dir: str) -> storage.Store:
    """A fresh store that holds the events."""
    store = storage.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    store.append(_events(spark, sf_dir))
    return store


def _after(*texts: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = _stored(spark, sf_dir)
        engine = Engine(spark, store, store=store)
        for text in texts:
            engine.query(text)
        return rounded(engine.query("select series, time, value from events.click where time >= 0"))

    return run


add("delete_range", _after(f"delete from events.click where time >= {LO} and time < {LO + 300000} and value > 20"), E + f"SELECT series, time, round(value, 6) AS value FROM c WHERE NOT (time >= {LO} AND time < {LO + 300000} AND value > 20)")
add("insert_row", _after(f"insert into events.click (time, value) values ({HI} + 5, 42.5)"), E + f"SELECT series, time, round(value, 6) AS value FROM c UNION ALL SELECT 'events.click', {HI + 5}, 42.5")
add(
    "translated_writes",
    _after(translate(f"INSERT INTO events.click (time, value) VALUES ({HI + 7}, 7.25);").text, translate(f"DELETE FROM events.click WHERE time < {LO + 100000};").text),
    E + f"SELECT series, time, round(value, 6) AS value FROM c WHERE time >= {LO + 100000} UNION ALL SELECT 'events.click', {HI + 7}, 7.25",
)


def _compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _stored(spark, sf_dir)
    store.append(store.scan(Bounds(LO, LO + 7200)).where(F.col("time") <= LO + 7200).withColumn("value", F.col("value") + 1000).withColumn("seq", F.col("seq") + 10_000_000))
    store.compact()
    return rounded(store.scan().select("series", "time", "value"))


add(
    "store_compact",
    _compacted,
    E + f", b AS (SELECT * FROM p UNION ALL SELECT event_type, series, time, value + 1000, seq + 10000000, user_tag, k FROM p WHERE time <= {LO + 7200}) SELECT series, time, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY series, time ORDER BY seq DESC) AS n FROM b) WHERE n = 1",
)


def _rollups(spark: SparkSession, sf_dir: str) -> rollup.Rollups:
    minute = rollup.build(_events(spark, sf_dir), 60)
    return rollup.Rollups({60: minute, 3600: rollup.coarser(minute, 3600)})


add("rollup_1h_from_1m", lambda s, d: rounded(_rollups(s, d).tables[3600].select("series", "bucket", "sum", "n", "min", "max")), E + "SELECT series, time - time % 3600 AS bucket, round(sum(value), 6) AS sum, count(*) AS n, round(min(value), 6) AS min, round(max(value), 6) AS max FROM p GROUP BY 1, 2")
add(
    "rollup_planned",
    lambda s, d: rounded(Engine(s, points.tables(s, d), _rollups(s, d)).query(f"select time_bucket(7200, time) as b, avg(value) as a, max(value) - min(value) as r, count() as n from events.click where time >= 0 group by time_bucket(7200, time)")),
    E + f"SELECT time - time % 7200 AS b, round(avg(value), 6) AS a, round(max(value) - min(value), 6) AS r, count(*) AS n FROM c GROUP BY 1",
)
NULLS = E.replace("value, event_id", "CASE WHEN event_id % 3 > 0 THEN value END AS value, event_id")


def _with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).withColumn("value", F.when(F.col("seq") % 3 > 0, F.col("value")))


def _rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollups that the store holds, over points some of which have no value."""
    store = storage.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    store.append(_with_nulls(spark, sf_dir))
    store.roll_up()
    made = store.rollups()
    df = Engine(spark, store, made).query("select time_bucket(7200, time) as b, avg(value) as a, max(value) - min(value) as r, count() as n, count(value) as m from events.click where time >= 0 group by time_bucket(7200, time)")
    assert made.used == 3600
    return rounded(df)


add("rollup_nulls", _rolled, NULLS + "SELECT time - time % 7200 AS b, round(avg(value), 6) AS a, round(max(value) - min(value), 6) AS r, count(*) AS n, count(value) AS m FROM c GROUP BY 1")


def _restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _stored(spark, sf_dir)
    store.snapshot(f"{store.root}/snapshot")
    store.delete_where(F.lit(True), F.col("time") < LO + 900_000)
    store.restore(f"{store.root}/snapshot")
    return rounded(store.scan().select("series", "time", "value"))


add("snapshot_restore", _restored, E + "SELECT series, time, round(value, 6) AS value FROM p")


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _stored(spark, sf_dir).stats()
    return spark.createDataFrame([(found["points"], found["series"], found["partitions"], found["files"] >= found["partitions"])], "points bigint, series bigint, partitions bigint, filed boolean")


add("store_stats", _counted, E + "SELECT count(*) AS points, count(DISTINCT series) AS series, count(DISTINCT time - time % 3600) AS partitions, true AS filed FROM p")


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _stored(spark, sf_dir)
    store.append(_events(spark, sf_dir).withColumn("series", F.concat(F.lit("old."), F.col("series"))))
    store.retain(1706700000, 7, {"old": 21})
    return rounded(store.scan().select("series", "time", "value"))


KEPT = "(SELECT *, 1706700000 - max(time) OVER (PARTITION BY time - time % 3600) AS age FROM p)"
add("store_retain", _kept, E + f"SELECT series, time, round(value, 6) AS value FROM {KEPT} WHERE age <= 7 * 86400 UNION ALL SELECT 'old.' || series, time, round(value, 6) FROM {KEPT} WHERE age <= 21 * 86400")


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points as segments of a series and hour, and read back."""
    path = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    binary.write_segments(_events(spark, sf_dir), path)
    return rounded(binary.read_segments(spark, path).select("series_id", "time", "value"))


IDS = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {series_id(f'events.{k}')}" for k in ("click", "error", "purchase", "signup", "view")) + " END"
add("segment_round_trip", _segments, E + f"SELECT CAST({IDS} AS BIGINT) AS series_id, time, round(value, 6) AS value FROM p")


def _logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points as logs of a day each, and replayed."""
    path = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    binary.write_logs(_events(spark, sf_dir), path)
    return rounded(binary.read_logs(spark, path).select("series_id", "time", "value"))


add("log_replay", _logged, ORACLE_SQL["segment_round_trip"])


def _from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    text.write_result(_events(spark, sf_dir).select("series", F.col("time").alias("ts"), "value"), path, "csv")
    return rounded(text.read_csv(spark, path).select("series", "time", "value"))


add("csv_import", _from_csv, ORACLE_SQL["snapshot_restore"])
add(
    "align_join",
    lambda s, d: rounded(align(_events(s, d).where("series = 'events.click'"), _events(s, d).where("series = 'events.view'"), 3600, names=("clicks", "views"))),
    E + "SELECT a.bucket, round(clicks, 6) AS clicks, round(views, 6) AS views FROM (SELECT time - time % 3600 AS bucket, avg(value) AS clicks FROM c GROUP BY 1) a JOIN (SELECT time - time % 3600 AS bucket, avg(value) AS views FROM p WHERE series = 'events.view' GROUP BY 1) b USING (bucket)",
)
add(
    "as_of_join",
    lambda s, d: rounded(as_of(_events(s, d).where("series = 'events.click'").select("time", "value", "seq"), _events(s, d).where("series = 'events.view'").select("time", "value", "seq"), slice_seconds=7200)),
    E + """, v AS (SELECT time, seq, value FROM p WHERE series = 'events.view'), x AS (SELECT c.seq, max(struct_pack(t := v.time, s := v.seq, v := v.value)) AS m FROM c JOIN v ON v.time <= c.time GROUP BY c.seq)
SELECT c.time, round(c.value, 6) AS value, c.seq, m.t AS right_time, round(m.v, 6) AS right_value FROM c LEFT JOIN x ON c.seq = x.seq""",
)


# -- ingest, streams, catalog, translation
def _ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines of mixed quality, read back."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    line = F.when(F.col("event_id") % 5 == 0, F.format_string('{"series": "a.%s", "ts": %d, "fields": {"x": "no", "y": %d.5}}', "event_type", at, F.col("event_id")))
    line = line.when(F.col("event_id") % 5 == 1, F.format_string('{"series": "a.%s", "ts": %d, "value": "text"}', "event_type", at))
    line = line.when(F.col("event_id") % 5 == 2, F.lit("{not json")).when(F.col("event_id") % 5 == 3, F.format_string('{"series": "a.%s", "ts": %d}', "event_type", at))
    line = line.otherwise(F.format_string('{"series":"a.%s","ts":%d,"value":%d,"tags":{"h": "%d"}}', "event_type", at, F.col("event_id"), F.col("user_id")))
    return ndjson.parse_text(df.select(line.alias("value"))).select("series", "time", "value", F.try_element_at("tags", F.lit("h")).alias("h"))


add(
    "ndjson_ingest",
    _ingested,
    """SELECT 'a.' || event_type AS series, CAST(floor(epoch(ts)) AS BIGINT) AS time, CAST(CASE event_id % 5 WHEN 0 THEN event_id + 0.5 WHEN 4 THEN event_id ELSE 0 END AS DOUBLE) AS value,
 CASE WHEN event_id % 5 = 4 THEN CAST(user_id AS VARCHAR) END AS h FROM events WHERE event_id % 5 != 2""",
)
add("load_generator", lambda s, d: rounded(ndjson.generated(s)), "SELECT 'weather.room1' AS series, 1694300000 + i * 10 AS ts, round(20 + (i % 100) / 10, 6) AS value FROM range(10000) t(i)")


def _streamed(shape: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{sf_dir}/events.parquet"
        raw = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/[e]vents.parquet")  # a pattern, as a stream's plain path must be a folder
        source = points.events(spark, sf_dir)
        source.frame = raw
        name = f"stream_{uuid.uuid4().hex}"
        query = shape(source.scan()).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
        query.awaitTermination()
        return rounded(spark.table(name))

    return run


SUMMARY = "count(*) AS n, round(avg(value), 6) AS avg, round(min(value), 6) AS min, round(max(value), 6) AS max"
add("stream_tumbling", _streamed(lambda p: ingest.windowed(p, "1 hour")), E + f'SELECT series, time - time % 3600 AS start, time - time % 3600 + 3600 AS "end", {SUMMARY} FROM p GROUP BY 1, 2, 3')
add("stream_sliding", _streamed(lambda p: ingest.windowed(p, "2 hours", "1 hour")), E + f'SELECT series, b AS start, b + 7200 AS "end", {SUMMARY} FROM (SELECT *, unnest([time - time % 3600, time - time % 3600 - 3600]) AS b FROM p) GROUP BY 1, 2, 3')
add(
    "stream_sessions",
    _streamed(lambda p: ingest.sessions(p, "10 minutes")),
    E + f', g AS (SELECT *, CASE WHEN time - lag(time) OVER w <= 600 THEN 0 ELSE 1 END AS fresh FROM p WINDOW w AS (PARTITION BY series ORDER BY time, seq)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY series ORDER BY time, seq) AS id FROM g) SELECT series, min(time) AS start, max(time) + 600 AS "end", {SUMMARY} FROM s GROUP BY series, id',
)


def _into_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events through a stream of 150 partitions a batch into the store, the second half of its batches sent twice."""
    store = storage.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    source = points.events(spark, sf_dir)
    source.frame = spark.readStream.schema(points.EVENTS).parquet(f"{sf_dir}/[e]vents.parquet")
    rows = source.scan()
    for _ in range(2):  # the second time as after a crash before the stream's own commit
        checkpoint = f"{store.root}/checkpoint-{uuid.uuid4().hex}"
        ingest.into_store(rows.repartition(150), store, checkpoint, once=True, source="events").awaitTermination()
    df = store.scan()
    return rounded(df.withColumn("tied", F.count(F.lit(1)).over(Window.partitionBy("seq")) > 1).select("series", "time", "value", "tied"))


add("stream_into_store", _into_store, E + "SELECT series, time, round(value, 6) AS value, false AS tied FROM p")


def _appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows in append mode: each is put out once, when the watermark passes its end, and its state is freed."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = points.events(spark, sf_dir)
    last = source.scan().agg(F.max("time")).first()[0]
    later = F.explode(F.array(F.lit(0), F.when(F.col("event_id") == 0, F.lit(1)))).alias("again")
    rows = source.frame.select("*", later).where("again is not null")
    # one more point, far ahead, in a file of its own, takes the watermark past all windows
    rows.where("again = 0").drop("again").coalesce(1).write.parquet(f"{root}/in")
    rows.where("again = 1").drop("again").withColumn("ts", F.timestamp_seconds(F.lit(last + 86400 * 2)).cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(f"{root}/in")
    source.frame = spark.readStream.schema(points.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    made = ingest.windowed(source.scan(), "1 hour").writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/out")
    made.awaitTermination()
    return rounded(spark.read.parquet(f"{root}/out"))


add("stream_append", _appended, ORACLE_SQL["stream_tumbling"])


def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What EXPLAIN shows: a scan of three columns, with the time bound and the series pushed down."""
    plan = Engine(spark, points.tables(spark, sf_dir)).query(f"explain select time, value from events.click where time >= {LO}").first()["plan"]
    return spark.createDataFrame([("Scan parquet" in plan, "PushedFilters" in plan and "EqualTo(event_type,click)" in plan and "GreaterThanOrEqual(ts" in plan, "props" not in plan)], "scan boolean, pushed boolean, pruned boolean")


add("explain_plan", _explained, "SELECT true AS scan, true AS pushed, true AS pruned")
add("now_in_where", "select time, value from events.click where time <= now() and time >= 0 and now() > 1700000000", E + "SELECT time, round(value, 6) AS value FROM c")
add("unary_plus", "select time, +value as a, - -value as b from events.click where time >= 0", E + "SELECT time, round(value, 6) AS a, round(value, 6) AS b FROM c")
add("comments", "select time, value -- a remark, 'quoted'\nfrom events.click -- another\nwhere time >= 0 and value < 10", E + "SELECT time, round(value, 6) AS value FROM c WHERE value < 10")

BROKEN = {
    "select value from events.click": "time_range_required",
    "select nothing(value) from events.click where time >= 0": "invalid_syntax",
    "select avg() from events.click where time >= 0": "invalid_function_arity",
    "select time from events.click where time >= 0 and avg(value) > 1": "invalid_syntax",
    "select from": "invalid_syntax",
    "select avg(value) as a from events.click where time >= 0 fill(0)": "unsupported_fill_policy",
}


def _refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of each statement that is refused."""
    engine, out = Engine(spark, points.tables(spark, sf_dir)), []
    for query in BROKEN:
        try:
            engine.query(query)
            out.append((query, "none"))
        except CheckError as e:
            out.append((query, e.diagnostics[0].code))
        except LanguageError as e:
            out.append((query, e.code))
    out += [(q, translate(q).sqlstate) for q in ("CREATE TABLE t (a int)", "SELECT 1 RETURNING x")]
    return spark.createDataFrame(out, "statement string, code string")


add("refused", _refused, "SELECT * FROM (VALUES " + ", ".join(f"('{q}', '{c}')" for q, c in [*BROKEN.items(), ("CREATE TABLE t (a int)", "0A000"), ("SELECT 1 RETURNING x", "0A000")]) + ") AS t(statement, code)")
add("catalog_types", lambda s, d: catalog.frames(s)["pg_type"].groupBy("typcategory").agg(F.count(F.lit(1)).alias("n"), F.sum("oid").alias("ids")), "SELECT typcategory, CAST(n AS BIGINT) AS n, CAST(ids AS BIGINT) AS ids FROM (VALUES ('A', 14, 19734), ('B', 1, 16), ('D', 4, 4463), ('N', 6, 3165), ('S', 1, 25), ('U', 2, 6752)) AS t(typcategory, n, ids)")
add("catalog_attributes", lambda s, d: catalog.frames(s)["pg_attribute"].select("attname", "atttypid", "attnum"), "SELECT attname, CAST(atttypid AS BIGINT) AS atttypid, attnum FROM (VALUES ('oid', 23, 1), ('typname', 25, 2), ('typlen', 21, 3), ('typbyval', 16, 4), ('typtype', 25, 5), ('typcategory', 25, 6), ('typdelim', 25, 7), ('typelem', 23, 8), ('typarray', 23, 9), ('typbasetype', 23, 10), ('typcollation', 23, 11)) AS t(attname, atttypid, attnum)")


def _translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = translate(f"SELECT time, value FROM events.click WHERE time >= {LO} AND time < {LO + 86400} ORDER BY time;")
    return rounded(Engine(spark, points.tables(spark, sf_dir)).query(made.text))


add("translated_sql", _translated, E + f"SELECT time, round(value, 6) AS value FROM c WHERE time >= {LO} AND time < {LO + 86400} ORDER BY time")
