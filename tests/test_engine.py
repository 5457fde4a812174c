"""Semantics, plans, storage and streams on small frames."""

import json
import math
import time as clock

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.engine import Engine
from tidemark.functions.scalars import floored_remainder, ln, time_bucket
from tidemark.operators import ema, fill
from tidemark.operators.align import as_of
from tidemark.plans import rollup
from tidemark.plans.builder import PlanError, time_bounds
from tidemark.plans.checks import CheckError
from tidemark.plans.language import parse
from tidemark.sources import catalog, ndjson, points, storage
from tidemark.sources.points import Bounds, FrameSource
from tidemark.sources.series import series_id, signed, xxh64
from tidemark.streaming import ingest


def frame(spark, rows):
    """rows: (series, time, value[, tags])"""
    data = [(series_id(r[0]), r[0], r[3] if len(r) > 3 else {}, r[1], r[2], i) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, points.POINTS)


def engine(spark, rows):
    return Engine(spark, FrameSource(frame(spark, rows)))


def values(df):
    return [tuple(r) for r in df.collect()]


METRIC = [("m", 0, 1.0), ("m", 60, 3.0), ("m", 120, 5.0)]


def test_select_constant(spark):
    df = engine(spark, METRIC).query("select 1")
    assert (df.columns, values(df)) == (["_col0"], [(1,)])


def test_average_over_three_points(spark):
    df = engine(spark, METRIC).query("select avg(value) from m where time >= 0")
    assert (df.columns, values(df)) == (["avg_0"], [(3.0,)])


def test_no_rows_give_no_global_row(spark):
    assert values(engine(spark, METRIC).query("select count() from m where time > 999")) == []


def test_null_safe_equality_and_float_arithmetic(spark):
    e = engine(spark, [("m", 1, None), ("m", 2, 4.0)])
    assert values(e.query("select time from m where time > 0 and value = null")) == [(1,)]
    assert values(e.query("select 1 + 1 as a, -3 as b")) == [(2.0, -3.0)]


def test_division_by_zero_raises(spark):
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        engine(spark, METRIC).query("select value / (value - value) as x from m where time >= 0").collect()


def test_names_of_columns(spark):
    df = engine(spark, METRIC).query("select value, time as t, value + 1, value from m where time >= 0")
    assert df.columns == ["value", "t", "_col2", "value_3"]


def test_sort_puts_nulls_lowest(spark):
    e = engine(spark, [("m", 1, None), ("m", 2, 4.0), ("m", 3, 1.0)])
    assert [r[0] for r in values(e.query("select time from m where time > 0 order by value"))] == [1, 3, 2]
    assert [r[0] for r in values(e.query("select time from m where time > 0 order by value desc"))] == [2, 3, 1]


def test_errors(spark):
    e = engine(spark, METRIC)
    with pytest.raises(CheckError, match="time_range_required"):
        e.query("select value from m")
    with pytest.raises(PlanError, match="unknown column"):
        e.query("select nothing from m where time > 0")
    with pytest.raises(PlanError, match="no store"):
        e.query("delete from m where time > 0")


def test_time_bounds():
    bounds = lambda w: time_bounds(parse(f"select value from m where {w}").where)
    assert bounds("time >= 10 and time < 20") == Bounds(10, 20)
    assert bounds("10 <= time and value > 3 and time <= 5 * 4") == Bounds(10, 20)
    assert bounds("time > -5") == Bounds(-5, None)
    assert bounds("time between 3 and 9") == Bounds(3, 9)
    assert bounds("time = 7") == Bounds(7, 7)
    assert bounds("time > 1 or time < 0") == Bounds()
    assert bounds("time >= '1970-01-02'") == Bounds(86400, None)
    recent = bounds("time between now() - 1h and now()")
    assert 3600 <= clock.time() - recent.low < 3700 and recent.high is None


def test_bounds_reach_the_files(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"), F.col("id").alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    text = Engine(spark, points.events(spark, str(tmp_path))).query("explain select value from events.click where time >= 10 and time < 20").first()[0]
    assert "GreaterThanOrEqual(ts,1970-01-01T00:00:10)" in text and "EqualTo(event_type,click)" in text
    assert "user_id" not in text.split("ReadSchema")[1].split("\n")[0]


def test_top_n_plan_and_no_python(spark):
    source = FrameSource(spark.range(9).selectExpr("1L series_id", "'m' series", "map('a', 'b') tags", "id time", "double(id) value", "id seq"))
    text = Engine(spark, source).query("explain select time, value from m where time >= 0 order by value desc limit 2 offset 1").first()[0]
    assert "TakeOrderedAndProject" in text and "Python" not in text


def test_execute_gives_json(spark):
    out = engine(spark, METRIC).execute("select time, value from m where time >= 60 order by time")
    assert out["rows"] == [[60, 3.0], [120, 5.0]] and out["stats"]["rows_emitted"] == 2
    json.dumps(out)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(-(10**6), 10**6), st.integers(1, 5000), st.integers(-100, 100)), min_size=1, max_size=20))
def test_time_bucket_floors(spark, rows):
    df = spark.createDataFrame(rows, "t bigint, s bigint, o bigint").select("t", "s", "o", time_bucket(F.col("s"), F.col("t")).alias("a"), time_bucket(F.col("s"), F.col("t"), F.col("o")).alias("b"))
    for r in df.collect():
        assert r["a"] == r["t"] // r["s"] * r["s"]
        assert r["b"] == (r["t"] - r["o"]) // r["s"] * r["s"] + r["o"]


def test_remainder_has_the_sign_of_the_divisor(spark):
    pairs = [(a, b) for a in (-7, 7, 6, 0) for b in (3, -3)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint").select("a", "b", floored_remainder(F.col("a"), F.col("b")).alias("r"))
    assert all(r["r"] == r["a"] % r["b"] for r in df.collect())


def test_ln_as_ieee(spark):
    a, b, c = spark.range(1).select(ln(F.lit(0)), ln(F.lit(-1)), ln(F.lit(None).cast("double"))).first()
    assert a == -math.inf and math.isnan(b) and c is None


def model_rate(rows):
    up = [b - a if b >= a else b for (_, a), (_, b) in zip(rows, rows[1:], strict=False)]
    return None if not up or rows[-1][0] == rows[0][0] else sum(up) / (rows[-1][0] - rows[0][0])


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(0, 50)), min_size=1, max_size=12))
def test_rate_family(spark, rows):
    rows = sorted(((t, float(v)) for t, v in rows), key=lambda r: r[0])
    got = values(engine(spark, [("m", t, v) for t, v in rows]).query("select rate(value), delta(value), integral(value), irate(value) from m where time >= 0"))[0]
    pairs = list(zip(rows, rows[1:], strict=False))
    last = pairs[-1] if pairs else None
    want = (model_rate(rows), rows[-1][1] - rows[0][1] if pairs else None, sum((a[1] + b[1]) / 2 * (b[0] - a[0]) for a, b in pairs) if pairs else None, (last[1][1] - last[0][1]) / (last[1][0] - last[0][0]) if last and last[1][0] > last[0][0] else None)
    for g, w in zip(got, want, strict=True):
        assert (g is None) == (w is None) and (g is None or g == pytest.approx(w))


def test_ema_over_many_runs(spark):
    rows = [("a", i, float(i % 7) if i % 11 else None) for i in range(1, 100)] + [("b", 5, None), ("b", 6, 2.0)]
    out = ema.ema(frame(spark, rows), "value", 0.3, ["series_id"], ["time", "seq"], "e", run=8)
    got = {(r["series"], r["time"]): r["e"] for r in out.collect()}
    assert len(got) == len(rows) and out.columns[-1] == "e"
    for s in "ab":
        e = None
        for _, t, v in [r for r in rows if r[0] == s]:
            e = e if v is None else v if e is None else 0.3 * v + 0.7 * e
            assert (got[s, t] is None) == (e is None) and (e is None or got[s, t] == pytest.approx(e))


def test_fill_kinds(spark):
    df = spark.createDataFrame([("x", 0, 1.0), ("x", 30, 4.0), ("y", 10, None), (None, 0, 2.0), (None, 20, 8.0)], "k string, b bigint, v double")
    get = lambda kind, c=None: {(r["k"], r["b"]): r["v"] for r in fill.fill(df, "b", 10, ["k"], ["v"], kind, c).collect()}
    assert get("null") == {("x", 0): 1.0, ("x", 10): None, ("x", 20): None, ("x", 30): 4.0, ("y", 10): None, (None, 0): 2.0, (None, 10): None, (None, 20): 8.0}
    assert get("previous")["x", 20] == 1.0 and get("linear")["x", 20] == pytest.approx(3.0) and get("linear")[None, 10] == 5.0
    assert get("constant", F.lit(7))["y", 10] == 7.0
    with pytest.raises(Exception, match="more than 2 buckets"):
        fill.grid(df, "b", 10, ["k"], max_buckets=2).collect()


def test_as_of_crosses_slices(spark):
    left = frame(spark, [("l", t, 0.0) for t in (5, 15, 95, 100)]).select("time", "value", "seq")
    right = frame(spark, [("r", t, float(t)) for t in (10, 15, 40)]).select("time", "value", "seq")
    got = {r["time"]: r["right_time"] for r in as_of(left, right, slice_seconds=10).collect()}
    assert got == {5: None, 15: 15, 95: 40, 100: 40}
    near = {r["time"]: r["right_value"] for r in as_of(left, right, slice_seconds=10, tolerance=10).collect()}
    assert near == {5: None, 15: 15.0, 95: None, 100: None}


def test_rollup_stands_in_only_where_it_fits(spark):
    rows = [("m", t, float(t % 17)) for t in range(0, 7200, 7)]
    source = FrameSource(frame(spark, rows))
    rolled = rollup.Rollups({60: rollup.build(source.scan(), 60)})
    ask = "select time_bucket({s}, time) as b, avg(value) as a, count() as n from m where {w} group by time_bucket({s}, time)"
    for step, where, fits in ((300, "time >= 0 and time < 3600", 60), (90, "time >= 0", None), (300, "time >= 30", None), (300, "time >= 0 and value > 3", None)):
        text = ask.format(s=step, w=where)
        got = sorted(values(Engine(spark, source, rolled).query(text)))
        assert rolled.used == fits
        want = sorted(values(Engine(spark, source).query(text)))
        assert len(got) == len(want) > 0 and all(g == pytest.approx(w) for g, w in zip(got, want, strict=True))


def test_series_ids():
    assert signed(xxh64(b"cpu.total")) == 5647934688031563484
    assert xxh64(b"") == 0xEF46DB3751D8E999


def test_ndjson_rules(spark, tmp_path):
    lines = ['{"series":"a.b","ts":1,"value":2}', '{"series":"a.b","ts":2,"fields":{"s":"x","n":3,"m":4}}', '{"series":"a.b","ts":3}', '{"series":"a.b","ts":4,"value":"no"}', "{broken", "", '{"ts":5}', '{"series":"a.b","ts":6,"value":1.5,"tags":{"z":"1","a":"2"}}']
    (tmp_path / "in.json").write_text("\n".join(lines))
    got = {r["time"]: r for r in ndjson.read(spark, str(tmp_path)).collect()}
    assert {t: r["value"] for t, r in got.items()} == {1: 2.0, 2: 3.0, 3: 0.0, 4: 0.0, 6: 1.5}
    assert got[6]["tags"] == {"z": "1", "a": "2"} and got[6]["series_id"] == series_id("a.b", '{"z":"1","a":"2"}') != got[1]["series_id"]


def test_store_round(spark, tmp_path):
    store = storage.Store(spark, f"file://{tmp_path}/s")
    e = Engine(spark, store, store=store)
    assert store.scan().count() == 0
    store.append(frame(spark, [("cpu.a", -5, 1.0), ("cpu.a", 10, 2.0), ("cpu.a", 4000, 3.0), ("mem.b", 10, 9.0)]))
    e.query("insert into cpu.a (time, value) values (10, 5)")
    assert store.stats()["points"] == 5 and store.stats()["partitions"] == 4
    store.snapshot(f"file://{tmp_path}/copy")
    store.compact()
    assert sorted(values(e.query("select time, value from cpu.a where time > -100"))) == [(-5, 1.0), (10, 5.0), (4000, 3.0)]
    assert e.query("delete from cpu.a where time >= 0 and value > 4").first()[0] == 1
    assert sorted(values(e.query("select time from cpu.a where time > -100"))) == [(-5,), (4000,)]
    assert store.retain(now=86400 + 3000, days=1) == 2
    assert sorted(r["time"] for r in store.scan().collect()) == [4000]
    store.restore(f"file://{tmp_path}/copy")
    assert store.scan().count() == 5
    assert store.retain(now=10 * 86400, days=0, by_namespace={"mem": 1}) == 1


def test_stream_into_store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"series":"a.b","ts":1,"value":2}\n{"series":"a.b","ts":7200,"value":3}\n{bad')
    store = storage.Store(spark, f"file://{tmp_path}/s")

    def run():
        ingest.into_store(ingest.lines(spark, str(tmp_path / "in")), store, f"{tmp_path}/c", once=True).awaitTermination()

    run()
    (tmp_path / "in" / "2.json").write_text('{"series":"a.b","ts":1,"value":4}')
    run()
    run()  # nothing new: nothing written twice
    assert store.scan().count() == 3
    store.compact()
    assert sorted((r["time"], r["value"]) for r in store.scan().collect()) == [(1, 4.0), (7200, 3.0)]


def test_catalog(spark):
    made = catalog.frames(spark)
    assert {k: v.count() for k, v in made.items()} == {"pg_namespace": 2, "pg_class": 1, "pg_type": 28, "pg_attribute": 11}
    assert values(made["pg_namespace"].orderBy("oid")) == [(11000, "pg_catalog"), (11001, "public")]


def test_windows_by_slices_match_whole_series(spark):
    """Neighbours, moving and exponential averages over slices of any size, against one pass over each series; null keys are keys."""
    import random

    from pyspark.sql import functions as F

    from tidemark.operators import ema, slices

    rnd = random.Random(4)
    rows = []
    for key in ("a", None, "b"):
        t = 0
        for i in range(120):
            t += rnd.choice([0, 1, 1, 7, 60])
            rows.append((key, t, i, None if rnd.random() < 0.2 or key == "b" and i < 5 else rnd.random()))
    df = spark.createDataFrame(rows, "k string, time bigint, seq bigint, value double").repartition(4)
    by = {k: [r for r in rows if r[0] == k] for k in ("a", None, "b")}
    for size in (5, 100, 100_000):
        got = slices.neighbours(df, [slices.Neighbour(F.col("value"), "p"), slices.Neighbour(F.col("seq"), "p3", 3), slices.Neighbour(F.col("seq"), "n2", 2, True)], ["k"], ["time", "seq"], size)
        want = [(*r, s[i - 1][3] if i else None, s[i - 3][2] if i >= 3 else None, s[i + 2][2] if i + 2 < len(s) else None) for s in by.values() for i, r in enumerate(s)]
        assert sorted(map(tuple, got.select("k", "time", "seq", "value", "p", "p3", "n2").collect()), key=repr) == sorted(want, key=repr)
        moved = {(r["k"], r["seq"]): r["m"] for r in slices.moving_average(df, F.col("value"), 30, "m", ["k"], "time", size).collect()}
        for k, s in by.items():
            for r in s:
                near = [x[3] for x in s if r[1] - 30 < x[1] <= r[1] and x[3] is not None]
                assert moved[k, r[2]] == (pytest.approx(sum(near) / len(near)) if near else None)
        for alpha in (0.001, 0.3, 0.999, 1.0):
            found = {(r["k"], r["seq"]): r["e"] for r in ema.ema(df, "value", alpha, ["k"], ["time", "seq"], "e", run=7, size=size).collect()}
            assert len(found) == len(rows)
            for k, s in by.items():
                e = None
                for r in s:
                    e = e if r[3] is None else r[3] if e is None else alpha * r[3] + (1 - alpha) * e
                    assert found[k, r[2]] == (None if e is None else pytest.approx(e))


def test_no_task_sorts_a_whole_series(spark):
    from tidemark.engine import Engine
    from tidemark.plans.builder import explain
    from tidemark.sources.points import FrameSource

    df = frame(spark, [("m", i, float(i)) for i in range(10)])
    for call in ("ema(value, 0, 0.5)", "lag(value)", "moving_avg(value, 60)", "rate(value)"):
        plan = explain(Engine(spark, FrameSource(df)).query(f"select {call} as x from m where time >= 0"))
        assert "_slot" in plan and ("SinglePartition" not in plan or call == "rate(value)")  # rate's own sum over all


def test_as_of_with_null_keys(spark):
    from tidemark.operators.align import as_of

    schema = "k string, time bigint, value double, seq bigint"
    left = spark.createDataFrame([(None, 95, 1.0, 0), ("a", 95, 1.0, 1)], schema)
    right = spark.createDataFrame([(None, 12, 5.0, 0), ("a", 13, 6.0, 1)], schema)
    got = as_of(left, right, ["k"], slice_seconds=10)
    assert {(r["k"], r["right_time"]) for r in got.collect()} == {(None, 12), ("a", 13)}


def test_store_is_whole_after_a_crash(spark, tmp_path, monkeypatch):
    from tidemark.engine import Engine
    from tidemark.plans.builder import PlanError
    from tidemark.sources.storage import Store

    store = Store(spark, f"file://{tmp_path}/s")
    store.append(frame(spark, [("m", i * 3600, float(i)) for i in range(4)]))
    engine = Engine(spark, store, store=store)
    with pytest.raises(PlanError):
        engine.query("insert into m values (1, 42, 'ok')")
    recover, calls = Store.recover, []

    def crash(self):
        calls.append(1)
        if len(calls) == 2:  # after the new partitions are listed
            raise RuntimeError("lost")
        return recover(self)

    monkeypatch.setattr(Store, "recover", crash)
    with pytest.raises(RuntimeError):
        engine.query("delete from m where time >= 3600 and time < 7200")
    monkeypatch.undo()
    assert store.scan().count() == 4
    store.recover()
    assert sorted(r["time"] for r in store.scan().collect()) == [0, 7200, 10800]
    extra = frame(spark, [("m", 5, 9.0)])
    assert store.append_once(extra, "x", 7) and not store.append_once(extra, "x", 7)
    store.append(frame(spark, [("x", 0, 0.0), ("m", 5, 10.0)]))
    store.compact()
    before = {f for _, _, files in store.partitions() for f in files}
    assert [r["value"] for r in store.scan().where("time = 5").collect()] == [10.0]
    store.compact()  # nothing to do: no file changes
    assert before == {f for _, _, files in store.partitions() for f in files}
    store.roll_up()
    assert sorted(store.rollups().tables) == [60, 3600]
    store.append(extra)
    assert not store.rollups().tables
