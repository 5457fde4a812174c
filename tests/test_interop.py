import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.plans.catalogue import QUERIES
from tidemark.sources import binary, points, text
from tidemark.sources.series import series_id
from tidemark.streaming.metrics import Metrics, observed


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-(2**40), 2**40), st.floats(allow_nan=False)), min_size=1, max_size=60))
def test_segment_round_trip(rows):
    times = np.array(sorted(t for t, _ in rows), np.int64)
    values = np.array([v for _, v in rows])
    series, t, v = binary.decode_segment(binary.encode_segment(-5, 0, times, values))
    assert series == 2**64 - 5 and t.tolist() == times.tolist() and v.tobytes() == values.tobytes()


def test_known_segment_bytes():
    times = np.array([1697040000, 1697040010, 1697040050])
    raw = binary.encode_segment(7, 1697040000, times, np.array([1.5, 1.5, 2.0]))
    # deltas of deltas 0, 10, 30 as zig-zag varints; 1.5 raw, the same, then 2.0: 15 leading and 51 trailing zeros apart from it
    assert raw[binary.HEADER.size :] == bytes((1, 1, 0, 20, 60, 2, 0, 0, 0, 0, 0, 0, 0xF8, 0x3F, 0, 1, 1, 51, 2, 0xFF, 0x0F))


def test_first_form_and_broken_files():
    raw = binary.HEADER.pack(binary.FORM_1, 9, 0, 2, 5, 4) + bytes((10, 1)) + np.array([1.0, 2.0]).tobytes()
    assert [x.tolist() if hasattr(x, "tolist") else x for x in binary.decode_segment(raw)] == [9, [5, 4], [1.0, 2.0]]
    for bad in (b"", raw[:20], b"XXSEG1" + raw[6:], binary.encode_segment(1, 0, np.array([1, 2]), np.array([1.0, 3.0]))[:-1][: binary.HEADER.size + 3]):
        with pytest.raises(binary.BrokenFile):
            binary.decode_segment(bad)


def test_log():
    rows = [(1, 10, 1.5), (2**63 + 1, -4, -0.0)]
    raw = binary.encode_log(rows)
    assert binary.decode_log(raw) == rows
    with pytest.raises(binary.BrokenFile):
        binary.decode_log(raw[:-1])
    with pytest.raises(binary.BrokenFile):
        binary.decode_log(raw[:10] + b"\xff" + raw[11:])


def test_files(spark, tmp_path):
    rows = [(series_id("m"), "m", {}, t, float(t % 5), i) for i, t in enumerate((10, 20, 3700, 3650))]
    frame = spark.createDataFrame(rows, points.POINTS)
    for r in binary.encoded_segments(frame).collect():
        folder = tmp_path / "segments" / str(r["hour"])
        folder.mkdir(parents=True)
        (folder / "a.seg").write_bytes(bytes(r["content"]))
    got = sorted((r["series_id"], r["time"], r["value"]) for r in binary.read_segments(spark, str(tmp_path / "segments")).collect())
    assert got == sorted((r[0], r[3], r[4]) for r in rows)
    (tmp_path / "wal").mkdir()
    (tmp_path / "wal" / "current.wal").write_bytes(binary.encode_log([(series_id("m"), 1, 42.0), (series_id("m"), 2, 43.5)]))
    assert [(r["time"], r["value"]) for r in binary.read_logs(spark, str(tmp_path / "wal")).orderBy("place").collect()] == [(1, 42.0), (2, 43.5)]
    (tmp_path / "MANIFEST").write_text('{"series_id":18446744073709551615,"hour_bucket":0,"start_ts":10,"end_ts":20,"count":2,"path":"segments/0/a.seg"}\n')
    assert binary.read_manifest(spark, str(tmp_path / "MANIFEST")).first()["count"] == 2


def test_csv_and_results(spark, tmp_path):
    (tmp_path / "in.csv").write_text("series,ts,value\nm,1,2.5\nm,x,1\n,3,1\nm,4,no\n")
    df = text.read_csv(spark, str(tmp_path / "in.csv"))
    assert [(r["series"], r["time"], r["value"]) for r in df.orderBy("time").collect()] == [("m", 1, 2.5), ("m", 4, 0.0)]
    text.write_result(df.select("time", "value"), str(tmp_path / "out"), "csv")
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2
    with pytest.raises(ValueError, match="unknown kind"):
        text.write_result(df, "x", "xml")


def test_metrics(spark):
    m = Metrics()
    m.add("points_in", 3)
    m.add("points_in", 2)
    assert "tidemark_points_in 5\n" in m.text()
    df, seen = observed(spark.createDataFrame([(1, "m", {}, 5, 2.0, 0)], points.POINTS))
    df.collect()
    assert seen.get == {"n": 1, "first": 5, "last": 5, "mean": 2.0}


def sent_to_driver(spark, run):
    """What run() gives, and the bytes of task results that came to the driver meanwhile."""
    sc = spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).resultSize() for i in range(found.size())}

    before = stages()
    out = run()
    return out, sum(size for stage, size in stages().items() if stage not in before)


@pytest.fixture(scope="module")
def many_points(spark, tmp_path_factory):
    """A folder with an events table of 60,000 points of two series over two days."""
    root = tmp_path_factory.mktemp("points")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 2 * 86400 + F.col("id") * 7919 % 86400).cast("timestamp_ntz")
    kind = F.when(F.col("id") % 3 == 0, "click").otherwise("view")
    spark.range(60_000).select(F.col("id").alias("event_id"), at.alias("ts"), F.col("id").alias("user_id"), kind.alias("event_type"), F.rand(7).alias("value"), F.lit("{}").alias("props")).write.parquet(f"{root}/events.parquet")
    return str(root)


def held(frame):
    return Counter(map(tuple, frame.select("series_id", "time", F.round("value", 6)).collect()))


def held_points(spark, many_points):
    return held(points.events(spark, many_points).scan())


def test_log_replay_sends_no_content_to_the_driver(spark, many_points, tmp_path):
    _, sent = sent_to_driver(spark, lambda: QUERIES["log_replay"](spark, many_points).write.parquet(str(tmp_path / "out")))
    assert held(spark.read.parquet(str(tmp_path / "out"))) == held_points(spark, many_points)
    assert sent < 300_000  # of 1,980,000 bytes of logs


def test_segment_round_trip_sends_no_content_to_the_driver(spark, many_points, tmp_path):
    _, sent = sent_to_driver(spark, lambda: QUERIES["segment_round_trip"](spark, many_points).write.parquet(str(tmp_path / "out")))
    assert held(spark.read.parquet(str(tmp_path / "out"))) == held_points(spark, many_points)
    assert sent < 300_000  # of some 600,000 bytes of segments


def test_a_segment_file_for_each_series_and_hour(spark, many_points, tmp_path):
    source = points.events(spark, many_points).scan()
    binary.write_segments(source, str(tmp_path / "segments"))
    files = {f.name: binary.decode_segment(f.read_bytes()) for f in (tmp_path / "segments").glob("*.seg")}
    wanted = {(r[0], r[1]): r[2] for r in source.groupBy("series_id", F.expr("time - pmod(time, 3600)")).count().collect()}
    assert {(int(name[:16], 16), int(name[17:-4])): len(times) for name, (_, times, _) in files.items()} == {(s & (1 << 64) - 1, hour): n for (s, hour), n in wanted.items()}
    assert all(int(name[:16], 16) == series and (np.diff(times) >= 0).all() for name, (series, times, _) in files.items())


def test_logs_of_bounded_size(spark, many_points, tmp_path):
    path = str(tmp_path / "logs")
    binary.write_logs(points.events(spark, many_points).scan(), path, records=7000)
    files = {f.name: binary.decode_log(f.read_bytes()) for f in sorted((tmp_path / "logs").glob("*.wal"))}
    assert sorted(map(len, files.values())) == [2000] * 2 + [7000] * 8
    assert [f.name for f in (tmp_path / "logs").iterdir() if not f.name.endswith(".wal")] == []
    times = [t for rows in files.values() for _, t, _ in rows]
    assert times == sorted(times)
    assert held(binary.read_logs(spark, path)) == held_points(spark, many_points)
    with pytest.raises(FileExistsError):
        binary.write_logs(points.events(spark, many_points).scan(), path)


def test_logs_in_a_store_that_tasks_cannot_write_to(spark, many_points, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "_known", lambda uri: False)
    path = str(tmp_path / "lo gs")
    binary.write_logs(points.events(spark, many_points).scan(), path, records=7000)
    assert len(list((tmp_path / "lo gs").glob("*.wal"))) == 10
    assert held(binary.read_logs(spark, path)) == held_points(spark, many_points)


def test_no_points_make_an_empty_folder(spark, tmp_path):
    binary.write_logs(spark.createDataFrame([], points.POINTS), str(tmp_path / "no logs"))
    assert binary.read_logs(spark, str(tmp_path / "no logs")).count() == 0


def test_long_logs_are_encoded_in_linear_time():
    began = time.process_time()
    assert len(binary.encode_log((7, i, 1.0) for i in range(300_000))) == 300_000 * 33
    assert time.process_time() - began < 20  # 300,000 copies of 5 MB take minutes
