"""FIT and GPX files: golden cases and round trips; streams against loops."""

import struct

import pytest

from cadenza.sources import files as f
from cadenza.streaming import flows


def fit_file(records, events):
    body = b"\x40\x00\x00" + struct.pack("<H", 20) + bytes([7]) + bytes([253, 4, 0x86, 0, 4, 0x85, 1, 4, 0x85, 2, 2, 0x84, 6, 2, 0x84, 7, 2, 0x84, 3, 1, 0x02])
    body += b"\x41\x00\x01" + struct.pack(">H", 21) + bytes([3]) + bytes([253, 4, 0x86, 0, 1, 0x00, 1, 1, 0x00])
    for r in records:
        body += b"\x00" + struct.pack("<IiiHHHB", *r)
    for e in events:
        body += b"\x01" + struct.pack(">IBB", *e)
    return struct.pack("<BBHI4sH", 14, 32, 2000, len(body), b".FIT", 0) + body + b"\0\0"


def test_fit_points_events_and_totals(spark):
    data = fit_file([(1000, 2**29, 2**28, 3000, 5000, 210, 130), (1001, 2**31 - 1, 2**31 - 1, 3000, 5000, 210, 130), (1002, 2**29, 2**28, 65535, 65535, 65535, 255)], [(1000, 0, 0), (1003, 0, 4), (1004, 0, 9), (1005, 8, 0)])
    got = f.read_fit(spark.createDataFrame([("a.fit", bytearray(data)), ("b.fit", bytearray(b"no")), ("c.fit", bytearray(data[:40]))], "path string, content binary")).collect()
    a = [r for r in got if r.path == "a.fit"]
    one, two = [r for r in a if r.kind == "record"]
    assert (one.lat, one.lon, one.power, one.heart_rate, one.altitude) == (45.0, 22.5, 210, 130, 100.0) and abs(one.speed_kmh - 18.0) < 1e-9
    assert (two.idx, two.power, two.heart_rate, two.altitude, two.speed_kmh) == (2, None, None, None, None)
    assert [r.event for r in a if r.kind == "timer"] == ["start", "stop_all"]
    assert [r.idx for r in a if r.kind == "total"] == [3]
    assert all(r.error and r.lat is None for r in got if r.path != "a.fit") and len(got) == len(a) + 2


GPX = '<gpx xmlns="http://www.topografix.com/GPX/1/1"><metadata><name>M</name></metadata>{}</gpx>'
CASES = [
    (GPX.format('<trk><name>T</name><trkseg><trkpt lat="1" lon="2"><ele>5.5</ele></trkpt><trkpt lat="x" lon="2"/></trkseg><trkseg><trkpt lat="3" lon="4"/></trkseg></trk>'), "T", [(1.0, 2.0, 5.5), (3.0, 4.0, None)]),
    (GPX.format('<rte><rtept lat="1" lon="2"/></rte>'), "M", [(1.0, 2.0, None)]),
    (GPX.format('<trk><trkseg><trkpt lon="2"/></trkseg></trk><rte><name>R</name><rtept lat="7" lon="8"/></rte>'), "R", [(7.0, 8.0, None)]),
    (GPX.format(""), None, None), ("<gpx><trk>", None, None),
]


@pytest.mark.parametrize("text,name,want", CASES)
def test_gpx(spark, text, name, want):
    rows = f.read_gpx(spark.createDataFrame([("p", bytearray(text.encode()))], "path string, content binary")).orderBy("idx").collect()
    if want is None:
        assert len(rows) == 1 and rows[0].error and rows[0].lat is None
    else:
        assert [(r.lat, r.lon, r.altitude) for r in rows] == want and {r.name for r in rows} == {name}


def test_gpx_round_trip(spark):
    pts = [(1, "a & <b>'\"", i, 50.0 + i / 7, 6.0 - i / 3) for i in range(50)]
    docs = f.gpx_documents(spark.createDataFrame(pts, "k long, name string, idx long, lat double, lon double"), "k", "name", "idx", "2026-01-01T00:00:00Z")
    back = f.read_gpx(docs.selectExpr("cast(k as string) path", "cast(gpx as binary) content")).orderBy("idx").collect()
    assert [(r.name, r.lat, r.lon) for r in back] == [(p[1], p[3], p[4]) for p in pts]


def test_new_files_by_content(spark):
    files = spark.createDataFrame([("b", bytearray(b"1")), ("a", bytearray(b"1")), ("c", bytearray(b"2")), ("d", bytearray(b"3"))], "path string, content binary")
    known = files.where("path = 'd'").selectExpr("sha1(content) as sha1")
    assert sorted(r.path for r in f.new_files(files, known).collect()) == ["a", "c"]


def test_guard_on_few_points(spark):
    good, bad = f.enough_points(spark.createDataFrame([(1, i) for i in range(3)] + [(2, 0)], "k long, i long"), "k", 3)
    assert good.count() == 3 and [tuple(r) for r in bad.collect()] == [(2, 1)]


def test_throttle_and_headings_on_a_stream(spark, tmp_path):
    rows = [(1, 1000 + s, float(h)) for s, h in [(0, 350), (2, 10), (4, 20), (5, 30), (9, 40), (10, 50)]]
    spark.createDataFrame(rows, "k long, s long, heading double").selectExpr("k", "timestamp_seconds(s) as ts", "heading").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k long, ts timestamp, heading double").parquet(f"{tmp_path}/in")

    def run(df, name):
        df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination(120)
        return [tuple(r) for r in spark.table(name).selectExpr("unix_seconds(ts)", "round(heading, 6)").orderBy("unix_seconds(ts)").collect()]

    assert [s - 1000 for s, _ in run(flows.throttled(stream, "k", "heading"), "thr")] == [0, 5, 10]
    mean, want = 350.0, [(1000, 350.0)]
    for _, s, h in rows[1:]:
        mean = (mean + 0.15 * ((h - mean + 180) % 360 - 180)) % 360
        want.append((s, round(mean, 6)))
    assert run(flows.smoothed_headings(stream, "k"), "ema") == want


def test_first_good_fix(spark):
    fixes = spark.createDataFrame([(1, 0, 1, 50.0), (1, 0, 3, 15.0), (1, 0, 4, 5.0), (2, 0, 1, 90.0), (2, 0, 4, 60.0), (2, 0, 9, 1.0)], "k long, a long, t long, accuracy_m double").selectExpr("k", "timestamp_seconds(a) asked_at", "timestamp_seconds(t) ts", "accuracy_m")
    assert {r.k: r.accuracy_m for r in flows.first_good_fix(fixes, "k").collect()} == {1: 15.0, 2: 60.0}


def test_forced_imports_and_checked_graphs(spark):
    rows = spark.createDataFrame([(1, 1)], "k long, i long")
    good, bad = f.enough_points(rows, "k", 3, force=True)
    assert good.count() == 1 and bad.count() == 0
    metadata = spark.createDataFrame([(2,)], "schema_version int")
    assert f.checked_graph({"nodes": rows}, metadata, 2) == {"nodes": rows}
    with pytest.raises(ValueError, match="schema versions"):
        f.checked_graph({}, metadata)


def test_arriving_files_are_imported_once(spark, tmp_path):
    seen, regrouped = [], []
    (tmp_path / "in").mkdir()

    def go():
        def take(batch):
            rows = [(r.path.rsplit("/", 1)[-1], bytes(r.content)) for r in batch.collect()]
            seen.extend(rows)
            return batch.selectExpr("CASE WHEN length(content) > 1 THEN 'success' ELSE 'small' END as kind")
        flows.import_batches(flows.arriving_files(spark, str(tmp_path / "in"), ".fit"), take, lambda _: regrouped.append(1), str(tmp_path / "ck")).start().awaitTermination(120)

    for name, text in (("a.fit", b"one"), ("b.txt", b"two")):
        (tmp_path / "in" / name).write_bytes(text)
    go()
    (tmp_path / "in" / "c.fit").write_bytes(b"3")
    go()
    assert seen == [("a.fit", b"one"), ("c.fit", b"3")] and regrouped == [1]


def test_results_kept_current_have_no_gaps(spark, tmp_path):
    table, source = str(tmp_path / "out"), str(tmp_path / "src")
    assert flows.current(spark, table) is None
    for n in (1, 2, 3, 4):
        spark.range(n).selectExpr("id", f"{n} as n").write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long, n int").parquet(source)
        query = flows.kept_current(stream, lambda s: s.read.parquet(source).groupBy().max("n"), table, str(tmp_path / "ck2")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert flows.current(spark, table).first()[0] == n
    assert len(flows.versions(spark, table)) == 2


def test_usable_fixes_and_latest_of_both(spark):
    rows = spark.createDataFrame([(1, 1000, 1010, 5.0), (2, 1000, 1200, 5.0), (3, 1000, 1010, 90.0)], "k long, t long, s long, accuracy_m double").selectExpr("k", "timestamp_seconds(t) ts", "timestamp_seconds(s) seen_at", "accuracy_m")
    assert [r.k for r in flows.usable_fixes(rows, 20.0).collect()] == [1]
    one = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k long, ts long, v string")
    assert [(r.k, r.one.v, r.two.v) for r in flows.latest_of_both(one, one.where("k = 1 and ts = 1"), "k").collect()] == [(1, "b", "a")]


def test_table_writes(spark):
    from cadenza.operators import history as h

    rows = lambda *x: spark.createDataFrame(list(x), "id long, v string")
    stored = rows((1, "a"), (2, "b"))
    assert sorted(map(tuple, h.inserted(stored, rows((3, "c")), "id").collect())) == [(1, "a"), (2, "b"), (3, "c")]
    for bad in (rows((2, "x")), rows((5, "x"), (5, "y"))):
        with pytest.raises(ValueError, match="there already"):
            h.inserted(stored, bad, "id")
    assert sorted(map(tuple, h.updated(stored, rows((2, "x"), (9, "y")), "id").collect())) == [(1, "a"), (2, "x")]
    assert sorted(map(tuple, h.without(stored, rows((1, "")), "id").collect())) == [(2, "b")]
    assert [r.cnt for r in h.merged_speed_bins(spark.createDataFrame([(1, k, n) for k, n in zip([*h.SPEED_LABELS, "odd"], (2, 3, 10, 4, 6, 5, 1, 7, 99))], "session_id long, label string, cnt long"), h.SPEED_LABELS).orderBy("label").collect()] == [5, 10, 10, 6, 7]
