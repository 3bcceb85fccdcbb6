"""Sessions, intervals, graphs, decoders and tables, case by case."""

import random
import sqlite3
import struct
from datetime import date

import pytest
from pyspark.sql import functions as F

from chronoweave import __main__ as cli
from chronoweave.constants import MINUTE as M
from chronoweave.functions import network, times
from chronoweave.operators import asof, graph, intervals, location, running, sessions, upsert
from chronoweave.plans import report
from chronoweave.sources import binary, config, logs, sqlite

RAW = "entity string, time_ms long, src_ord int, seq long, kind string"
PERIOD = "entity string, first_ms long, last_ms long"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def fold_sessions(events, now):
    """Sessions one event at a time."""
    out, start, hard, close, key = [], None, False, None, None
    for t, _, _, kind in sorted(events, key=lambda e: e[:3]):
        if kind == "hard_open":
            start, hard = (t if start is None else start), True
        elif kind == "hard_close":
            if start is not None:
                out.append((start, t))
            start, hard, close = None, False, t
        else:
            quiet = key is None or t - key >= 30 * M
            if start is None and quiet and (close is None or t > close):
                start, hard = t, False
            elif start is not None and key is not None and quiet:
                out.append((start, key))
                start, hard = t, False
            key = t
    if start is not None:
        out.append((start, key if not hard and key is not None and key > start else now))
    return out


def fold_islands(periods):
    out = []
    for a, b in sorted(p for p in periods if p[1] - p[0] >= 10 * M):
        if out and a - out[-1][1] <= 5 * M:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def test_sessions_against_a_fold(spark):
    r = random.Random(2)
    streams = {}
    for k in range(150):
        t, events = 0, []
        for i in range(r.randint(0, 16)):
            t += r.choice([0, 1, 4, 10, 29, 30, 31]) * M
            kind = r.choice(["hard_open", "hard_close", "kbd", "kbd"])
            events.append((t, 3 if kind == "kbd" else 0, i, kind))
        streams[f"e{k}"] = events
    now = 10_000 * M
    df = spark.createDataFrame([(e, *x) for e, xs in streams.items() for x in xs], RAW)
    found = sessions.sessions(df, now)
    assert rows(found, "entity", "first_ms", "last_ms") == sorted((e, *s) for e, xs in streams.items() for s in fold_sessions(xs, now))
    assert rows(sessions.merge_islands(found), "entity", "first_ms", "last_ms") == sorted((e, *s) for e, xs in streams.items() for s in fold_islands(fold_sessions(xs, now)))


def test_gap_of_five_minutes_joins(spark):
    p = [("x", 0, 20 * M), ("x", 25 * M, 40 * M), ("x", 45 * M + 1, 60 * M), ("x", 61 * M, 62 * M)]
    assert rows(sessions.merge_islands(spark.createDataFrame(p, PERIOD)), "first_ms", "last_ms") == [(0, 40 * M), (45 * M + 1, 60 * M)]


def test_buckets(spark):
    h = 60 * M
    b = spark.createDataFrame([("x", k * h, s) for k, s in enumerate([0, 600, 3600, 1800, 0, 3600, 3600, 0])], "entity string, time_ms long, screen_on_secs long")
    keys = spark.createDataFrame([("x", h + 40 * M, "kbd", 1), ("x", 3 * h + 35 * M, "kbd", 2)], "entity string, time_ms long, kind string, seq long")
    got = rows(sessions.bucket_events(b, keys), "time_ms", "kind")
    assert got == [(h + 40 * M, "hard_open"), (3 * h + 35 * M, "hard_close"), (5 * h, "hard_open")]


def test_clip_to_days(spark):
    six = 1704434400000  # 2024-01-05T06:00Z
    p = spark.createDataFrame([("a", six - 30 * M, six + 30 * M), ("b", six - 30 * M, six + 30 * M)], PERIOD)
    keys = spark.createDataFrame([("a", six + 10 * M, "kbd", 1), ("b", six + 30 * M, "kbd", 2)], "entity string, time_ms long, kind string, seq long")
    got = rows(sessions.clip_to_days(p, keys, six * 2), "entity", "day", "first_ms", "last_ms")
    assert got == [("a", date(2024, 1, 4), six - 30 * M, six), ("a", date(2024, 1, 5), six + 10 * M, six + 30 * M), ("b", date(2024, 1, 4), six - 30 * M, six)]


def test_asof_bounds(spark):
    e = spark.createDataFrame([("x", t, t) for t in (100, 200, 300)], "entity string, time_ms long, seq long")
    p = spark.createDataFrame([("x", t) for t in (50, 100, 200, 250, 999)] + [("y", 100)], "entity string, at long")
    got = lambda strict: {(r.entity, r.at): r.event.time_ms if r.event else None for r in asof.asof(p, e, on="at", strict=strict).collect()}
    assert got(True) == {("x", 50): None, ("x", 100): None, ("x", 200): 100, ("x", 250): 200, ("x", 999): 300, ("y", 100): None}
    assert got(False)[("x", 100)] == 100


def test_session_of_a_point(spark):
    s = spark.createDataFrame([("x", 1000, 2000, "n", 1), ("x", 500_000, 900_000, "m", 2)], "entity string, first_ms long, last_ms long, ssid string, seq long")
    p = spark.createDataFrame([("x", t) for t in (1000, 2001, 61_000, 61_001, 900_001)], "entity string, time_ms long")
    assert rows(intervals.in_session(p, s), "time_ms", "ssid") == [(1000, "n"), (2001, "n"), (61_000, "n")]


def test_overlaps_come_once_across_bins(spark):
    r = random.Random(1)
    make = lambda: [("x", a, a + r.choice([0, 1, 5, 40])) for a in (r.randrange(100) for _ in range(60))]
    a, b = make(), make()
    left = spark.createDataFrame([(*x, k) for k, x in enumerate(a)], "entity string, l_first long, l_last long, i long")
    right = spark.createDataFrame([(*x, k) for k, x in enumerate(b)], "entity string, r_first long, r_last long, j long")
    want = sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if y[1] < x[2] and y[2] > x[1])
    assert rows(intervals.overlap_join(left, right, size=7), "i", "j") == want


def test_locate(spark):
    iv = spark.createDataFrame([("x", 0, 100, "active"), ("x", 100, 200, "transit"), ("x", 200, 300, "break"), ("x", 900, 950, "active")], PERIOD + ", label string")
    blocks = spark.createDataFrame([("x", 50, 400, "late", 1), ("x", 10, 60, "early", 2), ("x", 300, 310, "edge", 3)], PERIOD + ", place string, seq long")
    spare = spark.createDataFrame([("x", 0, 1000, "spare", 1)], PERIOD + ", place string, seq long")
    assert [r[2] for r in rows(intervals.locate(iv, blocks, spare), "first_ms", "label", "location")] == ["early", None, "late", "spare"]
    assert [r[1] for r in rows(intervals.locate(iv.where("first_ms = 200"), blocks.where("seq = 3")), "first_ms", "location")] == ["edge"]


def test_smoothing(spark):
    day = date(2024, 1, 5)
    make = lambda labels: spark.createDataFrame([("x", day, 100 * k, 100 * k + 100, c, None) for k, c in enumerate(labels)], "entity string, day date, first_ms long, last_ms long, label string, location string")
    labels = lambda s: [r[1] for r in rows(intervals.smooth(make(s)), "first_ms", "label")]
    a, t = "active", "transit"
    assert labels([a, t, a]) == [a, t, a] and labels([a, t, a, t, a]) == [a, t, a, t, a] and labels([a, t, a, t, a, t, a]) == [a, t, a, t, a]
    placed = spark.createDataFrame([("x", day, 0, 100, a, None), ("x", day, 100, 150, a, "p"), ("x", day, 150, 200, a, "q"), ("x", day, 300, 700, a, "r")], "entity string, day date, first_ms long, last_ms long, label string, location string")
    assert rows(intervals.smooth(placed), "first_ms", "last_ms", "location") == [(0, 700, "r")]


CO = "entity string, signal_a string, signal_b string, total_seconds double, last_seen long"


def test_clusters_and_dominant(spark):
    now, day = 1_700_000_000_000, 86_400_000
    co = spark.createDataFrame([("x", "duet:b", "subnet:1", 10_000.0, now), ("x", "duet:a", "subnet:1", 9000.0, now - 14 * day), ("x", "duet:z", "subnet:2", 1.0, now - 400 * day), ("y", "duet:z", "subnet:2", 50_000.0, now), ("y", "duet:k", "subnet:3", 50_000.0, now)], CO)
    found = graph.clusters(co, now)
    assert rows(found, "entity", "signal", "cluster") == [("x", "duet:a", "duet:a"), ("x", "duet:b", "duet:a"), ("x", "subnet:1", "duet:a"), ("y", "duet:k", "duet:k"), ("y", "duet:z", "duet:z"), ("y", "subnet:2", "duet:z"), ("y", "subnet:3", "duet:k")]
    assert rows(graph.dominant(co, found, now), "entity", "dominant_id") == [("x", "duet:a"), ("y", "duet:k")]
    assert graph.clusters(graph.empty_edges(spark), now).isEmpty()


def test_long_chain(spark):
    e = spark.createDataFrame([("x", f"n{k:03d}", f"n{k + 1:03d}") for k in range(60)], "entity string, a string, b string")
    assert {r.root for r in graph.components(e).collect()} == {"n000"}
    r = random.Random(5)
    e = spark.createDataFrame([(r.choice("xy"), f"n{r.randrange(60)}", f"n{r.randrange(60)}") for _ in range(50)], "entity string, a string, b string")
    assert rows(graph.components(e), "entity", "node", "root") == rows(graph.joined_up(e), "entity", "node", "root")


def test_pair_order(spark):
    df = spark.createDataFrame([("subnet:a", "duet:z"), ("subnet:b", "subnet:a"), ("duet:a", "duet:b")], "a string, b string")
    x, y = graph.ordered_pair(F.col("a"), F.col("b"))
    assert [tuple(r) for r in df.select(x, y).collect()] == [("duet:z", "subnet:a"), ("subnet:a", "subnet:b"), ("duet:a", "duet:b")]


def test_co_occurrence_mark(spark):
    p = PERIOD + ", signal string, seq long"
    a = spark.createDataFrame([("x", 0, 10_000, "duet:p", 1)], p)
    s = spark.createDataFrame([("x", 2000, 20_000, "subnet:n", 1)], p)
    assert rows(location.co_occurrences(a, s), "total_seconds", "last_seen") == [(8.0, 10_000)]
    assert rows(location.co_occurrences(a, s, since=6000), "total_seconds") == [(4.0,)]


def test_calendar(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        ms = lambda text: F.unix_millis(F.lit(text).cast("timestamp"))
        one = spark.range(1)
        got = one.select(times.effective_day(ms("2024-03-10 06:30:00")), times.effective_day(ms("2024-11-03 05:30:00")), times.day_start(F.lit("2024-03-10").cast("date")) == ms("2024-03-10 06:00:00"), times.effective_day(ms("2024-03-15 05:59:59.999")), times.effective_day(ms("2024-03-15 06:00:00"))).first()
        assert tuple(got) == (date(2024, 3, 10), date(2024, 11, 3), True, date(2024, 3, 14), date(2024, 3, 15))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    d = F.lit("2024-02-10").cast("date")
    midnight = 1707523200000
    got = spark.range(1).select(times.extended_time(d, F.lit(midnight + 1530 * M)), times.extended_time(d, F.lit(midnight + 59_999)), times.extended_time(d, F.lit(midnight + 1), True), times.duration(F.lit(90 * M)), times.duration(F.lit(30_000)), F.size(times.month_days(F.lit("202402"))), F.size(times.month_days(F.lit("202302")))).first()
    assert tuple(got) == ("25:30", "00:00", "00:01", "01h30", "00h01", 29, 28)


def test_subnets(spark):
    df = spark.createDataFrame([("192.168.1.77", "255.255.255.0"), ("10.1.2.3", "255.0.0.0"), ("nope", "255.0.0.0"), ("10.1.2", "255.255.0.0")], "ip string, mask string")
    assert [r[0] for r in df.select(network.subnet(F.col("ip"), F.col("mask"))).collect()] == ["192.168.1.0/24", "10.0.0.0/8", None, None]
    assert df.select(network.ip_to_long(F.col("ip"), strict=False)).collect()[3][0] == (10 << 16) + (1 << 8) + 2


def test_wifi_log(spark):
    text = ["Tue May  5 11:45:33.009  IP Address: 10.0.0.7 up", "  Router IP Address: 9.9.9.9", "  IP subnet mask: 255.255.255.0", "Tue May  5 11:45:33.800 more", "Tue May  5 11:45:40.000 IP Address: 0.0.0.0", "IP subnet mask: 255.0.0.0", "Tue May  5 11:46:00.000 IP Address: 10.0.0.9", "garbage"]
    lines = spark.createDataFrame([("f", 2026, k, t) for k, t in enumerate(text)], "file string, year int, pos long, value string")
    at = 1777981533000
    assert rows(logs.wifi_events(lines), "time_ms", "ip", "subnet") == [(at, "10.0.0.7", "10.0.0.0/24"), (at + 7000, "", "")]


def test_wifi_log_files(spark, tmp_path):
    import bz2

    (tmp_path / "wifi.log").write_text("Tue May  5 11:45:33.009  IP Address: 10.0.0.7 IP subnet mask: 255.255.255.0\n")
    (tmp_path / "wifi.log.0.bz2").write_bytes(bz2.compress(b"Mon May 25 01:00:00.000  IP Address: 10.1.0.7 IP subnet mask: 255.255.0.0\n"))
    assert rows(logs.read_wifi_logs(spark, [str(tmp_path)], 2026), "subnet") == [("10.0.0.0/24",), ("10.1.0.0/16",)]


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, wire, body):
    return varint(number << 3 | wire) + body


def text_field(number, text):
    return field(number, 2, varint(len(text)) + text)


def focus(at, bundle=b"app.x", gained=1, tail=b""):
    return field(2, 0, b"\x01") + field(3, 0, varint(gained)) + field(4, 1, struct.pack("<d", at)) + text_field(6, bundle) + tail


def test_focus_records():
    assert binary.focus_record(focus(1.5)) == (978307201500, "app.x")
    assert binary.focus_record(focus(1.5, tail=b"\x00\x00\x00\xaa\xbb\xcc\xdd")) == (978307201500, "app.x")
    assert binary.focus_record(focus(1.5, tail=text_field(9, b"10.0.0.1") + field(9, 0, b"\x01"))) == (978307201500, "app.x")
    assert [binary.focus_record(x) for x in (focus(1.5, gained=0), focus(0.0), focus(1.5, b""), focus(1.5, b"\xff"), b"", b"\x12\xff")] == [None] * 6


def test_container():
    d = binary.DELIMITER
    head = b"SEGB" + d + b"more" + d + b"\x00\x00\x00\x00"
    assert list(binary.payloads(head)) == []
    assert list(binary.payloads(head + d + b"one" + d + d + b"\x0atwo")) == [b"one", b"\x0atwo"]
    assert list(binary.payloads(b"")) == [] and list(binary.payloads(b"SEGB" + d)) == []


def test_binary_files(spark, tmp_path):
    d, head = binary.DELIMITER, b"SEGB" + binary.DELIMITER + b"\x00"
    (tmp_path / "1").write_bytes(head + d + focus(10.0) + d + focus(20.0, b"app.y"))
    (tmp_path / "2").write_bytes(head + d + focus(20.0, b"app.z"))
    (tmp_path / "notes").write_bytes(head + d + focus(30.0))
    at = lambda s: 978307200000 + s * 1000
    assert rows(binary.read_focus(spark, str(tmp_path)), "time_ms", "bundle_id") == [(at(10), "app.x"), (at(20), "app.y")]
    assert rows(binary.read_focus(spark, str(tmp_path), since_ms=at(10)), "time_ms") == [(at(20),)]
    times_ = text_field(2, b"skip") + field(2, 1, struct.pack("<d", 5.0)) + field(3, 1, struct.pack("<d", 9.0))
    record, nameless = times_ + text_field(4, text_field(3, b"net")), times_ + text_field(4, text_field(3, b""))
    wifi = tmp_path / "w"
    wifi.mkdir()
    (wifi / "a").write_bytes(b"xx" + binary.WIFI_MARKER + record + binary.WIFI_MARKER + nameless + binary.WIFI_MARKER)
    assert rows(binary.read_wifi_sessions(spark, str(wifi)), "first_ms", "last_ms", "ssid") == [(at(5), at(9), "net")]


def test_sqlite(spark, tmp_path):
    import gzip

    path = tmp_path / "a.db"
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE PLDisplayAgent_EventPoint_Display (timestamp REAL, Block TEXT, Active INT)")
    db.executemany("INSERT INTO PLDisplayAgent_EventPoint_Display VALUES (?, ?, ?)", [(1.2999, "Backlight", 1), (1.2991, "Backlight", 0), (2.0, "Other", 1), (3.0, "Backlight", 0)])
    db.execute("CREATE TABLE ZOBJECT (Z_PK INTEGER PRIMARY KEY, ZSTREAMNAME TEXT, ZSTARTDATE REAL, ZENDDATE REAL, ZVALUESTRING TEXT)")
    db.executemany("INSERT INTO ZOBJECT (ZSTREAMNAME, ZSTARTDATE, ZENDDATE, ZVALUESTRING) VALUES (?, ?, ?, ?)", [("/app/usage", 1, 2, "a"), ("/app/usage", 5, 5, "b"), ("/app/usage", 7, 9, "c"), ("/x", 7, 9, "d"), ("/app/usage", 7, None, "e")])
    db.commit()
    db.close()
    want = [(1299, True), (3000, False)]
    assert rows(sqlite.read_backlight(spark, str(path)), "time_ms", "active") == want
    packed = tmp_path / "powerlog_2024-01-05_x.PLSQL.gz"
    packed.write_bytes(gzip.compress(path.read_bytes()))
    assert rows(sqlite.read_backlight(spark, str(packed)), "time_ms", "active") == want
    assert rows(sqlite.read_usage(spark, str(path)), "first_ms", "bundle_id") == [(978307201000, "a"), (978307207000, "c")]
    assert rows(sqlite.read_usage(spark, str(path), since_ms=978307202000), "bundle_id") == [("c",)]
    assert sqlite.read_backlight(spark, str(tmp_path / "absent.db")).isEmpty()
    assert sqlite.archives(str(tmp_path), "2024-01-07") == [str(packed)] and sqlite.archives(str(tmp_path), "2024-01-08") == []
    assert sqlite.archives(str(tmp_path), "2024-01-07", {"2024-01-05_x"}) == []


def test_config(tmp_path):
    assert config.parse('[office]\nssid = "net"').office_ssid == "net"
    for text in ("", "[office]", '[office]\nssid = ""', "[[["):
        with pytest.raises(config.ConfigError):
            config.parse(text)
    with pytest.raises(config.ConfigError):
        config.load(tmp_path / "c.toml")
    assert (tmp_path / "c.toml").exists()


def test_arguments():
    assert [cli.parse(x) for x in ("2024-01-31", "20240131", "2024-01", "202401")] == [("day", "2024-01-31")] * 2 + [("month", "202401")] * 2
    for bad in ("2024-13", "2024-00", "2024-01-32", "2024-01-00", "1999-01-01", "x"):
        with pytest.raises(ValueError):
            cli.parse(bad)
    assert report.use_colour("auto", True, {}) and not report.use_colour("auto", True, {"NO_COLOR": "1"}) and report.use_colour("always", False, {})


def test_upserts_twice_are_once(spark, tmp_path):
    new = spark.createDataFrame([("x", 1, "a"), ("x", 1, "b"), ("x", 2, "c")], "entity string, time_ms long, v string")
    once = upsert.insert_new(None, new, ["entity", "time_ms"], ["v"])
    twice = upsert.insert_new(once, new, ["entity", "time_ms"], ["v"])
    assert rows(once, *once.columns) == rows(twice, *once.columns) == [("x", 1, "a"), ("x", 2, "c")]
    day = spark.createDataFrame([(date(2024, 1, 5), 1), (date(2024, 1, 6), 2)], "day date, v int")
    upsert.replace_days(day, f"{tmp_path}/t")
    upsert.replace_days(day.where("v = 2").withColumn("v", F.lit(9)), f"{tmp_path}/t")
    assert rows(spark.read.parquet(f"{tmp_path}/t"), "v") == [(1,), (9,)]


def test_coverage_gaps():
    assert upsert.gaps(0, 100, None, None) == [(0, 100)]
    assert upsert.gaps(10, 10 * M, 20, 4 * M) == [(10, 20), (4 * M, 10 * M)] and upsert.gaps(30, 5 * M, 20, 4 * M) == []
    assert upsert.stale(None, 0) and not upsert.stale(0, 5 * M) and upsert.stale(0, 5 * M + 1)


def test_cached_days(spark):
    iv = "entity string, day date, first_ms long, last_ms long, label string"
    d5, d6, d7 = (date(2024, 1, k) for k in (5, 6, 7))
    fresh = spark.createDataFrame([("x", d5, 0, 1, "active"), ("x", d6, 0, 1, "break"), ("x", d7, 0, 1, "active")], iv)
    cached = spark.createDataFrame([("x", d5, 5, 6, "active"), ("x", d6, 5, 6, "active"), ("x", d7, 5, 6, "active")], iv)
    state = spark.createDataFrame([("x", d5, False), ("x", d6, True), ("x", d7, True)], "entity string, day date, provisional boolean")
    now = 1704628800000  # 2024-01-07T12:00Z
    got = rows(upsert.merge_cached(fresh, cached, state, F.lit("2024-01-07").cast("date"), now), "day", "first_ms")
    assert got == [(d5, 5), (d6, 5), (d7, 0)]


def test_reports(spark):
    day = date(2024, 1, 5)
    base = 1704434400000
    iv = spark.createDataFrame([("x", day, base + a * M, base + b * M, c, p) for a, b, c, p in [(0, 5, "break", None), (5, 65, "active", "duet:b"), (65, 95, "break", None), (95, 125, "active", "duet:a"), (125, 130, "break", None), (130, 130, "active", None)]], "entity string, day date, first_ms long, last_ms long, label string, location string")
    out = report.day_report(iv)
    assert rows(out, "label", "total_ms") == [("active", 90 * M)] * 2 + [("break", 90 * M)]
    text = report.render_day(out)
    assert text.splitlines()[0] == "Fri 2024-01-05" and text.splitlines()[1].startswith("06:05–07:05  01h00  active") and text.endswith("Active 01h30")
    dom = spark.createDataFrame([("x", "duet:b")], "entity string, dominant_id string")
    month = report.month_report(iv, dom, F.lit("2024-01-31").cast("date"))
    r = month.first()
    assert (r.first_ms, r.last_ms, r.total_ms, r.locations, len(r.breaks)) == (base + 5 * M, base + 125 * M, 90 * M, ["duet:b", "duet:a"], 1)
    assert "01h30  1 breaks  duet:b duet:a" in report.render_month(month, colour=True)
    other = spark.createDataFrame([("x", ["duet:a", "duet:c"])], "entity string, other_ids array<string>")
    text = report.render_day(report.with_places(out, dom, other)).splitlines()
    assert text[1].endswith("active  ✓") and text[3].endswith("active  ²") and text[-2:] == ["✓  Main office", "²  Other office"]
    text = report.render_month(report.with_places(month, dom, other)).splitlines()
    assert text[0].endswith("1 breaks  ✓²") and text[1:] == ["✓  Main office", "²  Other office"]
    assert report.render_month(report.with_places(month.limit(0), dom, other)) == "No presence."
    assert report.render_day(out.withColumn("total_ms", F.lit(30_000).cast("long"))).endswith("Active 00h01")
    assert "  00h01  1 breaks" in report.render_month(month.withColumn("total_ms", F.lit(30_000).cast("long")))
    others = F.array(*[F.lit(f"o{k}") for k in range(10)])
    got = spark.range(1).select(*[report.symbol(F.lit(x), F.lit("d"), others) for x in ("d", "o0", "o7", "o8", "?")], report.symbol(F.lit("o0"), F.lit("d"), F.array(F.lit("o0")))).first()
    assert tuple(got) == ("✓", "²", "⁹", "10", "²", "*")


def test_running_values_cross_bins(spark):
    """Against a plain fold, with null keys, null times, ties and a key that has most rows."""
    rng = random.Random(5)
    data = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, *range(0, 9_000, 7)]), k, rng.choice([None, rng.randrange(50)])) for k in range(600)]
    df = spark.createDataFrame(data, "entity string, time_ms long, seq long, v long")
    for inclusive in (False, True):
        out = running.running(df, order=("seq",), lasts={"last": F.col("v")}, sums={"sum": F.col("v")}, maxima={"max": F.col("v")}, inclusive=inclusive, size=1000)
        want = []
        for e in {r[0] for r in data}:
            seen = []
            for r in sorted((r for r in data if r[0] == e), key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
                known = [x for x in [*seen, *([r[3]] if inclusive else [])] if x is not None]
                want.append((r[2], known[-1] if known else None, sum(known) if known else None, max(known, default=None)))
                seen.append(r[3])
        assert sorted((r.seq, r.last, r.sum, r.max) for r in out.collect()) == sorted(want)
    following = running.with_next(df.where("time_ms is not null"), "next", order=("seq",), size=1000)
    want = []
    for e in {r[0] for r in data}:
        mine = sorted((r[1], r[2]) for r in data if r[0] == e and r[1] is not None)
        want += [(k, nxt) for (_, k), nxt in zip(mine, [t for t, _ in mine[1:]] + [None])]
    assert sorted((r.seq, r.next) for r in following.collect()) == sorted(want)
    assert running.running(df.limit(0), lasts={"last": F.col("v")}).count() == 0
