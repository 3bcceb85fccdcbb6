"""The day's state machine, rule by rule, and against another formulation."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from chronoweave.constants import MINUTE, MIN_PERIOD, SOFT_CLOSE
from chronoweave.operators import timeline as tl

M = MINUTE
D = date(2024, 1, 5)
START = 1704434400000  # 2024-01-05T06:00Z


def run(*events, lit=False, locked=False, network=None, last=None):
    day = tl.Day(0, lit, locked, network, last)
    for t, source, kind in events:
        day.take(int(t * M), source, kind)
    return [(a / M, b / M, c) for a, b, c in day.rows()]


B, S, I, Fo, W = range(5)


def test_soft_close():
    assert run((0, B, "on"), (0, I, "kbd"), (5, I, "kbd"), (40, I, "kbd")) == [(0, 5, "active"), (5, 40, "break")]


def test_short_break_is_taken_back():
    assert run((0, B, "on"), (0, I, "kbd"), (20, S, "lock"), (22, S, "unlock"), (25, I, "kbd"), (30, I, "kbd")) == [(0, 30, "active")]


def test_long_break_stays():
    assert run((0, B, "on"), (0, I, "kbd"), (20, S, "lock"), (31, S, "unlock"), (31, I, "kbd"), (40, I, "kbd")) == [(0, 20, "active"), (20, 31, "break"), (31, 40, "active")]


def test_transit_splits_at_the_event_before():
    assert run((0, B, "on"), (0, I, "kbd"), (15, I, "kbd"), (25, W, "b"), (60, I, "kbd"), (61, I, "kbd"), network="a") == [(0, 15, "active"), (15, 25, "transit"), (25, 60, "break"), (60, 61, "active")]


def test_loss_of_the_network_is_no_transit():
    assert run((0, B, "on"), (0, I, "kbd"), (5, W, None), (15, W, "b"), (20, I, "kbd"), network="a") == [(0, 20, "active")]


def test_focus_wakes_in_the_dark():
    assert run((0, S, "lock"), (12, Fo, None), (15, Fo, None)) == [(0, 12, "break"), (12, 15, "active")]


def test_input_in_the_dark_does_not():
    assert run((0, I, "kbd"), (5, I, "kbd")) == []


def test_random_days_against_segments():
    """The same rules told with segments that have ends of their own."""

    def plain(events, lit, locked, network, last):
        segs, before = [], 0
        for t, source, kind in events:
            if source == B:
                lit = kind == "on"
            if source == S:
                locked = kind == "lock"
            if source in (B, S) and kind in ("off", "lock"):
                if segs:
                    segs[-1][1] = t
                segs.append([t, t, "break"])
            if source in (I, Fo):
                locked = locked and source != Fo
                if segs and segs[-1][2] == "active" and last is not None and t - last >= SOFT_CLOSE:
                    segs[-1][1] = last
                    segs.append([last, t, "break"])
                if (source == Fo or lit and not locked) and not (segs and segs[-1][2] == "active"):
                    keep = max([1, *(k + 1 for k, s in enumerate(segs) if s[2] == "active" or t - s[0] >= MIN_PERIOD)]) if segs else 0
                    if keep < len(segs):
                        segs = segs[:keep]
                        segs[-1][1] = t
                    if not segs:
                        segs.append([t, t, "active"])
                    elif segs[-1][2] != "active":
                        segs[-1][1] = t
                        if t - segs[-1][0] < MIN_PERIOD:
                            segs[-1][2] = "active"
                        else:
                            segs.append([t, t, "active"])
                last = t
            if source == W:
                if kind and network and kind != network:
                    if segs and segs[-1][0] < before < t:
                        segs[-1][1] = before
                        if before - segs[-1][0] < MIN_PERIOD and len(segs) > 1:
                            segs.pop()
                            segs[-1][1] = before
                        segs.append([before, t, "transit"])
                    elif segs:
                        segs[-1][1:] = [t, "transit"]
                        if len(segs) > 1 and segs[-1][0] - segs[-2][0] < MIN_PERIOD:
                            segs[-1][0] = segs.pop(-2)[0]
                    segs.append([t, t, "break"])
                network = kind
            before = t
        if segs and segs[-1][2] == "active":
            segs[-1][1] = max(segs[-1][1], before, segs[-1][0])
        while segs and segs[-1][2] == "break":
            segs.pop()
        out = []
        for a, b, c in segs:
            if b > a and out and out[-1][2] == c and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            elif b > a:
                out.append([a, b, c])
        return [tuple(x) for x in out]

    rng = random.Random(4)
    kinds = {B: ["on", "off"], S: ["lock", "unlock"], I: ["kbd"], Fo: [None], W: ["a", "b", None]}
    for _ in range(4000):
        events, t = [], 0
        for _ in range(rng.randint(0, 14)):
            t += rng.choice([0, 1, 3, 8, 9, 10, 12, 30, 31]) * M
            s = rng.randrange(5)
            events.append((t, s, rng.choice(kinds[s])))
        start = rng.random() < 0.5, rng.random() < 0.3, rng.choice([None, "a"]), rng.choice([None, 0])
        day = tl.Day(0, *start)
        for e in events:
            day.take(*e)
        assert day.rows() == plain(events, *start)


def test_folded_days_equal_the_machine(spark):
    rng = random.Random(7)
    kinds = {B: ["on", "off"], S: ["lock", "unlock"], I: ["kbd", "app_launch"], Fo: [None], W: ["a", "b", None]}
    rows, want = [], {}
    for k in range(3000):
        events, t = [], START
        for n in range(rng.randint(0, 40)):
            t += rng.choice([0, 1, 3, 8, 9, 10, 12, 30, 31]) * M
            s = rng.randrange(5)
            events.append((t, s, n, rng.choice(kinds[s])))
        state = rng.random() < 0.5, rng.random() < 0.3, rng.choice([None, "a"]), rng.choice([None, START - M, START - 40 * M])
        day = tl.Day(START, *state)
        for t, s, _, kind in events:
            day.take(t, s, kind)
        want[str(k)] = day.rows()
        rows.append((str(k), D, START, *state, events))
    days = frame(spark, rows, "entity string, day date, start_ms long, lit boolean, locked boolean, network string, last_input long, events array<struct<t:long,src_ord:int,seq:long,kind:string>>")
    got = {k: [] for k in want}
    for r in tl.fold_days(days.repartition(4)).collect():
        got[r.entity].append((r.first_ms, r.last_ms, r.label))
    assert got == want


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_edge_belongs_to_both_days(spark):
    e = lambda s, r: frame(spark, r, s)
    days = e("entity string, day date", [("x", date(2024, 1, 4)), ("x", D)])
    empty = e("entity string, time_ms long, kind string, seq long", [])
    lit = e("entity string, time_ms long, active boolean, seq long", [("x", START - 20 * M, True, 1)])
    keys = e("entity string, time_ms long, kind string, seq long", [("x", START - 15 * M, "kbd", 2), ("x", START, "kbd", 3), ("x", START + 20 * M, "kbd", 4)])
    focus = e("entity string, time_ms long, bundle_id string, seq long", [])
    wifi = e("entity string, time_ms long, network string, seq long", [])
    out = tl.timeline(days, lit, empty, keys, focus, wifi, START + 999 * M, "lock").orderBy("first_ms").collect()
    assert [((r.first_ms - START) // M, (r.last_ms - START) // M, r.label) for r in out] == [(-15, 0, "active"), (0, 20, "active")]


def test_focus_merge(spark):
    periods = frame(spark, [("x", 1000, 3000, "p", 1)], "entity string, first_ms long, last_ms long, bundle_id string, seq long")
    points = frame(spark, [("x", t, "q", 1, k) for k, t in enumerate((500, 1000, 1500, 4000))], "entity string, time_ms long, bundle_id string, src_ord int, seq long")
    got = [(r.time_ms, r.bundle_id) for r in tl.merge_focus(periods, points).orderBy("time_ms").collect()]
    assert got == [(500, "q"), (1000, "p"), (4000, "q")]


def test_streaming_days_equal_batch_days(spark, tmp_path):
    from chronoweave.plans import queries
    from chronoweave.plans import streams as st
    from chronoweave.streaming import live

    d = "/root/testdata/sf0.001"
    if not __import__("os").path.isdir(d):
        pytest.skip("needs the driver's tables")
    focus = queries._focus(spark, d).where(F.col("bundle_id") != st.LOCK_APP)
    parts = [
        st.backlight(spark, d).select("entity", "time_ms", F.lit(0).alias("src_ord"), "seq", F.when(F.col("active"), "on").otherwise("off").alias("kind")),
        st.screen(spark, d).select("entity", "time_ms", F.lit(1).alias("src_ord"), "seq", "kind"),
        st.inputs(spark, d).select("entity", "time_ms", F.lit(2).alias("src_ord"), "seq", "kind"),
        focus.select("entity", "time_ms", F.lit(3).alias("src_ord"), "seq", F.lit(None).cast("string").alias("kind")),
        queries._wifi(spark, d).select("entity", "time_ms", F.lit(4).alias("src_ord"), "seq", F.col("network").alias("kind")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.withColumn("ts", F.timestamp_millis("time_ms")).select("entity", "ts", "time_ms", "src_ord", "seq", "kind")
    every.where("time_ms < 1705276800000").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    every.where("time_ms >= 1705276800000").coalesce(1).write.parquet(f"{tmp_path}/in/b")
    stream = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = live.day_timelines(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = {tuple(r) for r in queries._timeline(spark, d).select("entity", "day", "first_ms", "last_ms", "label").collect()}
    assert got and got <= batch
    late = max(r[1] for r in got)
    assert {r for r in batch if r[1] < late} <= got
