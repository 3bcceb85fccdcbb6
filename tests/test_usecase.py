"""The whole way: cached days are reused, given blocks go first, and looking back can be left out."""

import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import timeline
from chronoweave.plans import queries, usecase
from chronoweave.plans import streams as st
from chronoweave.tables import saved

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_days(spark):
    s = queries.all_streams(spark, SF)
    days = saved(timeline.days_between([st.events(spark, SF)]).where("day between date '2024-01-05' and date '2024-01-07' and entity = '0'"), "days")
    rows, _ = usecase.intervals_for_days(s, days, st.NOW, st.OFFICE, st.LOCK_APP)
    fresh = {(r.day, r.first_ms, r.last_ms, r.label): r.location for r in rows.collect()}
    assert {k[0] for k in fresh} <= {date(2024, 1, k) for k in (5, 6, 7)} and any(k[3] == "active" for k in fresh)

    start = 1704434400000
    cached = spark.createDataFrame([("0", date(2024, 1, 5), start + 1, start + 9, "active"), ("0", date(2024, 1, 6), 1, 2, "active")], "entity string, day date, first_ms long, last_ms long, label string")
    state = spark.createDataFrame([("0", date(2024, 1, 5), False), ("0", date(2024, 1, 6), True)], "entity string, day date, provisional boolean")
    blocks = spark.createDataFrame([("0", start, start + 10, "room", 1)], "entity string, first_ms long, last_ms long, place string, seq long")
    rows, _ = usecase.intervals_for_days(s, days, st.NOW, st.OFFICE, st.LOCK_APP, cached=cached, cached_days=state, blocks=blocks)
    got = {(r.day, r.first_ms, r.last_ms, r.label): r.location for r in rows.collect()}
    assert got[date(2024, 1, 5), start + 1, start + 9, "active"] == "room"
    assert {k for k in got if k[0] != date(2024, 1, 5)} == {k for k in fresh if k[0] != date(2024, 1, 5)}


def test_strict_lookback(spark):
    """Unlocked and without input history on the first day."""
    e = lambda s, r: spark.createDataFrame(r, s)
    m, start = 60_000, 1704434400000
    none = {
        "screen_on": "entity string, time_ms long, screen_on_secs long",
        "anchors": "entity string, anchor_s double, place string, seq long",
        "places": "place string, type string",
        "focus_points": "entity string, time_ms long, bundle_id string, src_ord int, seq long",
        "focus_periods": "entity string, first_ms long, last_ms long, bundle_id string, seq long",
        "wifi": "entity string, time_ms long, ip string, subnet string, seq long",
        "ssid_sessions": "entity string, first_ms long, last_ms long, ssid string, seq long",
    }
    s = usecase.Streams(
        backlight=e("entity string, time_ms long, active boolean, seq long", [("x", start + m, True, 1)]),
        screen=e("entity string, time_ms long, kind string, seq long", [("x", start - 40 * m, "lock", 2)]),
        inputs=e("entity string, time_ms long, kind string, seq long", [("x", start + k * m, "kbd", 10 + k) for k in (5, 15, 25)]),
        **{k: e(v, []) for k, v in none.items()},
    )
    days = e("entity string, day date", [("x", date(2024, 1, 5))])
    run = lambda strict: [((r.first_ms - start) // m, (r.last_ms - start) // m, r.label) for r in usecase.intervals_for_days(s, days, start + 999 * m, "net", "lock", strict_lookback=strict)[0].where(F.col("day") == "2024-01-05").collect()]
    assert run(True) == [(5, 25, "active")] and run(False) == []
