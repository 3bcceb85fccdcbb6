"""The whole way from streams to located intervals of the days asked for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CLUSTER_THRESHOLD
from ..functions.times import day_start, next_day
from ..operators import graph, intervals, location, sessions, timeline, upsert
from ..tables import saved


@dataclass(frozen=True)
class Streams:
    """One DataFrame for each stream, with the columns that the operators name."""

    backlight: DataFrame
    screen: DataFrame
    inputs: DataFrame
    focus_points: DataFrame
    focus_periods: DataFrame
    wifi: DataFrame
    ssid_sessions: DataFrame
    screen_on: DataFrame
    anchors: DataFrame
    places: DataFrame


@dataclass(frozen=True)
class Places:
    """Located periods, the dominant place and the other places of each entity."""

    periods: DataFrame
    dominant: DataFrame
    others: DataFrame


def network_groups(s: Streams) -> DataFrame:
    """Subnets with the group of those that one network showed together, or within ten minutes."""
    seen = saved(intervals.in_session(s.wifi, s.ssid_sessions).where("subnet <> ''").select("entity", "time_ms", "subnet", "ssid", "session_first", "session_last"), "seen")
    pairs = intervals.session_pairs(seen).unionByName(intervals.proximity_pairs(seen)).distinct()
    return graph.subnet_groups(pairs, s.wifi)


def resolve_places(s: Streams, now: int, office: str, threshold: float = CLUSTER_THRESHOLD, moments: bool = False) -> Places:
    """Places of the periods spent in the office's subnets; with ``moments``, anchors without length count, too."""
    subnets = location.office_subnets(intervals.in_session(s.wifi, s.ssid_sessions), office)
    nets = saved(location.of_office(location.subnet_periods(s.wifi, now), subnets), "office")
    at = saved(intervals.clip(location.anchor_periods(s.anchors, s.places, now), nets, moments), "anchors")
    co = saved(location.co_occurrences(at, nets), "co")
    found = saved(graph.clusters(co, now, threshold), "clusters")
    main = graph.dominant(co, found, now)
    periods = location.all_periods(at, nets, found)
    return Places(periods, main, location.others(periods, main))


def intervals_for_days(
    s: Streams, days: DataFrame, now: int, office: str, lock_app: str, today: str | None = None, cached: DataFrame | None = None, cached_days: DataFrame | None = None, blocks: DataFrame | None = None, strict_lookback: bool = False, moments: bool = False
) -> tuple[DataFrame, Places]:
    """(entity, day, first_ms, last_ms, label, location) of (entity, day) rows, and the places.

    Days whose cached rows are final and reusable aren't computed. ``blocks`` are located periods that go before
    those resolved here. With ``strict_lookback``, locks and inputs before the first day's start and after the
    last day's end are as if not known. ``moments`` is that of ``resolve_places``.
    """
    today_ = F.lit(today).cast("date") if today else F.to_date(F.timestamp_millis(F.lit(now)))
    wanted = days
    if cached_days is not None:
        ready = cached_days.where(~F.col("provisional") & upsert.reusable(F.col("day"), today_, now))
        wanted = days.join(ready, ["entity", "day"], "left_anti")
    screen, inputs = s.screen, s.inputs
    if strict_lookback:
        span = days.agg(F.min(day_start(F.col("day"))), F.max(day_start(next_day(F.col("day"))))).first()
        within = F.col("time_ms").between(*[F.lit(x) for x in span])
        screen, inputs = screen.where(within), inputs.where(within)
    mine = lambda df: df.where(F.col("bundle_id") != lock_app)
    focus = timeline.merge_focus(mine(s.focus_periods), mine(s.focus_points))
    wifi = timeline.with_network(s.wifi, network_groups(s))
    main = saved(timeline.timeline(wanted, s.backlight, screen, inputs, focus, wifi, now, lock_app), "timeline")
    rows, lit = main, timeline.lit_days(s.backlight)
    dark = saved(timeline.days_without(main, wanted, lit), "dark")
    if not dark.isEmpty():
        raw = sessions.raw_events(s.backlight, screen, inputs, sessions.bucket_events(s.screen_on, inputs))
        spare = sessions.with_breaks(sessions.clip_to_days(sessions.merge_islands(sessions.sessions(raw, now)), inputs, now))
        rows = saved(timeline.fallback(main, spare.join(dark, ["entity", "day"], "left_semi"), lit), "rows")
    if cached is not None and cached_days is not None:
        rows = upsert.merge_cached(rows, cached.join(days, ["entity", "day"], "left_semi"), cached_days, today_, now)
    places = resolve_places(s, now, office, moments=moments)
    located = intervals.locate(rows, blocks, places.periods) if blocks is not None else intervals.locate(rows, places.periods)
    return located, places
