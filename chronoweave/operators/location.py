"""Where a device was: places and networks as signals, their co-occurrence, clusters and the dominant place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asof import to_periods
from .graph import ordered_pair
from .intervals import overlap_join

HOME = "home"


def office_subnets(points: DataFrame, office: str) -> DataFrame:
    """(entity, subnet) seen in sessions of the office's ssid."""
    return points.where((F.col("ssid") == office) & (F.col("subnet") != "")).select("entity", "subnet").distinct()


def subnet_periods(wifi: DataFrame, now: int) -> DataFrame:
    """Each address as a period up to the next event; then those without address are dropped."""
    return to_periods(wifi.select("entity", "time_ms", "subnet", "seq"), now).where("subnet <> ''").select("entity", "first_ms", "last_ms", F.concat(F.lit("subnet:"), F.col("subnet")).alias("signal"), "seq")


def anchor_periods(anchors: DataFrame, places: DataFrame, now: int) -> DataFrame:
    """Anchors away from home as periods up to the next such anchor. Their seconds are rounded to milliseconds."""
    away = anchors.join(places, "place").where(F.col("type") != HOME)
    points = away.select("entity", F.round(F.col("anchor_s") * 1000).cast("long").alias("time_ms"), "place", "seq")
    return to_periods(points, now).select("entity", "first_ms", "last_ms", F.concat(F.lit("duet:"), F.col("place")).alias("signal"), "seq")


def of_office(periods: DataFrame, office: DataFrame) -> DataFrame:
    return periods.join(office.select("entity", F.concat(F.lit("subnet:"), F.col("subnet")).alias("signal")), ["entity", "signal"], "left_semi").select(*periods.columns)


def co_occurrences(anchors: DataFrame, subnets: DataFrame, since: int = 0, shortest_s: float = 0.0) -> DataFrame:
    """(entity, signal_a, signal_b, total_seconds, last_seen): the seconds that a place and a network were both on.

    Of anchors, only what lies after ``since`` counts: that is the mark up to which an earlier run has summed. Anchors
    without length add no seconds, but are seen.
    """
    left = anchors.select("entity", F.greatest("first_ms", F.lit(since)).alias("l_first"), F.col("last_ms").alias("l_last"), F.col("signal").alias("l_signal")).where((F.col("l_last") >= F.col("l_first")) & (F.col("l_last") > since))
    right = subnets.select("entity", F.col("first_ms").alias("r_first"), F.col("last_ms").alias("r_last"), F.col("signal").alias("r_signal"))
    met = overlap_join(left, right)
    end = F.least("l_last", "r_last")
    seconds = (end - F.greatest("l_first", "r_first")) / 1000.0
    a, b = ordered_pair(F.col("l_signal"), F.col("r_signal"))
    return met.where(seconds >= shortest_s).groupBy("entity", a.alias("signal_a"), b.alias("signal_b")).agg(F.sum(seconds).alias("total_seconds"), F.max(end).alias("last_seen"))


def all_periods(anchors: DataFrame, subnets: DataFrame, clusters: DataFrame) -> DataFrame:
    """Both kinds of periods with the cluster that stands for their signal: (entity, first_ms, last_ms, place, seq), anchors first at one moment."""
    both = anchors.select("entity", "first_ms", "last_ms", "signal", (F.col("seq") * 2).alias("seq")).unionByName(subnets.select("entity", "first_ms", "last_ms", "signal", (F.col("seq") * 2 + 1).alias("seq")))
    return both.join(clusters, ["entity", "signal"], "left").select("entity", "first_ms", "last_ms", F.coalesce("cluster", "signal").alias("place"), "seq")


def others(periods: DataFrame, dominant: DataFrame) -> DataFrame:
    """(entity, other_ids): place clusters seen besides the dominant one, sorted."""
    seen = periods.where(F.col("place").startswith("duet:")).select("entity", "place").distinct()
    rest = seen.join(dominant.select("entity", F.col("dominant_id").alias("place")), ["entity", "place"], "left_anti")
    return rest.groupBy("entity").agg(F.sort_array(F.collect_set("place")).alias("other_ids"))

