"""Interval joins by time bins, and interval rewriting within a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import HOUR, MIN_SESSION, PROXIMITY

BIN = 6 * HOUR


def _bins(first: Column, last: Column, size: int) -> Column:
    low, high = F.floor(first / size).cast("long"), F.floor(last / size).cast("long")
    return F.sequence(low, F.greatest(low, high))


def overlap_join(left: DataFrame, right: DataFrame, *, by: tuple[str, ...] = ("entity",), size: int = BIN, touch_right_end: bool = False) -> DataFrame:
    """Rows of intervals ``left`` (l_first, l_last, ...) and ``right`` (r_first, r_last, ...) that overlap.

    Overlap is r_first < l_last and r_last > l_first; with ``touch_right_end`` also r_first = l_last. Both sides
    are dealt to bins of ``size`` by an equi-join; a pair is kept in the bin where the later one starts, so each
    comes once. An entity's rows spread over its bins, so no entity is one task.
    """
    a = left.withColumn("__bin", F.explode(_bins(F.col("l_first"), F.col("l_last"), size)))
    b = right.withColumn("__bin", F.explode(_bins(F.col("r_first"), F.col("r_last"), size)))
    meets = (F.col("r_first") <= F.col("l_last")) if touch_right_end else (F.col("r_first") < F.col("l_last"))
    once = F.col("__bin") == F.floor(F.greatest("l_first", "r_first") / size)
    return a.join(b, [*by, "__bin"]).where(meets & (F.col("r_last") > F.col("l_first")) & once).drop("__bin")


def clip(periods: DataFrame, windows: DataFrame, moments: bool = False) -> DataFrame:
    """The parts of ``periods`` that lie in ``windows``: (entity, first_ms, last_ms, and the other columns of periods).

    With ``moments``, periods without length that lie within a window count, too.
    """
    rest = [c for c in periods.columns if c not in ("entity", "first_ms", "last_ms")]
    left = periods.withColumnsRenamed({"first_ms": "l_first", "last_ms": "l_last"})
    right = windows.select("entity", F.col("first_ms").alias("r_first"), F.col("last_ms").alias("r_last"))
    cut = overlap_join(left, right).select("entity", F.greatest("l_first", "r_first").alias("first_ms"), F.least("l_last", "r_last").alias("last_ms"), *rest)
    return cut if moments else cut.where("last_ms > first_ms")


def in_session(points: DataFrame, sessions: DataFrame) -> DataFrame:
    """Points with the ssid of the latest session begun by then, if it holds: to its end, but sixty seconds at least. No session: no row."""
    from .asof import asof

    found = asof(points, sessions, event_time="first_ms", order=("seq",), name="s")
    held = F.col("time_ms") <= F.greatest(F.col("s.last_ms"), F.col("s.first_ms") + MIN_SESSION)
    return found.where("s is not null").where(held).select("*", F.col("s.first_ms").alias("session_first"), F.col("s.last_ms").alias("session_last"), F.col("s.ssid").alias("ssid")).drop("s")


def session_pairs(points: DataFrame) -> DataFrame:
    """Unordered pairs of different subnets that one session saw: (entity, subnet_a, subnet_b), distinct.

    Each session's subnets are made distinct before they pair.
    """
    seen = points.select("entity", "session_first", "session_last", "ssid", "subnet").distinct()
    a, b = seen.withColumnRenamed("subnet", "subnet_a"), seen.withColumnRenamed("subnet", "subnet_b")
    return a.join(b, ["entity", "session_first", "session_last", "ssid"]).where("subnet_a < subnet_b").select("entity", "subnet_a", "subnet_b").distinct()


def proximity_pairs(points: DataFrame, reach: int = PROXIMITY) -> DataFrame:
    """Unordered pairs of different subnets that one ssid saw within ``reach``: (entity, subnet_a, subnet_b), distinct.

    A point meets the last point of every other subnet at or before it, not all points in reach: for each ssid
    the moments are binned by the reach and only a subnet's first and last moment of a bin are kept, which
    decides whether bins of two subnets come near each other.
    """
    binned = points.select("entity", "ssid", "subnet", "time_ms", F.floor(F.col("time_ms") / reach).cast("long").alias("bin"))
    ends = binned.groupBy("entity", "ssid", "subnet", "bin").agg(F.min("time_ms").alias("lo"), F.max("time_ms").alias("hi"))
    a = ends.select("entity", "ssid", F.col("subnet").alias("a"), "bin", F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    b = ends.select("entity", "ssid", F.col("subnet").alias("b"), F.explode(F.array(F.col("bin"), F.col("bin") - 1)).alias("bin"), F.col("bin").alias("b_bin"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    # Within a bin all moments are in reach; of the next bin, the earliest is nearest to the latest of this one.
    near = a.join(b, ["entity", "ssid", "bin"]).where((F.col("a") != F.col("b")) & ((F.col("b_bin") == F.col("bin")) | (F.col("b_lo") - F.col("a_hi") <= reach)))
    return near.select("entity", F.least("a", "b").alias("subnet_a"), F.greatest("a", "b").alias("subnet_b")).distinct()


def locate(intervals: DataFrame, blocks: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """intervals with ``location``: of the earliest block with first <= its end and last > its start, else of the earliest such fallback.

    Transit rows get none. Blocks have (entity, first_ms, last_ms, place, seq); equal starts are settled by seq.
    """
    keys = ["entity", "l_first", "l_last", "label"]
    named = intervals.drop("location").withColumnsRenamed({"first_ms": "l_first", "last_ms": "l_last"})

    def earliest(rows: DataFrame, name: str) -> DataFrame:
        right = rows.select("entity", F.col("first_ms").alias("r_first"), F.col("last_ms").alias("r_last"), "place", "seq")
        met = overlap_join(named.select(*keys).where("label <> 'transit'").distinct(), right, touch_right_end=True)
        return met.groupBy(*keys).agg(F.min_by("place", F.struct("r_first", "seq")).alias(name))

    out = named.join(earliest(blocks, "__block"), keys, "left")
    location = F.col("__block")
    if fallback is not None:
        out = out.join(earliest(fallback, "__fallback"), keys, "left")
        location = F.coalesce("__block", "__fallback")
    return out.withColumn("location", location).drop("__block", "__fallback").withColumnsRenamed({"l_first": "first_ms", "l_last": "last_ms"})


def merge_same_label(intervals: DataFrame) -> DataFrame:
    """Neighbours of a day that touch or overlap and share a label become one; empty ones are dropped first."""
    w = Window.partitionBy("entity", "day").orderBy("first_ms", "last_ms")
    real = intervals.where("last_ms > first_ms")
    starts = (F.lag("label").over(w) != F.col("label")) | (F.lag("last_ms").over(w) < F.col("first_ms"))
    parted = real.withColumn("__s", F.coalesce(starts.cast("int"), F.lit(1))).withColumn("__i", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return parted.groupBy("entity", "day", "__i").agg(F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), F.first("label").alias("label")).drop("__i")


def smooth(intervals: DataFrame) -> DataFrame:
    """(entity, day, first_ms, last_ms, label, location) with inner transits of a day taken for active rows, and neighbours of one label joined, gaps or not.

    A day with up to two transits keeps them. Among joined active rows a location is kept from the first that has
    one; a newcomer's other location wins if it alone lasts longer than all that was joined before it.
    """
    w = Window.partitionBy("entity", "day").orderBy("first_ms", "last_ms")
    day = Window.partitionBy("entity", "day")
    transit = (F.col("label") == "transit").cast("int")
    counted = intervals.withColumn("__n", F.sum(transit).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__all", F.sum(transit).over(day))
    inner = (F.col("label") == "transit") & (F.col("__all") > 2) & (F.col("__n") > 1) & (F.col("__n") < F.col("__all"))
    relabelled = counted.withColumn("label", F.when(inner, "active").otherwise(F.col("label")))
    parted = relabelled.withColumn("__c", F.coalesce((F.lag("label").over(w) != F.col("label")).cast("int"), F.lit(1))).withColumn("__i", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = parted.groupBy("entity", "day", "__i").agg(F.first("label").alias("label"), F.array_sort(F.collect_list(F.struct("first_ms", "last_ms", "location"))).alias("rows"))
    head = F.element_at("rows", 1)
    zero = F.struct(head["first_ms"].alias("first_ms"), head["last_ms"].alias("last_ms"), head["location"].alias("location"))

    def step(acc: Column, x: Column) -> Column:
        longer = x["last_ms"] - x["first_ms"] > acc["last_ms"] - acc["first_ms"]
        wins = (F.col("label") == "active") & x["location"].isNotNull() & (acc["location"].isNull() | (acc["location"] != x["location"]) & longer)
        return F.struct(acc["first_ms"].alias("first_ms"), x["last_ms"].alias("last_ms"), F.when(wins, x["location"]).otherwise(acc["location"]).alias("location"))

    folded = rows.withColumn("f", F.aggregate(F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0))), zero, step))
    return folded.select("entity", "day", F.col("f.first_ms").alias("first_ms"), F.col("f.last_ms").alias("last_ms"), "label", F.col("f.location").alias("location"))


def trim_to_active(intervals: DataFrame) -> DataFrame:
    """Rows of a day from its first to its last active one."""
    day = Window.partitionBy("entity", "day")
    w = day.orderBy("first_ms", "last_ms")
    placed = intervals.where("last_ms > first_ms").withColumn("__r", F.row_number().over(w))
    active = F.when(F.col("label") == "active", F.col("__r"))
    bounded = placed.withColumn("__lo", F.min(active).over(day)).withColumn("__hi", F.max(active).over(day))
    return bounded.where("__r between __lo and __hi").drop("__r", "__lo", "__hi")
