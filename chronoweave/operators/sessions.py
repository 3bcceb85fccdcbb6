"""Sessions from open, close and keyboard events, and from hourly totals, with running values and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BUCKET_SLACK, HOUR, MERGE_GAP, MIN_PERIOD, SOFT_CLOSE
from ..functions.times import day_start, effective_day, next_day
from ..tables import saved
from .running import running, with_next


def raw_events(backlight: DataFrame, screen: DataFrame, inputs: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """The streams as hard_open, hard_close and kbd events; at one moment backlight, totals, locks, keys in turn."""
    open_close = lambda c: F.when(c, "hard_open").otherwise("hard_close")
    out = backlight.select("entity", "time_ms", F.lit(0).alias("src_ord"), "seq", open_close(F.col("active")).alias("kind"))
    if extra is not None:
        out = out.unionByName(extra.select("entity", "time_ms", F.lit(1).alias("src_ord"), "seq", "kind"))
    out = out.unionByName(screen.select("entity", "time_ms", F.lit(2).alias("src_ord"), "seq", open_close(F.col("kind") == "unlock").alias("kind")))
    return out.unionByName(inputs.where("kind = 'kbd'").select("entity", "time_ms", F.lit(3).alias("src_ord"), "seq", "kind"))


def sessions(events: DataFrame, now: int) -> DataFrame:
    """(entity, first_ms, last_ms) of each session, short and inverted ones included.

    A session begins at a hard open, or at a key after a pause; it ends at a hard close, or at the last key
    before a pause of thirty minutes, when the next key begins another.
    """
    order = ("src_ord", "seq")
    t, kbd = F.col("time_ms"), F.col("kind") == "kbd"
    used = events.select("entity", "time_ms", *order, "kind")
    # Each step needs the one before in each bin and across bins: written once rather than worked out twice.
    marked = saved(running(used, order=order, lasts={"last_key": F.when(kbd, t), "last_close": F.when(F.col("kind") == "hard_close", t)}), "marked")
    paused = F.coalesce(t - F.col("last_key") >= SOFT_CLOSE, F.lit(True))
    wakes = kbd & paused & F.coalesce(t > F.col("last_close"), F.lit(True))
    state = F.when(F.col("kind") == "hard_open", 1).when(F.col("kind") == "hard_close", 0).when(wakes, 1)
    known = running(marked.withColumn("state", state), order=order, lasts={"was": F.col("state")})
    was_open = F.coalesce(F.col("was") == 1, F.lit(False))
    split = kbd & was_open & F.coalesce(t - F.col("last_key") >= SOFT_CLOSE, F.lit(False))
    begins = split | ~was_open & F.coalesce(F.col("state") == 1, F.lit(False))
    steps = saved(known.select("entity", "time_ms", *order, "kind", "last_key", was_open.alias("was_open"), split.alias("split"), begins.alias("begins")), "steps")
    parted = running(steps, order=order, sums={"session": F.col("begins").cast("long")}, inclusive=True)
    # A key that splits also tells the session before it where that one ended.
    rows = parted.withColumn("back", F.explode(F.when(F.col("split"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    own = F.col("back") == 0
    per = (
        rows.withColumn("session", F.col("session") - F.col("back"))
        .where("session > 0")
        .groupBy("entity", "session")
        .agg(
            F.min(F.when(own & F.col("begins"), t)).alias("first_ms"),
            F.min(F.when(own & (F.col("kind") == "hard_close") & F.col("was_open"), t)).alias("closed"),
            F.max(own & (F.col("kind") == "hard_open")).alias("hard"),
            F.max(F.when(~own, F.col("last_key"))).alias("next_split"),
            F.max(F.when(own & kbd, t)).alias("key"),
        )
    )
    open_end = F.when(~F.col("hard") & (F.col("key") > F.col("first_ms")), F.col("key")).otherwise(F.lit(now))
    return per.select("entity", "first_ms", F.coalesce("closed", "next_split", open_end).alias("last_ms"))


def merge_islands(periods: DataFrame, gap: int = MERGE_GAP, shortest: int = MIN_PERIOD) -> DataFrame:
    """Periods of at least ``shortest``, joined where no more than ``gap`` parts them."""
    long = periods.where(F.col("last_ms") - F.col("first_ms") >= shortest).select("entity", "first_ms", "last_ms")
    reached = saved(running(long, time="first_ms", order=("last_ms",), maxima={"reach": F.col("last_ms")}), "reach")
    parts = F.coalesce((F.col("first_ms") - F.col("reach") > gap).cast("long"), F.lit(0))
    numbered = running(reached, time="first_ms", order=("last_ms",), sums={"island": parts}, inclusive=True)
    return numbered.groupBy("entity", "island").agg(F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms")).drop("island")


def bucket_events(buckets: DataFrame, keys: DataFrame) -> DataFrame:
    """Hourly screen-on totals as hard_open and hard_close events, sharpened by the keys of the hour.

    A run of hours with screen time opens in its first and closes in its last hour, unless that hour is full.
    """
    on = F.col("screen_on_secs")
    hours = with_next(buckets, "next", value=F.struct("time_ms", "screen_on_secs"))
    ends = (on < 3600) & (F.col("next").isNull() | (F.col("next.screen_on_secs") == 0) | (F.col("next.time_ms") > F.col("time_ms") + HOUR + BUCKET_SLACK))
    marked = running(hours.withColumn("ends", ends).drop("next"), lasts={"was": F.struct("screen_on_secs", "ends")})
    runs_on = F.coalesce((F.col("was.screen_on_secs") > 0) & ~F.col("was.ends"), F.lit(False))
    marked = marked.withColumn("opens", (on > 0) & ~runs_on).withColumn("closes", (on > 0) & F.col("ends")).where("opens or closes").drop("was", "ends")
    # Keys of [t, t + 1 h): those of the hour that t begins, or of the two hours it lies in.
    hour = F.floor(F.col("time_ms") / HOUR)
    wide = marked.select("*", F.explode(F.array_distinct(F.array(hour, F.floor((F.col("time_ms") + HOUR - 1) / HOUR)))).alias("__h"))
    k = keys.where("kind = 'kbd'").select("entity", hour.alias("__h"), F.col("time_ms").alias("key_ms"))
    near = wide.join(k, ["entity", "__h"], "left").withColumn("key_ms", F.when((F.col("key_ms") >= F.col("time_ms")) & (F.col("key_ms") < F.col("time_ms") + HOUR), F.col("key_ms")))
    per = near.groupBy("entity", "time_ms", "screen_on_secs", "opens", "closes").agg(F.min("key_ms").alias("first_key"), F.max("key_ms").alias("last_key"))
    opened = F.least(F.col("time_ms") + HOUR - on * 1000, F.col("first_key"))
    closed = F.greatest(F.col("time_ms") + on * 1000, F.col("last_key"))
    pairs = F.array(F.struct(F.lit("hard_open").alias("kind"), opened.alias("at"), F.col("opens").alias("real"), F.lit(0).alias("o")), F.struct(F.lit("hard_close").alias("kind"), closed.alias("at"), F.col("closes").alias("real"), F.lit(1).alias("o")))
    return per.select("entity", (F.col("time_ms") * 2).alias("seq"), F.explode(pairs).alias("e")).where("e.real").select("entity", F.col("e.at").alias("time_ms"), (F.col("seq") + F.col("e.o")).alias("seq"), F.col("e.kind").alias("kind"))


def clip_to_days(periods: DataFrame, keys: DataFrame, now: int) -> DataFrame:
    """Periods cut at 06:00 into (entity, day, first_ms, last_ms).

    A part that began before its day starts at the first key of [06:00, end), and is dropped without one.
    """
    days = periods.select("*", F.explode(F.sequence(effective_day(F.col("first_ms")), F.greatest(effective_day(F.col("first_ms")), effective_day(F.col("last_ms"))))).alias("day"))
    cut = days.withColumn("day_ms", day_start(F.col("day"))).withColumn("end_ms", F.least("last_ms", F.least(day_start(next_day(F.col("day"))), F.lit(now)))).where("end_ms > day_ms")
    # The day's first key is the first of [06:00, end), if it comes before the end.
    woken = keys.where("kind = 'kbd'").groupBy("entity", effective_day(F.col("time_ms")).alias("day")).agg(F.min("time_ms").alias("key_ms"))
    start = F.when(F.col("first_ms") >= F.col("day_ms"), F.col("first_ms")).otherwise(F.col("key_ms"))
    return cut.join(woken, ["entity", "day"], "left").withColumn("start_ms", start).where("end_ms > start_ms").select("entity", "day", F.col("start_ms").alias("first_ms"), F.col("end_ms").alias("last_ms"))


def with_breaks(periods: DataFrame) -> DataFrame:
    """Active rows and, between neighbours of a day, break rows."""
    w = Window.partitionBy("entity", "day").orderBy("first_ms", "last_ms")
    gaps = periods.withColumn("next", F.lead("first_ms").over(w)).where("next > last_ms")
    return periods.select("entity", "day", "first_ms", "last_ms", F.lit("active").alias("label")).unionByName(gaps.select("entity", "day", F.col("last_ms").alias("first_ms"), F.col("next").alias("last_ms"), F.lit("break").alias("label")))
