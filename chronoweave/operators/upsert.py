"""Incremental tables: inserts that keep the first row, sums, coverage, marks, and reuse of days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import COVERAGE_SLACK, LABELS, OPEN_PERIOD_SLACK, PLACE_VERSION, REFRESH_TTL
from ..functions.times import effective_day
from .asof import keep_first


def insert_new(old: DataFrame | None, new: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """Old rows, and the first new row of each key that old has not."""
    fresh = keep_first(new, keys, order)
    return fresh if old is None else old.unionByName(fresh.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def add(old: DataFrame, new: DataFrame, keys: list[str], sums: list[str], greatest: list[str] = ()) -> DataFrame:
    """Rows of both with the sums and maxima of each key."""
    return old.unionByName(new).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in greatest])


def count_run(old: DataFrame | None, seen: DataFrame, keys: list[str], counter: str = "observations") -> DataFrame:
    """The counters of a table after one more run: one is added for each key that the run has seen, once however often it did."""
    run = seen.select(*keys).distinct().withColumn(counter, F.lit(1).cast("long"))
    return run if old is None else add(old.select(*keys, counter), run, keys, sums=[counter])


def widen(old: DataFrame | None, new: DataFrame, keys: list[str], at: str = "time_ms") -> DataFrame:
    """(keys, earliest, latest) of both."""
    fresh = new.groupBy(*keys).agg(F.min(at).alias("earliest"), F.max(at).alias("latest"))
    return fresh if old is None else old.unionByName(fresh).groupBy(*keys).agg(F.min("earliest").alias("earliest"), F.max("latest").alias("latest"))


def not_in(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    return new.join(old, keys, "left_anti")


def high_mark(df: DataFrame, at: str) -> int:
    """The greatest value, zero of an empty table: one row reaches the driver."""
    return df.agg(F.max(at).alias("m")).first()["m"] or 0


def replace_days(df: DataFrame, path: str) -> None:
    """Write intervals so that each of their days replaces what the path has of it."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def gaps(needed: int, now: int, earliest: int | None, latest: int | None) -> list[tuple[int, int]]:
    """Ranges to fetch so that [needed, now] is covered: before the coverage, and after it once it is five minutes old."""
    if earliest is None or latest is None:
        return [(needed, now)]
    out = [(needed, earliest)] if needed < earliest else []
    return [*out, (latest, now)] if now - latest > COVERAGE_SLACK else out


def ranges_to_fetch(wanted: DataFrame, coverage: DataFrame, now: int) -> DataFrame:
    """(entity, class, first_ms, last_ms) of what is to be fetched so that each (entity, class, needed_ms) is covered up to now, as ``gaps`` has it."""
    known = wanted.join(coverage.select("entity", "class", "earliest", "latest"), ["entity", "class"], "left")
    span = lambda a, b: F.struct(a.alias("first_ms"), b.alias("last_ms"))
    none = F.col("earliest").isNull() | F.col("latest").isNull()
    whole, head, tail = span(F.col("needed_ms"), F.lit(now)), span(F.col("needed_ms"), F.col("earliest")), span(F.col("latest"), F.lit(now))
    parts = F.array(F.when(none, whole), F.when(~none & (F.col("needed_ms") < F.col("earliest")), head), F.when(~none & (F.lit(now) - F.col("latest") > COVERAGE_SLACK), tail))
    return known.select("entity", "class", F.explode(F.array_compact(parts)).alias("r")).select("entity", "class", "r.*")


def due(sources: DataFrame, imports: DataFrame, now: int) -> DataFrame:
    """Those of ``sources`` (entity, class) whose last import, (entity, class, imported_ms), is over the refresh time old, or that had none."""
    last = imports.groupBy("entity", "class").agg(F.max("imported_ms").alias("imported_ms"))
    old = F.coalesce(F.lit(now) - F.col("imported_ms") > REFRESH_TTL, F.lit(True))
    return sources.join(last, ["entity", "class"], "left").where(old).select("entity", "class")


def with_codes(intervals: DataFrame) -> DataFrame:
    """Intervals with the code of their label; those of no known label go."""
    return intervals.withColumn("code", F.array_position(F.array(*map(F.lit, LABELS)), F.col("label")).cast("int") - 1).where("code >= 0")


def from_codes(coded: DataFrame) -> DataFrame:
    """Intervals with the label of their code; those of no known code go."""
    return coded.withColumn("label", F.get(F.array(*map(F.lit, LABELS)), F.col("code"))).where(F.col("label").isNotNull()).drop("code")


def current_places(evidence: DataFrame, version: int) -> DataFrame:
    """Evidence as the present version has it: before it, places were named without their kind."""
    if version >= PLACE_VERSION:
        return evidence
    bare = F.col("location").isNotNull() & ~F.col("location").contains(":")
    return evidence.withColumn("location", F.when(bare, F.concat(F.lit("duet:"), F.col("location"))).otherwise(F.col("location")))


def stale(imported: int | None, now: int) -> bool:
    return imported is None or now - imported > REFRESH_TTL


def reusable(day: Column, today: Column, now: int) -> Column:
    """A finished day's cached rows serve again."""
    return (day < today) & (day != effective_day(F.lit(now)))


def provisional(day: Column, today: Column, now: int) -> Column:
    return (day >= today) | (day == effective_day(F.lit(now)))


def merge_cached(fresh: DataFrame, cached: DataFrame, cached_days: DataFrame, today: Column, now: int) -> DataFrame:
    """Intervals of all days: reusable final days from the cache; other days fresh, or where that has no active row, provisional cached ones.

    cached_days has (entity, day, provisional). Cached rows of no known label go.
    """
    cached = cached.where(F.col("label").isin(*LABELS))
    final = cached_days.where(~F.col("provisional") & reusable(F.col("day"), today, now)).select("entity", "day")
    active = fresh.where("label = 'active'").select("entity", "day").distinct()
    spare = cached_days.where("provisional").select("entity", "day").join(active, ["entity", "day"], "left_anti")
    used = final.unionByName(spare).distinct()
    return fresh.join(used, ["entity", "day"], "left_anti").unionByName(cached.join(used, ["entity", "day"], "left_semi").select(*fresh.columns))


def is_open(last_ms: Column, day: Column, now: int) -> Column:
    """The period goes on: it ends within five seconds of now, on the day that counts now."""
    return (F.lit(now) - last_ms <= OPEN_PERIOD_SLACK) & (day == effective_day(F.lit(now)))


def worth_writing(day: Column, today: Column, n_rows: Column) -> Column:
    return (day <= today) & ((n_rows > 0) | (day < today))
