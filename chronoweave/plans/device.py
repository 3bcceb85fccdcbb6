"""A device's files to its streams, and to a day's or month's report; what was read is kept from run to run.

A device's folder has, each optional: power/CurrentPowerlog.PLSQL and power/Archives/powerlog_*.PLSQL.gz, focus/ (binary
containers), usage.db, sessions/ (binary files), wifi/ (text logs, plain or .bz2), log/ (captured compact logs) and places.db.

The store is a folder of Parquet tables, of which each run adds a part of its own: rows whose key no earlier part has. A run that
is repeated replaces its part, so one that failed halfway is run again with the same number. Intervals are kept by day.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals, upsert
from ..sources import binary, logs, sqlite
from ..sources.paths import existing
from ..tables import saved
from . import report, usecase

#: Fixed value: the app in front while the screen is locked.
LOCK_APP = "com.apple.loginwindow"
SCHEMAS = {
    "backlight": "time_ms long, active boolean",
    "frontmost": "time_ms long, bundle_id string",
    "screen_on": "time_ms long, screen_on_secs long",
    "infocus": "time_ms long, bundle_id string",
    "usage": "first_ms long, last_ms long, bundle_id string",
    "sessions": "first_ms long, last_ms long, ssid string",
    "wifi": "time_ms long, ip string, subnet string",
    "events": "time_ms long, kind string",
    "archives": "key string",
    "marks": "source string, mark_ms long, imported_ms long",
}
#: Tables by day, which a later run replaces.
DAYS, INTERVALS = "entity string, provisional boolean, day date", "entity string, first_ms long, last_ms long, code int, day date"
KEYS = {"usage": ["first_ms", "bundle_id"], "sessions": ["first_ms", "last_ms", "ssid"], "events": ["time_ms", "kind"], "archives": ["key"]}


@dataclass(frozen=True)
class Store:
    """Tables of one device."""

    spark: SparkSession
    path: str
    run: int

    def table(self, name: str, before: int | None = None) -> DataFrame:
        """A table, or what it was before a run; empty where there is none."""
        path = f"{self.path}/{name}"
        if not existing(self.spark, [f"{path}/run=*"]):
            return self.spark.createDataFrame([], SCHEMAS[name])
        rows = self.spark.read.schema(f"{SCHEMAS[name]}, run int").parquet(path)
        return (rows if before is None else rows.where(F.col("run") < before)).drop("run")

    def by_day(self, name: str, schema: str) -> DataFrame:
        path = f"{self.path}/{name}"
        return self.spark.read.schema(schema).parquet(path) if existing(self.spark, [f"{path}/day=*"]) else self.spark.createDataFrame([], schema)

    def insert(self, name: str, rows: DataFrame, order: list[str | Column] = ()) -> None:
        """Add rows whose key the table has not, the first in ``order`` of each."""
        keys = KEYS.get(name, ["time_ms"])
        if existing(self.spark, [f"{self.path}/{name}/run=*"]):
            rows = rows.join(self.table(name, self.run).select(*keys), keys, "left_anti")
        upsert.insert_new(None, rows, keys, list(order) or [F.lit(0)]).write.mode("overwrite").parquet(f"{self.path}/{name}/run={self.run}")

    def marks(self) -> dict[str, tuple[int, int]]:
        """The greatest moment read of each source, and when it was imported last."""
        found = self.table("marks", self.run).groupBy("source").agg(F.max("mark_ms").alias("mark"), F.max("imported_ms").alias("imported")).collect()
        return {r.source: (r.mark, r.imported) for r in found}


def import_files(store: Store, files: str, now: int, needed_day: str) -> None:
    """Read what is new in a device's files into its store.

    Live files are read when their last import is over the refresh time old; archives once; streams of containers and
    usage beyond the greatest moment read so far; text logs whole, of which only new moments are added.
    """
    spark, power, known, marks = store.spark, f"{files}/power", store.marks(), []

    def import_stream(source: str, read, time: str, order: list[str | Column] = ()) -> None:
        mark, imported = known.get(source, (None, None))
        if upsert.stale(imported, now):
            rows = saved(read(mark), source)
            store.insert(source, rows, order)
            marks.append((source, upsert.high_mark(rows, time) or mark or 0, now))

    done = {r.key for r in store.table("archives", store.run).collect()}  # a name for each archive
    archives = sqlite.archives(f"{power}/Archives", needed_day, done)
    live = f"{power}/CurrentPowerlog.PLSQL"
    import_stream("backlight", lambda mark: sqlite.read_backlight(spark, [live, *archives]), "time_ms")
    import_stream("frontmost", lambda mark: sqlite.read_frontmost(spark, [live, *archives]), "time_ms")
    import_stream("screen_on", lambda mark: sqlite.read_screen_on(spark, live), "time_ms")
    import_stream("infocus", lambda mark: binary.read_focus(spark, f"{files}/focus", mark), "time_ms")
    import_stream("usage", lambda mark: sqlite.read_usage(spark, f"{files}/usage.db", mark), "last_ms")
    import_stream("sessions", lambda mark: binary.read_wifi_sessions(spark, f"{files}/sessions"), "first_ms")
    import_stream("wifi", lambda mark: logs.read_wifi_logs(spark, [f"{files}/wifi"]), "time_ms", ["file"])
    import_stream("events", lambda mark: logs.read_compact(spark, [f"{files}/log"]), "time_ms")
    if archives and any(m[0] == "backlight" for m in marks):
        names = [sqlite.ARCHIVE.match(os.path.basename(x))[1] for x in archives]
        store.insert("archives", spark.createDataFrame([(x,) for x in names], SCHEMAS["archives"]))
    spark.createDataFrame(marks, SCHEMAS["marks"]).write.mode("overwrite").parquet(f"{store.path}/marks/run={store.run}")


def streams(store: Store, files: str, device: str) -> usecase.Streams:
    """The streams of a device from its store; places are read as they are."""
    own = lambda df: df.select(F.lit(device).alias("entity"), *df.columns)
    plain = lambda name: own(store.table(name)).withColumn("seq", F.lit(0).cast("long"))
    points = lambda name, order: plain(name).select("entity", "time_ms", "bundle_id", F.lit(order).alias("src_ord"), "seq")
    events = plain("events")
    locks = events.where("kind in ('screen_lock', 'screen_unlock')").withColumn("kind", F.when(F.col("kind") == "screen_lock", "lock").otherwise("unlock"))
    return usecase.Streams(
        backlight=plain("backlight"),
        screen=locks,
        inputs=events.where("kind in ('kbd', 'app_launch')"),
        focus_points=points("frontmost", 1).unionByName(points("infocus", 2)),
        focus_periods=plain("usage"),
        wifi=plain("wifi"),
        ssid_sessions=plain("sessions"),
        screen_on=own(store.table("screen_on")),
        anchors=own(sqlite.read_anchors(store.spark, f"{files}/places.db")),
        places=sqlite.read_places(store.spark, f"{files}/places.db"),
    )


def intervals_of(store: Store, files: str, device: str, days: list[str], now: int, office: str, today: str) -> tuple[DataFrame, usecase.Places]:
    """Located intervals of the days of one device, final ones from the cache, and its places; days that were computed are cached."""
    spark = store.spark
    import_files(store, files, now, min(days))
    asked = spark.createDataFrame([(device, x) for x in days], "entity string, day string").withColumn("day", F.col("day").cast("date"))
    cached = upsert.from_codes(store.by_day("intervals", INTERVALS)).select("entity", "day", "first_ms", "last_ms", "label")
    known = saved(store.by_day("days", DAYS).select("entity", "day", "provisional"), "known")
    rows, places = usecase.intervals_for_days(streams(store, files, device), asked, now, office, LOCK_APP, today, cached, known)
    rows = saved(rows, "located")
    cache(store, rows.drop("location"), asked.join(known.where("not provisional"), ["entity", "day"], "left_anti"), now, F.lit(today).cast("date"))
    return rows, places


def cache(store: Store, rows: DataFrame, days: DataFrame, now: int, today: Column) -> None:
    """Keep the intervals of these days, without their places; each replaces what an earlier run kept of it."""
    counts = rows.groupBy("entity", "day").agg(F.count("*").alias("n"))
    worth = days.join(counts, ["entity", "day"], "left").where(upsert.worth_writing(F.col("day"), today, F.coalesce("n", F.lit(0))))
    worth = worth.select("entity", upsert.provisional(F.col("day"), today, now).alias("provisional"), "day")
    upsert.replace_days(upsert.with_codes(rows).join(worth, ["entity", "day"], "left_semi").select("entity", "first_ms", "last_ms", "code", "day"), f"{store.path}/intervals")
    upsert.replace_days(worth, f"{store.path}/days")


def next_run(spark: SparkSession, path: str) -> int:
    """The number of a run after all that are there."""
    if not existing(spark, [f"{path}/marks/run=*"]):
        return 0
    return (spark.read.schema(f"{SCHEMAS['marks']}, run int").parquet(f"{path}/marks").agg(F.max("run")).first()[0] or 0) + 1


def text(spark: SparkSession, files: str, store: str, device: str, kind: str, when: str, now: int, office: str, today: str, colour: bool = False) -> str:
    """The table of a ("day", "YYYY-MM-DD") or ("month", "YYYYMM")."""
    at = Store(spark, store, next_run(spark, store))
    days = [when] if kind == "day" else [r.d for r in spark.sql(f"SELECT explode(transform(sequence(to_date('{when}01', 'yyyyMMdd'), last_day(to_date('{when}01', 'yyyyMMdd'))), x -> string(x))) AS d").collect()]
    days = [x for x in days if x <= today] or days[:1]
    rows, places = intervals_of(at, files, device, days, now, office, today)
    mine = intervals.smooth(rows)
    if kind == "day":
        return report.day_table(report.with_places(report.day_report(mine), places.dominant, places.others), colour)
    return report.month_table(report.with_places(report.month_report(mine, places.dominant, F.lit(today).cast("date")), places.dominant, places.others), colour)
