"""SQLite files as a Spark source, and the device tables read from them.

    spark.dataSource.register(SqliteSource)
    spark.read.format("sqlite").schema(...).option("query", "SELECT ...").load(path)

Paths are those of the executors' shared store. Archives (.gz) are unpacked in memory by the task that reads
them, one task a file. Absent optional files give no rows; a folder that may not be read is an error.
"""

from __future__ import annotations

import glob
import gzip
import os
import re
import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..constants import ARCHIVE_LOOKBACK_DAYS, COCOA_EPOCH_S

ARCHIVE = re.compile(r"powerlog_(.+)\.PLSQL\.gz$")


class SqliteSource(DataSource):
    """Options: path (files or patterns, one a line), query, and optional=true to take an absent path for an empty one."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        raise ValueError("give a schema")

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(self.options, schema)


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def files(path: str) -> list[str]:
    """Files of a path or pattern; none where there is none, PermissionError where the folder may not be read."""
    found = sorted(glob.glob(path)) or ([path] if os.path.exists(path) else [])
    if not found:
        folder = os.path.dirname(path) or "."
        while folder and glob.has_magic(folder):
            folder = os.path.dirname(folder)
        try:
            with os.scandir(folder or "."):
                pass
        except (FileNotFoundError, NotADirectoryError):
            pass
    return found


class SqliteReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.query = options.get("path", ""), options["query"]
        self.optional, self.width = options.get("optional", "false").lower() == "true", len(schema.fields)

    def partitions(self) -> list[File]:
        found = [p for path in self.path.split("\n") if path for p in files(path)]
        if not found and not self.optional:
            raise FileNotFoundError(self.path)
        return [File(p) for p in found]

    def read(self, part: File):
        if not isinstance(part, File):
            return
        if part.path.endswith(".gz"):
            db = sqlite3.connect(":memory:")
            with gzip.open(part.path) as f:
                db.deserialize(f.read())
        else:
            db = sqlite3.connect(f"file:{part.path}?mode=ro", uri=True)
        try:
            yield from (tuple(r) for r in db.execute(self.query))
        finally:
            db.close()


def _read(spark: SparkSession, path: str | list[str], schema: str, query: str, optional: bool = True) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    paths = path if isinstance(path, str) else "\n".join(path)
    return spark.read.format("sqlite").schema(schema).option("query", query).option("optional", str(optional).lower()).load(paths)


def read_backlight(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(time_ms, active); seconds are cut to milliseconds, a moment's first row counts."""
    rows = _read(spark, path, "n long, ts double, active int", "SELECT rowid, timestamp, Active FROM PLDisplayAgent_EventPoint_Display WHERE Block = 'Backlight' AND timestamp IS NOT NULL")
    return rows.groupBy((F.col("ts") * 1000).cast("long").alias("time_ms")).agg(F.min_by(F.col("active") == 1, "n").alias("active"))


def read_frontmost(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(time_ms, bundle_id), '' where there is none."""
    rows = _read(spark, path, "n long, ts double, bundle_id string", "SELECT rowid, timestamp, BundleID FROM PLApplicationAgent_EventForward_FrontmostApp WHERE timestamp IS NOT NULL")
    return rows.groupBy((F.col("ts") * 1000).cast("long").alias("time_ms")).agg(F.min_by(F.coalesce("bundle_id", F.lit("")), "n").alias("bundle_id"))


def read_screen_on(spark: SparkSession, live: str, latest: bool = False) -> DataFrame:
    """(time_ms, screen_on_secs) of the live file; archives have none. An hour's first row counts, or with ``latest`` its last."""
    rows = _read(spark, live, "n long, ts double, secs double", "SELECT rowid, timestamp, ScreenOn FROM PLDisplayAgent_Aggregate_ScreenOn WHERE timestamp IS NOT NULL")
    return rows.groupBy((F.col("ts") * 1000).cast("long").alias("time_ms")).agg((F.max_by if latest else F.min_by)(F.col("secs").cast("long"), "n").alias("screen_on_secs"))


def read_usage(spark: SparkSession, path: str, since_ms: int | None = None) -> DataFrame:
    """(first_ms, last_ms, bundle_id) of app usage that ended after ``since_ms``; rows that don't last go."""
    beyond = "" if since_ms is None else f" AND ZENDDATE > {since_ms / 1000 - COCOA_EPOCH_S!r}"
    query = f"SELECT Z_PK, ZSTARTDATE, ZENDDATE, ZVALUESTRING FROM ZOBJECT WHERE ZSTREAMNAME = '/app/usage' AND ZSTARTDATE IS NOT NULL AND ZENDDATE IS NOT NULL AND ZVALUESTRING IS NOT NULL{beyond}"
    rows = _read(spark, path, "n long, s double, e double, bundle_id string", query)
    ms = lambda c: ((F.lit(float(COCOA_EPOCH_S)) + F.col(c)) * 1000).cast("long")
    named = rows.select("n", ms("s").alias("first_ms"), ms("e").alias("last_ms"), "bundle_id").where("last_ms > first_ms")
    return named.groupBy("first_ms", "bundle_id").agg(F.min_by("last_ms", "n").alias("last_ms")).select("first_ms", "last_ms", "bundle_id")


def archives(folder: str, needed_day: str, imported: set[str] = frozenset()) -> list[str]:
    """Archives not imported yet whose key's date is at most two days before the day needed."""
    from datetime import date, timedelta

    cutoff = (date.fromisoformat(needed_day) - timedelta(days=ARCHIVE_LOOKBACK_DAYS)).isoformat()
    found = []
    for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        m = ARCHIVE.match(name)
        if m and m[1][:10] >= cutoff and m[1] not in imported:
            found.append(os.path.join(folder, name))
    return found


def read_anchors(spark: SparkSession, path: str) -> DataFrame:
    """(anchor_s, place, seq) of visits to places."""
    return _read(spark, path, "anchor_s double, place string, seq long", "SELECT anchorDate, anchorLocation, rowid FROM anchorOccurrence WHERE anchorDate IS NOT NULL")


#: Fixed value: the type of the place that is home.
HOME_TYPE = "ANCHOR_LOCATION_TYPE_HOME"


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """(place, type), the type "home" or as the file has it."""
    rows = _read(spark, path, "place string, type string", "SELECT uuid, type FROM locations")
    return rows.withColumn("type", F.when(F.col("type") == HOME_TYPE, "home").otherwise(F.coalesce("type", F.lit(""))))
