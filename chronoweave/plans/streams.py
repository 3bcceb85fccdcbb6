"""Device streams derived from the events table, in Spark and, for the oracles, as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import HOUR, MINUTE, SECOND
from ..tables import saved

#: Devices that events are dealt to.
DEVICES = 4
#: The moment that counts as now: 2024-02-01T00:00Z.
NOW = 1_706_745_600_000
BLOCK = 6 * HOUR
LOCK_APP = "app.6"
OFFICE = "net0"


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, parsed and written once: what takes a folder here takes them, too."""
    return saved(events(spark, sf_dir), "events")


def events(spark: SparkSession, sf_dir: str | DataFrame) -> DataFrame:
    """entity, time_ms, event_type, value, k, seq; only these columns are read."""
    if isinstance(sf_dir, DataFrame):
        return sf_dir
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        (F.col("user_id") % DEVICES).cast("string").alias("entity"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("time_ms"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.col("event_id").alias("seq"),
    )


def _of(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return events(spark, sf_dir).where(F.col("event_type") == kind)


def inputs(spark, sf_dir):
    return _of(spark, sf_dir, "click").select("entity", "time_ms", F.when(F.col("k") % 10 == 0, "app_launch").otherwise("kbd").alias("kind"), "seq")


def focus_points(spark, sf_dir):
    """Points of two sources: src_ord 1 for odd k, 2 for even."""
    return _of(spark, sf_dir, "view").select("entity", "time_ms", F.concat(F.lit("app."), (F.col("k") % 7).cast("string")).alias("bundle_id"), F.when(F.col("k") % 2 == 1, 1).otherwise(2).alias("src_ord"), "seq")


def focus_periods(spark, sf_dir):
    v = _of(spark, sf_dir, "view").where(F.col("k") % 5 == 0)
    return v.select("entity", F.col("time_ms").alias("first_ms"), (F.col("time_ms") + F.floor(F.col("value") * (10 * SECOND)).cast("long")).alias("last_ms"), F.concat(F.lit("app."), (F.col("k") % 7).cast("string")).alias("bundle_id"), "seq")


def backlight(spark, sf_dir):
    return _of(spark, sf_dir, "error").select("entity", "time_ms", (F.col("k") % 2 == 1).alias("active"), "seq")


def screen(spark, sf_dir):
    return _of(spark, sf_dir, "signup").select("entity", "time_ms", F.when(F.col("k") % 3 == 0, "lock").otherwise("unlock").alias("kind"), "seq")


def _pool():
    return F.pmod(F.floor(F.col("time_ms") / BLOCK).cast("long"), F.lit(3)).cast("string")


def wifi(spark, sf_dir):
    net = F.concat(F.lit("10."), _pool(), F.lit("."), (F.col("k") % 2).cast("string"), F.lit("."))
    up = F.col("k") % 11 != 0
    return _of(spark, sf_dir, "purchase").select("entity", "time_ms", F.when(up, F.concat(net, F.col("k").cast("string"))).otherwise("").alias("ip"), F.when(up, F.concat(net, F.lit("0/24"))).otherwise("").alias("subnet"), "seq")


def ssid_sessions(spark, sf_dir):
    last = F.least(F.col("time_ms") + F.floor(F.col("value") * MINUTE).cast("long"), (F.floor(F.col("time_ms") / BLOCK).cast("long") + 1) * BLOCK - 1)
    return _of(spark, sf_dir, "purchase").where(F.col("k") % 4 != 0).select("entity", F.col("time_ms").alias("first_ms"), last.alias("last_ms"), F.concat(F.lit("net"), _pool()).alias("ssid"), "seq")


def anchors(spark, sf_dir):
    a = _of(spark, sf_dir, "signup").where(F.col("k") % 2 == 0)
    return a.select("entity", (F.col("time_ms") / 1000.0).alias("anchor_s"), F.concat(F.lit("p"), (F.col("k") % 6).cast("string")).alias("place"), "seq")


def places(spark, sf_dir):
    """Six places, of which p0 is home."""
    return spark.createDataFrame([(f"p{k}", "home" if k == 0 else "other") for k in range(6)], "place string, type string")


def screen_on_buckets(spark, sf_dir):
    """Seconds of screen time per device and hour, zero hours of the covered range included."""
    counted = events(spark, sf_dir).groupBy("entity", (F.floor(F.col("time_ms") / HOUR) * HOUR).cast("long").alias("time_ms")).agg(F.count("*").alias("n"))
    span = counted.groupBy("entity").agg(F.min("time_ms").alias("a"), F.max("time_ms").alias("b"))
    grid = span.select("entity", F.explode(F.sequence("a", "b", F.lit(HOUR))).alias("time_ms"))
    return grid.join(counted, ["entity", "time_ms"], "left").select("entity", "time_ms", F.least(F.lit(3600).cast("long"), F.coalesce("n", F.lit(0)) * 600).alias("screen_on_secs"))


#: The same streams for DuckDB.
SQL = f"""
ev AS (SELECT CAST(user_id % {DEVICES} AS VARCHAR) AS entity, epoch_us(ts) // 1000 AS time_ms, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id AS seq FROM events),
inputs AS (SELECT entity, time_ms, CASE WHEN k % 10 = 0 THEN 'app_launch' ELSE 'kbd' END AS kind, seq FROM ev WHERE event_type = 'click'),
focus_points AS (SELECT entity, time_ms, 'app.' || (k % 7) AS bundle_id, CASE WHEN k % 2 = 1 THEN 1 ELSE 2 END AS src_ord, seq FROM ev WHERE event_type = 'view'),
focus_periods AS (SELECT entity, time_ms AS first_ms, time_ms + CAST(floor(value * {10 * SECOND}) AS BIGINT) AS last_ms, 'app.' || (k % 7) AS bundle_id, seq FROM ev WHERE event_type = 'view' AND k % 5 = 0),
backlight AS (SELECT entity, time_ms, k % 2 = 1 AS active, seq FROM ev WHERE event_type = 'error'),
screen AS (SELECT entity, time_ms, CASE WHEN k % 3 = 0 THEN 'lock' ELSE 'unlock' END AS kind, seq FROM ev WHERE event_type = 'signup'),
wifi AS (SELECT entity, time_ms, CASE WHEN k % 11 <> 0 THEN '10.' || (time_ms // {BLOCK} % 3) || '.' || (k % 2) || '.' || k ELSE '' END AS ip,
  CASE WHEN k % 11 <> 0 THEN '10.' || (time_ms // {BLOCK} % 3) || '.' || (k % 2) || '.0/24' ELSE '' END AS subnet, seq FROM ev WHERE event_type = 'purchase'),
ssid_sessions AS (SELECT entity, time_ms AS first_ms, least(time_ms + CAST(floor(value * {MINUTE}) AS BIGINT), (time_ms // {BLOCK} + 1) * {BLOCK} - 1) AS last_ms, 'net' || (time_ms // {BLOCK} % 3) AS ssid, seq
  FROM ev WHERE event_type = 'purchase' AND k % 4 <> 0),
anchors AS (SELECT entity, time_ms / 1000.0 AS anchor_s, 'p' || (k % 6) AS place, seq FROM ev WHERE event_type = 'signup' AND k % 2 = 0),
places AS (SELECT 'p' || i AS place, CASE WHEN i = 0 THEN 'home' ELSE 'other' END AS type FROM range(6) t(i)),
counted AS (SELECT entity, time_ms // {HOUR} * {HOUR} AS time_ms, count(*) AS n FROM ev GROUP BY ALL),
bucket_span AS (SELECT entity, min(time_ms) AS a, max(time_ms) AS b FROM counted GROUP BY entity),
buckets AS (SELECT g.entity, g.time_ms, least(3600, coalesce(n, 0) * 600) AS screen_on_secs
  FROM (SELECT entity, unnest(range(a, b + 1, {HOUR})) AS time_ms FROM bucket_span) g LEFT JOIN counted USING (entity, time_ms))
"""
