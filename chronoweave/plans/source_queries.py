"""Queries of the text decoders, over lines made from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import times
from ..sources import logs
from . import streams as st

CTES = "WITH " + st.SQL.strip() + "\n"


def compact_lines(spark, d):
    """A compact log line for each event."""
    e = st.events(spark, d)
    at = F.date_format(times.instant(F.col("time_ms")), "yyyy-MM-dd HH:mm:ss")
    said = (
        F.when(F.col("event_type") == "click", f"{logs.CLASSES['keyboard']} down")
        .when(F.col("event_type") == "signup", F.concat(F.lit(logs.CLASSES["screen_lock"]), F.when(F.col("k") % 3 == 0, "IsLocked").otherwise("IsUnlocked")))
        .when(F.col("event_type") == "view", f"{logs.CLASSES['app_launch']} app")
        .otherwise("nothing of note")
    )
    said = F.regexp_replace(said, "screenIsIs", "screenIs")
    return e.select("seq", F.concat(at, F.lit(".123-0500  Df proc[1:2] "), said).alias("value"))


def q_compact(spark, d):
    """S7, P3, P4."""
    lines = compact_lines(spark, d).withColumn("line_class", logs.class_of(F.col("value")))
    return logs.parse_compact(lines).select("seq", "time_ms", "kind")


SQL_COMPACT = (
    CTES
    + """SELECT seq, time_ms // 1000 * 1000 AS time_ms, CASE event_type WHEN 'click' THEN 'kbd' WHEN 'view' THEN 'app_launch' ELSE CASE WHEN k % 3 = 0 THEN 'screen_lock' ELSE 'screen_unlock' END END AS kind
FROM ev WHERE event_type IN ('click', 'view', 'signup')"""
)


def wifi_lines(spark, d):
    """Three lines for each purchase: an address with a moment, a router, a mask. Like any log, they are in the order of their seconds, whatever the order of ids."""
    e = st.wifi(spark, d)
    at = times.instant(F.col("time_ms"))
    moment = F.concat(F.date_format(at, "E MMM "), F.lpad(F.dayofmonth(at).cast("string"), 2, " "), F.date_format(at, " HH:mm:ss.SSS"))
    ip = F.when(F.col("ip") == "", "0.0.0.0").otherwise(F.col("ip"))
    lines = F.array(F.concat(moment, F.lit("  IP Address: "), ip, F.lit(" up")), F.lit("  Router IP Address: 9.9.9.9"), F.lit("  IP subnet mask: 255.255.255.0"))
    return e.select(F.col("entity").alias("file"), F.year(at).alias("year"), F.floor(F.col("time_ms") / 1000).alias("second"), "seq", F.posexplode(lines).alias("i", "value")).select("file", "year", F.struct("second", "seq", "i").alias("pos"), "value")


def q_wifi_log(spark, d):
    """S6, P5, P6, P7, P8, P10, P11."""
    return logs.wifi_events(wifi_lines(spark, d)).withColumnRenamed("file", "entity")


SQL_WIFI = CTES + "SELECT entity, time_ms // 1000 * 1000 AS time_ms, max_by(ip, seq) AS ip, max_by(subnet, seq) AS subnet FROM wifi GROUP BY entity, time_ms // 1000 * 1000"

QUERIES = {"compact_log": q_compact, "wifi_log": q_wifi_log}
ORACLES = {"compact_log": SQL_COMPACT, "wifi_log": SQL_WIFI}
