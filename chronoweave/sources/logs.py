"""Text logs: compact unified-log lines and blocks of a wifi log, decoded with expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.network import subnet
from .paths import existing

#: Classes of compact lines and what marks them: fixed values.
CLASSES = {
    "keyboard": "com.apple.SkyLight:KeyboardEvent",
    "screen_lock": "sendDistributedNotification: com.apple.screenIs",
    "app_launch": "LAUNCH:",
}


def class_of(line: Column) -> Column:
    """The class whose mark a line has, or null."""
    out = None
    for name, mark in CLASSES.items():
        out = (F if out is None else out).when(line.contains(mark), name)
    return out


def kind_of(line_class: Column, line: Column) -> Column:
    lock = F.when(line.contains("screenIsLocked"), "screen_lock").when(line.contains("screenIsUnlocked"), "screen_unlock")
    return F.when(line_class == "keyboard", "kbd").when(line_class == "screen_lock", lock).when(line_class == "app_launch", "app_launch")


def parse_compact(lines: DataFrame) -> DataFrame:
    """(line_class, value) lines with time_ms and kind. Local time to the second; lines that aren't of the form, or of no kind, go.

    The offset that a line prints is ignored: the session's time zone holds.
    """
    at = F.try_to_timestamp(F.substring("value", 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))
    parsed = lines.withColumn("time_ms", F.unix_millis(at)).withColumn("kind", kind_of(F.col("line_class"), F.col("value")))
    return parsed.where(F.col("value").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}") & F.col("time_ms").isNotNull() & F.col("kind").isNotNull())


def wifi_time(line: Column, year: Column) -> Column:
    """Milliseconds of "Tue May  5 11:45:33.009" in a given year: to the second, weekday ignored, or null."""
    head = F.regexp_extract(line, r"^\S{3} ([A-Z][a-z]{2}) +([0-9]{1,2} [0-9]{2}:[0-9]{2}:[0-9]{2})", 1)
    rest = F.regexp_extract(line, r"^\S{3} ([A-Z][a-z]{2}) +([0-9]{1,2} [0-9]{2}:[0-9]{2}:[0-9]{2})", 2)
    text = F.when(head != "", F.concat_ws(" ", year.cast("string"), head, rest))
    return F.unix_millis(F.try_to_timestamp(text, F.lit("yyyy MMM d HH:mm:ss")))


def field(line: Column, prefix: str) -> Column:
    """What follows a prefix up to white space; null without the prefix."""
    return F.when(F.instr(line, prefix) > 0, F.regexp_extract(line, f"{prefix}([^\\s]*)", 1))


def wifi_events(lines: DataFrame) -> DataFrame:
    """(file, time_ms, ip, subnet) from lines (file, year, pos, value).

    Lines belong to the last moment seen above them; when the moment changes, the last address and mask of its
    lines make an event, if both are there. Addresses on lines of routers don't count. 0.0.0.0 is an event
    without address; masks and addresses that aren't any make none.
    """
    w = Window.partitionBy("file").orderBy("pos")
    at = F.last(wifi_time(F.col("value"), F.col("year")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    line = F.col("value")
    router = line.contains("Router") | line.contains("Gateway") | line.contains("Default")
    marked = lines.select("file", "pos", at.alias("time_ms"), F.when(~router, field(line, "IP Address: ")).alias("ip"), field(line, "IP subnet mask: ").alias("mask")).where("time_ms is not null")
    island = F.sum(F.coalesce((F.col("time_ms") != F.col("was")).cast("int"), F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    blocks = marked.withColumn("was", F.lag("time_ms").over(w)).withColumn("island", island)
    per = blocks.groupBy("file", "island", "time_ms").agg(F.max_by("ip", F.when(F.col("ip").isNotNull(), F.col("pos"))).alias("ip"), F.max_by("mask", F.when(F.col("mask").isNotNull(), F.col("pos"))).alias("mask"))
    none = F.col("ip") == "0.0.0.0"
    out = per.where("ip is not null and mask is not null").select("file", "time_ms", F.when(none, "").otherwise(F.col("ip")).alias("ip"), F.when(none, "").otherwise(subnet(F.col("ip"), F.col("mask"))).alias("subnet"))
    return out.where("subnet is not null")


def read_wifi_logs(spark: SparkSession, paths: list[str], year: int | None = None) -> DataFrame:
    """Events of wifi logs, plain or .bz2. Without ``year``, that of a file's modification (UTC) holds."""
    paths = existing(spark, paths)
    if not paths:
        return spark.createDataFrame([], "file string, time_ms long, ip string, subnet string")
    raw = spark.read.option("wholetext", True).text(paths)
    of_file = F.lit(year) if year else F.year(F.col("_metadata.file_modification_time"))
    lines = raw.select(F.col("_metadata.file_path").alias("file"), of_file.alias("year"), F.posexplode(F.split("value", "\r?\n")).alias("pos", "value"))
    return wifi_events(lines)


def read_compact(spark: SparkSession, paths: list[str], line_class: str | None = None) -> DataFrame:
    """(time_ms, kind) of captured compact logs; the class of each line is told by its mark unless given."""
    paths = existing(spark, paths)
    if not paths:
        return spark.createDataFrame([], "time_ms long, kind string")
    lines = spark.read.text(paths)
    return parse_compact(lines.select("value", F.lit(line_class).alias("line_class") if line_class else class_of(F.col("value")).alias("line_class"))).select("time_ms", "kind")
