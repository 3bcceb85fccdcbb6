"""Day and month reports as DataFrames, and their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import pad_end, pad_start
from ..functions.times import duration, extended_time, month_name, weekday
from ..operators.intervals import trim_to_active

SUPERSCRIPTS = "²³⁴⁵⁶⁷⁸⁹"


def active_ms() -> Column:
    return F.sum(F.when(F.col("label") == "active", F.col("last_ms") - F.col("first_ms")).otherwise(0))


def day_report(intervals: DataFrame) -> DataFrame:
    """Rows of each day from the first to the last active one, with the day's active total."""
    day = Window.partitionBy("entity", "day")
    return trim_to_active(intervals).withColumn("total_ms", active_ms().over(day))


def month_report(intervals: DataFrame, dominant: DataFrame, today: Column) -> DataFrame:
    """A row for each day up to ``today`` that has active rows: bounds, total, locations (the dominant one first) and breaks."""
    rows = intervals.where((F.col("day") <= today) & (F.col("last_ms") > F.col("first_ms"))).join(dominant.select("entity", "dominant_id"), "entity", "left")
    active = F.col("label") == "active"
    place = F.when(active & F.col("location").isNotNull(), F.struct((~F.col("location").eqNullSafe(F.col("dominant_id"))).alias("other"), F.col("location").alias("id")))
    rest = F.when(~active, F.struct("first_ms", "last_ms", "label"))
    per = rows.groupBy("entity", "day").agg(
        F.min(F.when(active, F.col("first_ms"))).alias("first_ms"),
        F.max(F.when(active, F.col("last_ms"))).alias("last_ms"),
        active_ms().alias("total_ms"),
        F.transform(F.array_sort(F.collect_set(place)), lambda x: x["id"]).alias("locations"),
        F.array_sort(F.collect_list(rest)).alias("all_breaks"),
    )
    breaks = F.filter("all_breaks", lambda b: (b["first_ms"] >= F.col("first_ms")) & (b["last_ms"] <= F.col("last_ms")))
    return per.where("first_ms is not null").select("entity", "day", "first_ms", "last_ms", "total_ms", "locations", breaks.alias("breaks"))


def symbol(location: Column, dominant: Column, others: Column) -> Column:
    """A tick for the dominant place; a star for a sole other; else raised numbers from two on. An unknown id counts as the first other."""
    index = F.greatest(F.array_position(others, location).cast("int") - 1, F.lit(0))
    raised = F.when(index < len(SUPERSCRIPTS), F.substring(F.lit(SUPERSCRIPTS), index + 1, F.lit(1))).otherwise((index + 2).cast("string"))
    return F.when(location.isNull(), "").when(location.eqNullSafe(dominant), "✓").when(F.size(others) == 1, "*").otherwise(raised)


def with_places(report: DataFrame, dominant: DataFrame, others: DataFrame) -> DataFrame:
    """A day or month report with the dominant place and the other places of each row's entity, and the symbols of the row's own."""
    known = report.join(dominant.select("entity", "dominant_id"), "entity", "left").join(others.select("entity", "other_ids"), "entity", "left")
    known = known.withColumn("other_ids", F.coalesce("other_ids", F.array().cast("array<string>")))
    own = F.col("locations") if "locations" in report.columns else F.when(F.col("location").isNull(), F.array().cast("array<string>")).otherwise(F.array("location"))
    return known.withColumn("places", own).withColumn("symbols", F.transform("places", lambda x: symbol(x, F.col("dominant_id"), F.col("other_ids"))))


def legend(rows: list) -> list[str]:
    """What the symbols of these rows mean: the dominant place if they have it, then the other places that they have."""
    used = {place: sign for r in rows for place, sign in zip(r.places, r.symbols, strict=True)}
    out = [f"{used[rows[0].dominant_id]}  Main office"] if rows and rows[0].dominant_id in used else []
    others = [used[x] for x in rows[0].other_ids if x in used] if rows else []
    return [*out, f"{' '.join(others)}  Other office"] if others else out


def legend_lines(used: Column, dominant: Column, others: Column) -> Column:
    """What the symbols of the places used mean, an array of lines: the dominant one first, then the others in their order."""
    signs = F.transform(F.filter(others, lambda x: F.array_contains(used, x)), lambda x: symbol(x, dominant, others))
    main = F.when(F.array_contains(used, dominant), F.concat(symbol(dominant, dominant, others), F.lit("  Main office")))
    more = F.when(F.size(signs) > 0, F.concat(F.array_join(signs, " "), F.lit("  Other office")))
    return F.array_compact(F.array(main, more))


def printable(report: DataFrame) -> DataFrame:
    """Times as text: from, to (HH:MM since the day's midnight), length and weekday."""
    return report.select("*", extended_time(F.col("day"), F.col("first_ms")).alias("from_text"), extended_time(F.col("day"), F.col("last_ms")).alias("to_text"), duration(F.col("last_ms") - F.col("first_ms")).alias("length_text"), weekday(F.col("day")).alias("weekday"))


COLOURS = {"active": "\x1b[32m", "break": "\x1b[33m", "transit": "\x1b[36m"}


def use_colour(choice: str, terminal: bool, environment: dict) -> bool:
    """never, always, or auto: on a terminal unless NO_COLOR is set."""
    if choice not in ("never", "always", "auto"):
        raise ValueError(f"colour: never, always or auto, not {choice}")
    return choice == "always" or choice == "auto" and terminal and not environment.get("NO_COLOR")


def render_day(report: DataFrame, colour: bool = False) -> str:
    """Text of one device's day: a report of one day is small. With places (``with_places``), symbols stand for ids and a legend follows."""
    named = "symbols" in report.columns
    rows = printable(report).withColumn("total_text", duration(F.col("total_ms"))).orderBy("first_ms").collect()
    if not rows:
        return "No presence."
    lines = [f"{rows[0].weekday} {rows[0].day}"]
    for r in rows:
        text = f"{r.from_text}–{r.to_text}  {r.length_text}  {r.label:<8}{''.join(r.symbols) if named else getattr(r, 'location', None) or ''}".rstrip()
        lines.append(f"{COLOURS[r.label]}{text}\x1b[0m" if colour else text)
    return "\n".join([*lines, f"Active {rows[0].total_text}", *(legend(rows) if named else [])])


def render_month(report: DataFrame, colour: bool = False) -> str:
    """Text of one device's month, a line a day: at most 31 rows. Places as in ``render_day``."""
    named = "symbols" in report.columns
    rows, lines = printable(report).withColumn("total_text", duration(F.col("total_ms"))).orderBy("day").collect(), []
    for r in rows:
        text = f"{r.weekday} {r.day}  {r.from_text}–{r.to_text}  {r.total_text}  {len(r.breaks)} breaks  {''.join(r.symbols) if named else ' '.join(r.locations)}".rstrip()
        lines.append(f"{COLOURS['active']}{text}\x1b[0m" if colour else text)
    return "\n".join([*lines, *(legend(rows) if named else [])]) or "No presence."


GAP = "   "


def _lines(rows: DataFrame, cells: list[tuple[str, Column, object]], order: list[str]) -> DataFrame:
    """rows with n, their place in their table, line, and head: cells padded to the widest of their column, its title included.

    The rows of one entity and ``table`` are a table. Widths are bytes.
    """
    w = Window.partitionBy("entity", "table")
    kept = rows.select("*", *[value.alias(f"__{k}") for k, (_, value, _) in enumerate(cells)])
    wide = kept.select("*", *[F.greatest(F.max(F.octet_length(f"__{k}")).over(w), F.lit(len(title))).alias(f"__w{k}") for k, (title, _, _) in enumerate(cells)])
    join = lambda values: F.concat_ws(GAP, *[pad(v, F.col(f"__w{k}")) for k, ((_, _, pad), v) in enumerate(zip(cells, values, strict=True))])
    line = join([F.col(f"__{k}") for k in range(len(cells))])
    head = join([F.lit(title) for title, _, _ in cells])
    numbered = wide.select("*", line.alias("line"), head.alias("head"), F.row_number().over(w.orderBy(*order)).cast("long").alias("n"))
    return numbered.drop(*[f"__{k}" for k in range(len(cells))], *[f"__w{k}" for k in range(len(cells))])


def table_lines(report: DataFrame) -> DataFrame:
    """Rows of day reports with line and head, a table for each entity and day: start, end, length, type and, where any row has one, place."""
    rows = printable(report).withColumn("table", F.col("day").cast("string"))
    cells = [("Start", F.col("from_text"), pad_end), ("End", F.col("to_text"), pad_start), ("Duration", F.col("length_text"), pad_start), ("Type", F.col("label"), pad_end)]
    return _lines(rows, cells, ["first_ms", "last_ms"])


def month_lines(report: DataFrame) -> DataFrame:
    """Rows of month reports with line and head, a table for each entity and month: day, start, end, total, breaks."""
    rows = printable(report).withColumn("table", F.date_format("day", "yyyyMM")).withColumn("total_text", duration(F.col("total_ms")))
    cells = [("Day", F.concat_ws(" ", "weekday", F.col("day").cast("string")), pad_end), ("Start", F.col("from_text"), pad_end), ("End", F.col("to_text"), pad_start), ("Total", F.col("total_text"), pad_start), ("Breaks", F.size("breaks").cast("string"), pad_start)]
    return _lines(rows, cells, ["day"])


def _table(rows: list, title: str, total: str, signs: bool, colour: bool) -> str:
    """Title, head, rule, lines and total of one table: a day or a month is small."""
    sign = lambda r: ("".join(r.symbols) if signs else r.places_text) or ""
    placed = any(sign(r) for r in rows)
    head = rows[0].head + (f"{GAP}At" if placed else "")
    paint = lambda text, code: f"{code}{text}\x1b[0m" if colour else text
    lines = [paint((r.line + (GAP + sign(r) if placed else "")).rstrip(), COLOURS[r.label if "label" in r else "active"]) for r in rows]
    legend = [x for x in (rows[0].legend if signs else [])]
    return "\n".join([title, "", head.rstrip(), "─" * len(head), *lines, "─" * len(head), total, *legend])


def _with_texts(rows: DataFrame) -> DataFrame:
    """Rows with places as text, or with the legend of their table where the report has places."""
    if "symbols" in rows.columns:
        w = Window.partitionBy("entity", "table")
        used = F.array_distinct(F.flatten(F.collect_list("places").over(w)))
        return rows.withColumn("legend", legend_lines(used, F.col("dominant_id"), F.col("other_ids")))
    if "locations" in rows.columns:
        return rows.withColumn("places_text", F.array_join("locations", " "))
    return rows.withColumn("places_text", F.coalesce("location", F.lit("")) if "location" in rows.columns else F.lit(""))


def day_table(report: DataFrame, colour: bool = False) -> str:
    """The table of one device's day. With places (``with_places``), symbols stand for ids and a legend follows."""
    rows = _with_texts(table_lines(report)).withColumn("total_text", duration(F.col("total_ms"))).orderBy("n").collect()
    if not rows:
        return "No presence."
    return _table(rows, f"{rows[0].weekday} {rows[0].day}", f"Active {rows[0].total_text}", "symbols" in report.columns, colour)


def month_table(report: DataFrame, colour: bool = False) -> str:
    """The table of one device's month, a line a day: at most 31 rows. Places as in ``render_day``."""
    rows = _with_texts(month_lines(report)).withColumn("month", F.concat_ws(" ", month_name(F.col("day")), F.year("day").cast("string"))).withColumn("all_text", duration(F.sum("total_ms").over(Window.partitionBy("entity", "table")))).orderBy("n").collect()
    if not rows:
        return "No presence."
    return _table(rows, rows[0].month, f"Active {rows[0].all_text}", "symbols" in report.columns, colour)
