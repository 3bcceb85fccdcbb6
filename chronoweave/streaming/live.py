"""Streams as they come in: input sessions, hourly totals, running tables and finished day timelines.

The batch operators define the results; these give the same ones for events that come within the delay allowed.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DAY_START_HOUR
from ..operators.asof import keep_first
from ..operators.timeline import FOCUS, INPUT, SCHEMA, SCREEN, WIFI, Day
from ..sources.paths import existing


def input_sessions(inputs: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(entity, first_ms, last_ms, n) of (entity, ts) inputs that no pause of thirty minutes parts."""
    w = F.session_window("ts", "30 minutes")
    per = inputs.withWatermark("ts", delay).groupBy("entity", w.alias("w")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"))
    return per.select("entity", F.unix_millis("a").alias("first_ms"), F.unix_millis("b").alias("last_ms"), "n")


def hourly(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(entity, time_ms, n) of (entity, ts) events by hour."""
    per = events.withWatermark("ts", delay).groupBy("entity", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return per.select("entity", F.unix_millis("w.start").alias("time_ms"), "n")


def keep_first_rows(path: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: rows whose key the table at ``path`` has not. Each batch has its own folder, so that one written again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = existing(spark, [f"{path}/batch=*"])
        old = spark.read.schema(f"{batch.schema.toDDL()}, batch int").parquet(path).where(F.col("batch") < number).select(*batch.columns) if known else batch.limit(0)
        fresh = keep_first(batch, keys, order).join(old.select(*keys), keys, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def _bounds(ms: int, zone: str) -> tuple[str, int, int]:
    """Date of the effective day of a moment, and its first and next first moment."""
    here = datetime.fromtimestamp(ms / 1000, timezone.utc).astimezone(ZoneInfo(zone))
    day = (here - timedelta(hours=DAY_START_HOUR)).date() if here.hour < DAY_START_HOUR else here.date()
    start = lambda d: int(datetime(d.year, d.month, d.day, DAY_START_HOUR, tzinfo=ZoneInfo(zone)).timestamp() * 1000)
    return day.isoformat(), start(day), start(day + timedelta(days=1))


def _advance(zone: str):
    def run(key, frames: Iterator, state):
        import pandas as pd

        kept = json.loads(state.get[0]) if state.exists else {"lit": False, "locked": False, "network": None, "last_input": None, "events": []}
        for pdf in frames:
            kept["events"] += [list(r) for r in zip(pdf.time_ms.tolist(), pdf.src_ord.tolist(), pdf.seq.tolist(), [k if isinstance(k, str) else None for k in pdf.kind], strict=True)]
        kept["events"].sort(key=lambda e: e[:3])
        mark, rows = state.getCurrentWatermarkMs(), []
        while kept["events"]:
            name, start, end = _bounds(kept["events"][0][0], zone)
            if end > mark:
                state.setTimeoutTimestamp(max(end, mark + 1))
                break
            day = Day(start, kept["lit"], kept["locked"], kept["network"], kept["last_input"])
            known = kept["network"]
            for t, source, _, kind in kept["events"]:
                if t > end:
                    break
                day.take(t, source, kind)
                if t < end:
                    known = kind if source == WIFI and kind else known
            rows += [(key[0], datetime.fromisoformat(name).date(), *r) for r in day.rows()]
            # What was before the next day's start is its initial state; a moment at the start belongs to both days.
            before = [e for e in kept["events"] if e[0] < end]
            kept["events"] = [e for e in kept["events"] if e[0] >= end]
            lit = [e for e in before if e[1] == 0]
            locks = [e for e in before if e[1] == SCREEN]
            touched = [e for e in before if e[1] in (INPUT, FOCUS)]
            kept["lit"] = lit[-1][3] == "on" if lit else kept["lit"]
            kept["locked"] = locks[-1][3] == "lock" if locks else kept["locked"]
            kept["last_input"] = touched[-1][0] if touched else kept["last_input"]
            kept["network"] = known
        state.update((json.dumps(kept),))
        yield pd.DataFrame(rows, columns=["entity", "day", "first_ms", "last_ms", "label"])

    return run


def day_timelines(events: DataFrame, zone: str = "UTC", delay: str = "1 hour") -> DataFrame:
    """Timelines of days that the watermark has passed, from (entity, ts, time_ms, src_ord, seq, kind) events.

    A device's state is what its last finished day left, and the events since.
    """
    timed = events.withWatermark("ts", delay).groupBy("entity")
    return timed.applyInPandasWithState(_advance(zone), SCHEMA, "state string", "append", "EventTimeTimeout")
