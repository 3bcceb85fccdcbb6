"""As-of joins: each probe gets the last event at or before it, by one sort of both sides together.

The union of probes and events is sorted within each entity and bin of time; what came before a bin is carried
into it. No pair of rows is formed and nothing is broadcast. Times are explicit in how ties are settled: events
come before or after probes of the same moment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import running, with_next


def asof(probes: DataFrame, events: DataFrame, *, on: str = "time_ms", event_time: str = "time_ms", order: tuple[str, ...] = ("seq",), strict: bool = False, by: tuple[str, ...] = ("entity",), name: str = "event") -> DataFrame:
    """probes with a struct column ``name``: the last row of ``events`` at or before (``strict``: before) ``on``, null if none.

    Events of the same moment are ordered by ``order``. Rows of either side whose time is null match nothing.
    """
    keys = list(by)
    value = F.struct(*[F.col(c) for c in events.columns if c not in keys])
    left = probes.select(*keys, F.struct(*[F.col(c) for c in probes.columns if c not in keys]).alias("__probe"), F.lit(None).cast(_type(events, keys)).alias("__event"), F.col(on).alias("__t"), F.lit(0 if strict else 2).alias("__side"), *[F.lit(None).cast(dict(events.dtypes)[c]).alias(f"__o{k}") for k, c in enumerate(order)])
    right = events.where(F.col(event_time).isNotNull()).select(*keys, F.lit(None).cast(_type(probes, keys)).alias("__probe"), value.alias("__event"), F.col(event_time).alias("__t"), F.lit(1).alias("__side"), *[F.col(c).alias(f"__o{k}") for k, c in enumerate(order)])
    sides = ("__side", *[f"__o{k}" for k in range(len(order))])
    joined = running(left.unionByName(right), by=by, time="__t", order=sides, lasts={"__found": F.col("__event")}, inclusive=True).where("__probe is not null")
    found = F.when(F.col("__t").isNotNull(), F.col("__found")).alias(name)
    return joined.select(*keys, "__probe.*", found)


def _type(df: DataFrame, keys: list[str]):
    from pyspark.sql.types import StructType

    return StructType([f for f in df.schema.fields if f.name not in keys])


def to_periods(points: DataFrame, now: int, order: tuple[str, ...] = ("seq",), by: tuple[str, ...] = ("entity",)) -> DataFrame:
    """Points as periods up to the next point; the last one runs to ``now``. first_ms is the point's time_ms."""
    ends = F.coalesce("last_ms", F.lit(now)).alias("last_ms")
    return with_next(points, "last_ms", by=by, order=order).select(F.col("time_ms").alias("first_ms"), *[c for c in points.columns if c != "time_ms"], ends)


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row for each key: the first in the order given."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
