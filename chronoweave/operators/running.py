"""Running values over a key's whole history, dealt by key and bin of time.

A window over a key's history sorts that key in one task. Here each bin's last values, sums and maxima are
aggregated first; they are carried from bin to bin in a window over bins, which are as many as days; and each
bin starts with a row that holds what came before it. So a key with a third of all rows is spread over its bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DAY


def time_bin(time: str, size: int) -> Column:
    return F.floor(F.col(time) / size).cast("long")


def running(
    df: DataFrame, *, by: tuple[str, ...] = ("entity",), time: str = "time_ms", order: tuple[str, ...] = (), lasts: dict[str, Column] | None = None, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, inclusive: bool = False, size: int = DAY
) -> DataFrame:
    """df with a column for each name: the last non-null value, sum or maximum of the key's rows before the row, or up to it if ``inclusive``.

    Rows are ordered by ``time`` (a number of milliseconds), then ``order``; null where there is no value yet.
    Rows of null key count as one key, and rows of null time come first, as in a window. Rows that tie in all of
    the order come in any order.
    """
    lasts, sums, maxima = lasts or {}, sums or {}, maxima or {}
    names = [*lasts, *sums, *maxima]
    hidden = {n: f"__v{k}" for k, n in enumerate(names)}
    at = F.struct(time, *order)
    binned = df.select("*", time_bin(time, size).alias("__bin"), *[v.alias(hidden[n]) for n, v in {**lasts, **sums, **maxima}.items()])
    value = {n: F.col(h) for n, h in hidden.items()}
    of_bin = [F.max_by(value[n], F.when(value[n].isNotNull(), at)) for n in lasts] + [F.sum(value[n]) for n in sums] + [F.max(value[n]) for n in maxima]
    per = binned.groupBy(*by, "__bin").agg(*[x.alias(hidden[n]) for n, x in zip(names, of_bin, strict=True)])

    def over(w) -> list[Column]:
        return [F.last(value[n], ignorenulls=True).over(w) for n in lasts] + [F.sum(value[n]).over(w) for n in sums] + [F.max(value[n]).over(w) for n in maxima]

    bins = Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select(*by, "__bin", *[x.alias(hidden[n]) for n, x in zip(names, over(bins), strict=True)], F.lit(False).alias("__row"))
    both = binned.withColumn("__row", F.lit(True)).unionByName(carried, allowMissingColumns=True)
    w = Window.partitionBy(*by, "__bin").orderBy("__row", time, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    return both.select(*df.columns, "__row", *[x.alias(n) for n, x in zip(names, over(w), strict=True)]).where("__row").drop("__row")


def with_next(df: DataFrame, name: str, *, by: tuple[str, ...] = ("entity",), time: str = "time_ms", order: tuple[str, ...] = (), value: Column | None = None, size: int = DAY) -> DataFrame:
    """df with the time of the key's next row, or with ``value`` as it is there, null in the last one; ordered as in ``running``."""
    value = F.col(time) if value is None else value
    binned = df.withColumn("__bin", time_bin(time, size)).withColumn("__value", value)
    per = binned.groupBy(*by, "__bin").agg(F.min_by("__value", F.struct(time, *order)).alias("__value"))
    carried = per.select(*by, "__bin", F.lead("__value").over(Window.partitionBy(*by).orderBy("__bin")).alias("__value"), F.lit(True).alias("__after"))
    both = binned.withColumn("__after", F.lit(False)).unionByName(carried, allowMissingColumns=True)
    w = Window.partitionBy(*by, "__bin").orderBy("__after", time, *order)
    return both.withColumn(name, F.lead("__value").over(w)).where("not __after").drop("__bin", "__after", "__value")
