"""Signal graphs: decayed weights, components, clusters and the dominant one."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CLUSTER_THRESHOLD, DAY, HALF_LIFE_DAYS
from ..tables import saved

#: Pairs of one group that are joined up by one task at most.
WITHIN = 100_000


def ordered_pair(a: Column, b: Column) -> tuple[Column, Column]:
    """Signals as an unordered pair: places (duet:) before networks, then by name."""
    rank = lambda x: F.struct((~x.startswith("duet:")).alias("n"), x.alias("id"))
    swap = rank(a) > rank(b)
    return F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)


def weight(total: Column, last_seen: Column, now: int, half_life_days: float = HALF_LIFE_DAYS) -> Column:
    """total, halved for each half-life since it was last seen."""
    return total * F.exp(F.lit(-math.log(2) / half_life_days) * (F.lit(now) - last_seen) / float(DAY))


def components(edges: DataFrame, by: tuple[str, ...] = ("entity",)) -> DataFrame:
    """(by..., node, root): root is the smallest node that edges (by..., a, b) reach, for every node on an edge.

    Labels spread to neighbours and then jump along the labels they point at, so rounds grow with the logarithm
    of the longest path. Each round is written to the shared folder: a lost executor costs no more than one.
    """
    keys = list(by)
    both = edges.select(*keys, "a", "b").unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = saved(both, "edges")
    now = saved(both.groupBy(*keys, F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(now.withColumnRenamed("node", "b"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hooked = now.join(near, [*keys, "node"]).select(*keys, "node", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        jump = hooked.select(*keys, F.col("node").alias("root"), F.col("root").alias("further"))
        after = saved(hooked.join(jump, [*keys, "root"], "left").select(*keys, "node", F.least("root", F.coalesce("further", "root")).alias("root"), "old"), "labels")
        if after.where("root <> old").isEmpty():
            return after.select(*keys, "node", "root")
        now = after.select(*keys, "node", "root")


def joined_up(edges: DataFrame, by: tuple[str, ...] = ("entity",), within: int = WITHIN) -> DataFrame:
    """components(), in one pass where the distinct pairs of every group ``by`` are counted to be no more than ``within``.

    A device's networks and places are few, however many events showed them; groups that are larger go the long way.
    """
    keys = list(by)
    pairs = saved(edges.select(*keys, "a", "b").distinct(), "pairs")
    most = pairs.groupBy(*keys).count().agg(F.max("count").alias("n")).first()["n"] or 0
    if most > within:
        return components(pairs, by)
    nodes = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*keys).schema.fields)

    def run(pdf):
        import pandas as pd

        root: dict[str, str] = {}

        def find(x: str) -> str:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in zip(pdf.a, pdf.b, strict=True):
            low, high = sorted((find(a), find(b)))
            root[high] = low
        out = pd.DataFrame({"node": list(root)})
        out["root"] = [find(x) for x in out.node]
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return pairs.groupBy(*keys).applyInPandas(run, f"{nodes}, node string, root string")


def representatives(labels: DataFrame, by: tuple[str, ...] = ("entity",)) -> DataFrame:
    """(by..., signal, cluster): each component is named after its first place, or else its first signal."""
    named = labels.groupBy(*by, "root").agg(F.min(F.struct((~F.col("node").startswith("duet:")).alias("n"), F.col("node").alias("id"))).alias("m"))
    return labels.join(named, [*by, "root"]).select(*by, F.col("node").alias("signal"), F.col("m.id").alias("cluster"))


def clusters(co: DataFrame, now: int, threshold: float = CLUSTER_THRESHOLD, by: tuple[str, ...] = ("entity",)) -> DataFrame:
    """Clusters of the signals on edges whose decayed weight reaches the threshold."""
    kept = co.where(weight(F.col("total_seconds"), F.col("last_seen"), now) >= threshold)
    return representatives(joined_up(kept.select(*by, F.col("signal_a").alias("a"), F.col("signal_b").alias("b")), by), by)


def subnet_groups(pairs: DataFrame, wifi: DataFrame, by: tuple[str, ...] = ("entity",)) -> DataFrame:
    """(by..., subnet, group_id): the smallest subnet of the component, for every subnet seen; one alone is its own."""
    labels = joined_up(pairs.select(*by, F.col("subnet_a").alias("a"), F.col("subnet_b").alias("b")), by).select(*by, F.col("node").alias("subnet"), "root")
    return wifi.where("subnet <> ''").select(*by, "subnet").distinct().join(labels, [*by, "subnet"], "left").select(*by, "subnet", F.coalesce("root", "subnet").alias("group_id"))


def dominant(co: DataFrame, of: DataFrame, now: int, by: tuple[str, ...] = ("entity",)) -> DataFrame:
    """(by..., dominant_id, weight): the cluster with the largest sum of edge weights; ties go to the smaller id.

    Every edge counts, for the clusters of both its ends, or once where they are one. Signals in no cluster
    stand for themselves. Without positive weight there is none.
    """
    rep = lambda side: of.select(*by, F.col("signal").alias(f"signal_{side}"), F.col("cluster").alias(f"rep_{side}"))
    edges = co.join(rep("a"), [*by, "signal_a"], "left").join(rep("b"), [*by, "signal_b"], "left")
    ends = F.array_distinct(F.array(F.coalesce("rep_a", "signal_a"), F.coalesce("rep_b", "signal_b")))
    sums = edges.select(*by, F.explode(ends).alias("id"), weight(F.col("total_seconds"), F.col("last_seen"), now).alias("w")).groupBy(*by, "id").agg(F.sum("w").alias("w"))
    best = sums.where("w > 0").groupBy(*by).agg(F.min(F.struct((-F.col("w")).alias("w"), F.col("id").alias("id"))).alias("m"))
    return best.select(*by, F.col("m.id").alias("dominant_id"), (-F.col("m.w")).alias("weight"))


def empty_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "entity string, signal_a string, signal_b string, total_seconds double, last_seen long")
