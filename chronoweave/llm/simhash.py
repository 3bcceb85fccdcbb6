"""SimHash near-duplicates: exact comparison of fingerprints within a radius, in tiles, with numpy XOR and bit counts.

Fingerprints are compared once each, however many documents share one. Two that differ in at most three bits
agree in one of four 16-bit blocks, and in one of four 12-bit parts of the rest: these pairs of equal parts
are the keys under which fingerprints meet, so no pair within the radius is missed and no bucket is capped.
Within a bucket, tiles sorted by population count are compared, but for tile pairs whose counts differ by
more than the radius. A bucket yields a spanning forest of its links, not its pairs. A bucket of too many
fingerprints is dealt again by quarters of the bits that its key leaves open, one of which has to be equal, too: so
no bucket is compared by one task but one that is small, or as small as the few bits left allow.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, save, table, width

RADIUS = 3
TILE = 1024
#: Fingerprints that a bucket may hold before it is dealt again.
BUCKET = 1 << 15
#: Nodes whose edges may be joined by broadcast.
BROADCAST_NODES = 1 << 17
#: Lower-cases A-Z.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """A signed 64-bit fingerprint for each text."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    for k, text in enumerate(texts):
        words = (text or "").encode().translate(LOWER).split()
        if not words:
            continue
        if len(words) < 3:
            hashes = [digest(b" ".join(words), 42)]
        else:
            hashes = [digest(s, 42) for s in map(b" ".join, zip(words, words[1:], words[2:]))]
        h = np.array(hashes, np.uint64)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 65_536):
            ones += np.unpackbits(h[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]
    return out.view(np.int64)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1024), pa.array(fingerprints(batch.column(1).slice(at, 1024).to_pylist()), pa.int64())], names=["doc_id", "fp"])


def _keys(fp: Column) -> Column:
    """Sixteen long keys: the block's number and value, then the part's number and value."""
    keys = []
    for j in range(4):
        block = F.shiftrightunsigned(fp, 16 * j).bitwiseAND(F.lit(0xFFFF))
        low = fp.bitwiseAND(F.lit((1 << 16 * j) - 1)) if j else F.lit(0).cast("long")
        high = F.shiftrightunsigned(fp, 16 * (j + 1)) if j < 3 else F.lit(0).cast("long")
        rest = low.bitwiseOR(F.shiftleft(high, 16 * j)) if j else high
        for k in range(4):
            part = F.shiftrightunsigned(rest, 12 * k).bitwiseAND(F.lit(0xFFF))
            keys.append(F.lit((4 * j + k) << 28).bitwiseOR(F.shiftleft(block.cast("long"), 12)).bitwiseOR(part.cast("long")))
    return F.array(*keys)


def forest(fps: np.ndarray, radius: int = RADIUS, tile: int = TILE) -> list[tuple[int, int]]:
    """Edges (member, root) of a spanning forest of the links among distinct fingerprints, by place in ``fps``."""
    n, bits = len(fps), fps.view(np.uint64)
    if n == 2:
        return [(1, 0)] if np.bitwise_count(bits[0] ^ bits[1]) <= radius else []
    count = np.bitwise_count(bits)
    order = np.argsort(count, kind="stable")
    value, count = bits[order], count[order].astype(np.int64)
    parent = np.arange(n)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(xs, ys) -> None:
        for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
            p, q = root(x), root(y)
            parent[max(p, q)] = min(p, q)

    for a in range(0, n, tile):
        end = min(a + tile, n)
        for b in range(a, n, tile):
            if count[b] - count[end - 1] > radius:
                break
            near = np.bitwise_count(value[a:end, None] ^ value[None, b : b + tile]) <= radius
            x, y = np.nonzero(near)
            if len(x) <= 4096:
                join(a + x, b + y)
                continue
            # Many links: every row takes the least label it meets, then every column, until labels stay.
            while True:
                while (parent[parent] != parent).any():
                    parent = parent[parent]
                top, side = parent[a:end], parent[b : b + tile]
                row = np.minimum(top, np.where(near, side[None, :], n).min(axis=1))
                column = np.minimum(side, np.where(near, row[:, None], n).min(axis=0))
                moved, shifted = np.flatnonzero(row < top), np.flatnonzero(column < side)
                if not len(moved) and not len(shifted):
                    break
                was = np.concatenate([top[moved], side[shifted]])
                join(was, np.concatenate([row[moved], column[shifted]]))
    return [(int(order[x]), int(order[root(x)])) for x in np.flatnonzero(parent != np.arange(n)).tolist()]


def open_bits(path: int) -> np.ndarray:
    """Bits of a fingerprint that the buckets of a path leave open.

    A path is 16 and the number of the first key, then two bits for the quarter of each finer dealing.
    """
    quarters = []
    while path >= 32:
        quarters.append(path & 3)
        path >>= 2
    block, part = path - 16 >> 2, path & 3
    bits = np.delete(np.arange(64), np.arange(16 * block, 16 * block + 16))
    bits = np.delete(bits, np.arange(12 * part, 12 * part + 12))
    for k in reversed(quarters):
        bits = np.setdiff1d(bits, np.array_split(bits, RADIUS + 1)[k])
    return bits


LINKS = "kind int, a long, b long, path long"
LINK, AGAIN = 0, 1


def _links(radius: int, tile: int, bucket: int, first: bool):
    """From rows (key, fp, node, and path but for the first dealing) sorted by path and key: links between nodes, and (fp, node, path) of buckets to be dealt again."""

    def emit(kind: int, a, b, path) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), path, np.int64))], names=["kind", "a", "b", "path"])

    def links(fp: np.ndarray, node: np.ndarray) -> list[tuple[int, int]]:
        return [(int(node[x]), int(node[y])) for x, y in forest(fp, radius, tile)] if len(fp) > 1 else []

    def run(batches):
        name, held, over = None, [], False

        def close() -> list[tuple[int, int]]:
            nonlocal held, over
            found = links(*(np.concatenate(x) for x in zip(*held, strict=True))) if held else []
            held, over = [], False
            return found

        for batch in batches:
            if not batch.num_rows:
                continue
            key, fp, node = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            path = 16 + (key >> 28) if first else batch.column(3).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((key[1:] != key[:-1]) | (path[1:] != path[:-1])) + 1
            begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
            size, last = end - begin, len(begin) - 1
            rows = []
            for k in np.flatnonzero((size > 1) & (size <= bucket)).tolist():
                if 0 < k < last:
                    rows += links(fp[begin[k] : end[k]], node[begin[k] : end[k]])
            for k in sorted({0, last, *np.flatnonzero(size > bucket).tolist()}):
                at, this = begin[k], (int(path[begin[k]]), int(key[begin[k]]))
                if this != name:
                    rows += close()
                    name = this
                held.append((fp[at : end[k]].copy(), node[at : end[k]].copy()))
                # Of a bucket with few open bits there is no more than can be compared.
                n_open = len(open_bits(this[0]))
                if over or sum(len(x[0]) for x in held) > bucket and n_open > 7 and 1 << n_open > bucket:
                    for x, nodes in held:
                        for quarter in range(RADIUS + 1):
                            yield emit(AGAIN, x, nodes, this[0] << 2 | quarter)
                    held, over = [], True
            yield emit(LINK, [r[0] for r in rows], [r[1] for r in rows], 0)
        rows = close()
        yield emit(LINK, [r[0] for r in rows], [r[1] for r in rows], 0)

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, node, path) of (fp, node, path): the key is what the path fixes of the fingerprint."""
    for batch in batches:
        fp, path = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)
        key = np.zeros(len(fp), np.uint64)
        for p in np.unique(path).tolist():
            mask = (1 << 64) - 1 - sum(1 << int(k) for k in open_bits(p))
            key = np.where(path == p, fp & np.uint64(mask), key)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *batch.columns], names=["key", "fp", "node", "path"])


def links_of(nodes: DataFrame, partitions: int, radius: int = RADIUS, tile: int = TILE, bucket: int = BUCKET) -> DataFrame:
    """(a, b) links between the nodes of (fp, node) rows, which join up what all links within the radius do."""
    dealt = nodes.select(F.explode(_keys(F.col("fp"))).alias("key"), "fp", "node").repartition(partitions, "key").sortWithinPartitions("key")
    found = []
    while True:
        met, _ = save(dealt.mapInArrow(_links(radius, tile, bucket, not found), LINKS), "links")
        found.append(met.where(F.col("kind") == LINK).select("a", "b"))
        over = met.where(F.col("kind") == AGAIN)
        if over.isEmpty():
            return reduce(DataFrame.unionByName, found)
        finer = over.select(F.col("a").alias("fp"), F.col("b").alias("node"), "path").mapInArrow(_keyed, "key long, fp long, node long, path long")
        dealt = finer.repartition(partitions, "path", "key").sortWithinPartitions("path", "key")


def _with_least(edges: DataFrame, total: int, limit: int) -> DataFrame:
    """Edges (a, b) with m, the least b of their a.

    Of many edges, nodes that hold one in ``limit`` of them are broadcast, which are no more than that; the others, none of which
    has many edges then, meet theirs by shuffle.
    """
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    if total <= limit:
        return edges.join(least.drop("n"), "a")
    hubs = F.broadcast(least.where(F.col("n") * limit >= total).drop("n"))
    rest = edges.join(hubs.select("a"), "a", "left_anti").join(least.where(F.col("n") * limit < total).drop("n"), "a")
    return edges.join(hubs, "a").unionByName(rest)


def components(edges: DataFrame, limit: int = BROADCAST_NODES) -> DataFrame:
    """(node, component): the smallest node reachable, for the nodes of (a, b) edges that aren't it.

    Each round hangs every node and its larger neighbours on the smallest neighbour, large stars and small
    stars in turn, until nothing changes. Rounds grow with the logarithm of the longest path. Each round is
    written as a table, groups of neighbours are only summed, never gathered, and no hub's edges are one task.
    """
    spark = edges.sparkSession
    now, at = save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    total = now.count()
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, 2 * total, limit).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        joined = _with_least(large, total, limit)
        small = joined.select(F.col("a"), F.col("m").alias("b")).unionByName(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        after, path = save(small, "edges")
        # A forest of stars, each on its smallest node, has no node that is hung and hung on.
        hung = after.select(F.col("a").alias("b")).distinct()
        done = after.join(hung, "b", "left_semi").isEmpty() and after.groupBy("a").count().where("count > 1").isEmpty()
        drop(spark, at)
        now, at = after, path
        if done:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tile: int = TILE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint and component_id for each row of (doc_id, text).

    Texts without words, null ones among them, have fingerprint zero and link like any others. Rows that
    share a doc_id count each on its own text. Rows without doc_id are fingerprinted, link nothing and have a
    null component. Other columns are ignored.
    """
    if radius != RADIUS:
        raise ValueError("the keys hold for a radius of three")
    spark = docs.sparkSession
    prints, _ = save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_prints, "doc_id long, fp long"), "prints")
    nodes, nodes_at = save(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    # A document id can be the least of several fingerprints if rows share it; its links then join them, as they should.
    found = components(links_of(nodes, width(docs), radius, tile, bucket))
    of_print = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    out = prints.join(of_print, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    return out


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
