"""Removal of repeated 100-byte strings by prefix doubling over sampled suffixes.

Plain prefix doubling sorts a (rank, rank) pair for every byte at every offset. Here the doubling up to 32
bytes is done where the text is, by hash names: the name at 2k is made of the names at k of a position and of
the position k further. Of each 100-byte window, only the position of least 32-byte name is ranked by Spark, and
neighbouring windows that choose the same position form one block, so about one position in thirty-five is sorted.

Rank one: positions are sorted by 32-byte name and by the name of their whole block. Positions whose 32-byte
name is unique end there. A block seen before is repeated as a whole. Blocks of one 32-byte name that differ are
compared by the next doubling: a window reaches 32 bytes beyond its position's string to the right, or to the
left, so where neither 64-byte name comes twice its windows end, too. Rank two: the windows left are named at
100 bytes, the threshold, and sorted again. Equal windows choose equal positions, so no repeat is missed.
Names are pairs of 64-bit hashes; those at 64 bytes are short ones, as they only rule windows out.

A 32-byte name that very many blocks hold, as of a licence line, is found by a sample beforehand. Its blocks are dealt
by the names of whole blocks, and where they differ their sides are counted by an aggregation, so no name is one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, table, width

LENGTH = 100
SEED_LENGTH = 32
CHUNK = 1 << 18
#: Blocks of one name that a task is to hold at most, about; the documents of the sample, or a 1024th of all; names found by it at most.
HOT_ROWS, SAMPLE, HOT_NAMES = 1 << 15, 1 << 12, 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)
ODD2 = np.uint64(0xD6E8FEB86659FD93)
PLACE = np.uint64((1 << 24) - 1)
BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def double(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Name of two strings' concatenation from their names."""
    out = a * ODD
    out += b
    out ^= out >> np.uint64(29)
    out *= ODD2
    out ^= out >> np.uint64(32)
    return out


def names(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of all strings of 32, of 64 and of 100 bytes, by start."""
    by = {1: BYTES[text]}
    k = 1
    while k < 64:
        by[2 * k] = double(by[k][:-k], by[k][k:])
        k *= 2
    n = len(text) - LENGTH + 1
    # 100 = 64 + 32 + 4
    return by[32], by[64], double(double(by[64][:n], by[32][64 : 64 + n]), by[4][96 : 96 + n])


def anchors(seeds: np.ndarray) -> np.ndarray:
    """For each window of 100 bytes, the place of the least 32-byte name in it, the leftmost of equals."""
    least = seeds & ~PLACE | np.arange(len(seeds), dtype=np.uint64)
    k = 1
    while k < 64:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    extra = LENGTH - SEED_LENGTH + 1 - 64
    return (np.minimum(least[:-extra], least[extra:]) & PLACE).astype(np.int64)


def blocks(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text number, start, windows, seed name, block name, sides) of the blocks of these texts, which windows don't cross.

    Sides packs 28 bits of the 64-byte names that end and begin with the seed's string, and its place in the block.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    lens = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(lens) - lens
    counts = np.maximum(lens - LENGTH + 1, 0)
    total = int(counts.sum())
    if not total:
        empty = np.zeros(0, np.int64)
        return (empty,) * 6
    seeds, doubles, wholes = names(data)
    own = np.repeat(np.arange(len(texts)), counts)
    p = np.repeat(begin - np.cumsum(counts) + counts, counts) + np.arange(total)
    at = anchors(seeds)[p]
    edge = np.flatnonzero((at[1:] != at[:-1]) | (own[1:] != own[:-1])) + 1
    first, last = np.concatenate([[0], edge]), np.concatenate([edge, [total]]) - 1
    p1, p2, q = p[first], p[last], at[first]
    shape = ((p2 - p1) << 8 | (q - p1)).astype(np.uint64)
    # The first and the last window overlap: their names and places name every byte of the block.
    block = double(double(wholes[p1], wholes[p2]), shape)
    doc = own[first]
    # A side that no window of the block reaches is never asked for; its place is kept within the data.
    left = doubles[np.maximum(q - SEED_LENGTH, 0)] >> np.uint64(36)
    right = doubles[np.minimum(q, len(doubles) - 1)] >> np.uint64(36)
    sides = (left << np.uint64(35) | right << np.uint64(7) | (q - p1).astype(np.uint64)).view(np.int64)
    return doc, p1 - begin[doc], p2 - p1 + 1, seeds[q].view(np.int64), block.view(np.int64), sides


SCHEMA = "kind int, a long, b long, key long, p long, n long, c long"
TO_RANK, REPEATED, UNDECIDED, HOT = 0, 1, 2, 3


def _batch(kind, a, b, key, p, n, c) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(kind, len(key)).astype(np.int32)), *(pa.array(np.asarray(x, np.int64)) for x in (a, b, key, p, n, c))], names=["kind", "a", "b", "key", "p", "n", "c"])


def _first_here(a, b, key, p, n, c, hot: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of one name meet first in their batch: only the earliest is ranked, the others are repeats for certain.

    Repeats that follow each other become one run, and get a name that spreads them over the partitions.
    """
    order = np.lexsort((p, key, b, a))
    again = np.zeros(len(a), bool)
    again[1:] = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]])
    once, more = order[~again], order[again]
    kind = TO_RANK if hot is None else np.where(np.isin(a[once], hot), HOT, TO_RANK)
    yield _batch(kind, *(x[once] for x in (a, b, key, p, n, c)))
    if len(more):
        key, p, n = runs(key[more], p[more], n[more])
        zero = np.zeros(len(key), np.int64)
        yield _batch(REPEATED, (key.view(np.uint64) * ODD).view(np.int64), zero, key, p, n, zero)


def runs(key: np.ndarray, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that follow each other in a text, as one row."""
    order = np.lexsort((p, key))
    key, p, n = key[order], p[order], n[order]
    starts = np.ones(len(key), bool)
    starts[1:] = (key[1:] != key[:-1]) | (p[1:] != p[:-1] + n[:-1])
    at = np.flatnonzero(starts)
    return key[at], p[at], np.add.reduceat(n, at)


def _pieces(text: bytes, size: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """(start, bytes) of pieces of at most ``size`` bytes, each window of the text in exactly one of them."""
    for at in range(0, max(len(text) - LENGTH + 1, 1), size - LENGTH + 1):
        yield at, text[at : at + size] if len(text) > size else text


def _grouped(texts: list, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end]) <= size):
            total += len(texts[end])
            end += 1
        yield at, end
        at = end


def _blocks(hot: np.ndarray | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            # Pieces are far shorter than PLACE can count.
            pieces = [(k, at, piece) for k, t in enumerate(batch.column(1).to_pylist()) for at, piece in _pieces((t or "").encode())]
            owner, begin = (np.array([x[c] for x in pieces], np.int64) for c in (0, 1))
            texts = [x[2] for x in pieces]
            parts = []
            for s, e in _grouped(texts):
                doc, p, n, seed, block, sides = blocks(texts[s:e])
                parts.append((seed, block, keys[owner[s:e][doc]], begin[s:e][doc] + p, n, sides))
            if parts:
                yield from _first_here(*(np.concatenate(x) for x in zip(*parts, strict=True)), hot)

    return run


def open_windows(group, a, b, key, p, n, c) -> tuple[np.ndarray, ...]:
    """Of the first blocks of each name, the windows that another block of the group may hold, too.

    A window that begins at most 36 bytes before its position reaches 32 bytes beyond the position's string, and
    one that begins at least 32 bytes before it holds the 32 bytes left of it: that side's name must come twice.
    """
    bits = np.uint64(28)
    sides = c.view(np.uint64)
    twice = []
    for shift in (35, 7):
        side = group.astype(np.uint64) << bits | sides >> np.uint64(shift) & np.uint64((1 << 28) - 1)
        _, which, many = np.unique(side, return_inverse=True, return_counts=True)
        twice.append(many[which] > 1)
    left, right = twice
    q = p + (c & 127)
    room = LENGTH - SEED_LENGTH - 32
    first = np.where(left, p, np.maximum(p, q - room))
    last = np.where(right, p + n - 1, np.minimum(p + n - 1, q - 32))
    keep = (left | right) & (last >= first)
    return a[keep], b[keep], key[keep], first[keep], (last - first + 1)[keep], c[keep]


def _rank(undecided: bool):
    """Over rows sorted by (a, b, key, p): all but the first of a name (a, b) are repeated; where blocks of one ``a`` differ, windows of the firsts stay undecided, or the firsts of hot names whole."""

    def ranked(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        kind, a, b, key, p, n, c = rows
        fresh_a = np.ones(len(a), bool)
        fresh_a[1:] = a[1:] != a[:-1]
        fresh = fresh_a.copy()
        fresh[1:] |= b[1:] != b[:-1]
        again = np.flatnonzero(~fresh)
        if len(again):
            k, at, many = runs(key[again], p[again], n[again])
            zero = np.zeros(len(k), np.int64)
            yield _batch(REPEATED, zero, zero, k, at, many, zero)
        if undecided:
            for some, was_hot in ((kind != HOT, False), (kind == HOT, True)):
                firsts = [x[fresh & some] for x in rows[1:]]
                if len(firsts[0]):
                    yield _batch(HOT, *firsts) if was_hot else _batch(UNDECIDED, *open_windows(np.cumsum(fresh_a)[fresh & some], *firsts))

    def run(batches):
        held: list[list[np.ndarray]] = []
        for batch in batches:
            rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(7)]
            known = rows[0] == REPEATED
            if known.any():
                yield _batch(REPEATED, *(x[known] for x in rows[1:]))
                rows = [x[~known] for x in rows]
            if not len(rows[0]):
                continue
            # The last name may go on in the next batch: a name of blocks where no ``a`` has to be looked at whole.
            same = rows[1] == rows[1][-1]
            if not undecided or rows[0][-1] == HOT:
                same &= rows[2] == rows[2][-1]
            last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if last:
                yield from ranked([np.concatenate(x) for x in zip(*held, [x[:last] for x in rows], strict=True)])
                held = []
            held.append([x[last:].copy() for x in rows])
        if held:
            yield from ranked([np.concatenate(x) for x in zip(*held, strict=True)])

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """100-byte names of the windows of undecided blocks: rows (key, text, blocks)."""
    for batch in batches:
        parts = []
        for key, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            p, n, a = (found.values.field(k).to_numpy(zero_copy_only=False) for k in ("p", "n", "a"))
            wholes = np.concatenate([names(np.frombuffer(piece, np.uint8))[2] for _, piece in _pieces((text or "").encode())]).view(np.int64)
            at = np.repeat(p - np.cumsum(n) + n, n) + np.arange(n.sum())
            parts.append((wholes[at], np.repeat(a, n), np.full(len(at), key, np.int64), at, np.ones(len(at), np.int64), np.zeros(len(at), np.int64)))
        if parts:
            yield from _first_here(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def removal(text: bytes, p: np.ndarray, n: np.ndarray) -> tuple[int, int, bytes]:
    """Bytes removed, runs removed and what is left, from runs of repeated windows."""
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, p, 1)
    np.add.at(change, p + n + LENGTH - 1, -1)
    gone = np.cumsum(change[:-1]) > 0
    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes()


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            data = (text.as_py() or "").encode()
            if found.is_valid:
                n_removed, spans, kept = removal(data, *(found.values.field(k).to_numpy(zero_copy_only=False) for k in ("p", "n")))
            else:
                n_removed, spans, kept = 0, 0, data
            out.append((doc, len(data), n_removed, spans, kept))
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(x, pa.int64()) for x in list(zip(*out, strict=True))[:4]), pa.array([hashlib.sha256(x[4]).hexdigest() for x in out], pa.string()), pa.array([x[4] for x in out], pa.binary())] if out else [pa.array([], t) for t in (*[pa.int64()] * 4, pa.string(), pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def _lists(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows of each document as a list: as many as its text is long at most."""
    return rows.groupBy("key").agg(F.collect_list(F.struct(*columns)).alias("found"))


def numbered(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text), the key telling rows apart in the order of their doc_ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    same = rows.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if same.isEmpty():
        return rows.select(F.col("doc_id").alias("key"), "doc_id", "text")
    return save(rows.orderBy("doc_id", "text").withColumn("key", F.monotonically_increasing_id()).select("key", "doc_id", "text"), "numbered")[0]


def hot_names(rows: DataFrame, hot_rows: int = HOT_ROWS) -> np.ndarray | None:
    """32-byte names that about ``hot_rows`` blocks or more hold, sorted, by a sample of the documents; None of fewer documents.

    Which names it finds changes the dealing of blocks, not the result.
    """
    n = rows.count()
    if n < hot_rows:
        return None
    rate = min(1.0, max(SAMPLE / n, 1 / 1024))
    some = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < round(rate * (1 << 20))).select("key", "text")
    counted = some.mapInArrow(_blocks(), SCHEMA).where(F.col("kind") == TO_RANK).groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= max(8, round(hot_rows * rate)))
    found = counted.orderBy(F.desc("n"), "a").limit(HOT_NAMES).select("a").collect()
    return np.sort(np.array([r.a for r in found], np.int64)) if found else None


def _open_by_counts(first: DataFrame) -> DataFrame:
    """Windows of the first blocks of hot names that another block may hold, too.

    A window that begins at least 32 bytes before its position holds the 32 bytes left of it, any other one reaches 32
    bytes beyond the position's string: that side's name must come twice.
    """
    q, end = F.expr("p + (c & 127)"), F.col("p") + F.col("n") - 1
    left = F.struct(F.lit(0).alias("side"), F.expr("shiftrightunsigned(c, 35) & 268435455").alias("name"), F.col("p").alias("first"), F.least(end, q - SEED_LENGTH).alias("last"))
    right = F.struct(F.lit(1).alias("side"), F.expr("shiftrightunsigned(c, 7) & 268435455").alias("name"), F.greatest(F.col("p"), q - SEED_LENGTH + 1).alias("first"), end.alias("last"))
    sides = first.where(F.col("kind") == HOT).select("key", "a", F.explode(F.array(left, right)).alias("s")).select("key", "a", "s.*").where("last >= first")
    twice = sides.groupBy("a", "side", "name").count().where("count > 1").drop("count")
    return sides.join(twice, ["a", "side", "name"], "left_semi").select("key", F.col("first").alias("p"), F.expr("last - first + 1").alias("n"), "a")


def repeated_runs(rows: DataFrame, partitions: int, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, list[str]]:
    """(key, p, n): n windows from p on that start earlier, too; and the tables it reads."""
    hot = hot_names(rows, hot_rows)
    route = F.col("a") if hot is None else F.when(F.col("kind") == HOT, F.xxhash64("a", "b")).otherwise(F.col("a"))
    ranked = rows.select("key", "text").mapInArrow(_blocks(hot), SCHEMA).repartition(partitions, route).sortWithinPartitions("a", "b", "key", "p").mapInArrow(_rank(True), SCHEMA)
    first, first_at = save(ranked, "rank32")
    undecided = first.where(F.col("kind") == UNDECIDED).select("key", "p", "n", "a")
    open_ = _lists(undecided if hot is None else undecided.unionByName(_open_by_counts(first)), "p", "n", "a")
    windows = rows.select("key", "text").join(open_.hint("shuffle_hash"), "key").select("key", "text", "found").mapInArrow(_windows, SCHEMA)
    second, second_at = save(windows.repartition(partitions, "a", "b").sortWithinPartitions("a", "b", "key", "p").mapInArrow(_rank(False), SCHEMA), "rank100")
    return first.where(F.col("kind") == REPEATED).select("key", "p", "n").unionByName(second.where(F.col("kind") == REPEATED).select("key", "p", "n")), [first_at, second_at]


def remove_repeats(docs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of each (doc_id, text) row.

    Texts are UTF-8 bytes; null ones are empty. Texts under 100 bytes keep all. Rows that share a doc_id count
    as documents one after the other, in the order of their texts; rows without doc_id come first. Other columns
    are ignored.
    """
    rows = numbered(docs)
    runs, _ = repeated_runs(rows, width(docs, 2), hot_rows)
    found = rows.join(_lists(runs, "p", "n").hint("shuffle_hash"), "key", "left").select("doc_id", "text", "found")
    return found.mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
