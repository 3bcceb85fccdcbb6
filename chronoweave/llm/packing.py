"""Lexical retrieval packing: a sharded BM25 index gives each seed document its nearest unused documents, which fill its window.

Terms are token ids. Document frequencies and the mean length come from the whole corpus; the index itself
is built for each shard: documents are dealt by range of a min-hash of their token pairs, so copies and near
texts meet, and every shard has about as many documents however large a group of copies is. What fills whole windows
of a long document needs no neighbours and is cut off beforehand; its rest is dealt, so no row is longer than a window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, table, width
from .tokens import END_ID, VOCABULARY, encoder

WINDOW = 4096
K1, B = 1.2, 0.75
#: A shard ends with the document that reaches either bound.
SHARD_TOKENS, SHARD_DOCS = 1 << 21, 1 << 14
#: Terms in one of so many documents of a shard have a row of impacts instead of postings.
DENSE = 16
#: Sequence ids of whole windows of long documents start here.
WHOLE = 1 << 62


def _signature(ids: np.ndarray) -> int:
    """Min-hash of the pairs of neighbouring ids."""
    pairs = ids[:-1].astype(np.uint64) << np.uint64(32) | ids[1:]
    if not len(pairs):
        return -1
    mixed = pairs * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    return int((mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(1)).min())


def _tokenise(path: str, end_id: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sequence = encoder(path), WHOLE | TaskContext.get().partitionId() << 40
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                raw = [x + end for x in enc.encode(batch.column(1).slice(at, 512).to_pylist())]
                ids = [np.frombuffer(x, enc.dtype) for x in raw]
                crcs = [[zlib.crc32(x[k : k + window].astype("<u4").tobytes()) for k in range(0, len(x) - window + 1, window)] for x in ids]
                firsts = sequence + np.cumsum([0, *map(len, crcs)])
                sequence = int(firsts[-1])
                columns = [batch.column(0).slice(at, 512), pa.array([_signature(x) for x in ids], pa.int64()), pa.array(raw, pa.binary()), pa.array(crcs, pa.list_(pa.int64())), pa.array(firsts[:-1], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "sig", "ids", "crcs", "sequence"])

    return run


def _statistics(size: int, dtype: str):
    """Documents with each id; at -1 the documents, at -2 their ids."""

    def run(batches):
        seen, docs, tokens = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            for raw in batch.column(0):
                ids = np.frombuffer(raw.as_py(), dtype)
                seen[np.unique(ids)] += 1
                docs, tokens = docs + 1, tokens + len(ids)
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *found.tolist()], pa.int64()), pa.array([docs, tokens, *seen[found].tolist()], pa.int64())], names=["id", "n"])

    return run


class Index:
    """BM25 postings of one shard, by term, and the terms of each document."""

    def __init__(self, texts: list[np.ndarray], idf: np.ndarray, mean: float):
        found = [np.unique(ids, return_counts=True) for ids in texts]
        self.queries = [t for t, _ in found]
        term, tf = (np.concatenate(x) for x in zip(*found, strict=True))
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in self.queries])
        self.size = np.array([len(x) for x in texts])
        norm = K1 * (1 - B + B * self.size / mean)
        order = np.argsort(term, kind="stable")
        term, tf, doc = term[order], tf[order], doc[order]
        impact = (idf[term] * tf * (K1 + 1) / (tf + norm[doc])).astype(np.float32)
        self.terms, begin, n = np.unique(term, return_index=True, return_counts=True)
        # Postings of common terms as rows, those of the others as lists.
        common = n * DENSE >= len(texts)
        self.row = np.where(common, np.cumsum(common) - 1, -1)
        self.rows = np.zeros((int(common.sum()), len(texts)), np.float32)
        at = np.repeat(common, n)
        self.rows[np.repeat(self.row, n)[at], doc[at]] = impact[at]
        self.doc, self.impact = doc[~at], impact[~at]
        self.begin = np.concatenate([[0], np.cumsum(np.where(common, 0, n))])
        self.unused = np.ones(len(texts), bool)

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of all documents for all distinct terms of the seed, each of weight one."""
        k = np.searchsorted(self.terms, self.queries[seed])
        row, n = self.row[k], self.begin[k + 1] - self.begin[k]
        at = np.repeat(self.begin[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.doc[at], self.impact[at], len(self.unused)) + self.rows[row[row >= 0]].sum(axis=0)

    def neighbours(self, seed: int, room: int) -> list[int]:
        """Unused documents by falling score, ties by place, as many as fill ``room`` ids, or all that share a term with the seed."""
        score = self.scores(seed)
        near = np.flatnonzero(self.unused & (score > 0))
        some = 64
        while True:
            best = near
            if some < len(near):
                least = np.partition(score[near], len(near) - some)[len(near) - some]
                best = near[score[near] >= least]
            best = best[np.argsort(-score[best], kind="stable")]
            filled = np.cumsum(self.size[best])
            if len(best) == len(near) or filled[-1] >= room:
                return best[: int(np.searchsorted(filled, room)) + 1].tolist()
            some *= 8


class Packer:
    """Fills windows piece by piece. What is left in the last window is cut at powers of two, so nothing is padded."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence, self.fill, self.open, self.rows = window, first_sequence, 0, [], []

    def add(self, doc, ids: np.ndarray, before: int = 0) -> None:
        """Take a document's ids, ``before`` of which are packed already."""
        at = 0
        while at < len(ids):
            n = min(len(ids) - at, self.window - self.fill)
            self.open.append((doc, before + at, ids[at : at + n], before + len(ids)))
            at, self.fill = at + n, self.fill + n
            if self.fill == self.window:
                self._close(self.window)

    def _close(self, size: int) -> None:
        """The first ``size`` ids that are open become a sequence."""
        offset, rest = 0, []
        for doc, start, ids, total in self.open:
            n = min(len(ids), size - offset)
            if n:
                self.rows.append((doc, start, n, zlib.crc32(ids[:n].astype("<u4").tobytes()), total, self.sequence, offset))
            if n < len(ids):
                rest.append((doc, start + n, ids[n:], total))
            offset += n
        self.open, self.fill, self.sequence = rest, self.fill - size, self.sequence + 1

    def finish(self) -> None:
        while self.fill:
            self._close(1 << self.fill.bit_length() - 1)

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 7)], names=PIECE_NAMES)


PIECE_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
PIECES = ", ".join(f"{x} long" for x in PIECE_NAMES)


def pack_shard(docs: list, texts: list[np.ndarray], idf: np.ndarray, mean: float, packer: Packer) -> None:
    """Pack one shard of (doc_id, ids before) pairs and their ids. The document that a window cuts seeds the next one."""
    index, at, seed = Index(texts, idf, mean), 0, None

    def use(k: int) -> None:
        index.unused[k] = False
        packer.add(docs[k][0], texts[k], docs[k][1])

    while True:
        if seed is None:
            while at < len(docs) and not index.unused[at]:
                at += 1
            if at == len(docs):
                return
            seed = at
            use(seed)
        sequence, last = packer.sequence, seed
        for k in index.neighbours(seed, packer.window - packer.fill) if packer.fill else []:
            use(k)
            last = k
            if packer.sequence != sequence:
                break
        # A window that closed in the middle of a document goes on with that document's neighbours.
        seed = last if packer.fill and packer.sequence != sequence else None


def _pack(idf: np.ndarray, mean: float, dtype: str, window: int, shard_tokens: int, shard_docs: int):
    def run(batches):
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        docs, texts, n = [], [], 0
        for batch in batches:
            for doc, before, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                docs.append((doc, before))
                texts.append(np.frombuffer(raw.as_py(), dtype))
                n += len(texts[-1])
                if n >= shard_tokens or len(docs) >= shard_docs:
                    pack_shard(docs, texts, idf, mean, packer)
                    docs, texts, n = [], [], 0
                    yield packer.take()
        if docs:
            pack_shard(docs, texts, idf, mean, packer)
        packer.finish()
        yield packer.take()

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` ids.

    Every id of every document, and its end id, lies in exactly one piece. A null or empty text is its end id.
    Rows that share a doc_id are packed each on its own; a null doc_id stays null. Other columns are ignored.
    Sequences are full, or as long as a power of two at the end of a partition: none needs padding.
    Sequence ids are unique, not dense. A shard ends with the document that reaches ``shard_tokens`` ids or
    ``shard_docs`` documents; a document that fills whole windows takes part with what is left of it.
    """
    path = tokenizer or VOCABULARY
    size, dtype = encoder(path).size, encoder(path).dtype.str
    encoded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tokenise(path, end_id, window), "doc_id long, sig long, ids binary, crcs array<long>, sequence long")
    tokens, _ = save(encoded, "pack-tokens")
    rows = tokens.select("ids").mapInArrow(_statistics(size, dtype), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # one row for each id of the vocabulary
    n = {r.id: r.n for r in rows}
    total = max(n.pop(-1, 0), 1)
    mean = max(n.pop(-2, 0) / total, 1.0)
    seen = np.zeros(size)
    seen[list(n)] = list(n.values())
    idf = np.log1p((total - seen + 0.5) / (seen + 0.5))
    width_, total_ = np.dtype(dtype).itemsize, F.expr(f"bigint(octet_length(ids) div {np.dtype(dtype).itemsize})")
    whole = tokens.where("size(crcs) > 0").select("doc_id", total_.alias("doc_tokens"), "sequence", F.posexplode("crcs").alias("k", "ids_crc32"))
    whole = whole.select("doc_id", (F.col("k") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("sequence") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    before = F.size("crcs").cast("long") * window
    rest = tokens.select("doc_id", "sig", before.alias("before"), F.expr(f"substring(ids, int(size(crcs) * {window * width_} + 1), {window * width_})").alias("ids")).where("octet_length(ids) > 0")
    dealt = rest.repartitionByRange(width(docs), "sig", "doc_id").sortWithinPartitions("sig", "doc_id", "ids")
    packed = dealt.select("doc_id", "before", "ids").mapInArrow(_pack(idf, mean, dtype, window, shard_tokens, shard_docs), PIECES)
    return whole.select(*PIECE_NAMES).unionByName(packed)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
