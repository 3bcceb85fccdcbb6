"""Token-id files: frequency-ranked ids in byte-aligned variable-length code with separate control bytes.

A file set has shards in ascending order of doc_id, each of numbered blocks. A block's payload is a header,
the doc ids, the tokens of each document, control bytes (two bits a value: its bytes less one) and data bytes.
Values are ranks of ids by corpus frequency, so common ids take one byte. Blocks lie in Parquet containers:
Spark's committers make their writing safe against lost executors, and any store that Spark writes to serves.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, save, table, width
from .tokens import END_ID, VOCABULARY, encoder

MAGIC = b"CWT1"
HEADER = "<4sIIQIQ"  # magic, shard, block, ids before it in the shard, documents, ids
BLOCK_TOKENS = 1 << 18
#: Bytes of the four values that a control byte stands for.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
NO_DOC = np.iinfo(np.int64).min  # stands for a null doc_id


def pack_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned values under 2**32."""
    values = np.ascontiguousarray(values, "<u4")
    code = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = code
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    used = np.arange(4, dtype=np.uint8) <= code[:, None]
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The values again: lengths by table lookup, then a gather for each byte place."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    out = np.zeros(n, np.uint32)
    for k in range(int(lengths.max(initial=0))):
        out |= np.where(lengths > k, raw[starts + k], 0).astype(np.uint32) << np.uint32(8 * k)
    return out


def _blocks(path: str, end_id: int, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, block, before = encoder(path), TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], enc.dtype).tobytes()
        docs, lens, parts, n = [], [], [], 0

        def flush():
            nonlocal block, before, n
            row = [[shard], [block], [before], [len(docs)], [n], [np.array(docs, "<i8").tobytes()], [np.array(lens, "<i8").tobytes()], [b"".join(parts)]]
            block, before, n = block + 1, before + n, 0
            docs.clear(), lens.clear(), parts.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["shard", "block", "before", "n_docs", "n_ids", "docs", "lens", "ids"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at in range(0, len(ids), 512):
                for doc, raw in zip(ids[at : at + 512], enc.encode(batch.column(1).slice(at, 512).to_pylist()), strict=True):
                    docs.append(NO_DOC if doc is None else doc)
                    parts.append(raw + end)
                    lens.append(len(parts[-1]) // enc.dtype.itemsize)
                    n += lens[-1]
                    if n >= block_tokens:
                        yield flush()
        if docs:
            yield flush()

    return run


BLOCKS = "shard int, block int, before long, n_docs int, n_ids long, docs binary, lens binary, ids binary"


def _count(size: int, dtype: str):
    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                total += np.bincount(np.frombuffer(raw.as_py(), dtype), minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["id", "n"])

    return run


def _encode(rank_of: np.ndarray, dtype: str):
    def run(batches):
        for batch in batches:
            rows = batch.to_pydict()
            out = []
            for shard, block, before, n_docs, n_ids, docs, lens, ids in zip(*(rows[k] for k in ("shard", "block", "before", "n_docs", "n_ids", "docs", "lens", "ids")), strict=True):
                control, data = pack_values(rank_of[np.frombuffer(ids, dtype)])
                out.append(struct.pack(HEADER, MAGIC, shard, block, before, n_docs, n_ids) + docs + lens + control + data)
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("n_ids"), pa.array(out, pa.binary()), batch.column("shard")], names=["block", "n_ids", "payload", "shard"])

    return run


def write_token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> tuple[str, str]:
    """Write the token files of (doc_id, text) rows; returns the paths of the files and of their rank table.

    A null text is empty: its document has the end id alone. Rows that share a doc_id stay apart, in an order
    that their texts fix. Rows without doc_id come first. Other columns are ignored. Texts of any length are
    encoded whole; a block holds at least one document, so the longest text bounds memory.
    """
    spark, path = docs.sparkSession, tokenizer or VOCABULARY
    size, dtype = encoder(path).size, encoder(path).dtype.str
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = source.repartitionByRange(width(docs, 2), "doc_id").sortWithinPartitions("doc_id", "text")
    raw, at = save(ordered.mapInArrow(_blocks(path, end_id, block_tokens), BLOCKS), "token-raw")
    counts = raw.select("ids").mapInArrow(_count(size, dtype), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = counts.collect()  # at most one row for each id of the vocabulary
    by_rank = sorted(((-r.n, r.id) for r in found))
    rank_of = np.zeros(size, np.uint32)
    rank_of[[i for _, i in by_rank]] = np.arange(len(by_rank))
    ranks = spark.createDataFrame([(k, i, -n) for k, (n, i) in enumerate(by_rank)], "rank long, id long, n long")
    files = raw.mapInArrow(_encode(rank_of, dtype), "block int, n_ids long, payload binary, shard int")
    _, ranks_at = save(ranks.coalesce(1), "token-ranks")
    _, files_at = save(files, "token-files", "shard", "uncompressed")
    drop(spark, at)
    return files_at, ranks_at


def decode_block(payload: bytes, id_of: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """Shard, ids before the block in it, doc ids, ids of each document, all ids."""
    magic, shard, _, before, n_docs, n_ids = struct.unpack_from(HEADER, payload)
    if magic != MAGIC:
        raise ValueError("not a token block")
    at = struct.calcsize(HEADER)
    docs = np.frombuffer(payload, "<i8", n_docs, at)
    lens = np.frombuffer(payload, "<i8", n_docs, at + 8 * n_docs)
    at += 16 * n_docs
    n_control = -(-n_ids // 4)
    values = unpack_values(payload[at : at + n_control], payload[at + n_control :], n_ids)
    return shard, before, docs, lens, id_of[values]


def _digest(id_of: np.ndarray, base: dict[int, int]):
    def run(batches):
        for batch in batches:
            for payload in batch.column(0):
                shard, before, docs, lens, ids = decode_block(payload.as_py(), id_of)
                ends = np.cumsum(lens)
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lens.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64(), mask=docs == NO_DOC), pa.array(base[shard] + before + ends - lens, pa.int64()), pa.array(lens, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def read_token_files(spark: SparkSession, files_at: str, ranks_at: str) -> DataFrame:
    """Digest of each document of a file set: doc_id, start, n_tokens, ids_crc32. An empty set gives no rows."""
    files = spark.read.schema("block int, n_ids long, payload binary, shard int").parquet(files_at)
    ranks = spark.read.schema("rank long, id long, n long").parquet(ranks_at).collect()  # one row for each id of the vocabulary
    id_of = np.zeros(len(ranks) + 1, np.uint32)
    for r in ranks:
        id_of[r["rank"]] = r["id"]
    totals = {r["shard"]: r["n"] for r in files.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}  # one row for each shard
    base, so_far = {}, 0
    for shard in sorted(totals):
        base[shard] = so_far
        so_far += totals[shard]
    return files.select("payload").mapInArrow(_digest(id_of, base), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(spark, *write_token_files(table(spark, sf_dir, "documents")))
