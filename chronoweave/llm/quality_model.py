"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Pairwise interactions have low rank: with x the features, V their factors,
    score = w0 + <w, x> + (|Vx|^2 - sum of squares of each V[i] x[i]) / 2,
so a document costs its number of features times the rank. Training takes a bounded sample of labelled rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BUCKETS = 1 << 12
RANK = 8
#: Labelled rows that training takes at most, those of least hash. A documented bound: their features go to the driver.
MAX_ROWS = 6000
EPOCHS = 30
SEED = 7
SYMBOLS = "#*$%&|<>!@=_"
STATS = (
    "log_words", "log_chars", "mean_word", "upper", "symbol", "digit", "space", "distinct", "top_word", "next_same", "repeated_triples",
    "bare_symbol_words", "capital_words", "stop_marks", "log_lines", "repeated_lines", "short", "long_word", "distinct_bytes", "metadata_chars",
)


def structure(text: str, words: list[str], counts: Counter, n_chars: float | None) -> list[float]:
    """The structure statistics of a text, in the order of STATS."""
    n, chars = len(words), len(text)
    per_word, per_char = 1 / max(n, 1), 1 / max(chars, 1)
    letters = sum(map(len, words))
    lines = [x for x in text.split("\n") if x.strip()]
    triples = Counter(zip(words, words[1:], words[2:]))
    return [
        np.log1p(n),
        np.log1p(chars),
        letters * per_word / 10,
        sum(map(str.isupper, words)) * per_word,
        sum(map(text.count, SYMBOLS)) * per_char * 10,
        sum(map(text.count, "0123456789")) * per_char * 10,
        (chars - letters) * per_char,
        len(counts) * per_word,
        max(counts.values(), default=0) * per_word,
        sum(map(str.__eq__, words, words[1:])) * per_word,
        sum(c for c in triples.values() if c > 1) * per_word,
        sum(c for w, c in counts.items() if not w[0].isalnum()) * per_word,
        sum(c for w, c in counts.items() if w[0].isupper()) * per_word,
        sum(map(text.count, ".!?")) * per_word,
        np.log1p(len(lines)),
        1 - len(set(lines)) / max(len(lines), 1),
        float(n < 8),
        max(map(len, counts), default=0) / 50,
        len(set(text)) / 64,
        np.log1p(max(float(n_chars), 0.0) if n_chars is not None and n_chars == n_chars else chars),
    ]


class Hasher:
    """Feature rows of texts. Buckets of words are remembered, up to a bound."""

    def __init__(self, buckets: int = BUCKETS, limit: int = 400_000):
        self.buckets, self.limit, self.bucket = buckets, limit, {}

    def row(self, text: str | None, n_chars: float | None) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers, distinct, and their values."""
        text = text or ""
        words = text.split()
        counts = Counter(words)
        if len(self.bucket) > self.limit:
            self.bucket.clear()
        known, places = self.bucket, []
        for w in counts:
            at = known.get(w)
            if at is None:
                at = known[w] = zlib.crc32(w.lower().encode("utf-8", "replace")) % self.buckets
            places.append(at)
        weight = np.bincount(np.array(places, np.int64), np.fromiter(counts.values(), np.float64, len(counts)), self.buckets) if places else np.zeros(self.buckets)
        at = np.flatnonzero(weight)
        value = np.log1p(weight[at])
        norm = np.sqrt((value * value).sum())
        stats = np.array(structure(text, words, counts, n_chars))
        return np.concatenate([at, np.arange(self.buckets, self.buckets + len(stats))]), np.concatenate([value / norm if norm else value, stats])


class Machine:
    """A trained factorisation machine."""

    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.bias, self.weights, self.factors, self.mean, self.scale = bias, weights, factors, mean, scale

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Scores from 0 to 1, by the sum-of-squares identity over all rows' features at once."""
        if not rows:
            return np.zeros(0)
        at = np.concatenate([a for a, _ in rows])
        x = np.concatenate([v for _, v in rows])
        begin = np.cumsum([0, *(len(a) for a, _ in rows[:-1])])
        own = at >= len(self.weights) - len(self.mean)
        k = at[own] - (len(self.weights) - len(self.mean))
        x[own] = np.clip((x[own] - self.mean[k]) / self.scale[k], -4, 4)
        part = self.factors[at] * x[:, None]
        total = np.add.reduceat(part, begin, axis=0)
        squares = np.add.reduceat((part * part).sum(axis=1), begin)
        z = self.bias + np.add.reduceat(self.weights[at] * x, begin) + 0.5 * ((total * total).sum(axis=1) - squares)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, buckets: int = BUCKETS, rank: int = RANK, epochs: int = EPOCHS, seed: int = SEED, batch: int = 128) -> Machine:
    """Adam on the logistic loss with weight decay. Classes weigh alike up to a factor of two. No rows: a machine that says 0.5."""
    n_stats = len(STATS)
    size = buckets + n_stats
    rng = np.random.default_rng(seed)
    if not rows:
        return Machine(0.0, np.zeros(size), np.zeros((size, rank)), np.zeros(n_stats), np.ones(n_stats))
    # Each row ends with its statistics; only a batch is ever dense.
    stats = np.array([value[-n_stats:] for _, value in rows], np.float32)
    mean, scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-3)
    stats = np.clip((stats - mean) / scale, -4, 4)
    dense = np.zeros((batch, size), np.float32)
    y = labels.astype(np.float32)
    share = float(np.clip(y.mean(), 0.02, 0.98))
    weight = np.where(y > 0, 1.0, min(share / (1 - share), 2.0)).astype(np.float32)
    params = [np.array([np.log(share / (1 - share))], np.float32), np.zeros(size, np.float32), rng.normal(0, 0.02, (size, rank)).astype(np.float32)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    step = 0
    for epoch in range(epochs):
        order, rate = rng.permutation(len(rows)), 0.02 * (1 - epoch / (epochs + 1))
        for a in range(0, len(rows), batch):
            pick = order[a : a + batch]
            b = dense[: len(pick)]
            b[:, :buckets] = 0
            for row, k in zip(b, pick.tolist(), strict=True):
                at, value = rows[k]
                row[at[:-n_stats]] = value[:-n_stats]
            b[:, buckets:] = stats[pick]
            b2 = b * b
            w0, w, v = params
            total = b @ v
            z = w0 + b @ w + 0.5 * ((total * total).sum(axis=1) - (b2 @ (v * v)).sum(axis=1))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) * weight[pick] / len(pick)
            grads = [np.array([g.sum()]), b.T @ g + 1e-4 * w, b.T @ (g[:, None] * total) - (b2.T @ g)[:, None] * v + 1e-4 * v]
            step += 1
            for p, (m, s), d in zip(params, moments, grads, strict=True):
                m += 0.1 * (d - m)
                s += 0.001 * (d * d - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Machine(float(params[0][0]), params[1].astype(float), params[2].astype(float), mean.astype(float), scale.astype(float))


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32(doc_id as text) leaves 1 on division by 3: no label of theirs is learned."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        for doc, label, text, n_chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            at, value = hasher.row(text, n_chars)
            yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([label], pa.int32()), pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.array([value.astype("<f8").tobytes()], pa.binary())], names=["doc_id", "label", "at", "value"])


def _n_chars(docs: DataFrame) -> Column:
    return F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")


def inputs(docs: DataFrame) -> DataFrame:
    """doc_id, text and n_chars, which is null where the table has none."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _n_chars(docs).alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Machine:
    """Fit on at most ``max_rows`` labelled rows that aren't held out, those whose doc_id has the least hash.

    Rows without label or text are passed over; of several labels of a document the greatest counts, and of several
    rows of a doc_id the one with the least features: what reaches the driver is ``max_rows`` rows at most.
    """
    sample = (
        labels.where("doc_id is not null and quality is not null")
        .where(~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col("quality").cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    rows = inputs(docs).where("text is not null").join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text", "n_chars")
    features = rows.mapInArrow(_features, "doc_id long, label int, at binary, value binary")
    found = features.groupBy("doc_id").agg(F.min(F.struct("label", "at", "value")).alias("row")).select("row.*").collect()  # bounded by max_rows
    found.sort(key=lambda r: (r.label, bytes(r["at"]), bytes(r["value"])))
    return fit([(np.frombuffer(r["at"], "<i4").astype(np.int64), np.frombuffer(r["value"], "<f8").copy()) for r in found], np.array([r.label for r in found]))


def _scores(machine: Machine):
    def run(batches):
        hasher = Hasher()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = [hasher.row(t, n) for t, n in zip(batch.column(1).slice(at, 256).to_pylist(), batch.column(2).slice(at, 256).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), pa.array(machine.scores(rows), pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) of each row. A null text counts as empty and is scored. Repeated rows are scored each; columns beside doc_id, text and n_chars are ignored."""
    return inputs(docs).mapInArrow(_scores(machine), "doc_id long, score double")


def passing(docs: DataFrame, machine: Machine, least: float = 0.5) -> DataFrame:
    """The rows of docs that score at least ``least``, each on its own, with all their columns."""
    names, text = docs.columns, docs.columns.index("text")

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [hasher.row(t, n) for t, n in zip(part.column(text).to_pylist(), part.column(len(names)).to_pylist(), strict=True)]
                yield part.select(names).filter(pa.array(machine.scores(rows) >= least))

    return docs.withColumn("__n_chars", _n_chars(docs)).mapInArrow(run, docs.schema)


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
