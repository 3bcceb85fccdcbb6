"""Benchmark decontamination with a distributed positional inverted index.

The index is dealt by blocks of documents and knows no benchmark. A block stores, for each of its terms, the sorted
positions of that term over the block's running text, so an offset-adjusted list of one term is its positions
less the term's place in a window. A search starts from each window's rarest term in the block and keeps the
starts that the next rarest lists hold too, until all terms agree: an exact phrase match. The same lists with
a tolerance give proximity matches.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, save, table

WINDOW = 10
SLOP = 2
#: What a pass searches at most, about: items, and windows, which are what a task is sent.
ITEMS_PER_PASS = 20_000
WINDOWS_PER_PASS = 1 << 19
#: Longer items are dealt in pieces of so many windows.
PIECE = 1 << 14
BLOCK_CHARS = 4_000_000
#: Starts that are tried at once.
CANDIDATES = 1 << 20
#: A-Z to a-z, all ASCII but digits and letters to space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def windows_of(items: list[tuple[int | None, str | None]], size: int = WINDOW) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Terms; a row of term numbers for each distinct window, -1 after its end; and which window belongs to which item."""
    term_of: dict[bytes, int] = {}
    found: dict[tuple[int, ...], int] = {}
    pairs = set()
    for item, text in items:
        numbers = [term_of.setdefault(w, len(term_of)) for w in words(text)]
        n = min(size, len(numbers))
        for k in range(len(numbers) - n + 1) if n else ():
            row = found.setdefault(tuple(numbers[k : k + n]), len(found))
            if item is not None:
                pairs.add((row, item))
    table_ = np.full((len(found), size), -1, np.int32)
    for w, row in found.items():
        table_[row, : len(w)] = w
    owned = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    return list(term_of), table_, owned[:, 0], owned[:, 1]


INDEX = "docs binary, starts binary, terms binary, begins binary, postings binary"


def _index(block_chars: int):
    """Index blocks of (doc_id, text) rows: all terms in the order of their first place. Between documents lies a gap longer than any window and tolerance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = defaultdict(lambda: len(number))
        docs, parts, starts, at, chars = [], [], [], 0, 0
        gap = np.full(GAP, -1, np.int32)

        def flush():
            flat = np.concatenate(parts)
            places = np.flatnonzero(flat >= 0)
            terms = flat[places]
            order = places[np.argsort(terms.astype(np.uint16) if len(number) <= 1 << 16 else terms, kind="stable")]
            begins = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=len(number)))])
            row = [np.array(docs, "<i8").tobytes(), np.array([*starts, at], "<i8").tobytes(), b" ".join(number), begins.astype("<i8").tobytes(), order.astype("<i8" if at >> 31 else "<i4").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], names=["docs", "starts", "terms", "begins", "postings"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                ws = words(text)
                docs.append(NO_DOC if doc is None else doc)
                starts.append(at)
                parts += [np.fromiter(map(number.__getitem__, ws), np.int32, len(ws)), gap]
                at += len(ws) + GAP
                chars += len(text or "") + 1
                if chars >= block_chars:
                    yield flush()
                    docs, parts, starts, at, chars = [], [], [], 0, 0
                    number.clear()
        if docs:
            yield flush()

    return run


def build_index(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> tuple[DataFrame, str]:
    """The index of (doc_id, text) rows as a table in the shared folder, a row a block, and its path. It serves any benchmark."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return save(rows.mapInArrow(_index(block_chars), INDEX).withColumn("block", F.monotonically_increasing_id()), "postings")


GAP = 64
NO_DOC = np.iinfo(np.int64).min


def _of_benchmark(row: dict, number: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of a block's terms that the benchmark has, by its numbers, in order; where their lists begin; the lists."""
    begins, postings = np.frombuffer(row["begins"], "<i8"), np.frombuffer(row["postings"], "<i8" if len(row["postings"]) == 8 * np.frombuffer(row["begins"], "<i8")[-1] else "<i4")
    names = row["terms"].split()
    own = np.fromiter((number.get(t, -1) for t in names), np.int64, len(names))
    used = np.flatnonzero(own >= 0)
    used = used[np.argsort(own[used])]
    size = begins[used + 1] - begins[used]
    ends = np.cumsum(size)
    at = np.repeat(begins[used] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)
    return own[used], np.concatenate([[0], ends]), postings[at]


def search_block(terms: np.ndarray, begins: np.ndarray, postings: np.ndarray, windows: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of every place in the block from which all terms of a window stand at most ``slop`` off their places; ``terms`` ascend."""
    n_terms = int(max(windows.max(initial=-1), terms.max(initial=-1))) + 1
    first, size = np.zeros(n_terms + 1, np.int64), np.zeros(n_terms + 1, np.int64)
    first[terms], size[terms] = begins[:-1], np.diff(begins)
    length = (windows >= 0).sum(axis=1)
    lists = np.where(windows >= 0, size[windows], np.iinfo(np.int64).max)
    alive = np.flatnonzero((lists > 0).all(axis=1) & (length > 0))
    if not len(alive):
        return alive, alive
    rarest = np.argsort(lists[alive], axis=1, kind="stable")
    # All postings as one sorted list of (term, position), so that many lists are intersected at once.
    span = int(postings.max(initial=0)) + 2 * GAP
    keys = np.repeat(terms.astype(np.int64), np.diff(begins)) * span + postings
    shifts = np.arange(-slop, slop + 1)
    out_w, out_s = [], []
    work = np.cumsum(size[windows[alive, rarest[:, 0]]] * len(shifts)) // CANDIDATES
    for cut in np.split(np.arange(len(alive)), np.flatnonzero(np.diff(work)) + 1):
        part, order = alive[cut], rarest[cut]
        term = windows[part, order[:, 0]]
        n = size[term]
        w = np.repeat(np.arange(len(part)), n)
        start = postings[np.repeat(first[term] - np.cumsum(n) + n, n) + np.arange(n.sum())].astype(np.int64) - order[w, 0]
        if slop:
            w, start = np.repeat(w, len(shifts)), (start[:, None] + shifts).ravel()
        for k in range(1, windows.shape[1]):
            offset = order[w, k]
            term = windows[part[w], offset]
            want = term.astype(np.int64) * span + start + offset
            place = np.searchsorted(keys, want - slop)
            near = keys[np.minimum(place, len(keys) - 1)]
            keep = (term < 0) | (place < len(keys)) & (near <= want + slop)
            w, start = w[keep], start[keep]
            if not len(w):
                break
        out_w.append(part[w])
        out_s.append(start)
    return np.concatenate(out_w), np.concatenate(out_s)


def _cover(spans: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` places lie in one of the spans [start, end)."""
    change = np.zeros(size, np.int64)
    np.add.at(change, spans[0], 1)
    np.add.at(change, spans[1], -1)
    return np.cumsum(change) > 0


def _firsts(rows: np.ndarray) -> np.ndarray:
    """Of (document, item, place) columns, each document and item once, in order, with the least place."""
    order = np.lexsort(rows[::-1])
    rows = rows[:, order]
    fresh = np.ones(rows.shape[1], bool)
    fresh[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
    return rows[:, fresh]


def _rows(docs: np.ndarray, starts: np.ndarray, spans: np.ndarray, exact: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    """A block's result from its hit spans and its sorted, distinct (document, item, place) columns."""
    n_hit = np.add.reduceat(_cover(spans, int(starts[-1]) + 1).astype(np.int64), starts[:-1])

    def lists(rows: np.ndarray, column: int) -> pa.Array:
        at = np.searchsorted(rows[0], np.arange(len(docs) + 1))
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(rows[column], pa.int64()))

    return pa.RecordBatch.from_arrays(
        [pa.array(docs, pa.int64(), mask=docs == NO_DOC), pa.array(np.diff(starts) - GAP, pa.int64()), pa.array(n_hit, pa.int64()), lists(exact, 1), lists(exact, 2), pa.array(np.bincount(near[0], minlength=len(docs)), pa.int64()), lists(near, 1), lists(near, 2)],
        names=["doc_id", "n_words", "n_hit", "items", "item_starts", "n_near_items", "near_items", "near_starts"],
    )


RESULT = "doc_id long, n_words long, n_hit long, items array<long>, item_starts array<long>, n_near_items long, near_items array<long>, near_starts array<long>"
#: A pass's result for one block, where anything is found: spans as two, matches as three rows of 64-bit numbers each.
FOUND = "block long, spans binary, exact binary, near binary"


def _columns(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<i8").reshape(n, -1)


def _search(terms: list[bytes], windows: np.ndarray, owned_window: np.ndarray, owned_item: np.ndarray, slop: int | None, whole: bool):
    """Rows of RESULT if the windows are the whole benchmark, or else of FOUND."""
    length = (windows >= 0).sum(axis=1)
    by = np.argsort(owned_window, kind="stable")
    item_of, item_at = owned_item[by], np.searchsorted(owned_window[by], np.arange(len(windows) + 1))

    def items(w: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
        """(document, item, first place) of window matches."""
        if not len(w):
            return np.zeros((3, 0), np.int64)
        doc, w, place = _firsts(np.stack([doc, w, place]))
        n = item_at[w + 1] - item_at[w]
        item = item_of[np.repeat(item_at[w] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        return _firsts(np.stack([np.repeat(doc, n), item, np.repeat(place, n)]))

    def run(batches):
        number = {t: k for k, t in enumerate(terms)}
        for batch in batches:
            for row in batch.to_pylist():
                docs, starts = np.frombuffer(row["docs"], "<i8"), np.frombuffer(row["starts"], "<i8")
                lists = _of_benchmark(row, number)
                w, start = search_block(*lists, windows)
                spans = np.stack([start, start + length[w]])
                doc = np.searchsorted(starts, start, "right") - 1
                exact = items(w, doc, start - starts[doc])
                near = np.zeros((3, 0), np.int64)
                if slop is not None:
                    w, start = search_block(*lists, windows, slop)
                    doc = np.searchsorted(starts, start + slop, "right") - 1
                    near = items(w, doc, np.maximum(start - starts[doc], 0))
                if whole:
                    yield _rows(docs, starts, spans, exact, near)
                elif spans.size or near.size:
                    edges = np.flatnonzero(np.diff(_cover(spans, int(starts[-1]) + 1), prepend=False))
                    raw = [np.ascontiguousarray(x, "<i8").tobytes() for x in (edges.reshape(-1, 2).T, exact, near)]
                    yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), *(pa.array([x], pa.binary()) for x in raw)], names=["block", "spans", "exact", "near"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of RESULT from blocks (docs, starts) and what the passes found in each."""
    for batch in batches:
        for row in batch.to_pylist():
            docs, starts = np.frombuffer(row["docs"], "<i8"), np.frombuffer(row["starts"], "<i8")
            spans, exact, near = (np.concatenate([np.zeros((n, 0), np.int64), *(_columns(x[k], n) for x in row["found"] or ())], axis=1) for k, n in (("spans", 2), ("exact", 3), ("near", 3)))
            # An item may be found in several passes.
            yield _rows(docs, starts, spans, _firsts(exact), _firsts(near))


def _pieces(window: int, size: int):
    """Items as rows (item_id, text, windows), long ones cut so that each window lies in exactly one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ws = words(text)
                for at in range(0, max(len(ws) - window + 1, 1), size) if ws else ():
                    piece = ws[at : at + size + window - 1]
                    out.append((item, b" ".join(piece).decode(), max(len(piece) - window + 1, 1)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64()))], names=["item_id", "text", "windows"])

    return run


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = {w for text in batch.column(0).to_pylist() for w in words(text)}
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary())], names=["term"])


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = SLOP, items_per_pass: int = ITEMS_PER_PASS, windows_per_pass: int = WINDOWS_PER_PASS) -> DataFrame:
    """What ``decontaminate`` returns, from a saved index."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    pieces = items.mapInArrow(_pieces(window, min(PIECE, windows_per_pass)), "item_id long, text string, windows long")
    owned = lambda part: [(r.item_id, r.text) for r in part.collect()]  # noqa: E731  # about a pass's items and windows
    size = pieces.agg(F.count("*").alias("items"), F.sum("windows").alias("windows")).first()
    passes = max(-(-size["items"] // items_per_pass), -(-(size["windows"] or 0) // windows_per_pass))
    if passes <= 1:
        return index.mapInArrow(_search(*windows_of(owned(pieces), window), slop, True), RESULT)
    dealt, dealt_at = save(pieces.select("item_id", "text").distinct().withColumn("pass", F.expr(f"int(pmod(xxhash64(item_id, text), {passes}))")), "items", "pass")
    parts = []
    for k in range(passes):
        parts.append(save(index.mapInArrow(_search(*windows_of(owned(dealt.where(F.col("pass") == k)), window), slop, False), FOUND), "found")[0])
    drop(index.sparkSession, dealt_at)
    merged = reduce(DataFrame.unionByName, parts).groupBy("block").agg(F.collect_list(F.struct("spans", "exact", "near")).alias("found"))
    return index.select("block", "docs", "starts").join(merged, "block", "left").select("docs", "starts", "found").mapInArrow(_merge, RESULT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = SLOP, items_per_pass: int = ITEMS_PER_PASS, windows_per_pass: int = WINDOWS_PER_PASS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids, sorted), item_starts, n_near_items, near_items and near_starts for each row of (doc_id, text).

    n_hit counts document words inside any occurrence of a window; item_starts has the first word at which a window
    of each item occurs. near_items are the sorted ids of items of which a window occurs with each word at most
    ``slop`` places off, n_near_items is their number, near_starts has the first word from which one does; with
    slop None proximity isn't searched and these are empty. Null and empty texts have no words and no hits; items
    without words have no windows. An item without item_id counts in n_hit and is in no list of items. Rows that
    share a doc_id stay apart. Other columns are ignored.

    The benchmark is a query set and is sent to every task, in passes over the same index of about
    ``items_per_pass`` rows and ``windows_per_pass`` windows at most; what the passes find is merged for each block
    of documents.
    """
    return search(build_index(docs, block_chars)[0], benchmark, window, slop, items_per_pass, windows_per_pass)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = lambda ids: F.sha2(F.array_join(F.array_sort(F.transform(ids, lambda x: x.cast("string"))), ",").cast("binary"), 256)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest("items").alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.col("n_near_items").alias("n_near"), digest("near_items").alias("near_sha256"),
    )
