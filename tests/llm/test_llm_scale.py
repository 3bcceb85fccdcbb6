"""Hot names, hubs, crowded buckets, many tiny documents and positions of matches, against brute force."""

import collections
import os
import re
import time

import numpy as np
import pytest

from chronoweave.llm import decontaminate, packing, quality_model, simhash, substrings
from test_llm_operators import BENCHMARK, TEXTS, by_id, fold, frame, prose

rng = np.random.default_rng(23)
split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))


def removed(texts):
    """What is to be removed of each text."""
    seen, out = set(), []
    for t in texts:
        data = t.encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - 99):
            if data[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(data[k : k + 100])
        out.append(int(gone.sum()))
    return out


def test_hot_names_change_nothing(spark):
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    lines = [word(n) for n in (40, 64, 96, 99, 100, 101, 130, 170, 260)]
    texts = []
    for k in range(60):
        parts = [word(int(rng.integers(0, 90)))]
        for line in rng.permutation(lines)[: int(rng.integers(3, 9))]:
            parts += [line, word(int(rng.choice([0, 1, 5, 40, 90])))]
        texts.append("".join(parts))
    want = removed(texts)
    for hot_rows in (1, 10, 1 << 15):
        found = by_id(substrings.remove_repeats(frame(spark, texts), hot_rows=hot_rows).drop("kept"))
        assert [found[i].n_removed for i in range(len(texts))] == want
    rows = substrings.numbered(frame(spark, texts))
    hot = substrings.hot_names(rows, 10)
    assert hot is not None and len(hot) > 5 and substrings.hot_names(rows, 1 << 15) is None
    # Blocks of a hot name are dealt over partitions.
    dealt = rows.select("key", "text").mapInArrow(substrings._blocks(hot), substrings.SCHEMA).where(f"kind = {substrings.HOT}")
    assert dealt.count() > 100 and dealt.selectExpr("pmod(xxhash64(a, b), 16) p", "a").distinct().groupBy("a").count().agg({"count": "max"}).first()[0] > 4


def near_of(text, items, slop=2):
    """Items of which a window stands in the text with each word at most slop off, and the first place from which one does."""
    words, out = split(text), {}
    at = collections.defaultdict(list)
    for k, w in enumerate(words):
        at[w].append(k)
    for item, t in items:
        ws = split(t)
        n = min(10, len(ws))
        for a in range(len(ws) - n + 1) if n else ():
            window = ws[a : a + n]
            for start in {p - j + d for j, w in enumerate(window) for p in at[w] for d in range(-slop, slop + 1)}:
                if all(any(abs(p - start - j) <= slop for p in at[w]) for j, w in enumerate(window)):
                    out[item] = min(out.get(item, start), start)
    return {k: max(v, 0) for k, v in out.items()}


def test_matches_of_both_kinds_whatever_the_blocks(spark):
    mixed = [split(prose(40, 100 + k)) for k in range(6)]
    for ws in mixed:
        for _ in range(3):
            k = int(rng.integers(0, len(ws) - 1))
            ws[k], ws[k + 1] = ws[k + 1], ws[k]
    texts = [*TEXTS, *(" ".join(ws) for ws in mixed), *(prose(40, 100 + k) for k in range(3))]
    items = [*BENCHMARK, *((20 + k, prose(40, 100 + k)) for k in range(6)), (3, "one two")]
    docs, bench = frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    for block_chars, items_per_pass, windows_per_pass in ((4_000_000, 99, 9999), (1, 99, 9999), (900, 2, 9999), (900, 99, 7)):
        found = by_id(decontaminate.decontaminate(docs, bench, block_chars=block_chars, items_per_pass=items_per_pass, windows_per_pass=windows_per_pass))
        for i, t in enumerate(texts):
            near = near_of(t, items)
            assert dict(zip(found[i].near_items, found[i].near_starts)) == near and found[i].n_near_items == len(near), i
            exact = {}
            for item, b in items:
                ws, doc = split(b), split(t)
                n = min(10, len(ws))
                places = [p for a in range(len(ws) - n + 1) if n for p in range(len(doc) - n + 1) if doc[p : p + n] == ws[a : a + n]]
                if places:
                    exact[item] = min([*places, exact.get(item, len(doc))])
            assert dict(zip(found[i]["items"], found[i].item_starts)) == exact, i
    off = by_id(decontaminate.decontaminate(docs, bench, slop=None))
    assert all(off[i].near_items == [] and off[i].n_hit == found[i].n_hit for i in range(len(texts)))


def test_index_serves_any_benchmark(spark):
    index, _ = decontaminate.build_index(frame(spark), 900)
    for items in ([(1, prose(25, 1))], [(2, "one two"), (3, TEXTS[4])]):
        bench = spark.createDataFrame(items, "item_id long, text string")
        want = sorted(map(str, decontaminate.decontaminate(frame(spark), bench).collect()))
        assert sorted(map(str, decontaminate.search(index, bench).collect())) == want


def test_bm25_against_a_plain_count():
    texts = [rng.integers(0, 40, int(n)) for n in rng.integers(1, 60, 50)]
    idf, mean = rng.uniform(0.1, 3, 40), 30.0
    index = packing.Index(texts, idf, mean)
    for seed in range(50):
        want = []
        for ids in texts:
            norm = packing.K1 * (1 - packing.B + packing.B * len(ids) / mean)
            want.append(sum(idf[t] * (ids == t).sum() * (packing.K1 + 1) / ((ids == t).sum() + norm) for t in set(texts[seed].tolist()) & set(ids.tolist())))
        assert index.scores(seed) == pytest.approx(want, rel=1e-5)
        index.unused[seed] = False
        near = index.neighbours(seed, 200)
        order = [k for k in np.argsort(-index.scores(seed), kind="stable").tolist() if index.unused[k] and want[k] > 0]
        assert near == order[: len(near)] and (len(near) == len(order) or sum(len(texts[k]) for k in near) >= 200 > sum(len(texts[k]) for k in near[:-1]))
        index.unused[seed] = seed % 3 > 0


def test_many_tiny_documents_and_long_ones(spark):
    long = " ".join(f"stone{k}" for k in range(3000))
    texts = [None] * 20_000 + [long, "river " * 200, long]
    started = time.time()
    pieces = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in packing.pack(frame(spark, texts), window=256).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert time.time() - started < 60 and len(pieces) == len(texts)
    for i in (20_000, 20_001, 20_002):
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == r.doc_tokens
    whole = [{(r.start, r.ids_crc32) for r in pieces[i] if r.length == 256 and r.offset == 0} for i in (20_000, 20_002)]
    assert len(whole[0] & whole[1]) > 20  # copies have the same whole windows
    for s in sequences.values():
        total = sum(r.length for r in s)
        assert sorted(r.offset for r in s)[0] == 0 and total & (total - 1) == 0 and total <= 256
    assert sum(sum(r.length for r in s) == 256 for s in sequences.values()) > 80


def classes(n, edges):
    label = list(range(n))
    for a, b in edges:
        x, y = label[a], label[b]
        if x != y:
            label = [min(x, y) if v in (x, y) else v for v in label]
    return label


def test_crowded_buckets_lose_no_link(spark):
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    flip = lambda x, k: x ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False)))
    some = [flip(x, int(k)) for x in base for k in rng.integers(1, 9, 20)]
    crowd = [base[0] ^ np.uint64(int(v)) for v in rng.choice(1 << 12, 150, replace=False)]
    fps = np.unique(np.array([*base, *some, *crowd], np.uint64))
    n = len(fps)
    near = [(a, b) for a in range(n) for b in range(a) if int(fps[a] ^ fps[b]).bit_count() <= 3]
    nodes = spark.createDataFrame([(int(x), k) for k, x in enumerate(fps.view(np.int64))], "fp long, node long")
    for bucket in (4, 30, 1 << 15):
        links = [(r.a, r.b) for r in simhash.links_of(nodes, 4, bucket=bucket).collect()]
        assert classes(n, links) == classes(n, near)


def test_hubs(spark):
    edges = [(k, 0) for k in range(1, 300)] + [(500 + k, 400) for k in range(50)] + [(549, 299), (900, 901)]
    want = {k: 0 for k in [*range(1, 300), 400, *range(500, 550)]} | {901: 900}
    for limit in (1, 3, 1 << 17):
        got = {r.node: r.component for r in simhash.components(spark.createDataFrame(edges, "a long, b long"), limit).collect()}
        assert got == want


def test_rows_that_share_a_sampled_id_are_one(spark):
    docs = spark.createDataFrame([(i % 5, prose(30, i)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(5)], "doc_id long, quality int, toxic int")
    seen = []
    before = quality_model.fit
    quality_model.fit = lambda rows, y: seen.append(len(rows)) or before(rows, y)
    try:
        quality_model.train(docs, labels)
    finally:
        quality_model.fit = before
    assert seen[0] <= 5


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("needs the driver's tables")
    found = {r.doc_id: r for r in quality_model.op7_quality_model(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    right = [found[i].predicted == y for i, y in labels.items() if i in found and found[i].held_out]
    print(f"held-out accuracy {np.mean(right):.4f} of {len(right)}")
    assert len(right) > 50 and np.mean(right) > 0.95
