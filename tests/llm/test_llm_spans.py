"""Spans of personal data and secrets: places, digests, long texts and many matches against plain Python."""

import hashlib
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import pii, registry, secrets, spans
from test_llm_operators import PII, SECRETS, TEXTS, frame

rng = np.random.default_rng(17)


def one(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id long, text string")


def base_of(kinds, text):
    return sorted((m.start(), k, m.end(), kind) for k, (kind, pattern, ok) in enumerate(kinds) for m in re.finditer(pattern, text or "") if ok(m))


@pytest.mark.parametrize("name, kinds, column", [("op2_pii", PII, "pii"), ("op5_secrets", SECRETS, "secrets")])
def test_columns_of_the_queries(spark, tmp_path, name, kinds, column):
    frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
    found = {r.doc_id: r for r in (pii.find_pii if column == "pii" else secrets.find_secrets)(frame(spark)).collect()}
    for i, text in enumerate(TEXTS):
        base = base_of(kinds, text)
        assert rows[i].base_sha256 == hashlib.sha256(",".join(f"{kind}:{a}:{b}" for a, _, b, kind in base).encode()).hexdigest()
        assert rows[i].spans == ",".join(f"{s.kind}:{s.start}:{s.end}" for s in found[i][column])
        for kind, *_ in kinds:
            assert rows[i][f"n_{kind}"] == sum(b[3] == kind for b in base)


def test_many_matches_take_linear_time(spark):
    few, many = ("".join(f"é user{i}@host{i}.org, password=abcdef{i} " for i in range(n)) for n in (10, 20_000))
    for text in (few, many):
        started = time.time()
        for kinds, find, column in ((PII, pii.find_pii, "pii"), (SECRETS, secrets.find_secrets, "secrets")):
            got = find(one(spark, text)).first()[column]
            assert [tuple(s)[:4] for s in got if s["rank"] < len(kinds)] == base_of(kinds, text)
        took = time.time() - started
    assert took < 60  # a quadratic walk takes minutes


def test_pieces_cross_blocks(spark):
    text = "".join(rng.choice(list("aé🙂 \n"), 3 * spans.BLOCK + 7))
    at = [(int(a), int(b)) for a, b in rng.integers(0, len(text) + 20, (200, 2))] + [(0, 256), (256, 512), (255, 257), (0, 0), (len(text), len(text))]
    rows = spark.createDataFrame([(text, a, b) for a, b in at], "text string, a int, b int").selectExpr("a", "b", f"{spans.let(spans.blocks('text'), 'parts', spans.cut('parts', 'a', 'b'))} as got").collect()
    assert all(r.got == text[r.a : r.b] for r in rows)


def test_running_values_and_spans_apart(spark):
    for n in (0, 1, 2, 3, 17, 64):
        x = rng.integers(0, 50, n).tolist()
        row = spark.createDataFrame([(x,)], "x array<int>").selectExpr(spans.running("x", "x + y"), spans.running("x", "greatest(x, y)")).first()
        assert row[0] == np.cumsum(x).tolist() and row[1] == np.maximum.accumulate(x).tolist() if n else row[0] == []
    for _ in range(30):
        base, own = ([(int(a), 0, int(a + n), "k") for a, n in zip(rng.integers(0, 60, m), rng.integers(1, 9, m))] for m in rng.integers(0, 9, 2))
        got = spark.createDataFrame([(own, base)], f"own {spans.SPAN}, base {spans.SPAN}").selectExpr(spans.apart("own", "base")).first()[0]
        assert sorted(map(tuple, got)) == sorted(s for s in own if not any(b[0] < s[2] and s[0] < b[2] for b in base))


def test_redaction_against_a_fold(spark):
    for _ in range(20):
        text = "".join(rng.choice(list("abé🙂"), 700))
        found = sorted((int(a), 0, int(a + n), "k") for a, n in zip(rng.integers(0, 690, 12), rng.integers(1, 60, 12)))
        found = [s for s in found if s[2] <= len(text)]
        at, want = 0, ""
        for a, _, b, _ in found:
            if a >= at:
                want += text[at:a] + "[SECRET]"
            at = max(at, b)
        want += text[at:]
        got = spark.createDataFrame([(text, found)], f"text string, found {spans.SPAN}").selectExpr(secrets.redact("text", "found")).first()[0]
        assert got == want


def iban(country, n):
    body = "".join(rng.choice(list("0123456789"), n - 4))
    digits = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{country}{98 - int(digits) % 97:02d}{body}"


def test_ibans_of_every_country(spark):
    for n, names in pii.IBAN_LENGTHS.items():
        for country in names.split():
            assert len(iban(country, n)) == n
    numbers = [iban(c, n) for n, names in pii.IBAN_LENGTHS.items() for c in names.split()]
    spaced = [" ".join(x[k : k + 4] for k in range(0, len(x), 4)) for x in numbers]
    broken = [x[:-1] + str((int(x[-1]) + 1) % 10) for x in numbers]
    text = "".join(f"{x} EUR; " for x in [*numbers, *spaced, *broken])
    got = [(s.start, s.end) for s in pii.find_pii(one(spark, text)).first().pii if s.kind == "iban"]
    base = base_of(PII, text)
    want = [(text.index(f"{x} EUR"), text.index(f"{x} EUR") + len(x)) for x in [*numbers, *spaced]]
    assert got == sorted(w for w in want if not any(a < w[1] and w[0] < b for a, _, b, _ in base))
    assert len(got) > 150


def test_dates_are_no_phone_numbers(spark):
    text = "call me 2024-01-05 or 05.01.2024, phone 555 123 4567"
    got = [text[s.start : s.end] for s in pii.find_pii(one(spark, text)).first().pii]
    assert got == ["555 123 4567"]


def test_models_on_held_out_samples(spark):
    samples = secrets.labelled_samples(spark)
    model, threshold = secrets.fit(samples)
    held = samples.where(secrets.held_out(F.col("text"))).selectExpr("random", f"{secrets.ratio('text', model)} > {threshold} as found")
    share = {r.random: r.n for r in held.groupBy("random").agg(F.avg(F.col("found").cast("int")).alias("n")).collect()}
    print(f"held-out recall {share[True]:.4f}, false positives {share[False]:.4f}")
    assert share[True] > 0.97 and share[False] <= 0.002
