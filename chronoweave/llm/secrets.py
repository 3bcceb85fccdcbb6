"""Secrets: patterns for assignments, access keys and hex runs, and Markov models of characters for other tokens.

Two first-order models, of random strings and of ordinary identifiers, are counted from labelled samples.
A token's log-likelihood ratio, a sum over its pairs of characters, tells which of them made it. The ratio from
which a token counts as random is where a held-out third of the ordinary samples all but ends. All of it is
built-in SQL functions; what reaches the driver is a table of at most 66 x 66 ratios.

Tokens that the models judge are runs of at least twenty characters with a letter and a digit: shorter ones hold too
few pairs to tell, and base patterns find those that are named.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .spans import blocks, count, cut, digest, find, found_if, has, joined, let, quoted, running, with_base

KINDS = ("assign", "access", "hex", "markov")
BASE = KINDS[:3]
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
#: Runs of the asked length are whole runs: a shorter one inside can't match.
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
#: What the models judge: runs of at least so many characters that hold a digit.
MIN_LENGTH = 20
TOKEN = r"(?:\G|(?<![A-Za-z0-9+/_=-]))[A-Za-z0-9+/_=-]{20,}+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: Share of held-out ordinary samples that may count as random.
FALSE_RATE = 0.001
#: Parts of ordinary identifiers, of which the labelled sample of identifiers is made.
PARTS = (
    "get set is has add remove update delete create find load save read write open close start stop run test "
    "user name id list item data value key index count size time date file path page text line word table row "
    "column field type node tree map array string number status state error message request response client "
    "server config option default manager service handler controller model view source target parent child "
    "first last next previous total average maximum minimum current temporary global local public private"
).split()
SAMPLES = 4000


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """(text, random): n random strings, hex and base64 of hash values, and n identifiers made of PARTS."""
    parts = f"array({', '.join(map(quoted, PARTS))})"
    pick = lambda k: f"element_at({parts}, int(pmod(xxhash64(id, {k}), {len(PARTS)})) + 1)"
    ordinary = (
        f"concat_ws('_', {pick(1)}, {pick(2)}, {pick(3)}, {pick(4)})",
        f"concat({pick(5)}, initcap({pick(6)}), initcap({pick(7)}), initcap({pick(8)}), string(id % 10))",
        f"concat({pick(1)}, {pick(3)}, {pick(6)}, {pick(8)}, {pick(2)})",
        f"concat_ws('-', {pick(2)}, {pick(4)}, {pick(6)}, {pick(7)}, string(id % 2100))",
    )
    base = spark.range(n).selectExpr("id", "sha2(cast(concat('sample', id) as binary), 256) as h")
    random = base.selectExpr("if(id % 3 = 0, substring(h, 1, 40), replace(base64(unhex(h)), '=', '')) as text", "true as random")
    return random.unionByName(base.selectExpr(f"element_at(array({', '.join(ordinary)}), int(id % 4) + 1) as text", "false as random"))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios, random over ordinary, of each pair of ALPHABET's characters, row by row.

    Pairs never seen count a half in both models. Samples without text or label, and characters outside the
    alphabet, are passed over; with no samples all ratios are zero.
    """
    n = len(ALPHABET)
    chars = samples.where("text is not null and random is not null").select("random", F.regexp_replace("text", f"[^{ALPHABET[:-2]}_-]", "").alias("text"))
    pairs = chars.selectExpr("random", "explode(transform(sequence(1, greatest(length(text) - 1, 1)), i -> substring(text, i, 2))) as pair").where("length(pair) = 2")
    seen = {(r.random, r.pair): r["n"] for r in pairs.groupBy("random", "pair").agg(F.count("*").alias("n")).collect()}  # at most 2 x 66 x 66 rows
    rows = {(k, a): sum(seen.get((k, a + b), 0) + 0.5 for b in ALPHABET) for k in (True, False) for a in ALPHABET}
    return [math.log((seen.get((True, a + b), 0) + 0.5) / rows[True, a] * rows[False, a] / (seen.get((False, a + b), 0) + 0.5)) for a in ALPHABET for b in ALPHABET] if seen else [0.0] * n * n


def ratio(token: str, model: list[float]) -> str:
    """Mean log-likelihood ratio of a token's pairs; zero for tokens under two characters."""
    n, ratios = len(ALPHABET), quoted(",".join(f"{x:.6f}" for x in model))  # folded to one array
    pairs = f"zip_with(places, slice(places, 2, size(places)), (a, b) -> if(a > 0 and b > 0, get(cast(split({ratios}, ',') as array<double>), a * {n} + b - {n + 1}), 0D))"
    places = f"transform(filter(split({token}, ''), c -> c <> ''), c -> instr({quoted(ALPHABET)}, c))"
    return let(places, "places", f"aggregate({pairs}, 0D, (total, x) -> total + x) / greatest(size(places) - 1, 1)")


def held_out(text: Column) -> Column:
    """A third of the samples, by hash."""
    return F.pmod(F.xxhash64(text, F.lit("held")), F.lit(3)) == 1


def fit(samples: DataFrame, false_rate: float = FALSE_RATE) -> tuple[list[float], float]:
    """The ratios of samples that aren't held out, and the threshold that leaves at most ``false_rate`` of the held-out ordinary ones above it.

    Without held-out ordinary samples the threshold is zero, where both models are as likely.
    """
    model = train(samples.where(~held_out(F.col("text"))))
    ordinary = samples.where("text is not null and not random").where(held_out(F.col("text")))
    least = ordinary.agg(F.expr(f"percentile({ratio('text', model)}, {1 - false_rate}) as least")).first()["least"]
    return model, max(least or 0.0, 0.0)


def base_spans(text: str) -> str:
    """All base spans, unordered."""
    named = lambda h: f"length(regexp_extract({h}, {quoted(VALUE)}, 1)) >= 6"
    spans = (
        found_if(has(text, r"(?i:password|passwd|secret|token|api_?key)"), find(text, ASSIGN, "assign", 0, named)),
        found_if(f"contains({text}, 'AKIA')", find(text, ACCESS, "access", 1)),
        found_if(has(text, HEX), find(text, HEX, "hex", 2)),
    )
    return f"concat({', '.join(spans)})"


def model_spans(text: str, model: list[float], threshold: float) -> str:
    random = lambda h: f"{has(h, '[0-9]')} and {has(h, '[A-Za-z]')} and {ratio(h, model)} > {threshold:.9f}D"
    return found_if(has(text, TOKEN), find(text, TOKEN, "markov", 3, random))


def find_secrets(docs: DataFrame, samples: DataFrame | None = None, threshold: float | None = None, into: str = "secrets") -> DataFrame:
    """Adds ``secrets``: spans (start, rank, end, kind) of each row with a text, by start, then kind.

    A span of the models is added only where no base span overlaps it. A null text counts as empty and has no
    spans. Other columns pass through; a column of the name ``into`` is replaced. A text with n spans takes n log n
    steps beside its length. Without ``threshold``, held-out samples set it.
    """
    samples = samples if samples is not None else labelled_samples(docs.sparkSession)
    model, least = fit(samples) if threshold is None else (train(samples), threshold)
    text = "coalesce(text, '')"
    return docs.withColumn(into, F.expr(with_base(base_spans(text), model_spans(text, model, least))))


def redact(text: str, spans: str, mark: str = "[SECRET]") -> str:
    """SQL text: the column ``text`` with each run of overlapping spans replaced by the mark; spans come by their starts."""
    heads = f"filter(transform({spans}, (s, i) -> named_struct('start', coalesce(get(reach, i - 1), 0), 'end', s.start)), p -> p.`end` >= p.start)"
    last = f"array(named_struct('start', element_at(reach, -1), 'end', length({text})))"
    pieces = f"array_join(transform(concat({heads}, {last}), p -> {cut('parts', 'p.start', 'p.`end`')}), {quoted(mark)})"
    changed = let(f"transform({spans}, s -> s.`end`)", "ends", let(running("ends", "greatest(x, y)"), "reach", let(blocks(text), "parts", pieces)))
    return f"if(size({spans}) > 0, {changed}, {text})"


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    base = f"filter(secrets, s -> s.rank < {len(BASE)})"
    kinds = [f"{count('secrets', k)} as n_{k}" for k in BASE]
    return found.selectExpr("doc_id", *kinds, f"{digest(base)} as base_sha256", f"{joined('secrets')} as spans")
