"""Quality rules by host: documents that fail rules are counted for each domain, the rates are shrunk with a
beta prior fitted to all domains, and the domain's verdict is joined back to its documents.

All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, table

SYMBOLS = "#*$%&|<>"
BLANKS = "\t\n\x0b\x0c\r "
MIN_WORDS = 50
MAX_REPEAT = 50
MAX_SYMBOL_RATIO = 0.5
#: A host is rejected when its shrunk rate, less two posterior deviations, is over this.
MAX_RATE = 0.5
#: Hosts whose verdicts are broadcast at most; of more hosts, those with this share of all documents at least.
BROADCAST_HOSTS = 50_000


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def occurrences(text: Column, characters: str) -> Column:
    """How many of these ASCII characters the text has."""
    total = F.lit(0)
    for c in characters:
        total = total + F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))
    return total


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more, the first time included.

    Windows are told apart by a 64-bit hash of their words.
    """
    n = F.size(words)
    numbered = F.transform(
        F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(pairs, lambda p: F.transform(F.filter(p, lambda s, j: (F.get(p, j - 1)["h"] == s["h"]) | (F.get(p, j + 1)["h"] == s["h"])), lambda s: s["i"]))
        places = let(twice, lambda t: F.size(F.array_distinct(F.concat(t, F.transform(t, lambda i: i + 1), F.transform(t, lambda i: i + 2)))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(places)

    return let(numbered, covered)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and source with the counts and base_failed of each row; a null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")))
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        counts.alias("c"),
        (F.length(text) - occurrences(text, BLANKS)).cast("long").alias("word_chars"),
        occurrences(text, SYMBOLS).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    n, repeated = F.col("c.n_words"), F.col("c.n_repeat_words")
    return found.select("doc_id", "source", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", repeated.alias("n_repeat_words"), ((n < MIN_WORDS) | (100 * repeated > MAX_REPEAT * n)).alias("base_failed"))


def host_verdicts(measured: DataFrame) -> tuple[DataFrame, dict]:
    """A row for each host with its documents, failures, shrunk rate and verdict; and the prior.

    A document fails if a base rule does or if it has more symbols than half its words. The prior is the beta
    distribution whose mean and variance are those of the hosts' raw rates, weighted alike; without spread it
    is worth the mean host. Documents without source belong to no host.
    """
    failed = F.col("base_failed") | (F.col("n_symbols") > MAX_SYMBOL_RATIO * F.col("n_words"))
    hosts = measured.where("source is not null").groupBy("source").agg(F.count("*").alias("docs"), F.sum(failed.cast("long")).alias("failures"))
    m = hosts.agg(F.count("*").alias("n"), F.sum("docs").alias("total"), F.avg(F.col("failures") / F.col("docs")).alias("mean"), F.var_pop(F.col("failures") / F.col("docs")).alias("var"), F.avg("docs").alias("docs"), F.avg(1 / F.col("docs")).alias("inverse")).first()
    mean = min(max(m["mean"] or 0.0, 1e-3), 1 - 1e-3)
    # What sampling within hosts adds to the spread of rates isn't spread among hosts.
    spread = max((m["var"] or 0.0) - mean * (1 - mean) * (m["inverse"] or 0.0), 0.0)
    weight = mean * (1 - mean) / spread - 1 if spread > 0 else m["docs"] or 1.0
    weight = min(max(weight, 1.0), 1e6)
    a, b = mean * weight, (1 - mean) * weight
    total = F.col("docs") + F.lit(a + b)
    rate = (F.col("failures") + F.lit(a)) / total
    low = rate - 2 * F.sqrt(rate * (1 - rate) / (total + 1))
    return hosts.select("source", "docs", "failures", rate.alias("host_rate"), (low > MAX_RATE).alias("host_rejected")), {"hosts": m["n"], "documents": m["total"] or 0, "a": a, "b": b}


def with_verdicts(measured: DataFrame, verdicts: DataFrame, prior: dict, limit: int = BROADCAST_HOSTS) -> DataFrame:
    """Rows of ``measured`` with the verdict of their host, null without one.

    Up to ``limit`` hosts are broadcast. Of more, only those are that hold one in ``limit`` of all documents, which
    are no more than that; the others, none of which is large then, meet their documents by shuffle. Documents
    without source take no part in it.
    """
    columns = ["source", "host_rate", "host_rejected"]
    if prior["hosts"] <= limit:
        return measured.join(F.broadcast(verdicts.select(*columns)), "source", "left")
    kept, _ = save(verdicts.withColumn("large", F.col("docs") * limit >= prior["documents"]), "hosts")
    large = F.broadcast(kept.where("large").select(*columns, "large"))
    met = measured.join(large, "source", "left")
    small = met.where("source is not null and large is null").drop("large", *columns[1:]).join(kept.where("not large").select(*columns), "source", "left")
    return met.where("source is null or large").drop("large").unionByName(small)


def apply_rules(docs: DataFrame, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """doc_id, the counts, base_failed, host_rate and kept for each (doc_id, text, source) row.

    A document is kept if no base rule fails it and its host isn't rejected; one without source has no host to
    answer for. Repeated rows stay and count each. Other columns are ignored.
    """
    measured, _ = save(measure(docs), "rules")
    hosts, prior = host_verdicts(measured)
    joined = with_verdicts(measured, hosts, prior, broadcast_hosts)
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False))).alias("kept"), F.round(F.coalesce("host_rate", F.lit(0.0)), 6).alias("host_rate"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"))
