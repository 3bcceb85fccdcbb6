"""Personal data: regular expressions propose spans, check digits confirm them, words nearby move their score.

All of it is built-in SQL functions. Base kinds are email, ip, card and phone. The method adds IBANs whose
mod-97 check digits hold, and numbers without a plus sign that a word such as "phone" introduces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .spans import SPAN, blocks, count, cut, digest, find, found_if, has, joined, let, with_base

KINDS = ("email", "ip", "card", "phone", "iban", "local_phone")
BASE = KINDS[:4]
#: Loops are possessive, so that long runs take no stack; a match can only begin where a run does, or right
#: after another match, so that they take linear time. Neither changes what is found.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Characters of each country's IBAN, as its standard's registry has them.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG FK PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = "(?<![A-Za-z0-9])(?:" + "|".join(rf"(?:{names.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN_LENGTHS.items()) + ")(?![A-Za-z0-9])"
LOCAL_PHONE = r"(?<![0-9+.-])\(?[0-9]{2,5}\)?(?:[\x20.-]?[0-9]{2,5}){1,4}(?![0-9])"
#: Dates look like local numbers.
DATE = r"^(?:(?:19|20)[0-9]{2}([.\x20-])(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])([.\x20-])(?:0[1-9]|1[0-2])\2(?:19|20)[0-9]{2}|(?:0[1-9]|1[0-2])([.\x20-])(?:0[1-9]|[12][0-9]|3[01])\3(?:19|20)[0-9]{2})$"
#: Words that raise a kind's score, and those that lower it, in the text around a span.
CONTEXT = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|credit|payment|karte|tarjeta|carte",
    "phone": "phone|tel|call|mobile|fax|telefon",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "local_phone": "phone|tel|call|mobile|fax|telefon",
}
AGAINST = "version|example|sample|test|isbn|order|page"
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "local_phone": 0.2}
REACH = 40
THRESHOLD = 0.5


def digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def mod97(value: str) -> str:
    """Remainder of an IBAN's check number; 1 if it holds."""
    turned = "concat(substring(bare, 5, 64), substring(bare, 1, 4))"
    step = "(r, c) -> if(ascii(c) <= 57, (r * 10 + ascii(c) - 48) % 97, (r * 100 + ascii(c) - 55) % 97)"
    return let(f"replace({value}, ' ', '')", "bare", f"aggregate(filter(split({turned}, ''), c -> c <> ''), 0, {step})")


def octets(value: str) -> str:
    """All parts of an address are at most 255, leading zeros aside."""
    return rf"forall(split(regexp_replace({value}, '(^|\\.)0+(?=[0-9])', '$1'), '\\.'), p -> length(p) < 3 or length(p) = 3 and p <= '255')"


def base_spans(text: str) -> str:
    """All base spans, unordered."""
    card = lambda h: let(digits(h), "d", "length(d) between 14 and 19 and luhn_check(d)")
    spans = (
        found_if(f"contains({text}, '@')", find(text, EMAIL, "email", 0)),
        found_if(has(text, r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), find(text, IP, "ip", 1, octets)),
        found_if(has(text, r"[0-9](?:[\x20-]?[0-9]){13}"), find(text, CARD, "card", 2, card)),
        found_if(f"contains({text}, '+')", find(text, PHONE, "phone", 3, lambda h: f"length({digits(h)}) between 10 and 15")),
    )
    return f"concat({', '.join(spans)})"


def method_spans(text: str) -> str:
    """IBANs that hold, and proposals of local phone numbers, unordered."""
    iban = found_if(has(text, r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"), find(text, IBAN, "iban", 4, lambda h: f"{mod97(h)} = 1"))
    near = f"{has(text, f'(?i)(?:{CONTEXT["local_phone"]})')} and {has(text, '[0-9][0-9 ().-]{5}')}"
    local = found_if(near, find(text, LOCAL_PHONE, "local_phone", 5, lambda h: f"length({digits(h)}) between 7 and 12 and not {has(h, DATE)}"))
    return f"concat({iban}, {local})"


SCORED = SPAN.replace("kind:string", "kind:string,score:double")


def scored(text: str, spans: str) -> str:
    """Spans by start, then kind, with the score that the words around give."""
    whens = lambda value: "case s.kind " + " ".join(f"when '{k}' then {value(k)}" for k in KINDS) + " end"
    prior = whens(lambda k: f"{PRIOR[k]}D")
    helped = whens(lambda k: has("near", rf"(?i)\b(?:{CONTEXT[k]})\b"))
    against = has("near", rf"(?i)\b(?:{AGAINST})\b")
    score = f"round(greatest(least({prior} + if({helped}, 0.35D, 0D) - if({against}, 0.25D, 0D), 1D), 0D), 4)"
    near = f"concat_ws(' ', {cut('parts', f'greatest(s.start - {REACH}, 0)', 's.start')}, {cut('parts', 's.`end`', f's.`end` + {REACH}')})"
    row = f"named_struct('start', s.start, 'rank', s.rank, 'end', s.`end`, 'kind', s.kind, 'score', {let(near, 'near', score)})"
    some = let(blocks(text), "parts", f"array_sort(transform(found, s -> {row}))")
    return let(spans, "found", f"if(size(found) > 0, {some}, cast(array() as {SCORED}))")


def find_pii(docs: DataFrame) -> DataFrame:
    """Adds ``pii``: spans (start, rank, end, kind, score) of each (doc_id, text) row, by start, then kind.

    Base spans stay whatever their score; spans that the method adds are kept from ``THRESHOLD`` on, and only
    where they overlap no base span. A null text counts as empty and has no spans. Other columns pass through;
    a column named pii is replaced. A text with n spans takes n log n steps beside its length.
    """
    text = "coalesce(text, '')"
    more = f"filter({scored(text, method_spans(text))}, s -> s.score >= {THRESHOLD})"
    return docs.withColumn("pii", F.expr(with_base(scored(text, base_spans(text)), more)))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    base = f"filter(pii, s -> s.rank < {len(BASE)})"
    kinds = [f"{count('pii', k)} as n_{k}" for k in BASE]
    return found.selectExpr("doc_id", *kinds, f"{digest(base)} as base_sha256", f"{joined('pii')} as spans", "coalesce(array_max(transform(pii, s -> s.score)), 0D) as top_score")
