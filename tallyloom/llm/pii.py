"""Personal data, in DataFrame operations only: regular expressions propose, checksums confirm, context scores.

`regexp_extract_all` gives a kind's matches and `split` by the same pattern the text between them, so running
sums of lengths give each match's place in code points, and the neighbouring pieces its context. Validators
(octets of an address, Luhn for cards, digits of phones, mod-97 for IBANs) are expressions over the match.
Context words near a span raise or lower its score; spans of the base kinds stay whatever the score, IBANs
need `min_score`.

The patterns are written so that Java's engine takes linear time and constant stack on any text: runs are
possessive, and a match may only begin at a run's first character or where the last match ended.

Defined results: a null text is an empty one; rows are independent, so repeated ids give repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOCAL = "[A-Za-z0-9._%+-]"

# Patterns of the kinds, and a cheap test that a text can hold any.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:[\x20-]?[A-Z0-9]){11,30}+",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"(?:[0-9][\x20-]?){12}[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}"}
BASE = ("email", "ip", "card", "phone")

# Score of a confirmed span, words that raise it and words that lower it by 0.3. An added span counts from 0.5 on: an
# IBAN unless words speak against it, a social security number, which has no check digit, only if words speak for it.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "ssn": 0.4}
RAISE = {
    "email": "mail|contact|write|reach|kontakt|courriel|correo",
    "ip": "ip|host|server|address|login|client|adresse",
    "card": "card|visa|credit|debit|payment|pay|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|cell|telefon|appel|llama",
    "iban": "iban|bank|account|transfer|konto|compte|cuenta",
    "ssn": "ssn|social|taxpayer|identity",
}
LOWER = {"email": "example|noreply", "ip": "version|release|section|chapter", "card": "order|serial|isbn|invoice", "phone": "isbn|version|score", "iban": "serial|part", "ssn": "serial|part|order|phone"}
NEAR = 40


def _octets(match: Column) -> Column:
    one = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return match.rlike(rf"^{one}\.{one}\.{one}\.{one}$")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""

    def add(total: Column, i: Column) -> Column:
        d = digits.substr(F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without blanks leaves 1 when its rearranged number is divided by 97."""
    turned = F.concat(iban.substr(F.lit(5), F.length(iban)), iban.substr(1, 4))

    def add(rest: Column, i: Column) -> Column:
        code = F.ascii(turned.substr(i, F.lit(1)))
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return _octets(match)
    if kind == "card":
        digits = F.regexp_replace(match, "[^0-9]", "")
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(9, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(match, "[^A-Z0-9]", ""))
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _score(kind: str, before: Column, after: Column) -> Column:
    context = F.lower(F.concat_ws(" ", F.right(before, F.lit(NEAR)), F.left(after, F.lit(NEAR))))
    moved = F.lit(SCORES[kind]) + F.when(context.rlike(rf"\b(?:{RAISE[kind]})"), 0.3).otherwise(0.0) - F.when(context.rlike(rf"\b(?:{LOWER[kind]})"), 0.3).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), moved)), 3)


def _let(value: Column, then) -> Column:
    """`then` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), 0)


def running_sums(steps: Column, block: int = 256) -> Column:
    """0 and the sums of the first 1, 2, ... elements of an array that is not empty.

    An array that grows is copied at each step, so sums run within blocks, and the blocks' own sums apart.
    """

    def grow(values: Column) -> Column:
        return F.aggregate(values, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def blocks(steps: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / block).cast("int")), lambda b: grow(F.slice(steps, b * block + 1, F.lit(block))))

    def moved(inner: Column, before: Column) -> Column:
        return F.transform(inner, lambda v, b: _let(F.get(before, b), lambda c: F.transform(F.slice(v, F.lit(2), F.size(v)), lambda x: x + c)))

    def joined(inner: Column) -> Column:
        return _let(grow(F.transform(inner, lambda v: F.element_at(v, -1))), lambda before: F.flatten(moved(inner, before)))

    return F.concat(F.array(F.lit(0)), _let(_let(steps, blocks), joined))


def find_spans(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """(doc_id, text, spans): spans of kind, start, end (code points, end exclusive), value and score, by kind, then start."""
    out = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    gate = {k: F.col("text").contains(g) if k == "email" else F.col("text").rlike(g) for k, g in GATES.items()}
    out = out.select("doc_id", "text", *(F.when(gate[k], F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias(f"{k}_m") for k, p in PATTERNS.items()))
    out = out.select("*", *(F.when(F.size(f"{k}_m") > 0, F.split("text", p, -1)).alias(f"{k}_g") for k, p in PATTERNS.items()))

    def offsets(k: str) -> Column:  # where each piece between the matches begins
        return running_sums(F.transform(f"{k}_m", lambda m, i: F.length(m) + F.length(F.get(f"{k}_g", i))))

    out = out.select("*", *(F.when(F.size(f"{k}_m") > 0, offsets(k)).alias(f"{k}_o") for k in PATTERNS))

    def spans(k: str) -> Column:
        def span(m: Column, i: Column) -> Column:
            gap = F.get(f"{k}_g", i)
            start = F.get(f"{k}_o", i) + F.length(gap)
            return F.when(_valid(k, m), F.struct(F.lit(k).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"), m.alias("value"), _score(k, gap, F.get(f"{k}_g", i + 1)).alias("score")))

        found = F.filter(F.transform(f"{k}_m", span), lambda s: s.isNotNull() if k in BASE else s.isNotNull() & (s["score"] >= min_score))
        return F.when(F.size(f"{k}_m") > 0, found).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,value:string,score:double>>"))

    return out.select("doc_id", "text", F.concat(*(spans(k) for k in PATTERNS)).alias("spans"))


def pii_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_iban, n_ssn, scores, top_score) of each document; scores are the spans', joined likewise."""
    found = find_spans(docs).select("doc_id", "spans")
    places = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    base = F.transform(F.filter("spans", lambda s: s["kind"].isin(*BASE)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *(count(k) for k in BASE),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(places, ",").alias("spans"),
        count("iban"),
        count("ssn"),
        F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 1)), ",").alias("scores"),
        F.array_max(F.transform("spans", lambda s: s["score"])).alias("top_score"),
    )
