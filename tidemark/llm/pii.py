"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust their score.

Expressions only, row by row: nothing is shuffled. Where a pattern's runs
can't match from their middle, it is held to a run's start (or the end of
the match before), so that long runs are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import let

#: Fixed by the contract: the kinds in their order, and what each accepts. Possessive where nothing that follows could want a part back.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Spans that the method adds.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
NATIONAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
KINDS = ("email", "ip", "card", "phone", "iban", "national_id")
BASE = KINDS[:4]
#: What a proposed span scores by its form and checksum, and words within CONTEXT characters before it that add CONTEXT_SCORE.
FORM = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "national_id": 0.3}
CONTEXT_WORDS = {
    "email": r"(?i)e-?mail|contact|write",
    "ip": r"(?i)\bip\b|host|server|address",
    "card": r"(?i)card|visa|credit|payment",
    "phone": r"(?i)phone|tel|call|mobile|fax",
    "iban": r"(?i)iban|bank|account",
    "national_id": r"(?i)ssn|social security|national id|tax id",
}
CONTEXT, CONTEXT_SCORE, LEAST = 40, 0.4, 0.5


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def total(d: Column) -> Column:
        def step(sum_: Column, i: Column) -> Column:
            x = F.substring(d, i, F.lit(1)).cast("int")
            doubled = (F.length(d) - i) % 2 == 1
            return sum_ + F.when(doubled, 2 * x - F.when(2 * x > 9, 9).otherwise(0)).otherwise(x)

        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step) % 10 == 0

    return let(value, total)


def mod97(value: Column) -> Column:
    """Whether an account number leaves 1 when its letters are two-digit numbers and its first four characters come last."""

    def step(rest: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (rest * 10 + (F.ascii(c) - 48)) % 97).otherwise((rest * 100 + (F.ascii(c) - 55)) % 97)

    def rest(v: Column) -> Column:
        turned = F.concat(F.substring(v, F.lit(5), F.length(v)), F.substring(v, 1, 4))
        return F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(step(r, c))) == 1

    return let(F.translate(value, " ", ""), rest)


def accepted(kind: str, value: Column) -> Column:
    if kind == "ip":
        octet = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return value.rlike(rf"^{octet}\.{octet}\.{octet}\.{octet}$")
    if kind == "card":
        return let(digits(value), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    if kind == "iban":
        return value != ""
    return F.lit(True)


def first_valid(value: Column) -> Column:
    """The longest part of a proposed account number, from its start and up to the end of a group, that passes its check; empty if none does."""

    def part(v: Column) -> Column:
        ends = F.filter(F.sequence(F.length(v), F.lit(15), F.lit(-1)), lambda n: (F.substring(v, n + 1, F.lit(1)).isin("", " ")) & (F.substring(v, n, F.lit(1)) != " "))
        return F.coalesce(F.substring(v, F.lit(1), F.get(F.filter(ends, lambda n: mod97(F.substring(v, F.lit(1), n))), F.lit(0))), F.lit(""))

    return let(value, part)


def total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def begins(gaps: Column, values: Column) -> Column:
    """Where each value starts, if gaps and values take turns.

    In two levels, the sums of blocks and those within one: a text of n values takes n times the root of n additions, and no array is
    copied as it grows.
    """

    def blocked(lengths: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(lengths))).cast("int")
        sums = F.transform(F.sequence(F.lit(0), F.size(lengths) - 1, size), lambda k: total(F.slice(lengths, k + 1, size)))
        before = let(sums, lambda b: F.transform(b, lambda _, k: total(F.slice(b, F.lit(1), k))))

        def begin(at: Column) -> Column:
            return F.transform(values, lambda _, i: F.get(at, F.floor(i / size).cast("int")) + total(F.slice(lengths, i - i % size + 1, i % size)) + F.length(F.get(gaps, i)))

        return let(before, begin)

    return let(F.transform(values, lambda v, i: F.length(F.get(gaps, i)) + F.length(v)), blocked)


def found(text: Column, kind: str, pattern: str) -> Column:
    """Accepted spans of a kind: start and end in code points, the kind's number, score and whether it counts."""
    number = KINDS.index(kind)

    def placed(values: Column) -> Column:
        def along(gaps: Column) -> Column:
            def spans(at: Column) -> Column:
                def span(v: Column, i: Column) -> Column:
                    own = first_valid(v) if kind == "iban" else v
                    before = F.right(F.get(gaps, i), F.lit(CONTEXT))
                    return let(own, lambda x: F.struct(F.get(at, i).alias("start"), F.lit(number).alias("kind"), (F.get(at, i) + F.length(x)).alias("end"), x.alias("value"), before.alias("before")))

                return F.transform(values, span)

            return let(begins(gaps, values), spans)

        return F.when(F.size(values) > 0, let(F.split(text, pattern, -1), along)).otherwise(F.array())

    spans = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    spans = F.filter(spans, lambda s: accepted(kind, s["value"]))
    score = lambda s: FORM[kind] + F.when(s["before"].rlike(CONTEXT_WORDS[kind]), CONTEXT_SCORE).otherwise(0.0)
    return F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"], F.round(score(s), 2).alias("score")))


def listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): the spans of every row in order of start and kind, each with its score.

    Spans of the contract's four kinds always count; those that the method adds count from a score of LEAST on. A null text is empty and
    has none. Rows are handled one by one, repeated ones alike.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    t = F.col("text")
    none = F.array().cast("array<struct<start:int,kind:int,end:int,score:double>>")
    has = {"email": F.contains(t, F.lit("@")), "phone": F.contains(t, F.lit("+"))}
    patterns = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE, IBAN, NATIONAL), strict=True))
    parts = []
    for kind, pattern in patterns.items():
        spans = found(t, kind, pattern)
        if kind not in BASE:
            spans = F.filter(spans, lambda s: s["score"] >= LEAST)
        parts.append(F.when(has[kind], spans).otherwise(none) if kind in has else spans)
    return own.select("doc_id", F.sort_array(F.concat(*parts)).alias("spans"))


def digest(spans: DataFrame) -> DataFrame:
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    counts = [of(k).alias(f"n_{name}") for k, name in enumerate(BASE)]
    scores = F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",")
    return spans.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), scores.alias("scores"))
