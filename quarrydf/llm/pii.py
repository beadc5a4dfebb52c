"""Personal data, with DataFrame functions only.

Regular expressions propose spans, checksum validators (Luhn for cards, mod 97 for bank accounts) confirm them, and words
close to a span raise or lower its score. Spans count code points, end exclusive.

A pattern's matches and the texts between them (``regexp_extract_all`` and ``split`` with the same pattern) give each
match's place by adding up lengths block by block, and a span's surroundings are looked up in a piece of the text, so no position is searched twice. The patterns use possessive loops and start only
where a run of their first characters starts or the last match ended; that finds the same leftmost matches in linear time
and without deep recursion, on words of any length.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrydf.llm import common

#: Code points on each side of a span that are searched for context words.
WINDOW = 40


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: its pattern, a cheap test whether a text can hold it, its validator, the score of a span
    without context, and the context words that raise it (``raises``) or lower it (``lowers``)."""

    name: str
    pattern: str
    possible: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    score: float
    raises: str
    lowers: str
    base: bool = True


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    from_right = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(from_right, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether letters and digits pass the mod 97 check of international bank accounts."""
    packed = F.regexp_replace(account, " ", "")
    turned = F.split(F.concat(F.substring(packed, 5, 64), F.substring(packed, 1, 4)), "")
    value = F.transform(turned, lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).when(c == "", F.lit(None).cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(F.filter(value, lambda v: v.isNotNull()), F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


_LOCAL = "A-Za-z0-9._%+-"
#: In the order in which spans of equal start are listed.
KINDS = [
    Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: F.contains(t, F.lit("@")), lambda m: F.lit(True), 0.9, "mail|contact|write|reach", "example"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda m: ~m.rlike(r"(?:^|\.)0*+(?:25[6-9]|2[6-9][0-9]|[3-9][0-9]{2}|[0-9]{4,})(?:\.|$)"), 0.6, "ip|host|server|address", "version|release|chapter|section"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), lambda m: F.when(_between(F.length(_digits(m)), 14, 19), luhn(_digits(m))).otherwise(False), 0.7, "card|visa|pay|credit|carte|tarjeta|karte", "order|isbn|invoice"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+")), lambda m: _between(F.length(_digits(m)), 10, 15), 0.7, "phone|call|tel|mobile|fax", "sum|plus|total"),
    Kind("iban", r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])", lambda t: t.rlike("[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"), lambda m: F.when(_between(F.length(F.regexp_replace(m, " ", "")), 15, 34), mod97(m)).otherwise(False), 0.9, "iban|account|bank|konto|compte|cuenta", "serial|part", base=False),
]
_SPAN = "array<struct<kind: string, start: long, end: long, value: string, score: double>>"
#: Values that are added up one after the other, and code points of the pieces in which a text is looked up by place.
_BLOCK, _PIECE = 128, 1024


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _scan(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array of longs what ``merge`` makes, from 0, of those before it, and at the end that of all.

    Appending copies an array, so it is done in blocks of ``_BLOCK``, and for the blocks' totals again in blocks.
    """
    none = F.array().cast("array<long>")

    def append(xs):
        start = F.struct(F.lit(0).cast("long").alias("so_far"), none.alias("out"))
        return F.aggregate(xs, start, lambda s, x: F.struct(merge(s["so_far"], x).alias("so_far"), F.concat(s["out"], F.array(s["so_far"])).alias("out")))

    def blocks(xs):
        return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(xs) / _BLOCK).cast("int") - 1, F.lit(0))), lambda k: append(F.slice(xs, k * _BLOCK + 1, F.lit(_BLOCK))))

    def level(xs, offsets):
        def joined(parts, before):
            own = F.flatten(F.zip_with(parts, before, lambda p, b: F.transform(p["out"], lambda x: merge(b, x))))
            return F.concat(own, F.array(merge(F.element_at(before, -1), F.element_at(parts, -1)["so_far"])))

        return _bind(blocks(xs), lambda parts: _bind(F.slice(offsets(F.transform(parts, lambda p: p["so_far"])), F.lit(1), F.size(parts)), lambda before: joined(parts, before)))

    return _bind(values, lambda xs: level(xs, lambda sums: level(sums, lambda top: append(top)["out"])))


def _pieces(text: Column) -> Column:
    """The text cut into pieces of ``_PIECE`` code points, so that a place is found without counting from the start."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_PIECE}}}"), F.lit(0))


def _cut(pieces: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` up to ``end`` of a text in pieces; what lies outside the text is left out."""
    low, high = F.greatest(start, F.lit(0).cast("long")), F.greatest(end, F.lit(0).cast("long"))
    first = F.floor(low / _PIECE).cast("int")
    some = F.slice(pieces, first + 1, F.floor(high / _PIECE).cast("int") - first + 1)
    return F.substring(F.array_join(some, ""), (low % _PIECE + 1).cast("int"), F.greatest(high - low, F.lit(0).cast("long")).cast("int"))


_STEP = "array<struct<m: string, g: long, step: long>>"


def _matches(text: Column, kind: Kind) -> Column:
    """The matches of one kind, each with the length of the gap before it and the step from the end of the last match to its own."""
    gaps = F.transform(F.split(text, kind.pattern, -1), lambda g: F.length(g).cast("long"))
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g"), (g + F.length(m)).alias("step")))
    # the gap after the last match has none
    return F.when(kind.possible(text), F.filter(pairs, lambda p: p["m"].isNotNull()).cast(_STEP)).otherwise(F.array().cast(_STEP))


def _spans(text: Column, kinds: list[Kind]) -> Column:
    """The confirmed spans as an array of (start, rank, end, value), by start, then by rank."""

    def placed(found, rank):
        ends = _scan(F.transform(found, lambda p: p["step"]), lambda a, b: a + b)
        return F.zip_with(found, F.slice(ends, F.lit(2), F.size(found)), lambda p, end: F.struct((end - p["step"] + p["g"]).alias("start"), rank.alias("rank"), end.alias("end"), p["m"].alias("value")))

    def confirmed(found, kind):
        return F.filter(found, lambda s: kind.valid(s["value"]))

    every = F.transform(F.array(*[_matches(text, kind) for kind in kinds]), placed)
    return _bind(every, lambda found: F.array_sort(F.concat(*[confirmed(F.element_at(found, k + 1), kind) for k, kind in enumerate(kinds)])))


def find(df: DataFrame, text: str = "text", spans: str = "pii", kinds: list[Kind] = KINDS) -> DataFrame:
    """``df`` with ``spans``: an array of (kind, start, end, value, score), by start, then in the order of ``kinds``.

    Null texts count as empty and, like any text without findings, give an empty array. Row by row, no shuffle, whole texts, in time
    that grows with a text and its spans; repeated rows get equal results and an empty table stays empty. A column
    named ``spans`` is replaced, all others stay. Spans of different kinds may overlap. The score is the kind's own, 0.1 higher (at most 1)
    with a raising word within ``WINDOW`` code points, 0.3 lower with a lowering one; nothing is dropped for its score.
    """
    held, near = common.fresh(df, "pii_text", spans), common.fresh(df, "pii_found", spans)
    source = df.withColumn(held, common.text_of(text))
    body = F.col(held)
    found = source.withColumn(near, _spans(body, kinds))

    names = F.array(*[F.lit(k.name) for k in kinds])

    def scored(s, pieces):
        around = F.lower(F.concat(_cut(pieces, s["start"] - WINDOW, s["start"]), F.lit(" "), _cut(pieces, s["end"], s["end"] + WINDOW)))

        def score(near_by):
            out = F.lit(0.0)
            for rank, kind in enumerate(kinds):
                raised = F.least(F.lit(1.0), F.lit(kind.score) + F.when(near_by.rlike(rf"\b(?:{kind.raises})"), 0.1).otherwise(0.0))
                out = F.when(s["rank"] == rank, raised - F.when(near_by.rlike(rf"\b(?:{kind.lowers})"), 0.3).otherwise(0.0)).otherwise(out)
            return out

        return F.struct(F.element_at(names, s["rank"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), _bind(around, score).alias("score"))

    some = _bind(_pieces(body), lambda pieces: F.transform(F.col(near), lambda s: scored(s, pieces)).cast(_SPAN))
    return found.withColumn(spans, F.when(F.size(near) > 0, some).otherwise(F.array().cast(_SPAN))).drop(held, near)


def redact(df: DataFrame, text: str = "text", spans: str = "pii", out: str = "redacted", least_score: float = 0.5) -> DataFrame:
    """``df`` with ``out``: the text with its spans of at least this score replaced by their kind in angle brackets; spans that
    overlap are replaced as one, by the kind of the first. Null texts give empty ones. Linear like :func:`find`."""

    def cleaned(pieces, chosen):
        upto = _scan(F.transform(chosen, lambda s: s["end"]), lambda a, b: F.greatest(a, b))

        def text_of(ends):
            parts = F.zip_with(chosen, F.slice(ends, F.lit(1), F.size(chosen)), lambda s, e: F.when(s["start"] >= e, F.concat(_cut(pieces, e, s["start"]), F.lit("<"), s["kind"], F.lit(">"))).otherwise(F.lit("")))
            return F.concat(F.array_join(parts, ""), _cut(pieces, F.element_at(ends, -1), F.lit((1 << 31) - 1)))

        return _bind(upto, text_of)

    chosen = F.filter(F.col(f"`{spans}`"), lambda s: s["score"] >= least_score)
    return df.withColumn(out, _bind(_pieces(common.text_of(text)), lambda pieces: _bind(chosen, lambda some: cleaned(pieces, some))))


def op5_pii(spark, sf_dir):
    """Spans of personal data in every text of ``documents``, and the scores of the spans (``kind:start:score``)."""
    docs = common.only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    found = find(docs).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["kind"].isin([k.name for k in KINDS if k.base]))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda name: F.size(F.filter("pii", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    scores = F.array_join(F.transform("pii", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), F.format_number(s["score"], 2))), ",")
    total = F.size("pii").cast("long")
    return found.select("doc_id", *[count(n) for n in ("email", "ip", "card", "phone")], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), total.alias("n_spans"), scores.alias("scores"))
