"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key divided by its quality weight; in the order of these keys a prefix is a weighted
sample without replacement. A source's target is met by complete epochs first, then by the prefix whose sizes add up to what is
left. The place where the prefix ends is found by adding up sizes in ever finer ranges of keys, so no source is ever
sorted in one task; what is selected is then a condition on each row alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrydf.llm import common

#: The table of sources is kept on the driver and broadcast, so their number is bounded; more are an error.
MAX_SOURCES = 10_000
#: Keys are fixed-point numbers; ranges of 2 to these powers are added up, coarse ones first.
_UNIT, _COARSE, _FINE = 32, 26, 10
#: After the first prefix, further prefixes of documents that still fit fill what the next whole document would overrun.
FILLS = 2
#: The smallest quality weight.
LEAST_QUALITY = 0.05


def word_count(text: Column) -> Column:
    """The number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def letter_share(text: Column) -> Column:
    """A quality weight from the text alone: the share of letters among its characters, between ``LEAST_QUALITY`` and 1."""
    body = F.coalesce(text, F.lit(""))
    share = F.length(F.regexp_replace(body, r"\P{L}+", "")) / F.greatest(F.length(body), F.lit(1))
    return F.greatest(share, F.lit(LEAST_QUALITY))


@dataclass(frozen=True)
class Source:
    """What the mix takes of one source: ``epochs`` complete passes, then the documents of ``spans``, each the keys
    after (key, tie) ``begin`` up to ``end`` among documents of at most ``fits`` words."""

    name: str | None
    size: int
    target: float
    epochs: int
    spans: list[tuple[tuple[int, int], tuple[int, int], int]]


def share_out(sizes: list[int], weights: list[float], total: float, max_epochs: float) -> list[float]:
    """``total`` dealt by weight; no share above ``max_epochs`` times its size, the excess dealt again until none is."""
    targets, open_ = [0.0] * len(sizes), [i for i, w in enumerate(weights) if w > 0]
    left = float(total)
    while open_:
        weight = math.fsum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > max_epochs * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / weight
            break
        for i in over:
            targets[i] = float(max_epochs * sizes[i])
        left = max(0.0, left - math.fsum(targets[i] for i in over))
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def mix_key(text: str, source: str, doc_id: str, quality: Column | None, seed: int) -> Column:
    """Source, size, key and tie-break of a row, from the row alone. The key is -ln(u) / weight for a u in (0, 1) that a hash of id and
    text gives, in units of 2^-32: the exponential form of u^(1 / weight), smallest first."""
    body = F.col(f"`{text}`").cast("string")
    tie = F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`").cast("string"), body)
    unit = (F.pmod(F.xxhash64(F.lit("unit"), tie), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)
    weight = F.least(F.greatest(F.coalesce(quality if quality is not None else letter_share(body), F.lit(LEAST_QUALITY)), F.lit(LEAST_QUALITY)), F.lit(1.0))
    key = F.floor(-F.log(unit) / weight * float(1 << _UNIT))
    return F.struct(F.col(f"`{source}`").cast("string").alias("source"), word_count(body).alias("size"), key.cast("long").alias("key"), tie.alias("tie"))


def _table(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of the driver, at most one row a source."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def _boundary(rows: DataFrame, level: Column, budgets: dict) -> dict:
    """For each source the first value of ``level`` at which the sizes, added up by level, pass its budget: (value, sum before).
    A source whose sizes stay within the budget is absent."""
    spark = rows.sparkSession
    limits = _table(spark, [(k, v) for k, v in budgets.items()], "source string, budget double")
    sums = rows.groupBy("source", level.alias("level")).agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("level"))
    run = sums.withColumn("upto", upto)
    past = run.join(limits, run["source"].eqNullSafe(limits["source"])).filter(F.col("upto") > F.col("budget"))
    found = past.groupBy(run["source"]).agg(F.min(F.struct("level", (F.col("upto") - F.col("size")).alias("before"))).alias("x"))
    return {r[0]: (r["x"]["level"], r["x"]["before"]) for r in found.collect()}


def _within(rows: DataFrame, cells: dict, shift: int) -> DataFrame:
    """The rows of each source whose key lies in its cell."""
    table = _table(rows.sparkSession, [(k, v) for k, v in cells.items()], "cell_source string, cell long")
    return rows.join(table, rows["source"].eqNullSafe(table["cell_source"]) & (F.shiftright("key", shift) == F.col("cell"))).drop("cell_source", "cell")


_FIRST, _LAST = (-1, -(1 << 63)), ((1 << 62), 0)


def _prefix(rows: DataFrame, budgets: dict) -> tuple[dict, dict]:
    """For each source the last (key, tie) whose prefix sum of sizes stays within the budget, and the rest of the budget.
    Sources of which everything fits end at ``_LAST`` and have no rest here."""
    ends = dict.fromkeys(budgets, _LAST)
    rests: dict = {}
    coarse = _boundary(rows, F.shiftright("key", _COARSE), budgets)
    if not coarse:
        return ends, rests
    inside = _within(rows, {k: v for k, (v, _) in coarse.items()}, _COARSE)
    left = {k: budgets[k] - before for k, (_, before) in coarse.items()}
    fine = _boundary(inside, F.shiftright("key", _FINE), left)
    left = {k: left[k] - before for k, (_, before) in fine.items()}
    cell = _within(rows, {k: v for k, (v, _) in fine.items()}, _FINE)
    # the last cell spans a millionth of a source's documents or fewer
    last = _boundary(cell, F.struct("key", "tie"), left)
    for k, (place, before) in last.items():
        ends[k] = (place["key"], place["tie"] - 1)
        rests[k] = left[k] - before
    return ends, rests


_SPANS = "array<struct<begin: struct<key: long, tie: long>, end: struct<key: long, tie: long>, fits: long>>"


def _chosen(spans: Column, here: Column, size: Column) -> Column:
    """Whether a document at the place ``here`` is in one of a source's spans."""
    return F.exists(spans, lambda s: (here > s["begin"]) & (here <= s["end"]) & (size <= s["fits"]))


def _closest(rows: DataFrame, gaps: dict, spans: dict) -> dict:
    """For each source the place of the document not yet taken whose size is closest to what is missing, if taking it brings the
    source closer to its target."""
    if not gaps:
        return {}
    table = _table(rows.sparkSession, [(k, float(v), spans[k]) for k, v in gaps.items()], f"at_source string, gap double, spans {_SPANS}")
    free = rows.join(table, rows["source"].eqNullSafe(table["at_source"])).filter(~_chosen(F.col("spans"), F.struct("key", "tie"), F.col("size")))
    off = F.abs(F.col("size") - F.col("gap"))
    best = free.filter(off < F.col("gap")).groupBy("at_source").agg(F.min(F.struct(off.alias("off"), "key", "tie")).alias("place"))
    return {r["at_source"]: r["place"] for r in best.collect() if r["place"]["tie"] > -(1 << 63)}


def plan(rows: DataFrame, weights: list[float], share: float = 1.5, max_epochs: int = 2) -> list[Source]:
    """Decide what a mix takes of each source: see :func:`mix`. rows: a written table of the fields of :func:`mix_key`; it is read a few times."""
    rows = rows.select("source", "size", "key", "tie")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    by_name = sorted(((r["source"], r["size"]) for r in sizes), key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8", "surrogatepass")))
    cycle = [float(weights[i % len(weights)]) for i in range(len(by_name))]
    amounts = [n for _, n in by_name]
    targets = share_out(amounts, cycle, share * sum(amounts), max_epochs)
    epochs = {k: min(int(t // n), max_epochs) if n else 0 for (k, n), t in zip(by_name, targets)}
    budgets = {k: t - epochs[k] * n for (k, n), t in zip(by_name, targets) if n and t > epochs[k] * n}
    spans: dict = {k: [] for k, _ in by_name}
    begins, fits = dict.fromkeys(budgets, _FIRST), dict.fromkeys(budgets, 1 << 62)
    for turn in range(1 + FILLS):
        if not budgets:
            break
        source_rows = rows
        if turn:
            table = _table(rows.sparkSession, [(k, *begins[k], fits[k]) for k in budgets], "at_source string, at_key long, at_tie long, fits long")
            after = (F.col("key") > F.col("at_key")) | ((F.col("key") == F.col("at_key")) & (F.col("tie") > F.col("at_tie")))
            source_rows = rows.join(table, rows["source"].eqNullSafe(table["at_source"]) & (F.col("size") <= F.col("fits")) & after).select("source", "size", "key", "tie")
        ends, rests = _prefix(source_rows, budgets)
        for k in budgets:
            spans[k].append((begins[k], ends[k], fits[k]))
        begins = {k: ends[k] for k in rests}
        fits = {k: int(rests[k]) for k in rests}
        budgets = {k: v for k, v in rests.items() if v >= 1}
    for k, place in _closest(rows, budgets, spans).items():
        spans[k].append(((place["key"], place["tie"] - 1), (place["key"], place["tie"]), 1 << 62))
    return [Source(k, n, t, epochs[k], spans[k]) for (k, n), t in zip(by_name, targets)]


#: The columns that a mix adds, with their names in :func:`_decided`.
ADDED = ["mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_taken"]


def _decided(rows: DataFrame, sources: list[Source]) -> DataFrame:
    """``row`` (a struct) of ``rows`` (``row`` and ``m``, the fields of :func:`mix_key`) and the columns that a mix adds: row by row, no shuffle."""
    table = _table(
        rows.sparkSession,
        [(s.name, s.size, s.target, s.epochs, [(b, e, f) for b, e, f in s.spans]) for s in sources],
        f"name string, source_size long, target double, epochs int, spans {_SPANS}",
    )
    joined = rows.join(table, rows["m.source"].eqNullSafe(table["name"]), "left")
    chosen = _chosen(F.col("spans"), F.struct(F.col("m.key").alias("key"), F.col("m.tie").alias("tie")), F.col("m.size"))
    copies = (F.coalesce("epochs", F.lit(0)) + F.coalesce(chosen.cast("int"), F.lit(0))).cast("int")
    added = [F.col("m.size"), F.col("source_size"), F.col("target"), copies, F.col("m.size") * copies]
    return joined.select("row", *[c.alias(n) for c, n in zip(added, ADDED)])


def _whole(df: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def mix(df: DataFrame, weights: list[float], share: float = 1.5, max_epochs: int = 2, text: str = "text", source: str = "source", doc_id: str = "doc_id", quality: Column | None = None, seed: int = 17) -> DataFrame:
    """``df`` with the mix's decision on each row: ``mix_size`` (words), ``mix_source_size``, ``mix_target`` (of the row's
    source), ``mix_copies`` (how often the mix holds it) and ``mix_taken`` (words, repeats counted).

    Sources, by code point with null last, weigh ``weights`` in turn and share ``share`` times all words; a target stops at
    ``max_epochs`` times its source's size and the excess is dealt again by weight. ``quality`` (0 to 1, default the share of letters)
    weighs documents in the fractional epoch. A document is taken whole or not at all; after the first prefix ``FILLS`` further
    ones fill what is missing with documents that still fit, and one more is taken if that brings the source closer to its
    target. Reruns agree. Null texts have size 0; repeated rows (equal id and text) are taken alike. An empty table
    gives an empty one. Columns of the five names are replaced, all others stay. The texts are read twice and never shuffled: once for the narrow
    table that decides, once to carry the decision out.
    """
    key = mix_key(text, source, doc_id, quality, seed).alias("m")
    with common.scratch(df.sparkSession):
        sources = plan(common.materialize(df.select(key).select("m.*"), "mix-keys"), weights, share, max_epochs)
    out = _decided(df.select(_whole(df), key), sources)
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns if c.lower() not in ADDED], *ADDED)


WEIGHTS = [3.0, 1.0, 2.0]


def op2_mixing(spark, sf_dir):
    """Mix all ``documents`` at source weights 3, 1, 2, repeating. The result needs no text, so it comes from the narrow written table."""
    docs = common.only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "source")
    rows = common.materialize(docs.select(F.struct("doc_id").alias("row"), mix_key("text", "source", "doc_id", None, 17).alias("m")), "mix-keys")
    mixed = _decided(rows, plan(rows.select("m.*"), WEIGHTS))
    return mixed.select("row.doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))
