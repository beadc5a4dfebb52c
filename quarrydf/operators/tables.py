"""Row numbers, chunks and row access.

Spark tables have no order, so everything positional takes an explicit unique key. Row numbers come from two passes: the counts of
key ranges give each range its first number, and inside a range a window counts on. No window spans the whole table.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a chunk unless told otherwise, rows that one key range should hold, most key ranges (their bounds are literals of the plan), and
#: sampled keys for each range.
CHUNK_ROWS, RANGE_ROWS, RANGES, SAMPLED = 65_536, 1_000_000, 16_384, 32


def _bounds(df: DataFrame, key: str, rows: int, ranges: int) -> list:
    """Keys that cut the table into about equal ranges: every so-many-th of a sample that a hash picks, so that it is the same whenever asked for."""
    every = max(1, rows // (ranges * SAMPLED))
    some = df.select(F.col(f"`{key}`").alias("k")).filter(F.col("k").isNotNull() & (F.pmod(F.xxhash64("k"), F.lit(every)) == 0)).distinct()
    found = sorted(r["k"] for r in some.collect())
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []


def _range_of(value: Column, bounds: list) -> Column:
    """How many of the sorted bounds lie below the value: first among every so-many-th, then among those between."""
    step = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    tops = F.array(*[F.lit(b[-1]) for b in blocks])
    inner = F.array(*[F.array(*[F.lit(x) for x in b]) for b in blocks])
    block = F.size(F.filter(tops, lambda b: b < value))
    return F.when(block == len(blocks), F.lit(len(bounds))).otherwise(block * step + F.size(F.filter(F.get(inner, block), lambda b: b < value)))


def with_row_id(df: DataFrame, key: str, name: str = "row_id", ranges: int | None = None) -> DataFrame:
    """``df`` with the place (from 0) of each row in the order of the column ``key``, of any type that can be ordered.

    The key must be unique and not null: a null or repeated key is an error when the rows are read. Ranges of keys are numbered independently.
    """
    rows = df.count() if ranges is None else None
    if ranges is None:
        ranges = min(RANGES, max(1, -(-rows // RANGE_ROWS)))
    value = F.col(f"`{key}`")
    at, first, bounds = "__range", F.lit(0).cast("bigint"), []
    if ranges > 1:
        bounds = _bounds(df, key, rows if rows is not None else df.count(), ranges)
    ranged = df.withColumn(at, _range_of(value, bounds) if bounds else F.lit(0))
    if bounds:
        counts = {r[at]: r["count"] for r in ranged.groupBy(at).count().collect()}
        firsts = list(accumulate((counts.get(i, 0) for i in range(len(bounds))), initial=0))
        first = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in firsts]), F.col(at) + 1)
    order = Window.partitionBy(at).orderBy(value)
    place = first + F.row_number().over(order).cast("bigint") - 1
    wrong = F.when(value.isNull(), F.raise_error(F.lit(f"{key} is null")).cast("bigint")).when(F.lag(value).over(order) == value, F.raise_error(F.lit(f"{key} is not unique")).cast("bigint"))
    return ranged.withColumn(name, wrong.otherwise(place)).drop(at)


def with_chunk_id(df: DataFrame, row_id: str = "row_id", name: str = "chunk_id", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``df`` with the chunk of each row: its number divided by the rows of a chunk."""
    if chunk_rows < 1:
        raise ValueError("chunk_rows must be positive")
    return df.withColumn(name, F.expr(f"`{row_id}` div {chunk_rows}"))


def row_at(df: DataFrame, row: int, row_id: str = "row_id") -> DataFrame:
    """The row of this number; none if there is no such row."""
    return df.filter(F.col(row_id) == row)


def row_range(df: DataFrame, start: int, end: int, row_id: str = "row_id") -> DataFrame:
    """Rows from ``start`` up to, not including, ``end``; an end beyond the table is its end, and start >= end gives none."""
    return df.filter((F.col(row_id) >= start) & (F.col(row_id) < end))


def project(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; a missing one is an error."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no column {missing}; there are {df.columns}")
    return df.select(*[F.col(f"`{n}`") for n in names])


def as_text(df: DataFrame) -> DataFrame:
    """All cells as strings."""
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def union_by_name(*tables: DataFrame) -> DataFrame:
    """The rows of all tables; columns meet by name and missing ones are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
