"""Statistics: zone maps, column profiles, compression and cost estimates."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zone_map(df: DataFrame, columns: list[str], chunk_id: str = "chunk_id") -> DataFrame:
    """For each chunk: ``n_rows`` and for each column ``<c>_min``, ``<c>_max`` and ``<c>_nulls``, in the column's own type."""
    aggs = [F.count("*").alias("n_rows")]
    for c in columns:
        col = F.col(f"`{c}`")
        aggs += [F.min(col).alias(f"{c}_min"), F.max(col).alias(f"{c}_max"), F.count_if(col.isNull()).alias(f"{c}_nulls")]
    return df.groupBy(chunk_id).agg(*aggs)


def surviving(zones: DataFrame, column: str, op: str, value) -> DataFrame:
    """The chunks that may hold a row for which ``column op value``; a chunk without known bounds cannot."""
    low, high, v = F.col(f"{column}_min"), F.col(f"{column}_max"), F.lit(value)
    tests = {"=": (low <= v) & (high >= v), "!=": (low != v) | (high != v), ">": high > v, ">=": high >= v, "<": low < v, "<=": low <= v}
    return zones.filter(tests[op])


def entropy_ratio(distinct: Column, rows: Column) -> Column:
    """The size estimate used by the cost model: binary entropy of distinct/rows over 8; 0.1 where that share is 0 or 1; 0 without values."""
    p = distinct / rows
    return F.when(F.coalesce(distinct, F.lit(0)) == 0, F.lit(0.0)).when(p >= 1, F.lit(0.1)).otherwise((-p * F.log2(p) - (1 - p) * F.log2(1 - p)) / 8)


def simple_ratio(distinct: Column, rows: Column) -> Column:
    """1 / (1 + distinct / rows); 0 without rows."""
    return F.when(rows > 0, 1.0 / (1.0 + distinct / rows)).otherwise(0.0)


def column_stats(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """One row a column: name, rows, distinct, nulls, least and greatest value (as text).

    One pass per column group: the distinct counts of all columns come from a single aggregate; ``approximate`` replaces them with
    sketches, which need no expansion of the rows.
    """
    columns = columns or df.columns
    count = F.approx_count_distinct if approximate else F.count_distinct
    parts = []
    for i, c in enumerate(columns):
        col = F.col(f"`{c}`")
        parts += [count(col).alias(f"d{i}"), F.count_if(col.isNull()).alias(f"n{i}"), F.min(col).cast("string").alias(f"a{i}"), F.max(col).cast("string").alias(f"b{i}")]
    wide = df.agg(F.count("*").alias("rows"), *parts)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("rows").alias("n_rows"), F.col(f"d{i}").alias("n_distinct"), F.col(f"n{i}").alias("n_nulls"), F.col(f"a{i}").alias("min_value"), F.col(f"b{i}").alias("max_value")) for i, c in enumerate(columns)])
    return wide.select(F.inline(rows))


def with_ratio(stats: DataFrame) -> DataFrame:
    """Column statistics with ``ratio``."""
    return stats.withColumn("ratio", entropy_ratio(F.col("n_distinct"), F.col("n_rows")))


def query_cost(stats: DataFrame, columns: list[str], filtered: bool) -> DataFrame:
    """Estimated cost of reading columns: the sum of rows times ratio, halved if there is a predicate."""
    chosen = with_ratio(stats).filter(F.col("column_name").isin(columns))
    return chosen.agg((F.sum(F.col("n_rows") * F.col("ratio")) * (0.5 if filtered else 1.0)).alias("cost"))


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """Values and their counts; by count, largest first, then by value."""
    return df.groupBy(F.col(f"`{column}`").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("value"))


def size_estimate(rows: int, columns: int, chunk_rows: int = 65_536, cell_bytes: int = 50) -> dict:
    """Chunks, and uncompressed bytes at a fixed number of bytes a cell."""
    return {"rows": rows, "columns": columns, "chunks": -(-rows // chunk_rows), "bytes": rows * columns * cell_bytes}


class MetadataCache:
    """Statistics by table name, forgotten after ``ttl`` seconds."""

    def __init__(self, ttl: float = 300.0, clock=time.monotonic):
        self.ttl, self._clock, self._kept = ttl, clock, {}

    def put(self, table: str, value) -> None:
        self._kept[table] = (self._clock(), value)

    def get(self, table: str):
        at, value = self._kept.get(table, (None, None))
        if at is None or self._clock() - at > self.ttl:
            self._kept.pop(table, None)
            return None
        return value


def all_of(conditions: list[Column]) -> Column:
    """The conjunction; true for none."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
