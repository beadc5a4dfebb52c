"""The compact query model: SELECT with aggregates, WHERE, GROUP BY, ORDER BY one column, LIMIT.

A query is built into one DataFrame plan, so Catalyst prunes columns and pushes filters down to the scan.
Order of evaluation: filter, group, order (output names first, then input columns), limit.
"""

from __future__ import annotations

import csv
import io
from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count_distinct": F.count_distinct}
OPERATORS = ("=", "!=", ">", "<", ">=", "<=", "contains", "in", "like")


@dataclass(frozen=True)
class Select:
    """A column, perhaps aggregated and renamed; ``*`` counts rows."""

    name: str
    agg: str | None = None
    alias: str | None = None

    @property
    def output(self) -> str:
        return self.alias or (f"{self.agg}_{'all' if self.name == '*' else self.name}" if self.agg else self.name)


@dataclass(frozen=True)
class Where:
    """One condition; the value is given as text (for ``in`` a list of texts) and takes the column's type."""

    column: str
    op: str
    value: str | list[str]


@dataclass(frozen=True)
class Query:
    select: list[Select]
    where: list[Where] = field(default_factory=list)
    group_by: list[str] = field(default_factory=list)
    order_by: str | None = None
    descending: bool = False
    limit: int | None = None


def _literal(text, kind: T.DataType) -> Column:
    """``text`` as a literal of the column's type; what does not parse is an error."""
    if isinstance(kind, T.IntegralType):
        return F.lit(int(text))
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        try:
            Decimal(str(text))
        except InvalidOperation:
            raise ValueError(f"{text!r} is no number") from None
        return F.lit(str(text)).cast(kind)
    if isinstance(kind, T.BooleanType):
        if str(text).lower() not in ("true", "false", "1", "0"):
            raise ValueError(f"{text!r} is no truth value")
        return F.lit(str(text).lower() in ("true", "1"))
    return F.lit(str(text)).cast(kind)


def condition(df: DataFrame, w: Where) -> Column:
    """The condition as a column; rows where it is unknown (null) do not pass."""
    if w.op not in OPERATORS:
        raise ValueError(f"operator {w.op!r}; there are {OPERATORS}")
    kind, c = df.schema[w.column].dataType, F.col(f"`{w.column}`")
    if w.op == "contains":
        return F.contains(c.cast("string"), F.lit(str(w.value)))
    if w.op == "like":
        return c.cast("string").like(str(w.value))
    if w.op == "in":
        return c.isin(*[_literal(v, kind) for v in w.value])
    value = _literal(w.value, kind)
    return {"=": c == value, "!=": c != value, ">": c > value, "<": c < value, ">=": c >= value, "<=": c <= value}[w.op]


def build(df: DataFrame, q: Query) -> DataFrame:
    """The query over a table as a DataFrame."""
    for w in q.where:
        df = df.filter(condition(df, w))
    aggregated = bool(q.group_by) or any(s.agg for s in q.select)
    if aggregated:
        plain = [s for s in q.select if not s.agg]
        loose = [s.name for s in plain if s.name not in q.group_by]
        if loose:
            raise ValueError(f"{loose} are neither grouped nor aggregated")
        aggregates = []
        for s in q.select:
            if s.agg:
                if s.agg not in AGGREGATES:
                    raise ValueError(f"aggregate {s.agg!r}; there are {sorted(AGGREGATES)}")
                aggregates.append((F.count("*") if s.name == "*" else AGGREGATES[s.agg](F.col(f"`{s.name}`"))).alias(s.output))
        if aggregates:
            out = df.groupBy(*q.group_by).agg(*aggregates)
        else:
            out = df.select(*q.group_by).distinct()
        names = [F.col(f"`{s.output}`") if s.agg else F.col(f"`{s.name}`").alias(s.output) for s in q.select]
        if q.order_by and q.order_by in out.columns and q.order_by not in [s.output for s in q.select]:
            return _tail(out, q).select(*names)
        return _tail(out.select(*names), q)
    names = [F.col(f"`{s.name}`").alias(s.output) for s in q.select]
    if q.order_by and q.order_by not in [s.output for s in q.select]:
        return _tail(df, q).select(*names)
    return _tail(df.select(*names), q)


def _tail(df: DataFrame, q: Query) -> DataFrame:
    if q.order_by:
        c = F.col(f"`{q.order_by}`")
        df = df.orderBy(c.desc_nulls_last() if q.descending else c.asc_nulls_last())
    return df if q.limit is None else df.limit(q.limit)


def sql(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """SQL text over named tables."""
    return spark.sql(text, **tables)


def to_csv(df: DataFrame, rows: int = 1000) -> str:
    """The first rows as quoted CSV with a header, for results of a readable size."""
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(df.columns)
    writer.writerows(["" if v is None else v for v in r] for r in df.limit(rows).collect())
    return out.getvalue()


def to_table(df: DataFrame, rows: int = 20, width: int = 40) -> str:
    """The first rows as an aligned text table, with the number of rows left out."""
    found = df.limit(rows + 1).collect()
    more = df.count() - rows if len(found) > rows else 0
    cells = [df.columns] + [["null" if v is None else str(v)[:width] for v in r] for r in found[:rows]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    lines = [" | ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip() for r in cells]
    lines.insert(1, "-+-".join("-" * w for w in widths))
    return "\n".join(lines + ([f"... {more} more rows"] if more else []))
