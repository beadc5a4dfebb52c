"""Tables as Parquet folders: writing with chunk size, codec, bloom filters and partitions, and reading with pruning.

Paths may be local or in any store that Spark is set up for (``s3a://``, ``gs://``, ``abfss://``): nothing here opens a file itself.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrydf.functions.schema import parse_schema
from quarrydf.operators.tables import project, union_by_name
from quarrydf.sources.interchange import file_stats

MODES = ("error", "append", "overwrite", "ignore")


def from_rows(spark: SparkSession, rows: Iterable[Sequence], schema: str | T.StructType) -> DataFrame:
    """A table from rows; a row of another length or type is an error, no rows are an empty table."""
    return spark.createDataFrame(list(rows), parse_schema(schema) if isinstance(schema, str) else schema)


def from_columns(spark: SparkSession, columns: Mapping[str, Sequence], schema: str | T.StructType | None = None) -> DataFrame:
    """A table from columns of equal length, through Arrow."""
    if len({len(v) for v in columns.values()}) > 1:
        raise ValueError("columns differ in length")
    wanted = parse_schema(schema) if isinstance(schema, str) else schema
    if not columns or not len(next(iter(columns.values()))):
        return spark.createDataFrame([], wanted or T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    df = spark.createDataFrame(pa.table({k: pa.array(v) for k, v in columns.items()}))
    return df if wanted is None else df.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in wanted])


def write(
    df: DataFrame,
    path: str,
    mode: str = "error",
    codec: str = "zstd",
    chunk_bytes: int | None = None,
    rows_per_file: int | None = None,
    bloom: Sequence[str] = (),
    partition_by: Sequence[str] = (),
    sort_by: Sequence[str] = (),
) -> None:
    """Write a table; Spark's commit protocol replaces files only when all are written.

    ``chunk_bytes`` is the size of a row group, the unit that zone maps skip; ``sort_by`` orders rows inside each file so that they
    can; ``bloom`` columns get bloom filters (their dictionaries are turned off, else Parquet leaves the filter out).
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode!r}; there are {MODES}")
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    writer = df.write.mode(mode).option("compression", codec)
    if chunk_bytes:
        writer = writer.option("parquet.block.size", chunk_bytes)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    for c in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.enable.dictionary#{c}", "false")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read(spark: SparkSession, *paths: str, columns: Sequence[str] = (), merge: bool = False) -> DataFrame:
    """A table from one or more folders, which may be partitioned differently; columns meet by name, missing ones are null.
    With ``merge`` the schemas of a folder's files are united too."""
    df = union_by_name(*[spark.read.option("mergeSchema", merge).parquet(p) for p in paths])
    return project(df, *columns) if columns else df


def report(spark: SparkSession, path: str) -> str:
    """What was written, in one line."""
    s = file_stats(spark, path)
    return f"{s['rows']} rows, {s['columns']} columns, {s['bytes']} bytes, {100 * s['ratio']:.1f} % of plain cells"


def partitions(spark: SparkSession, path: str) -> int:
    """The number of partition folders."""
    return spark.read.parquet(path).select(F.regexp_replace(F.input_file_name(), "/[^/]*$", "")).distinct().count()
