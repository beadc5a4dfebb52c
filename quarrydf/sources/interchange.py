"""Conversions: CSV, the bracketed text forms, Parquet, batches of files, and byte comparison."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrydf.functions.schema import parse_schema, schema_text

#: The marker of a null cell in text forms.
NULL = "NULL"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, strict: bool = True) -> DataFrame:
    """A CSV file with a header. Without a schema every column is a string: types are never guessed from the data. Cells may hold line breaks
    and quotes; the marker is a null, the marker after a backslash the text itself."""
    reader = spark.read.option("header", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").options(**_CSV)
    wanted = parse_schema(schema) if isinstance(schema, str) else schema
    df = reader.csv(path) if wanted is None else reader.schema(T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.StringType) else f.dataType) for f in wanted])).csv(path)
    marked = lambda c: F.when(F.col(f"`{c}`").rlike(_MARKED), F.expr(f"substring(`{c}`, 2)")).otherwise(F.col(f"`{c}`")).alias(c)
    return df.select(*[marked(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema])


#: Quotes are doubled inside quotes, and nothing is trimmed: any text survives.
_CSV = {"nullValue": NULL, "quote": '"', "escape": '"', "multiLine": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": ""}
_MARKED = rf"^\\+{NULL}$"


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """A folder of CSV files with headers that :func:`read_csv` reads back whole; a text cell that is the null marker gets a backslash before it."""
    text = lambda c: F.when(F.col(f"`{c}`").rlike(rf"^\\*{NULL}$"), F.concat(F.lit("\\"), F.col(f"`{c}`"))).otherwise(F.col(f"`{c}`")).alias(c)
    marked = df.select(*[text(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema])
    marked.write.mode(mode).option("header", True).options(**(_CSV | {"emptyValue": '""', "quoteAll": False})).csv(path)


def csv_to_parquet(spark: SparkSession, source: str, target: str, schema: T.StructType | str | None = None, codec: str = "zstd") -> None:
    read_csv(spark, source, schema).write.option("compression", codec).parquet(target)


def bracketed(df: DataFrame, name: str = "line") -> DataFrame:
    """Each row as ``[a,b,...]``; null cells are the marker."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(NULL)) for c in df.columns]
    return df.select(F.concat(F.lit("["), F.concat_ws(",", *cells), F.lit("]")).alias(name))


def piped(df: DataFrame, name: str = "line") -> DataFrame:
    """Each row as its cells between bars."""
    return df.select(F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(NULL)) for c in df.columns]).alias(name))


def write_text(df: DataFrame, path: str, mode: str = "error") -> None:
    """The table as a folder of text files; the schema's text form travels as the first line of a file of its own, ``schema``.

    Cells are escaped (backslash, tab and line ends), so any text survives.
    """
    def escaped(c):
        text = F.col(f"`{c}`").cast("string")
        for plain, mark in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
            text = F.replace(text, F.lit(plain), F.lit(mark))
        return F.coalesce(text, F.lit("\\N"))

    spark = df.sparkSession
    df.select(F.concat_ws("\t", *[escaped(c) for c in df.columns]).alias("value")).write.mode(mode).text(f"{path}/rows")
    spark.createDataFrame([(schema_text(df.schema),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/schema")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """A table of :func:`write_text`; a row with another number of cells is an error."""
    schema = parse_schema(spark.read.text(f"{path}/schema").first()["value"])
    cells = F.split("value", "\t", -1)

    def plain(c):
        # backslash pairs are resolved by cutting the text at them, so no character has to stand in for them
        def part(text):
            for mark, char in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r")):
                text = F.replace(text, F.lit(mark), F.lit(char))
            return text

        return F.when(c == "\\N", F.lit(None)).otherwise(F.array_join(F.transform(F.split(c, r"\\\\", -1), part), "\\"))

    rows = spark.read.text(f"{path}/rows").select(cells.alias("cells"))
    checked = F.when(F.size("cells") == len(schema), F.col("cells")).otherwise(F.raise_error(F.lit(f"a row without {len(schema)} cells")))
    return rows.select(checked.alias("cells")).select(*[plain(F.col("cells")[i]).cast(f.dataType).alias(f.name) for i, f in enumerate(schema)])


def file_stats(spark: SparkSession, path: str, cell_bytes: int = 50) -> dict:
    """Rows, columns, names, types, bytes on disk, and these against a fixed number of bytes a cell."""
    df = spark.read.parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    rows = df.count()
    plain = rows * len(df.columns) * cell_bytes
    return {"rows": rows, "columns": len(df.columns), "names": df.columns, "types": [t for _, t in df.dtypes], "bytes": size, "ratio": size / plain if plain else 0.0}


#: Files of a batch that are worked on at once.
PARALLEL = 8


def process_batch(spark: SparkSession, paths: list[str], op: str) -> dict[str, object]:
    """``row_count``, ``column_count`` or ``stats`` of many files, or ``compress`` and ``decompress`` to a folder beside each, whose path is the result; a file that cannot be read gives its error's text and does not stop the others."""
    ops: dict[str, Callable] = {"row_count": lambda p: spark.read.parquet(p).count(), "column_count": lambda p: len(spark.read.parquet(p).columns), "stats": lambda p: file_stats(spark, p), "compress": lambda p: _repacked(spark, p, "zstd"), "decompress": lambda p: _repacked(spark, p, "uncompressed")}
    if op not in ops:
        raise ValueError(f"operation {op!r}; there are {sorted(ops)}")

    def one(p):
        try:
            return ops[op](p)
        except Exception as e:  # noqa: BLE001  reported, not hidden
            return f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}"

    # the jobs of several files run side by side; Spark's scheduler shares the cluster among them
    with ThreadPoolExecutor(PARALLEL) as pool:
        return dict(zip(paths, pool.map(one, paths)))


def _repacked(spark: SparkSession, path: str, codec: str) -> str:
    target = f"{path.rstrip('/')}.{codec}"
    spark.read.parquet(path).write.mode("overwrite").option("compression", codec).parquet(target)
    return target


def in_chunks(df: DataFrame, rows: int = 65_536) -> Iterator[list]:
    """The rows in lists of at most ``rows``, one partition at a time on the driver; a caller that stops early reads no further."""
    held: list = []
    for r in df.toLocalIterator(prefetchPartitions=True):
        held.append(r)
        if len(held) == rows:
            yield held
            held = []
    if held:
        yield held


def digests(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``length``, ``sha256`` of files, read where they lie."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def same_bytes(spark: SparkSession, a: str, b: str) -> bool:
    """Whether two files hold the same bytes."""
    one, two = (digests(spark, p).select("length", "sha256").collect() for p in (a, b))
    return sorted(one) == sorted(two)
