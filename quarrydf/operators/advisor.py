"""Which encoding suits a column: rule sets over one statistics pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrydf.operators.encodings import bits_for, varint_bytes, zigzag

# Fixed values of the rule sets: widest FOR residual in bits, most values of a chunk's dictionary, bytes that a string costs beside its own,
# values below which the column profiler advises a dictionary, most values of a file's dictionary, mean length from which text is compressed.
FOR_BITS = 32
DICTIONARY_VALUES = 65_536
STRING_COST = 5
PROFILE_VALUES = 1000
FILE_DICTIONARY_VALUES = 256
LONG_TEXT = 32


def integer_sizes(df: DataFrame, column: str, chunk_id: str = "chunk_id", row_id: str = "row_id") -> DataFrame:
    """For each chunk: rows, whether steps are constant (never with a null), and the bytes that FOR, delta and RLE would take; nulls make runs, and no bytes."""
    v, w = F.col(f"`{column}`").cast("bigint"), Window.partitionBy(chunk_id).orderBy(row_id)
    base = df.select(chunk_id, row_id, v.alias("v"), F.last(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("p"), ((F.row_number().over(w) == 1) | ~v.eqNullSafe(F.lag(v).over(w))).alias("new"))
    step = F.col("v") - F.col("p")
    new = F.col("new")
    runs = base.select(chunk_id, "v", "p", step.alias("step"), new.alias("new"), F.sum(new.cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    per_run = runs.groupBy(chunk_id, "run").agg(
        F.count("*").alias("len"),
        F.first("v").alias("v"),
        F.min("step").alias("s0"),
        F.max("step").alias("s1"),
        F.sum(varint_bytes(zigzag(F.coalesce("step", "v")))).alias("delta_bytes"),
    )
    per = per_run.groupBy(chunk_id).agg(
        F.sum("len").alias("n"),
        F.min("v").alias("low"),
        F.max("v").alias("high"),
        ((F.count("v") == F.count("*")) & (F.coalesce(F.min("s0"), F.lit(0)) == F.coalesce(F.max("s1"), F.lit(0)))).alias("constant"),
        F.sum("delta_bytes").cast("bigint").alias("delta_bytes"),
        F.sum(varint_bytes(F.col("len")) + varint_bytes(zigzag(F.col("v")))).cast("bigint").alias("rle_bytes"),
    )
    width = F.when(F.col("high") == F.col("low"), F.lit(0)).otherwise(F.length(F.bin(F.col("high") - F.col("low"))))
    size = varint_bytes(zigzag(F.col("low"))) + 1 + F.ceil(width * F.col("n") / 8)
    return per.select(chunk_id, "n", "constant", width.cast("bigint").alias("for_bits"), size.cast("bigint").alias("for_bytes"), "delta_bytes", "rle_bytes")


def integer_codec(sizes: DataFrame) -> DataFrame:
    """``codec``: CDELTA for constant steps, else the smallest of FOR (32 bits or fewer), DELTA and RLE; ties in that order."""
    big = F.lit(1 << 62)
    for_size = F.when(F.col("for_bits") <= FOR_BITS, F.col("for_bytes")).otherwise(big)
    least = F.least(for_size, "delta_bytes", "rle_bytes")
    return sizes.withColumn("codec", F.when(F.col("n") == 0, "RAW").when(F.col("constant"), "CDELTA").when(for_size == least, "FOR").when(F.col("delta_bytes") == least, "DELTA").otherwise("RLE"))


def string_codec(df: DataFrame, column: str, chunk_id: str = "chunk_id", row_id: str = "row_id") -> DataFrame:
    """For each chunk: distinct values, runs, and ``codec``: RAW beyond 65,536 values, RLE for one value or if runs are smaller, else BDICT."""
    v, w = F.col(f"`{column}`"), Window.partitionBy(chunk_id).orderBy(row_id)
    new = ((F.row_number().over(w) == 1) | ~v.eqNullSafe(F.lag(v).over(w))).cast("bigint")
    rows = df.select(chunk_id, v.alias("v"), new.alias("new"))
    by_value = rows.groupBy(chunk_id, "v").agg(F.count("*").alias("n"), F.sum("new").alias("runs"))
    size = F.octet_length("v")
    per = by_value.groupBy(chunk_id).agg(F.sum("n").alias("n"), F.count("v").alias("distinct"), F.sum("runs").alias("runs"), F.sum(size + STRING_COST).alias("table_bytes"), F.sum(size * F.col("n")).alias("bytes"))
    run_bytes = F.col("runs") * (F.col("bytes") / F.col("n") + STRING_COST)
    dict_bytes = F.col("table_bytes") + F.ceil(bits_for(F.col("distinct")) * F.col("n") / 8)
    codec = F.when(F.col("n") == 0, "RAW").when(F.col("distinct") > DICTIONARY_VALUES, "RAW").when(F.col("distinct") <= 1, "RLE").when(run_bytes <= dict_bytes, "RLE").otherwise("BDICT")
    return per.select(chunk_id, "n", "distinct", "runs", codec.alias("codec"))


def profile_codec(kind: Column, distinct: Column, rows: Column) -> Column:
    """The advice of the column profiler, from its statistics alone."""
    return F.when(distinct < PROFILE_VALUES, "Dictionary").when(kind.isin("int", "float"), "FOR").when((kind == "str") & (distinct < rows / 2), "Dictionary").otherwise("LZSS")


def simple_codec(distinct: Column) -> Column:
    """A dictionary for fewer than 1000 values, else nothing."""
    return F.when(distinct < PROFILE_VALUES, "dict").otherwise("none")


def type_codec(kind: Column) -> Column:
    """The advice by type alone, for the text form."""
    return F.when(kind == "int", "delta").when(kind == "float", "plain").when(kind == "bool", "rle").otherwise("dict")


def value_codec(kind: Column, distinct: Column, mean_length: Column) -> Column:
    """The advice by type, distinct values and mean length, for single-file tables."""
    text = F.when(distinct <= FILE_DICTIONARY_VALUES, "DictRLE").when(mean_length > LONG_TEXT, "LZ77").otherwise("None")
    return F.when(kind.isin("int", "float"), "Delta").when(kind == "bool", "RLE").when(kind == "embedding", "None").when(kind == "str", text).otherwise("LZ77")


def float_codec(df: DataFrame, column: str, chunk_id: str = "chunk_id") -> DataFrame:
    """For each chunk of a float column ``codec``: RLE for one value, FOR if all values are whole numbers of at most ``FOR_BITS`` bits of spread, else
    FLOATDELTA, which keeps every bit."""
    v = F.col(f"`{column}`").cast("double")
    whole = F.coalesce(F.bool_and((v == F.floor(v)) & (F.abs(v) < float(1 << 53))), F.lit(True))
    per = df.groupBy(chunk_id).agg(F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), whole.alias("whole"))
    codec = F.when(F.col("n") == 0, "RAW").when(F.col("low").eqNullSafe(F.col("high")), "RLE").when(F.col("whole") & (F.col("high") - F.col("low") < float(1 << FOR_BITS)), "FOR").otherwise("FLOATDELTA")
    return per.select(chunk_id, "n", codec.alias("codec"))


def codec_by_type(kind: str) -> str | None:
    """The codec that a type alone decides: truth values are always packed into bits; None where the values have to be looked at."""
    return "BITPACK" if kind == "boolean" else None
