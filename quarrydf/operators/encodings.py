"""Column encodings as relations, each with its inverse.

A column is read in the order of ``row_id``; windows stay inside a chunk, so chunks are encoded independently and in
parallel. Nulls are values like any other: they are kept by every encoding.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrydf.operators.tables import with_row_id

#: Fixed value: distinct values up to which a column gets a Huffman code.
HUFFMAN_VALUES = 256


def _order(chunk_id: str, row_id: str):
    return Window.partitionBy(chunk_id).orderBy(row_id)


def zigzag(c: Column) -> Column:
    """Small magnitudes of either sign as small unsigned numbers."""
    wide = c.cast("bigint")
    return F.shiftleft(wide, 1).bitwiseXOR(F.shiftright(wide, 63))


def unzigzag(c: Column) -> Column:
    return F.shiftrightunsigned(c, 1).bitwiseXOR(-(c.bitwiseAND(F.lit(1).cast("bigint"))))


def varint_bytes(c: Column) -> Column:
    """Bytes of a number written seven bits at a time (read as unsigned)."""
    bits = F.length(F.bin(c))
    return F.greatest(F.lit(1), F.ceil(bits / 7)).cast("int")


def bits_for(n: Column) -> Column:
    """Bits that tell ``n`` values apart, 1 at least."""
    return F.when(n <= 1, F.lit(1)).otherwise(F.length(F.bin(n - 1))).cast("int")


def delta_encode(df: DataFrame, column: str, chunk_id: str = "chunk_id", row_id: str = "row_id") -> DataFrame:
    """``delta``: the first value of a chunk, then differences to the last value before; null where the value is. Differences beyond 64 bits are an error."""
    v, w = F.col(f"`{column}`").cast("bigint"), _order(chunk_id, row_id)
    before = F.last(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.select(chunk_id, row_id, (v - F.coalesce(before, F.lit(0).cast("bigint"))).alias("delta"))


def delta_decode(encoded: DataFrame, name: str = "value", chunk_id: str = "chunk_id", row_id: str = "row_id") -> DataFrame:
    """The values: running sums of the differences; null where the difference is."""
    total = F.sum("delta").over(_order(chunk_id, row_id).rowsBetween(Window.unboundedPreceding, 0))
    return encoded.select(chunk_id, row_id, F.when(F.col("delta").isNotNull(), total.cast("bigint")).alias(name))


def float_bits(c: Column) -> Column:
    """The 64 bits of a double as a whole number (Spark has no such function, so Arrow batches are reinterpreted)."""
    return F.arrow_udf(_to_bits, "long")(c.cast("double"))


def bits_float(c: Column) -> Column:
    return F.arrow_udf(_from_bits, "double")(c.cast("bigint"))


def _to_bits(values: pa.Array) -> pa.Array:
    return pa.Array.from_buffers(pa.int64(), len(values), values.buffers(), offset=values.offset)


def _from_bits(values: pa.Array) -> pa.Array:
    return pa.Array.from_buffers(pa.float64(), len(values), values.buffers(), offset=values.offset)


def _wrapped(c: Column) -> Column:
    """A decimal as the 64-bit number that is equal to it modulo 2^64."""
    low = F.pmod(c, F.lit(Decimal(1 << 64)))
    return F.when(low >= F.lit(Decimal(1 << 63)), low - F.lit(Decimal(1 << 64))).otherwise(low).cast("bigint")


def float_delta_encode(df: DataFrame, column: str, chunk_id: str = "chunk_id", row_id: str = "row_id") -> DataFrame:
    """``delta`` of the bit patterns of a float column, modulo 2^64: every double survives, signed zeros and infinities too; null where the value is."""
    bits = df.select(chunk_id, row_id, float_bits(F.col(f"`{column}`")).alias("bits"))
    before = F.last("bits", ignorenulls=True).over(_order(chunk_id, row_id).rowsBetween(Window.unboundedPreceding, -1))
    exact = F.col("bits").cast("decimal(20,0)") - F.coalesce(before, F.lit(0).cast("bigint")).cast("decimal(20,0)")
    return bits.select(chunk_id, row_id, _wrapped(exact).alias("delta"))


def float_delta_decode(encoded: DataFrame, name: str = "value", chunk_id: str = "chunk_id", row_id: str = "row_id") -> DataFrame:
    total = F.sum(F.col("delta").cast("decimal(20,0)")).over(_order(chunk_id, row_id).rowsBetween(Window.unboundedPreceding, 0))
    bits = encoded.select(chunk_id, row_id, F.when(F.col("delta").isNotNull(), _wrapped(total)).alias("bits"))
    return bits.select(chunk_id, row_id, bits_float(F.col("bits")).alias(name))


def rle_encode(df: DataFrame, column: str, chunk_id: str = "chunk_id", row_id: str = "row_id") -> DataFrame:
    """Runs of equal neighbours: ``run_id`` (from 1), ``value``, ``start`` (a row id) and ``length``."""
    v, w = F.col(f"`{column}`"), _order(chunk_id, row_id)
    first = F.row_number().over(w) == 1
    new = (first | ~v.eqNullSafe(F.lag(v).over(w))).cast("bigint")
    marked = df.select(chunk_id, row_id, v.alias("value"), new.alias("new"))
    runs = marked.withColumn("run_id", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(chunk_id, "run_id").agg(F.first("value").alias("value"), F.min(row_id).alias("start"), F.count("*").alias("length"))


def rle_decode(runs: DataFrame, name: str = "value", chunk_id: str = "chunk_id", row_id: str = "row_id") -> DataFrame:
    """One row for each row of each run."""
    rows = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1))
    return runs.select(chunk_id, rows.alias(row_id), F.col("value").alias(name))


def _run_text(runs: DataFrame, item: Column, between: str, chunk_id: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("run_id", item.alias("item"))))
    return runs.groupBy(chunk_id).agg(F.array_join(F.transform(ordered, lambda x: x["item"]), between).alias("runs"))


def rle_text(runs: DataFrame, mark: str = "~", between: str = ",", chunk_id: str = "chunk_id") -> DataFrame:
    """The runs of each chunk as one text: length, mark, value."""
    return _run_text(runs, F.concat(F.col("length").cast("string"), F.lit(mark), F.coalesce(F.col("value").cast("string"), F.lit("NULL"))), between, chunk_id)


def rle_pairs(runs: DataFrame, between: str = "|", chunk_id: str = "chunk_id") -> DataFrame:
    """The runs of each chunk as one text: value and length in turn, all between bars."""
    return _run_text(runs, F.concat(F.coalesce(F.col("value").cast("string"), F.lit("NULL")), F.lit(between), F.col("length").cast("string")), between, chunk_id)


def varint_hex(c: Column) -> Column:
    """A number of up to 63 bits as hex of its varint: seven bits a byte, low ones first, the high bit set on all but the last byte."""
    wide = c.cast("bigint")
    bytes_ = F.transform(F.sequence(F.lit(0), varint_bytes(wide) - 1), lambda k: (F.floor(wide / F.pow(F.lit(128), k)) % 128 + F.when(k < varint_bytes(wide) - 1, 128).otherwise(0)).cast("bigint"))
    return F.array_join(F.transform(bytes_, lambda x: F.lpad(F.hex(x), 2, "0")), "")


def rle_bytes(runs: DataFrame, chunk_id: str = "chunk_id") -> DataFrame:
    """The runs of each chunk as bytes: for each run the length of the value, the value, and the length of the run, lengths as varints. A null value
    is written as its marker ``NULL``."""
    value = F.coalesce(F.col("value").cast("string"), F.lit("NULL"))
    item = F.concat(varint_hex(F.octet_length(value)), F.hex(value.cast("binary")), varint_hex(F.col("length")))
    return _run_text(runs, item, "", chunk_id).select(chunk_id, F.unhex("runs").alias("runs"))


def dict_rle_encode(df: DataFrame, column: str, codes: DataFrame, chunk_id: str = "chunk_id", row_id: str = "row_id") -> DataFrame:
    """Runs of dictionary codes: the column by its dictionary, then run lengths inside each chunk."""
    rows = df.select(chunk_id, row_id, F.col(f"`{column}`").alias("__v"))
    coded = rows.join(codes.select("value", "code"), rows["__v"].eqNullSafe(codes["value"])).select(chunk_id, row_id, "code")
    return rle_encode(coded, "code", chunk_id, row_id)


def dict_rle_decode(runs: DataFrame, codes: DataFrame, name: str = "value", chunk_id: str = "chunk_id", row_id: str = "row_id") -> DataFrame:
    """One row for each row of each run; the dictionary is met by runs, not by rows."""
    met = runs.withColumnRenamed("value", "code").join(codes.select("value", "code"), "code")
    return rle_decode(met, name, chunk_id, row_id)


def dictionary(df: DataFrame, column: str, row_id: str = "row_id") -> DataFrame:
    """``value``, ``code`` (from 0) in order of first appearance. One row a distinct value, numbered range by range."""
    seen = df.groupBy(F.col(f"`{column}`").alias("value")).agg(F.min(row_id).alias("first_row"))
    return with_row_id(seen, "first_row", "code").select("value", "code")


def frequency_dictionary(df: DataFrame, column: str) -> DataFrame:
    """``value``, ``n``, ``code`` (from 0) by count, largest first, then by value, and the ``bits`` of a code.

    Values are numbered inside each count; only the distinct counts, of which n rows have fewer than sqrt(2 n), are added up in one window.
    """
    seen = df.groupBy(F.col(f"`{column}`").alias("value")).agg(F.count("*").alias("n"))
    counts = seen.groupBy("n").agg(F.count("*").alias("k"))
    before = counts.select("n", (F.sum("k").over(Window.orderBy(F.desc("n"))) - F.col("k")).alias("ahead"), F.sum("k").over(Window.partitionBy()).alias("total"))
    inside = F.row_number().over(Window.partitionBy("n").orderBy(F.asc_nulls_last("value"))) - 1
    return seen.withColumn("inside", inside).join(before, "n").select("value", "n", (F.col("ahead") + F.col("inside")).cast("bigint").alias("code"), bits_for(F.col("total")).cast("bigint").alias("bits"))


def dictionary_encode(df: DataFrame, column: str, codes: DataFrame, row_id: str = "row_id") -> DataFrame:
    """``row_id``, ``code``: the column by its dictionary (nulls have a code of their own)."""
    rows = df.select(row_id, F.col(f"`{column}`").alias("__v"))
    return rows.join(codes.select("value", "code"), rows["__v"].eqNullSafe(codes["value"])).select(row_id, "code")


def dictionary_decode(encoded: DataFrame, codes: DataFrame, name: str = "value", row_id: str = "row_id") -> DataFrame:
    return encoded.join(codes.select(F.col("value").alias(name), "code"), "code").select(row_id, name)


def for_encode(df: DataFrame, column: str, chunk_id: str = "chunk_id", row_id: str = "row_id") -> DataFrame:
    """Frame of reference: ``base`` (the chunk's least value), ``residual``, and the ``bits`` of the chunk's widest residual (0 if constant)."""
    v, w = F.col(f"`{column}`").cast("bigint"), Window.partitionBy(chunk_id)
    low, high = F.min(v).over(w), F.max(v).over(w)
    bits = F.when(high == low, F.lit(0)).otherwise(F.length(F.bin(high - low)))
    return df.select(chunk_id, row_id, low.alias("base"), (v - low).alias("residual"), bits.cast("bigint").alias("bits"))


def for_decode(encoded: DataFrame, name: str = "value", chunk_id: str = "chunk_id", row_id: str = "row_id") -> DataFrame:
    return encoded.select(chunk_id, row_id, (F.col("base") + F.col("residual")).alias(name))


def constant_step(df: DataFrame, column: str, chunk_id: str = "chunk_id", row_id: str = "row_id") -> DataFrame:
    """For each chunk ``base``, ``step``, ``n`` and ``constant``: whether all steps are equal (two values or fewer always are) and no value is null."""
    v, w = F.col(f"`{column}`").cast("bigint"), _order(chunk_id, row_id)
    stepped = df.select(chunk_id, row_id, v.alias("v"), (v - F.lag(v).over(w)).alias("step"))
    return stepped.groupBy(chunk_id).agg(
        F.min_by("v", row_id).alias("base"),
        F.coalesce(F.min("step"), F.lit(0).cast("bigint")).alias("step"),
        F.count("*").alias("n"),
        ((F.count("v") == F.count("*")) & (F.coalesce(F.min("step"), F.lit(0).cast("bigint")) == F.coalesce(F.max("step"), F.lit(0).cast("bigint")))).alias("constant"),
    )


def constant_step_decode(chunks: DataFrame, name: str = "value", chunk_id: str = "chunk_id") -> DataFrame:
    """``at`` (from 0 in the chunk) and the value of each row of the chunks that have a constant step."""
    at = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("at")
    return chunks.filter("constant").select(chunk_id, "base", "step", at).select(chunk_id, "at", (F.col("base") + F.col("step") * F.col("at")).alias(name))


def pack_bools(df: DataFrame, column: str, row_id: str = "row_id") -> DataFrame:
    """``byte_id``, ``byte`` and ``known``: eight truth values a byte, the first in the lowest bit, and in the same places which of them are not null."""
    v = F.col(f"`{column}`")
    place = F.expr(f"shiftleft(1L, int({row_id} % 8))")
    bits = lambda test: F.sum(F.when(test, place).otherwise(F.lit(0).cast("bigint"))).cast("bigint")
    return df.groupBy(F.expr(f"{row_id} div 8").alias("byte_id")).agg(bits(v).alias("byte"), bits(v.isNotNull()).alias("known"))


def unpack_bools(packed: DataFrame, rows: int, name: str = "value", row_id: str = "row_id") -> DataFrame:
    out = packed.select("byte_id", "byte", "known", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    at = (F.col("byte_id") * 8 + F.col("k")).cast("bigint")
    bit = lambda c: F.expr(f"shiftright({c}, k)").bitwiseAND(F.lit(1).cast("bigint")) == 1
    return out.select(at.alias(row_id), F.when(bit("known"), bit("byte")).alias(name)).filter(F.col(row_id) < rows)


def fixed_point(c: Column, digits: int = 4) -> Column:
    """A float as a whole number of 10^-digits, halves away from zero. This loses what lies below that unit."""
    return F.round(c * 10**digits, 0).cast("bigint")


def from_fixed_point(c: Column, digits: int = 4) -> Column:
    return c / 10**digits


def huffman_bits(df: DataFrame, column: str) -> DataFrame:
    """``distinct`` and ``bits``: the entropy of the column's values, the least mean length of a prefix code. Beyond ``HUFFMAN_VALUES``
    distinct values no code is built: ``bits`` is then that of a plain dictionary code."""
    counts = df.groupBy(F.col(f"`{column}`").alias("value")).agg(F.count("*").alias("n"))
    total = F.sum("n")
    return counts.agg(F.count("*").alias("distinct"), F.when(F.count("*") > HUFFMAN_VALUES, bits_for(F.count("*")).cast("double")).otherwise(F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total).alias("bits"))


@dataclass(frozen=True)
class Encoded:
    """A column by one codec: its rows, and its dictionary where the codec has one."""

    codec: str
    rows: DataFrame
    codes: DataFrame | None = None
    n: int = 0


#: The codecs of :func:`encode`, as the advisors name them.
CODECS = ("RAW", "RLE", "DELTA", "FLOATDELTA", "FOR", "CDELTA", "BDICT", "DICTRLE", "BITPACK")


def encode(df: DataFrame, column: str, codec: str) -> Encoded:
    """One column of a table with ``chunk_id`` and ``row_id`` by a codec. Nulls survive every codec. ``CDELTA`` is for columns whose
    steps are constant in every chunk; where they are not, decoding lacks the rows, so that is an error here."""
    name = codec.upper()
    if name == "RAW":
        return Encoded(name, df.select("chunk_id", "row_id", F.col(f"`{column}`").alias("value")))
    if name == "RLE":
        return Encoded(name, rle_encode(df, column))
    if name == "DELTA":
        return Encoded(name, delta_encode(df, column))
    if name == "FLOATDELTA":
        return Encoded(name, float_delta_encode(df, column))
    if name == "FOR":
        return Encoded(name, for_encode(df, column))
    if name == "CDELTA":
        steps = constant_step(df, column)
        broken = steps.filter(~F.col("constant")).limit(1).collect()
        if broken:
            raise ValueError(f"chunk {broken[0]['chunk_id']} of {column} has no constant step")
        return Encoded(name, steps.join(df.groupBy("chunk_id").agg(F.min("row_id").alias("first_row")), "chunk_id"))
    if name == "BDICT":
        codes = frequency_dictionary(df, column)
        return Encoded(name, dictionary_encode(df, column, codes), codes)
    if name == "DICTRLE":
        codes = dictionary(df, column)
        return Encoded(name, dict_rle_encode(df, column, codes), codes)
    if name == "BITPACK":
        return Encoded(name, pack_bools(df, column), n=df.count())
    raise ValueError(f"codec {codec!r}; there are {CODECS}")


def decode(encoded: Encoded, name: str = "value") -> DataFrame:
    """``row_id`` and the values again."""
    rows, codec = encoded.rows, encoded.codec
    if codec == "CDELTA":
        at = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("at")
        out = rows.select("base", "step", "first_row", at)
        return out.select((F.col("first_row") + F.col("at")).alias("row_id"), (F.col("base") + F.col("step") * F.col("at")).alias(name))
    done = {
        "RAW": lambda: rows.withColumnRenamed("value", name),
        "RLE": lambda: rle_decode(rows, name),
        "DELTA": lambda: delta_decode(rows, name),
        "FLOATDELTA": lambda: float_delta_decode(rows, name),
        "FOR": lambda: for_decode(rows, name),
        "BDICT": lambda: dictionary_decode(rows, encoded.codes, name),
        "DICTRLE": lambda: dict_rle_decode(rows, encoded.codes, name),
        "BITPACK": lambda: unpack_bools(rows, encoded.n, name),
    }[codec]()
    return done.select("row_id", name)
