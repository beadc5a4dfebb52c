"""Secondary indexes: posting lists and bloom membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits and hash functions of a chunk's bloom filter.
BLOOM_BITS, BLOOM_HASHES = 4096, 3


def postings(df: DataFrame, column: str, row_id: str = "row_id", block_rows: int = 1 << 20) -> DataFrame:
    """``value``, ``block`` and ``rows`` (ascending row ids): a value's rows are cut into blocks of the table, so that the list of a very
    common value is never one cell (:func:`whole_lists` puts them together)."""
    return df.groupBy(F.col(f"`{column}`").alias("value"), F.expr(f"{row_id} div {block_rows}").alias("block")).agg(F.array_sort(F.collect_list(row_id)).alias("rows"))


def whole_lists(index: DataFrame) -> DataFrame:
    """``value`` and ``rows``: one ascending list a value, its blocks put together. A list is one cell, of which Spark holds 2 GB (about 268
    million rows); a longer one is an error."""
    blocks = F.array_sort(F.collect_list(F.struct("block", "rows")))
    return index.groupBy("value").agg(blocks.alias("blocks")).select("value", F.flatten(F.col("blocks.rows")).alias("rows"))


def lookup(index: DataFrame, value) -> DataFrame:
    """The row ids of a value."""
    return index.filter(F.col("value").eqNullSafe(F.lit(value))).select(F.explode("rows").alias("row_id"))


def index_size(index: DataFrame) -> DataFrame:
    """``bytes``: the keys' bytes, once each, and eight bytes a row."""
    per = index.groupBy("value").agg(F.sum(F.size("rows")).alias("n"))
    return per.agg((F.sum(F.coalesce(F.octet_length(F.col("value").cast("string")), F.lit(0))) + 8 * F.sum("n")).cast("bigint").alias("bytes"))


def bloom_positions(c: Column, bits: int = BLOOM_BITS, hashes: int = BLOOM_HASHES) -> Column:
    """The bits of a value: double hashing with two 64-bit hashes of its text, so that a literal meets a column of another width."""
    text = c.cast("string")
    a, b = F.xxhash64(text), F.xxhash64(F.lit("bloom"), text)
    return F.array(*[F.pmod(F.pmod(a, F.lit(bits)) + k * F.pmod(b, F.lit(bits - 1)) + k, F.lit(bits)).cast("int") for k in range(hashes)])


def build_bloom(df: DataFrame, column: str, chunk_id: str = "chunk_id", bits: int = BLOOM_BITS, hashes: int = BLOOM_HASHES) -> DataFrame:
    """``bits_set`` for each chunk: the set bits, at most ``bits`` of them whatever the chunk holds."""
    spread = df.filter(F.col(f"`{column}`").isNotNull()).select(chunk_id, F.explode(bloom_positions(F.col(f"`{column}`"), bits, hashes)).alias("bit"))
    return spread.groupBy(chunk_id).agg(F.array_sort(F.collect_set("bit")).alias("bits_set"))


def may_contain(bloom: DataFrame, value, chunk_id: str = "chunk_id", bits: int = BLOOM_BITS, hashes: int = BLOOM_HASHES) -> DataFrame:
    """The chunks that may hold the value: never one too few. The value is compared by its text."""
    wanted = bloom_positions(F.lit(value), bits, hashes)
    return bloom.filter(F.size(F.array_except(wanted, F.col("bits_set"))) == 0).select(chunk_id)
