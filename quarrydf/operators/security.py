"""Integrity checksums and column encryption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_checksum(df: DataFrame, name: str = "crc") -> DataFrame:
    """``df`` with the CRC-32 of each row's cells as text, nulls apart from empty cells."""
    cells = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in df.columns]
    return df.withColumn(name, F.crc32(F.concat_ws("\u001f", *cells).cast("binary")))


def chunk_checksums(df: DataFrame, chunk_id: str = "chunk_id") -> DataFrame:
    """For each chunk its rows and an order-independent checksum: sum and exclusive or of the rows' CRC-32."""
    rows = row_checksum(df.drop(chunk_id), "__crc").select("__crc") if chunk_id not in df.columns else row_checksum(df, "__crc").select(chunk_id, "__crc")
    return rows.groupBy(chunk_id).agg(F.count("*").alias("n_rows"), F.sum("__crc").alias("crc_sum"), F.bit_xor("__crc").alias("crc_xor"))


def damaged_chunks(df: DataFrame, recorded: DataFrame, chunk_id: str = "chunk_id") -> DataFrame:
    """The recorded chunks whose rows no longer have the recorded checksum."""
    now = chunk_checksums(df, chunk_id)
    a, b = recorded.alias("a"), now.alias("b")
    differ = F.col("b.crc_sum").isNull() | (F.col("a.n_rows") != F.col("b.n_rows")) | (F.col("a.crc_sum") != F.col("b.crc_sum")) | (F.col("a.crc_xor") != F.col("b.crc_xor"))
    return a.join(b, F.col(f"a.{chunk_id}") == F.col(f"b.{chunk_id}"), "left").filter(differ).select(F.col(f"a.{chunk_id}"))


def null_damaged(df: DataFrame, recorded: DataFrame, chunk_id: str = "chunk_id") -> DataFrame:
    """``df`` with all cells of damaged chunks null: the rows keep their places, no damaged value is passed on."""
    bad = damaged_chunks(df, recorded, chunk_id).select(F.col(chunk_id).alias("__bad"))
    marked = df.join(bad, df[chunk_id] == bad["__bad"], "left")
    return marked.select(*[F.col(f"`{c}`") if c == chunk_id else F.when(F.col("__bad").isNull(), F.col(f"`{c}`")).alias(c) for c in df.columns])


def encrypt(c: Column, key: Column | bytes) -> Column:
    """AES-GCM with a random nonce: ciphertext that also detects tampering. Null stays null. The key is 16, 24 or 32 bytes."""
    k = F.lit(key) if isinstance(key, bytes) else key
    return F.aes_encrypt(c.cast("string").cast("binary"), k, F.lit("GCM"))


def decrypt(c: Column, key: Column | bytes, kind: str = "string") -> Column:
    """The value again; a wrong key or a changed cell is an error."""
    k = F.lit(key) if isinstance(key, bytes) else key
    return F.aes_decrypt(c, k, F.lit("GCM")).cast("string").cast(kind)


def encrypt_columns(df: DataFrame, columns: list[str], key: bytes, key_id: str) -> DataFrame:
    """``df`` with columns encrypted; the schema keeps the key's name and the type, never the key."""
    out = df
    for c in columns:
        field = df.schema[c]
        out = out.withColumn(c, encrypt(F.col(f"`{c}`"), key).alias(c)).withMetadata(c, {"encrypted": True, "key_id": key_id, "type": field.dataType.simpleString()})
    return out


def decrypt_columns(df: DataFrame, keys: dict[str, bytes]) -> DataFrame:
    """``df`` with all encrypted columns whose key is given as they were."""
    out = df
    for field in df.schema:
        meta = field.metadata or {}
        if meta.get("encrypted") and meta["key_id"] in keys:
            out = out.withColumn(field.name, decrypt(F.col(f"`{field.name}`"), keys[meta["key_id"]], meta["type"])).withMetadata(field.name, {})
    return out
