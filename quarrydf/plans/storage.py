"""Registered queries of sources, sinks and versions: each writes a table to the shared folder and reads it back."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from quarrydf.operators import advisor, encodings, lifecycle, security, stats, tables
from quarrydf.plans.query import Query, Select, build, to_csv, to_table
from quarrydf.sources import format as table_format
from quarrydf.sources import interchange, store

_numbers = itertools.count()


def folder(spark, name: str) -> str:
    """A new folder that the driver and all executors share: below ``spark.checkpoint.dir``, or else the warehouse."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/quarrydf-{spark.sparkContext.applicationId}/{name}-{next(_numbers)}"


def register(query, load, numbered, orders, events):
    """Register all of them with the catalog's decorator, its loaders and its SQL of numbered tables."""

    def roundtrip(name, sql, write, read):
        def run(spark, sf_dir):
            path = folder(spark, name)
            write(spark, sf_dir, path)
            return read(spark, path)

        query(sql, name)(run)

    customers = lambda spark, sf_dir: load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    plain = "SELECT c_custkey, c_name, c_acctbal FROM customer"
    # texts with every character that a text form could trip over
    odd = lambda spark, sf_dir: load(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 5 == 0, F.lit(None).cast("string")).when(F.col("n_nationkey") % 5 == 1, "NULL").when(F.col("n_nationkey") % 5 == 2, F.concat("n_name", F.lit('\n"x"\t\\N, \\'))).otherwise(F.concat(F.lit("  "), "n_name")).alias("note"))
    odd_sql = "SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'NULL' WHEN 2 THEN n_name || chr(10) || '\"x\"' || chr(9) || '\\N, \\' ELSE '  ' || n_name END AS note FROM nation"
    schema = "c_custkey:int,c_name:str,c_acctbal:float"

    roundtrip("table_roundtrip", plain, lambda s, d, p: store.write(customers(s, d), p, codec="gzip", chunk_bytes=1 << 20, sort_by=["c_custkey"], rows_per_file=500), lambda s, p: store.read(s, p))
    roundtrip("format_roundtrip", plain, lambda s, d, p: store.write(customers(s, d), p), lambda s, p: (table_format.register(s), s.read.format("quarrydf").load(p))[1])
    roundtrip("csv_roundtrip", odd_sql, lambda s, d, p: interchange.write_csv(odd(s, d), p), lambda s, p: interchange.read_csv(s, p, "n_nationkey:int,note:str"))
    roundtrip("text_roundtrip", odd_sql, lambda s, d, p: interchange.write_text(odd(s, d), p), interchange.read_text)
    roundtrip("csv_to_table", plain, lambda s, d, p: (interchange.write_csv(customers(s, d), f"{p}/csv"), interchange.csv_to_parquet(s, f"{p}/csv", f"{p}/table", schema)), lambda s, p: store.read(s, f"{p}/table"))
    roundtrip("partitioned_read", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'", lambda s, d, p: store.write(load(s, d, "customer").select("c_custkey", "c_mktsegment"), p, partition_by=["c_mktsegment"]), lambda s, p: store.read(s, p).filter("c_mktsegment = 'BUILDING'"))
    roundtrip("write_append", "SELECT * FROM (SELECT n_nationkey FROM nation) UNION ALL SELECT r_regionkey FROM region", lambda s, d, p: (store.write(load(s, d, "nation").select("n_nationkey"), p), store.write(load(s, d, "region").select(F.col("r_regionkey").cast(load(s, d, "nation").schema["n_nationkey"].dataType).alias("n_nationkey")), p, mode="append")), lambda s, p: store.read(s, p))
    roundtrip("write_overwrite", "SELECT r_name AS name FROM region", lambda s, d, p: (store.write(load(s, d, "nation").select(F.col("n_name").alias("name")), p), store.write(load(s, d, "region").select(F.col("r_name").alias("name")), p, mode="overwrite")), lambda s, p: store.read(s, p))
    roundtrip("write_ignore", "SELECT n_name AS name FROM nation", lambda s, d, p: (store.write(load(s, d, "nation").select(F.col("n_name").alias("name")), p), store.write(load(s, d, "region").select(F.col("r_name").alias("name")), p, mode="ignore")), lambda s, p: store.read(s, p))

    @query("SELECT count(*) AS n_rows, CAST(3 AS BIGINT) AS n_columns, true AS compressed, 'c_custkey,c_name,c_acctbal' AS names FROM customer")
    def file_stats(spark, sf_dir):
        path = folder(spark, "file_stats")
        store.write(customers(spark, sf_dir), path)
        s = interchange.file_stats(spark, path)
        return spark.createDataFrame([(s["rows"], s["columns"], 0 < s["ratio"] < 1, ",".join(s["names"]))], "n_rows long, n_columns long, compressed boolean, names string")

    @query("SELECT 'customer' AS name, CAST(count(*) AS VARCHAR) AS found FROM customer UNION ALL SELECT 'orders', CAST(count(*) AS VARCHAR) FROM orders UNION ALL SELECT 'missing', 'error'")
    def batch_row_count(spark, sf_dir):
        """Many files at once; one that is missing does not stop the others."""
        names = ["customer", "orders", "missing"]
        done = interchange.process_batch(spark, [f"{sf_dir}/{n}.parquet" for n in names], "row_count")
        return spark.createDataFrame([(n, str(done[f"{sf_dir}/{n}.parquet"]).partition(":")[0]) for n in names], "name string, found string")

    @query("SELECT 'customer' AS name, n, true AS same FROM (SELECT count(*) AS n FROM customer)")
    def batch_compress(spark, sf_dir):
        path = folder(spark, "batch_compress")
        store.write(customers(spark, sf_dir), path)
        packed = interchange.process_batch(spark, [path], "compress")[path]
        back = interchange.process_batch(spark, [packed], "decompress")[packed]
        before, after = store.read(spark, path), store.read(spark, back)
        return after.agg(F.count("*").alias("n")).select(F.lit("customer").alias("name"), "n", F.lit(before.exceptAll(after).isEmpty()).alias("same"))

    @query("SELECT 5 AS chunks, 20 AS n")
    def chunked_read(spark, sf_dir):
        """The first chunks of four rows of a table; nothing is read beyond the fifth."""
        sizes = [len(c) for c in itertools.islice(interchange.in_chunks(load(spark, sf_dir, "customer"), 4), 5)]
        return spark.createDataFrame([(len(sizes), sum(sizes))], "chunks int, n int")

    @query("SELECT true AS same, false AS other")
    def byte_compare(spark, sf_dir):
        one, two = f"{sf_dir}/nation.parquet", f"{sf_dir}/region.parquet"
        return spark.createDataFrame([(interchange.same_bytes(spark, one, one), interchange.same_bytes(spark, one, two))], "same boolean, other boolean")

    @query("SELECT 'r_name' AS header, count(*) AS n, true AS cut FROM region")
    def result_text(spark, sf_dir):
        """A result as CSV and as a table that is cut off for display."""
        out = build(load(spark, sf_dir, "region"), Query([Select("r_name")], order_by="r_name"))
        lines = to_csv(out).splitlines()
        return spark.createDataFrame([(lines[0], len(lines) - 1, "more rows" in to_table(out, rows=2))], "header string, n long, cut boolean")

    # --- versions ----------------------------------------------------------------------------------------------------

    def versioned(spark, sf_dir, name):
        """A table with three versions: orders of the first, of the first two, and of all parts of the table."""
        t = lifecycle.VersionedTable(spark, folder(spark, name))
        all_orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
        for k, stamp in enumerate(["2024-01-01T00:00:00", "2024-06-01T12:00:00+02:00", "2025-01-01T00:00:00Z"], 1):
            t.begin(all_orders.filter(F.col("o_orderkey") % 3 < k)).commit(f"part {k}", timestamp=stamp)
        return t

    @query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 < 2")
    def time_travel_asof(spark, sf_dir):
        """The table as of a moment between the second commit and the third, written in another form than the log has."""
        return versioned(spark, sf_dir, "asof").as_of("2024-06-01 10:00:05")

    @query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 < 1")
    def version_checkout(spark, sf_dir):
        return versioned(spark, sf_dir, "checkout").checkout(1)

    @query("SELECT k AS version, 'part ' || k AS message, (SELECT count(*) FROM orders WHERE o_orderkey % 3 < k) AS n FROM (VALUES (1), (2), (3)) AS t(k)")
    def version_log(spark, sf_dir):
        """The log after three commits and an abort."""
        t = versioned(spark, sf_dir, "log")
        t.begin(load(spark, sf_dir, "region")).abort()
        return spark.createDataFrame([(v.version, v.message, v.rows) for v in t.versions()], "version int, message string, n long")

    @query("SELECT o_orderkey FROM orders WHERE o_orderkey % 11 <> 0")
    def tombstone_sidecar(spark, sf_dir):
        """Deletions saved beside a table and loaded again."""
        path, orders_ = folder(spark, "tombstones"), load(spark, sf_dir, "orders").select("o_orderkey")
        lifecycle.Tombstones.none(spark, "o_orderkey").delete(orders_.filter("o_orderkey % 11 = 0")).save(path)
        return lifecycle.Tombstones.load(spark, path, "o_orderkey").active(orders_)

    # --- integrity ---------------------------------------------------------------------------------------------------

    @query(f"SELECT chunk_id, row_id, CASE WHEN chunk_id = 0 THEN NULL ELSE o_custkey END AS o_custkey FROM {orders}")
    def damaged_chunk(spark, sf_dir):
        """The first chunk has lost a value since its checksum was taken: its cells come back as nulls."""
        df = numbered(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select("chunk_id", "row_id", "o_custkey")
        recorded = security.chunk_checksums(df)
        changed = df.withColumn("o_custkey", F.when(F.col("row_id") == 3, -1).otherwise(F.col("o_custkey")))
        out = security.null_damaged(changed, recorded)
        place = changed.select("row_id", F.col("o_custkey").alias("now"))
        lost = changed.join(out.filter("row_id IS NULL").select("chunk_id").distinct(), "chunk_id").select("chunk_id", "row_id", F.lit(None).cast("bigint").alias("o_custkey"))
        return out.filter("row_id IS NOT NULL").join(place, "row_id").select("chunk_id", "row_id", "o_custkey").unionByName(lost)

    # --- encodings with nulls ----------------------------------------------------------------------------------------

    gaps = lambda spark, sf_dir: numbered(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority").withColumn("v", F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")))
    gap = "CASE WHEN o_custkey % 5 <> 0 THEN o_custkey END"

    def codec_query(name, codec, make, sql):
        query(sql, name)(lambda spark, sf_dir: encodings.decode(encodings.encode(make(gaps(spark, sf_dir)), "v", codec)).select("row_id", "value"))

    codec_query("delta_nulls", "DELTA", lambda df: df, f"SELECT row_id, {gap} AS value FROM {orders}")
    codec_query("for_nulls", "FOR", lambda df: df, f"SELECT row_id, {gap} AS value FROM {orders}")
    codec_query("rle_int_roundtrip", "RLE", lambda df: df, f"SELECT row_id, {gap} AS value FROM {orders}")
    codec_query("bdict_roundtrip", "BDICT", lambda df: df, f"SELECT row_id, {gap} AS value FROM {orders}")
    codec_query("dict_rle_roundtrip", "DICTRLE", lambda df: df.withColumn("v", F.when(F.col("o_custkey") % 5 != 0, F.col("o_orderpriority"))), f"SELECT row_id, CASE WHEN o_custkey % 5 <> 0 THEN o_orderpriority END AS value FROM {orders}")
    codec_query("bitpack_nulls", "BITPACK", lambda df: df.withColumn("v", F.col("v") % 2 == 0), f"SELECT row_id, {gap} % 2 = 0 AS value FROM {orders}")
    codec_query("float_delta_roundtrip", "FLOATDELTA", lambda df: df.withColumn("v", F.when(F.col("o_custkey") % 5 != 0, F.col("o_totalprice"))), f"SELECT row_id, CASE WHEN o_custkey % 5 <> 0 THEN o_totalprice END AS value FROM {orders}")
    codec_query("cdelta_roundtrip", "CDELTA", lambda df: df.withColumn("v", 3 * F.col("row_id") - 7), f"SELECT row_id, 3 * row_id - 7 AS value FROM {orders}")

    @query(f"SELECT chunk_id, count(v) = count(*) AND coalesce(min(s), 0) = coalesce(max(s), 0) AS constant FROM (SELECT *, v - lag(v) OVER (PARTITION BY chunk_id ORDER BY row_id) AS s FROM (SELECT chunk_id, row_id, CASE WHEN row_id <> 5 THEN row_id END AS v FROM {orders})) GROUP BY chunk_id")
    def cdelta_nulls(spark, sf_dir):
        df = numbered(spark, sf_dir, "orders", "o_orderkey").withColumn("v", F.when(F.col("row_id") != 5, F.col("row_id")))
        return encodings.constant_step(df, "v").select("chunk_id", "constant")

    runs_sql = f"""(SELECT chunk_id, run, any_value(event_type) AS v, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY chunk_id ORDER BY row_id) AS run FROM (
        SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY chunk_id ORDER BY row_id) THEN 1 ELSE 0 END AS new FROM {events})) GROUP BY chunk_id, run)"""
    runs = lambda spark, sf_dir: encodings.rle_encode(numbered(spark, sf_dir, "events", "event_id", "event_type"), "event_type")
    query(f"SELECT chunk_id, string_agg(n || '~' || v, ',' ORDER BY run) AS runs FROM {runs_sql} GROUP BY chunk_id", "rle_text_form")(lambda s, d: encodings.rle_text(runs(s, d)))
    query(f"SELECT chunk_id, string_agg(v || '|' || n, '|' ORDER BY run) AS runs FROM {runs_sql} GROUP BY chunk_id", "rle_pairs_form")(lambda s, d: encodings.rle_pairs(runs(s, d)))
    byte = "lpad(hex({0}), 2, '0')"
    varint = f"CASE WHEN n < 128 THEN {byte.format('n')} ELSE {byte.format('(n % 128 + 128)')} || {byte.format('(n // 128)')} END"
    query(f"SELECT chunk_id, string_agg({byte.format('strlen(v)')} || hex(v) || {varint}, '' ORDER BY run) AS runs FROM {runs_sql} GROUP BY chunk_id", "rle_bytes_form")(lambda s, d: encodings.rle_bytes(runs(s, d)).select("chunk_id", F.hex("runs").alias("runs")))

    @query(f"SELECT chunk_id, CASE WHEN min(o_totalprice) = max(o_totalprice) THEN 'RLE' WHEN bool_and(o_totalprice = floor(o_totalprice)) AND max(o_totalprice) - min(o_totalprice) < 4294967296 THEN 'FOR' ELSE 'FLOATDELTA' END AS codec FROM {orders} GROUP BY chunk_id")
    def codec_advice_float(spark, sf_dir):
        return advisor.float_codec(numbered(spark, sf_dir, "orders", "o_orderkey", "o_totalprice"), "o_totalprice").select("chunk_id", "codec")

    @query("SELECT row_number() OVER (ORDER BY c_name) - 1 AS row_id, c_name FROM customer")
    def row_id_by_text(spark, sf_dir):
        """Row numbers by a text key, over several key ranges."""
        return tables.with_row_id(load(spark, sf_dir, "customer").select("c_name"), "c_name", ranges=7)

    @query("SELECT count(*) AS n_rows, CAST(ceil(count(*) / 65536.0) AS BIGINT) AS chunks, count(*) * 9 * 50 AS bytes, true AS cached FROM orders")
    def size_estimate(spark, sf_dir):
        """The size at a fixed number of bytes a cell, by way of the metadata cache."""
        cache = stats.MetadataCache()
        cache.put("orders", stats.size_estimate(load(spark, sf_dir, "orders").count(), 9))
        s = cache.get("orders")
        return spark.createDataFrame([(s["rows"], s["chunks"], s["bytes"], cache.get("absent") is None)], "n_rows long, chunks long, bytes long, cached boolean")
