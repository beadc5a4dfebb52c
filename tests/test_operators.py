import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrydf.functions.schema import as_bool, as_int, display, is_numeric, parse_schema, schema_text
from quarrydf.operators import encodings, index, lifecycle, security, stats, tables
from quarrydf.sources import interchange, store
from quarrydf.streaming.events import read_stream, windowed


def column(spark, values, kind="long", chunk=4):
    return spark.createDataFrame([(i, i // chunk, v) for i, v in enumerate(values)], f"row_id long, chunk_id long, v {kind}")


def back(df, name="value"):
    return [r[name] for r in df.orderBy("row_id").collect()]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-(2**40), 2**40), min_size=1, max_size=14))
def test_integer_round_trips(spark, values):
    df = column(spark, values)
    assert back(encodings.delta_decode(encodings.delta_encode(df, "v"))) == values
    assert back(encodings.for_decode(encodings.for_encode(df, "v"))) == values
    assert back(encodings.rle_decode(encodings.rle_encode(df, "v"))) == values
    z = df.select("row_id", encodings.unzigzag(encodings.zigzag(F.col("v"))).alias("value"))
    assert back(z) == values


def test_fixtures(spark):
    delta = encodings.delta_encode(column(spark, [25, 30, 25], chunk=9), "v")
    assert back(delta, "delta") == [25, 5, -5]
    runs = encodings.rle_encode(column(spark, ["true", "true", "false"], "string", 9), "v")
    assert encodings.rle_text(runs).first()["runs"] == "2~true,1~false"
    runs = encodings.rle_encode(column(spark, list("AAABBCCCC"), "string", 99), "v")
    assert [(r["value"], r["length"]) for r in runs.orderBy("run_id").collect()] == [("A", 3), ("B", 2), ("C", 4)]
    words = column(spark, ["Alice", "Bob", "Alice", "Carol", "Bob", "Dave", "Alice"], "string")
    codes = encodings.dictionary(words, "v")
    assert [r["value"] for r in codes.orderBy("code").collect()] == ["Alice", "Bob", "Carol", "Dave"]
    assert back(encodings.dictionary_encode(words, "v", codes), "code") == [0, 1, 0, 2, 1, 3, 0]
    posted = index.postings(column(spark, ["A", "B", "A"], "string"), "v")
    assert {r["value"]: r["rows"] for r in posted.collect()} == {"A": [0, 2], "B": [1]}
    assert index.index_size(posted).first()["bytes"] == 2 + 24


def test_nulls_survive(spark):
    values = [None, None, "x", None, "x", "x", ""]
    df = column(spark, values, "string", 99)
    assert back(encodings.rle_decode(encodings.rle_encode(df, "v"))) == values
    codes = encodings.dictionary(df, "v")
    assert back(encodings.dictionary_decode(encodings.dictionary_encode(df, "v", codes), codes)) == values


def test_bools_and_steps(spark):
    values = [i % 3 == 0 for i in range(19)]
    packed = encodings.pack_bools(column(spark, values, "boolean"), "v")
    assert [r["byte"] for r in packed.orderBy("byte_id").collect()] == [0b01001001, 0b10010010, 0b100]
    assert back(encodings.unpack_bools(packed, 19)) == values
    steps = encodings.constant_step(column(spark, [5, 8, 11, 14, 1, 2, 4, 5, 9, 10], chunk=4), "v")
    assert {r["chunk_id"]: r["constant"] for r in steps.collect()} == {0: True, 1: False, 2: True}
    assert [r["value"] for r in encodings.constant_step_decode(steps).orderBy("chunk_id", "at").collect()] == [5, 8, 11, 14, 9, 10]


def test_row_ids_over_several_ranges(spark):
    keys = [(k * 7919) % 100_003 for k in range(1000)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r["k"]: r["row_id"] for r in tables.with_row_id(df, "k", ranges=7).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}
    one = {r["k"]: r["row_id"] for r in tables.with_row_id(df, "k").collect()}
    assert one == got


@pytest.mark.parametrize("rows", [1, 3, 4, 5])
def test_chunk_boundaries_and_ranges(spark, rows):
    df = tables.with_chunk_id(tables.with_row_id(spark.range(10, 10 + rows), "id"), chunk_rows=4)
    assert df.agg(F.countDistinct("chunk_id")).first()[0] == -(-rows // 4)
    assert tables.row_range(df, 2, 99).count() == max(0, rows - 2)
    assert tables.row_range(df, 3, 3).count() == 0
    assert [r["id"] for r in tables.row_at(df, 0).collect()] == [10]
    assert tables.row_at(df, 99).count() == 0


def test_zones_and_stats(spark):
    df = column(spark, [1.5, -1.9, None, 3.0, None, None, None, None, 9.0], "double")
    zones = stats.zone_map(df, ["v"])
    assert {r["chunk_id"]: (r["v_min"], r["v_max"], r["v_nulls"]) for r in zones.collect()} == {0: (-1.9, 3.0, 1), 1: (None, None, 4), 2: (9.0, 9.0, 0)}
    for op, value in [("=", 3.0), (">", 2.9), ("<", -1.0), (">=", 9.0), ("<=", -1.9), ("!=", 9.0)]:
        real = {r[0] for r in df.filter(F.expr(f"v {op} {value}")).select("chunk_id").collect()}
        assert real <= {r[0] for r in stats.surviving(zones, "v", op, value).select("chunk_id").collect()}
    s = {r["column_name"]: r for r in stats.with_ratio(stats.column_stats(df, ["v", "row_id"])).collect()}
    assert (s["v"]["n_rows"], s["v"]["n_distinct"], s["v"]["n_nulls"]) == (9, 4, 5) and s["row_id"]["ratio"] == 0.1


def test_metadata_cache_forgets():
    now = [0.0]
    cache = stats.MetadataCache(10, clock=lambda: now[0])
    cache.put("t", 1)
    now[0] = 9
    assert cache.get("t") == 1
    now[0] = 20
    assert cache.get("t") is None and stats.size_estimate(65_537, 2)["chunks"] == 2


def test_bloom_has_no_false_negatives(spark):
    df = column(spark, [f"k{i}" for i in range(60)], "string", 10)
    bloom = index.build_bloom(df, "v")
    for i in (0, 9, 10, 59):
        assert i // 10 in {r[0] for r in index.may_contain(bloom, f"k{i}").collect()}
    assert index.may_contain(bloom, "absent").count() <= 1


def test_schema_text_and_values(spark):
    schema = parse_schema("name:str, age:int,salary:float,active:bool")
    assert schema_text(schema) == "name:str,age:int,salary:float,active:bool"
    with pytest.raises(ValueError):
        parse_schema("a:decimal")
    df = spark.createDataFrame([("1", 1.9), ("TRUE", -1.9), ("no", None), (None, 0.5)], "s string, d double")
    assert [r[0] for r in df.select(as_bool(F.col("s"))).collect()] == [True, True, False, None]
    assert [r[0] for r in df.select(as_int(F.col("d"))).collect()] == [1, -1, None, 0]
    assert [r[0] for r in df.select(display(F.col("d"), T.DoubleType())).collect()] == ["1.9", "-1.9", "null", "0.5"]
    texts = ["123", "45.67", "-89", "hello", "NULL", "2026-05-08", "true", "", "-", "1.2.3"]
    found = spark.createDataFrame([(t,) for t in texts], "s string").select(is_numeric(F.col("s"))).collect()
    assert [r[0] for r in found] == [True, True, True, False, True, False, False, True, True, True]


def test_evolve_and_tombstones(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    out = lifecycle.evolve(df, parse_schema("y:float,id:int"))
    assert out.columns == ["y", "id"] and [tuple(r) for r in out.orderBy("id").collect()] == [(None, 1), (None, 2)]
    rows = spark.range(5).withColumnRenamed("id", "row_id")
    gone = lifecycle.Tombstones.none(spark).delete(rows.filter("row_id IN (1, 3)")).delete(rows.filter("row_id = 3")).delete(spark.createDataFrame([(99,)], "row_id long"))
    assert sorted(r[0] for r in gone.active(rows).collect()) == [0, 2, 4] and gone.active_count(rows).first()[0] == 3


def test_versions(spark, tmp_path):
    t = lifecycle.VersionedTable(spark, str(tmp_path / "t"))
    assert t.latest() is None
    with pytest.raises(ValueError):
        t.current()
    one = t.begin(spark.range(3)).commit("first | with bar", timestamp="2020-01-01T00:00:00")
    assert one.rows == 3
    a, b = t.begin(spark.range(5)), t.begin(spark.range(7))
    a.commit("second", timestamp="2021-01-01T00:00:00")
    with pytest.raises(RuntimeError):
        b.commit("too late")
    b.abort()
    assert t.current().count() == 5 and t.checkout(1).count() == 3
    assert t.as_of("2020-06-01").count() == 3 and t.history()[0] == "v1 2020-01-01T00:00:00 first | with bar"
    with pytest.raises(ValueError):
        t.as_of("2019-01-01")
    with pytest.raises(ValueError):
        t.checkout(9)


def test_checksums_find_damage(spark):
    df = column(spark, ["a", None, "", "b", "c"], "string", 2).drop("row_id")
    recorded = security.chunk_checksums(df)
    assert security.damaged_chunks(df, recorded).count() == 0
    changed = df.withColumn("v", F.when(F.col("v") == "b", "B").otherwise(F.col("v")))
    assert [r[0] for r in security.damaged_chunks(changed, recorded).collect()] == [1]


def test_encryption(spark):
    df = spark.createDataFrame([("x", 1.5), (None, None)], "s string, d double")
    key = b"k" * 32
    hidden = security.encrypt_columns(df, ["s", "d"], key, "k1")
    assert "k" * 32 not in str(hidden.schema.jsonValue()) and dict(hidden.dtypes)["d"] == "binary"
    got = {tuple(r) for r in security.decrypt_columns(hidden, {"k1": key}).collect()}
    assert got == {("x", 1.5), (None, None)}
    with pytest.raises(Exception):
        security.decrypt_columns(hidden, {"k1": b"w" * 32}).collect()


def test_interchange(spark, tmp_path):
    rows = [("a\tb", 1, 1.5, True), ("c\nd\\n", None, None, False), (None, -3, 0.1, None), ("", 0, -0.0, True)]
    df = spark.createDataFrame(rows, "s string, i long, d double, b boolean")
    interchange.write_text(df, str(tmp_path / "text"))
    assert {tuple(r) for r in interchange.read_text(spark, str(tmp_path / "text")).collect()} == set(rows)
    assert {r[0] for r in interchange.bracketed(spark.createDataFrame([("x", None)], "a string, b string")).collect()} == {"[x,NULL]"}
    plain = spark.createDataFrame([("x", 1), (None, 2)], "s string, i long")
    interchange.write_csv(plain, str(tmp_path / "csv"))
    interchange.csv_to_parquet(spark, str(tmp_path / "csv"), str(tmp_path / "pq"), "s:str,i:int")
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "pq")).collect()} == {("x", 1), (None, 2)}
    done = interchange.process_batch(spark, [str(tmp_path / "pq"), str(tmp_path / "nothing")], "row_count")
    assert done[str(tmp_path / "pq")] == 2 and str(done[str(tmp_path / "nothing")]).startswith("error")
    assert interchange.file_stats(spark, str(tmp_path / "pq"))["rows"] == 2
    assert [len(c) for c in interchange.in_chunks(spark.range(7), 3)] == [3, 3, 1]
    assert next(iter(interchange.in_chunks(spark.range(1000), 2)))
    (tmp_path / "a").write_bytes(b"1")
    (tmp_path / "b").write_bytes(b"1")
    assert interchange.same_bytes(spark, str(tmp_path / "a"), str(tmp_path / "b"))


def test_stream_counts_like_a_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = windowed(read_stream(spark, str(tmp_path / "in"), events.schema), "ts", ["event_type"], "user_id")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("counts").collect()} == {tuple(r) for r in windowed(events, "ts", ["event_type"], "user_id").collect()}


def test_store_prunes_and_reports(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(2000).selectExpr("id", "id % 4 AS part", "cast(id AS string) AS name")
    store.write(df, path, partition_by=["part"], sort_by=["id"], bloom=["name"], chunk_bytes=1 << 20)
    assert store.partitions(spark, path) == 4
    plan = store.read(spark, path, columns=["id", "part"]).filter("part = 2 AND id > 5")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "GreaterThan(id,5)" in plan and "name" not in plan.split("ReadSchema")[1]
    with pytest.raises(Exception):
        store.write(df, path)
    store.write(df, path, mode="ignore")
    with pytest.raises(ValueError):
        store.write(df, path, mode="sometimes")
    assert store.report(spark, path).startswith("2000 rows, 3 columns")
    more = str(tmp_path / "u")
    store.write(spark.range(3).selectExpr("id", "1.5D AS extra"), more)
    assert set(store.read(spark, path, more, merge=True).columns) == {"id", "name", "part", "extra"}
    with pytest.raises(ValueError):
        store.read(spark, more, columns=["absent"])


def test_tables_from_rows_and_columns(spark):
    rows = [(1, "alice", True, 3.5), (2, "bob", False, 7.25), (3, None, None, None)]
    df = store.from_rows(spark, rows, "id:int,name:str,flag:bool,score:float")
    assert [tuple(r) for r in df.orderBy("id").collect()] == rows
    same = store.from_columns(spark, {"id": [1, 2, 3], "name": ["alice", "bob", None]}, "id:int,name:str")
    assert [tuple(r) for r in same.orderBy("id").collect()] == [r[:2] for r in rows]
    assert store.from_rows(spark, [], "id:int").count() == 0 and store.from_columns(spark, {"id": []}, "id:int").count() == 0
    with pytest.raises(ValueError):
        store.from_columns(spark, {"a": [1], "b": []})


def test_damaged_chunks_become_null(spark):
    df = column(spark, ["a", "b", "c"], "string", 2).drop("row_id")
    recorded = security.chunk_checksums(df)
    changed = df.withColumn("v", F.when(F.col("v") == "c", "C").otherwise(F.col("v")))
    assert sorted(r["v"] or "" for r in security.null_damaged(changed, recorded).collect()) == ["", "a", "b"]
    assert spark.range(1).select(F.crc32(F.lit("123456789").cast("binary"))).first()[0] == 3421780262
