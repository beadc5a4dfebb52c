"""Cases that once went wrong: nulls in encodings, keys of any type, logs of dead writers, odd text, literals of another width."""

import os
import random

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrydf.__main__ import main
from oracle import TABLES, same
from quarrydf.operators import advisor, encodings, index, lifecycle, tables
from quarrydf.plans import catalog
from quarrydf.sources import format as table_format
from quarrydf.sources import interchange
from test_operators import back, column

LOOSE = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def there_and_back(df, codec):
    return back(encodings.decode(encodings.encode(df, "v", codec)))


@LOOSE
@given(st.lists(st.none() | st.integers(-(2**40), 2**40), min_size=1, max_size=14))
def test_whole_numbers_with_nulls(spark, values):
    df = column(spark, values)
    for codec in ("RAW", "DELTA", "FOR", "RLE", "BDICT", "DICTRLE"):
        assert there_and_back(df, codec) == values


@LOOSE
@given(st.lists(st.none() | st.floats(allow_nan=False), min_size=1, max_size=14), st.lists(st.none() | st.booleans(), min_size=1, max_size=20))
def test_floats_and_truth_values_with_nulls(spark, floats, truths):
    assert list(map(repr, there_and_back(column(spark, floats, "double"), "FLOATDELTA"))) == list(map(repr, floats))
    assert there_and_back(column(spark, truths, "boolean"), "BITPACK") == truths


def test_constant_steps(spark):
    steps = {r["chunk_id"]: r["constant"] for r in encodings.constant_step(column(spark, [5, None, 5, 5, 7, 7, 7, 7]), "v").collect()}
    assert steps == {0: False, 1: True}
    assert there_and_back(column(spark, [5, 8, 11, 14, 1, 1, 1, 1, 9]), "CDELTA") == [5, 8, 11, 14, 1, 1, 1, 1, 9]
    with pytest.raises(ValueError):
        encodings.encode(column(spark, [1, 2, 4]), "v", "CDELTA")
    with pytest.raises(ValueError):
        encodings.encode(column(spark, [1]), "v", "LZ")


def test_runs_as_text_and_bytes(spark):
    runs = encodings.rle_encode(column(spark, ["a"] * 300 + ["bé"], "string", 999), "v")
    assert encodings.rle_pairs(runs).first()["runs"] == "a|300|bé|1"
    assert bytes(encodings.rle_bytes(runs).first()["runs"]) == b"\x01a\xac\x02\x03b\xc3\xa9\x01"


def test_advice_counts_nulls_as_values(spark):
    runs = lambda values: advisor.string_codec(column(spark, values, "string", 99), "v").first()["runs"]
    assert (runs([None, None]), runs(["a", None]), runs(["a", None, "a"])) == (1, 2, 3)
    codec = lambda values: advisor.float_codec(column(spark, values, "double", 99), "v").first()["codec"]
    assert (codec([1.5, 1.5]), codec([1.0, 9.0]), codec([1.5, 2.0])) == ("RLE", "FOR", "FLOATDELTA") and advisor.codec_by_type("boolean") == "BITPACK"


@pytest.mark.parametrize("kind", ["bigint", "string", "date"])
@pytest.mark.parametrize("ranges", [1, 7])
def test_row_numbers_by_any_key(spark, kind, ranges):
    made = {"bigint": "id * 7919 % 1009", "string": "concat('k', id * 7919 % 1009, 'é')", "date": "date_add(date '2000-01-01', int(id * 7919 % 1009))"}
    df = spark.range(1000).select(F.expr(made[kind]).alias("k")).repartition(3)
    got = {r["k"]: r["row_id"] for r in tables.with_row_id(df, "k", ranges=ranges).collect()}
    assert got == {k: i for i, k in enumerate(sorted(got))} and len(got) == 1000
    for wrong in (df.unionByName(df.limit(1)), df.unionByName(df.limit(1).select(F.expr(f"cast(null AS {kind})").alias("k")))):
        with pytest.raises(Exception, match="is not unique|is null"):
            tables.with_row_id(wrong, "k", ranges=ranges).collect()


def test_a_dead_writer_blocks_nobody(spark, tmp_path):
    t = lifecycle.VersionedTable(spark, str(tmp_path / "t"))
    t.begin(spark.range(3)).commit("one", timestamp="2020-01-01T12:00:00+02:00")
    (tmp_path / "t" / "_log" / "00000002.json").write_bytes(b"")
    assert t.commit(spark.range(4)).version == 3 and t.current().count() == 4 and [v.version for v in t.versions()] == [1, 3]
    assert t.as_of("2020-01-01 10:00:05").count() == 3
    with pytest.raises(ValueError):
        t.as_of("2020-01-01 09:59:59")
    table_format.register(spark)
    read = lambda **o: spark.read.format("quarrydf").options(**o).load(str(tmp_path / "t")).count()
    assert (read(), read(version="1")) == (4, 3)


def test_any_text_survives(spark, tmp_path):
    rng = random.Random(0)
    texts = ["".join(rng.choice('ab \t\n\r"\\N,\u0000é') for _ in range(rng.randint(0, 8))) for _ in range(200)] + ["NULL", "\\NULL", "\\\\NULL", "\\N", None, "", " x "]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, s string")
    interchange.write_text(df, str(tmp_path / "text"))
    assert {tuple(r) for r in interchange.read_text(spark, str(tmp_path / "text")).collect()} == set(enumerate(texts))
    # the CSV parser knows no lone carriage return and no NUL; all else comes back
    plain = [(i, t) for i, t in enumerate(texts) if t is None or "\r" not in t and "\u0000" not in t]
    interchange.write_csv(spark.createDataFrame(plain, "id long, s string"), str(tmp_path / "csv"))
    assert {tuple(r) for r in interchange.read_csv(spark, str(tmp_path / "csv"), "id:int,s:str").collect()} == set(plain)


def test_bloom_literals_of_another_width(spark):
    df = spark.range(100).select("id", F.lit(0).alias("chunk_id"))
    assert index.may_contain(index.build_bloom(df, "id"), 77).count() == 1


def test_commands(spark, tmp_path, capsys):
    spark.createDataFrame([(1, "x")], "id long, s string").write.parquet(str(tmp_path / "t"))
    path = str(tmp_path / "t")
    assert main(["read", path], spark) == 0 and capsys.readouterr().out == "id,s\n1,x\n"
    assert main(["read-column", path, "s"], spark) == 0 and capsys.readouterr().out == "s\nx\n"
    assert main(["stats", path], spark) == 0 and '"rows": 1' in capsys.readouterr().out
    assert main(["validate", path], spark) == 0 and main(["validate", path + "-absent"], spark) == 1


def test_posting_lists_are_whole_beyond_one_block(spark, sf, tmp_path):
    """One list a value, as the SQL has it, for more rows than a block of the index holds; keys in no order, null among the values."""
    for t in set(TABLES) - {"events"}:
        os.symlink(f"{sf}/{t}.parquet", tmp_path / f"{t}.parquet")
    kind = "CASE i * 31 % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'é' ELSE 'view' END"
    duckdb.sql(f"COPY (SELECT i * 7919 % 1048583 AS event_id, {kind} AS event_type FROM range(1048583) r(i)) TO '{tmp_path}/events.parquet'")
    same(catalog.queries()["posting_index"](spark, str(tmp_path)), catalog.oracle_sql()["posting_index"], str(tmp_path))


def test_posting_blocks_put_together(spark):
    values = ["a", None, "b", "a", "a", None, "a", "b", "a", "a", None]
    blocks = index.postings(column(spark, values, "string").repartition(3), "v", block_rows=2)
    assert blocks.count() == 10
    got = [(r["value"], r["rows"]) for r in index.whole_lists(blocks.repartition(4)).collect()]
    assert sorted(got, key=repr) == sorted([(v, [i for i, x in enumerate(values) if x == v]) for v in ("a", "b", None)], key=repr)
