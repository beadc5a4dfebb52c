import pytest

from quarrydf.plans.query import Query, Select, Where, build, sql, to_csv, to_table


@pytest.fixture()
def people(spark):
    rows = [("Alice", 25, 90000.0, "Engineering", True), ("Bob", 30, 75000.0, "Sales", False), ("Carol", 41, 60000.5, None, True), ("Dan", None, None, "Sales", None), ("Eve", 28, 95000.0, "Engineering", False)]
    return spark.createDataFrame(rows, "name string, age long, salary double, dept string, active boolean")


def names(df):
    return [r[0] for r in df.collect()]


@pytest.mark.parametrize(
    "op,value,found",
    [("=", "30", ["Bob"]), ("!=", "30", ["Alice", "Carol", "Eve"]), (">", "28", ["Bob", "Carol"]), ("<", "28", ["Alice"]), (">=", "28", ["Bob", "Carol", "Eve"]), ("<=", "28", ["Alice", "Eve"]), ("contains", "2", ["Alice", "Eve"]), ("in", ["25", "41"], ["Alice", "Carol"]), ("like", "2_", ["Alice", "Eve"])],
)
def test_operators_leave_nulls_out(people, op, value, found):
    assert sorted(names(build(people, Query([Select("name")], [Where("age", op, value)])))) == found


def test_bad_literals_and_names_are_errors(people):
    with pytest.raises(ValueError):
        build(people, Query([Select("name")], [Where("age", "=", "old")]))
    with pytest.raises(ValueError):
        build(people, Query([Select("name")], [Where("salary", "=", "much")]))
    with pytest.raises(ValueError):
        build(people, Query([Select("name")], [Where("age", "~", "1")]))
    with pytest.raises(ValueError):
        build(people, Query([Select("name"), Select("*", "count")], group_by=["dept"]))


def test_groups_order_and_limit(people):
    q = Query([Select("dept"), Select("*", "count", "n"), Select("age", "avg", "mean")], group_by=["dept"], order_by="n", descending=True, limit=2)
    assert {r["dept"]: (r["n"], r["mean"]) for r in build(people, q).collect()} == {"Engineering": (2, 26.5), "Sales": (2, 30.0)}
    assert names(build(people, Query([Select("name")], order_by="age"))) == ["Alice", "Eve", "Bob", "Carol", "Dan"]
    assert names(build(people, Query([Select("name")], order_by="age", descending=True))) == ["Carol", "Bob", "Eve", "Alice", "Dan"]


def test_empty_table(people):
    none = people.limit(0)
    assert build(none, Query([Select("*", "count", "n"), Select("age", "sum", "s")])).collect()[0].asDict() == {"n": 0, "s": None}
    assert build(none, Query([Select("dept"), Select("*", "count")], group_by=["dept"])).count() == 0


def test_plan_prunes_and_pushes(spark, sf):
    df = build(spark.read.parquet(f"{sf}/lineitem.parquet"), Query([Select("l_orderkey")], [Where("l_quantity", ">", "45")]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,45.0)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_results_as_text(people):
    assert to_csv(people.filter("age = 25").select("name", "dept", "active")) == "name,dept,active\nAlice,Engineering,True\n"
    shown = to_table(people.orderBy("name").select("name", "age"), rows=2)
    assert shown.splitlines()[-1] == "... 3 more rows"
    assert sql(people.sparkSession, "SELECT count(*) AS n FROM {t}", t=people).first()["n"] == 5
