"""Plan operations on small tables."""

import math

import pytest

from sparkqa.plans.plan import Filter, Plan, PlanError, answer_table, apply_filters, distinct_filters, filter_trace, run_plan, sample_sources
from sparkqa.sources import catalog as C


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame([("EMEA", "Open", 10), ("APAC", "Closed", 20), ("EMEA", "Open", 30), ("AMER", "Open", 40)], "region string, status string, amount int")


@pytest.fixture(scope="module")
def groups(spark):
    return spark.createDataFrame([("b", 5.0), ("a", 5.0), (None, 5.0), ("c", 7.0), ("c", None)], "g string, v double")


def value(df, plan, **kw):
    return run_plan(df, plan, **kw).first()["value"]


def test_count_with_two_filters(sales):
    assert value(sales, Plan("count", filters=(Filter("status", "eq", "open"), Filter("region", "eq", " EMEA ")))) == 2


@pytest.mark.parametrize("rows,schema,plan,want", [
    ([("Finance", "Senior", 120000), ("Finance", "Junior", 80000), ("Engineering", "Senior", 150000)], "department string, level string, salary int", Plan("sum", target="salary", filters=(Filter("department", "eq", "Finance"),)), 200000),
    ([("Finance", 120000), ("Finance", 80000), ("Engineering", 150000)], "Department string, Salary int", Plan("avg", target="Salary", filters=(Filter("Department", "eq", "finance"),)), 100000),
    ([("Furniture", 10), ("Furniture", 20), ("Technology", 100), ("Office Supplies", 50)], "Category string, Revenue int", Plan("sum", target="Revenue", filters=(Filter("Category", "eq", "Furniture"),)), 30),
    ([("North", 275000), ("South", 50000), ("North", 330000), ("West", 10000)], "Region string, Revenue int", Plan("sum", target="Revenue", filters=(Filter("Region", "eq", "North"),)), 605000),
    ([("First Class", 10), ("Second Class", 90), ("First Class", 15)], "`Ship Mode` string, Amount int", Plan("sum", target="Amount", filters=(Filter("Ship Mode", "eq", "first class"),)), 25),
    ([("Widgets", 5), ("Gadgets", 50), ("Widgets", 7)], "`Product Category` string, `Net Sales` int", Plan("sum", target="Net Sales", filters=(Filter("Product Category", "eq", "Widgets"),)), 12),
    ([("Furniture", 10), ("Technology", 100)], "Category string, Revenue int", Plan("sum", target="Revenue"), 110),
])
def test_sums(spark, rows, schema, plan, want):
    assert value(spark.createDataFrame(rows, schema), plan) == want


def test_correlation(spark):
    rows = [(100 + i, i, 1000, 1000 * i) for i in range(1, 19)]
    df = spark.createDataFrame(rows, "Order_ID int, Quantity int, Unit_Price int, Revenue int")
    assert value(df, Plan("correlation", targets=("Quantity", "Revenue"))) > 0.99
    assert value(df, Plan("correlation", targets=("Quantity", "Unit_Price"))) is None
    types = {r["column"]: r.semantic_type for r in C.profile(df, rules="catalog").collect()}
    assert types["Order_ID"] == "identifier" and types["Quantity"] == "integer"


def test_identifier_that_counts(spark):
    rows = [("Order_ID", "bigint", "identifier", "identifier"), ("Quantity", "bigint", "identifier", "identifier"), ("Revenue", "bigint", "numeric", "measure")]
    df = spark.createDataFrame(rows, "column string, kind string, semantic_type string, role string")
    assert {r["column"]: r.ok for r in df.select("column", C.usable_numeric().alias("ok")).collect()} == {"Order_ID": False, "Quantity": True, "Revenue": True}


def test_groups_and_rankings(groups):
    assert {r.g: r.value for r in run_plan(groups, Plan("group_sum", target="v", group_by=("g",))).collect()} == {"a": 5, "b": 5, "c": 7, None: 5}
    assert [r.g for r in run_plan(groups, Plan("top_n", target="v", group_by=("g",))).collect()] == ["c", "a", "b", None]
    assert [r.g for r in run_plan(groups, Plan("bottom_n", target="v", group_by=("g",))).collect()] == ["a", "b", None, "c"]
    assert {r.g: r.value for r in run_plan(groups, Plan("group_count", group_by=("g",))).collect()}["c"] == 2


def test_ratio_and_spread(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 0.0), (None, 4.0), (6.0, 3.0)], "a double, b double")
    assert value(df, Plan("ratio", targets=("a", "b"))) == 1.25
    assert value(df.limit(1), Plan("std", target="a")) is None
    assert value(df, Plan("percentage", target="b", filters=(Filter("a", "gt", 2),))) == pytest.approx(3 / 9 * 100)


def test_strings_as_numbers(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("1d",), (" 2 ",), (None,), ("1e1",)], "v string")
    assert value(df, Plan("sum", target="v")) == 13.5
    with pytest.raises(PlanError):
        run_plan(df.where("v = 'x'"), Plan("sum", target="v"), strict=True)


def test_null_texts_and_numbers_in_filters(spark):
    df = spark.createDataFrame([(None, 10.0), ("nan", 20.0), ("A & B", math.nan)], "s string, x double")
    assert apply_filters(df, [Filter("s", "eq", "nan")]).count() == 1
    assert apply_filters(df, [Filter("s", "ne", "nan")]).count() == 2
    assert apply_filters(df, [Filter("s", "contains", "a and")]).count() == 1
    assert apply_filters(df, [Filter("x", "eq", "10")]).count() == 1
    assert apply_filters(df, [Filter("x", "gt", 1)]).count() == 2


@pytest.mark.parametrize("plan", [
    Plan("power"), Plan("sum", target="nope"), Plan("sum"), Plan("group_sum", target="amount"), Plan("top_n", target="amount", limit=0), Plan("top_n", target="amount", limit=1001),
    Plan("count", filters=(Filter("amount", "gt", "many"),)), Plan("count", filters=(Filter("amount", "like", "x"),)), Plan("correlation", targets=("amount",)), Plan("trend", target="amount"),
])
def test_refusals(sales, plan):
    with pytest.raises(PlanError):
        run_plan(sales, plan)


def test_trace_and_sources(spark, sales):
    trace = filter_trace(sales, [Filter("status", "eq", "Open"), Filter("amount", "gte", 30)]).orderBy("step").collect()
    assert [r.rows_after for r in trace] == [3, 2]
    rows = C.with_lineage(sales, "Sales Data.csv")
    assert [r["__row_number"] for r in rows.orderBy("__row_number").collect()] == [1, 2, 3, 4]
    assert rows.first()["__table_id"] == "uploaded_sales_data_csv"
    assert sample_sources(rows).columns == ["region", "status", "amount"]


def test_tables_that_answer(sales, groups):
    catalog = C.catalog_of({"sales": sales, "groups": groups})
    assert answer_table(["amount"], catalog) == "sales"
    with pytest.raises(PlanError):
        answer_table(["nothing"], catalog)


def test_distinct_filters():
    kept = distinct_filters([Filter("A", "eq", "x y"), Filter("a", "eq", "X-Y"), Filter("a", "ne", "x y")])
    assert [f.op for f in kept] == ["eq", "ne"]


def test_headers():
    assert C.clean_headers([" Revenue ", "revenue", "", ""]) == ["Revenue", "revenue_2", "Unnamed", "Unnamed_2"]


def test_profile_edges(spark):
    df = spark.createDataFrame([(None, "yes", "2024-01-01", "1"), (None, "No", "2024-02-01", "0"), (None, "n", "x", "1")], "empty string, flag string, day string, bit string")
    got = {r["column"]: r for r in C.profile(df).collect()}
    assert got["empty"].semantic_type == "text" and got["empty"].non_null == 0
    assert got["flag"].semantic_type == "boolean" and got["bit"].semantic_type == "numeric"
    assert C.profile(df.limit(0)).count() == 0
    assert {r["column"]: r.samples for r in C.sample_values(df.selectExpr("*", "monotonically_increasing_id() AS r"), "r", 2, ["flag"]).collect()} == {"flag": ["yes", "No"]}


def test_whole_numbers_compare_exactly_and_reach_the_scan(spark, tmp_path):
    from decimal import Decimal

    big = 2**53
    rows = [(big, Decimal("1.10"), 1), (big + 1, Decimal("1.11"), 2), (None, None, None), (-3, Decimal("-0.50"), 3)]
    path = str(tmp_path / "numbers")
    spark.createDataFrame(rows, "k long, d decimal(10,2), i int").write.parquet(path)
    df = spark.read.parquet(path)
    found = lambda *f: sorted(r.i for r in apply_filters(df, [Filter(*f)]).collect() if r.i)
    assert found("k", "eq", big + 1) == [2] and found("k", "gt", big) == [2] and found("k", "lte", str(big)) == [1, 3] and found("k", "ne", big) == [2, 3]
    assert found("k", "gt", 2.5) == found("k", "gte", 2.5) == [1, 2] and found("k", "lt", -2.5) == [3] and found("k", "lt", -3.5) == [] and found("k", "eq", 2.5) == []
    assert found("d", "eq", "1.1") == [1] and found("d", "gt", 1.1) == [2] and found("d", "lt", "1.105") == [1, 3] and found("d", "gt", 10**12) == []
    for f in (Filter("k", "gt", big), Filter("d", "gte", "1.10"), Filter("i", "lt", 3)):
        plan = apply_filters(df, [f])._jdf.queryExecution().executedPlan().toString()
        assert {"gt": "GreaterThan", "gte": "GreaterThanOrEqual", "lt": "LessThan"}[f.op] + f"({f.column}," in plan


def test_median_against_python(spark):
    import random
    import statistics

    random.seed(3)
    for values in ([], [None], [5.0], [1.0, 2.0], [random.choice([1.0, 2.0, random.random()]) for _ in range(30_001)], [random.gauss(0, 1) for _ in range(25_000)] + [None] * 10):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        there = [v for v in values if v is not None]
        assert run_plan(df, Plan("median", target="x")).first().value == (pytest.approx(statistics.median(there)) if there else None)


def test_median_in_several_brackets(spark):
    """A coarse sketch needs several rounds; values without number, values that most rows share, and two values only."""
    import random
    import statistics

    from sparkqa.plans.plan import median

    random.seed(8)
    many = [random.gauss(0, 1) for _ in range(20_001)]
    for values in (many, [round(v, 1) for v in many], many[:9000] + [0.25] * 11_000, [1.0, 2.0] * 5000, [3.0] * 4000, [-1.0, 7.0], [float(v) for v in range(1000)]):
        df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
        for sketched, most in ((50, 40), (1000, 200), (10_000, 100_000)):
            assert median(df, sketched, most).first().value == pytest.approx(statistics.median(values)), (sketched, most)
    ordered = median(spark.createDataFrame([(v,) for v in many], "x double"), 200, 300)
    import re

    bounds = re.search(r"x#\d+ >= ([-0-9.E]+)\).*?x#\d+ <= ([-0-9.E]+)\)", ordered._jdf.queryExecution().optimizedPlan().toString())
    assert sum(float(bounds[1]) <= v <= float(bounds[2]) for v in many) <= 330  # what one task sorts


def test_numbered_rows(spark):
    from sparkqa.sources.catalog import with_lineage

    df = spark.range(0, 5000, 1, 7).selectExpr("id", "id % 10 as v")
    assert [r["__row_number"] for r in with_lineage(df, "a.csv").orderBy("id").collect()] == list(range(1, 5001))
    got = with_lineage(df, "a.csv", order="v").orderBy("__row_number").collect()
    assert [r["__row_number"] for r in got] == list(range(1, 5001)) and [r.v for r in got] == sorted(r.v for r in got)
    assert with_lineage(df.limit(0), "a.csv").count() == 0
