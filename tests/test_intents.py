"""Intents of questions: class, confidence, limits and all matches, by an expected table and against SQL."""

import pytest
from oracle import same
from pyspark.sql import functions as F

from sparkqa.operators import questions
from sparkqa.operators.questions import intent_of
from sparkqa.queries import conversations

#: question: intent, operation, confidence, top, grouped, ranked, temporal, families that match
EXPECTED = {
    "": ("unknown", None, 0.0, None, False, False, False, []),
    "Summarize the latest demand commentary": ("semantic", None, 0.8, None, False, False, False, []),
    "What is the revenue by region": ("structured", None, 0.55, None, True, False, False, []),
    "revenue by region": ("semantic", None, 0.8, None, False, False, False, []),
    "Sum of revenue": ("structured", "sum", 0.97, None, False, False, False, ["sum"]),
    "How many unique products": ("structured", "distinct_count", 0.98, None, False, False, False, ["count", "distinct_count"]),
    "highest revenue": ("structured", "top_n", 0.96, 5, False, True, False, ["max"]),
    "bottom three by total sales": ("structured", "bottom_n", 0.96, 3, False, True, False, ["sum"]),
    "top 2000 by total": ("structured", "top_n", 0.96, 5, False, True, False, ["sum"]),
    "average price by month": ("structured", "group_avg", 0.96, None, True, False, True, ["avg"]),
    "median salary after 2020": ("structured", "median", 0.98, None, False, False, True, ["median"]),
    "relationship of top price and cost": ("structured", "correlation", 0.98, None, False, False, False, ["correlation"]),
    "percentage of orders": ("structured", "percentage", 0.97, None, False, False, False, ["percentage"]),
    "sales trend": ("structured", "trend", 0.96, None, False, False, True, ["trend"]),
    "cost versus price": ("structured", "compare", 0.95, None, False, False, False, ["compare"]),
    "least cost": ("structured", "min", 0.96, None, False, False, False, ["min"]),
    "ratio of cost": ("structured", "ratio", 0.97, None, False, False, False, ["ratio"]),
}


def test_expected_intents(spark):
    rows = [(i, q) for i, q in enumerate(EXPECTED)] + [(99, None)]
    got = {r.id: r.x for r in spark.createDataFrame(rows, "id int, q string").select("id", intent_of(F.col("q")).alias("x")).collect()}
    for i, (question, want) in enumerate(EXPECTED.items()):
        x = got[i]
        assert (x.intent, x.operation, x.confidence, x.top, x.grouped, x.ranked, x.temporal, [m.operation for m in x.matches]) == want, question
    assert got[99].intent == "unknown" and got[5].matches[0].phrases == ["how many"] and got[5].matches[1].score == 0.98


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, sf):
    same(conversations.e16_intents(spark, f"/root/testdata/{sf}"), conversations.SQL["e16_intents"], f"/root/testdata/{sf}")


@pytest.mark.parametrize("name", ["e17_generated_limits", "e18_generated_comparisons"])
def test_generated_against_sql(spark, name):
    same(conversations.QUERIES[name](spark, "/root/testdata/sf0.01"), conversations.SQL[name], "/root/testdata/sf0.01")


def test_catalog_samples(spark):
    """800 different values are all kept; one more and only the first 80 are."""
    from sparkqa.queries import tables
    from sparkqa.sources.catalog import sample_values

    for n, want in ((800, 800), (801, 80)):
        df = spark.range(3 * n).selectExpr("id AS row", f"concat(' v', id % {n}, ' ') AS c")
        got = sample_values(df, "row", columns=["c"], catalog=True).first().samples
        assert got == [f"v{i}" for i in range(want)]
    for sf in ("sf0.001", "sf0.1"):
        same(tables.f10_catalog_samples(spark, f"/root/testdata/{sf}"), tables.SQL["f10_catalog_samples"], f"/root/testdata/{sf}")


def test_each_pattern_is_worked_out_once(spark):
    """As one expression, every pattern would be repeated in each branch that names what came of it."""
    plan = spark.range(1).select(questions.intent_of(F.col("id").cast("string")).alias("i"))._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= sum(plan.count(f"(?:{words})") for words in questions.OPERATIONS.values()) <= len(questions.OPERATIONS)
