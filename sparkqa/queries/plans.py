"""Plan operations (filters, aggregations, grouping, ranking) and calculations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkqa.functions import scalar as S
from sparkqa.plans.plan import Filter, Plan, filter_trace, predicate, refusals, run_plan, sample_sources, select_tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def planned(name: str, source: str, plan: Plan, sql: str, digits: int | None = 4) -> None:
    """Registers a plan's result; double columns are rounded, as sums depend on their order."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = run_plan(table(spark, sf_dir, source), plan)
        return out.select(*[F.round(c, digits).alias(c) if kind == "double" and c in ("value", "first", "second", "difference", "min", "max") else F.col(c) for c, kind in out.dtypes])

    QUERIES[name], SQL[name] = run, sql


NORM = "trim(regexp_replace(replace(replace(lower({0}), 'ß', 'ss'), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"

flagship = Plan("top_n", target="o_totalprice", group_by=("o_orderpriority",), filters=(Filter("o_orderstatus", "eq", "f"),), limit=5)
planned("d10_top_groups", "orders", flagship, """
SELECT o_orderpriority, round(sum(o_totalprice), 4) AS value FROM orders WHERE lower(o_orderstatus) = 'f'
GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 NULLS LAST LIMIT 5""")
planned("d10_bottom_groups", "orders", Plan("bottom_n", target="o_totalprice", group_by=("o_custkey",), limit=7), """
SELECT o_custkey, round(sum(o_totalprice), 4) AS value FROM orders GROUP BY 1 ORDER BY sum(o_totalprice), 1 LIMIT 7""")
planned("c1_eq_filter_count", "customer", Plan("count", filters=(Filter("c_mktsegment", "eq", " Building "),)), """
SELECT count(*) AS value FROM customer WHERE lower(c_mktsegment) = 'building'""")
planned("c4_numeric_filters", "lineitem", Plan("count", filters=(Filter("l_quantity", "gte", 10), Filter("l_quantity", "lt", "40"), Filter("l_discount", "gt", 0.03), Filter("l_tax", "lte", 0.06))), """
SELECT count(*) AS value FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 40 AND l_discount > 0.03 AND l_tax <= 0.06""")
planned("c3_contains_sum", "part", Plan("sum", target="p_retailprice", filters=(Filter("p_name", "contains", "a"), Filter("p_brand", "ne", "Brand#12"))), f"""
SELECT round(sum(p_retailprice), 4) AS value FROM part WHERE contains({NORM.format('p_name')}, 'a') AND {NORM.format('p_brand')} <> 'brand 12'""")
for op, expr in {"sum": "sum(l_extendedprice)", "avg": "avg(l_extendedprice)", "min": "min(l_extendedprice)", "max": "max(l_extendedprice)", "median": "median(l_extendedprice)", "std": "stddev_samp(l_extendedprice)", "variance": "var_samp(l_extendedprice)"}.items():
    digits = 2 if op == "variance" else 4
    planned(f"d2_{op}", "lineitem", Plan(op, target="l_extendedprice", filters=(Filter("l_returnflag", "eq", "R"),)), f"SELECT round({expr}, {digits}) AS value FROM lineitem WHERE l_returnflag = 'R'", digits)
planned("d5_distinct_count", "lineitem", Plan("distinct_count", target="l_suppkey"), "SELECT count(DISTINCT l_suppkey) AS value FROM lineitem")
planned("d6_correlation", "lineitem", Plan("correlation", targets=("l_quantity", "l_extendedprice")), "SELECT round(corr(l_quantity, l_extendedprice), 6) AS value FROM lineitem", 6)
planned("d7_group_count", "lineitem", Plan("group_count", group_by=("l_returnflag", "l_linestatus")), "SELECT l_returnflag, l_linestatus, count(*) AS value FROM lineitem GROUP BY ALL")
planned("d8_group_sum", "lineitem", Plan("group_sum", target="l_quantity", group_by=("l_linestatus",)), "SELECT l_linestatus, round(sum(l_quantity), 4) AS value FROM lineitem GROUP BY ALL")
for op in ("avg", "min", "max"):
    planned(f"d9_group_{op}", "orders", Plan(f"group_{op}", target="o_totalprice", group_by=("o_orderpriority", "o_orderstatus")), f"SELECT o_orderpriority, o_orderstatus, round({op}(o_totalprice), 4) AS value FROM orders GROUP BY ALL")
planned("d12_percentage", "orders", Plan("percentage", target="o_totalprice", filters=(Filter("o_orderstatus", "eq", "O"),)), "SELECT round(sum(o_totalprice) FILTER (o_orderstatus = 'O') / sum(o_totalprice) * 100, 4) AS value FROM orders")
planned("d13_ratio", "lineitem", Plan("ratio", targets=("l_extendedprice", "l_discount")), "SELECT round(avg(l_extendedprice / nullif(l_discount, 0)), 4) AS value FROM lineitem")
planned("d14_compare_two", "lineitem", Plan("compare", targets=("l_extendedprice", "l_quantity")), "SELECT round(sum(l_extendedprice), 2) AS first, round(sum(l_quantity), 2) AS second, round(sum(l_extendedprice) - sum(l_quantity), 2) AS difference FROM lineitem", 2)
planned("d15_compare_one", "orders", Plan("compare", target="o_totalprice"), "SELECT round(min(o_totalprice), 4) AS min, round(max(o_totalprice), 4) AS max, round(max(o_totalprice) - min(o_totalprice), 4) AS difference FROM orders")
planned("d16_trend", "orders", Plan("trend", target="o_totalprice", time="o_orderdate"), "SELECT strftime(o_orderdate, '%Y-%m-%d') AS period, round(sum(o_totalprice), 4) AS value FROM orders GROUP BY o_orderdate")
planned("d16_trend_month", "orders", Plan("trend", target="o_totalprice", time="o_orderdate", grain="month"), "SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS period, round(sum(o_totalprice), 3) AS value FROM orders GROUP BY 1", 3)


def numbered(df: DataFrame, key: str) -> DataFrame:
    """``__row_number`` by a key that is unique: here a stand-in for the order in a file."""
    return df.withColumn("__row_number", F.col(key))


@query("d11_top_rows", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def d11_top_rows(spark, sf_dir):
    return run_plan(numbered(table(spark, sf_dir, "orders"), "o_orderkey"), Plan("top_n", target="o_totalprice", limit=10))


@query("c6_filter_trace", """
SELECT 1 AS step, 'l_returnflag' AS "column", 'eq' AS op, 'r' AS value, count(*) FILTER (l_returnflag = 'R') AS rows_after FROM lineitem
UNION ALL SELECT 2, 'l_quantity', 'gt', '25', count(*) FILTER (l_returnflag = 'R' AND l_quantity > 25) FROM lineitem
UNION ALL SELECT 3, 'l_linestatus', 'ne', 'O', count(*) FILTER (l_returnflag = 'R' AND l_quantity > 25 AND l_linestatus <> 'O') FROM lineitem""")
def c6_filter_trace(spark, sf_dir):
    return filter_trace(table(spark, sf_dir, "lineitem"), [Filter("l_returnflag", "eq", "r"), Filter("l_quantity", "gt", 25), Filter("l_linestatus", "ne", "O")])


@query("c2_ne_passes_nulls", "SELECT count(*) AS value FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS DISTINCT FROM 'MACHINERY'")
def c2_ne_passes_nulls(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return run_plan(rows, Plan("count", filters=(Filter("c_mktsegment", "ne", "machinery"),)))


@query("d8_null_group", "SELECT nullif(o_orderstatus, 'P') AS o_orderstatus, round(sum(nullif(o_totalprice, 0)), 4) AS value FROM orders GROUP BY 1")
def d8_null_group(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    return run_plan(rows, Plan("group_sum", target="o_totalprice", group_by=("o_orderstatus",))).withColumn("value", F.round("value", 4))


@query("b9_sample_sources", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer ORDER BY customer.c_custkey LIMIT 5")
def b9_sample_sources(spark, sf_dir):
    return sample_sources(numbered(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "c_custkey"))


@query("c9_select_tables", "SELECT 'orders' AS table_id")
def c9_select_tables(spark, sf_dir):
    from sparkqa.sources.catalog import catalog_of

    tables = {n: table(spark, sf_dir, n) for n in ("orders", "customer", "lineitem")}
    return select_tables(["o_totalprice", "o_orderdate"], catalog_of(tables)).select("table_id")


@query("e6_calculations", """
SELECT p_partkey, round((p_retailprice - p_size) / nullif(p_size, 0) * 100, 4) AS change, round(p_retailprice - p_size, 4) AS diff,
       round(p_retailprice / nullif(p_size - 1, 0), 4) AS ratio, round((p_retailprice + p_size + 1) / 3, 4) AS mean, round(p_size / nullif(p_retailprice, 0) * 100, 4) AS margin FROM part""")
def e6_calculations(spark, sf_dir):
    a, b = F.col("p_size").cast("double"), F.col("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(S.percentage_change(a, b), 4).alias("change"), F.round(S.difference(b, a), 4).alias("diff"), F.round(S.ratio(b, a - 1), 4).alias("ratio"), F.round(S.average(F.array(a, b, F.lit(1.0))), 4).alias("mean"), F.round(S.margin(a, b), 4).alias("margin"))


@query("e7_verify_calculation", """
WITH t AS (SELECT l_orderkey, l_linenumber, ['percentage_change','difference','ratio','margin','power'][1 + l_orderkey % 5] AS op, l_quantity AS a, l_extendedprice AS b,
                  CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END AS wrong FROM lineitem),
x AS (SELECT *, CASE op WHEN 'percentage_change' THEN (b - a) / nullif(a, 0) * 100 WHEN 'difference' THEN a - b WHEN 'ratio' THEN a / nullif(b, 0) WHEN 'margin' THEN a / nullif(b, 0) * 100 END AS e FROM t)
SELECT op, count(*) FILTER (e IS NOT NULL AND wrong = 0) AS verified, count(*) AS n FROM x GROUP BY 1""")
def e7_verify_calculation(spark, sf_dir):
    op = F.element_at(F.array(*[F.lit(x) for x in ("percentage_change", "difference", "ratio", "margin", "power")]), (F.col("l_orderkey") % 5 + 1).cast("int"))
    a, b = F.col("l_quantity").cast("double"), F.col("l_extendedprice")
    right = F.when(op == "percentage_change", S.percentage_change(a, b)).when(op == "difference", a - b).when(op == "ratio", S.ratio(a, b)).otherwise(S.margin(a, b))
    stored = right + F.when(F.col("l_linenumber") % 2 == 0, 1.0).otherwise(0.0)
    return table(spark, sf_dir, "lineitem").select(op.alias("op"), S.verify_calculation(op, a, b, stored).alias("ok")).groupBy("op").agg(F.count_if("ok").alias("verified"), F.count("*").alias("n"))


@query("e8_explicit_percentage", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN round((round(o_totalprice + 7, 0) - round(o_totalprice, 0)) / nullif(round(o_totalprice, 0), 0) * 100, 6) END AS change FROM orders""")
def e8_explicit_percentage(spark, sf_dir):
    whole = lambda c: F.round(c, 0).cast("long").cast("string")
    words = F.element_at(F.array(F.lit("went"), F.lit("growth"), F.lit("increase")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    text = F.concat(F.lit("The "), words, F.lit(" from "), whole(F.col("o_totalprice")), F.lit(" to "), whole(F.col("o_totalprice") + 7))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.explicit_percentage(text).alias("change"))


@query("e1_normalize", f"""SELECT doc_id, {NORM.format("substr(text, 1, 0) || text")} AS norm FROM documents""")
def e1_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.normalize_text(F.col("text")).alias("norm"))


@query("e2_number_coercion", """
SELECT p_size, count(try_cast(p_size || CASE p_partkey % 4 WHEN 0 THEN '.5' WHEN 1 THEN 'd' WHEN 2 THEN '' ELSE 'e1' END AS DOUBLE)) AS n,
       sum(try_cast(p_size || CASE p_partkey % 4 WHEN 0 THEN '.5' WHEN 1 THEN 'd' WHEN 2 THEN '' ELSE 'e1' END AS DOUBLE)) AS total FROM part GROUP BY 1""")
def e2_number_coercion(spark, sf_dir):
    tail = F.element_at(F.array(F.lit(".5"), F.lit("d"), F.lit(""), F.lit("e1")), (F.col("p_partkey") % 4 + 1).cast("int"))
    x = S.to_number(F.concat(F.col("p_size").cast("string"), tail))
    return table(spark, sf_dir, "part").groupBy("p_size").agg(F.count(x).alias("n"), F.sum(x).alias("total"))


@query("e3_date_coercion", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE strftime(date_trunc('day', o_orderdate), '%Y-%m-%d') END AS day FROM orders""")
def e3_date_coercion(spark, sf_dir):
    forms = F.array(*[F.date_format("o_orderdate", f) for f in ("yyyy-MM-dd", "MM/dd/yyyy", "dd.MM.yyyy")], F.col("o_orderkey").cast("string"))
    text = F.element_at(forms, (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(S.to_date(text), "yyyy-MM-dd").alias("day"))


@query("e12_format_number", """
SELECT o_orderkey, regexp_replace(regexp_replace(format('{:,.4f}', o_totalprice), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') AS shown FROM orders""")
def e12_format_number(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.format_number(F.col("o_totalprice")).alias("shown"))


@query("e13_table_rows", "SELECT concat_ws(' | ', CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR)) AS line FROM nation")
def e13_table_rows(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(S.table_row(["n_nationkey", "n_name", "n_regionkey"]).alias("line"))


@query("d18_clean_numbers", "SELECT l_linestatus, count(*) FILTER (l_discount > 0 AND l_tax > 0) AS clean FROM lineitem GROUP BY 1")
def d18_clean_numbers(spark, sf_dir):
    x = F.when(F.col("l_discount") <= 0, F.lit(float("nan"))).when(F.col("l_tax") <= 0, F.lit(float("inf"))).otherwise(F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.count(S.clean_number(x)).alias("clean"))


@query("g8_distinct_filters", """
WITH f AS (SELECT c_custkey, c_mktsegment AS col, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE lower(c_name) END AS value FROM customer UNION ALL SELECT c_custkey + 1000000, c_mktsegment, lower(c_name) FROM customer)
SELECT c_custkey, col, value FROM f QUALIFY row_number() OVER (PARTITION BY col, lower(value) ORDER BY c_custkey) = 1""")
def g8_distinct_filters(spark, sf_dir):
    from sparkqa.operators.linking import first_filters

    base = table(spark, sf_dir, "customer")
    mine = base.select("c_custkey", F.col("c_mktsegment").alias("col"), F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name")).otherwise(F.lower("c_name")).alias("value"))
    rows = mine.unionByName(base.select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.col("c_mktsegment").alias("col"), F.lower("c_name").alias("value")))
    return first_filters(rows, ["col"], "value", "c_custkey")


@query("c5_filters_in_order", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45 AND l_discount <= 0.02")
def c5_filters_in_order(spark, sf_dir):
    from sparkqa.plans.plan import apply_filters

    return apply_filters(table(spark, sf_dir, "lineitem"), [Filter("l_returnflag", "eq", "a"), Filter("l_quantity", "gt", "45"), Filter("l_discount", "lte", 0.02)]).select("l_orderkey", "l_linenumber")


@query("d17_run_plan_strict", "SELECT round(avg(l_extendedprice), 4) AS value FROM lineitem WHERE l_linestatus = 'O'")
def d17_run_plan_strict(spark, sf_dir):
    out = run_plan(table(spark, sf_dir, "lineitem"), Plan("avg", target="l_extendedprice", filters=(Filter("l_linestatus", "eq", "o"),)), strict=True)
    return out.select(F.round("value", 4).alias("value"))


__all__ = ["QUERIES", "SQL", "flagship", "numbered", "planned", "predicate", "query", "table"]


#: Plans over orders that must be refused, and some that must not: unknown columns and filters (c7), targets without a
#: number (c8), rules of operations (c10).
PLANS = {
    "c7 unknown column": Plan("count", filters=(Filter("o_colour", "eq", "red"),)),
    "c7 unknown filter": Plan("count", filters=(Filter("o_orderstatus", "like", "F"),)),
    "c7 no number": Plan("count", filters=(Filter("o_totalprice", "gt", "many"),)),
    "c7 fits": Plan("count", filters=(Filter("o_orderstatus", "eq", "f"), Filter("o_totalprice", "gte", "100,000"))),
    "c8 no number in target": Plan("sum", target="o_orderpriority"),
    "c8 none after filters": Plan("sum", target="o_totalprice", filters=(Filter("o_orderkey", "lt", 0),)),
    "c8 fits": Plan("avg", target="o_totalprice", filters=(Filter("o_orderkey", "gt", 10.5),)),
    "c10 unknown operation": Plan("mode", target="o_totalprice"),
    "c10 no target": Plan("sum"),
    "c10 one column for a correlation": Plan("correlation", targets=("o_totalprice",)),
    "c10 no group": Plan("group_sum", target="o_totalprice"),
    "c10 limit": Plan("top_n", target="o_totalprice", limit=1001),
    "c10 no time": Plan("trend", target="o_totalprice"),
    "c10 fits": Plan("group_sum", target="o_totalprice", group_by=("o_orderpriority",)),
}
_ROWS = {"c7 fits": "count(*) FILTER (lower(o_orderstatus) = 'f' AND o_totalprice >= 100000)", "c8 fits": "count(*) FILTER (o_orderkey > 10.5)", "c10 fits": "count(*)"}


def _refused(part: str) -> str:
    return " UNION ALL ".join(f"SELECT '{p}' AS plan, {str(p in _ROWS).lower()} AS accepted, {_ROWS.get(p, 'CAST(NULL AS BIGINT)')} AS rows FROM orders" for p in PLANS if p.startswith(part + " ")).replace("CAST(NULL AS BIGINT) AS rows FROM orders", "CAST(NULL AS BIGINT) AS rows")


def _told(part: str):
    def run(spark, sf_dir):
        return refusals(table(spark, sf_dir, "orders"), {n: p for n, p in PLANS.items() if n.startswith(part + " ")}).select("plan", "accepted", "rows")

    return run


for _name, _part in (("c7_refused_filters", "c7"), ("c8_refused_targets", "c8"), ("c10_refused_plans", "c10")):
    query(_name, _refused(_part))(_told(_part))
