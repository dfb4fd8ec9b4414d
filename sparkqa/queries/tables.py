"""Table catalog: ids, headers, lineage, storing, replacing, profiles, linking of values."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkqa.functions import scalar as S
from sparkqa.operators import linking
from sparkqa.queries.plans import NORM, table
from sparkqa.sources import catalog as C
from sparkqa.sources.directory import read_directory
from sparkqa.sources.documents import DocumentStore
from sparkqa.sources.store import new_path

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def shared(spark, what: str) -> str:
    """A new path in the cluster's shared folder."""
    return new_path(spark, what)


@query("a1_csv_round_trip", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def a1_csv_round_trip(spark, sf_dir):
    path = shared(spark, "csv")
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias(" c_mktsegment ")).write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return C.read_csv(spark, path).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("a2_sheets", "SELECT 'uploaded_orders_book_xlsx__sheet_' || lower(replace(o_orderpriority, '-', '_')).replace(' ', '').regexp_replace('[^a-z0-9]+', '_', 'g') AS table_id, count(*) AS n FROM orders GROUP BY 1")
def a2_sheets(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumns({"document": F.lit("Orders Book.xlsx"), "sheet": F.replace("o_orderpriority", F.lit(" "), F.lit(""))})
    return C.split_sheets(rows).groupBy(F.col("__table_id").alias("table_id")).agg(F.count("*").alias("n"))


@query("a3_sync_directory", "SELECT n_name, n_regionkey FROM nation")
def a3_sync_directory(spark, sf_dir):
    path = shared(spark, "dir")
    table(spark, sf_dir, "nation").select("n_name", "n_regionkey").repartition(3).write.option("header", True).csv(path)
    return C.sync_directory(spark, path, "n_name string, n_regionkey int").select("n_name", "n_regionkey")


@query("a3_unlike_files", """
SELECT 'customer' AS kind, c_custkey AS key, c_name AS name, c_nationkey AS nation FROM customer WHERE c_custkey % 5 <> 0
UNION ALL SELECT 'refused', c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT 'supplier', s_suppkey, s_name, s_nationkey FROM supplier UNION ALL SELECT 'part', p_partkey, p_name, NULL FROM part""")
def a3_unlike_files(spark, sf_dir):
    """Three kinds of files under one folder, with other columns in other orders; every fifth customer's line has a cell too
    many, which refuses that line alone."""
    path = shared(spark, "unlike")
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_nationkey").cast("string"), F.when(F.col("c_custkey") % 5 == 0, F.lit("more")))
    table(spark, sf_dir, "customer").select(line.alias("key,name,nation")).write.option("header", True).option("sep", ";").csv(f"{path}/customer")
    table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS nation", "s_suppkey AS key", "s_name AS name").write.option("header", True).csv(f"{path}/supplier")
    table(spark, sf_dir, "part").selectExpr("p_name AS name", "p_partkey AS key").write.option("header", True).csv(f"{path}/part")
    found = read_directory(spark, path)
    kinds = {"key": "customer", "nation": "supplier", "name": "part"}
    nation = lambda t: (F.col("nation") if "nation" in t.columns else F.lit(None)).cast("long").alias("nation")
    kept = [t.select(F.lit(kinds[t.columns[0]]).alias("kind"), F.col("key").cast("long").alias("key"), "name", nation(t)) for t in found.tables]
    cells = F.split("line", ",")
    kept.append(found.refused.select(F.lit("refused").alias("kind"), cells[0].cast("long").alias("key"), cells[1].alias("name"), cells[2].cast("long").alias("nation")))
    return C.append_tables(kept)


@query("a4_store_and_load", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def a4_store_and_load(spark, sf_dir):
    path = shared(spark, "store")
    rows = table(spark, sf_dir, "orders").withColumn("__table_id", C.table_id(F.lit("uploaded_orders"), F.col("o_orderstatus")))
    C.store_tables(rows, path)
    return C.load_table(spark, path, "uploaded_orders__sheet_f").select("o_orderkey", "o_totalprice")


@query("a4_store_json", "SELECT n_name, strftime(TIMESTAMP '2024-01-01' + to_days(n_nationkey), '%Y-%m-%dT%H:%M:%S.000Z') AS at FROM nation WHERE n_regionkey = 2")
def a4_store_json(spark, sf_dir):
    path = shared(spark, "json")
    at = F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval(F.col("n_nationkey"))
    rows = table(spark, sf_dir, "nation").select("n_name", at.alias("at"), F.concat(F.lit("region_"), F.col("n_regionkey").cast("string")).alias("__table_id"))
    C.store_tables(rows, path, "json")
    return C.load_table(spark, path, "region_2", "json", "n_name string, at string, __table_id string").select("n_name", "at")


@query("a5_replace_documents", "SELECT l_orderkey % 7 AS doc, count(*) FILTER (l_linenumber > 0) AS n, sum(CASE WHEN l_orderkey % 7 < 2 THEN 2 ELSE 1 END) AS versions FROM lineitem GROUP BY 1")
def a5_replace_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 7).alias("doc"), F.lit(1).alias("version"))
    new = rows.where("doc < 2").withColumn("version", F.lit(2))
    return C.replace_documents(rows, new, "doc").groupBy("doc").agg(F.count("*").alias("n"), F.sum("version").alias("versions"))


@query("a6_clear_report", "SELECT l_returnflag AS __document_id, count(*) AS removed FROM lineitem GROUP BY 1")
def a6_clear_report(spark, sf_dir):
    return C.clear_report(table(spark, sf_dir, "lineitem").withColumn("__document_id", F.col("l_returnflag")))


@query("a5_store_replace", """
SELECT 'order ' || (l_orderkey % 7) AS doc, count(*) FILTER (l_orderkey % 7 >= 2 OR l_linenumber <= 2) AS n, sum(CASE WHEN l_orderkey % 7 >= 2 THEN l_quantity WHEN l_linenumber <= 2 THEN -1 ELSE 0 END) AS quantity FROM lineitem WHERE l_orderkey % 7 <> 6 GROUP BY 1""")
def a5_store_replace(spark, sf_dir):
    """Seven documents stored, two replaced by fewer rows and one deleted, on disk."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("order "), F.col("l_orderkey") % 7).alias("__document_id"), "l_linenumber", F.col("l_quantity").cast("double").alias("quantity"))
    store = DocumentStore(spark, shared(spark, "documents"))
    store.put(rows)
    store.put(rows.where("__document_id IN ('order 0', 'order 1') AND l_linenumber <= 2").withColumn("quantity", F.lit(-1.0)))
    store.delete(["order 6"])
    return store.read().groupBy(F.col("__document_id").alias("doc")).agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))


@query("a6_store_clear", "SELECT l_returnflag AS doc, count(*) AS removed, 0 AS left FROM lineitem GROUP BY 1")
def a6_store_clear(spark, sf_dir):
    """A store cleared on disk: what was removed per document, and that nothing is left."""
    store = DocumentStore(spark, shared(spark, "documents"))
    store.put(table(spark, sf_dir, "lineitem").withColumn("__document_id", F.col("l_returnflag")))
    removed = store.clear()
    return removed.select(F.col("__document_id").alias("doc"), "removed", F.lit(0 if store.read() is None else 1).alias("left"))


@query("a7_upload_gate", """
WITH f AS (SELECT p_partkey, p_name || ['.csv', '.XLSX', '.exe', '.pdf'][1 + p_partkey % 4] AS name, CAST(p_retailprice * 8000 AS BIGINT) AS length FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 4 = 2 THEN 'extension' WHEN length > 10485760 THEN 'size' END AS reason, NOT (p_partkey % 4 = 2 OR length > 10485760) AS accepted FROM f""")
def a7_upload_gate(spark, sf_dir):
    ending = F.element_at(F.array(F.lit(".csv"), F.lit(".XLSX"), F.lit(".exe"), F.lit(".pdf")), (F.col("p_partkey") % 4 + 1).cast("int"))
    files = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", ending).alias("name"), F.round(F.col("p_retailprice") * 8000).cast("long").alias("length"))
    return C.gate_uploads(files).select("p_partkey", "reason", "accepted")


@query("b1_clean_headers", "SELECT c_custkey AS \"Revenue\", c_name AS revenue_2, c_nationkey AS \"Unnamed\", c_mktsegment AS \"Unnamed_2\" FROM customer")
def b1_clean_headers(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return rows.toDF(*C.clean_headers([" Revenue ", "revenue", "", ""]))


@query("b2_ids", r"""
SELECT p_partkey, 'uploaded_' || replace(trim(regexp_replace(lower(p_name || ' (v' || p_size || ').csv'), '[^a-z0-9.]+', '_', 'g'), '_'), '.', '_') AS document_id,
       'uploaded_' || replace(trim(regexp_replace(lower(p_name || ' (v' || p_size || ').csv'), '[^a-z0-9.]+', '_', 'g'), '_'), '.', '_') || '__sheet_' || trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS table_id FROM part""")
def b2_ids(spark, sf_dir):
    document = S.document_id(F.concat("p_name", F.lit(" (v"), F.col("p_size").cast("string"), F.lit(").csv")))
    return table(spark, sf_dir, "part").select("p_partkey", document.alias("document_id"), S.table_id(document, F.col("p_brand")).alias("table_id"))


@query("b3_lineage", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS __row_number, 'uploaded_orders_csv' AS __table_id FROM orders")
def b3_lineage(spark, sf_dir):
    return C.with_lineage(table(spark, sf_dir, "orders"), "orders.csv", order="o_orderkey").select("o_orderkey", "__row_number", "__table_id")


@query("b3_file_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS __row_number FROM orders WHERE o_orderkey % 3 <> 0")
def b3_file_order(spark, sf_dir):
    """Orders in several files, each sorted and one after the other in the order of their names: numbers follow the files."""
    path = shared(spark, "ordered")
    table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").where("o_orderkey % 3 <> 0").repartitionByRange(5, "o_orderkey").sortWithinPartitions("o_orderkey").write.option("header", True).csv(path)
    rows = spark.read.option("header", True).schema("o_orderkey long, o_totalprice double").csv(path)
    return C.with_lineage(rows, "orders.csv").select("o_orderkey", "__row_number")


PROFILE_SQL = """
SELECT '{c}' AS "column", count(*) AS row_count, count({c}) AS non_null, count(DISTINCT {c}) AS distinct_count, round(min({n}), 4) AS min, round(max({n}), 4) AS max, round(avg({n}), 4) AS mean,
       '{semantic}' AS semantic_type, '{role}' AS role FROM {t}"""


def _profile_sql(name: str, columns: dict[str, tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(PROFILE_SQL.format(c=c, n=f"CAST({c} AS DOUBLE)" if x == "x" else "CAST(NULL AS DOUBLE)", semantic=s, role=r, t=name) for c, (x, s, r) in columns.items())


@query("f1_profile_orders", _profile_sql("orders", {
    "o_orderkey": ("x", "identifier", "identifier"), "o_custkey": ("x", "integer", "measure"), "o_orderstatus": ("", "categorical", "dimension"),
    "o_totalprice": ("x", "numeric", "measure"), "o_orderdate": ("", "datetime", "time"), "o_orderpriority": ("", "categorical", "dimension")}))
def f1_profile_orders(spark, sf_dir):
    out = C.profile(table(spark, sf_dir, "orders"))
    return out.select("column", "row_count", "non_null", "distinct_count", F.round("min", 4).alias("min"), F.round("max", 4).alias("max"), F.round("mean", 4).alias("mean"), "semantic_type", "role")


@query("f3_parse_ratios", """
SELECT 'mixed' AS "column", round(avg(CASE WHEN p_partkey % 3 = 0 THEN 1.0 ELSE 0 END), 6) AS numeric_ratio, round(avg(CASE WHEN p_partkey % 3 = 1 THEN 1.0 ELSE 0 END), 6) AS date_ratio, count(*) = 0 AS nullable FROM part
UNION ALL SELECT 'flag', 0.0, 0.0, true""")
def f3_parse_ratios(spark, sf_dir):
    mixed = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("string")).when(F.col("p_partkey") % 3 == 1, F.lit("2024-05-01")).otherwise(F.col("p_name"))
    rows = table(spark, sf_dir, "part").select(mixed.alias("mixed"), F.when(F.col("p_partkey") % 2 == 0, "Yes").when(F.col("p_partkey") % 3 == 0, "no").alias("flag"))
    return C.profile(rows).select("column", F.round("numeric_ratio", 6).alias("numeric_ratio"), F.round("date_ratio", 6).alias("date_ratio"), "nullable")


@query("f4_catalog_types", """
SELECT * FROM (VALUES ('c_custkey', 'identifier', 'identifier'), ('c_name', 'text', 'text'), ('c_nationkey', 'integer', 'measure'), ('c_acctbal', 'numeric', 'measure'), ('c_mktsegment', 'categorical', 'dimension')) t("column", semantic_type, role)""")
def f4_catalog_types(spark, sf_dir):
    return C.profile(table(spark, sf_dir, "customer"), rules="catalog").select("column", "semantic_type", "role")


@query("f9_confidence_and_units", """
SELECT * FROM (VALUES ('Price (USD/t)', 'numeric', 1.0, 'USD/t'), ('Weight kg', 'integer', 1.0, 'kg'), ('Margin [%]', 'text', 0.8, '%'), ('Brand', 'categorical', 0.85, NULL)) t("column", semantic_type, confidence, unit)""")
def f9_confidence_and_units(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_retailprice").alias("Price (USD/t)"), F.col("p_size").alias("Weight kg"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("Margin [%]"), F.col("p_brand").alias("Brand"))
    return C.profile(rows).select("column", "semantic_type", "confidence", "unit")


@query("f10_sample_values", """
WITH v AS (SELECT 'p_brand' AS "column", p_brand AS value, min(p_partkey) AS first FROM part GROUP BY ALL UNION ALL SELECT 'p_type', p_type, min(p_partkey) FROM part GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY first, value) AS n FROM v)
SELECT "column", list(value ORDER BY n) AS samples FROM r WHERE n <= 5 GROUP BY 1""")
def f10_sample_values(spark, sf_dir):
    return C.sample_values(table(spark, sf_dir, "part"), "p_partkey", 5, ["p_brand", "p_type"])


@query("f10_catalog_samples", """
WITH v AS (SELECT 'o_clerk' AS "column", CAST(o_custkey AS VARCHAR) AS value, min(o_orderkey) AS first FROM orders GROUP BY ALL UNION ALL SELECT 'o_orderpriority', o_orderpriority, min(o_orderkey) FROM orders GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY first, value) AS n, count(*) OVER (PARTITION BY "column") AS every FROM v)
SELECT "column", count(*) AS n, sha256(string_agg(value, '|' ORDER BY n)) AS samples FROM r WHERE n <= CASE WHEN every <= 800 THEN 800 ELSE 80 END GROUP BY 1""")
def f10_catalog_samples(spark, sf_dir):
    """The catalog's form: up to 800 values where a column has no more, else the first 80."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("o_clerk"), "o_orderpriority")
    told = C.sample_values(rows, "o_orderkey", columns=["o_clerk", "o_orderpriority"], catalog=True)
    return told.select("column", F.size("samples").cast("long").alias("n"), F.sha2(F.array_join("samples", "|"), 256).alias("samples"))


@query("f11_column_indexes", """SELECT ['o_custkey', 'o_totalprice'] AS numeric_columns, ['o_orderstatus', 'o_orderpriority'] AS categorical_columns, ['o_orderkey'] AS identifier_columns, ['o_orderdate'] AS time_columns""")
def f11_column_indexes(spark, sf_dir):
    return C.column_indexes(C.profile(table(spark, sf_dir, "orders"))).select("numeric_columns", "categorical_columns", "identifier_columns", "time_columns")


@query("f12_catalog_row", "SELECT 'uploaded_orders' AS table_id, 'uploaded_orders' AS document_id, count(*) AS row_count, 6 AS column_count, '2024-01-01' AS indexed_at FROM orders")
def f12_catalog_row(spark, sf_dir):
    return C.catalog_row(table(spark, sf_dir, "orders"), "uploaded_orders", "uploaded_orders", F.lit("2024-01-01"))


@query("f13_newest_entries", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts) DESC, event_id DESC) = 1")
def f13_newest_entries(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.date_trunc("day", "ts").alias("indexed_at"))
    return C.newest_entries(rows, "user_id", "indexed_at", "event_id").select("user_id", "event_id")


@query("c11_usable_columns", """
SELECT * FROM (VALUES ('l_orderkey', true, false, false), ('l_quantity', true, false, false), ('l_returnflag', false, true, false), ('l_shipdate', false, false, true)) t("column", is_numeric, is_dimension, is_time)""")
def c11_usable_columns(spark, sf_dir):
    out = C.profile(table(spark, sf_dir, "lineitem"), columns=["l_orderkey", "l_quantity", "l_returnflag", "l_shipdate"])
    return out.select("column", C.usable_numeric().alias("is_numeric"), C.usable_dimension().alias("is_dimension"), C.usable_time().alias("is_time"))


@query("g6_value_dictionary", f"""
WITH v AS (SELECT DISTINCT 'c_mktsegment' AS "column", trim(c_mktsegment) AS value FROM customer UNION SELECT 'c_mktsegment', n_name FROM nation)
SELECT "column", {NORM.format("value")} AS norm, min(value) AS value FROM v GROUP BY ALL""")
def g6_value_dictionary(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.lit("c_mktsegment").alias("column"), F.col("n_name").alias("value"))
    return linking.value_dictionary(table(spark, sf_dir, "customer"), ["c_mktsegment"], names)


@query("g2_link_values")
def g2_link_values(spark, sf_dir):
    """Nation names with a letter dropped, linked to the dictionary of names (checked against plain Python in tests)."""
    nations = table(spark, sf_dir, "nation")
    phrases = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.substring("n_name", 1, 2), F.substring("n_name", 4, 40)).alias("phrase"))
    return linking.only_column(linking.link_values(phrases, linking.value_dictionary(nations, ["n_name"])))


@query("g4_link_columns")
def g4_link_columns(spark, sf_dir):
    """Loosely written column names linked to those of the profile (checked against plain Python in tests)."""
    columns = C.profile(table(spark, sf_dir, "orders")).select("column")
    words = F.explode(F.array(*[F.lit(w) for w in ("order total price", "orderdate", "o order prority", "xyzzy")]))
    return linking.link_columns(table(spark, sf_dir, "region").select(words.alias("phrase")), columns)


@query("g7_append_tables", "SELECT 'orders' AS source, o_orderkey AS key, o_totalprice AS price, CAST(NULL AS VARCHAR) AS name FROM orders UNION ALL SELECT 'part', p_partkey, NULL, p_name FROM part")
def g7_append_tables(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.lit("orders").alias("source"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"))
    b = table(spark, sf_dir, "part").select(F.lit("part").alias("source"), F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))
    return C.append_tables([a, b])


@query("f5_profiler_types", """
SELECT * FROM (VALUES ('c_custkey', 'identifier'), ('c_name', 'text'), ('c_nationkey', 'integer'), ('c_acctbal', 'numeric'), ('c_mktsegment', 'categorical')) t("column", semantic_type)""")
def f5_profiler_types(spark, sf_dir):
    return C.profile(table(spark, sf_dir, "customer"), rules="profiler").select("column", "semantic_type")


@query("f6_identifier_rules", """
WITH r AS (SELECT count(DISTINCT o_orderkey) / count(*)::DOUBLE AS a, count(DISTINCT o_custkey) / count(*)::DOUBLE AS b FROM orders)
SELECT 'order_total' AS "column", false AS catalog, a >= 0.995 AS profiler FROM r UNION ALL SELECT 'customer_no', true, b >= 0.995 FROM r UNION ALL SELECT 'account', b >= 0.98, true FROM r""")
def f6_identifier_rules(spark, sf_dir):
    """The two rule sets disagree by design: a measure's name vetoes in one, ``no`` and ``account`` count in one each."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_total"), F.col("o_custkey").alias("customer_no"), F.col("o_custkey").alias("account"))
    ratio = F.col("distinct_ratio")
    out = C.profile(rows)
    return out.select("column", C.is_identifier(F.col("column"), F.col("kind"), ratio, "catalog").alias("catalog"), C.is_identifier(F.col("column"), F.col("kind"), ratio, "profiler").alias("profiler"))


@query("f7_booleans", "SELECT 'done' AS \"column\", true AS booleans, 'boolean' AS semantic_type FROM orders HAVING count(*) > 0 UNION ALL SELECT 'status', false, 'categorical'")
def f7_booleans(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", " Yes").when(F.col("o_orderstatus") == "O", "no").alias("done"), F.col("o_orderstatus").alias("status"))
    return C.profile(rows).select("column", "booleans", "semantic_type")


@query("f8_roles", """
SELECT * FROM (VALUES ('p_partkey', 'identifier'), ('p_name', 'dimension'), ('p_brand', 'dimension'), ('p_type', 'dimension'), ('p_size', 'measure'), ('p_retailprice', 'measure'), ('remarks', 'text'), ('label', 'text')) t("column", role)""")
def f8_roles(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    rows = table(spark, sf_dir, "part").withColumns({"remarks": F.concat(F.lit("r "), key), "label": F.concat(F.lit("l "), key)})
    return C.profile(rows).select("column", "role")


@query("f1_profile_approx", "SELECT 'l_returnflag' AS \"column\", count(*) AS row_count, count(l_returnflag) AS non_null, count(DISTINCT l_returnflag) AS distinct_count FROM lineitem UNION ALL SELECT 'l_linestatus', count(*), count(l_linestatus), count(DISTINCT l_linestatus) FROM lineitem")
def f1_profile_approx(spark, sf_dir):
    return C.profile(table(spark, sf_dir, "lineitem"), approx=True, columns=["l_returnflag", "l_linestatus"]).select("column", "row_count", "non_null", "distinct_count")


@query("e4_fuzzy_contained", f"""
WITH p AS (SELECT p_partkey, {NORM.format("p_name")} AS q, {NORM.format("p_name || CASE p_partkey % 2 WHEN 0 THEN '' ELSE ' ' || p_type END")} AS c FROM part)
SELECT p_partkey, round(CASE WHEN q = c THEN 1.0 ELSE 0.82 + 0.18 * length(q) / length(c) END, 6) AS score FROM p""")
def e4_fuzzy_contained(spark, sf_dir):
    """Equal and contained names (the sequence ratio is tested against plain Python)."""
    other = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat("p_name", F.lit(" "), "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(linking.fuzzy_score(F.col("p_name"), other), 6).alias("score"))


@query("g3_only_column", f"""
WITH d AS (SELECT 'c_mktsegment' AS "column", c_mktsegment AS value FROM customer UNION SELECT 'other', nullif(c_mktsegment, 'BUILDING') FROM customer), n AS (SELECT DISTINCT "column", value FROM d WHERE value IS NOT NULL)
SELECT value AS phrase, max("column") AS "column" FROM n GROUP BY 1 HAVING count(*) = 1""")
def g3_only_column(spark, sf_dir):
    """Values that two columns have are refused; the one that only one has is linked."""
    rows = table(spark, sf_dir, "customer").withColumn("other", F.nullif("c_mktsegment", F.lit("BUILDING")))
    values = linking.value_dictionary(rows, ["c_mktsegment", "other"])
    links = linking.link_values(rows.select(F.col("c_mktsegment").alias("phrase")), values, near_miss=False)
    return linking.only_column(links.where("score = 1")).select("phrase", "column")
