"""Question labels and conversation state, on questions made of the tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from sparkqa.functions import scalar as S
from sparkqa.operators import conversation, linking, questions
from sparkqa.operators.filters import resolve_filters
from sparkqa.queries.plans import NORM, table
from sparkqa.queries.tables import shared
from sparkqa.streaming.logs import run_to_end

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


#: Forms of questions, filled with two years and a number from orders.
FORMS = [
    "What was the revenue growth from {a} to {b}?", "And growth in {b}?", "How many unique suppliers in {a}", "Top {n} products by sales", "top five regions by total profit",
    "average price by region", "compare milk production {a} versus {b}", "What was the growth?", "price above {n}.5 please", "list employees", "correlation between cost and margin", "percentage of income in {a}",
]


def asked(spark, sf_dir, *more):
    """(id, conv, turn, text) and more of the order's columns: a question per order."""
    o = table(spark, sf_dir, "orders")
    a, n = F.date_format("o_orderdate", "yyyy"), (F.col("o_custkey") % 40 + 1).cast("string")
    b = (F.year("o_orderdate") + 1).cast("string")
    form = F.element_at(F.array(*[F.lit(f) for f in FORMS]), (F.col("o_orderkey") % len(FORMS) + 1).cast("int"))
    text = F.replace(F.replace(F.replace(form, F.lit("{a}"), a), F.lit("{b}"), b), F.lit("{n}"), n)
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("conv_id"), F.col("o_orderkey").alias("turn"), text.alias("text"), *more)


_LIST = ", ".join("'" + f.replace("'", "''") + "'" for f in FORMS)
ASKED = f"""asked AS (SELECT o_orderkey AS id, o_custkey AS conv_id, o_orderkey AS turn, replace(replace(replace([{_LIST}][1 + o_orderkey % {len(FORMS)}], '{{a}}', strftime(o_orderdate, '%Y')), '{{b}}', CAST(year(o_orderdate) + 1 AS VARCHAR)), '{{n}}', CAST(o_custkey % 40 + 1 AS VARCHAR)) AS text FROM orders)"""
METRIC = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '\\b{a}\\b') THEN '{m}'" for a, m in questions.METRICS.items()) + " ELSE '' END"


@query("e14_metrics", f"WITH {ASKED} SELECT id, {METRIC} AS metric FROM asked")
def e14_metrics(spark, sf_dir):
    return asked(spark, sf_dir).select("id", questions.metric_of(F.col("text")).alias("metric"))


GROW = r"regexp_matches(lower(text), '\b(growth|increase|decrease|change|yoy|year over year|percent(age)?)\b')"
EXPLICIT = r"regexp_matches(lower(text), 'from\s+-?\d+(\.\d+)?\s+to\s+-?\d+(\.\d+)?')"


@query("e15_analysis", f"""WITH {ASKED}, y AS (SELECT *, {METRIC} AS metric, regexp_extract_all(text, '\\b((?:19|20)\\d{{2}})\\b', 1) AS years, {GROW} AS grows, {EXPLICIT} AS explicit FROM asked)
SELECT id, metric, coalesce(years[1], '') AS start_period, coalesce(years[2], '') AS end_period, grows OR explicit AS requires_calculation, regexp_matches(lower(text), '^(and|what about|how about|also|same for)\\b') AS is_follow_up,
       grows AND NOT explicit AND metric <> '' AND len(years) < 2 AS needs_period, grows AND NOT explicit AND metric = '' AS is_ambiguous FROM y""")
def e15_analysis(spark, sf_dir):
    told = questions.analysis(F.col("text"))
    return asked(spark, sf_dir).select("id", told.alias("t")).select("id", "t.metric", "t.start_period", "t.end_period", "t.requires_calculation", "t.is_follow_up", "t.needs_period", "t.is_ambiguous")


@query("e16_operations", f"""WITH {ASKED} SELECT id, [NULL, NULL, 'distinct_count', NULL, 'top_n', 'group_avg', 'compare', NULL, NULL, NULL, 'correlation', 'percentage'][1 + id % {len(FORMS)}] AS operation FROM asked""")
def e16_operations(spark, sf_dir):
    return asked(spark, sf_dir).select("id", questions.operation_of(F.col("text")).alias("operation"))


#: Parts of generated questions; an order's numbers pick one of each.
OPENERS = ["What is the", "Show the", "Tell me the", "", "Please give"]
ASKS = [
    "total", "average", "number of", "median", "highest", "lowest", "standard deviation of", "variance in", "correlation of", "percentage of", "ratio of", "unique", "how many unique", "trend in", "top 7", "bottom three", "comparison of",
    "total and average", "most", "revenue", "mean divided by count of", "rank of",
]
TAILS = ["sales", "sales by region", "orders per customer", "profit over time", "margin from 2020", "sales monthly by city", "cost versus price", "milk", "sales across stores between May and June"]


def _pick(parts: list[str], n):
    return F.element_at(F.array(*[F.lit(p) for p in parts]), (n % len(parts) + 1).cast("int"))


def generated(spark, sf_dir):
    """(id, text): questions put together from parts."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(key.alias("id"), F.trim(F.concat_ws(" ", _pick(OPENERS, cust + key), _pick(ASKS, key), _pick(TAILS, cust))).alias("text"))


def _part(parts: list[str], n: str) -> str:
    return f"[{', '.join(repr(p) for p in parts)}][1 + ({n}) % {len(parts)}]"


def _asks(op: str) -> str:
    return f"regexp_matches(t, '\\b(?:{questions.OPERATIONS[op]})\\b')"


_PICKED = " ".join(
    [f"WHEN {_asks(op)} THEN '{op}'" for op in ("correlation", "distinct_count", "percentage", "ratio", "compare", "trend")]
    + [f"WHEN ranks AND regexp_matches(t, '{questions.UPWARD_MORE}') THEN 'top_n' WHEN ranks AND regexp_matches(t, '{questions.DOWNWARD}') THEN 'bottom_n'"]
    + [f"WHEN {_asks(op)} THEN '{op}'" for op in ("median", "std", "variance", "count", "sum", "avg", "max", "min")]
)
_SURE = " ".join(f"WHEN '{op}' THEN {c}" for op, c in questions.CONFIDENCE.items())
_MATCHED = " || ".join(f"CASE WHEN {_asks(op)} THEN '{op}:' || array_to_string(list_sort(list_distinct(regexp_extract_all(t, '\\b(?:{words})\\b'))), '/') || ' ' ELSE '' END" for op, words in questions.OPERATIONS.items())


@query("e16_intents", f"""
WITH q AS (SELECT o_orderkey AS id, trim(array_to_string([{_part(OPENERS, "o_custkey + o_orderkey")}, {_part(ASKS, "o_orderkey")}, {_part(TAILS, "o_custkey")}], ' ')) AS text FROM orders),
n AS (SELECT id, lower(text) AS t FROM q), f AS (SELECT *, regexp_matches(t, '{questions.RANKING}') AS ranks, regexp_matches(t, '{questions.GROUPING}') AS groups, regexp_matches(t, '{questions.TEMPORAL}') AS timed FROM n),
p AS (SELECT *, CASE {_PICKED} END AS picked, {_MATCHED} AS matched FROM f),
o AS (SELECT *, CASE WHEN picked IS NULL OR matched = '' THEN NULL WHEN picked = 'correlation' THEN picked WHEN ranks THEN CASE WHEN regexp_matches(t, '{questions.UPWARD}') THEN 'top_n' ELSE 'bottom_n' END
  WHEN groups THEN CASE WHEN picked IN ('sum', 'avg', 'min', 'max') THEN 'group_' || picked ELSE 'group_count' END ELSE picked END AS operation FROM p),
d AS (SELECT *, operation IS NULL AND groups AND regexp_matches(t, '{questions.DATA_WORDS}') AS open FROM o)
SELECT id, CASE WHEN operation IS NOT NULL OR open THEN 'structured' ELSE 'semantic' END AS intent, operation,
 CAST(CASE WHEN open THEN 0.55 WHEN operation IS NULL THEN 0.8 WHEN operation LIKE 'group%' THEN 0.96 ELSE CASE operation {_SURE} ELSE 0.9 END END AS DOUBLE) AS confidence,
 CASE WHEN operation IN ('top_n', 'bottom_n') THEN CASE WHEN t LIKE '%top 7%' THEN 7 WHEN t LIKE '%bottom three%' THEN 3 ELSE 5 END END AS top,
 coalesce(operation LIKE 'group%', open) AS grouped, coalesce(operation = 'trend' OR (operation LIKE 'group%' OR operation IN ('count', 'sum', 'avg', 'min', 'max', 'distinct_count', 'median', 'std', 'variance')) AND timed, false) AS temporal,
 trim(matched) AS matched FROM d""")
def e16_intents(spark, sf_dir):
    """Class, confidence and all matched families of questions put together from parts."""
    told = generated(spark, sf_dir).select("id", questions.intent_of(F.col("text")).alias("i"))
    matched = F.array_join(F.transform("i.matches", lambda m: F.concat(m["operation"], F.lit(":"), F.array_join(F.array_sort(m["phrases"]), "/"))), " ")
    return told.select("id", "i.intent", "i.operation", "i.confidence", "i.top", "i.grouped", "i.temporal", matched.alias("matched"))


@query("e17_limits", f"WITH {ASKED} SELECT id, CASE id % {len(FORMS)} WHEN 3 THEN CAST(conv_id % 40 + 1 AS INTEGER) WHEN 4 THEN 5 END AS top FROM asked")
def e17_limits(spark, sf_dir):
    return asked(spark, sf_dir).select("id", questions.limit_of(F.col("text")).alias("top"))


@query("e18_comparisons", f"WITH {ASKED} SELECT id, CASE WHEN id % {len(FORMS)} = 8 THEN 'price' END AS column_text, CASE WHEN id % {len(FORMS)} = 8 THEN 'gt' END AS op, CASE WHEN id % {len(FORMS)} = 8 THEN conv_id % 40 + 1.5::DOUBLE END AS value FROM asked")
def e18_comparisons(spark, sf_dir):
    return asked(spark, sf_dir).select("id", questions.comparison_of(F.col("text")).alias("c")).select("id", "c.column_text", "c.op", "c.value")


STOP = "[" + ", ".join(f"'{w}'" for w in questions.STOP_WORDS) + "]"


@query("e19_leftover_tokens", f"""WITH {ASKED}, t AS (SELECT id, unnest(string_split({NORM.format("text")}, ' ')) AS w, unnest(range(1, 1 + len(string_split({NORM.format("text")}, ' ')))) AS i FROM asked)
SELECT id, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (length(w) >= 3 AND NOT regexp_matches(w, '^\\d+$') AND NOT list_contains({STOP}, w) AND w NOT IN ('price', 'prices', 'region', 'regions', 'revenue')), '') AS leftover FROM t GROUP BY 1""")
def e19_leftover_tokens(spark, sf_dir):
    left = questions.leftover_tokens(F.col("text"), F.array(F.lit("Price"), F.lit("Region")), F.array(F.lit("Revenue")))
    return asked(spark, sf_dir).select("id", F.array_join(left, " ").alias("leftover"))


@query("g5_ngrams", f"""WITH {ASKED}, w AS (SELECT id, string_split({NORM.format("text")}, ' ') AS w FROM asked),
g AS (SELECT DISTINCT id, array_to_string(w[i : i + n - 1], ' ') AS gram FROM w, range(1, 5) r(n), range(1, 20) s(i) WHERE i + n - 1 <= len(w) AND len(list_intersect(w[i : i + n - 1], {STOP})) = 0)
SELECT id, count(*) AS n FROM g WHERE gram <> '' GROUP BY 1""")
def g5_ngrams(spark, sf_dir):
    grams = asked(spark, sf_dir).select("id", F.explode(linking.ngrams(F.col("text"))).alias("gram"))
    return grams.groupBy("id").agg(F.count("*").alias("n"))


#: Questions whose values stand beside a column word, after a preposition, or alone; none is known in the last.
VALUE_FORMS = [
    "Sum of total price of the {segment} market segment", "Count of rows where country is {nation} for {region}", "Average total price for the {region} region?",
    "Total price in {nation} and with {priority}", "How many {segment} rows", "Sum of total price of xyzzy",
]
_FORM = f"o_orderkey % {len(VALUE_FORMS)}"


@query("g5_resolved_filters", f"""
WITH o AS (SELECT o_orderkey AS id, {_FORM} AS form, c_mktsegment, n_name, r_name, o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT id, CASE form WHEN 0 THEN 'Market Segment=' || c_mktsegment || ' (bound)' WHEN 1 THEN 'Country=' || n_name || ' (bound), Region=' || r_name || ' (for)' WHEN 2 THEN 'Region=' || r_name || ' (bound)'
 WHEN 3 THEN 'Country=' || n_name || ' (in), Order Priority=' || o_orderpriority || ' (mention)' WHEN 4 THEN 'Market Segment=' || c_mktsegment || ' (mention)' ELSE '' END AS filters,
 CASE form WHEN 5 THEN 'xyzzy' ELSE '' END AS leftover FROM o""")
def g5_resolved_filters(spark, sf_dir):
    """Questions over orders, the filters that they name, and what nothing explains."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    customers = table(spark, sf_dir, "customer").join(nations, F.col("n_nationkey") == F.col("c_nationkey"))
    rows = table(spark, sf_dir, "orders").join(customers, F.col("c_custkey") == F.col("o_custkey")).select(
        "o_orderkey", F.col("c_mktsegment").alias("Market Segment"), F.col("n_name").alias("Country"), F.col("r_name").alias("Region"), F.col("o_orderpriority").alias("Order Priority"), F.col("o_totalprice").alias("Total Price"))
    text = F.element_at(F.array(*[F.lit(f) for f in VALUE_FORMS]), F.expr(_FORM).cast("int") + 1)
    for slot, column in (("segment", "Market Segment"), ("nation", "Country"), ("region", "Region"), ("priority", "Order Priority")):
        text = F.replace(text, F.lit(f"{{{slot}}}"), F.col(column))
    dimensions = ["Market Segment", "Country", "Region", "Order Priority"]
    columns = spark.createDataFrame([(c, c in dimensions) for c in [*dimensions, "Total Price"]], "column string, dimension boolean")
    out = resolve_filters(rows.select(F.col("o_orderkey").alias("id"), text.alias("question")), linking.value_dictionary(rows, dimensions), columns)
    told = F.transform(F.array_sort("filters"), lambda f: F.concat(f["column"], F.lit("="), f["value"], F.lit(" ("), f["form"], F.lit(")")))
    return out.select("id", F.array_join(told, ", ").alias("filters"), F.array_join("leftover", " ").alias("leftover"))


#: Parts of questions with limits and with comparisons.
LIMIT_WORDS = ["top", "Bottom", "first", "last", "best"]
NUMBERS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "zero"]
COMPARED = ["unit price", "net_sales", "cost"]
PHRASES = ["greater than or equal to", "at least", "is above", ">", "no more than", "<", "exceeds", "equals", "is less than", "lower than", ">=", "near"]


@query("e17_generated_limits", f"""
WITH q AS (SELECT o_orderkey AS id, lower('Show ' || {_part(LIMIT_WORDS, "o_custkey")} || ' ' || CASE WHEN o_orderkey % 3 = 0 THEN {_part(NUMBERS, "o_orderkey + o_custkey")} ELSE CAST((o_orderkey * 7 + o_custkey) % 1300 AS VARCHAR) END || ' products') AS t FROM orders),
x AS (SELECT id, regexp_extract(t, '\\b(?:top|bottom|first|last)\\s+(\\w+)', 1) AS w FROM q)
SELECT id, CASE WHEN regexp_matches(w, '^\\d+$') THEN CASE WHEN CAST(w AS INTEGER) BETWEEN 1 AND 1000 THEN CAST(w AS INTEGER) END
  ELSE CAST(nullif(list_position(['one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten'], w), 0) AS INTEGER) END AS top FROM x""")
def e17_generated_limits(spark, sf_dir):
    """Limits of questions whose numbers come from the rows: figures up to 1299, number words, words that are none."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    number = F.when(key % 3 == 0, _pick(NUMBERS, key + cust)).otherwise(((key * 7 + cust) % 1300).cast("string"))
    text = F.concat_ws(" ", F.lit("Show"), _pick(LIMIT_WORDS, cust), number, F.lit("products"))
    return table(spark, sf_dir, "orders").select(key.alias("id"), questions.limit_of(text).alias("top"))


_OPS = ["gte", "gte", "gt", "gt", "lte", "lt", "gt", None, "lt", "lt", "gte", None]


@query("e18_generated_comparisons", f"""
WITH q AS (SELECT o_orderkey AS id, {_part(COMPARED, "o_custkey")} AS c, [{", ".join("NULL" if o is None else repr(o) for o in _OPS)}][1 + o_orderkey % {len(PHRASES)}] AS op,
  CAST((o_custkey % 4000 - 2000) AS DOUBLE) + (o_orderkey % 4) / 4.0 AS v FROM orders)
SELECT id, CASE WHEN op IS NOT NULL THEN c END AS column_text, op, CASE WHEN op IS NOT NULL THEN v END AS value FROM q""")
def e18_generated_comparisons(spark, sf_dir):
    """Comparisons whose columns, phrases and numbers come from the rows: negative ones and decimals, phrases that are none."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    value = ((cust % 4000 - 2000).cast("double") + (key % 4) / 4).cast("decimal(12,2)").cast("string")
    told = table(spark, sf_dir, "orders").select(key.alias("id"), questions.comparison_of(F.concat_ws(" ", _pick(COMPARED, cust), _pick(PHRASES, key), value)).alias("c"))
    return told.select("id", "c.column_text", "c.op", "c.value")


FOLLOWS = r"regexp_matches(lower(text), '^(and|what about|how about|also|same for)\b')"
RESOLVED = f"""r AS (SELECT id, text, {METRIC} AS own, regexp_extract_all(text, '\\b((?:19|20)\\d{{2}})\\b', 1) AS y, {GROW} OR {EXPLICIT} AS calculates, {FOLLOWS} AS follows FROM asked),
s AS (SELECT *, CASE WHEN own <> '' THEN own ELSE 'profit' END AS metric, coalesce(y[1], '2000') AS a, coalesce(y[2], '2030') AS b FROM r)
SELECT id, CASE WHEN follows AND regexp_matches(lower(text), 'growth|increase') THEN 'What was the ' || metric || ' growth from ' || a || ' to ' || b || '?'
 WHEN follows AND len(y) < 2 THEN 'What was the ' || metric || ' in ' || a || '?'
 WHEN own <> '' AND len(y) >= 2 AND calculates THEN 'What was the ' || own || ' growth from ' || y[1] || ' to ' || y[2] || '?'
 ELSE trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS question FROM s"""


@query("e20_resolved", f"WITH {ASKED}, {RESOLVED}")
def e20_resolved(spark, sf_dir):
    """All twelve forms of questions as questions that stand alone."""
    rows = asked(spark, sf_dir).withColumn("t", questions.analysis(F.col("text")))
    return rows.select("id", questions.resolved_question(F.col("text"), F.col("t"), F.lit("2000"), F.lit("2030"), F.lit("profit")).alias("question"))


@query("e20_resolved_all", f"WITH {ASKED}, {RESOLVED}")
def e20_resolved_all(spark, sf_dir):
    """The same; kept under the name it had when e20_resolved took only some forms."""
    return e20_resolved(spark, sf_dir)


@query("e21_options", """SELECT n_nationkey, 'revenue ' || n_nationkey || '|' || lower(n_name) || '|x' AS options, 'Which period do you mean: 2001, ' || n_name || ', or 2003?' AS question FROM nation""")
def e21_options(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    text = F.concat(F.lit("Please: Do you mean revenue "), F.col("n_nationkey").cast("string"), F.lit(", "), F.lower("n_name"), F.lit(" or x?"))
    return n.select("n_nationkey", F.array_join(S.options_of(text), "|").alias("options"), S.period_question(F.array(F.lit("2001"), F.col("n_name"), F.lit("2003"))).alias("question"))


@query("j1_carried_slots", f"""WITH {ASKED}, t AS (SELECT *, nullif({METRIC}, '') AS metric, regexp_extract_all(text, '\\b((?:19|20)\\d{{2}})\\b', 1) AS y FROM asked)
SELECT id, last_value(metric IGNORE NULLS) OVER w AS last_metric, last_value(y[1] IGNORE NULLS) OVER w AS last_start_period FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def j1_carried_slots(spark, sf_dir):
    return conversation.carried_slots(asked(spark, sf_dir)).select("id", "last_metric", "last_start_period")


def retrieved(spark, sf_dir):
    """Questions with the years that retrieval would find for them: the years of the customer's orders, as an array."""
    years = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(F.date_format("o_orderdate", "yyyy")).alias("years"))
    return asked(spark, sf_dir).join(years, F.col("conv_id") == F.col("o_custkey")).drop("o_custkey")


@query("j2_clarify")
def j2_clarify(spark, sf_dir):
    """The clarification state machine over all conversations (checked against expected tables in tests)."""
    return conversation.clarify(asked(spark, sf_dir))


@query("j2_clarify_periods")
def j2_clarify_periods(spark, sf_dir):
    """The same with what retrieval found, where growth without its periods is asked back for one of them."""
    return conversation.clarify(retrieved(spark, sf_dir), found_years="years")


@query("j3_newest_conversations", "WITH l AS (SELECT user_id, max(ts) AS t FROM events GROUP BY 1 ORDER BY t DESC, user_id DESC LIMIT 20) SELECT user_id, count(*) AS n FROM events JOIN l USING (user_id) GROUP BY 1")
def j3_newest_conversations(spark, sf_dir):
    return conversation.newest_conversations(table(spark, sf_dir, "events"), "user_id", "ts", 20).groupBy("user_id").agg(F.count("*").alias("n"))


@query("j5_clarify_stream")
def j5_clarify_stream(spark, sf_dir):
    """The same through a stream with kept state; its result equals j2's (tested)."""
    feed, out, checkpoint = (shared(spark, x) for x in ("feed", "clarified", "state"))
    asked(spark, sf_dir).select("conv_id", "turn", "text").write.parquet(feed)
    stream = spark.readStream.schema("conv_id long, turn long, text string").parquet(feed)
    result = conversation.clarify_stream(stream, idle=None, groups=conversation.GROUPS)
    result.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


#: Minutes after which a conversation of orders begins anew, and how far behind the newest order a turn may come.
IDLE, LATE = timedelta(days=200), "30 days"


@query("j5_clarify_events")
def j5_clarify_events(spark, sf_dir):
    """Turns at the time of their orders through a stream in several deliveries, which are not in the order of time within;
    conversations begin anew after a long pause. Equal to the batch over the same turns (tested)."""
    rows = asked(spark, sf_dir, F.col("o_orderdate").cast("timestamp").alias("ts")).drop("id")
    feed, out, checkpoint = (shared(spark, x) for x in ("feed", "clarified", "state"))
    for first, last in ((1992, 1993), (1994, 1995), (1996, 2100)):
        rows.where(F.year("ts").between(first, last)).write.mode("append").parquet(feed)
        stream = spark.readStream.schema("conv_id long, turn long, text string, ts timestamp").parquet(feed)
        run_to_end(conversation.clarify_events(stream, late=LATE, idle=IDLE, groups=conversation.GROUPS), out, checkpoint)
    return spark.read.parquet(out)
