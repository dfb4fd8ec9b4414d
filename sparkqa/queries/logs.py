"""Run log: the events table plays the log (errors are failures), prices, indicators, series, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkqa.operators import runlog
from sparkqa.queries.plans import table
from sparkqa.queries.tables import shared
from sparkqa.streaming import logs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def log(spark, sf_dir):
    """Events as requests."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCESS").alias("status"), e.cast("string").alias("request_id"),
        F.when(e % 5 == 0, "openai").when(e % 7 == 0, " ").when(e % 11 == 0, "other").otherwise("google").alias("provider"), F.when(e % 4 > 0, F.concat(F.lit("q"), e.cast("string"))).otherwise("").alias("question"),
        F.when(e % 3 > 0, F.col("props")).alias("answer"), (F.col("value") / 1000).alias("confidence"), (F.col("value") * 10).alias("total_time_ms"), (F.col("value") * 100).cast("long").alias("input_tokens"), F.col("user_id").alias("output_tokens"),
        F.col("value").alias("retrieval_time_ms"), F.array(F.col("event_type")).alias("sources"),
    )


LOG = """log AS (SELECT ts, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS status, event_id, CAST(event_id AS VARCHAR) AS request_id,
 CASE WHEN event_id % 5 = 0 THEN 'openai' WHEN event_id % 7 = 0 THEN ' ' WHEN event_id % 11 = 0 THEN 'other' ELSE 'google' END AS provider, CASE WHEN event_id % 4 > 0 THEN 'q' || event_id ELSE '' END AS question,
 CASE WHEN event_id % 3 > 0 THEN props END AS answer, value / 1000 AS confidence, value * 10 AS total_time_ms, CAST(trunc(value * 100) AS BIGINT) AS input_tokens, user_id AS output_tokens, value FROM events)"""


@query("a8_csv_log", f"WITH {LOG} SELECT status, count(*) AS n, count(*) FILTER (model = '' AND error = '') AS blank, count(DISTINCT sources) AS sources FROM (SELECT *, '' AS model, '' AS error, status || '' AS sources FROM log) GROUP BY 1")
def a8_csv_log(spark, sf_dir):
    path = shared(spark, "log")
    rows = log(spark, sf_dir).withColumn("sources", F.array("status"))
    runlog.append_csv(rows, path)
    back = spark.read.option("header", True).option("nullValue", "\u0000").option("emptyValue", "").option("escape", "\\").csv(path)
    blank = (F.coalesce("model", F.lit("")) == "") & (F.coalesce("error", F.lit("")) == "")
    return back.groupBy("status").agg(F.count("*").alias("n"), F.count_if(blank).alias("blank"), F.count_distinct("sources").alias("sources"))


@query("a9_json_log", f"WITH {LOG} SELECT 'FAILED' AS status, count(*) AS n FROM log WHERE status = 'FAILED' UNION ALL SELECT 'SUCCESS', count(*) FROM log WHERE status = 'SUCCESS'")
def a9_json_log(spark, sf_dir):
    path = shared(spark, "log")
    rows = log(spark, sf_dir)
    runlog.append_json(rows.where("status = 'SUCCESS'"), path)
    runlog.append_json(rows.where("status <> 'SUCCESS'"), path, failed=True)
    return runlog.read_jsonl(spark, path, "status string, request_id string").groupBy("status").agg(F.count("*").alias("n"))


@query("a10_tolerant_jsonl", "SELECT event_id, event_type FROM events WHERE event_id % 10 < 8")
def a10_tolerant_jsonl(spark, sf_dir):
    good = F.to_json(F.struct("event_id", "event_type"))
    lines = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 10 == 8, "  ").when(F.col("event_id") % 10 == 9, F.concat(F.lit("{bad "), good)).otherwise(good).alias("value"))
    return runlog.parse_jsonl(lines, "event_id long, event_type string")


@query("a11_question_answers", f"WITH {LOG} SELECT question, answer FROM log WHERE question <> '' AND answer IS NOT NULL")
def a11_question_answers(spark, sf_dir):
    return runlog.question_answers(log(spark, sf_dir))


@query("g1_priced", f"""WITH {LOG}, p(provider, i, o) AS (VALUES ('google', 0.3, 2.5), ('openai', 0.0, 0.0))
SELECT request_id, round(round(input_tokens / 1e6 * CAST(i AS DOUBLE), 8) + round(output_tokens / 1e6 * CAST(o AS DOUBLE), 8), 8) AS total_cost, i IS NULL AS price_error FROM log LEFT JOIN p USING (provider)""")
def g1_priced(spark, sf_dir):
    return runlog.priced(log(spark, sf_dir)).select("request_id", "total_cost", "price_error")


@query("i1_history", f"WITH {LOG} SELECT timestamp, request_id, coalesce(answer, '') AS answer FROM log ORDER BY timestamp DESC, request_id LIMIT 50")
def i1_history(spark, sf_dir):
    return runlog.history(log(spark, sf_dir).select("timestamp", "request_id", "answer"), 50)


DAY = "2024-01-30 18:00:00"


@query("i2_indicators", f"""WITH {LOG}, t AS (SELECT * FROM log WHERE ts >= TIMESTAMP '2024-01-30')
SELECT count(*) AS questions_today, coalesce(round(avg(confidence), 3), 0) AS avg_confidence, coalesce(round(avg(total_time_ms), 2), 0) AS avg_response_time, 0.0::DOUBLE AS today_cost,
       coalesce(round(count(*) FILTER (status = 'SUCCESS') * 100.0::DOUBLE / nullif(count(*), 0), 2), 0) AS success_rate FROM t""")
def i2_indicators(spark, sf_dir):
    return runlog.indicators(log(spark, sf_dir), F.lit(DAY).cast("timestamp"))


@query("i4_series", f"WITH {LOG} SELECT timestamp, request_id, confidence, total_time_ms, 0.0::DOUBLE AS total_cost, value AS retrieval_time_ms, 0.0::DOUBLE AS llm_time_ms, 0.0::DOUBLE AS total_tokens FROM log")
def i4_series(spark, sf_dir):
    return runlog.series(log(spark, sf_dir))


@query("i5_means", f"WITH {LOG} SELECT round(avg(value), 2) AS avg_retrieval_time, 0.0::DOUBLE AS avg_provider_latency, 0.0::DOUBLE AS avg_context_length, 0.0::DOUBLE AS avg_chunks FROM log")
def i5_means(spark, sf_dir):
    return runlog.means(log(spark, sf_dir))


@query("i6_providers", f"WITH {LOG} SELECT coalesce(nullif(trim(provider), ''), 'Unknown') AS provider, count(*) AS requests FROM log GROUP BY 1")
def i6_providers(spark, sf_dir):
    return runlog.providers(log(spark, sf_dir))


@query("i7_totals", f"WITH {LOG} SELECT count(*) AS total, count(*) FILTER (status = 'SUCCESS') AS success, count(*) FILTER (status = 'FAILED') AS failed FROM log")
def i7_totals(spark, sf_dir):
    return runlog.totals(log(spark, sf_dir))


@query("i8_dashboard", f"""WITH {LOG}, t AS (SELECT * FROM log WHERE ts >= TIMESTAMP '2024-01-30')
SELECT (SELECT count(*) FROM t) AS questions_today, (SELECT count(DISTINCT source) FROM documents) AS documents, (SELECT count(*) FROM documents) AS chunks""")
def i8_dashboard(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(F.col("source").alias("document_id"))
    return runlog.dashboard(log(spark, sf_dir), F.lit(DAY).cast("timestamp"), chunks).select("questions_today", "documents", "chunks")


DAILY = "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS requests, count(*) FILTER (event_type = 'error') AS failed, round(avg(value), 4) AS mean_value FROM events GROUP BY 1"


@query("j4_daily_batch", DAILY)
def j4_daily_batch(spark, sf_dir):
    return logs.daily_indicators(table(spark, sf_dir, "events"), status="event_type", failed="error").withColumn("mean_value", F.round("mean_value", 4))


@query("j4_daily_stream", DAILY)
def j4_daily_stream(spark, sf_dir):
    """The same days through a stream over the files of the table; complete days come from the stream's last state."""
    events = table(spark, sf_dir, "events")
    feed, out, checkpoint = (shared(spark, x) for x in ("feed", "daily", "state"))
    events.select("ts", "value", "event_type").write.json(feed)
    stream = logs.daily_indicators(logs.read_log(spark, feed, "ts timestamp, value double, event_type string"), status="event_type", failed="error")

    def keep(batch, number):
        batch.write.mode("append").parquet(f"{out}/batch={number}")

    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    latest = spark.read.parquet(out).groupBy("day").agg(F.max_by(F.struct("requests", "failed", "mean_value"), "batch").alias("x"))
    return latest.select("day", "x.requests", "x.failed", F.round("x.mean_value", 4).alias("mean_value"))


#: Which of four deliveries a row of the log comes with: its week of eight days, but every fiftieth row of the first week
#: comes with the third delivery, far behind the watermark, and every fiftieth plus one of day 16 with the same, in time.
DELIVERY = "CASE WHEN day(ts) <= 8 AND event_id % 50 = 0 OR day(ts) = 16 AND event_id % 50 = 1 THEN 2 ELSE (day(ts) - 1) // 8 END"


@query("j4_closed_days", f"""WITH e AS (SELECT *, {DELIVERY} AS d, day(ts) <= 8 AND event_id % 50 = 0 AS late FROM events)
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS requests, count(*) FILTER (event_type = 'error') AS failed, round(avg(value), 4) AS mean_value, (SELECT CAST(sum(CASE WHEN event_id % 7 = 3 THEN 2 ELSE 1 END) AS BIGINT) FROM e WHERE late) AS dropped
FROM e WHERE NOT late GROUP BY 1 HAVING CAST(strptime(day, '%Y-%m-%d') AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM e)""")
def j4_closed_days(spark, sf_dir):
    """Days through a stream in append mode, delivery after delivery: late rows are dropped and counted, days behind the
    watermark are told once. Each delivery repeats every seventh row, which counts once (dropped rows count as delivered)."""
    rows = table(spark, sf_dir, "events").withColumn("delivery", F.expr(DELIVERY.replace("//", "DIV")))
    feed, out, checkpoint = (shared(spark, x) for x in ("feed", "closed", "state"))
    schema = "event_id long, ts timestamp, value double, event_type string"
    lost = 0
    for n in range(4):
        part = rows.where(F.col("delivery") == n).select("event_id", "ts", "value", "event_type")
        part.unionByName(part.where("event_id % 7 = 3")).write.mode("append").json(feed)
        lost += logs.run_to_end(logs.closed_days(logs.read_log(spark, feed, schema), "event_id", status="event_type", failed="error"), out, checkpoint)
    return spark.read.parquet(out).select("day", "requests", "failed", F.round("mean_value", 4).alias("mean_value"), F.lit(lost).cast("long").alias("dropped"))


@query("i3_numbers", "SELECT user_id, round(sum(CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END), 4) AS total, 0.0::DOUBLE AS missing FROM events GROUP BY 1")
def i3_numbers(spark, sf_dir):
    """Bad values and missing columns count as 0."""
    rows = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("value"))
    return rows.groupBy("user_id").agg(F.round(F.sum(runlog.number(rows, "value")), 4).alias("total"), F.sum(runlog.number(rows, "nothing")).alias("missing"))
