"""Run log: writing and reading it, prices, history, indicators, series, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkqa.functions.scalar import to_number

#: The log's columns in order, and prices per million tokens.
COLUMNS = [
    "timestamp", "status", "request_id", "provider", "model", "question", "answer", "confidence", "max_similarity", "should_answer", "chunks_retrieved", "context_length",
    "retrieval_threshold", "top_k", "retrieval_time_ms", "llm_time_ms", "llm_provider_latency_ms", "total_time_ms", "temperature", "input_tokens", "output_tokens", "total_tokens",
    "input_cost", "output_cost", "embedding_cost", "total_cost", "sources", "error",
]
PRICES = {"google": (0.30, 2.50), "openai": (0.0, 0.0)}


def csv_rows(log: DataFrame) -> DataFrame:
    """The fixed columns as strings: missing and null as empty, fractions to three decimals, lists and maps as JSON."""
    kinds = dict(log.dtypes)

    def cell(name: str) -> Column:
        kind = kinds.get(name)
        if kind is None:
            return F.lit("").alias(name)
        value = F.round(name, 3) if kind in ("double", "float") else F.to_json(name) if kind.startswith(("array", "map", "struct")) else F.col(name)
        return F.coalesce(value.cast("string"), F.lit("")).alias(name)

    return log.select(*[cell(c) for c in COLUMNS])


def append_csv(log: DataFrame, path: str) -> None:
    csv_rows(log).write.mode("append").option("header", True).csv(path)


def append_json(log: DataFrame, path: str, failed: bool = False) -> None:
    """JSON lines; failed runs get the status FAILED."""
    (log.withColumn("status", F.lit("FAILED")) if failed else log).write.mode("append").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by a schema; blank lines and what is no JSON are left out."""
    return parse_jsonl(spark.read.text(path), schema)


def parse_jsonl(lines: DataFrame, schema: str) -> DataFrame:
    parsed = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = lines.where(F.trim("value") != "").select(parsed.alias("r")).where("r is not null and r._corrupt_record is null")
    return rows.select("r.*").drop("_corrupt_record")


def question_answers(log: DataFrame) -> DataFrame:
    """Rows with a question that is not empty and an answer that is not null, as two columns of strings."""
    return log.where((F.coalesce(F.col("question").cast("string"), F.lit("")) != "") & F.col("answer").isNotNull()).select(F.col("question").cast("string").alias("question"), F.col("answer").cast("string").alias("answer"))


def export_csv(log: DataFrame, path: str) -> None:
    question_answers(log).write.mode("overwrite").option("header", True).csv(path)


def priced(requests: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Adds input_cost, output_cost, embedding_cost (0), total_cost (8 decimals) and ``price_error`` for providers without
    a price. Prices: provider, input_per_million, output_per_million; Spark broadcasts them where it finds them small."""
    table = prices if prices is not None else requests.sparkSession.createDataFrame([(p, *v) for p, v in PRICES.items()], "provider string, input_per_million double, output_per_million double")
    rows = requests.join(table, "provider", "left")
    cost = lambda tokens, price: F.round(F.col(tokens) / 1e6 * F.col(price), 8)
    rows = rows.withColumns({"input_cost": cost("input_tokens", "input_per_million"), "output_cost": cost("output_tokens", "output_per_million"), "embedding_cost": F.lit(0.0)})
    return rows.withColumns({"total_cost": F.round(F.col("input_cost") + F.col("output_cost") + F.col("embedding_cost"), 8), "price_error": F.col("input_per_million").isNull()}).drop("input_per_million", "output_per_million")


def number(log: DataFrame, column: str) -> Column:
    """A number of the log; a missing column and values that are no numbers count as 0, and so lower means."""
    return F.coalesce(to_number(F.col(column)), F.lit(0.0)) if column in log.columns else F.lit(0.0)


def history(log: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest first, unreadable times last, times printed, nulls empty; limit: at least 1. A limit keeps to the top rows
    of every task and never sorts the whole log."""
    at = F.try_to_timestamp(F.col("timestamp").cast("string"))
    rows = log.withColumn("_at", at).orderBy(F.col("_at").desc_nulls_last(), *([F.col("request_id")] if "request_id" in log.columns else []))
    rows = rows.limit(max(1, limit)) if limit is not None else rows
    return rows.select(*[F.coalesce((F.date_format("_at", "yyyy-MM-dd HH:mm:ss") if c == "timestamp" else F.col(c).cast("string")), F.lit("")).alias(c) for c in log.columns])


def is_status(log: DataFrame, status: str) -> Column:
    return F.coalesce(F.upper("status") == status, F.lit(False))


def indicators(log: DataFrame, as_of: Column) -> DataFrame:
    """One row since the start of ``as_of``'s day: questions_today, avg_confidence (3 decimals), avg_response_time (2),
    today_cost (6), success_rate (% with 2); all 0 without rows."""
    today = log.where(F.try_to_timestamp(F.col("timestamp").cast("string")) >= F.date_trunc("day", as_of))
    zero = lambda c, d: F.coalesce(F.round(c, d), F.lit(0.0))
    return today.agg(
        F.count("*").alias("questions_today"), zero(F.avg(number(log, "confidence")), 3).alias("avg_confidence"), zero(F.avg(number(log, "total_time_ms")), 2).alias("avg_response_time"),
        zero(F.sum(number(log, "total_cost")), 6).alias("today_cost"), zero(F.try_divide(F.count_if(is_status(log, "SUCCESS")) * 100.0, F.count("*")), 2).alias("success_rate"),
    )


SERIES = ("confidence", "total_time_ms", "total_cost", "retrieval_time_ms", "llm_time_ms", "total_tokens")


def series(log: DataFrame) -> DataFrame:
    """One row per request in log order with the numbers that are plotted."""
    return log.select("timestamp", "request_id", *[number(log, c).alias(c) for c in SERIES]).orderBy("timestamp", "request_id")


def means(log: DataFrame) -> DataFrame:
    zero = lambda c, d: F.coalesce(F.round(F.avg(number(log, c)), d), F.lit(0.0))
    return log.agg(zero("retrieval_time_ms", 2).alias("avg_retrieval_time"), zero("llm_provider_latency_ms", 2).alias("avg_provider_latency"), zero("context_length", 0).alias("avg_context_length"), zero("chunks_retrieved", 2).alias("avg_chunks"))


def providers(log: DataFrame) -> DataFrame:
    """Requests per provider, most first; null and blank providers are ``Unknown``."""
    name = F.coalesce(F.nullif(F.trim("provider"), F.lit("")), F.lit("Unknown"))
    return log.groupBy(name.alias("provider")).agg(F.count("*").alias("requests")).orderBy(F.desc("requests"), "provider")


def totals(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("total"), F.count_if(is_status(log, "SUCCESS")).alias("success"), F.count_if(is_status(log, "FAILED")).alias("failed"))


def dashboard(log: DataFrame, as_of: Column, chunks: DataFrame) -> DataFrame:
    """One row: the indicators beside counts of the knowledge store (documents, chunks). Both sides are one row each."""
    store = chunks.agg(F.count_distinct("document_id").alias("documents"), F.count("*").alias("chunks"))
    return indicators(log, as_of).withColumns({c: store.select(c).scalar() for c in ("documents", "chunks")})
