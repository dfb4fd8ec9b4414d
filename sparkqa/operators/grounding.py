"""Grounding: facts in texts, missing and conflicting facts, growth, and answers held against their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkqa.functions.scalar import ANY_NUMBER, TEXT_NUMBER, numbers_of, percentage_change, years_of

EPSILON = 1e-6


def metric_values(texts: DataFrame, key: str = "query_id", text: str = "text", metric: str = "metric", keep_decimals: bool = False) -> DataFrame:
    """(key, metric, year, value, pos): per line (texts split at line ends, full stops and semicolons) each year with the
    first two numbers that are no year of the line; lines with the metric but no year give year ``unknown``.

    Lines of a text that never names the metric give nothing. Splitting at full stops also cuts decimals, as the question
    service does; ``keep_decimals`` splits only at those that no digit follows."""
    lines = texts.select(key, metric, F.contains(F.lower(text), F.lower(metric)).alias("_named"), F.posexplode(F.split(F.col(text), r"[\n;]|\.(?!\d)" if keep_decimals else r"[\n.;]")).alias("_line", "_text"))
    years = years_of(F.col("_text"))
    numbers = F.filter(numbers_of(F.col("_text"), TEXT_NUMBER), lambda n: ~F.exists(years, lambda y: y.cast("double") == n))
    found = lines.select(key, metric, "_named", "_line", F.contains(F.lower("_text"), F.lower(metric)).alias("_here"), years.alias("_years"), F.slice(numbers, 1, 2).alias("_numbers"))
    which = F.when((F.size("_years") > 0) & (F.col("_here") | F.col("_named")), F.col("_years")).when((F.size("_years") == 0) & F.col("_here"), F.array(F.lit("unknown"))).otherwise(F.array().cast("array<string>"))
    pairs = found.where(F.size("_numbers") > 0).select(key, metric, "_line", F.posexplode(which).alias("_y", "year"), "_numbers").select(key, metric, "_line", "_y", "year", F.posexplode("_numbers").alias("_n", "value"))
    return pairs.select(key, metric, "year", "value", (F.col("_line").cast("long") * 1000000 + F.col("_y") * 10 + F.col("_n")).alias("pos"))


def facts(values: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, metric, year, value, conflict): the first value of a year; a conflict if others differ by more than 1e-6."""
    return values.groupBy(key, "metric", "year").agg(F.min_by("value", "pos").alias("value"), (F.max("value") - F.min("value") > EPSILON).alias("conflict"))


def evidence_status(queries: DataFrame, texts: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, status, completeness, missing) of each query (key, metric, years array, calculation boolean) over its texts
    (key, text; several per key are joined by line ends in ``pos`` order).

    ``irrelevant`` without text; ``conflicting`` (0.4) where a year has two values; else completeness is the share of the
    wanted years that have a value, ``insufficient`` below 1. Without a calculation only the metric must be named (else
    ``insufficient``, 0.2)."""
    joined = texts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("text"))
    asked = queries.join(joined, key, "left").withColumn("text", F.coalesce("text", F.lit("")))
    found = facts(metric_values(asked.where(F.col("calculation") & (F.col("metric") != "")), key), key)
    per = found.groupBy(key).agg(F.bool_or("conflict").alias("_conflict"), F.collect_set("year").alias("_found"))
    rows = asked.join(per, key, "left")
    wanted = F.filter(F.coalesce("years", F.array().cast("array<string>")), lambda y: y != "")
    missing = F.array_except(wanted, F.coalesce("_found", F.array().cast("array<string>")))
    named = (F.col("metric") == "") | F.contains(F.lower("text"), F.lower("metric"))
    complete = F.when(F.size(wanted) == 0, F.when(named, 1.0).otherwise(0.0)).otherwise((F.size(wanted) - F.size(missing)) / F.size(wanted))
    blank, plain, conflict = F.trim("text") == "", ~F.col("calculation"), F.coalesce("_conflict", F.lit(False))
    return rows.select(
        key,
        F.when(blank, "irrelevant").when(plain, F.when(named, "relevant").otherwise("insufficient")).when(conflict, "conflicting").when(complete < 1, "insufficient").otherwise("relevant").alias("status"),
        F.when(blank, 0.0).when(plain, F.when(named, 1.0).otherwise(0.2)).when(conflict, 0.4).otherwise(complete).alias("completeness"),
        F.when(blank | plain | conflict, F.array().cast("array<string>")).otherwise(missing).alias("missing"),
    )


def growth(found: DataFrame, queries: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, metric, old, new, growth): change between the facts of a query's first and second year, six decimals; null
    where a fact is missing, in conflict, or the first is 0."""
    start, end = F.element_at("years", 1), F.element_at("years", 2)
    both = queries.where(F.size("years") >= 2).select(key, start.alias("_start"), end.alias("_end")).join(found.where("not conflict"), key, "left")
    sums = both.groupBy(key).agg(F.max("metric").alias("metric"), F.max(F.when(F.col("year") == F.col("_start"), F.col("value"))).alias("old"), F.max(F.when(F.col("year") == F.col("_end"), F.col("value"))).alias("new"))
    return sums.withColumn("growth", F.round(percentage_change(F.col("old"), F.col("new")), 6))


#: Years that need no evidence.
FREE_YEARS = tuple(float(y) for y in range(2019, 2027))


def unsupported_numbers(answer: Column, evidence: Column, result: Column | None = None) -> Column:
    """Numbers of an answer that no evidence number matches within 0.05 (raw or at two decimals), nor the calculation
    (also within 0.51 of its whole number)."""
    allowed = numbers_of(evidence, ANY_NUMBER)
    if result is not None:
        allowed = F.when(result.isNotNull(), F.concat(allowed, F.array(result))).otherwise(allowed)
    near = lambda n: F.exists(allowed, lambda a: (F.abs(n - a) <= 0.05) | (F.abs(n - F.round(a, 2)) <= 0.05))
    whole = (lambda n: F.coalesce(F.abs(n - F.round(result, 0)) <= 0.51, F.lit(False))) if result is not None else (lambda n: F.lit(False))
    return F.filter(numbers_of(answer, ANY_NUMBER), lambda n: ~F.abs(n).isin(*FREE_YEARS) & ~near(n) & ~whole(n))


def verified(answer: Column, evidence: Column, result: Column | None = None) -> Column:
    """Is every number of an answer supported? Answers that abstain always are."""
    text = F.lower(F.trim(F.coalesce(answer, F.lit(""))))
    abstains = text.startswith("i don't have enough") | F.contains(text, F.lit("i couldn't find"))
    return abstains | (F.size(unsupported_numbers(answer, evidence, result)) == 0)
