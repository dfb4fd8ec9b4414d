"""Loose phrases to column values and names: fuzzy scores, best values with a lead, candidates of a question."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkqa.functions.scalar import normalize_text
from sparkqa.operators.questions import STOP_WORDS
from sparkqa.sources.catalog import long_form

SURE, NEAR, LEAD, COLUMN_MINIMUM, COLUMN_LEAD, MAX_DISTINCT = 0.88, 0.82, 0.08, 0.78, 0.05, 800


def sequence_score(q: str, c: str) -> float:
    """The better of the mean best token ratio and the whole ratio, of two normalised texts."""
    others = c.split()
    tokens = [1.0 if t in others else max(SequenceMatcher(None, t, o).ratio() for o in others) for t in q.split()]
    return max(sum(tokens) / len(tokens), SequenceMatcher(None, q, c).ratio())


def fuzzy_score(query: Column, candidate: Column) -> Column:
    """0 to 1: equal 1; one within the other 0.82 and up by their lengths; else by sequence ratios (Arrow batches, on those
    pairs only)."""

    @F.pandas_udf("double")
    def by_sequence(q: pd.Series, c: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        out = []
        for pair in zip(q, c, strict=True):
            if None in pair:
                out.append(0.0)
                continue
            if pair not in known:
                known[pair] = sequence_score(*pair)
            out.append(known[pair])
        return pd.Series(out)

    q, c = (F.coalesce(normalize_text(x), F.lit("")) for x in (query, candidate))
    within = F.contains(q, c) | F.contains(c, q)
    easy = (q == "") | (c == "") | within
    rest = by_sequence(F.when(~easy, q), F.when(~easy, c))
    lengths = F.least(F.length(q), F.length(c)) / F.greatest(F.length(q), F.length(c))
    return F.when((q == "") | (c == ""), 0.0).when(q == c, 1.0).when(within, 0.82 + 0.18 * lengths).otherwise(rest)


def value_dictionary(df: DataFrame, columns: Sequence[str], samples: DataFrame | None = None, most: int = MAX_DISTINCT) -> DataFrame:
    """(column, value, norm): distinct trimmed values of columns with at most ``most`` of them, one per normalised form;
    samples (column, value) are merged in. Larger columns are left out, which bounds the dictionary by ``most`` rows a
    column."""
    values = long_form(df, columns).select("column", F.trim("value").alias("value")).where("value is not null and value <> ''")
    if samples is not None:
        values = values.unionByName(samples.select("column", F.trim("value").alias("value")))
    distinct = values.distinct()
    small = distinct.groupBy("column").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("column")
    return distinct.join(small, "column", "left_semi").withColumn("norm", normalize_text(F.col("value"))).groupBy("column", "norm").agg(F.min("value").alias("value")).where("norm <> ''")


def link_values(phrases: DataFrame, dictionary: DataFrame, near_miss: bool = True) -> DataFrame:
    """(phrase, column, value, score): per phrase and column the best dictionary value; it counts from 0.88, or from 0.82
    with a lead of 0.08 over the next.

    Distinct phrases that equal a value join by key. Only the others are scored, against the values that share a pair of
    neighbouring characters, or a token of one character; a text of one character meets all that have it. That leaves out
    no link: a ratio of 0.82 over S characters leaves at most 0.18 S of them unmatched, so at least 0.41 S matched ones lie
    in at most 0.18 S + 1 runs, and one run has two characters or is a whole token of one; and what holds another text
    holds its pairs. There is no cross join, and the dictionary's size is bounded.
    """
    def grams(n: Column, side: str) -> Column:
        letters = F.array_distinct(F.filter(F.split(n, ""), lambda x: x != ""))
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(n) - 1, F.lit(1))), lambda i: F.substring(n, i, 2))
        single = F.filter(F.split(n, " "), lambda t: F.length(t) == 1)
        meant = F.transform(letters, lambda x: F.concat(F.lit("in value " if side == "value" else "in phrase "), x))
        alone = F.when(F.length(n) == 1, F.array(F.concat(F.lit("in phrase " if side == "value" else "in value "), n))).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.concat(pairs, single, meant, alone))

    asked = phrases.select("phrase").distinct().withColumn("norm", normalize_text(F.col("phrase"))).where("norm <> ''")
    exact = asked.join(dictionary, "norm").select("phrase", "column", "value", F.lit(1.0).alias("score"), F.lit(1.0).alias("lead"))
    open_pairs = (
        asked.withColumn("gram", F.explode(grams(F.col("norm"), "phrase"))).select("phrase", "gram")
        .join(dictionary.withColumn("gram", F.explode(grams(F.col("norm"), "value"))).select("column", "value", "gram"), "gram").select("phrase", "column", "value").distinct()
        .join(exact.select("phrase", "column").distinct(), ["phrase", "column"], "left_anti")
    )
    scored = open_pairs.withColumn("score", fuzzy_score(F.col("phrase"), F.col("value")))
    order = Window.partitionBy("phrase", "column").orderBy(F.desc("score"), "value")
    best = scored.withColumns({"_n": F.row_number().over(order), "_next": F.lead("score", 1, 0.0).over(order)}).where("_n = 1")
    fuzzy = best.select("phrase", "column", "value", "score", (F.col("score") - F.col("_next")).alias("lead"))
    good = (F.col("score") >= SURE) | (F.lit(near_miss) & (F.col("score") >= NEAR) & (F.col("lead") >= LEAD))
    return exact.unionByName(fuzzy.where(good)).select("phrase", "column", "value", "score")


def only_column(links: DataFrame, lead: float = COLUMN_LEAD) -> DataFrame:
    """Links of phrases whose best column leads the next by ``lead``; phrases that fit two columns are refused."""
    order = Window.partitionBy("phrase").orderBy(F.desc("score"), "column")
    ranked = links.withColumns({"_n": F.row_number().over(order), "_next": F.lead("score").over(order)})
    return ranked.where((F.col("_n") == 1) & (F.col("_next").isNull() | (F.col("score") - F.col("_next") >= lead))).drop("_n", "_next")


def link_columns(phrases: DataFrame, columns: DataFrame, minimum: float = COLUMN_MINIMUM, lead: float = COLUMN_LEAD) -> DataFrame:
    """(phrase, column, score): the best column name for each phrase, from ``minimum`` on and with a lead over the next.
    columns: the names of one table's profile (checked: at most ``MAX_DISTINCT``), which go to every phrase."""
    names = [r["column"] for r in columns.select("column").distinct().limit(MAX_DISTINCT + 1).collect()]
    if len(names) > MAX_DISTINCT:
        raise ValueError(f"more than {MAX_DISTINCT} columns")
    pairs = phrases.select("phrase").distinct().withColumn("column", F.explode(F.array(*[F.lit(n) for n in sorted(names)])))
    scored = pairs.withColumn("score", fuzzy_score(F.col("phrase"), F.col("column")))
    order = Window.partitionBy("phrase").orderBy(F.desc("score"), "column")
    ranked = scored.withColumns({"_n": F.row_number().over(order), "_next": F.lead("score", 1, 0.0).over(order)})
    return ranked.where((F.col("_n") == 1) & (F.col("score") >= minimum) & (F.col("score") - F.col("_next") >= lead)).drop("_n", "_next")


def ngrams(text: Column, most: int = 4) -> Column:
    """Distinct runs of ``most`` to one tokens of a question, longest first, that hold no stop word."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    tokens = F.filter(F.split(normalize_text(text), " "), lambda t: t != "")

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
        return F.when(F.size(tokens) >= n, F.transform(starts, lambda i: F.slice(tokens, i, n))).otherwise(F.array().cast("array<array<string>>"))

    every = F.flatten(F.array(*[runs(n) for n in range(most, 0, -1)]))
    return F.array_distinct(F.transform(F.filter(every, lambda r: F.size(F.array_intersect(r, stop)) == 0), lambda r: F.array_join(r, " ")))


def first_filters(filters: DataFrame, by: Sequence[str], value: str, position: str) -> DataFrame:
    """Filters of a table of filters without repeats of ``by`` and the normalised value; the first by position stays."""
    norm = normalize_text(F.col(value))
    order = Window.partitionBy(*by, norm).orderBy(position)
    return filters.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
