"""Filters that a question names: values bound to a column by their place, after a preposition, or mentioned anywhere.

All phrases of all questions that could be values are linked to the value dictionary in one join (``linking.link_values``);
what is chosen among them is decided per question, in a fixed order, by one fold over the question's own candidates: each
column takes one value, and what a chosen phrase used up is no mention any more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkqa.functions.scalar import normalize_text
from sparkqa.operators.linking import COLUMN_LEAD, MAX_DISTINCT, NEAR, SURE, link_values
from sparkqa.operators.questions import STOP_WORDS, leftover_tokens
from sparkqa.sources.store import new_path

#: Words of a column's name that do not stand for it alone; what may come between a column word and its value.
WEAK_WORDS = ["id", "ids", "code", "key", "name", "names", "value", "values", "date", "time", "no", "number"]
BEFORE_COLUMN, AFTER_COLUMN, PREPOSITIONS, ENDS = ["of", "the"], ["of", "is", "equals", "equal"], ["for", "in"], ["and", "with"]
MOST_TOKENS, LEAST_ALIAS, LEAST_MENTION = 4, 3, 4

HIT = "struct<score: double, column: string, value: string, norm: string>"
FILTER = "struct<column: string, value: string, score: double, requested: string, form: string>"


def _texts(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def _stored(df: DataFrame, what: str) -> DataFrame:
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _said(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def _split(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda t: t != "")


def column_aliases(dimensions: DataFrame) -> DataFrame:
    """(rank, column, words, first): what a column is called in a question: its whole name, or a token of three letters or
    more that only its name has and that is no weak word; longest first. dimensions: column, of one table (checked: at most
    ``MAX_DISTINCT``, so this goes to every task)."""
    names = dimensions.select("column").distinct().withColumn("norm", normalize_text(F.col("column"))).where("norm <> ''")
    whole = names.select("column", F.col("norm").alias("alias"), F.lit(0).alias("part"))
    tokens = names.select("column", F.explode(F.array_distinct(F.split("norm", " "))).alias("alias")).where((F.length("alias") >= LEAST_ALIAS) & ~F.col("alias").isin(WEAK_WORDS))
    alone = tokens.groupBy("alias").agg(F.min("column").alias("column"), F.count("*").alias("n")).where("n = 1").select("column", "alias", F.lit(1).alias("part"))
    found = whole.unionByName(alone).dropDuplicates(["column", "alias"]).limit(16 * MAX_DISTINCT + 1).collect()
    if len({r.column for r in found}) > MAX_DISTINCT or len(found) > 16 * MAX_DISTINCT:
        raise ValueError(f"more than {MAX_DISTINCT} columns")
    rows = [(i, r.column, r.alias.split(), r.alias.split()[0]) for i, r in enumerate(sorted(found, key=lambda r: (-len(r.alias), r.part, r.column)))]
    return dimensions.sparkSession.createDataFrame(rows, "rank int, column string, words array<string>, first string")


def bound_candidates(asked: DataFrame, aliases: DataFrame) -> DataFrame:
    """(question, rank, column, words, place, phrase): of the first span of each alias, the one to four tokens before and
    after it, shortest first, those before first; what is all stop words is left out."""
    at = asked.select("question", "tokens", F.posexplode("tokens").alias("start", "token")).join(F.broadcast(aliases), F.col("token") == F.col("first"))
    spans = at.where(F.slice("tokens", F.col("start") + 1, F.size("words")) == F.col("words"))
    spans = spans.groupBy("question", "rank").agg(F.min_by(F.struct("start", "tokens", "column", "words"), "start").alias("s")).select("question", "rank", "s.*")
    end = F.col("start") + F.size("words")
    before = F.coalesce(F.array_max(F.transform(F.slice("tokens", 1, F.col("start")), lambda t, i: F.when(~t.isin(BEFORE_COLUMN), i + 1))), F.lit(0))
    skip = F.when(F.get("tokens", end).isin(AFTER_COLUMN), F.when(F.get("tokens", end + 1) == "the", 2).otherwise(1)).otherwise(0)
    placed = spans.withColumns({"_before": before, "_after": end + skip, "_n": F.size("tokens")})
    sides = []
    for size in range(1, MOST_TOKENS + 1):
        sides.append(F.when(F.col("_before") >= size, F.slice("tokens", F.greatest(F.col("_before") - size + 1, F.lit(1)), size)))
        sides.append(F.when(F.col("_n") - F.col("_after") >= size, F.slice("tokens", F.col("_after") + 1, size)))
    telling = F.filter(F.array(*sides), lambda c: c.isNotNull() & (F.size(F.array_except(c, _texts(STOP_WORDS))) > 0))
    phrases = F.array_distinct(F.transform(telling, _said))
    return placed.select("question", "rank", "column", "words", F.posexplode(phrases).alias("place", "phrase"))


def preposition_candidates(asked: DataFrame, names: Sequence[str]) -> DataFrame:
    """(question, rank, whole, cut): what follows the first "for" and the first "in", up to "and" or "with"; cut: without a
    leading column name. names: normalised."""
    leading = "|".join(n for n in sorted(names, key=lambda n: (-len(n), n)) if n)
    out = []
    for p in PREPOSITIONS:
        rest = F.regexp_extract("norm", rf"\b{p}\s+(?:the\s+)?(.+)$", 1)
        whole = F.trim(F.element_at(F.split(rest, rf"\b(?:{'|'.join(ENDS)})\b", 2), 1))
        cut = F.trim(F.regexp_replace(whole, rf"^(?:{leading}) ", "")) if leading else whole
        out.append(F.struct(F.lit(PREPOSITIONS.index(p)).alias("rank"), whole.alias("whole"), cut.alias("cut")))
    return asked.select("question", F.inline(F.array(*out))).where("whole <> ''")


def mention_candidates(asked: DataFrame, column_words: Sequence[str]) -> DataFrame:
    """(question, rank, phrase): runs of four to one tokens of a question without its stop words, longest first, that are no
    word of a column."""
    kept = F.filter("tokens", lambda t: ~F.array_contains(_texts(STOP_WORDS), t))

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size("_kept") - (n - 1), F.lit(1)))
        return F.when(F.size("_kept") >= n, F.transform(starts, lambda i: _said(F.slice("_kept", i, n)))).otherwise(F.array().cast("array<string>"))

    every = F.array_distinct(F.concat(*[runs(n) for n in range(MOST_TOKENS, 0, -1)]))
    return asked.withColumn("_kept", kept).select("question", F.posexplode(F.array_except(every, _texts(column_words))).alias("rank", "phrase"))


def _only(hits: Column, used: Column) -> Column:
    """The best hit among columns not used yet, if it leads the next by enough. hits: best first."""
    free = F.filter(hits, lambda h: ~F.array_contains(used, h["column"]))
    best, second = F.get(free, F.lit(0)), F.get(free, F.lit(1))
    return F.when(F.size(free) == 1, best).when((F.size(free) > 1) & (best["score"] - second["score"] >= COLUMN_LEAD), best)


def _chosen(steps: Column) -> Column:
    """Folds a question's steps, in order, to (used columns, consumed tokens, filters)."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("used"), none.alias("consumed"), F.array().cast(f"array<{FILTER}>").alias("filters"))

    def taken(state: Column, step: Column) -> Column:
        hit = F.coalesce(_only(step["first"], state["used"]), _only(step["second"], state["used"]))
        requested = _split(step["requested"])
        mention = (F.size(F.array_except(requested, state["consumed"])) > 0) & ((hit["norm"] == step["requested"]) | (F.length(step["requested"]) >= LEAST_MENTION) & (hit["score"] >= NEAR))
        fits = hit.isNotNull() & ((step["phase"] < 2) | mention)
        new = F.struct(hit["column"].alias("column"), hit["value"].alias("value"), hit["score"].alias("score"), step["requested"].alias("requested"), step["form"].alias("form"))
        return F.when(fits, F.struct(
            F.array_append(state["used"], hit["column"]).alias("used"),
            F.array_union(state["consumed"], F.concat(_split(hit["norm"]), requested, step["words"])).alias("consumed"),
            F.array_append(state["filters"], new.cast(FILTER)).alias("filters"),
        )).otherwise(state)

    return F.reduce(steps, start, taken)


def resolve_filters(questions: DataFrame, dictionary: DataFrame, columns: DataFrame, text: str = "question") -> DataFrame:
    """``questions`` with filters (array of column, value, score, requested, form) and leftover (tokens that nothing
    explains; a plan that has some is to be refused).

    columns: (column, dimension boolean), all columns of one table; values are looked for in dimensions. dictionary: as
    ``linking.value_dictionary`` gives it. In this order: (1) "bound": values right before or after a column word, longer
    column words first; an exact value wins, the shortest first, else the best one from 0.88; (2) "for" and "in": what
    follows, without a leading column name first; (3) "mention": any run of tokens, longest first. For (2) and (3) one
    column must lead the next by 0.05 and near values count as in ``link_values``. A column takes one value; tokens that are
    all used up are no mention. A null or empty question has no filters; equal questions are resolved once.
    """
    known = columns.select("column", "dimension", normalize_text(F.col("column")).alias("norm")).distinct().limit(MAX_DISTINCT + 1).collect()
    if len(known) > MAX_DISTINCT:
        raise ValueError(f"more than {MAX_DISTINCT} columns")
    names = [r.norm for r in known if r.dimension]
    words = sorted({t for n in names for t in [n, *n.split()]})
    asked = questions.select(F.col(f"`{text}`").alias("question")).distinct().withColumn("norm", normalize_text(F.col("question"))).where("norm <> ''").withColumn("tokens", _split(F.col("norm")))
    asked = _stored(asked, "asked")  # read five times below, so the questions' own source is read once for all

    bound = bound_candidates(asked, column_aliases(columns.where("dimension")))
    after = preposition_candidates(asked, names)
    mentions = mention_candidates(asked, words)
    phrases = bound.select("phrase").unionByName(after.select(F.col("whole").alias("phrase"))).unionByName(after.select(F.col("cut").alias("phrase"))).unionByName(mentions.select("phrase"))
    phrases = phrases.distinct().where(~F.col("phrase").isin(STOP_WORDS))
    hit = F.struct("score", "column", "value", normalize_text(F.col("value")).alias("norm")).cast(HIT)
    links = _stored(link_values(phrases, _stored(dictionary, "dictionary")).select("phrase", "column", "score", hit.alias("hit")), "links")
    no_hits, no_words = F.array().cast(f"array<{HIT}>"), F.array().cast("array<string>")
    best_first = F.array_sort(F.collect_list("hit"), lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["column"] < b["column"], -1).when(a["column"] > b["column"], 1).otherwise(0))
    of_phrase = links.groupBy("phrase").agg(best_first.alias("hits"))  # one a column

    exact = F.col("hit.norm") == F.col("phrase")
    tokens = F.size(F.split("phrase", " "))
    better = F.struct((~exact).alias("a"), F.when(exact, tokens).otherwise(-F.col("score")).alias("b"), F.when(exact, 0).otherwise(tokens).alias("c"), "place")
    one = bound.join(links.where(F.col("score") >= SURE), ["phrase", "column"]).groupBy("question", "rank").agg(F.min_by(F.struct("phrase", "hit", "words"), better).alias("s"))

    def step(phase: int, form: Column, requested: Column, first: Column, second: Column, words: Column) -> Column:
        return F.struct(F.lit(phase).alias("phase"), F.col("rank").cast("int").alias("rank"), form.alias("form"), requested.alias("requested"), first.alias("first"), second.alias("second"), words.alias("words")).alias("step")

    form = F.element_at(_texts(PREPOSITIONS), F.col("rank") + 1)
    by_cut = of_phrase.select(F.col("phrase").alias("cut"), F.col("hits").alias("cut_hits"))
    by_whole = of_phrase.select(F.col("phrase").alias("whole"), F.col("hits").alias("whole_hits"))
    steps = (
        one.select("question", step(0, F.lit("bound"), F.col("s.phrase"), F.array("s.hit"), no_hits, F.col("s.words")))
        .unionByName(after.join(by_cut, "cut", "left").join(by_whole, "whole", "left").where("cut_hits is not null or whole_hits is not null").select("question", step(1, form, F.col("whole"), F.coalesce("cut_hits", no_hits), F.coalesce("whole_hits", no_hits), no_words)))
        .unionByName(mentions.join(of_phrase, "phrase").select("question", step(2, F.lit("mention"), F.col("phrase"), F.col("hits"), no_hits, no_words)))
    )
    chosen = steps.groupBy("question").agg(F.array_sort(F.collect_list("step")).alias("steps")).select("question", _chosen(F.col("steps")).alias("chosen"))  # as long as the question
    none = F.array().cast(f"array<{FILTER}>")
    # what is left over is told once a question too, not once a row
    left = leftover_tokens(F.col("question"), _texts([r.column for r in known]), F.coalesce("chosen.consumed", no_words))
    told = asked.select("question").join(chosen, "question", "left").select(F.col("question").alias("_asked"), F.col("chosen.filters").alias("_filters"), left.alias("_left"))
    out = questions.join(told, F.col(f"`{text}`") == F.col("_asked"), "left")
    return out.select(*[F.col(f"`{c}`") for c in questions.columns], F.coalesce("_filters", none).alias("filters"), F.coalesce("_left", no_words).alias("leftover"))
