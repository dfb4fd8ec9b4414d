"""Labels of a question log: metric, flags, operation class, limits, comparisons, leftover tokens, resolved questions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkqa.functions.scalar import explicit_pair, normalize_text

#: Metric aliases in the order they are tried, and the words of analysis.
METRICS = {
    "revenue": "revenue", "sales": "revenue", "turnover": "revenue", "profit": "profit", "income": "profit", "earnings": "profit",
    "employee": "employee", "employees": "employee", "headcount": "employee", "quantity": "quantity", "volume": "quantity",
    "production": "production", "milk": "milk", "cost": "cost", "price": "price", "margin": "margin",
}
GROWTH = r"(?i)\b(growth|increase|decrease|change|yoy|year over year)\b"
PERCENT = r"(?i)\b(percent(?:age)?(?:\s+(?:increase|decrease|change|growth))?)\b"
FOLLOW_UP = r"(?i)^(and|what about|how about|also|same for)\b"
EXPLICIT = r"(?i)from\s+-?\d+(?:\.\d+)?\s+to\s+-?\d+(?:\.\d+)?"
QUESTION_YEAR = r"\b((?:19|20)\d{2})\b"

#: Words and phrases by operation, and those of grouping, ranking and time.
OPERATIONS = {
    "count": r"how many|count|number of|total number|no\.?\s+of|number",
    "sum": r"total|sum|summed|aggregate|add up|combined|grand total",
    "avg": r"average|avg|mean",
    "min": r"minimum|min|lowest|smallest|least",
    "max": r"maximum|max|highest|largest|greatest|most",
    "distinct_count": r"distinct|unique|how many different",
    "median": r"median",
    "std": r"standard deviation|std deviation|std|volatility",
    "variance": r"variance",
    "correlation": r"correlation|correlated|correlate|association between|how related|relationship",
    "percentage": r"percentage|percent|proportion|share of",
    "ratio": r"ratio|rate relative to|relative to|divided by|per",
    "compare": r"compare|comparison|versus|vs|difference between|difference in|higher than|lower than",
    "trend": r"trend|over time|change over time|changed over time|time series",
}
GROUPING = r"\b(?:by\s+|per\s+|each\s+|for\s+each\b|breakdown (?:by|of)\b|grouped by\b|group by\b|across\b)"
RANKING = r"\b(?:top|bottom|rank|ranking|ranked|best|worst|highest|lowest|largest|smallest)\b"
UPWARD = r"\b(?:top|best|highest|largest)\b"
UPWARD_MORE, DOWNWARD = r"\b(?:top|best|highest|largest|greatest|most)\b", r"\b(?:bottom|worst|lowest|smallest|least)\b"
WORD_LIMITS = {w: i for i, w in enumerate(("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"), 1)}


def metric_of(text: Column) -> Column:
    """The canonical metric of the first alias, in declared order, that a text has as a word; empty without one."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    pick = reduce(lambda w, m: w.when(lowered.rlike(rf"\b{m[0]}\b"), m[1]), list(METRICS.items())[1:], F.when(lowered.rlike(r"\brevenue\b"), "revenue"))
    return pick.otherwise("")


def years_in(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(QUESTION_YEAR), F.lit(1))


def analysis(text: Column, last_metric: Column | None = None, last_start: Column | None = None, last_end: Column | None = None) -> Column:
    """A struct of what a question asks: metric, start_period, end_period, requires_calculation, is_follow_up,
    needs_period, is_ambiguous, missing, required_values. last_*: what the conversation had before (empty: nothing)."""
    empty = F.lit("")
    text = F.trim(F.coalesce(text, empty))
    old_metric, old_start, old_end = (F.coalesce(c, empty) if c is not None else empty for c in (last_metric, last_start, last_end))
    own = metric_of(text)
    metric = F.when(own != "", own).otherwise(old_metric)
    follows = text.rlike(FOLLOW_UP) | ((own == "") & (old_metric != ""))
    grows = text.rlike(GROWTH) | text.rlike(PERCENT)
    explicit = text.rlike(EXPLICIT)
    years = years_in(text)
    n = F.size(years)
    one, kept = F.get(years, F.lit(0)), F.array(old_start, old_end)
    years = (
        F.when((n == 1) & (old_start != "") & ((old_end == "") | (old_end == one)), F.array(old_start, one))
        .when((n == 0) & (old_start != "") & (old_end != "") & (grows | follows), kept).otherwise(years)
    )
    start, end = F.coalesce(F.get(years, F.lit(0)), empty), F.coalesce(F.get(years, F.lit(1)), empty)
    asks = grows & ~explicit
    no_metric, no_period = asks & (metric == ""), asks & (metric != "") & ((start == "") | (end == ""))
    none = F.array().cast("array<string>")
    return F.when(text == "", F.struct(empty.alias("metric"), empty.alias("start_period"), empty.alias("end_period"), F.lit(False).alias("requires_calculation"), F.lit(False).alias("is_follow_up"), F.lit(False).alias("needs_period"), F.lit(True).alias("is_ambiguous"), F.array(F.lit("question")).alias("missing"), none.alias("required_values"))).otherwise(F.struct(
        metric.alias("metric"), start.alias("start_period"), end.alias("end_period"), (grows | explicit).alias("requires_calculation"), follows.alias("is_follow_up"), no_period.alias("needs_period"), no_metric.alias("is_ambiguous"),
        F.when(no_metric, F.array(F.lit("metric"))).when(no_period, F.array(F.lit("period"))).otherwise(none).alias("missing"),
        F.when(asks & (metric != ""), F.when(no_period, F.array(F.concat(metric, F.lit(" start value")), F.concat(metric, F.lit(" end value")))).otherwise(F.array(F.concat(start, F.lit(" "), metric), F.concat(end, F.lit(" "), metric)))).otherwise(none).alias("required_values"),
    ))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once, however often ``then`` names it: as an expression it would be worked
    out again in every branch."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def has(text: Column, operation: str) -> Column:
    return _may_have(text, operation) & text.rlike(rf"\b(?:{OPERATIONS[operation]})\b")


def _may_have(text: Column, operation: str) -> Column:
    """Whether a text holds how any of the operation's phrases begins, which a match needs and a plain search tells sooner."""
    begins = {re.match(r"[a-z]+(?: [a-z]+)*", phrase).group() for phrase in OPERATIONS[operation].split("|")}
    fewest = sorted(b for b in begins if not any(o != b and o in b for o in begins))
    return reduce(Column.__or__, [F.contains(text, F.lit(b)) for b in fewest])


def operation_of(question: Column) -> Column:
    """The operation class of a question, null when it asks for none.

    Kept as the question service has it: correlation first, then distinct count, percentage, ratio, compare, trend, then
    ranking words, median and spread, and the plain aggregations. A ranking word turns all but correlation into ``top_n``
    (top, best, highest, largest) or ``bottom_n`` (any other, even "rank"); grouping words (also "per") turn the rest into
    grouped operations, those without one into ``group_count``. Ranking words alone are no operation.
    """
    return once(_lowered(question), lambda text: once(_matches(text), lambda found: once(_flags(text), lambda flags: _operation(text, found, flags))))


def _lowered(question: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.coalesce(question, F.lit(""))), r"\s+", " "))


def _matches(text: Column) -> Column:
    """A struct of whether the lower-cased text has an operation's phrases, by operation."""
    return F.struct(*[has(text, op).alias(op) for op in OPERATIONS])


def _flags(text: Column) -> Column:
    return F.struct(text.rlike(RANKING).alias("ranks"), text.rlike(GROUPING).alias("groups"))


def _operation(text: Column, found: Column, flags: Column) -> Column:
    ranks, groups = flags["ranks"], flags["groups"]
    some = reduce(Column.__or__, [found[op] for op in OPERATIONS])
    picked = F.when(found["correlation"], "correlation")
    for op in ("distinct_count", "percentage", "ratio", "compare", "trend"):
        picked = picked.when(found[op], op)
    picked = picked.when(ranks & text.rlike(UPWARD_MORE), "top_n").when(ranks & text.rlike(DOWNWARD), "bottom_n")
    for op in ("median", "std", "variance", "count", "sum", "avg", "max", "min"):
        picked = picked.when(found[op], op)

    def settled(picked: Column) -> Column:
        grouped = F.when(picked.isin("sum", "avg", "min", "max"), F.concat(F.lit("group_"), picked)).otherwise("group_count")
        return F.when(some & picked.isNotNull(), F.when(picked == "correlation", picked).when(ranks, F.when(text.rlike(UPWARD), "top_n").otherwise("bottom_n")).when(groups, grouped).otherwise(picked))

    return once(picked, settled)


#: How sure a class is; phrases of time; words of a question about data. A class not named has 0.9.
CONFIDENCE = {
    "correlation": 0.98, "top_n": 0.96, "bottom_n": 0.96, "grouped": 0.96, "percentage": 0.97, "ratio": 0.97, "compare": 0.95, "trend": 0.96, "count": 0.97, "sum": 0.97,
    "avg": 0.97, "min": 0.96, "max": 0.96, "distinct_count": 0.98, "median": 0.98, "std": 0.98, "variance": 0.98,
}
UNRESOLVED, SEMANTIC, DEFAULT_LIMIT = 0.55, 0.80, 5
TEMPORAL = r"\b(?:over time|by month|monthly|by year|yearly|annually|by quarter|quarterly|by week|weekly|by day|daily|between|from|until|before|after)\b"
DATA_WORDS = r"\b(?:what|which|show|list|give|data|report|values?|figures?)\b"


def intent_of(question: Column) -> Column:
    """A struct of how a question is to be answered: intent (``structured``, ``semantic``, ``unknown`` for an empty one),
    operation, confidence, top (of ranking classes), grouped, ranked, temporal, and matches: every operation whose phrases
    the question has, in declared order, with those phrases and the score that the operation alone would have.

    The class is ``operation_of``'s, which settles conflicts between matches; its confidence follows from the class that
    came out (ranking and grouping before the operation they stand with). Grouping words without an operation count as an
    unresolved question about data, if any of its words says so."""
    none = F.array().cast("array<string>")
    all_of = lambda text, op: F.array_distinct(F.regexp_extract_all(text, F.lit(rf"\b(?:{OPERATIONS[op]})\b"), F.lit(0)))
    phrases = lambda text: F.struct(*[F.when(_may_have(text, op), all_of(text, op)).otherwise(none).alias(op) for op in OPERATIONS])
    matched = lambda said: F.struct(*[(F.size(said[op]) > 0).alias(op) for op in OPERATIONS])
    return once(_lowered(question), lambda text: once(phrases(text), lambda said: once(matched(said), lambda found: once(_flags(text), lambda flags: once(
        _operation(text, found, flags), lambda operation: _intent(question, text, said, flags, operation))))))


def _intent(question: Column, text: Column, said: Column, flags: Column, operation: Column) -> Column:
    ranks, groups, timed = flags["ranks"], flags["groups"], text.rlike(TEMPORAL)
    found = F.array(*[F.struct(F.lit(op).alias("operation"), said[op].alias("phrases"), F.lit(CONFIDENCE[op]).alias("score")) for op in OPERATIONS])
    ranked = operation.isin("top_n", "bottom_n")
    grouped = operation.startswith("group_")
    open_data = operation.isNull() & groups & text.rlike(DATA_WORDS)
    scores = F.create_map(*[x for op, c in CONFIDENCE.items() for x in (F.lit(op), F.lit(c))])
    confidence = (
        F.when(text == "", 0.0).when(open_data, UNRESOLVED).when(operation.isNull(), SEMANTIC).when(grouped, CONFIDENCE["grouped"]).otherwise(F.coalesce(F.try_element_at(scores, operation), F.lit(0.9)))
    )
    plain = operation.isin("count", "sum", "avg", "min", "max", "distinct_count", "median", "std", "variance")
    return F.struct(
        F.when(text == "", "unknown").when(operation.isNotNull() | open_data, "structured").otherwise("semantic").alias("intent"), operation.alias("operation"), confidence.alias("confidence"),
        F.when(ranked, F.coalesce(limit_of(question), F.lit(DEFAULT_LIMIT))).alias("top"), F.coalesce(grouped | open_data, F.lit(False)).alias("grouped"), F.coalesce(ranked & ranks, F.lit(False)).alias("ranked"),
        F.coalesce((operation == "trend") | ((grouped | plain) & timed), F.lit(False)).alias("temporal"), F.filter(found, lambda m: F.size(m["phrases"]) > 0).alias("matches"),
    )


def limit_of(question: Column) -> Column:
    """The limit after top, bottom, first or last: 1 to 1000, or one to ten; null without one."""
    text = F.lower(F.coalesce(question, F.lit("")))
    number = F.nullif(F.regexp_extract(text, r"\b(?:top|bottom|first|last)\s+(\d{1,4})\b", 1), F.lit("")).cast("int")
    word = F.regexp_extract(text, rf"\b(?:top|bottom|first|last)\s+({'|'.join(WORD_LIMITS)})\b", 1)
    words = F.create_map(*[x for w, i in WORD_LIMITS.items() for x in (F.lit(w), F.lit(i))])
    return F.coalesce(F.when(number.between(1, 1000), number), F.try_element_at(words, word))


#: Phrases of comparison by operation, in the order they are tried.
COMPARISONS = [
    ("gte", r"greater than or equal to|at least|no less than|>="), ("lte", r"less than or equal to|at most|no more than|<="),
    ("gt", r"greater than|more than|above|over|exceeds|>"), ("lt", r"less than|lower than|below|under|<"),
]


def comparison_of(question: Column) -> Column:
    """struct(column_text, op, value) of the first comparison with a number, null without one. Read before the text is
    normalised, so signs and decimals count."""
    text = F.lower(F.coalesce(question, F.lit("")))
    found = []
    for op, words in COMPARISONS:
        pattern = rf"([a-z][a-z0-9_ ]*?)\s*(?:is\s+)?(?:{words})\s*(-?\d+(?:,\d{{3}})*(?:\.\d+)?)"
        value = F.replace(F.regexp_extract(text, pattern, 2), F.lit(","), F.lit(""))
        found.append(F.when(value != "", F.struct(F.trim(F.regexp_extract(text, pattern, 1)).alias("column_text"), F.lit(op).alias("op"), value.try_cast("double").alias("value"))))
    return F.coalesce(*found)


#: Words of a question that name no value.
STOP_WORDS = [
    "sum", "total", "count", "average", "avg", "mean", "min", "max", "median", "std", "variance", "correlation", "what", "whats", "is", "the", "of",
    "a", "an", "give", "me", "please", "calculate", "find", "show", "how", "many", "much", "and", "or", "for", "in", "on", "to", "from", "by", "with",
    "as", "it", "this", "that", "all", "rows", "row", "value", "values", "number", "amount", "where", "equals", "equal", "get", "tell", "greater",
    "least", "most", "above", "below", "under", "than", "between", "over", "at", "combined", "add", "up", "compute", "report", "list", "sold", "sale",
    "generated", "earned", "booked", "recorded", "reported", "achieved", "data", "table", "sheet", "file", "excel", "csv", "xlsx",
]


def leftover_tokens(question: Column, names: Column, consumed: Column) -> Column:
    """Tokens of a question that no stop word, column word (also its plural) or used value explains, longer than two
    characters and not digits alone. What is left over refuses a plan rather than being ignored. names, consumed: arrays."""
    words = F.flatten(F.transform(names, lambda n: F.split(normalize_text(n), " ")))
    plural = lambda w: F.array_union(w, F.transform(w, lambda x: F.concat(x, F.lit("s"))))
    many = lambda w: F.array_union(w, F.transform(F.filter(w, lambda x: x.endswith("y")), lambda x: F.concat(F.regexp_replace(x, "y$", ""), F.lit("ies"))))
    used = F.flatten(F.transform(consumed, lambda v: F.split(normalize_text(v), " ")))
    tokens = F.split(normalize_text(question), " ")
    told = once(words, lambda w: once(plural(w), lambda p: F.array_union(F.array(*[F.lit(s) for s in STOP_WORDS]), F.array_union(many(p), used))))
    return once(told, lambda known: F.filter(tokens, lambda t: (F.length(t) >= 3) & ~t.rlike(r"^\d+$") & ~F.array_contains(known, t)))


#: How a question is put once its slots are known; the first row that fits. A row needs every name before the
#: bar and none after it. Slots: metric, start and end (what the conversation carries over included), own_end (what the
#: text itself or its reading gives). Facts: replies (the text answers a clarification), growth ("growth" in question or
#: reply), follows (a follow-up), rises ("growth" or "increase" in the text), calculates.
RESOLUTIONS = [
    ("replies growth metric start end", "What was the {metric} growth from {start} to {end}?"),
    ("replies growth metric", "What was the {metric} growth?"),
    ("replies", "{joined}"),
    ("follows rises metric start end", "What was the {metric} growth from {start} to {end}?"),
    ("follows metric end | start", "What was the {metric} in {end}?"),
    ("follows metric start | own_end", "What was the {metric} in {start}?"),
    ("calculates own_metric own_start own_end", "What was the {own_metric} growth from {own_start} to {own_end}?"),
    ("", "{plain}"),
]


def needs(row: str) -> tuple[list[str], list[str]]:
    """The names that a row of RESOLUTIONS needs, and those that it must not have."""
    present, _, absent = row.partition("|")
    return present.split(), absent.split()


def resolution(facts: dict[str, Column], slots: dict[str, Column]) -> Column:
    """RESOLUTIONS as one expression. A fact that is not given is false, a slot that is not given is empty."""
    holds = lambda name: facts[name] if name in facts else slots[name] != "" if name in slots else F.lit(False)

    def filled(template: str) -> Column:
        parts = re.split(r"\{(\w+)\}", template)  # texts and names in turn
        return F.concat(*[slots[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])

    chosen = None
    for row, template in RESOLUTIONS[:-1]:
        present, absent = needs(row)
        if any(n not in facts and n not in slots for n in present):
            continue
        when = reduce(Column.__and__, [*(holds(n) for n in present), *(~holds(n) for n in absent)])
        chosen = F.when(when, filled(template)) if chosen is None else chosen.when(when, filled(template))
    return chosen.otherwise(filled(RESOLUTIONS[-1][1]))


def plain(text: Column) -> Column:
    """Trimmed, blanks squeezed, null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def resolved_question(question: Column, told: Column, last_start: Column, last_end: Column, last_metric: Column) -> Column:
    """A question (with its ``analysis`` struct) as one that stands alone, by RESOLUTIONS and what the conversation had last."""
    pick = lambda own, last: F.when(own != "", own).otherwise(F.coalesce(last, F.lit("")))
    own = {"own_metric": told["metric"], "own_start": told["start_period"], "own_end": told["end_period"]}
    slots = own | {"metric": pick(told["metric"], last_metric), "start": pick(told["start_period"], last_start), "end": pick(told["end_period"], last_end), "plain": plain(question)}
    return resolution({"follows": told["is_follow_up"], "calculates": told["requires_calculation"], "rises": F.lower(question).rlike("growth|increase")}, slots)


def reading(text: Column) -> Column:
    """What a turn's text says by itself, for the conversation's machine: text, metric (its place among METRICS), years,
    whether it grows, holds a pair of values, opens as a follow-up, says growth, rises, asks; number of words."""
    bare = plain(text)
    lowered = F.lower(bare)
    places = F.array(*[F.when(lowered.rlike(rf"\b{alias}\b"), i) for i, alias in enumerate(METRICS)])
    return F.struct(
        bare.alias("text"), F.array_min(places).alias("metric"), years_in(bare).alias("years"), (bare.rlike(GROWTH) | bare.rlike(PERCENT)).alias("grows"), bare.rlike(EXPLICIT).alias("pair"),
        bare.rlike(FOLLOW_UP).alias("opens"), F.contains(lowered, F.lit("growth")).alias("growth"), lowered.rlike("growth|increase").alias("rises"), bare.endswith("?").alias("asks"),
        F.when(bare == "", 0).otherwise(F.size(F.split(bare, " "))).alias("words"),
    )


__all__ = ["analysis", "comparison_of", "explicit_pair", "leftover_tokens", "limit_of", "metric_of", "operation_of", "reading", "resolution", "resolved_question"]
