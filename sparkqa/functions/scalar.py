"""Column functions: normalised text, coerced numbers and dates, number facts in texts, calculations, formats.

All are built from Spark's own functions, so they stay inside code generation. Divisions by zero and unreadable values
give null, never an error, under ANSI mode as well.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
#: Letters whose full case folding is more than lower case.
FOLDS = [("ß", "ss"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl")]
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd.MM.yyyy")


def normalize_text(value: Column) -> Column:
    """Case-folded, ``&`` as " and ", every run outside a-z0-9 as one blank, trimmed. Null stays null."""
    text = F.lower(value.cast("string"))
    for letter, folded in FOLDS:
        text = F.replace(text, F.lit(letter), F.lit(folded))
    return F.trim(F.regexp_replace(F.replace(text, F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def to_number(value: Column) -> Column:
    """A double where the text is a plain number, else null."""
    text = value.cast("string")
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def number_of(df: DataFrame, name: str) -> Column:
    """``to_number`` of a column; numeric columns are only cast (NaN as null), so nothing is parsed and filters push down."""
    kind = dict(df.dtypes)[name]
    column = F.col(f"`{name}`")
    if kind in ("double", "float"):
        return F.when(~F.isnan(column), column.cast("double"))
    if kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal"):
        return column.cast("double")
    return to_number(column)


def to_date(value: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """A timestamp by the first format that reads the text; texts of digits alone are never dates."""
    text = F.trim(value.cast("string"))
    parsed = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])
    return F.when(~text.rlike(r"^\d+$"), parsed)


def clean_number(value: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def is_amount(text: Column) -> Column:
    """Is this an amount: commas, one sign and one ``$`` aside, a number?"""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), ",", ""), r"^([+-]?)\$?", "$1")
    return F.coalesce(bare.rlike(NUMBER), F.lit(False))


def token_overlap(query: Column, candidate: Column) -> Column:
    """Share of the candidate's distinct tokens that the query has too; 0 without tokens."""
    q, c = (F.array_distinct(F.filter(F.split(normalize_text(x), " "), lambda t: t != "")) for x in (query, candidate))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, c)), F.size(c)), F.lit(0.0))


# Calculations

def percentage_change(old: Column, new: Column) -> Column:
    return F.try_divide(new - old, old) * 100


def difference(new: Column, old: Column) -> Column:
    return new - old


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator, denominator)


def average(values: Column) -> Column:
    """Mean of an array; null when it is empty."""
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))


def margin(profit: Column, revenue: Column) -> Column:
    return F.try_divide(profit, revenue) * 100


def verify_calculation(operation: Column, a: Column, b: Column, result: Column) -> Column:
    """Does the stored result follow from its inputs within 1e-6? a, b: old and new value (difference: new, old), numerator
    and denominator, or profit and revenue. Unknown operations and impossible formulas are not verified."""
    expected = (
        F.when(operation.isin("percentage_change", "growth", "growth_rate"), percentage_change(a, b))
        .when(operation == "difference", difference(a, b))
        .when(operation == "ratio", ratio(a, b))
        .when(operation == "margin", margin(a, b))
    )
    return F.coalesce(F.abs(expected - result) <= 1e-6, F.lit(False))


#: Words that announce a change, and the form of a pair of values.
CHANGE_WORDS = ("percent", "percentage", "growth", "increase", "decrease", "change")
FROM_TO = r"(?i)(?:from\s+)?(-?\d+(?:\.\d+)?)\s+(?:to|and)\s+(-?\d+(?:\.\d+)?)"


def explicit_pair(text: Column, which: int) -> Column:
    """The first (1) or second (2) value of the first "[from] A to|and B" in a text."""
    return F.nullif(F.regexp_extract(text, FROM_TO, which), F.lit("")).try_cast("double")


def explicit_percentage(text: Column) -> Column:
    """Percentage change of the explicit pair, six decimals, where a word of change is there."""
    told = reduce(Column.__or__, [F.contains(F.lower(text), F.lit(w)) for w in CHANGE_WORDS])
    return F.when(told, F.round(percentage_change(explicit_pair(text, 1), explicit_pair(text, 2)), 6))


# Number facts in texts

#: Years, and numbers with thousands commas that touch no word character.
YEAR = r"\b((?:19|20)\d{2})\b"
TEXT_NUMBER = r"(?<![\w])(-?\d{1,3}(?:,\d{3})*(?:\.\d+)?|-?\d+(?:\.\d+)?)(?![\w])"
ANY_NUMBER = r"-?\d+(?:,\d{3})*(?:\.\d+)?"


def years_of(text: Column) -> Column:
    """Years 19xx and 20xx of a text, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(YEAR), F.lit(1)))


def numbers_of(text: Column, pattern: str = TEXT_NUMBER) -> Column:
    """Numbers of a text, thousands commas removed, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    return F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit("")).cast("double"))


def period_options(years: Column) -> Column:
    """``y1-y2`` of neighbouring years, sorted."""
    ordered = F.array_sort(F.array_distinct(years))
    n = F.size(ordered)
    pairs = F.zip_with(F.slice(ordered, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(ordered, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit("-"), b))
    return F.when(n >= 2, pairs).otherwise(F.array().cast("array<string>"))


# Formats

def format_number(value: Column, decimals: int = 4) -> Column:
    """Thousands separators, at most ``decimals`` decimals, no trailing zeros."""
    text = F.format_number(clean_number(value), decimals)
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def table_row(columns: Sequence[str]) -> Column:
    """A row as pipe text, nulls as empty cells."""
    return F.concat_ws(" | ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns])


def period_question(options: Column) -> Column:
    """The question that asks for one of several periods."""
    n = F.size(options)
    some = F.array_join(F.slice(options, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return (
        F.when(n <= 0, "Which time period do you mean?")
        .when(n == 1, F.concat(F.lit("Do you mean "), F.element_at(options, 1), F.lit("?")))
        .otherwise(F.concat(F.lit("Which period do you mean: "), some, F.lit(", or "), F.try_element_at(options, F.lit(-1)), F.lit("?")))
    )


def options_of(question: Column) -> Column:
    """Options named in a clarification question."""
    text = F.trim(F.coalesce(question, F.lit("")))
    text = F.when(F.contains(text, F.lit(":")), F.regexp_replace(text, r"^[^:]*:", "")).otherwise(text)
    text = F.replace(F.replace(text, F.lit("Do you mean"), F.lit("")), F.lit("?"), F.lit(""))
    parts = F.transform(F.split(F.replace(text, F.lit(" or "), F.lit(", ")), ","), lambda p: F.regexp_replace(p, r"^[ .]+|[ .]+$", ""))
    return F.filter(parts, lambda p: p != "")


def confidence_blend(retrieval: Column, completeness: Column, calculation_ok: Column) -> Column:
    """0.35 retrieval + 0.35 completeness + 0.15 for a right calculation + 0.15, at most 1."""
    return F.least(F.lit(1.0), 0.35 * retrieval + 0.35 * completeness + F.when(calculation_ok, 0.15).otherwise(0.0) + 0.15)


def document_id(filename: Column) -> Column:
    """``uploaded_`` and the file name in lower case, runs outside a-z0-9. as ``_``, dots as ``_``."""
    slug = F.regexp_replace(F.lower(F.trim(filename)), "[^a-z0-9.]+", "_")
    return F.concat(F.lit("uploaded_"), F.replace(F.trim(slug, F.lit("_")), F.lit("."), F.lit("_")))


def table_id(document: Column, sheet: Column) -> Column:
    """The document's id, and ``__sheet_`` with the sheet's name where there is one."""
    slug = F.trim(F.regexp_replace(F.lower(F.trim(sheet)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(F.coalesce(sheet, F.lit("")) == "", document).otherwise(F.concat(document, F.lit("__sheet_"), slug))
