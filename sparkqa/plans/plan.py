"""Declared plans over one table: validation, filters with their trace, and the 21 operations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from decimal import ROUND_FLOOR, Decimal, InvalidOperation
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkqa.functions.scalar import clean_number, normalize_text, number_of, to_date, to_number

#: Internal columns, and the operations by what they need.
INTERNAL = ("__source_file", "__document_id", "__sheet_name", "__row_number", "__table_id")
SCALAR = ("sum", "avg", "min", "max", "median", "std", "variance")
GROUPED = ("group_count", "group_sum", "group_avg", "group_min", "group_max")
RANKING = ("top_n", "bottom_n")
OTHER = ("count", "distinct_count", "correlation", "percentage", "ratio", "compare", "trend")
OPERATIONS = (*SCALAR, *GROUPED, *RANKING, *OTHER)
FILTER_OPS = ("eq", "ne", "contains", "gt", "gte", "lt", "lte")
DEFAULT_LIMIT, MAX_LIMIT = 5, 1000


class PlanError(ValueError):
    """A plan that does not fit its table: refused, never answered with a part of it ignored."""


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: object


@dataclass(frozen=True)
class Plan:
    operation: str
    target: str | None = None
    targets: Sequence[str] = ()
    group_by: Sequence[str] = ()
    filters: Sequence[Filter] = field(default_factory=tuple)
    limit: int | None = None
    time: str | None = None
    grain: str | None = None


def validate(plan: Plan, columns: Sequence[str], numeric: Sequence[str]) -> None:
    """Raises PlanError unless the plan fits. columns: those of the table; numeric: those that can be added up."""
    def need(ok: bool, why: str) -> None:
        if not ok:
            raise PlanError(why)

    need(plan.operation in OPERATIONS, f"unknown operation {plan.operation}")
    named = [c for c in (plan.target, plan.time, *plan.targets, *plan.group_by, *(f.column for f in plan.filters)) if c]
    need(not (missing := sorted(set(named) - set(columns))), f"unknown columns {missing}")
    for f in plan.filters:
        need(f.op in FILTER_OPS, f"unknown filter {f.op}")
        if f.op in ("gt", "gte", "lt", "lte"):
            need(_float(f.value) is not None, f"{f.column} {f.op} needs a number")
    if plan.operation in SCALAR or plan.operation in ("percentage", "group_sum", "group_avg", "group_min", "group_max"):
        need(plan.target in numeric, "a numeric target is needed")
    if plan.operation == "distinct_count":
        need(plan.target is not None, "a target is needed")
    if plan.operation in ("correlation", "ratio"):
        need(len(plan.targets) == 2 and all(t in numeric for t in plan.targets), "two numeric columns are needed")
    if plan.operation == "compare":
        need(plan.target in numeric or (len(plan.targets) in (1, 2) and all(t in numeric for t in plan.targets)), "one or two numeric columns are needed")
    if plan.operation in GROUPED:
        need(len(plan.group_by) > 0, "a group key is needed")
    if plan.operation in RANKING:
        need(plan.target in numeric, "a numeric target is needed")
        need(plan.limit is None or 1 <= plan.limit <= MAX_LIMIT, f"the limit goes from 1 to {MAX_LIMIT}")
    if plan.operation == "trend":
        need(plan.time is not None and plan.target in numeric, "a time column and a numeric target are needed")


def _float(value: object) -> float | None:
    try:
        return float(str(value).replace(",", ""))
    except ValueError:
        return None


def _exact(value: object) -> Decimal | None:
    """A finite number as it is written."""
    try:
        number = Decimal(str(value).replace(",", ""))
    except InvalidOperation:
        return None
    return number if number.is_finite() else None


def compared(column: Column, kind: str, op: str, value: object) -> Column | None:
    """A numeric column against a number in the column's own type, so that the comparison is exact and reaches the scan; null
    cells give null. None where the type cannot hold the number: then doubles are compared."""
    number = _exact(value)
    if number is None:
        return None
    if kind in ("tinyint", "smallint", "int", "bigint"):
        floor = int(number.to_integral_value(ROUND_FLOOR))
        if not -(1 << 63) <= floor < 1 << 63:
            return None
        if number != floor:  # between two whole numbers
            never = F.when(column.isNotNull(), False)
            return {"eq": never, "gt": column > floor, "gte": column > floor, "lt": column <= floor, "lte": column <= floor}[op]
        v = F.lit(floor)
    elif kind.startswith("decimal"):
        digits, scale = (int(x) for x in kind[8:-1].split(","))
        if number.normalize().as_tuple().exponent < -scale or abs(number) >= Decimal(10) ** (digits - scale):
            return None
        v = F.lit(number).cast(kind)
    else:
        return None
    return {"eq": column == v, "gt": column > v, "gte": column >= v, "lt": column < v, "lte": column <= v}[op]


def _is_number(kind: str) -> bool:
    return kind in ("double", "float", "tinyint", "smallint", "int", "bigint") or kind.startswith("decimal")


def predicate(df: DataFrame, f: Filter) -> Column:
    """A filter as a condition. Text compares normalised; ``ne`` lets nulls pass, all others refuse them; a number
    compares as a number where column and operand are both numeric."""
    column, kind = F.col(f"`{f.column}`"), dict(df.dtypes)[f.column]
    if f.op in ("gt", "gte", "lt", "lte"):
        own = compared(column, kind, f.op, f.value)
        if own is not None:
            return own
        v = F.lit(_float(f.value))
        if kind in ("double", "float"):  # NaN counts as greatest, and is no number here
            return {"gt": (column > v) & ~F.isnan(column), "gte": (column >= v) & ~F.isnan(column), "lt": column < v, "lte": column <= v}[f.op]
        x = number_of(df, f.column)
        return {"gt": x > v, "gte": x >= v, "lt": x < v, "lte": x <= v}[f.op]
    if _is_number(kind) and _float(f.value) is not None and f.op != "contains":
        own = compared(column, kind, "eq", f.value)
        same = own if own is not None else column == F.lit(_float(f.value))
        return same if f.op == "eq" else ~F.coalesce(same, F.lit(False))
    text, wanted = normalize_text(column), normalize_text(F.lit(str(f.value)))
    if f.op == "contains":
        return F.contains(text, wanted)
    return text == wanted if f.op == "eq" else ~text.eqNullSafe(wanted)


def apply_filters(df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    return reduce(lambda d, f: d.where(predicate(df, f)), filters, df)


def filter_trace(df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """Per filter the rows left after it and those before, in one pass: step, column, op, value, rows_after."""
    spark = df.sparkSession
    counts, so_far = [F.count("*").alias("n0")], F.lit(True)
    for i, f in enumerate(filters, 1):
        so_far = so_far & F.coalesce(predicate(df, f), F.lit(False))
        counts.append(F.count_if(so_far).alias(f"n{i}"))
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(f.column).alias("column"), F.lit(f.op).alias("op"), F.lit(str(f.value)).alias("value"), F.col(f"n{i}").alias("rows_after")) for i, f in enumerate(filters, 1)])
    if not filters:
        return spark.createDataFrame([], "step int, column string, op string, value string, rows_after long")
    return df.agg(*counts).select(F.inline(steps))


def visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in INTERNAL]


def sample_sources(df: DataFrame, rows: int = 5, columns: int = 8) -> DataFrame:
    """The first rows by row number, the first visible columns as text, nulls kept."""
    return df.orderBy("__row_number").limit(rows).select(*[F.col(f"`{c}`").cast("string").alias(c) for c in visible(df)[:columns]])


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns whose type is numeric, and text columns (whose numbers count and whose other values drop out)."""
    return [c for c, kind in df.dtypes if c not in INTERNAL and (_is_number(kind) or kind == "string")]


def correlation(a: Column, b: Column) -> Column:
    """Pearson's over pairs with both values; null for fewer than two pairs or no variance."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.when((F.count(x) >= 2) & (F.stddev_samp(x) > 0) & (F.stddev_samp(y) > 0), F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y)))


def refusals(df: DataFrame, plans: dict[str, Plan], strict: bool = True) -> DataFrame:
    """Per named plan over one table: plan, accepted, reason (empty when accepted) and rows, those that its filters leave
    (null when refused). All accepted plans' rows are counted in one pass, and so are, when strict, all targets' numbers."""
    known, numeric = df.columns, numeric_columns(df)
    reasons, fits = {}, {}
    for name, plan in plans.items():
        try:
            validate(plan, known, numeric)
            fits[name] = plan
        except PlanError as e:
            reasons[name] = str(e)
    passes = {n: reduce(Column.__and__, [F.coalesce(predicate(df, f), F.lit(False)) for f in p.filters], F.lit(True)) for n, p in fits.items()}
    asked = {n: [t for t in (list(p.targets) or [p.target]) if t] if p.operation not in ("count", "distinct_count", "group_count") else [] for n, p in fits.items()}
    counts = {f"rows_{i}": F.count_if(passes[n]) for i, n in enumerate(fits)}
    for i, n in enumerate(fits):
        counts |= {f"target_{i}_{j}": F.count_if(passes[n] & number_of(df, t).isNotNull()) for j, t in enumerate(asked[n])}
    seen = df.agg(*[c.alias(k) for k, c in counts.items()]).first() if counts else None
    rows = []
    for name in plans:
        i = list(fits).index(name) if name in fits else None
        if i is not None and strict and any(seen[f"target_{i}_{j}"] == 0 for j in range(len(asked[name]))):
            reasons[name], i = "a target has no numbers", None
        rows.append((name, i is not None, reasons.get(name, ""), seen[f"rows_{i}"] if i is not None else None))
    return df.sparkSession.createDataFrame(rows, "plan string, accepted boolean, reason string, rows long")


def run_plan(df: DataFrame, plan: Plan, strict: bool = False) -> DataFrame:
    """The plan's result.

    Scalars give one row with ``value``; grouped operations their keys and ``value``; compare ``first, second,
    difference`` or ``min, max, difference``; trend ``period`` (yyyy-MM-dd) and ``value``, one row per exact timestamp or
    per ``grain``. Null keys form a group. Rankings over groups drop null targets, break ties by key (nulls last), and
    over rows by ``__row_number``. strict: also refuse a numeric target without a single number (one small job).
    """
    validate(plan, df.columns, numeric_columns(df))
    targets = list(plan.targets) or ([plan.target] if plan.target else [])
    if strict and plan.operation not in ("count", "distinct_count", "group_count"):
        seen = apply_filters(df, plan.filters).agg(*[F.count(number_of(df, t)).alias(t) for t in targets]).first()
        if any(seen[t] == 0 for t in targets):
            raise PlanError("a target has no numbers")
    if plan.operation == "percentage":
        x = number_of(df, plan.target)
        passes = reduce(Column.__and__, [F.coalesce(predicate(df, f), F.lit(False)) for f in plan.filters], F.lit(True))
        return df.agg(clean_number(F.try_divide(F.sum(F.when(passes, x)), F.sum(x)) * 100).alias("value"))
    rows = apply_filters(df, plan.filters)
    x = number_of(df, targets[0]) if targets and plan.operation != "distinct_count" else None
    op = plan.operation
    if op == "count":
        return rows.agg(F.count("*").alias("value"))
    if op == "distinct_count":
        return rows.agg(F.count_distinct(F.col(f"`{plan.target}`")).alias("value"))
    if op == "median":
        return median(rows.select(x.alias("x")))
    if op in SCALAR:
        return rows.agg(clean_number(_aggregate(op)(x)).alias("value"))
    if op in GROUPED:
        value = F.count("*") if op == "group_count" else clean_number(_aggregate(op.removeprefix("group_"))(x))
        return rows.groupBy(*plan.group_by).agg(value.alias("value"))
    if op in RANKING:
        return _ranked(rows, plan, x)
    if op == "correlation":
        return rows.agg(correlation(number_of(df, targets[0]), number_of(df, targets[1])).alias("value"))
    if op == "ratio":
        return rows.agg(F.avg(F.try_divide(x, number_of(df, targets[1]))).alias("value"))
    if op == "compare":
        if len(targets) == 2:
            a, b = F.sum(x), F.sum(number_of(df, targets[1]))
            return rows.agg(a.alias("first"), b.alias("second"), (a - b).alias("difference"))
        return rows.agg(F.min(x).alias("min"), F.max(x).alias("max"), (F.max(x) - F.min(x)).alias("difference"))
    return _trend(rows, plan, x)


#: Ranks that Spark's percentile sketch tells apart: it is off by at most one in so many of the rows. Values that are put in
#: order at last, at most (unless no bracket can part them).
SKETCHED, MAX_ORDERED = 10_000, 100_000


def median(numbers: DataFrame, sketched: int = SKETCHED, most: int = MAX_ORDERED) -> DataFrame:
    """The exact median of column ``x`` (nulls left out; the mean of the two middle ones) as ``value``.

    A sketch brackets the middle, to about 4 in ``sketched`` rows, and the bracket is sketched again until it holds at most
    ``most`` different values: two passes over the numbers a round, and one round does for a billion rows. Only these values
    are counted one by one and put in order, so what one task sorts does not grow with the data."""
    there = numbers.where("x is not null")
    share = 2 / sketched
    n, (low, high) = there.agg(F.count("*"), F.coalesce(F.percentile_approx("x", [0.5 - share, 0.5 + share], sketched), F.array(F.lit(0.0), F.lit(0.0)).cast("array<double>"))).first()
    ranks, last, held = ((n - 1) // 2, n // 2), None, None
    while True:
        inside = there.where(F.col("x").between(low, high))
        below, within, values = there.agg(F.count_if(F.col("x") < low), F.count_if(F.col("x").between(low, high)), F.approx_count_distinct(F.when(F.col("x").between(low, high), F.col("x")))).first()
        if n and not below <= ranks[0] <= ranks[1] < below + within:  # beyond what the sketch promises: the bracket before holds them
            low, high, below = held or (float("-inf"), float("inf"), 0)
            inside = there.where(F.col("x").between(low, high))
            break
        if values <= most or within == last:
            break
        last, held = within, (low, high, below)
        first, second = ((r - below + i) / within for i, r in enumerate(ranks))
        low, high = inside.agg(F.percentile_approx("x", [max(0.0, first - share), min(1.0, second + share)], sketched)).first()[0]
    near = inside.groupBy("x").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + below
    ranked = near.withColumn("upto", upto)
    at = lambda rank: F.max(F.when((F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto")), F.col("x")))
    return ranked.agg(((at(F.lit(ranks[0])) + at(F.lit(ranks[1]))) / 2).alias("value")).select(clean_number(F.col("value")).alias("value"))


def _aggregate(op: str):
    return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp, "variance": F.var_samp}[op]


def _ranked(rows: DataFrame, plan: Plan, x: Column) -> DataFrame:
    limit = plan.limit or DEFAULT_LIMIT
    order = (lambda c: c.desc()) if plan.operation == "top_n" else (lambda c: c.asc())
    if plan.group_by:
        sums = rows.withColumn("_x", x).where("_x is not null").groupBy(*plan.group_by).agg(F.sum("_x").alias("value"))
        return sums.orderBy(order(F.col("value")), *[F.col(k).asc_nulls_last() for k in plan.group_by]).limit(limit)
    ties = ["__row_number"] if "__row_number" in rows.columns else []
    return rows.withColumn("_x", x).where("_x is not null").orderBy(order(F.col("_x")), *ties).limit(limit).select(*visible(rows))


def _trend(rows: DataFrame, plan: Plan, x: Column) -> DataFrame:
    kind = dict(rows.dtypes)[plan.time]
    at = F.col(f"`{plan.time}`").cast("timestamp") if kind in ("timestamp", "timestamp_ntz", "date") else to_date(F.col(f"`{plan.time}`"))
    at = F.date_trunc(plan.grain, at) if plan.grain else at
    sums = rows.select(at.alias("_at"), x.alias("_x")).where("_at is not null and _x is not null").groupBy("_at").agg(F.sum("_x").alias("value"))
    return sums.orderBy("_at").select(F.date_format("_at", "yyyy-MM-dd").alias("period"), "value")


def select_tables(needed: Sequence[str], catalog: DataFrame) -> DataFrame:
    """Of a catalog (table_id, columns array), the tables that own every needed column."""
    return catalog.where(F.size(F.array_except(F.array(*[F.lit(c) for c in needed]), F.col("columns"))) == 0)


def answer_table(needed: Sequence[str], catalog: DataFrame) -> str:
    """The one table that may answer; PlanError for none or several."""
    found = [r.table_id for r in select_tables(needed, catalog).select("table_id").limit(2).collect()]
    if len(found) != 1:
        raise PlanError("no table has these columns" if not found else "several tables have these columns")
    return found[0]


def distinct_filters(filters: Sequence[Filter]) -> list[Filter]:
    """Filters without repeats of column, operation and normalised value, first ones kept."""
    import re

    seen: dict[tuple, Filter] = {}
    for f in filters:
        seen.setdefault((f.column.casefold(), f.op, re.sub("[^a-z0-9]+", " ", str(f.value).casefold()).strip()), f)
    return list(seen.values())


__all__ = ["Filter", "Plan", "PlanError", "apply_filters", "answer_table", "filter_trace", "median", "refusals", "run_plan", "sample_sources", "select_tables", "to_number", "validate"]
