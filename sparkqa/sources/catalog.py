"""Table catalog: reading tables, headers, lineage, storing and replacing by document, and column profiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkqa.functions.scalar import document_id, table_id, to_date, to_number
from sparkqa.plans.plan import INTERNAL
from sparkqa.sources.store import numbered

# Reading and storing


def clean_headers(names: Sequence[str]) -> list[str]:
    """Trimmed names, blank ones ``Unnamed``, repeats (whatever their case) with ``_2``, ``_3``; the new names are not
    checked again. Costs nothing on the data: ``df.toDF(*clean_headers(df.columns))``."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        base = str(name or "").strip() or "Unnamed"
        n = seen[base.casefold()] = seen.get(base.casefold(), 0) + 1
        out.append(base if n == 1 else f"{base}_{n}")
    return out


def read_csv(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """A CSV with a header as one logical table; None when it has no rows. Without a schema, types are inferred (a pass)."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    if not df.columns or df.isEmpty():
        return None
    return df.toDF(*clean_headers(df.columns))


def with_lineage(df: DataFrame, source: str, sheet: str | None = None, order: str | None = None) -> DataFrame:
    """Adds source, ids, sheet (when there is one) and a 1-based row number; an existing row number is kept.

    order: a column that gives the rows' order; without it, the order of the file is used. Numbers come from the sizes of
    Spark's own ranges (see ``store.numbered``), so no task sorts the whole table."""
    if "__row_number" not in df.columns:
        df = numbered(df, "__row_number", F.col(order) if order else None)
    document = document_id(F.lit(source))
    cells = {"__source_file": F.lit(source), "__document_id": document, "__table_id": table_id(document, F.lit(sheet))}
    if sheet:
        cells["__sheet_name"] = F.lit(sheet)
    return df.withColumns(cells)


def split_sheets(cells: DataFrame, document: str = "document", sheet: str = "sheet") -> DataFrame:
    """Rows of many sheets with their table ids; sheets without rows do not appear, and none is mixed with another."""
    return cells.withColumn("__document_id", document_id(F.col(document))).withColumn("__table_id", table_id(F.col("__document_id"), F.col(sheet)))


def sync_directory(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All CSV files of a directory in one read, each row with its file's ids; rows that do not fit the schema are left
    out, so one bad file does not stop the rest."""
    df = spark.read.schema(f"{schema}, _bad string").option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").csv(path)
    name = F.col("_metadata.file_name")
    return df.select("*", name.alias("__source_file"), document_id(name).alias("__document_id"), document_id(name).alias("__table_id")).where("_bad is null").drop("_bad")


def store_tables(df: DataFrame, path: str, form: str = "parquet", mode: str = "overwrite") -> None:
    """Logical tables stored by table id (``parquet`` or ``json`` lines with ISO dates)."""
    df.write.mode(mode).partitionBy("__table_id").format(form).save(path)


def load_table(spark: SparkSession, path: str, table: str, form: str = "parquet", schema=None) -> DataFrame:
    """One table: only its partition is read."""
    reader = spark.read.format(form)
    return (reader.schema(schema) if schema else reader).load(path).where(F.col("__table_id") == table)


def table_ids(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    return spark.read.format(form).load(path).select("__table_id").distinct()


def replace_documents(existing: DataFrame, new: DataFrame, key: str = "__document_id") -> DataFrame:
    """The store with every document of ``new`` replaced by its new rows. The ids join by shuffle, or by broadcast where
    Spark finds them small."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def clear_report(store: DataFrame, key: str = "__document_id") -> DataFrame:
    """What clearing the store removes: rows per document."""
    return store.groupBy(key).agg(F.count("*").alias("removed"))


def cleared(store: DataFrame) -> DataFrame:
    """An empty store of the same schema, to overwrite with."""
    return store.limit(0)


#: Uploads that pass.
EXTENSIONS, MAX_BYTES = ("pdf", "csv", "xlsx", "jpg"), 10 * 1024 * 1024


def gate_uploads(files: DataFrame, name: str = "name", length: str = "length") -> DataFrame:
    """``accepted`` and the reason of a refusal, per file of a listing."""
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    reason = F.when(~extension.isin(*EXTENSIONS), "extension").when(F.col(length) > MAX_BYTES, "size")
    return files.withColumn("reason", reason).withColumn("accepted", reason.isNull())


def append_tables(frames: Sequence[DataFrame]) -> DataFrame:
    """All sheets' or documents' rows as one corpus; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def catalog_of(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_id, columns) of tables by id: schemas only, no data is read."""
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame([(t, df.columns) for t, df in tables.items()], "table_id string, columns array<string>")


def newest_entries(entries: DataFrame, table: str = "table_id", time: str = "indexed_at", position: str = "pos") -> DataFrame:
    """The newest entry of each table, the later one on ties."""
    order = Window.partitionBy(table).orderBy(F.col(time).desc_nulls_last(), F.col(position).desc())
    return entries.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


# Profiles

#: Name tokens of identifiers by rule set, of measures, of descriptive texts; words of booleans; units.
CATALOG_ID = ["id", "code", "key", "identifier", "number", "no", "sku", "isin", "cusip"]
PROFILER_ID = ["id", "code", "key", "identifier", "sku", "isin", "cusip", "uuid", "account", "customerid", "productid", "orderid"]
PLANNER_ID = ["id", "code", "key", "identifier", "sku", "isin", "cusip", "uuid"]
MEASURES = ["quantity", "qty", "amount", "revenue", "price", "sales", "units", "volume", "count", "cost", "profit", "salary", "age", "rate", "score", "weight", "total", "value"]
TEXTS = ["description", "comment", "notes", "remarks", "summary", "text"]
BOOLEANS = ["true", "false", "yes", "no", "y", "n", "1", "0"]
UNITS = ["usd/t", "usd/kg", "usd/lb", "eur/t", "eur/kg", "$/t", "$/kg", "$/lb", "kg", "g", "gram", "grams", "ton", "tons", "tonne", "tonnes", "mt", "kt", "%", "percent", "pct", "bbl", "barrel", "barrels"]
UNIT_SUFFIX = r"(?i)(?:^|[\s_-])(usd/?t|usd/?kg|usd/?lb|eur/?t|kg|g|tonnes?|tons?|mt|kt|%)$"
CATEGORICAL_MAX_RATIO = 0.20


def long_form(df: DataFrame, columns: Sequence[str] | None = None, row: str | None = None) -> DataFrame:
    """(column, position, kind, value as text[, row]) of every cell: what one pass of profiling groups."""
    names = list(columns or [c for c in df.columns if c not in INTERNAL])
    kinds = dict(df.dtypes)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"), F.lit(kinds[c]).alias("kind"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(names)])
    return df.select(F.inline(cells), *([F.col(row).alias("row")] if row else []))


def tokens(name: Column) -> Column:
    return F.regexp_extract_all(F.lower(name), F.lit("[a-z0-9]+"), F.lit(0))


def _named(column: Column, words: Sequence[str]) -> Column:
    return F.arrays_overlap(tokens(column), F.array(*[F.lit(w) for w in words]))


def is_identifier(column: Column, kind: Column, distinct_ratio: Column, rules: str) -> Column:
    """Does a column name rows? rules: ``catalog`` (measure names veto; integers unique to 0.98) or ``profiler`` (0.995)."""
    whole = kind.isin("tinyint", "smallint", "int", "bigint")
    if rules == "catalog":
        return _named(column, CATALOG_ID) | (~_named(column, MEASURES) & whole & (distinct_ratio >= 0.98))
    return _named(column, PROFILER_ID) | (whole & (distinct_ratio >= 0.995))


def semantic_type(rules: str = "profiler") -> Column:
    """Over a profile's columns. Dates are tested before numbers; booleans after both (profiler only)."""
    column, kind = F.col("column"), F.col("kind")
    identifier = is_identifier(column, kind, F.col("distinct_ratio"), rules)
    few = (F.col("distinct_count") <= 100) | (F.col("distinct_ratio") <= CATEGORICAL_MAX_RATIO)
    typed = (
        F.when(F.col("non_null") == 0, "text").when(kind == "boolean", "boolean")
        .when(kind.isin("tinyint", "smallint", "int", "bigint"), F.when(identifier, "identifier").otherwise("integer"))
        .when(kind.isin("float", "double") | kind.startswith("decimal"), "numeric").when(kind.startswith("timestamp"), "datetime").when(kind == "date", "date")
    )
    if rules == "catalog":
        return typed.when(F.col("date_ratio") >= 0.90, "date").when(F.col("numeric_ratio") >= 0.95, F.when(identifier, "identifier").otherwise("numeric")).when(few, "categorical").otherwise("text")
    return (
        typed.when(F.col("date_ratio") >= 0.95, "date").when(F.col("numeric_ratio") >= 0.98, F.when(identifier, "identifier").otherwise("numeric"))
        .when(F.col("booleans"), "boolean").when(identifier, "identifier").when(few, "categorical").otherwise("text")
    )


def role() -> Column:
    """How a plan can use a column, from its semantic type, name and distinct ratio."""
    column, kind, semantic = F.col("column"), F.col("kind"), F.col("semantic_type")
    return (
        F.when(semantic.isin("integer", "numeric"), F.when(is_identifier(column, kind, F.col("distinct_ratio"), "profiler"), "identifier").otherwise("measure"))
        .when(semantic.isin("date", "datetime"), "time").when(semantic == "categorical", "dimension").when(semantic == "identifier", "identifier").when(semantic == "boolean", "boolean")
        .when(semantic == "text", F.when(_named(column, TEXTS), "text").when(F.col("distinct_ratio") <= CATEGORICAL_MAX_RATIO, "dimension").otherwise("text")).otherwise("unknown")
    )


def confidence() -> Column:
    semantic = F.col("semantic_type")
    return (
        F.when(semantic.isin("integer", "numeric"), F.least(F.lit(1.0), F.greatest(F.col("numeric_ratio"), F.lit(0.90))))
        .when(semantic.isin("date", "datetime"), F.least(F.lit(1.0), F.greatest(F.col("date_ratio"), F.lit(0.90))))
        .when(semantic == "boolean", 0.95).when(semantic == "identifier", 0.90).when(semantic == "categorical", 0.85).when(semantic == "text", 0.80).otherwise(0.50)
    )


def unit_of(name: Column) -> Column:
    """The unit in a column name: in brackets, or as its ending."""
    known = lambda u: F.when(F.lower(F.trim(u)).isin(UNITS), F.trim(u))
    suffix = F.nullif(F.lower(F.regexp_extract(F.trim(name), UNIT_SUFFIX, 1)), F.lit(""))
    return F.coalesce(known(F.regexp_extract(name, r"\(([^()]{1,30})\)", 1)), known(F.regexp_extract(name, r"\[([^\[\]]{1,30})\]", 1)), suffix)


def profile(df: DataFrame, rules: str = "profiler", approx: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: counts, distinct, range and mean of numbers, parse ratios, semantic type, role, confidence, unit.

    Cells are counted per (column, value) first, where repeated values collapse before the shuffle; everything else comes
    from those counts, so each distinct value is parsed once. approx: distinct counts by sketch, in one pass without that
    shuffle (ratios stay exact; safe away from the 0.98 and 0.20 borders)."""
    cells = long_form(df, columns)
    keys = ["column", "position", "kind"]
    if approx:
        counted = cells.withColumn("n", F.lit(1))
        distinct = F.approx_count_distinct("value")
    else:
        counted = cells.groupBy(*keys, "value").agg(F.count("*").alias("n"))
        distinct = F.count("value")
    number = to_number(F.col("value"))
    date = F.coalesce(F.col("kind").startswith("timestamp") | (F.col("kind") == "date") | to_date(F.col("value")).isNotNull(), F.lit(False)) & F.col("value").isNotNull()
    sized = counted.withColumns({"x": F.when(~F.col("kind").startswith("timestamp"), number), "date": date, "there": F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)})
    out = sized.groupBy(*keys).agg(
        F.sum("n").alias("row_count"), F.sum("there").alias("non_null"), distinct.alias("distinct_count"),
        F.min("x").alias("min"), F.max("x").alias("max"), F.try_divide(F.sum(F.col("x") * F.col("n")), F.sum(F.when(F.col("x").isNotNull(), F.col("n")))).alias("mean"),
        F.sum(F.when(F.col("x").isNotNull(), F.col("n")).otherwise(0)).alias("numbers"), F.sum(F.when(F.col("date"), F.col("n")).otherwise(0)).alias("dates"),
        F.coalesce(F.bool_and(F.lower(F.trim("value")).isin(BOOLEANS)), F.lit(False)).alias("booleans"),
    )
    ratio = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("non_null")), F.lit(0.0))
    out = out.withColumns({"nullable": F.col("non_null") < F.col("row_count"), "distinct_ratio": ratio("distinct_count"), "numeric_ratio": ratio("numbers"), "date_ratio": ratio("dates")})
    return out.withColumn("semantic_type", semantic_type(rules)).withColumn("role", role()).withColumns({"confidence": confidence(), "unit": unit_of(F.col("column"))})


def sample_values(df: DataFrame, row: str, cap: int = 50, columns: Sequence[str] | None = None, catalog: bool = False) -> DataFrame:
    """(column, samples): the first distinct trimmed non-empty values in row order; catalog: 800 where there are no more
    distinct ones, else 80. Each value meets once per task before the shuffle; only capped lists are gathered."""
    value = F.trim(F.col("value"))
    firsts = long_form(df, columns, row).where(value.isNotNull() & (value != "") & (F.lower(value) != "nan")).groupBy("column", value.alias("value")).agg(F.min("row").alias("row"))
    ranked = firsts.withColumn("n", F.row_number().over(Window.partitionBy("column").orderBy("row", "value")))
    most = F.lit(cap)
    ranked = ranked.where(F.col("n") <= (800 if catalog else cap))  # so each task cuts its own values before they are ranked
    if catalog:
        counts = firsts.groupBy("column").agg(F.count("*").alias("all"))
        ranked = ranked.join(F.broadcast(counts), "column")  # one row per column
        most = F.when(F.col("all") <= 800, 800).otherwise(80)
    kept = ranked.where(F.col("n") <= most)
    return kept.groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]).alias("samples"))


def column_indexes(profiled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Lists of column names by use, in table order."""
    semantic, used = F.col("semantic_type"), F.col("role")
    lists = {
        "numeric_columns": semantic.isin("integer", "numeric"), "categorical_columns": semantic == "categorical", "date_columns": semantic == "date", "datetime_columns": semantic == "datetime",
        "identifier_columns": semantic == "identifier", "text_columns": semantic == "text", "measure_columns": used == "measure", "dimension_columns": used == "dimension", "time_columns": used == "time",
    }
    pick = lambda ok: F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct("position", "column")))), lambda x: x["column"])
    return profiled.groupBy(*by).agg(*[pick(ok).alias(name) for name, ok in lists.items()])


def catalog_row(df: DataFrame, table: str, document: str, indexed_at: Column) -> DataFrame:
    return df.agg(F.count("*").alias("row_count")).select(F.lit(table).alias("table_id"), F.lit(document).alias("document_id"), "row_count", F.lit(len([c for c in df.columns if c not in INTERNAL])).alias("column_count"), indexed_at.alias("indexed_at"))


def usable_numeric() -> Column:
    """Over a profile: can a plan add this column up? Identifiers that are numbers count unless their name says id."""
    number = F.col("kind").rlike("int|float|double|decimal|number")
    semantic = F.col("semantic_type")
    return semantic.isin("integer", "numeric") | ((F.col("role") == "measure") & number) | ((semantic == "identifier") & number & ~_named(F.regexp_replace("column", "[^A-Za-z0-9]+", " "), PLANNER_ID))


def usable_dimension() -> Column:
    return F.col("semantic_type").isin("categorical", "text") | (F.col("role") == "dimension")


def usable_time() -> Column:
    return F.col("semantic_type").isin("date", "datetime") | (F.col("role") == "time")
