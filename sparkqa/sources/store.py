"""The folder that driver and executors share, and rows numbered through it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def new_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, ``spark.checkpoint.dir``. Only in local mode does a temporary folder stand in where
    that is unset; on a cluster this is an error. What is written there is removed with that folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("sparkqa.local.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-sparkqa-")
        spark.conf.set("sparkqa.local.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def _in_files(df: DataFrame, name: str, within: str | None) -> DataFrame | None:
    """Numbers in the order of the files that ``df`` is a scan of; None if it is none.

    A row's place is counted within its split, and a split is one range of one file: so the splits' counts, one row each,
    tell what comes before each split. Nothing is written; the counts take one pass over what tells rows apart from none."""
    file, start, at = "_file", "_start", "_at"
    try:
        placed = df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.file_block_start").alias(start), F.monotonically_increasing_id().alias(at))
    except AnalysisException:
        return None
    keys = [file, start]
    splits = placed.groupBy(*keys, *([within] if within else [])).agg(F.count("*").alias("_n"), F.min(at).alias("_first"))
    order = Window.orderBy(*keys) if not within else Window.partitionBy(within).orderBy(*keys)
    splits = splits.select(*keys, "_first", F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(splits), keys).withColumn(name, F.col("_before") + F.col(at) - F.col("_first") + 1).drop(*keys, at, "_first", "_before")  # one row a split


def numbered(df: DataFrame, name: str, order: Column | None = None, within: str | None = None) -> DataFrame:
    """``df`` with ``name``, the rows' numbers from 1: in the order given, sorted by Spark in ranges of its own choice (ties
    by place in the input), or without one in the order of the files that ``df`` reads, by path and place, else in the order
    of its partitions. within: a column that tells files apart; numbers begin anew in each.

    Where ``df`` is no plain scan of files, the rows are written once with their place in their part; a row's number is what
    the parts before hold, which is one row a part, and its place."""
    spark = df.sparkSession
    told = _in_files(df, name, within) if order is None else None
    if told is not None:
        return told
    if within:
        raise ValueError("numbers within files need a scan of files")
    ranged = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = (ranged.sort(order, "_tie") if order is not None else ranged).drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    path = new_path(spark, "numbered")
    ranged.write.parquet(path)
    told = spark.read.schema(ranged.schema).parquet(path).withColumn("_part", F.shiftright("_at", 33))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = told.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", before.alias("_before"))
    number = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return told.join(F.broadcast(parts), "_part").withColumn(name, number).drop("_part", "_at", "_before")  # one row a part
