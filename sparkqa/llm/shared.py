"""Helpers that several operators use: shared folder, stored intermediates and their removal, free column names, connected
components."""

from __future__ import annotations

import string
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Folders made since the session began, or since the innermost ``scratch`` was entered.
_made: list[list[str]] = [[]]


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only in local mode, where driver and executors
    are one machine, a temporary folder stands in where that is unset; on a cluster this is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("sparkqa.local.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-sparkqa-")
        spark.conf.set("sparkqa.local.checkpoint.dir", path)
    return path


def new_folder(spark: SparkSession, what: str) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    _made[-1].append(path)
    return path


def stored(df: DataFrame, what: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage and survives the loss of executors."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, all intermediate folders that operators make within it. Results read them, so what is to stay
    must be written before; who calls an operator without this removes ``spark.checkpoint.dir`` in the end."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            remove(spark, path)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def mark(spark: SparkSession, path: str) -> None:
    """Leaves an empty file, which is there as a whole or not at all."""
    store, place = _place(spark, path)
    store.create(place, True).close()


def marked(spark: SparkSession, path: str) -> bool:
    store, place = _place(spark, path)
    return store.exists(place)


def remove(spark: SparkSession, path: str | None) -> None:
    """Deletes a folder of the shared storage, if there is one."""
    if path:
        store, place = _place(spark, path)
        store.delete(place, True)


def free(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with none of ``taken`` (whatever their case)."""
    used = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        out.append(name)
    return out


def quoted(names: Iterable[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def with_order(docs: DataFrame, name: str = "ord", keep: bool = False) -> DataFrame:
    """doc_id, text (null as empty) and ``name``, a number of its own for each row: doc_id where ids are distinct and none
    is null, else the row's rank by doc_id (nulls first) and text. keep: all columns as they are, and ``name``, which must
    be free.

    The rank is Spark's own sort by range, with the place in the input last, so that a row that is repeated without end is
    still split over ranges; a row's number is what the ranges before hold and its place in its range."""
    rows = docs if keep else docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n = rows.agg(F.count("*").alias("all"), F.count("doc_id").alias("ids")).first()
    if n.all == n.ids and n.all == rows.select("doc_id").distinct().count():
        return rows.withColumn(name, F.col("doc_id").cast("long"))
    tie, at, part, before = free([*rows.columns, name], "tie", "at", "part", "before")
    ranged = rows.withColumn(tie, F.monotonically_increasing_id()).sort(F.col("doc_id").asc_nulls_first(), "text", tie)
    told = stored(ranged.drop(tie).withColumn(at, F.monotonically_increasing_id()), "ordered")  # range's number and place in it
    told = told.withColumn(part, F.shiftright(at, 33))
    counts = told.groupBy(part).agg(F.count("*").alias(before))
    so_far = F.coalesce(F.sum(before).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = F.broadcast(counts.select(part, so_far.alias(before)))  # one row a range of the sort
    return told.join(counts, part).select(*quoted(rows.columns), (F.col(before) + F.col(at).bitwiseAND((1 << 33) - 1)).alias(name))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: long) as (node, component), component being the smallest node reachable.

    Alternates the large-star and small-star steps, which keep components and end in O(log^2 n) rounds with stars
    around the smallest nodes. Every step is a min per node (combined before the shuffle) and a join back on the node,
    which adaptive execution can split where one node has a large share of the edges. Each round is stored.
    """
    own = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    own = stored(own, "edges")
    last = None
    while True:
        # large star: every neighbour above u is linked to the smallest of u and its neighbours
        both = own.select("u", "v").unionByName(own.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every neighbour below u, and u itself, is linked to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u")
        small = down.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        own = stored(small.where("u <> v").distinct(), "edges")
        state = own.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    roots = own.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return own.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
