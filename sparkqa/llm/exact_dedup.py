"""Exact deduplication by a stateful stream (DataFrame functions only).

A feed of (digest, stable identifier, content locator) rows runs through a Structured Streaming aggregation whose keyed
state is kept on disk (RocksDB, no watermark, so nothing expires): per digest the row that stays, i.e. the largest doc_id
with its locator, and the number of rows. A new feed with the same checkpoint goes on from the same state. The locator is
the file (as a hash of its path) and the row's number in it, which finds one row even where ids repeat. With a checkpoint
the texts of each feed are kept beside the state with their digests, so that locators of earlier feeds still lead to
their bytes and no text is digested twice; marks, written last, tell which feeds are whole and which the state has taken.

Hits, digests seen more than once, have their full bytes checked: their texts are compared per digest by a min and a
max, which are combined before the shuffle, so a digest with a third of all rows sends one text a task. Texts without a
hit are mostly held back at the scan by a Bloom filter of bounded size over the hit digests (where it overfills, more
texts are compared; results stay the same). Digests whose texts differ are grouped by text instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkqa.llm import bloom
from sparkqa.llm.shared import ascii_lower, documents, free, mark, marked, new_folder, quoted, stored

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MAX_HIT_BITS = 1 << 27
#: Rows from which on a state that is forgotten after the call gets more stores than there are cores.
ROWS_A_STORE = 100_000


def located(docs: DataFrame, file: str = "_file", row: str = "_row") -> DataFrame:
    """``docs`` with the free names ``file`` and ``row``, which locate each row; what does not come from Parquet files is
    stored first."""
    place = [F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row)]
    columns = quoted(docs.columns)
    try:
        return docs.select(*columns, *place)
    except AnalysisException:
        return stored(docs, "docs").select(*columns, *place)


def normalised(text: Column) -> Column:
    """A-Z lower-cased, null as empty."""
    return F.coalesce(ascii_lower(text), F.lit(""))


def run_state(spark: SparkSession, feed: str, schema, checkpoint: str, digest: Callable[[Column], Column], files_per_trigger: int, stores: int | None = None) -> DataFrame:
    """Streams what is new under ``feed`` into the state at ``checkpoint``; the state: digest, keep, n. stores: into how many
    stores a new state is cut, as many as there are shuffle partitions if not given."""
    own = spark.newSession()
    for key, value in {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
        "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # else stores of a finished stream keep their memory for a while
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each of many small stores reserves log space
        "spark.sql.shuffle.partitions": stores or spark.conf.get("spark.sql.shuffle.partitions"),
    }.items():
        own.conf.set(key, value)
    stream = own.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(feed)
    keyed = stream.select(digest(F.col("text_sha256")).alias("digest"), F.struct("doc_id", "_file", "_row").alias("at"))
    state = keyed.groupBy("digest").agg(F.max("at").alias("keep"), F.count("*").alias("n"))
    run = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    kept = own.read.format("statestore").load(checkpoint)
    columns = kept.schema["value"].dataType.fieldNames()
    kept = kept.select(F.col("key.digest").alias("digest"), F.col(f"value.`{columns[0]}`").alias("keep"), F.col(f"value.`{columns[1]}`").alias("n"))
    path = new_folder(spark, "state")
    kept.write.parquet(path)
    return spark.read.parquet(path)


def stores_for(spark: SparkSession, rows: int) -> int:
    """Stores for a state of so many rows that no later feed goes on from. Each opening of a store leaves some native memory
    (RocksDB's statistics, about 0.5 MB on eight cores, which Spark never closes) in its executor, so their number goes with
    the rows and not with the shuffle partitions."""
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(most, max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_STORE)))


def _unfinished(spark: SparkSession, base: str) -> int:
    """The first feed of a checkpoint that is not in its state yet."""
    number = 0
    while marked(spark, f"{base}/done/{number}"):
        number += 1
    return number


def dedup(docs: DataFrame, digest: Callable[[Column], Column] = F.unhex, checkpoint: str | None = None, files_per_trigger: int = 1000, feed: int | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text and any others): doc_id, keep_id, group_size, kept, text_sha256, _file, _row.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the
    largest doc_id stays (null ids only among themselves; repeated ids: the last by locator), so exactly one row a group
    has kept = true. An empty table gives no rows. Texts of any length are compared whole. digest: what is used as the
    state's key, from the hex SHA-256.

    checkpoint: a folder in the shared storage that holds state, feeds and texts from call to call. Rows of earlier calls
    then count in groups (keep_id may be one of them, no row is kept if so), and hits are compared with their bytes too;
    one call at a time may use a checkpoint. Without one, everything is forgotten after the call.

    feed: the number of this call's rows, from 0, with a checkpoint. A call that failed, or whose result was lost, is made
    again with the same number, and gives what it would have given: rows that were written as a whole are not written
    again, a part of them is replaced, and the state takes each file once. Without a number it is the first feed that the
    state has not taken whole, so a call that failed before that is simply made again. Only the newest feed may be made
    again, with the same rows.
    """
    spark = docs.sparkSession
    base = checkpoint.rstrip("/") if checkpoint else new_folder(spark, "dedup")
    columns = docs.select(F.col("doc_id"), F.col("text"))
    number, sha, every = 0, F.sha2(normalised(F.col("text")), 256).alias("text_sha256"), None
    if checkpoint:
        number = _unfinished(spark, base)
        if feed is not None:
            if feed not in (number, number - 1):
                raise ValueError(f"feed {feed} comes out of turn: {number} is next")
            number = feed
        if not marked(spark, f"{base}/written/{number}"):
            columns.select("*", sha).write.mode("overwrite").parquet(f"{base}/texts/feed={number}")
        every = spark.read.schema(T.StructType([*columns.schema.fields, T.StructField("text_sha256", T.StringType()), T.StructField("feed", T.IntegerType())])).parquet(f"{base}/texts")
        rows = located(every.where(F.col("feed") == number)).drop("feed")
    else:
        rows = located(columns.select("*", sha))
    told = rows.select("doc_id", "_file", "_row", "text_sha256")
    if not (checkpoint and marked(spark, f"{base}/written/{number}")):
        told.write.mode("overwrite").parquet(f"{base}/feed/feed={number}")  # not seen by the state before it is whole
    if checkpoint:
        mark(spark, f"{base}/written/{number}")
    told = told.withColumn("feed", F.lit(number))
    own = spark.read.schema(told.schema).parquet(f"{base}/feed")
    stores = None if checkpoint else stores_for(spark, own.count())  # a state that lasts may grow by far larger feeds
    state = run_state(spark, f"{base}/feed", told.schema, f"{base}/state", digest, files_per_trigger, stores)
    if checkpoint:
        mark(spark, f"{base}/done/{number}")
    keyed = own.where(F.col("feed") == number).withColumn("digest", digest(F.col("text_sha256")))
    out = keyed.join(state, "digest").select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), _is(F.col("keep")).alias("kept"), "text_sha256", "_file", "_row", "digest")
    hits = state.where("n > 1").select("digest")
    texts = _texts(rows, digest, True)
    if number:
        earlier = located(every.where(F.col("feed") < number)).drop("feed")
        hits = stored(hits.join(keyed.select("digest").distinct(), "digest", "left_semi"), "hits")
        texts = texts.unionByName(_texts(earlier, digest, False))
    odd = differing(texts, hits)
    if not odd.isEmpty():
        texts = texts.join(F.broadcast(odd) if odd.count() <= 1000 else odd, "digest", "left_semi")
        groups = texts.groupBy("digest", "norm").agg(F.max("at").alias("keep"), F.count("*").alias("n"))
        apart = texts.where("now").join(groups, ["digest", "norm"]).select(F.col("at.doc_id").alias("doc_id"), F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("at") == F.col("keep")).alias("kept"), F.sha2("norm", 256).alias("text_sha256"), F.col("at._file").alias("_file"), F.col("at._row").alias("_row"), "digest")
        out = out.join(odd, "digest", "left_anti").unionByName(apart)
    return out.drop("digest")


def _is(keep: Column) -> Column:
    return (keep["_file"] == F.col("_file")) & (keep["_row"] == F.col("_row"))


def _texts(rows: DataFrame, digest: Callable[[Column], Column], now: bool) -> DataFrame:
    """digest, norm, at and now of rows with their SHA-256; inline keeps a filter on the digest above its making, so that a
    text is digested once and not once per probe."""
    norm = normalised(F.col("text"))
    return rows.select(F.inline(F.array(F.struct(digest(F.col("text_sha256")).alias("digest"), norm.alias("norm"), F.struct("doc_id", "_file", "_row").alias("at"), F.lit(now).alias("now")))))


def differing(texts: DataFrame, hits: DataFrame) -> DataFrame:
    """Digests among ``hits`` whose rows do not all have the same bytes."""
    bits, hashes = bloom.shape(hits.count(), 0.02)
    bits = min(bits, MAX_HIT_BITS)
    words = bloom.build(hits, "digest", 1, bits, hashes)
    suspects = texts.select("digest", "norm").where(bloom.passes(F.col("digest"), bloom.words_of(words), 1, bits, hashes))
    return stored(suspects.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b")).where("a <> b").select("digest"), "differing")


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns they have, whatever those are called. The locators of the rows that
    go are stored, and Spark sends them to the texts where their files are small enough for its broadcast limit."""
    columns = docs.columns
    file, row = free(columns, "_file", "_row")
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = stored(docs, "docs")
    gone = stored(dedup(docs).where("not kept").select(F.col("_file").alias(file), F.col("_row").alias(row)), "gone")
    return located(docs, file, row).join(gone, [file, row], "left_anti").select(*quoted(columns))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""
