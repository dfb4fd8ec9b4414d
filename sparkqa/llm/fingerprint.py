"""Document fingerprints: bottom-k sketches of five-word shingle hashes.

A sketch holds the k smallest distinct 64-bit hashes of a text's shingles, ascending, as base64 of big-endian words.
Sketches of parts merge into the sketch of the whole. With fewer than k hashes a sketch is the whole set and estimates
are exact; else the share of common hashes among the union's k smallest estimates resemblance (standard error about
``sqrt(j (1 - j) / k)``), and the k-th smallest hash the number of distinct shingles.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkqa.llm.shared import documents
from sparkqa.llm.textwork import shingle_hashes, small_batches, word_hashes

K, SHINGLE, MAX_BUCKETS, ROWS_A_BUCKET = 128, 5, 4096, 2000


def sketch(text: str | None, k: int = K, n: int = SHINGLE) -> np.ndarray:
    """The k smallest distinct shingle hashes of a text (null or no words: none)."""
    h = shingle_hashes(word_hashes((text or "").encode("utf-8", "surrogatepass")), n)
    if len(h) > 8 * k:
        low = np.unique(np.partition(h, 4 * k)[: 4 * k])
        if len(low) >= k:
            return low[:k]
    return np.unique(h)[:k]


def packed(hashes: np.ndarray) -> str:
    return base64.b64encode(hashes.astype(">u8").tobytes()).decode()


def unpacked(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), dtype=">u8").astype(np.uint64)


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of common shingles among all; 1 for two empty sketches."""
    whole = merged(a, b, k)
    if not len(whole):
        return 1.0
    return len(np.intersect1d(np.intersect1d(a, b, True), whole, True)) / len(whole)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too."""
    if not len(a):
        return 1.0
    both = resemblance(a, b, k) * distinct(merged(a, b, k), k)
    return min(1.0, both / distinct(a, k))


def fingerprint_of(text: Column, k: int = K, n: int = SHINGLE) -> Column:
    """Column form of ``sketch``."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: packed(sketch(t, k, n)))

    return of(text)


def merge_by(rows: DataFrame, by: list[str], fingerprint: str = "fingerprint", k: int = K, salts: int = 32) -> DataFrame:
    """Sketches merged per group: each keeps its k smallest hashes, in two steps so that a large group is merged in parts."""

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        whole = np.empty(0, dtype=np.uint64)
        for f in part["_f"]:
            whole = merged(whole, unpacked(f), k)
        return pd.DataFrame({**{c: part[c].iloc[:1].to_list() for c in keys}, "_f": [packed(whole)]})

    kinds = dict(rows.dtypes)
    parts = rows.where(F.col(fingerprint).isNotNull()).select(*by, F.col(fingerprint).alias("_f"), F.pmod(F.xxhash64(fingerprint), F.lit(salts)).cast("int").alias("_salt"))
    for keys in ([*by, "_salt"], by):
        schema = ", ".join(f"`{c}` {kinds.get(c, 'int')}" for c in keys) + ", _f string"
        parts = parts.groupBy(*keys).applyInPandas(merge, schema)
    return parts.withColumnRenamed("_f", fingerprint)


def successors(docs: DataFrame, max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """(bucket, halo, doc_id, text): rows dealt into ranges of doc_id, each range also holding the row that comes next.

    Range borders are quantiles of the ids (at most ``max_buckets`` values on the driver), themselves ids that occur, so
    each border is the first id of its range and goes to the range before as well; the first id of all goes to the last.
    """
    span = docs.agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    buckets = max(1, min(max_buckets, span.n // ROWS_A_BUCKET))
    marks = docs.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0] if buckets > 1 else []
    borders = np.array(sorted({m for m in marks or [] if m > span.low}), dtype=np.int64)
    low, nulls, last = span.low, span.nulls, len(borders)

    @F.pandas_udf("array<int>")
    def ranges(ids: pd.Series) -> pd.Series:
        """The row's own range, then those it is the end of."""
        none = ids.isna().to_numpy()
        values = ids.fillna(0).to_numpy(dtype=np.int64)
        own = np.where(none, 0, np.searchsorted(borders, values, side="right"))
        before = np.searchsorted(borders, values, side="left")
        out = []
        for i in range(len(values)):
            mine = [int(own[i])]
            if not none[i] and before[i] < own[i]:
                mine.append(int(before[i]))
            if none[i] or (not nulls and values[i] == low):
                mine.append(-1)
            out.append(mine)
        return pd.Series(out)

    wide = docs.select("doc_id", "text", F.posexplode(ranges("doc_id")).alias("copy", "bucket"))
    return wide.select(
        F.when(F.col("bucket") < 0, last).otherwise(F.col("bucket")).alias("bucket"),
        F.when(F.col("bucket") < 0, 2).when(F.col("copy") > 0, 1).otherwise(0).alias("halo"), "doc_id", "text",
    )


def compare_edited(docs: DataFrame, k: int = K) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document's, by ascending doc_id, the first following the last; repeated ids go by text, null ids come first, null
    texts are empty. One row a row, an empty table gives none, other columns are left out. Texts move once, by range of
    doc_id; one row at a time is held back while its successor arrives.
    """
    spark = docs.sparkSession
    small_batches(spark)
    dealt = successors(docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text")))
    ordered = dealt.repartition("bucket").sortWithinPartitions("bucket", "halo", F.col("doc_id").asc_nulls_first(), "text")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            out = []
            for bucket, halo, doc_id, text in zip(batch["bucket"], batch["halo"], batch["doc_id"], batch["text"], strict=True):
                if held is not None and held[0] == bucket and not held[4]:
                    doc, mine, own = held[1:4]
                    half = len(mine) // 2
                    edited = mine[: len(mine) - half] + text[:half]
                    after, changed = sketch(text, k), sketch(edited, k)
                    out.append((doc, len(mine), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), packed(own), packed(changed), resemblance(own, changed, k), resemblance(own, after, k)))
                    held = (bucket, doc_id, text, after, halo)
                elif halo and held is not None and held[0] == bucket:
                    continue
                else:
                    held = (bucket, doc_id, text, sketch(text, k), halo)
            frame = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            yield frame.astype({"doc_id": "Int64"})

    return ordered.mapInPandas(compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(documents(spark, sf_dir))
