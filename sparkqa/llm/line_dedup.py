"""Line deduplication with two Bloom filters, of keys seen once and of keys seen twice.

1. Each document's distinct line keys are hashed once, and the hashes are stored (8 bytes a key).
2. A task that reads hashes fills two filters: a key that "once" passes already goes into "twice", every other into
   "once". Tasks give their filters in blocks; of two tasks' blocks the merged "twice" has what either has and what both
   have in "once". So each key of two documents passes "twice", and some few others do.
3. The documents are read again, and only keys that pass "twice" are shuffled: by their bytes, combined before the shuffle
   to the smallest document and the number of documents. Keys of at least two documents are repeats.
4. Suspected lines meet the repeats by key; what is not in the first document goes, and texts are cut once.

The filters have at most ``MAX_BITS`` each, which bounds what a task holds, what is sent to the driver and what is
broadcast. A corpus with more keys than those can tell apart sends more suspects into the shuffle, in the end all lines,
and gets the same result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkqa.llm.shared import documents, stored, with_order
from sparkqa.llm.textwork import small_batches

MIN_CHARS, MIN_DOCS = 10, 2
#: Bits of a filter for each key, and at most (64 MB); bits that a key sets; bytes of the blocks in which filters travel.
BITS_A_KEY, MAX_BITS, HASHES, BLOCK = 12, 1 << 29, 4, 1 << 15
_STRIPPED = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes of keys that a batch of suspects has at most, one key aside.
BATCH_BYTES = 4 << 20


def line_keys(text: str, min_chars: int = MIN_CHARS) -> dict[bytes, list[int]]:
    """The keys of a text's lines that are long enough, with the numbers of their lines."""
    out: dict[bytes, list[int]] = {}
    for i, line in enumerate(text.encode("utf-8", "surrogatepass").lower().split(b"\n")):  # bytes.lower() is A-Z only
        key = line.strip(_STRIPPED)
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "surrogatepass")) >= min_chars):
            out.setdefault(key, []).append(i)
    return out


def bits_for(keys: int, most: int = MAX_BITS) -> int:
    """Bits of a filter: a power of two with ``BITS_A_KEY`` for each key, or ``most``."""
    return min(most, max(8 * BLOCK, 1 << max(0, int(BITS_A_KEY * keys - 1).bit_length())))


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each hash, a row each."""
    low, step = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32) | np.uint64(1)
    at = np.arange(HASHES, dtype=np.uint64)
    return (low[:, None] + at * step[:, None] * np.uint64(0x9E3779B1)) & np.uint64(bits - 1)


def _bit(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)


def passes(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    byte, mask = _bit(at)
    return (words[byte] & mask != 0).all(1)


def add(words: np.ndarray, at: np.ndarray) -> None:
    byte, mask = _bit(at.ravel())
    np.bitwise_or.at(words, byte, mask)


class Filters:
    """The filters of keys seen once and seen twice."""

    def __init__(self, bits: int):
        self.bits, self.once, self.twice = bits, np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def see(self, hashes: np.ndarray) -> None:
        """Keys of some documents, each document's distinct."""
        keys, n = np.unique(hashes, return_counts=True)
        at = positions(keys, self.bits)
        add(self.twice, at[(n > 1) | passes(self.once, at)])
        add(self.once, at)

    def merge(self, once: np.ndarray, twice: np.ndarray) -> None:
        self.twice |= twice | (self.once & once)
        self.once |= once


def _hashes(batches: Iterator[pd.DataFrame], min_chars: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        each = [np.array([xxhash.xxh3_64_intdigest(k) for k in line_keys(t, min_chars)], dtype=np.uint64) for t in batch["text"]]
        yield pd.DataFrame({"keys": [len(h) for h in each], "hashes": [h.astype("<u8").tobytes() for h in each]})


def _filled(batches: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    filters, any_ = None, False
    for batch in batches:
        filters, any_ = filters or Filters(bits), True
        filters.see(np.frombuffer(b"".join(batch["hashes"]), dtype="<u8"))
    if any_:
        yield from _blocks(filters)


def _blocks(filters: Filters) -> Iterator[pd.DataFrame]:
    for block, start in enumerate(range(0, filters.bits // 8, BLOCK)):
        part = slice(start, start + BLOCK)
        if filters.once[part].any():
            yield pd.DataFrame({"block": [block], "once": [zlib.compress(filters.once[part], 1)], "twice": [zlib.compress(filters.twice[part], 1)]})


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of "twice". In: blocks of all tasks, equal ones in a row."""
    read = lambda x: np.frombuffer(zlib.decompress(x), np.uint8)
    held, now = None, None
    for batch in batches:
        for block, once, twice in batch.itertuples(index=False):
            if block != now:
                if held is not None:
                    yield pd.DataFrame({"block": [now], "twice": [held.twice.tobytes()]})
                held, now = Filters(8 * len(read(once))), block
            held.merge(read(once), read(twice))
    if held is not None:
        yield pd.DataFrame({"block": [now], "twice": [held.twice.tobytes()]})


def twice_seen(docs: DataFrame, min_chars: int = MIN_CHARS, max_bits: int = MAX_BITS) -> np.ndarray:
    """The filter of keys seen twice over all texts, with no false negative; at most ``max_bits``."""
    hashes = stored(docs.select("text").mapInPandas(lambda b: _hashes(b, min_chars), "keys long, hashes binary"), "line-hashes")
    bits = bits_for(hashes.agg(F.sum("keys")).first()[0] or 0, max_bits)
    blocks = hashes.select("hashes").mapInPandas(lambda b: _filled(b, bits), "block int, once binary, twice binary")
    merged = blocks.repartition("block").sortWithinPartitions("block").mapInPandas(_merged, "block int, twice binary")
    twice = np.zeros(bits // 8, np.uint8)
    for block, words in merged.toPandas().itertuples(index=False):
        twice[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(words, np.uint8)
    return twice


def _suspects(batches: Iterator[pd.DataFrame], filled, min_chars: int) -> Iterator[pd.DataFrame]:
    twice, names = np.frombuffer(filled.value, np.uint8), ["ord", "key", "lines"]
    for batch in batches:
        out, size = [], 0
        for ord_, text in zip(batch["ord"], batch["text"], strict=True):
            keys = line_keys(text, min_chars)
            if not keys:
                continue
            hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
            for again, (key, lines) in zip(passes(twice, positions(hashes, 8 * len(twice))), keys.items(), strict=True):
                if again:
                    out.append((ord_, key, lines))
                    size += len(key) + 4 * len(lines)
                    if size > BATCH_BYTES:
                        yield pd.DataFrame(out, columns=names)
                        out, size = [], 0
        yield pd.DataFrame(out, columns=names)


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for doc_id, text, gone in zip(batch["doc_id"], batch["text"], batch["gone"], strict=True):
            lines = text.split("\n")
            drop = set() if gone is None else set(gone.tolist())
            kept = "\n".join(line for i, line in enumerate(lines) if i not in drop) if drop else text
            out.append((doc_id, len(lines), len(drop), kept))
        yield pd.DataFrame(out, columns=["doc_id", "n_lines", "n_dropped", "kept"]).astype({"doc_id": "Int64"})


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, max_bits: int = MAX_BITS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines (before dropping), n_dropped, kept (the text without the dropped lines).

    A line's key is the line without blanks at its ends, A-Z lower-cased. A key of at least ``min_chars`` code points that
    at least two documents hold loses all its lines but those of the smallest doc_id (all of them there). Null texts are
    empty, which is one empty line; rows are documents of their own even where ids repeat (they go by text then, null ids
    first); an empty table gives no rows; texts and lines of any length are taken whole; other columns are left out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = with_order(docs)
    filled = spark.sparkContext.broadcast(twice_seen(docs, min_chars, max_bits).tobytes())
    suspects = stored(docs.select("ord", "text").mapInPandas(lambda b: _suspects(b, filled, min_chars), "ord long, key binary, lines array<int>"), "suspects")
    repeats = suspects.groupBy("key").agg(F.min("ord").alias("first"), F.count("*").alias("docs")).where(F.col("docs") >= MIN_DOCS).drop("docs")
    repeats = stored(repeats, "repeats")  # so that the join has a shuffle of its own, which Spark can split at a frequent key
    gone = suspects.join(repeats, "key").where(F.col("ord") != F.col("first")).select("ord", "lines")
    gone = gone.groupBy("ord").agg(F.flatten(F.collect_list("lines")).alias("gone"))
    cut = docs.join(gone, "ord", "left").select("doc_id", "text", "gone")
    return cut.mapInPandas(_cut, "doc_id long, n_lines long, n_dropped long, kept string")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = drop_repeated_lines(documents(spark, sf_dir))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH split AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM split
), firsts AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), told AS (
  SELECT k.*, f.first IS NOT NULL AND f.first <> k.doc_id AS dropped FROM keyed k LEFT JOIN firsts f USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM told GROUP BY doc_id
"""
