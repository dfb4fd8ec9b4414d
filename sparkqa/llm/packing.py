"""Packing by shortest-pack-first over the length histogram.

Documents become token ids with an end id, cut into pieces of the sequence length and a rest. The histogram of piece
lengths (at most one entry per length up to the sequence length, whatever the corpus) is packed on the driver: lengths
longest first, each into the packs with the most room that still take it, by counts of packing patterns and never by
documents. Patterns then join back to pieces by rank: pieces are numbered per length, and a length's numbers are dealt
out to the places that patterns have for it. Numbers come from counts per (length, part), so a length with a third of
all pieces is numbered in many tasks.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkqa.llm.shared import documents, stored
from sparkqa.llm.textwork import small_batches

LENGTH, END_ID, VOCABULARY, PARTS, PIECES_A_PART = 2048, 1, "byte_bpe_50k.json", 64, 1 << 20

# Texts of plain characters (Latin letters, punctuation, blanks and line ends) are split into words as the tokenizer does,
# ids of words are kept, and only words that are new go to the tokenizer's model. Other texts, and texts with an added token, are encoded whole.
_PLAIN = [*range(0x20, 0x7F), *range(0xA1, 0x250), *range(0x2010, 0x2028)]
_OTHER = re.compile("[^\n\x20-\x7e\xa1-\u024f\u2010-\u2027]")
MAX_WORDS = 200_000


def _splitter() -> re.Pattern:
    """The byte-level pattern (contractions; letters, digits or signs with a blank before; white space), for plain texts."""
    of = lambda kind: "".join(re.escape(chr(c)) for c in _PLAIN if unicodedata.category(chr(c))[0] == kind)
    letters, digits = of("L"), of("N")
    return re.compile(rf" ?[{letters}]+| ?[{digits}]+|'(?:s|t|re|ve|m|ll|d)| ?[^\s{letters}{digits}]+|\s+(?!\S)|\s+")


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}


class Encoder:
    """Ids of texts by the tokenizer file, as little-endian 32-bit bytes; ids of words are remembered."""

    _loaded: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        told = json.loads(self.tokenizer.to_str())
        before = told["pre_tokenizer"] or {}
        self.by_words = before.get("type") == "ByteLevel" and not before["add_prefix_space"] and before.get("use_regex", True) and not told["normalizer"]
        self.added = [t["content"] for t in told["added_tokens"]]
        self.split, self.letters = _splitter().findall, _byte_letters()
        self.words: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def word(self, word: str) -> bytes:
        found = self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.letters))
        return array("I", [t.id for t in found]).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.by_words or _OTHER.search(text) or any(t in text for t in self.added):
            return self.whole(text)
        if len(self.words) > MAX_WORDS:
            self.words.clear()
        known, words = self.words, self.split(text)
        for new in set(words).difference(known):
            known[new] = self.word(new)
        return b"".join(map(known.__getitem__, words))


def pieces(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: a document's ids with the end id, in pieces of at most ``length``.
    vocabulary: the tokenizer file, at the same path on all executors."""
    spark = docs.sparkSession
    small_batches(spark)
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder.of(path)
        for batch in batches:
            out = []
            for doc_id, ids in zip(batch["doc_id"], map(encoder.encode, batch["text"]), strict=True):
                ids += end
                total = len(ids) // 4
                out.extend((doc_id, at, min(length, total - at), zlib.crc32(ids[4 * at : 4 * (at + length)]), total) for at in range(0, total, length))
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInPandas(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, count): lengths that share a sequence, longest first, and in how many sequences."""
    room: dict[int, list[list]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        while todo:
            most = max((r for r, packs in room.items() if packs), default=0)
            if most < length:
                # one opened after the other, each takes what follows while it has room
                each = capacity // length
                for n, count in ((each, todo // each), (todo % each, 1)):
                    if n and count:
                        room[capacity - length * n].append([(length,) * n, count])
                break
            pattern, count = room[most].pop()
            n = min(todo, count)
            if n < count:
                room[most].append([pattern, count - n])
            room[most - length].append([(*pattern, length), n])
            todo -= n
    return [(p, n) for r in sorted(room) for p, n in room[r]]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: first rank, places a sequence, first sequence and first offset, for each pattern that has the length."""
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    upto: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, count in patterns:
        at = i = 0
        while i < len(pattern):
            n = 1
            while i + n < len(pattern) and pattern[i + n] == pattern[i]:
                n += 1
            length = pattern[i]
            rows[length].append((upto[length], n, sequence, at))
            upto[length] += n * count
            at, i = at + n * length, i + n
        sequence += count
    return {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v, strict=True)) for k, v in rows.items()}


def ranked(rows: DataFrame) -> DataFrame:
    """Adds ``rank``, gapless from 0 within each length."""
    parts = max(PARTS, rows.count() // PIECES_A_PART)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)).cast("int"))
    counts = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32", "doc_tokens"))
    return dealt.withColumn("own", own).join(counts, ["length", "part"]).withColumn("rank", F.col("before") + F.col("own") - 1).drop("part", "own", "before")


def pack(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id (from 0), offset (gapless from 0 in
    each sequence).

    Null and empty texts are the end id alone, null ids and repeated rows are documents like others, an empty table
    gives no rows, other columns are left out. Each id lies in exactly one piece.
    """
    spark = docs.sparkSession
    rows = stored(pieces(docs, length, end_id, vocabulary), "pieces")
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    table = spark.sparkContext.broadcast(places(shortest_pack_first(histogram, length)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence, offset = np.empty(len(batch), dtype=np.int64), np.empty(len(batch), dtype=np.int64)
            lengths, ranks = batch["length"].to_numpy(), batch["rank"].to_numpy()
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                first, each, base, begin = table.value[int(n)]
                k = np.searchsorted(first, ranks[at], side="right") - 1
                nth = ranks[at] - first[k]
                sequence[at], offset[at] = base[k] + nth // each[k], begin[k] + nth % each[k] * n
            yield batch.drop(columns="rank").assign(sequence_id=sequence, offset=offset).astype({"doc_id": "Int64"})

    numbered = ranked(rows).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank")
    return numbered.mapInPandas(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
