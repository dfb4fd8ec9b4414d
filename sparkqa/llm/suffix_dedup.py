"""Suffix-array deduplication of repeated byte strings across documents.

Every 100-byte string has an anchor: the place in it whose next 24 bytes have the smallest hash (leftmost of equals).
Equal strings have their anchors at equal places, so it is enough to sort the suffixes that start at anchors, about one
in 35 bytes: a sparse suffix array. A suffix row stands for a run, the consecutive strings that share its anchor, and
holds the suffix's leading tokens, a digest of the run's bytes, and its place.

1. Copies of whole texts are found by digest; each first text is stored once, bucketed by document.
2. Suffix rows are dealt into ranges by splitters sampled from the rows. The place is the last part of the order, so a
   suffix that a third of all documents have is split over many ranges. Within its range Spark sorts them key after key,
   spilling where it must, and a task reads them in order: equal runs after the first are repeats; what continues from the
   range before is settled by comparing range borders. A task holds one batch and the first runs of one group of equal
   tokens, up to ``GROUP_ROWS``, so ranges may be of any size.
3. First runs whose leading tokens other runs share are compared string by string, with their bytes. Groups of more than
   ``GROUP_ROWS``, and those at range borders, compare digests of their strings in a join instead, which Spark can split,
   without a cap.
4. Ranges of repeated strings are merged per document and cut out.

Runs count as equal when their first eight bytes are, and their digests of 128 bits (XXH3 of the whole run and its shape).
Everything else is settled on bytes, or on digests of 128 bits too.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkqa.llm.shared import documents, new_folder, stored, with_order
from sparkqa.llm.textwork import mixed, powers, small_batches

LENGTH, TOKEN = 100, 24
#: Rows a range is to have; ranges and rows of the sample at most (beyond that ranges grow, which only makes them longer).
RANGE_ROWS, MAX_RANGES, SAMPLE_A_RANGE, MAX_SAMPLE = 200_000, 1 << 17, 64, 1_000_000
GROUP_ROWS = 2_000
#: Bytes a bucket of texts is to have, and buckets at most (beyond that they grow; they are read row by row).
BUCKET_BYTES, MAX_BUCKETS = 12_000_000, 100_000
#: Kinds of rows that a range gives: a repeat, a first run to compare by bytes, the range's first run, its last, and a first
#: run to compare by digests.
REPEAT, COMPARED, OPENING, CLOSING, DIGESTED = range(5)

_values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def suffix_rows(text: bytes, length: int = LENGTH) -> np.ndarray | None:
    """(t0, t1, run, run2, place) rows of a text: leading eight bytes, hash of the next sixteen, digest of the run, and the
    anchor's position with its distances from the run's first and last start."""
    b = np.frombuffer(text, dtype=np.uint8)
    n, w = len(b), length - TOKEN + 1
    if n < length:
        return None
    p, q = powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_values[b] * p[:n], out=sums[1:])
    h = mixed((sums[TOKEN:] - sums[:-TOKEN]) * q[: n - TOKEN + 1])
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while 2 * step <= w:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if w > step:
        low = np.minimum(low[: step - w], low[w - step :])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:] - 1, [len(at) - 1]))
    a = at[first]
    t0 = np.zeros(len(a), dtype=np.uint64)
    for i in range(8):
        t0 = (t0 << np.uint64(8)) | b[a + i]
    t1 = mixed((sums[a + TOKEN] - sums[a + 8]) * q[a + 8])
    place = a << 16 | (a - first) << 8 | (a - last)
    shapes = (place & 0xFFFF).tolist()
    digests = [xxhash.xxh3_128_digest(text[x : y + length], shape) for x, y, shape in zip(first.tolist(), last.tolist(), shapes, strict=True)]
    run = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
    return np.stack([(t0 ^ np.uint64(1 << 63)).view(np.int64), t1.view(np.int64), run[:, 0], run[:, 1], place])


KEYS = ["t0", "t1", "run", "run2", "ord", "place"]


def _comparable(keys: list[np.ndarray]) -> np.ndarray:
    """Rows as byte strings that compare like the keys."""
    out = np.empty((len(keys[0]), len(keys)), dtype=">u8")  # stacked, they would turn to the machine's byte order
    for i, k in enumerate(keys):
        out[:, i] = k.view(np.uint64) ^ np.uint64(1 << 63)
    return out.view(f"S{8 * len(keys)}").ravel()


def _suffixes(batches: Iterator[pd.DataFrame], length: int, split=None) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [(o, suffix_rows(t.encode("utf-8", "surrogatepass"), length)) for o, t in zip(batch["ord"], batch["text"], strict=True)]
        found = [(o, r) for o, r in found if r is not None]
        for at in range(0, len(found), 64):
            part = found[at : at + 64]
            t0, t1, run, run2, place = np.concatenate([r for _, r in part], axis=1)
            ord_ = np.repeat(np.array([o for o, _ in part], dtype=np.int64), [r.shape[1] for _, r in part])
            frame = {"t0": t0, "t1": t1, "run": run, "run2": run2, "ord": ord_, "place": place}
            if split is not None:
                frame["part"] = split([t0, t1, run, run2, ord_, place])
            yield pd.DataFrame(frame)


def splitter(rows: np.ndarray):
    """Deals keys into ranges: the number of splitters (sorted rows of KEYS) at or below each."""
    whole = _comparable(list(np.ascontiguousarray(rows.T))) if len(rows) else np.empty(0, dtype=f"S{8 * len(KEYS)}")
    heads = rows[:, 0].copy() if len(rows) else np.empty(0, dtype=np.int64)

    def split(keys: list[np.ndarray]) -> np.ndarray:
        out, end = np.searchsorted(heads, keys[0], side="left"), np.searchsorted(heads, keys[0], side="right")
        tied = np.flatnonzero(out != end)
        if len(tied):
            out[tied] = np.searchsorted(whole, _comparable([np.ascontiguousarray(k[tied]) for k in keys]), side="right")
        return out.astype(np.int32)

    return split


COLUMNS = ["part", *KEYS]


def _changes(rows: np.ndarray, columns: slice) -> np.ndarray:
    """Rows that differ from the one before in these columns, the first one included."""
    return np.concatenate(([True], (rows[1:, columns] != rows[:-1, columns]).any(1)))


def runs_of_ranges(batches: Iterator[pd.DataFrame], group_rows: int) -> Iterator[pd.DataFrame]:
    """Of suffix rows in the order of (range, keys): their kinds, without runs that share their tokens with no other."""
    held, opening, large = np.empty((0, len(COLUMNS)), dtype=np.int64), True, False

    def told(kind: np.ndarray, rows: np.ndarray) -> pd.DataFrame:
        kept = kind >= 0
        return pd.DataFrame(rows[kept], columns=COLUMNS).assign(kind=kind[kept])[["kind", *KEYS, "part"]]

    def settled(rows: np.ndarray, ended: bool) -> Iterator[pd.DataFrame]:
        """rows: the held first runs of the open group, and what follows; ended: nothing more comes."""
        nonlocal held, opening, large
        known = len(held)
        new_part, new_group = _changes(rows, slice(0, 1)), _changes(rows, slice(0, 3))
        first = _changes(rows, slice(0, 5))
        starts = np.flatnonzero(new_group)
        group = np.cumsum(new_group) - 1
        opens = new_part[starts]
        opens[0] = opening if known else True
        closes = np.append(opens[1:], ended)
        n = np.bincount(group, weights=first, minlength=len(starts))
        by_digest = opens | closes | (n > group_rows)
        by_digest[0] |= large
        kind = np.where(~first, REPEAT, np.where(by_digest, DIGESTED, np.where(n > 1, COMPARED, -1))[group])
        kind[starts[opens]] = OPENING
        if large:
            kind[:known] = -1  # they are out
        last = starts[-1]
        mine = rows[last:][first[last:]]
        if not ended:
            kind[last:][first[last:]] = -1
            opening, large = bool(opens[-1]), large and last == 0
            if large or len(mine) > group_rows:
                at = np.arange(len(mine))
                new = at >= (known if large else 0)
                yield told(np.where(new, np.where((at == 0) & opening, OPENING, DIGESTED), -1), mine)
                mine, large = mine[-1:], True
        yield told(kind, rows)
        ends = np.flatnonzero(closes)
        tails = np.append(starts[1:], len(rows))[ends] - 1
        yield told(np.full(len(tails), CLOSING), rows[tails])
        held = mine[:0] if ended else mine

    for batch in batches:
        rows = np.concatenate((held, batch[COLUMNS].to_numpy(dtype=np.int64)))
        if len(batch):
            yield from settled(rows, False)
    if len(held):
        yield from settled(held, True)


def _strings(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """Runs with their bytes. In: ord, text, runs as flat (t0, t1, place) numbers."""
    for batch in batches:
        out = []
        for ord_, text, runs in zip(batch["ord"], batch["text"], batch["runs"], strict=True):
            b = text.encode("utf-8", "surrogatepass")
            for t0, t1, place in np.asarray(runs, dtype=np.int64).reshape(-1, 3):
                a = int(place >> 16)
                out.append((t0, t1, ord_, a - int(place >> 8 & 255), b[a - int(place >> 8 & 255) : a - int(place & 255) + length]))
        yield pd.DataFrame(out, columns=["t0", "t1", "ord", "lo", "bytes"])


def _digests(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """A digest of each string of the runs. In: as ``_strings``."""
    for batch in _strings(batches, length):
        out = []
        for ord_, lo, data in zip(batch["ord"], batch["lo"], batch["bytes"], strict=True):
            out.extend((hashlib.blake2b(data[i : i + length], digest_size=16).digest(), ord_, lo + i) for i in range(len(data) - length + 1))
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=["digest", "ord", "lo"])
                out = []
        yield pd.DataFrame(out, columns=["digest", "ord", "lo"])


def _compare(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """Ranges of repeated strings of each group with equal tokens, rows in order; groups have at most ``GROUP_ROWS`` rows."""
    held: list[tuple[int, int, bytes]] = []
    key = None

    def settle() -> list[tuple]:
        out, seen = [], set()
        for ord_, lo, data in held:
            begun = None
            for i in range(len(data) - length + 1):
                s = data[i : i + length]
                if s in seen:
                    begun = i if begun is None else begun
                else:
                    seen.add(s)
                    if begun is not None:
                        out.append((ord_, lo + begun, lo + i - 1))
                        begun = None
            if begun is not None:
                out.append((ord_, lo + begun, lo + len(data) - length))
        return out

    for batch in batches:
        out = []
        for t0, t1, ord_, lo, data in batch.itertuples(index=False):
            if (t0, t1) != key:
                out += settle()
                key, held = (t0, t1), []
            held.append((ord_, lo, data))
        yield pd.DataFrame(out, columns=["ord", "lo", "hi"])
    yield pd.DataFrame(settle(), columns=["ord", "lo", "hi"])


def _cut(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for ord_, text, ranges in zip(batch["ord"], batch["text"], batch["ranges"], strict=True):
            b, r = text.encode("utf-8", "surrogatepass"), np.sort(np.asarray(ranges, dtype=np.int64))
            lo, hi = r >> 8, (r >> 8) + (r & 255) + length
            upto = np.maximum.accumulate(hi)
            new = np.concatenate(([True], lo[1:] > upto[:-1]))
            begin, end = lo[new], np.concatenate((upto[:-1][new[1:]], upto[-1:]))
            digest, at = hashlib.sha256(), 0
            for x, y in zip(begin.tolist(), end.tolist(), strict=True):
                digest.update(b[at:x])
                at = y
            digest.update(b[at:])
            out.append((ord_, int((end - begin).sum()), len(begin), digest.hexdigest(), begin.tolist(), end.tolist()))
        yield pd.DataFrame(out, columns=["ord", "n_removed", "n_spans", "kept_sha256", "span_start", "span_end"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, range_rows: int = RANGE_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, span_start and span_end (arrays; null for a
    text that is a copy of an earlier one and goes as a whole).

    A byte is removed when some string of ``length`` bytes (at least 32, at most 270) that covers it also starts
    earlier: in a document with smaller doc_id, or earlier in the same one. Strings are judged on the input. Null texts
    are empty; repeated ids go by text, null ids first; an empty table gives no rows; long texts are taken whole; other
    columns are left out.
    """
    if not TOKEN + 8 <= length <= 270:
        raise ValueError("length must be from 32 to 270")
    spark = docs.sparkSession
    small_batches(spark)
    docs = with_order(docs)
    size = F.octet_length("text").cast("long")
    told = stored(docs.select("ord", "doc_id", size.alias("n_bytes"), F.sha2("text", 256).alias("sha256")), "told")
    firsts = told.groupBy("sha256").agg(F.min("ord").alias("first"))
    told = stored(told.join(firsts, "sha256").withColumn("copy", F.col("ord") != F.col("first")).drop("first"), "told")

    own = told.where(~F.col("copy") & (F.col("n_bytes") >= length))
    total = own.agg(F.sum("n_bytes"), F.count("*")).first()
    buckets = min(MAX_BUCKETS, max(4, (total[0] or 0) // BUCKET_BYTES))
    texts = docs.select("ord", "text").repartition(buckets, "ord").join(own.select("ord"), "ord")
    name = f"texts_{uuid.uuid4().hex}"
    texts.write.option("path", new_folder(spark, "texts")).option("compression", "zstd").bucketBy(buckets, "ord").sortBy("ord").saveAsTable(name)
    texts = spark.table(name)
    texts.schema  # resolved here, so the catalog's entry can go; the files stay
    spark.sql(f"DROP TABLE {name}")

    row = "t0 long, t1 long, run long, run2 long, ord long, place long"
    ranges = min(MAX_RANGES, max(1, (total[0] or 0) // 30 // range_rows))
    splitters = np.empty((0, len(KEYS)), dtype=np.int64)
    if ranges > 1:
        wanted = min(MAX_SAMPLE, SAMPLE_A_RANGE * ranges)
        every = max(1, total[1] // max(200, wanted // 16))
        some = texts.where(F.pmod(F.xxhash64("ord"), F.lit(every)) == 0).mapInPandas(lambda b: _suffixes(b, length), row)
        share = min(1.0, 1.5 * wanted * every * 35 / total[0])
        drawn = some.where(F.pmod(F.xxhash64(*KEYS), F.lit(1 << 62)) < F.lit(int(share * (1 << 62)))).toPandas()[KEYS].to_numpy()
        drawn = drawn[np.lexsort(drawn.T[::-1])]
        splitters = drawn[np.unique(np.linspace(0, len(drawn), ranges + 1)[1:-1].astype(int))] if len(drawn) else splitters
    split = splitter(splitters)
    dealt = texts.mapInPandas(lambda b: _suffixes(b, length, split), f"{row}, part int")
    sorted_ = dealt.repartition("part").sortWithinPartitions(*COLUMNS)
    ordered = stored(sorted_.mapInPandas(lambda b: runs_of_ranges(b, group_rows), f"kind int, {row}, part int"), "ranges")

    # what a range starts with is a repeat if an earlier range ends with it
    ends = ordered.where(F.col("kind") == CLOSING).groupBy("t0", "t1", "run", "run2").agg(F.min("part").alias("from"))
    starts = ordered.where(F.col("kind") == OPENING).join(ends, ["t0", "t1", "run", "run2"], "left").withColumn("again", F.coalesce(F.col("from") < F.col("part"), F.lit(False)))
    starts = stored(starts.select("again", "t0", "t1", "ord", "place"), "starts")
    repeats = ordered.where(F.col("kind") == REPEAT).select("ord", "place").unionByName(starts.where("again").select("ord", "place"))

    runs = F.flatten(F.collect_list(F.array("t0", "t1", "place"))).alias("runs")
    by_bytes = ordered.where(F.col("kind") == COMPARED).groupBy("ord").agg(runs)
    strings = texts.join(by_bytes, "ord").select("ord", "text", "runs").mapInPandas(lambda b: _strings(b, length), "t0 long, t1 long, ord long, lo long, bytes binary")
    grouped = strings.repartition("t0", "t1").sortWithinPartitions("t0", "t1", "ord", "lo")
    compared = stored(grouped.mapInPandas(lambda b: _compare(b, length), "ord long, lo long, hi long"), "compared")
    by_digest = ordered.where(F.col("kind") == DIGESTED).select("t0", "t1", "ord", "place").unionByName(starts.where("not again").drop("again"))
    digested = texts.join(by_digest.groupBy("ord").agg(runs), "ord").select("ord", "text", "runs")
    many = stored(digested.mapInPandas(lambda b: _digests(b, length), "digest binary, ord long, lo long"), "digests")
    earliest = many.groupBy("digest").agg(F.min(F.struct("ord", "lo")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = many.join(earliest, "digest").where(F.struct("ord", "lo") != F.col("first")).select("ord", "lo", F.col("lo").alias("hi"))

    lo, hi = _first("place"), _last("place")
    found = repeats.select("ord", lo.alias("lo"), hi.alias("hi")).unionByName(compared).unionByName(again)
    per = found.groupBy("ord").agg(F.collect_list(F.shiftleft("lo", 8).bitwiseOR(F.col("hi") - F.col("lo"))).alias("ranges"))
    cut = texts.join(per, "ord").select("ord", "text", "ranges").mapInPandas(lambda b: _cut(b, length), "ord long, n_removed long, n_spans long, kept_sha256 string, span_start array<long>, span_end array<long>")

    whole = F.col("copy") & (F.col("n_bytes") >= length)
    return told.join(cut, "ord", "left").select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
        "span_start", "span_end",
    )


def _first(place: str) -> Column:
    return F.shiftright(place, 16) - F.shiftright(place, 8).bitwiseAND(255)


def _last(place: str) -> Column:
    return F.shiftright(place, 16) - F.col(place).bitwiseAND(255)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
