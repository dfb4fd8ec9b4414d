"""SimHash near-deduplication by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into four blocks of 16 bits. If two fingerprints differ in at most three bits, one block is
equal in both (pigeonhole), and of the other 48 bits, in two halves, one half differs in at most one bit. So the keys
(block, its bits, half, Golay codewords near the half) join every such pair: 8 places with up to 6 codewords each, about
42 keys a fingerprint, in a key space of 28 bits a place. Pairs that meet are verified on all bits.

Equal fingerprints are joined first, so a group of copies is one fingerprint. Within a key, links are followed breadth
first and only the links that connect something new are kept, never all pairs. Keys with more fingerprints than one task
should hold are compared block against block in many tasks.

Near duplicates by resemblance (``similar_rows``) take these links of five-word fingerprints as candidates. Resemblance of
0.8 bounds no number of bits, so an exact prefix filter adds the pairs whose fingerprints are further apart; all candidates
are verified on whole shingle sets before anything is connected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkqa.llm import golay
from sparkqa.llm.shared import components, documents, free, quoted, stored, with_order
from sparkqa.llm.textwork import mixed, shingle_hashes, small_batches, word_hashes

SHINGLE, RADIUS, KEY_ROWS = 3, 3, 2_000
SIMILARITY, SIMILAR_SHINGLE = 0.8, 5
SAMPLE_ROWS, COMMON = 10_000, 200_000
#: Rows of a block of a large key, and blocks such a key is cut into at least (as long as they have ``KEY_ROWS``): few blocks
#: mean few copies of rows, and several keep a key from being one task's work.
BLOCK_ROWS, BLOCKS = 20_000, 8
#: Shingles whose sets one task compares at once.
BLOCK_SHINGLES = 1_000_000
#: Rows whose keys a task makes at once.
KEYED_ROWS = 256
#: Bits of the sketches that candidates are compared by before their sets are, the differing bits that are too many, and the
#: shingles from which on that is asked. Sets of resemblance 0.8 differ in 38 bits of 256 (standard deviation 6), so 80 is
#: seven deviations off: a pair is lost with a chance below 1e-11.
WORDS, FAR, FAR_FROM = 4, 80, 64


def majority(hashes: np.ndarray, weights: np.ndarray | None = None) -> int:
    """64 bits, each set where over half of the hashes (by number, or by weight) have it; 0 without hashes."""
    counts = np.zeros(64, dtype=np.int64 if weights is None else np.float64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)], dtype="<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64) if weights is None else weights[at : at + (1 << 16)] @ bits
    half = len(hashes) if weights is None else weights.sum()
    return int(np.packbits(2 * counts > half, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """SimHash of the XXH64 (seed 42) of the text's shingles, A-Z lower-cased, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), min(n, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    ends, digest = (ends - 1).tolist(), xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[s:e], 42) for s, e in zip(starts, ends[n - 1 :], strict=False)], dtype=np.uint64))


def places(fingerprints: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The 8 (block, half) places: number, the block's bits, and the 23 bits of the half that are decoded."""
    f = fingerprints.view(np.uint64)
    part = lambda i: (f >> np.uint64(16 * i)) & np.uint64(0xFFFF)
    for block in range(4):
        a, b, c = (part(i) for i in range(4) if i != block)
        rest = (a << np.uint64(32) | b << np.uint64(16) | c).astype(np.int64)
        for half in range(2):
            yield 2 * block + half, part(block).astype(np.int64), rest >> 24 * half & (1 << golay.BITS) - 1


def keys(fingerprints: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, keys) of fingerprints (int64). salt keeps the keys of different fingerprints of a document apart."""
    rows, out = [], []
    for place, exact, word in places(fingerprints):
        near = golay.keys(word)
        row, nth = np.nonzero(near >= 0)
        rows.append(row)
        out.append((np.int64(8 * salt + place) << 28) | (exact[row] << 12) | near[row, nth])
    return np.concatenate(rows), np.concatenate(out)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of fingerprints, (n, words) each."""
    return np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int64).sum(-1)


def forest(ids: np.ndarray, bits: np.ndarray, radius: int, groups: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what ``radius`` connects, by breadth-first search. groups: only rows of different groups link."""
    out, left = [], np.arange(len(ids))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = distances(bits[left], bits[i]) <= radius
            if groups is not None:
                near &= groups[left] != groups[i]
            if near.any():
                found = left[near]
                out.extend((int(ids[i]), int(ids[j])) for j in found)
                queue.extend(found)
                left = left[~near]
    return out


def _linked(batches: Iterator[pd.DataFrame], words: list[str], radius: int, key_rows: int, all_pairs: int) -> Iterator[pd.DataFrame]:
    """Links among the rows of each key, rows in key order (kind 0), and the rows of keys that are too large (kind 1)."""
    columns = ["key", "id", *words]
    held, large = pd.DataFrame(columns=columns, dtype=np.int64), None

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        key, ids, bits = rows["key"].to_numpy(), rows["id"].to_numpy(), rows[words].to_numpy(dtype=np.int64)
        new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.empty(0, dtype=bool)
        first = np.flatnonzero(new)
        size = np.diff(np.concatenate((first, [len(key)])))
        of = np.repeat(size, size)
        a, b = [], []
        for gap in range(1, all_pairs):
            at = np.flatnonzero((key[gap:] == key[:-gap]) & (of[gap:] <= all_pairs)) if len(key) > gap else []
            if len(at):
                at = at[distances(bits[at], bits[at + gap]) <= radius]
                a.append(ids[at])
                b.append(ids[at + gap])
        for s, n in zip(first[size > all_pairs], size[size > all_pairs], strict=True):
            if pairs := forest(ids[s : s + n], bits[s : s + n], radius):
                x, y = np.array(pairs, dtype=np.int64).T
                a.append(x)
                b.append(y)
        a, b = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (a, b))
        return pd.DataFrame({"kind": np.int32(0), "key": np.int64(0), "id": a, "other": b})

    def deferred(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"kind": np.int32(1), "key": rows["key"], "id": rows["id"], "other": np.int64(0)})

    for batch in batches:
        if large is not None:
            more = batch["key"] == large
            yield deferred(batch[more])
            batch = batch[~more]
            if not len(batch):
                continue
            large = None
        held = pd.concat([held, batch], ignore_index=True) if len(held) else batch.reset_index(drop=True)
        sizes = held.groupby("key", sort=False)["key"].transform("size")
        too_many = sizes > key_rows
        if too_many.any():
            yield deferred(held[too_many])
        last = held["key"].iloc[-1]
        if too_many.iloc[-1]:
            large = last
        ready = ~too_many & (held["key"] != last)
        yield links(held[ready])
        held = held[~too_many & (held["key"] == last)]
    yield links(held)


def links(keyed: DataFrame, words: list[str], radius: int, key_rows: int = KEY_ROWS, all_pairs: int = 4) -> DataFrame:
    """(a, b) links among rows (key, id, the fingerprint's words) that share a key: at most one per row and key that
    connects something new (all pairs of up to ``all_pairs`` rows)."""
    ordered = keyed.repartition("key").sortWithinPartitions("key", "id")
    out = stored(ordered.mapInPandas(lambda b: _linked(b, words, radius, key_rows, all_pairs), "kind int, key long, id long, other long"), "links")
    few = out.where("kind = 0").select(F.col("id").alias("a"), F.col("other").alias("b"))
    many = out.where("kind = 1").select("key", "id")
    if many.isEmpty():
        return few.distinct()

    # large keys: their rows in blocks, each pair of blocks in a task of its own; a row goes out once a block
    blocks = many.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.least(F.ceil(F.count("*") / key_rows), F.lit(BLOCKS))).cast("int").alias("blocks"))
    rows = keyed.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "id", *words)

    def against(part: pd.DataFrame) -> pd.DataFrame:
        x, y = part["x"].iloc[0], part["y"].iloc[0]
        pairs = forest(part["id"].to_numpy(), part[words].to_numpy(dtype=np.int64), radius, None if x == y else part["block"].to_numpy())
        return pd.DataFrame(pairs, columns=["a", "b"], dtype=np.int64)

    return few.unionByName(rows.groupBy("key", "x", "y").applyInPandas(against, "a long, b long")).distinct()


def linked_fingerprints(docs: DataFrame, n: int = SHINGLE, radius: int = RADIUS, key_rows: int = KEY_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id, the smallest doc_id among all that
    chains of links reach; fingerprints link at ``radius`` (at most 3) or fewer differing bits.

    Null texts and texts without words have fingerprint 0, linked like any other. Repeated rows and ids share components,
    null ids never give a component its id, an empty table gives no rows, other columns are left out.
    """
    if not 0 <= radius <= 3:
        raise ValueError("the keys find pairs of at most 3 differing bits")
    small_batches(docs.sparkSession)

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([fingerprint(t, n) for t in batch["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "f": found})

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            f = batch["f"].to_numpy()
            row, key = keys(f)
            yield pd.DataFrame({"key": key, "id": f[row], "f": f[row]})

    rows = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(told, "doc_id long, f long"), "fingerprints")
    distinct = stored(rows.groupBy("f").agg(F.min("doc_id").alias("low")), "distinct")
    edges = links(distinct.select("f").mapInPandas(keyed, "key long, id long, f long"), ["f"], radius, key_rows)
    reached = components(edges)
    each = distinct.join(reached, distinct["f"] == reached["node"], "left").select("f", "low", F.coalesce("component", "f").alias("c"))
    smallest = each.groupBy("c").agg(F.min("low").alias("component_id"))
    of = each.join(smallest, "c").select("f", "component_id")
    return rows.join(of, "f").select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, n: int = SIMILAR_SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``n`` words."""
    return np.unique(shingle_hashes(word_hashes((text or "").encode("utf-8", "surrogatepass")), n))


def common_shingles(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sorted; counts) of shingles that are frequent in a sample of the rows. They only decide in which order
    prefixes are taken: any order gives the same pairs, an order by frequency gives the fewest candidates."""
    every = max(1, rows.count() // SAMPLE_ROWS)

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            h, c = np.unique(np.concatenate([np.empty(0, dtype=np.uint64), *(shingle_set(t, n) for t in batch["text"])]), return_counts=True)
            yield pd.DataFrame({"h": h.view(np.int64), "c": c})

    sample = rows.where(F.pmod(F.xxhash64("ord"), F.lit(every)) == 0).select("text").mapInPandas(told, "h long, c long")
    counts = sample.groupBy("h").agg(F.sum("c").alias("c")).where("c > 2").orderBy(F.desc("c"), "h").limit(COMMON).toArrow()
    h, c = counts["h"].to_numpy().view(np.uint64), counts["c"].to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


def prefix(shingles: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The shingles, rarest first, of which two sets share one if their resemblance is ``similarity`` or more."""
    if not len(shingles):
        return shingles
    h, c = common
    count = np.zeros(len(shingles), dtype=np.int64)
    if len(h):
        at = np.minimum(np.searchsorted(h, shingles), len(h) - 1)
        count = np.where(h[at] == shingles, c[at], 0)
    return shingles[np.lexsort((shingles, count))[: len(shingles) - int(np.ceil(similarity * len(shingles) - 1e-6)) + 1]]


def connected(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of places that connect what pairs of sets with the resemblance connect, by breadth-first search. One set is
    compared with all others at once, exactly."""
    sizes = np.array([len(s) for s in sets])
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    mark = np.zeros(number.max() + 1, dtype=np.int32)
    out, left = [], np.ones(len(sets), dtype=bool)
    while left.any():
        queue = [int(left.argmax())]
        left[queue] = False
        while queue and left.any():
            i = queue.pop()
            own = number[starts[i] : starts[i] + sizes[i]]
            mark[own] = 1
            common = np.add.reduceat(mark[number], starts)
            mark[own] = 0
            near = left & (common >= similarity * (sizes[i] + sizes - common) - 1e-9)
            found = np.flatnonzero(near).tolist()
            out.extend((i, j) for j in found)
            queue.extend(found)
            left &= ~near
    return out


def _verified(batches: Iterator[pd.DataFrame], similarity: float) -> Iterator[pd.DataFrame]:
    """Links that connect the rows (id, shingles) of each family and pair of blocks, which come one after the other."""
    key, ids, sets = None, [], []

    def links() -> pd.DataFrame:
        pairs = connected(sets, similarity) if len(sets) > 1 else []
        a, b = (np.array([ids[p[side]] for p in pairs], dtype=np.int64) for side in (0, 1))
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    for batch in batches:
        for family, x, y, id_, shingles in zip(batch["family"], batch["x"], batch["y"], batch["id"], batch["shingles"], strict=True):
            if (family, x, y) != key:
                yield links()
                key, ids, sets = (family, x, y), [], []
            ids.append(id_)
            sets.append(np.frombuffer(shingles, "<u8"))
    yield links()


def similar_rows(rows: DataFrame, similarity: float = SIMILARITY, n: int = SIMILAR_SHINGLE, key_rows: int = KEY_ROWS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(node, component) of the rows (ord, text) that have near duplicates: their ord and the smallest of their group.

    Near duplicates have a resemblance of ``similarity`` or more on the sets of shingles of ``n`` words; a group is what
    chains of such pairs connect. Rows meet under the Golay keys of their SimHash fingerprints and under the keys of a
    prefix filter, which is exact: with the shingles of all sets in one order, two sets of that resemblance share one of
    the first (1 - similarity) of each. Shingles known as frequent come last in the order.

    Rows that meet and whose SimHash sketches are not too far apart (see ``FAR``) are candidates. What candidates connect
    are families; each key gives only the links that connect something, never all pairs, and as many families come out as
    from all pairs. Within a family all pairs of whole sets are settled, and only pairs with the resemblance connect rows:
    so no link is lost to one that was left out. Rows with equal sets are one row for all that. A family's first row is
    compared with all others; rows similar to it are connected through it and need no comparison among themselves. The
    others, if any, are compared with each other and with all of these, in blocks of bounded size, each pair of blocks in a
    task of its own. So a family of near copies of one text costs its rows once, however large it is.

    Texts without words form no groups; long texts are taken whole.
    """
    spark = rows.sparkSession
    small_batches(spark)
    common = spark.sparkContext.broadcast(common_shingles(rows, n))
    small = FAR_FROM / similarity if similarity >= SIMILARITY else np.inf  # below, a similar set may be too small for FAR
    bits = [f"b{i}" for i in range(WORDS)]

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t, n) for t in batch["text"]]
            sketch = np.array([[majority(mixed(s + np.uint64(i)) if i else s) for i in range(WORDS)] for s in sets], dtype=np.uint64).reshape(-1, WORDS).view(np.int64)
            frame = {"ord": batch["ord"], "same": [hashlib.blake2b(s, digest_size=16).digest() for s in sets], "size": [len(s) for s in sets], "keys": [prefix(s, similarity, common.value).view(np.int64) for s in sets]}
            yield pd.DataFrame(frame | dict(zip(bits, sketch.T, strict=True)))

    def golay_keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            f = batch["f"].to_numpy()
            row, key = keys(f)
            yield pd.DataFrame({"key": key, "id": f[row], "f": f[row]})

    def prefix_keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Small sets also meet under keys of their own, where no bits keep them apart."""
        for batch in batches:
            parts = (batch.iloc[at : at + KEYED_ROWS] for at in range(0, len(batch), KEYED_ROWS))
            for rows_, salt in ((part[part["size"] >= FAR_FROM] if large else part[part["size"] < small], 1 - large) for part in parts for large in (1, 0)):
                many = np.array([len(k) for k in rows_["keys"]], dtype=np.int64)
                key = np.concatenate([np.empty(0, dtype=np.int64), *rows_["keys"]]).view(np.uint64)
                frame = {"key": (mixed(key) if salt else key).view(np.int64), "id": np.repeat(rows_["ord"].to_numpy(), many)}
                yield pd.DataFrame(frame | {b: np.repeat(np.zeros(len(rows_), dtype=np.int64) if salt else rows_[b].to_numpy(), many) for b in bits})

    every = stored(rows.select("ord", "text").mapInPandas(told, f"ord long, same binary, size int, keys array<long>, {', '.join(f'{b} long' for b in bits)}"), "sketches").where("size > 0")
    copies = every.groupBy("same").agg(F.min("ord").alias("low"), F.count("*").alias("n")).where("n > 1").select("same", "low")
    copies = stored(every.select("ord", "same").join(copies, "same").where("ord <> low").select(F.col("low").alias("a"), F.col("ord").alias("b")), "equal-sets")
    sketches = every.drop("same").join(copies.select(F.col("b").alias("ord")), "ord", "left_anti")
    firsts = stored(sketches.groupBy(F.col("b0").alias("f")).agg(F.min("ord").alias("low")), "firsts")
    near = links(firsts.select("f").mapInPandas(golay_keyed, "key long, id long, f long"), ["f"], RADIUS, key_rows)
    near = near.join(firsts.toDF("a", "low_a"), "a").join(firsts.toDF("b", "low_b"), "b").select(F.least("low_a", "low_b").alias("a"), F.greatest("low_a", "low_b").alias("b"))
    equal = sketches.join(firsts, sketches["b0"] == firsts["f"]).where("ord <> low").select(F.col("low").alias("a"), F.col("ord").alias("b"))
    met = links(sketches.mapInPandas(prefix_keyed, f"key long, id long, {', '.join(f'{b} long' for b in bits)}"), bits, FAR, key_rows)
    families = components(met.unionByName(near).unionByName(equal)).toDF("ord", "family")

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t, n) for t in batch["text"]]
            yield batch[["family", "ord"]].assign(size=[len(s) for s in sets], shingles=[s.astype("<u8").tobytes() for s in sets])

    def like_first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            common = [len(np.intersect1d(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8"), True)) for a, b in zip(batch["shingles"], batch["first"], strict=True)]
            least = similarity * (batch["size"] + batch["first_size"] - np.array(common, dtype=np.int64)) - 1e-9
            yield batch[["family", "ord", "size"]].assign(like=np.array(common, dtype=np.int64) >= least)

    sets = stored(rows.select("ord", "text").join(families, "ord").mapInPandas(sets_of, "family long, ord long, size long, shingles binary"), "sets")
    seeds = sets.where("ord = family").select("family", F.col("shingles").alias("first"), F.col("size").alias("first_size"))
    told_first = stored(sets.where("ord <> family").join(seeds, "family").mapInPandas(like_first, "family long, ord long, size long, like boolean"), "like-first")
    through_first = told_first.where("like").select(F.col("family").alias("a"), F.col("ord").alias("b"))

    # of families with rows unlike the first: those rows in blocks, with all blocks of the family
    shares = told_first.groupBy("family").agg(*[F.ceil(F.sum(F.when(of, F.col("size")).otherwise(0)) / block_shingles).cast("int").alias(c) for c, of in (("apart", ~F.col("like")), ("blocks", F.col("like")))], F.count("*").alias("rows"))
    shares = shares.where("apart > 0 and rows > 1").select("family", "apart", (F.col("apart") + F.col("blocks")).alias("blocks"))
    at = F.xxhash64("ord")
    block = F.when(F.col("like"), F.col("apart") + F.pmod(at, F.greatest(F.col("blocks") - F.col("apart"), F.lit(1)))).otherwise(F.pmod(at, F.col("apart"))).cast("int")
    members = told_first.join(shares, "family").select("ord", block.alias("block"), "blocks", F.when(F.col("like"), F.col("apart")).otherwise(F.col("blocks")).alias("others"))
    paired = sets.select("ord", "family", "shingles").join(members, "ord")
    paired = paired.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).where("blocks = 1 or block <> other")
    paired = paired.select("family", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), F.col("ord").alias("id"), "shingles")
    ordered = paired.repartition("family", "x", "y").sortWithinPartitions("family", "x", "y", "id")
    apart = stored(ordered.mapInPandas(lambda b: _verified(b, similarity), "a long, b long"), "alike")
    return components(apart.unionByName(through_first).unionByName(copies))


def similar_groups(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: its columns (whatever they are called, but for group_id, which is replaced) and
    ``group_id``, a number that near duplicates share (see ``similar_rows``). Null ids, repeated ids and rows are rows of
    their own; an empty table gives none."""
    docs = docs.drop("group_id")
    ord_, node, component = free([*docs.columns, "group_id"], "ord", "node", "component")
    rows = with_order(docs, ord_, keep=True)
    reached = similar_rows(rows.select(F.col(ord_).alias("ord"), "text"), **options).toDF(node, component)
    return rows.join(reached, F.col(ord_) == F.col(node), "left").select(*quoted(docs.columns), F.coalesce(component, ord_).alias("group_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The first row (by doc_id) of each group of near duplicates, with the columns of ``docs``, whatever they are called.
    Only the numbers of the rows that go meet the texts again, in one join."""
    ord_, = free(docs.columns, "ord")
    rows = with_order(docs, ord_, keep=True)
    reached = similar_rows(rows.select(F.col(ord_).alias("ord"), "text"), **options)
    gone = stored(reached.where("node <> component").select(F.col("node").alias(ord_)), "gone")
    return rows.join(gone, ord_, "left_anti").select(*quoted(docs.columns))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_fingerprints(documents(spark, sf_dir))
