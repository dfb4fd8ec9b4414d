"""Retrieval for many queries at once: nearest chunks, deduplication, thresholds, confidence, reranking, contexts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkqa.sources.store import new_path

TOP_K, KEEP, CHUNK_SIMILARITY, ANSWER_SIMILARITY = 8, 5, 0.58, 0.62
#: Bytes of queries that are sent to all tasks, of a block of chunks, scores held at once; cells of the blocked search.
MAX_QUERY_BYTES, BLOCK_BYTES, TILE, CELLS = 64 << 20, 64 << 20, 4 << 20, 256
#: Pairs of a query and a block of chunks that a task holds at once, and those that it passes on at once; rows and columns
#: of the scores that a block is searched by.
ASKS, PASSED, ROWS, COLUMNS = 1 << 18, 10_000, 1 << 10, 1 << 9
#: Bytes of queries that one round of the blocked search shuffles: so many at least, and so many times the input.
ROUND_BYTES, ROUND_TIMES = 128 << 20, 1
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def normalised(vector: Column) -> Column:
    """A vector of length 1; one of zeros stays."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0)))


def similarity_of(distance: Column, metric: str = "l2") -> Column:
    """``1 - d^2 / 2`` between 0 and 1, for unit vectors; metric: ``l2``, or ``squared_l2`` where the store's score is taken
    as a plain distance although it is squared (kept for equal results)."""
    d = distance if metric == "l2" else distance * distance
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - d * d / 2))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The columns of the k largest scores of each row, equal ones by the smaller id; all where there are no more than k.
    Rows of the result are in no order."""
    n = scores.shape[1]
    if n <= k:
        return np.broadcast_to(np.arange(n), scores.shape)
    out = np.argpartition(scores, n - k, axis=1)[:, n - k :]
    least = np.take_along_axis(scores, out, axis=1).min(axis=1)
    for row in np.flatnonzero((scores >= least[:, None]).sum(axis=1) > k):  # ties at the border
        above, ties = np.flatnonzero(scores[row] > least[row]), np.flatnonzero(scores[row] == least[row])
        out[row] = np.concatenate((above, ties[np.argsort(ids[ties], kind="stable")[: k - len(above)]]))
    return out


def _scored(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, chunks: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    """(query_id, id, similarity) of the k best chunks of each query, a tile of scores of bounded size at a time."""
    step = max(1, TILE // max(1, len(ids)))
    for at in range(0, len(query_ids), step):
        scores = np.round(queries[at : at + step] @ chunks.T, 12)  # products of equal vectors may differ in the last bits
        columns = best(scores, ids, k)
        rows = np.repeat(np.arange(len(scores)), columns.shape[1])
        yield pd.DataFrame({"query_id": query_ids[at : at + step][rows], "id": ids[columns.ravel()], "similarity": scores[rows, columns.ravel()]})


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list()).astype(np.float64)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """At most k rows a query and batch or block come in."""
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(chunks: DataFrame, queries: DataFrame, k: int = TOP_K, max_query_bytes: int = MAX_QUERY_BYTES) -> DataFrame:
    """(query_id, id, similarity, rank): the k chunks of highest dot product for each query, equal ones by id. chunks: id,
    vector; queries: query_id, vector; null vectors are left out.

    Queries of up to ``max_query_bytes`` (checked) go to every task as one matrix, and each batch of chunks keeps its k best
    per query, so k rows per query and batch are shuffled. More queries meet the chunks in blocks (``nearest_blocks``)."""
    spark = chunks.sparkSession
    asked = queries.where("vector is not null").select("query_id", "vector")
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    if size.n * (size.d or 0) * 8 > max_query_bytes:
        return nearest_blocks(chunks, queries, k)
    part = asked.toPandas()
    sent = spark.sparkContext.broadcast((part["query_id"].to_numpy(), _matrix(part["vector"]) if len(part) else np.empty((0, 0))))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, matrix = sent.value
        for batch in batches:
            if len(batch) and len(query_ids):
                yield from _scored(query_ids, matrix, batch["id"].to_numpy(), _matrix(batch["vector"]), k)

    return _ranked(chunks.where("vector is not null").select("id", "vector").mapInPandas(search, _hits(chunks, queries)), k)


def _hits(chunks: DataFrame, queries: DataFrame) -> str:
    return f"query_id {dict(queries.dtypes)['query_id']}, id {dict(chunks.dtypes)['id']}, similarity double"


def nearest_blocks(chunks: DataFrame, queries: DataFrame, k: int = TOP_K, cells: int = CELLS, block_bytes: int = BLOCK_BYTES, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """As ``nearest``, for any number of queries: exact, no query or chunk goes to the driver but the pivots.

    Chunks lie in cells around pivots, a sample of at most ``cells`` of them; a cell knows the widest angle to its pivot and
    its vectors' shortest and longest length, which bounds the product of a query with any of them. Each query first
    searches one part of the cell with the highest bound, which gives it a k-th product; then it meets only cells whose
    bound is not below that. Cells are cut into parts, however many equal vectors a cell has, and parts put together to
    blocks of up to ``block_bytes``, at least two for each core. A block is one task's, which holds it and lets the queries
    pass that want anything of it: so a chunk is shuffled once, and a query once a block, not once a cell.

    Where little can be left out, that still grows with the square of the rows. So queries go in rounds, each of which
    shuffles up to ``round_bytes`` of them, or a few times the input if that is more, and leaves nothing but its k best a
    query: the disk that is held at once grows with the input. What is returned is read from there."""
    spark = chunks.sparkSession
    kind = "array<float>" if all(dict(df.dtypes)["vector"] == "array<float>" for df in (chunks, queries)) else "array<double>"
    own = chunks.where("vector is not null").select("id", F.col("vector").cast(kind).alias("vector"))
    asked = queries.where("vector is not null").select("query_id", F.col("vector").cast(kind).alias("vector"))
    size = own.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    schema = _hits(chunks, queries)
    if not size.n:
        return _ranked(spark.createDataFrame([], schema), k)
    every = max(1, size.n // (4 * cells))
    sample = own.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).orderBy(F.xxhash64("id", F.lit(1)), "id").limit(cells).toPandas()
    if not len(sample):
        sample = own.orderBy("id").limit(cells).toPandas()
    pivots = _unit(np.unique(_matrix(sample["vector"]), axis=0))
    sent = spark.sparkContext.broadcast(pivots)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _rows(batch)
            near = _unit(v) @ sent.value.T
            cell = near.argmax(axis=1)
            cosine = np.clip(near[np.arange(len(v)), cell], -1, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(np.arccos(cosine)), pa.array(np.linalg.norm(v, axis=1))], [*batch.schema.names, "cell", "angle", "length"])

    id_kind, query_kind = dict(chunks.dtypes)["id"], dict(queries.dtypes)["query_id"]
    of_chunk = f"id {id_kind}, vector {kind}, cell int, angle double, length double"
    told = spark.read.schema(of_chunk).parquet(_stored(own.mapInArrow(placed, of_chunk), "cells"))
    known = told.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("angle"), F.min("length").alias("low"), F.max("length").alias("high")).orderBy("cell").toPandas()  # a row a cell
    width = 8 * max(1, size.d)
    held = max(width, min(block_bytes, size.n * width // (2 * spark.sparkContext.defaultParallelism)))
    parts = np.maximum(1, -(-known["n"].to_numpy() * width // held)).astype(np.int64)
    stats = spark.sparkContext.broadcast((known["cell"].to_numpy(), known["angle"].to_numpy(), known["low"].to_numpy(), known["high"].to_numpy(), parts))
    rows = np.repeat(known["n"].to_numpy() / parts, parts)  # of each part, parts in the order of cells
    block_of = ((np.cumsum(rows) - rows) * width // held).astype(np.int64)
    blocks = int(block_of[-1]) + 1
    at = list(zip(np.repeat(known["cell"].to_numpy(), parts).tolist(), (np.arange(len(rows)) - np.repeat(np.cumsum(parts) - parts, parts)).tolist(), np.repeat(parts, parts).tolist(), block_of.tolist()))
    of_part = F.broadcast(spark.createDataFrame([(c, p, b) for c, p, _, b in at], "cell int, part long, group long"))  # at most a row a cell and some a block
    of_cell = F.broadcast(spark.createDataFrame([(c, n) for c, p, n, _ in at if not p], "cell int, parts long"))
    parted = told.join(of_cell, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), "id", "vector")

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from _wanted(batch, sent.value, stats.value, True)

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, block in _pairs(_rows(batch), batch.column("floor").to_numpy(), sent.value, stats.value, False, block_of):
                row_, block_ = pa.array(row), pa.array(block)
                yield pa.RecordBatch.from_arrays([block_, *(batch.column(c).take(row_) for c in ("query_id", "vector", "floor"))], ["group", "query_id", "vector", "floor"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = sum(len(row) for row, _, _ in _pairs(_rows(batch), batch.column("floor").to_numpy(), sent.value, stats.value, False, block_of))
            yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    def met(asking: DataFrame, in_groups: DataFrame) -> DataFrame:
        """Both sides as they come to the search: of each group the chunks first."""
        fields = {"group": "long", "side": "int", "cell": "int", "id": id_kind, "query_id": query_kind, "vector": kind, "floor": "double"}
        either = [df.withColumns({c: F.lit(None).cast(t) for c, t in fields.items() if c not in df.columns}).select(*fields) for df in (in_groups.withColumn("side", F.lit(0)), asking.withColumn("side", F.lit(1)))]
        return either[0].unionByName(either[1])

    def floors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, top, _ in _searched(batches, sent.value, stats.value, k):
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vector"), pa.array(top[:, k - 1])], ["query_id", "vector", "floor"])

    def hits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, top, place in _searched(batches, sent.value, stats.value, k):
            if ids is not None:
                row, column = np.nonzero(place < len(ids))
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(row)), ids.take(pa.array(place[row, column])), pa.array(top[row, column])], ["query_id", "id", "similarity"])

    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # the files of a shuffle go when the job that needed them is over, not when the driver collects garbage
    try:
        asks = asked.withColumn("block", F.xxhash64("query_id")).mapInPandas(first, f"cell int, part long, block long, query_id {query_kind}, vector {kind}")
        each = asks.groupBy("cell").agg(F.count("*").alias("n")).toPandas()  # a row a cell
        if not len(each):
            return _ranked(spark.createDataFrame([], schema), k)
        splits = F.broadcast(spark.createDataFrame([(int(c), int(-(-n * width // held))) for c, n in zip(each["cell"], each["n"])], "cell int, splits long"))
        group = lambda split: F.shiftleft(F.col("cell").cast("long"), 32) + split
        in_groups = parted.where("part = 0").join(splits, "cell").withColumn("split", F.explode(F.sequence(F.lit(0).cast("long"), F.col("splits") - 1))).withColumn("group", group(F.col("split")))
        asking = asks.join(splits, "cell").withColumn("group", group(F.pmod("block", "splits"))).drop("cell")
        floored = f"query_id {query_kind}, vector {kind}, floor double"
        path = _stored(met(asking, in_groups).repartition("group").sortWithinPartitions("group", "side", "cell").mapInArrow(floors_of, floored), "floors")
        floors = spark.read.schema(floored).parquet(path)
        in_blocks = parted.join(of_part, ["cell", "part"])
        row_bytes = width if kind == "array<double>" else width // 2
        pairs = floors.mapInArrow(counted, "n long").agg(F.sum("n")).first()[0] or 0
        rounds = max(1, -(-pairs * row_bytes // max(round_bytes, ROUND_TIMES * row_bytes * (size.n + int(each["n"].sum())))))
        found = new_path(spark, "found")
        for r in range(rounds):
            asking = floors.where(F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(rounds)) == r).mapInArrow(wanted, f"group long, {floored}")
            both = met(asking, in_blocks).repartitionById(blocks, F.col("group").cast("int")).sortWithinPartitions("group", "side", "cell")
            _ranked(both.mapInArrow(hits_of, schema), k).write.mode("append").parquet(found)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(f"{schema}, rank int").parquet(found)


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch as a matrix."""
    vectors = batch.column("vector")
    sizes = pc.unique(pc.list_value_length(vectors))
    if len(sizes) > 1:
        raise ValueError(f"vectors of unlike lengths: {sorted(sizes.to_pylist())[:5]}")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1 if len(vectors) else 0)


def _bounds(v: np.ndarray, pivots: np.ndarray, cell: np.ndarray, angle: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """What the product of each vector with any of each cell is at most."""
    apart = np.arccos(np.clip(_unit(v) @ pivots[cell].T, -1, 1))
    cosine = np.cos(np.maximum(0, apart - angle))
    return np.linalg.norm(v, axis=1)[:, None] * np.where(cosine >= 0, cosine * high, cosine * low)


def _pairs(v: np.ndarray, floor: np.ndarray | None, pivots: np.ndarray, stats: tuple[np.ndarray, ...], first: bool, block_of: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Queries, cells and parts that are to meet, by place: a part of the best cell, or all that may hold something as good as
    ``floor``; with ``block_of``, the blocks of all parts in their order, blocks instead of parts, and each once a query.
    A query may meet every part, and there are more of them the more chunks there are: so the fewer queries are taken at
    once, and what is held stays the same."""
    cell, angle, low, high, n = stats
    step = max(1, ASKS // max(len(cell), int(n.sum())))
    for start in range(0, len(v), step):
        bound = _bounds(v[start : start + step], pivots, cell, angle, low, high)
        if first:
            row, at = np.arange(len(bound)), bound.argmax(axis=1)
            part = np.zeros(len(bound), np.int64)
        else:
            row, at = np.nonzero(~(bound < floor[start : start + step, None] - 1e-9 * (1 + np.abs(bound))))
            many = n[at]
            part = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            row, at = np.repeat(row, many), np.repeat(at, many)
            if block_of is not None:
                blocks = int(block_of[-1]) + 1
                once = np.unique(row * blocks + block_of[(np.cumsum(n) - n)[at] + part])
                row, at, part = once // blocks, np.zeros(len(once), np.int64), once % blocks
        for i in range(0, len(row), PASSED):
            yield start + row[i : i + PASSED], at[i : i + PASSED], part[i : i + PASSED]


def _wanted(batch: pd.DataFrame, pivots: np.ndarray, stats: tuple[np.ndarray, ...], first: bool) -> Iterator[pd.DataFrame]:
    """The parts of cells that each query is to meet: one of the best cell, or all that may hold something as good as ``floor``."""
    if not len(batch):
        return
    for row, at, part in _pairs(_matrix(batch["vector"]), None if first else batch["floor"].to_numpy(), pivots, stats, first):
        yield pd.DataFrame({"cell": stats[0][at].astype(np.int32), "part": part, "block": batch["block"].to_numpy()[row], "query_id": batch["query_id"].to_numpy()[row], "vector": batch["vector"].to_numpy()[row]})


class _Block:
    """Chunks that a task holds, in the order of cells and ids; the places of ids tell which of equal products come first.

    Products are worked out as floats first, of vectors no longer than 1, which are wrong by no more than ``wrong``; what may
    be good enough by that is worked out exactly."""

    def __init__(self, batches: list[pa.RecordBatch], pivots: np.ndarray, stats: tuple[np.ndarray, ...]) -> None:
        ids = pa.chunked_array([b.column("id") for b in batches]).combine_chunks()
        by_id = pc.array_sort_indices(ids, null_placement="at_start").to_numpy()
        place = np.empty(len(ids), np.int64)
        place[by_id] = np.arange(len(ids))
        cell = np.concatenate([b.column("cell").to_numpy() for b in batches])
        order = np.lexsort((place, cell))
        self.ids, self.place, self.n = ids.take(pa.array(by_id)), place[order], len(ids)
        self.vectors = np.concatenate([_rows(b) for b in batches])[order]
        self.longest = np.linalg.norm(self.vectors, axis=1).max() or 1.0
        self.floats, self.wrong = (self.vectors / self.longest).astype(np.float32), (8 + self.vectors.shape[1]) * 2.0**-23
        own, starts = np.unique(cell[order], return_index=True)
        at = np.searchsorted(stats[0], own)
        self.pivots, self.stats = pivots, [x[at] for x in stats[:4]]
        self.tiles: list[tuple[int, int, int, int]] = []  # cells from and to, chunks from and to: small cells together
        for c, (start, end) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), self.n])):
            if self.tiles and end - self.tiles[-1][2] <= COLUMNS:
                self.tiles[-1] = (self.tiles[-1][0], c + 1, self.tiles[-1][2], end)
            else:
                self.tiles += [(c, c + 1, a, min(end, a + COLUMNS)) for a in range(start, end, COLUMNS)]

    def search(self, v: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best products of each query, not below its floor, and their chunks' places among the ids (``n``: none).
        What is as good as the k-th so far comes in only by a smaller id."""
        top, place = np.full((len(v), k), -np.inf), np.full((len(v), k), self.n, np.int64)
        bound = _bounds(v, self.pivots, *self.stats)
        bound += 1e-9 * (1 + np.abs(bound))
        length = np.linalg.norm(v, axis=1)
        length[length == 0] = 1.0
        floats, lowest = (v / length[:, None]).astype(np.float32), _less(floor)  # products of other blocks may differ in the last bits
        for first, last, a, b in self.tiles:
            least = np.maximum(lowest, top[:, k - 1])
            rows = np.flatnonzero((~(bound[:, first:last] < least[:, None])).any(axis=1))
            if not len(rows):
                continue
            enough = np.clip(_less(least[rows]) / (length[rows] * self.longest) - self.wrong - 1e-6, -2, 2).astype(np.float32)
            row, column = np.divmod(np.flatnonzero(floats[rows] @ self.floats[a:b].T >= enough[:, None]), b - a)
            if len(row):
                self._merge(top, place, v, rows, row, column, a, b, k)
        return top, place

    def _merge(self, top: np.ndarray, place: np.ndarray, v: np.ndarray, rows: np.ndarray, row: np.ndarray, column: np.ndarray, a: int, b: int, k: int) -> None:
        def better(row: np.ndarray, column: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, ...]:
            value, at, of = np.round(products, 12), self.place[a:b][column], rows[row]  # products of equal vectors may differ in the last bits
            kth, last = top[of, k - 1], place[of, k - 1]
            some = (value > kth) | ((value == kth) & (at < last))
            return of[some], value[some], at[some]

        many = 4 * k * len(rows)
        if len(row) <= many:
            of, value, at = better(row, column, np.einsum("ij,ij->i", v[rows[row]], self.vectors[a + column]))
        else:  # no floor yet, or many equal vectors
            products = v[rows] @ self.vectors[a:b].T
            of, value, at = better(row, column, products[row, column])
            if len(of) > many:
                columns = best(np.round(products, 12), self.place[a:b], k)
                row, column = np.repeat(np.arange(len(rows)), columns.shape[1]), columns.ravel()
                of, value, at = better(row, column, products[row, column])
        if not len(of):
            return
        who, of = np.unique(of, return_inverse=True)
        of = np.concatenate((np.repeat(np.arange(len(who)), k), of))
        value, at = np.concatenate((top[who].ravel(), value)), np.concatenate((place[who].ravel(), at))
        order = np.lexsort((at, -value, of))
        of = of[order]
        first = order[np.arange(len(of)) - np.searchsorted(of, np.arange(len(who)))[of] < k]
        top[who], place[who] = value[first].reshape(-1, k), at[first].reshape(-1, k)


def _less(x: np.ndarray) -> np.ndarray:
    """A little less, by what roundings may come to."""
    return np.where(np.isfinite(x), x - 1e-9 * (1 + np.abs(x)), x)


def _searched(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, stats: tuple[np.ndarray, ...], k: int) -> Iterator[tuple[pa.RecordBatch, pa.Array | None, np.ndarray, np.ndarray]]:
    """Some queries at a time, the ids of their group's chunks in order (None: no chunks), the k best products and the places
    of their ids. Rows come in groups, chunks (side 0) before queries; the chunks of one group are held, queries pass."""
    own, chunks, block = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        group, side = batch.column("group").to_numpy(), batch.column("side").to_numpy()
        cuts = np.flatnonzero((np.diff(group) != 0) | (np.diff(side) != 0)) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(group)]):
            if group[start] != own:
                own, chunks, block = group[start], [], None
            part = batch.slice(start, end - start)
            if side[start] == 0:
                chunks.append(part)
                continue
            if chunks:
                block, chunks = _Block(chunks, pivots, stats), []
            step = max(1, min(ROWS, TILE // k))
            for i in range(0, part.num_rows, step):
                some = part.slice(i, step)
                floor = some.column("floor").fill_null(-np.inf).to_numpy(zero_copy_only=False)
                if block:
                    yield some, block.ids, *block.search(_rows(some), floor, k)
                else:
                    yield some, None, np.full((some.num_rows, k), -np.inf), np.zeros((some.num_rows, k), np.int64)


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def _stored(df: DataFrame, what: str) -> str:
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return path


def refined(hits: DataFrame, threshold: float = CHUNK_SIMILARITY, keep: int = KEEP) -> DataFrame:
    """Hits (query_id, content, similarity, rank) without repeated contents (the best stays), below the threshold, and
    beyond ``keep``; in this order, all in one shuffle by query. Hits are at most k rows per query."""
    first = F.min("rank").over(Window.partitionBy("query_id", F.xxhash64(F.trim("content")), F.trim("content")))
    best = hits.withColumn("_first", first).where("_first = rank").drop("_first").where(F.col("similarity") >= threshold)
    return best.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("_n") <= keep).drop("_n")


def confidences(queries: DataFrame, kept: DataFrame, minimum: float = ANSWER_SIMILARITY) -> DataFrame:
    """(query_id, confidence, max_similarity, answerable) of every query; without hits 0, 0 and false."""
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity")))
    best = kept.withColumn("_n", nth).groupBy("query_id").agg(F.avg(F.when(F.col("_n") <= 3, F.col("similarity"))).alias("c"), F.max("similarity").alias("m"))
    both = queries.select("query_id").distinct().join(best, "query_id", "left")
    confidence = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("c", F.lit(0.0)))), 4)
    return both.select("query_id", confidence.alias("confidence"), F.coalesce("m", F.lit(0.0)).alias("max_similarity"), F.coalesce(F.col("m") >= minimum, F.lit(False)).alias("answerable"))


def word_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def reranked(hits: DataFrame) -> DataFrame:
    """Hits (query_id, query, extra array of metric and periods, content, similarity, rank) with ``score`` and ``new_rank``:
    0.55 similarity, 0.25 share of the question's tokens, 0.20 share of the extra ones; ties stay in the old order."""
    own, asked = word_tokens(F.col("content")), word_tokens(F.col("query"))
    extra = F.array_distinct(F.filter(F.coalesce("extra", F.array().cast("array<string>")), lambda x: x != ""))
    share = lambda part: F.coalesce(F.try_divide(F.size(F.array_intersect(part, own)), F.size(part)), F.lit(0.0))
    score = 0.55 * F.coalesce("similarity", F.lit(0.0)) + 0.25 * share(asked) + 0.20 * share(extra)
    scored = hits.withColumn("score", score)
    return scored.withColumn("new_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")))


#: The format of a context block, and metadata that it shows elsewhere.
RULE = "=" * 30
SHOWN = ("document_name", "document_id", "source_type", "row_number", "similarity", "content")


def contexts(hits: DataFrame, by: str = "rank") -> DataFrame:
    """(query_id, context, sources): blocks of the hits in order, numbered from 1 (source, row, similarity, other metadata
    by key, content), and their sources, each once. Hits: content, similarity, metadata map of strings."""
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(by))
    other = F.filter(F.array_sort(F.map_entries("metadata")), lambda e: ~e["key"].isin(*SHOWN) & e["value"].isNotNull())
    extras = F.array_join(F.transform(other, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    value = lambda key, default: F.coalesce(F.try_element_at("metadata", F.lit(key)), F.lit(default))
    block = F.concat(
        F.lit(f"\n{RULE}\nDOCUMENT "), F.col("_i").cast("string"), F.lit(f"\n{RULE}\nSource: "), value("document_name", "unknown"), F.lit(" | Row: "), value("row_number", ""),
        F.lit("\nSimilarity: "), F.format_string("%.4f", F.col("similarity")), F.lit("\n"), F.when(extras != "", F.concat(F.lit("\n"), extras, F.lit("\n"))).otherwise("\n"), F.lit("\nContent:\n"), F.trim("content"), F.lit("\n"),
    )
    ordered = lambda x: F.transform(F.array_sort(F.collect_list(F.struct(F.col("_i").alias("n"), x.alias("x")))), lambda b: b["x"])
    return hits.withColumn("_i", nth).groupBy("query_id").agg(F.array_join(ordered(block), "\n").alias("context"), F.array_distinct(ordered(value("document_name", "unknown"))).alias("sources"))
