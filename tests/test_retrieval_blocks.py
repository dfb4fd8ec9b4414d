"""Blocked exact search: against all products, with equal vectors, zeros, ties, small blocks and many queries."""

import numpy as np
import pytest
from oracle import same

from sparkqa.operators import retrieval
from sparkqa.queries import texts


def frame(spark, ids, vectors, name="id"):
    return spark.createDataFrame([(int(i), None if v is None else [float(x) for x in v]) for i, v in zip(ids, vectors)], f"{name} long, vector array<double>")


def brute(chunks, queries, k):
    out = set()
    c = np.array([v for _, v in chunks])
    ids = np.array([i for i, _ in chunks])
    for q, v in queries:
        s = np.round(c @ v, 12)
        for rank, at in enumerate(np.lexsort((ids, -s))[:k], 1):
            out.add((q, int(ids[at]), rank))
    return out


def data(kind):
    rng = np.random.default_rng(6)
    if kind == "clusters":
        centre = rng.normal(size=(12, 8))
        v = centre[rng.integers(0, 12, 600)] + 0.1 * rng.normal(size=(600, 8))
    elif kind == "equal":  # a third of all vectors are one
        v = rng.normal(size=(600, 8))
        v[rng.permutation(600)[:200]] = v[0]
    else:  # any lengths, zeros, opposite directions
        v = rng.normal(size=(600, 8)) * rng.choice([0.0, 0.01, 1.0, 50.0], (600, 1))
        v[::2] = -abs(v[::2])
    if kind != "lengths":
        v /= np.linalg.norm(v, axis=1, keepdims=True)
    q = np.concatenate([v[:40], rng.normal(size=(30, 8)), -v[:5], np.zeros((1, 8))])
    ids = rng.permutation(600) * 7
    return list(zip(ids.tolist(), v)), list(enumerate(q))


@pytest.mark.parametrize("kind", ["clusters", "equal", "lengths"])
def test_blocks_against_all_products(spark, kind):
    chunks, queries = data(kind)
    a, b = frame(spark, *zip(*chunks)), frame(spark, *zip(*queries), name="query_id")
    b = b.unionByName(frame(spark, [999], [None], "query_id"))
    for k, bytes_ in ((1, 2000), (8, 2000), (8, 1 << 20), (700, 4000)):
        got = {(r.query_id, r.id, r.rank) for r in retrieval.nearest_blocks(a, b, k, cells=16, block_bytes=bytes_).collect()}
        assert got == brute(chunks, queries, k), (k, bytes_)
    assert {(r.query_id, r.id, r.rank) for r in retrieval.nearest(a, b, 8).collect()} == brute(chunks, queries, 8)
    assert {(r.query_id, r.id, r.rank) for r in retrieval.nearest(a, b, 8, max_query_bytes=100).collect()} == brute(chunks, queries, 8)


def test_ties_are_cut_by_id():
    scores = np.array([[1.0, 2.0, 2.0, 2.0, 0.0], [5.0, 1.0, 1.0, 1.0, 1.0]])
    ids = np.array([9, 8, 3, 5, 1])
    assert [sorted(ids[c].tolist()) for c in retrieval.best(scores, ids, 2)] == [[3, 5], [1, 9]]
    assert retrieval.best(scores, ids, 7).shape == (2, 5)


def test_empty_sides(spark):
    chunks, queries = data("clusters")
    a, b = frame(spark, *zip(*chunks)), frame(spark, *zip(*queries), name="query_id")
    assert retrieval.nearest_blocks(a.limit(0), b).count() == 0 and retrieval.nearest_blocks(a, b.limit(0)).count() == 0


def test_many_queries(spark):
    """100,000 queries over blocks of bounded size; a sample of them is held against all products."""
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(40, 16))
    v = centre[rng.integers(0, 40, 2000)] + 0.05 * rng.normal(size=(2000, 16))
    v[:700] = v[0]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    chunks = list(enumerate(v))
    queries = spark.range(100_000).selectExpr("id AS query_id", "transform(sequence(1, 16), i -> rand(7) - 0.5 + 0 * i) AS noise")
    picks = frame(spark, range(2000), v, "pick")
    queries = queries.join(picks, queries.query_id % 2000 == picks.pick).selectExpr("query_id", "transform(vector, (x, i) -> x + 0.01 * (query_id % 7) * (i % 3)) AS vector")
    found = retrieval.nearest_blocks(frame(spark, *zip(*chunks)), queries, k=5, block_bytes=1 << 19)
    path = retrieval._stored(found, "found")
    found = spark.read.parquet(path)
    assert found.count() == 500_000
    some = [(r.query_id, np.array(r.vector)) for r in queries.where("query_id % 997 = 0").collect()]
    assert {(r.query_id, r.id, r.rank) for r in found.where("query_id % 997 = 0").collect()} == brute(chunks, some, 5)


@pytest.mark.parametrize("name", ["h8_nearest_blocks", "h8_nearest"])
def test_queries_against_sql(spark, name):
    same(texts.QUERIES[name](spark, "/root/testdata/sf0.001"), texts.SQL[name], "/root/testdata/sf0.001")


def test_queries_that_meet_every_block_are_held_a_few_at_a_time():
    """Every query meets all parts of all cells, 2,000,000 pairs: each comes once, and few are held."""
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(3)
    parts = np.array([300, 1, 699], dtype=np.int64)
    stats = (np.array([0, 1, 2]), np.full(3, np.pi), np.zeros(3), np.ones(3), parts)
    batch = pd.DataFrame({"query_id": np.arange(2000), "block": 0, "floor": -np.inf, "vector": list(rng.normal(size=(2000, 4)))})
    seen = np.zeros((2000, 3, 699), dtype=np.int8)
    tracemalloc.start()
    for told in retrieval._wanted(batch, np.eye(4)[:3], stats, False):
        np.add.at(seen, (told["query_id"].to_numpy(), told["cell"].to_numpy(), told["part"].to_numpy()), 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all((seen[:, c, :n] == 1).all() and not seen[:, c, n:].any() for c, n in enumerate(parts)) and peak < 32 << 20


@pytest.mark.parametrize("kind", ["clusters", "equal", "lengths"])
def test_few_hits_of_few_blocks(spark, monkeypatch, kind):
    """What is shuffled of a query goes with the blocks, at least two for each core, and not with the cells."""
    chunks, _ = data(kind)
    counts, ranked = [], retrieval._ranked
    monkeypatch.setattr(retrieval, "_ranked", lambda found, k: (counts.append(found.count()), ranked(found, k))[1])
    a = frame(spark, *zip(*chunks))
    got = {(r.query_id, r.id, r.rank) for r in retrieval.nearest_blocks(a, a.withColumnRenamed("id", "query_id"), 4, cells=200).collect()}
    assert got == brute(chunks, chunks, 4)
    assert sum(counts) <= 600 * 4 * (2 * spark.sparkContext.defaultParallelism + 2)


def test_random_vectors_meet_each_block_once(spark, monkeypatch):
    """Random directions, of which no cell can be left out: the same bound, and the same in rounds that shuffle less."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(1500, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    chunks = list(enumerate(v))
    a = frame(spark, *zip(*chunks))
    counts, ranked = [], retrieval._ranked
    monkeypatch.setattr(retrieval, "_ranked", lambda found, k: (counts.append(found.count()), ranked(found, k))[1])
    before = spark.conf.get(retrieval.CLEANUP)
    want, bound = brute(chunks, chunks, 4), 1500 * 4 * (2 * spark.sparkContext.defaultParallelism + 2)
    for round_bytes, fewest in ((1 << 27, 1), (1, 3)):
        counts.clear()
        got = {(r.query_id, r.id, r.rank) for r in retrieval.nearest_blocks(a, a.withColumnRenamed("id", "query_id"), 4, cells=64, round_bytes=round_bytes).collect()}
        assert got == want and sum(counts) <= bound and len(counts) >= fewest and max(counts) <= bound / fewest * 1.3
    assert spark.conf.get(retrieval.CLEANUP) == before


def test_ids_of_other_kinds(spark):
    chunks, _ = data("equal")
    ids = [f"é{i % 7}-{i}" for i, _ in chunks]
    a = spark.createDataFrame([(i, [float(x) for x in v]) for i, (_, v) in zip(ids, chunks)], "id string, vector array<float>")
    big = spark.createDataFrame([(2**53 + 2 * n + 1, [float(x) for x in v]) for n, (_, v) in enumerate(chunks[:50])], "query_id long, vector array<float>")
    w = np.array([v for _, v in chunks]).astype(np.float32).astype(float)
    want = set()
    for n in range(50):
        best = sorted(zip(-np.round(w @ w[n], 12), ids))[:6]
        want |= {(2**53 + 2 * n + 1, i, rank) for rank, (_, i) in enumerate(best, 1)}
    assert {(r.query_id, r.id, r.rank) for r in retrieval.nearest_blocks(a, big, 6, cells=16).collect()} == want


@pytest.mark.parametrize("scale", [1.0, 1e60, 1e-60])
def test_block_tells_apart_what_floats_do_not(scale):
    """Products that differ by less than a float holds, equal ones, a floor, zeros, and no floor."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    v = np.repeat(rng.normal(size=(40, 16)), 50, axis=0)
    v[:, 0] += rng.integers(0, 25, len(v)) * 1e-9  # each twice or so
    v = np.concatenate([v, np.zeros((30, 16))]) * scale
    ids = rng.permutation(len(v))
    cell = np.repeat(np.arange(7), -(-len(v) // 7))[: len(v)].astype(np.int32)
    stats = (np.arange(7), np.full(7, np.pi), np.zeros(7), np.full(7, np.linalg.norm(v, axis=1).max()), np.ones(7, np.int64))
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, 16, dtype=np.int32)), pa.array(v.ravel()))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(cell), vectors], ["id", "cell", "vector"])
    block = retrieval._Block([batch.slice(0, 900), batch.slice(900)], np.eye(16)[:7], stats)
    q = np.concatenate([rng.normal(size=(60, 16)), np.zeros((2, 16))]) / scale
    s = np.round(q @ v.T, 12)
    want = np.stack([np.lexsort((ids, -row))[:9] for row in s])
    floor = np.take_along_axis(s, want, axis=1)[:, 8]
    for least in (np.full(len(q), -np.inf), floor, floor - 0.5):
        top, place = block.search(q, least, 9)
        assert (block.ids.to_numpy()[place] == ids[want]).all() and np.allclose(top, np.take_along_axis(s, want, axis=1), rtol=0, atol=2e-12)
