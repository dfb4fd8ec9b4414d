"""The pipeline's stages, each held against its own input."""

import sys
from pathlib import Path

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from sparkqa.llm import mixing

SF = "/root/testdata/sf0.01"


def shingles(text, n=5):
    w = text.encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        from sparkqa.llm.shared import stored

        docs = stored(out, "stage")
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [i for i, y in labels.items() if y == 0]
    assert np.mean([i in kept["toxicity"] for i in clean]) > 0.98
    assert np.mean([i not in kept["toxicity"] for i, y in labels.items() if y == 1]) > 0.6

    latest = {}
    for i in kept["toxicity"]:
        key = texts[i].translate({c: c + 32 for c in range(65, 91)})
        latest[key] = max(latest.get(key, -1), i)
    assert kept["exact dedup"] == set(latest.values())

    sets = {i: shingles(texts[i]) for i in kept["exact dedup"]}
    inverse = {}
    for i, s in sets.items():
        for x in s:
            inverse.setdefault(x, []).append(i)
    pairs = {(a, b) for group in inverse.values() for a in group for b in group if a < b}
    near = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    both = [p for p in near if p[0] in kept["near dedup"] and p[1] in kept["near dedup"]]
    assert near and not both
    linked = {x for a, b in pairs if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b]) for x in (a, b)}
    assert kept["exact dedup"] - kept["near dedup"] <= linked
    assert len(kept["mixing"]) > 0.8 * len(kept["near dedup"])

    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept["mixing"]
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048


def test_run_gives_what_the_stages_give(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.count() > 0 and "sequence_id" in rows.columns
    assert mixing.SEED == 7


def test_awkward_and_empty_tables(spark, tmp_path):
    """The whole pipeline on nulls, repeats, an empty and a very long text with clashing columns, and on no rows at all."""
    sys.path.insert(0, str(Path(__file__).parent))
    from test_operators import AWKWARD

    rows = [(*r, "en", "s0", 1, 2, 3, "x", True, 0.5, 4) for r in AWKWARD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, ord long, _file long, _row long, _topic string, kept boolean, score double, predicted int")
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for name, table, ids in (("awkward", docs, {1, 2, 3, 4, 5, None, 7, 8, 9}), ("empty", docs.limit(0), set())):
        sf = str(tmp_path / name)
        table.write.parquet(f"{sf}/documents.parquet")
        labels.write.parquet(f"{sf}/labels.parquet")
        out = corpus_pipeline.run(spark, sf).collect()
        assert {r.doc_id for r in out} <= ids and bool(out) == bool(ids)
