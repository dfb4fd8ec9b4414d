"""The shares that a mix reaches, beside its targets."""

import warnings

import corpus_pipeline
import numpy as np
import pytest

from sparkqa.llm import mixing

SF = "/root/testdata/sf0.01"


def test_reached_shares(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    for targets in (mixing.TARGETS, corpus_pipeline.MIX_TARGETS):
        told = mixing.reached(docs, targets)
        rows = mixing.with_cells(mixing.sampled_rows(docs, targets), targets).toPandas()
        for d, value, target, before, after in told:
            drawn = rows["tokens"][rows[d] == value].sum() / rows["tokens"].sum()
            assert abs(drawn - after) < 0.15
            low, high = target if isinstance(target, tuple) else (target, target)
            if before:  # targets of values that do not occur are dealt to the others
                assert low - 0.03 < after < high + 0.03
        assert mixing.mix(docs, targets).first().residual < 1e-6


def test_pipeline_mix_samples_a_hot_source_down(spark):
    """A source with over half of the tokens comes down to its bound; the others and all within bounds stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hot = docs.withColumn("source", mixing.F.when(docs.doc_id % 2 == 0, "src0").otherwise("src1"))
    shares = {(d, v): after for d, v, _, _, after in mixing.reached(hot, corpus_pipeline.MIX_TARGETS)}
    assert shares["source", "src0"] == pytest.approx(0.3, abs=1e-6)
    kept = mixing.sampled_rows(hot, corpus_pipeline.MIX_TARGETS)
    tokens = lambda d: mixing.with_cells(d).groupBy("source").agg(mixing.F.sum("tokens").alias("n")).toPandas().set_index("source").n
    drawn = tokens(kept)
    assert drawn["src0"] / drawn.sum() == pytest.approx(0.3, abs=0.05)


def test_goal_shares():
    shares = np.array([0.5, 0.3, 0.2, 0.0])
    assert mixing.goal_shares(shares, np.zeros(4), np.ones(4)) == pytest.approx(shares)
    got = mixing.goal_shares(shares, np.array([0, 0, 0, 0.1]), np.array([0.25, 1, 1, 0.1]))
    assert got == pytest.approx([0.25, 0.45, 0.3, 0]) and got.sum() == pytest.approx(1)
    assert mixing.goal_shares(shares, np.array([0.5, 0.4, 0.05, 0.05]), np.array([0.5, 0.4, 0.05, 0.05])) == pytest.approx(np.array([0.5, 0.4, 0.05, 0]) / 0.95)


def test_residual_of_targets_that_cannot_be_met(spark):
    """Source a is all English: it cannot have half of the tokens while English has a tenth."""
    rows = [(1, "a b c d", "s", "en"), (2, "a b c d", "t", "en"), (3, "a b c d", "t", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    targets = {"source": {"s": 0.5, "t": 0.5}, "lang": {"en": 0.1, "de": 0.9}, "topic": {"prose": 1.0}}
    with pytest.warns(UserWarning, match="missed"):
        assert mixing.mix(docs, targets).first().residual > 0.01
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert mixing.mix(docs, targets | {"lang": {"en": 0.6, "de": 0.4}}).first().residual < 1e-8
