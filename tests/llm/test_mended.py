"""Failed and retried feeds of exact dedup, very small samples, and texts made to collide under polynomial hashes."""

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from test_operators import brute_groups

from sparkqa.llm import exact_dedup, fingerprint, shards, simhash, suffix_dedup, textwork, toxicity

FEEDS = [[(1, "a"), (2, "b"), (9, "e"), (10, "f"), (11, None)], [(3, "A"), (4, "c"), (5, "E"), (6, "")], [(7, "a"), (8, "C"), (12, "g")]]


def groups(out):
    return sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in out.collect())


def feed_of(spark, n):
    return spark.createDataFrame(FEEDS[n], "doc_id long, text string").repartition(2)


class Lost(Exception):
    pass


@pytest.mark.parametrize("at", ["texts written", "feed written", "state begun", "state taken", "result lost"])
def test_retried_feed(spark, tmp_path, monkeypatch, at):
    """The second feed fails at some point and is made again; it and the third give what they give without a failure."""
    base = str(tmp_path / "dedup")
    assert groups(exact_dedup.dedup(feed_of(spark, 0), checkpoint=base)) == brute_groups(FEEDS[:1])

    def lost(*args, **kwargs):
        raise Lost

    run_state = exact_dedup.run_state

    def taken(*args):
        run_state(*args)
        raise Lost

    patches = {"texts written": ("located", lost), "feed written": ("mark", lost), "state begun": ("run_state", lost), "state taken": ("run_state", taken)}
    with monkeypatch.context() as patched:
        if at in patches:
            patched.setattr(exact_dedup, *patches[at])
            with pytest.raises(Lost):
                exact_dedup.dedup(feed_of(spark, 1), checkpoint=base)
        else:
            exact_dedup.dedup(feed_of(spark, 1), checkpoint=base)
    again = exact_dedup.dedup(feed_of(spark, 1), checkpoint=base, feed=1 if at == "result lost" else None)
    assert groups(again) == brute_groups(FEEDS[:2])
    assert groups(exact_dedup.dedup(feed_of(spark, 2), checkpoint=base, feed=2)) == brute_groups(FEEDS)
    with pytest.raises(ValueError, match="out of turn"):
        exact_dedup.dedup(feed_of(spark, 2), checkpoint=base, feed=5)


def test_small_shares_draw_their_part(spark):
    rows = spark.range(1 << 23)
    n = rows.where(toxicity.drawn(2.0**-20, "id")).count()
    assert 1 <= n <= 30  # 8 are expected
    assert rows.limit(1000).where(toxicity.drawn(1.0, "id")).count() == 1000
    bound = rows.where(toxicity.drawn(1e-12, "id"))._jdf.queryExecution().optimizedPlan().toString()
    assert str(int(1e-12 * (1 << 62))) in bound  # not zero


def test_half_written_map(spark, tmp_path):
    """A version that a failed write has left as a folder without files is written again; a whole one is not."""
    path = str(tmp_path / "map")
    docs = spark.range(50).selectExpr("id AS doc_id", "repeat('x', cast(id as int)) AS text")
    for version in (1, 3):
        (tmp_path / "map" / f"version={version}" / "_temporary").mkdir(parents=True)
        assert {r.map_version for r in shards.shard(docs, map_path=path).select("map_version").collect()} == {version + 1 if version == 1 else 3}
    with pytest.raises(AnalysisException, match="already exists"):
        shards.store_map(spark, {0: 0}, {}, 3, path)


def test_held_out_toxicity(spark):
    """At sf0.1: 120 toxic and 870 clean labelled texts that nothing was learnt from."""
    sf = "/root/testdata/sf0.1"
    out = toxicity.op2_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id")
    share = {r.toxic: (r.n, r.share) for r in out.groupBy("toxic").agg(F.count("*").alias("n"), F.avg("predicted").alias("share")).collect()}
    assert share[1][0] > 100 and share[1][1] > 0.9 and share[0][1] < 0.01


def thue_morse(n):
    return bytes(ord("a") + bin(i).count("1") % 2 for i in range(n))


def test_structured_words_do_not_collide(spark):
    """Thue-Morse words and their complements agree under every polynomial hash modulo a power of two."""
    one = thue_morse(2048)
    other = one.translate(bytes.maketrans(b"ab", b"ba"))
    assert len(set(textwork.word_hashes(one + b" " + other).tolist())) == 2
    texts = [one.decode(), other.decode()]
    assert fingerprint.sketch(texts[0]).tolist() != fingerprint.sketch(texts[1]).tolist()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert simhash.one_of_each(docs).count() == 2
    out = suffix_dedup.remove_repeats(spark.createDataFrame([(0, "x" * 30 + texts[0][:160] + "y" * 30), (1, "z" * 30 + texts[1][:160] + "w" * 30)], "doc_id long, text string"), length=100)
    want = brute_removed(["x" * 30 + texts[0][:160] + "y" * 30, "z" * 30 + texts[1][:160] + "w" * 30])
    assert [r.n_removed for r in out.orderBy("doc_id").collect()] == want


def brute_removed(texts, length=100):
    seen, out = set(), []
    for text in texts:
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - length + 1):
            if (s := text[i : i + length]) in seen:
                gone[i : i + length] = True
            seen.add(s)
        out.append(int(gone.sum()))
    return out


def test_splitters_follow_the_order_of_the_sort():
    """Rows in order must be dealt into ranges in order, equal tokens included."""
    rng = np.random.default_rng(3)
    rows = np.column_stack([rng.integers(-2, 2, 3000), rng.integers(-2, 2, 3000), rng.integers(-(1 << 62), 1 << 62, 3000), rng.integers(-300, 300, (3000, 3))])
    rows = rows[np.lexsort(rows.T[::-1])]
    split = suffix_dedup.splitter(rows[np.sort(rng.choice(3000, 40, replace=False))])
    part = split([np.ascontiguousarray(rows[:, i]) for i in range(6)])
    assert (np.diff(part) >= 0).all() and part.max() == 40


def test_words_are_hashed_alike():
    words = textwork.word_hashes("Ab \t aB\nÄ ä x".encode())
    assert words[0] == words[1] and len(set(words.tolist())) == 4 and words.dtype == np.uint64
    assert len(textwork.word_hashes(b" \n")) == 0
