"""The first ten operators: against SQL, plain Python and brute force, and on nulls, empty and long texts, ties, repeated rows,
empty tables and clashing columns."""

import hashlib
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import same  # noqa: E402

from sparkqa.llm import bloom, chat_format, exact_dedup, fingerprint, golay, mixing, packing, registry, shards, simhash, suffix_dedup, toxicity, url_filter  # noqa: E402
from sparkqa.llm.shared import components, with_order  # noqa: E402

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor " * 20_000
EXTRA = (
    ", kept boolean, score double, sequence_id long, rank int, vslot int, bucket int, key string, host string, component_id long, ord long, node long, component long, _file long, _row long, "
    "_source string, _lang string, _topic string, topic string, _probability double, _best string, predicted int, held_out boolean, keys int, best int, tie int, at int, part int, before int, feed int, first int"
)
AWKWARD = [(1, None), (2, ""), (3, "  \n "), (4, "A b c"), (5, "a B c"), (5, "a B c"), (None, "null id"), (7, "é ß 日本 \t x"), (8, LONG), (9, "one two three four five six " * 40)]


@pytest.fixture(scope="module")
def awkward(spark):
    """Rows with every hard case, and columns whose names the operators use themselves."""
    rows = [(*r, "en", "s0", 0, None, 1.0, 1, 1, 1, 1, "k", "h", 1, 5, 6, 7, 8, 9, "a", "b", "c", "d", 0.5, "e", 1, True, *range(8)) for r in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long" + EXTRA)


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    same(registry.queries()[name](spark, SF), registry.oracle_sql()[name], SF)


def test_all_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))


# 1 mixing

def test_raking_meets_targets(docs):
    out = mixing.mix(docs).toPandas()
    share = out.assign(w=out.tokens * out.weight).groupby("lang").w.sum()
    assert share["en"] / share.sum() == pytest.approx(0.5 / (0.5 + 0.18 + 0.18 + 0.12), abs=1e-3)
    assert out.probability.max() == pytest.approx(1.0)


def test_mixing_keeps_what_is_asked(docs):
    out = mixing.mix(docs, keep=0.9).toPandas()
    assert (out.tokens * out.probability).sum() / out.tokens.sum() == pytest.approx(0.9, abs=1e-6)
    kept = mixing.sampled_rows(docs, keep=0.9)
    assert kept.columns == docs.columns and kept.count() == out.sampled.sum()


def test_mixing_awkward(awkward):
    assert mixing.mix(awkward).count() == len(AWKWARD) and mixing.mix(awkward.limit(0)).count() == 0
    assert rows_of(mixing.sampled_rows(awkward, keep=1.0)) == rows_of(awkward)


# 2 toxicity

def test_toxicity_learns(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("bcdfgaeiou"), 6))
    rows, labels = [], []
    for i in range(400):
        words = [word() for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            for k in rng.choice(60, 3, False):
                words[k] = ("zzgrm", "zzgrmab", "qxlotu")[k % 3]
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.toxicity(d, y).join(y, "doc_id").toPandas()
    held = out[out.held_out]
    assert (held.predicted == held.toxic).mean() > 0.97
    assert all(out.held_out == (out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4) == 2))
    hidden = y.withColumn("toxic", F.when(toxicity.fold_of(F.col("doc_id")) == toxicity.HELD_OUT, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.toxicity(d, hidden).toPandas().set_index("doc_id").score
    assert (again - out.set_index("doc_id").score).abs().max() < 1e-12  # held-out labels change nothing


def test_toxicity_awkward(spark, awkward):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.toxicity(awkward, none).collect()
    assert len(out) == len(AWKWARD) and all(0 <= r.score <= 1 for r in out)
    kept = toxicity.accepted(awkward, none)
    assert kept.columns == awkward.columns and rows_of(kept) == rows_of(awkward)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (3, 0), (3, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity(awkward.limit(0), labels).count() == 0


def simulated(rng, n=40_000):
    """Votes of six voters of known rates by class, the second a noisy copy of the first; (patterns, counts, mean class 1)."""
    y = rng.random(n) < 0.15
    rate = np.array([[0.05, 0.0, 0.1, 0.02, 0.08, 0.04], [0.8, 0.0, 0.7, 0.6, 0.75, 0.5]])
    votes = rng.random((n, 6)) < rate[y.astype(int)]
    votes[:, 1] = np.where(rng.random(n) < 0.97, votes[:, 0], ~votes[:, 0])
    at = votes @ (1 << np.arange(6))
    counts = np.bincount(at, minlength=64)
    bits = (np.arange(64)[:, None] >> np.arange(6) & 1).astype(float)
    like = lambda c: np.prod([np.where(bits[:, 1] == bits[:, 0], 0.97, 0.03), *[np.where(bits[:, j] > 0, rate[c, j], 1 - rate[c, j]) for j in (0, 2, 3, 4, 5)]], axis=0)
    exact = 0.15 * like(1) / (0.15 * like(1) + 0.85 * like(0))
    return bits, counts, exact, np.bincount(at, weights=y, minlength=64)


def test_label_model_against_brute_force():
    """Rates, the correlated pair and posteriors by Bayes' rule come out of agreements alone."""
    bits, counts, exact, positive = simulated(np.random.default_rng(6))
    seen = counts > 0
    guess = 1 / (1 + np.exp(2.5 - bits.sum(1)))
    model = toxicity.LabelModel(6).fit(bits[seen], counts[seen], guess[seen])
    model.oriented(bits[seen], np.ones(seen.sum()), positive[seen] + 1e-9)
    assert model.prior == pytest.approx(0.15, abs=0.02)
    assert model.parent[1] == 0 and (model.parent[2:] == -1).all() and model.correlations[0, 1] > 0.8
    assert model.rates[1, 2:, 0] == pytest.approx([0.7, 0.6, 0.75, 0.5], abs=0.05)
    assert model.rates[0, 2:, 0] == pytest.approx([0.1, 0.02, 0.08, 0.04], abs=0.02)
    p = model.posterior(bits)
    assert np.average(np.abs(p - exact), weights=counts) < 0.01
    # the copy adds next to nothing: with the first voter and without any other, it does not raise the posterior
    alone, twice = p[1], p[3]
    assert twice - alone < 0.35 and exact[3] - exact[1] < 0.35


def test_label_model_is_oriented():
    bits, counts, _, positive = simulated(np.random.default_rng(7), 5_000)
    wrong = toxicity.LabelModel(6).fit(bits, counts + 1e-9, 1 / (1 + np.exp(bits.sum(1) - 2.5)))
    toxic = np.repeat([1.0, 0.0], 64)
    wrong.oriented(np.concatenate([bits, bits]), toxic, np.concatenate([positive, counts - positive]) + 1e-9)
    assert wrong.prior < 0.5 and wrong.posterior(bits).argmax() > 32


def test_toxicity_quality(spark):
    """Held-out accuracy, and the same result whatever the held-out labels are and however rows are dealt."""
    sf = "/root/testdata/sf0.01"
    out = toxicity.op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert out.predicted[out.toxic == 1].mean() > 0.6 and out.predicted[out.toxic == 0].mean() < 0.02


# 3 SimHash

def test_golay_keys_meet():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 3000)
    near = golay.keys(words)
    for i in range(23):
        other = golay.keys(words ^ (1 << i))
        assert all(set(a[a >= 0]) & set(b[b >= 0]) for a, b in zip(near, other, strict=True))


def union_find(ids, links):
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_fingerprint(text, n=3):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_brute_force(docs):
    got = {r.doc_id: r for r in simhash.linked_fingerprints(docs, key_rows=3).collect()}
    rows = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == rows
    ids = sorted(rows)
    want = union_find(ids, [(a, b) for a in ids for b in ids if a < b and (rows[a] ^ rows[b]).bit_count() <= 3])
    assert {i: r.component_id for i, r in got.items()} == want


def test_links_lose_nothing(spark):
    """Dense groups around a few centres, with keys larger than a task may hold."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-(1 << 63), 1 << 63, 3)
    fs = sorted({int(np.bitwise_xor.reduce([c, *(np.int64(1) << np.int64(b) for b in rng.choice(63, k, False))])) for c in centres for k in range(6) for _ in range(25)})

    def keyed(batches):
        import pandas as pd

        for b in batches:
            f = b["f"].to_numpy()
            row, key = simhash.keys(f)
            yield pd.DataFrame({"key": key, "id": f[row], "f": f[row]})

    table = spark.createDataFrame([(f,) for f in fs], "f long")
    edges = simhash.links(table.mapInPandas(keyed, "key long, id long, f long"), ["f"], 3, key_rows=20)
    got = {r.node: r.component for r in components(edges).collect()}
    mask = (1 << 64) - 1
    want = union_find(fs, [(a, b) for a in fs for b in fs if a < b and ((a ^ b) & mask).bit_count() <= 3])
    assert {f: got.get(f, f) for f in fs} == want


def test_simhash_awkward(awkward):
    out = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.linked_fingerprints(awkward).collect()}
    assert out[1, "0" * 16] == out[2, "0" * 16] == out[3, "0" * 16] == 1
    assert simhash.linked_fingerprints(awkward).count() == len(AWKWARD)
    assert simhash.linked_fingerprints(awkward.limit(0)).count() == 0


def test_near_groups(spark, awkward):
    rng = np.random.default_rng(5)
    base = [f"w{rng.integers(10**6)}" for _ in range(300)]
    near, far = base.copy(), base.copy()
    near[40], near[200] = "changed", "words"
    for i in range(0, 300, 12):
        far[i] = "different"
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate((base, near, far, base[::-1]))], "doc_id long, text string")
    got = {r.doc_id: r.group_id for r in simhash.similar_groups(d).collect()}
    assert got[0] == got[1] and len({got[0], got[2], got[3]}) == 3
    assert sorted(r.doc_id for r in simhash.one_of_each(d).collect()) == [0, 2, 3]
    kept = simhash.one_of_each(awkward)
    assert kept.columns == awkward.columns and kept.count() >= 7 and set(rows_of(kept)) <= set(rows_of(awkward))
    assert rows_of(simhash.similar_groups(awkward).drop("group_id")) == rows_of(awkward)
    assert simhash.one_of_each(awkward.limit(0)).count() == 0


# 4 url filters

def test_urls(spark):
    rules = spark.createDataFrame(url_filter.RULES, "key string, verdict string")
    rows = [(1, None), (2, "no scheme"), (3, "http://EXAMPLE.com/en/x?q#f"), (4, "https://www.example.com/en/"), (5, "http://a.net/es/x"), (6, "http://a.net/de/"), (7, "http://x.com"), (8, "://com/"), (9, "http://notexample.com/en/"), (10, "http://" + "a." * 20000 + "com/x"), (11, "")]
    df = spark.createDataFrame([(*r, "old", "old") for r in rows], "page_id long, url string, host string, rule string")
    want = {1: (None, "allow"), 2: (None, "allow"), 3: ("example.com/en/", "block"), 4: ("www.example.com/en/", "allow"), 5: ("net/es/", "block"), 6: (None, "allow"), 7: (None, "allow"), 8: ("com/", "allow"), 9: ("com/", "allow"), 10: ("com/", "allow"), 11: (None, "allow")}
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(df, rules).collect()}
    assert got == want
    parts = url_filter.filter_urls(df, rules, max_filter_bits=16)
    assert {r.page_id: (r.rule, r.verdict) for r in parts.collect()} == want
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(df, rules.limit(0)).collect()} == {"allow"}


def test_long_list_of_many_shapes(spark):
    """Thousands of rules of hundreds of shapes against brute force; the plan does not grow with them."""
    rng = np.random.default_rng(8)
    label = lambda: "".join(rng.choice(list("abc"), rng.integers(1, 3)))
    host = lambda: ".".join(label() for _ in range(rng.integers(1, 9)))
    path = lambda most: "/" + "".join(rng.choice(list("xy/"), rng.integers(0, most)))
    rules = {host() + path(70): ("block", "allow")[int(rng.integers(2))] for _ in range(4000)}
    shapes = {(k.split("/")[0].count(".") + 1, len(k) - len(k.split("/")[0])) for k in rules}
    assert len(shapes) > 400
    urls = [f"http://{host()}{path(90)}?q" for _ in range(400)] + [f"https://a.{k}x" for k in list(rules)[:200]]

    def judged(url):
        h, p = url.split("://")[1].split("?")[0].split("/", 1)
        p, labels, fits = "/" + p, h.split("."), []
        for i in range(len(labels)):
            for m in range(len(p) + 1):
                k = ".".join(labels[i:]) + p[:m]
                if k in rules:
                    fits.append((len(k), len(k.split("/")[0]), k, rules[k]))
        return max(fits)[2:] if fits else (None, "allow")

    table, listed = spark.createDataFrame([(u,) for u in urls], "url string"), spark.createDataFrame(list(rules.items()), "key string, verdict string")
    want = {u: judged(u) for u in urls}
    assert sum(v[0] is not None for v in want.values()) > 200
    out = url_filter.filter_urls(table, listed)
    assert {r.url: (r.rule, r.verdict) for r in out.collect()} == want
    assert {r.url: (r.rule, r.verdict) for r in url_filter.filter_urls(table, listed, max_filter_bits=8000).collect()} == want
    few = url_filter.filter_urls(table, spark.createDataFrame(list(rules.items())[:5], "key string, verdict string"))
    size = lambda df: len(df._jdf.queryExecution().analyzed().toString())
    assert size(out) < 3 * size(few)  # by levels and probes of the filters, not by rules or shapes


def test_cascade_is_exact(spark):
    universe = spark.range(4000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 7 == 3).alias("listed"))
    n = universe.where("listed").count()
    cascade = url_filter.build_cascade(universe.where("listed"), universe.where("not listed"), n, 4000 - n)
    assert len(cascade.levels) > 1
    assert universe.where(cascade.contains(F.col("key")) != F.col("listed")).count() == 0
    bits, hashes = bloom.shape(1000, 0.01)
    assert 9000 < bits < 10000 and hashes == 7


# 5 packing

def read_pieces(rows, length):
    by, seqs = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    for parts in seqs.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    return by, seqs


def test_packing_round_trip(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = packing.pack(docs).collect()
    by, seqs = read_pieces(rows, 2048)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for d in docs.collect():
        ids = np.array([*tokenizer.encode(d.text, add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(by[d.doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    assert sum(r.length for r in rows) / (2048 * len(seqs)) > 0.95


def test_encoder_equals_tokenizer():
    import public_tokenizers

    e = packing.Encoder.of(public_tokenizers.path(packing.VOCABULARY))
    for t in ["", " ", "\n\n a", "a  b\n\n c'll  ", "x\ty", "日本語 abc", "<|endoftext|> a", "we're ok  12,5é!!", "a " * 500]:
        assert e.encode(t) == e.whole(t)


def test_shortest_pack_first():
    patterns = packing.shortest_pack_first({6: 2, 5: 1, 4: 3, 1: 4}, 10)
    used = {}
    for p, n in patterns:
        assert sum(p) <= 10
        for x in p:
            used[x] = used.get(x, 0) + n
    assert used == {6: 2, 5: 1, 4: 3, 1: 4} and sum(n for _, n in patterns) == 4


def test_packing_awkward(awkward):
    rows = packing.pack(awkward, length=64).collect()
    by, _ = read_pieces(rows, 64)
    assert {r.doc_tokens for r in by[1] + by[2]} == {1} and len(by[5]) == 2 and None in by
    assert packing.pack(awkward.limit(0)).count() == 0


# 6 fingerprints

def test_edited_texts(docs):
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    got = {r.doc_id: r for r in fingerprint.compare_edited(docs).collect()}
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.encode().lower().split()] for i in range(max(1, len(w) - 4)) if w}
    errors = []
    for i, r in enumerate(rows):
        after = rows[(i + 1) % len(rows)].text
        half = len(r.text) // 2
        edited = r.text[: len(r.text) - half] + after[:half]
        g = got[r.doc_id]
        assert (g.n_chars, g.edited_sha256) == (len(r.text), hashlib.sha256(edited.encode()).hexdigest())
        a, b = shingles(r.text), shingles(edited)
        errors.append(g.near_edited - len(a & b) / max(1, len(a | b)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_sketches(spark):
    words = [f"w{i}" for i in range(3000)]
    a, b = " ".join(words[:2000]), " ".join(words[1000:])
    sa, sb = fingerprint.sketch(a), fingerprint.sketch(b)
    assert fingerprint.distinct(sa) == pytest.approx(1996, rel=0.35)
    assert fingerprint.resemblance(sa, sb) == pytest.approx(1 / 3, abs=0.15)
    assert fingerprint.containment(sa, sb) == pytest.approx(0.5, abs=0.2)
    whole = fingerprint.merged(sa, sb)
    parts = spark.createDataFrame([("g", fingerprint.packed(x)) for x in (sa, sb, sa)] + [("g", None)], "g string, fingerprint string")
    assert fingerprint.merge_by(parts, ["g"]).first().fingerprint == fingerprint.packed(whole)
    assert fingerprint.resemblance(fingerprint.sketch(""), fingerprint.sketch(None)) == 1.0


def test_fingerprint_awkward(spark, awkward):
    got = fingerprint.compare_edited(awkward).collect()
    assert len(got) == len(AWKWARD) and fingerprint.compare_edited(awkward.limit(0)).count() == 0
    assert {r.fingerprint for r in got if r.doc_id == 5} == {r.fingerprint for r in got if r.doc_id == 4}
    single = fingerprint.compare_edited(spark.createDataFrame([(3, "a b c d")], "doc_id long, text string")).first()
    assert single.edited_sha256 == hashlib.sha256(b"a ba b"[:4] + b"a b").hexdigest() or single.n_chars == 7


def test_ranges_of_successors(spark):
    rows = spark.range(0, 50_000, 1, 4).select((F.col("id") * 3).alias("doc_id"), F.col("id").cast("string").alias("text"))
    dealt = fingerprint.successors(rows, max_buckets=16)
    counts = {(r.halo > 0): r["count"] for r in dealt.groupBy((F.col("halo") > 0).cast("int").alias("halo")).count().collect()}
    buckets = dealt.select("bucket").distinct().count()
    assert counts[False] == 50_000 and counts[True] == buckets


# 7 chat

def test_chat_awkward(spark):
    rows = [(1, 2, "user", "b"), (1, 1, "user", None), (1, 1, "user", None), (2, 1, None, "<|end|> & [INST]"), (2, 2, "assistant", "<|turn|>&amp;&lt;"), (3, 1, "assistant", ""), (None, 1, "user", "x"), (4, None, "assistant", "long " * 50_000), (4, 1, "user", "after")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, example int")
    examples = chat_format.expand(df)
    got = {r.conv_id: r for r in chat_format.digest(examples).collect()}
    text = "user\n\nuser\n\nuser\nb\n"
    assert got[1].n_turns == 3 and got[1].turns_sha256 == hashlib.sha256(text.encode()).hexdigest() and got[1].loss_chars == 0
    assert got[2].loss_sha256 == hashlib.sha256(b"<|turn|>&amp;&lt;").hexdigest()
    assert got[3].n_turns == 1 and got[3].loss_chars == 0 and None in got
    assert got[4].n_turns == 2 and got[4].loss_chars == 250_000
    assert examples.where("conv_id = 4").count() == 2
    assert chat_format.expand(df.limit(0)).count() == 0
    assert not [r for r in examples.collect() if "[INST]" in r.text or "</s>" in r.text]


# 8 shards

def test_shards(spark, docs, awkward):
    out = shards.shard(docs).toPandas()
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    assert all(r.size == len(texts[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in out.itertuples())
    sizes = out.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= max(out.groupby("vslot")["size"].sum())
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    odd = shards.shard(awkward).toPandas()
    assert len(odd) == len(AWKWARD) and odd["size"].min() == 8
    assert shards.shard(awkward.limit(0)).count() == 0


def test_slot_map_is_edited_and_versioned(spark, tmp_path):
    totals = {v: ((v * 37) % 101 + 1, 2) for v in range(512)}
    first = shards.rebalanced(shards.first_map(512, 8), totals, 8)
    second = shards.rebalanced(first, totals, 9)
    moved = [v for v in first if first[v] != second[v]]
    load = [sum(totals[v][0] for v in second if second[v] == s) for s in range(9)]
    assert 0 < len(moved) < 512 / 4 and {second[v] for v in moved} == {8} and max(load) - min(load) <= 2 * 101
    path = str(tmp_path / "map")
    assert shards.load_map(spark, path) is None
    shards.store_map(spark, first, totals, 1, path)
    shards.store_map(spark, second, totals, 2, path)
    assert {r.version for r in shards.load_map(spark, path).collect()} == {2}
    assert {r.vslot: r.shard for r in shards.load_map(spark, path, 1).collect()} == first
    assert set(shards.rebalanced(second, totals, 8).values()) <= set(range(8))
    with pytest.raises(Exception, match="(?i)exists"):
        shards.store_map(spark, first, totals, 2, path)


def test_sharding_again_edits_the_map(spark, docs, tmp_path):
    """Three calls on one path: each row once, one more version each, few slots move; brute force over placements."""
    path, n = str(tmp_path / "map"), docs.count()
    outs = [shards.shard(docs, 256, 8, path).toPandas(), shards.shard(docs, 256, 8, path).toPandas(), shards.shard(docs, 256, 9, path).toPandas()]
    assert [sorted(set(o.map_version)) for o in outs] == [[2], [3], [4]] and all(len(o) == n == o.doc_id.nunique() for o in outs)
    maps = [{r.vslot: r.shard for r in shards.load_map(spark, path, v).collect()} for v in (1, 2, 3, 4)]
    assert maps[0] == {v: v % 8 for v in range(256)} and maps[1] == maps[2]
    assert {maps[3][v] for v in maps[3] if maps[3][v] != maps[2][v]} == {8}
    for o, placed, count in zip(outs, maps[1:], (8, 8, 9), strict=True):
        assert all(placed[v] == s for v, s in zip(o.vslot, o.shard, strict=True))
        assert all(sorted(part.slot) == list(range(len(part))) for _, part in o.groupby("shard"))
        sizes = o.groupby("shard")["size"].sum()
        assert len(sizes) == count and sizes.max() - sizes.min() <= 2 * o.groupby("vslot")["size"].sum().max()
    with pytest.raises(ValueError, match="for ever"):
        shards.shard(docs, 128, 8, path)


# 9 repeats

def brute_repeats(rows, length):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def told(df):
    return [tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]


@pytest.mark.parametrize("length,group_rows", [(100, 2000), (40, 3)])
def test_repeats_against_brute_force(spark, docs, length, group_rows):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    shared = rows[3][1][:700]
    rows += [(10_000 + i, f"{i} own words here {i * 7919} {shared} and {i}") for i in range(30)] + [(20_000, "ab" * 400), (20_001, "x" * 350)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.remove_repeats(df, length, range_rows=3000, group_rows=group_rows)
    assert sorted(told(got)) == sorted(brute_repeats(rows, length))


def test_repeats_awkward(awkward):
    got = told(suffix_dedup.remove_repeats(awkward))
    assert sorted(got, key=repr) == sorted(brute_repeats(AWKWARD, 100), key=repr)
    assert suffix_dedup.remove_repeats(awkward.limit(0)).count() == 0


def test_runs_of_ranges_in_any_batches():
    """Kinds of rows do not depend on batches, and are those of a plain reading."""
    import pandas as pd

    rng = np.random.default_rng(2)
    rows = np.array(sorted({tuple(r) for r in np.column_stack([rng.integers(0, 4, 600), rng.integers(0, 6, 600), rng.integers(0, 2, 600), rng.integers(0, 5, 600), np.full(600, 7), rng.integers(0, 300, 600), rng.integers(0, 9, 600)]).tolist()}))
    frame = pd.DataFrame(rows, columns=suffix_dedup.COLUMNS)

    def plain(group_rows):
        out = []
        for part, of in frame.groupby("part"):
            groups = [g for _, g in of.groupby(["t0", "t1"])]
            for i, g in enumerate(groups):
                runs, border = g["run"].nunique(), i in (0, len(groups) - 1)
                for at, (_, r) in enumerate(g.iterrows()):
                    first = not at or g["run"].iloc[at - 1] != r["run"]
                    kind = 0 if not first else 2 if not i and not at else 4 if border or runs > group_rows else 1 if runs > 1 else None
                    if kind is not None:
                        out.append((kind, *(int(r[k]) for k in suffix_dedup.KEYS), part))
            last = groups[-1].iloc[-1]
            out.append((3, int(last["t0"]), int(last["t1"]), int(last["run"]), 7, 0, 0, part))
        return sorted(out)

    for group_rows in (2, 3, 100):
        for size in (1, 7, 64, 1000):
            got = pd.concat(suffix_dedup.runs_of_ranges((frame[i : i + size] for i in range(0, len(frame), size)), group_rows))
            assert sorted((*r[:5], *((0, 0) if r[0] == 3 else r[5:7]), r[7]) for r in got.itertuples(index=False, name=None)) == plain(group_rows), (group_rows, size)


def test_repeats_of_a_hot_token(spark):
    """A passage in over half of all rows, each time with other neighbours, so that its tokens make one large group."""
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, f"{' '.join(word() for _ in range(30))} {passage if i % 3 else ''} {' '.join(word() for _ in range(30))}") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(brute_repeats(rows, 100))
    assert sum(r[2] for r in want) > 25_000
    for range_rows in (200, 100_000):
        tables = {t.name for t in spark.catalog.listTables()}
        assert sorted(told(suffix_dedup.remove_repeats(df, range_rows=range_rows, group_rows=20))) == want
        assert {t.name for t in spark.catalog.listTables()} == tables


# 10 exact dedup

def test_exact_dedup_checks_bytes(docs):
    """A digest of one hex digit: every hit must be told apart by the full texts."""
    want = {tuple(r) for r in exact_dedup.dedup(docs).drop("_file", "_row").collect()}
    got = {tuple(r) for r in exact_dedup.dedup(docs, digest=lambda c: F.substring(c, 1, 1), files_per_trigger=1).drop("_file", "_row").collect()}
    assert got == want


def brute_groups(feeds):
    """(doc_id, keep_id, group_size, kept) of the last of several feeds."""
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    every = [(i, low(t)) for feed in feeds for i, t in feed]
    out = []
    for i, t in feeds[-1]:
        ids = [j for j, u in every if u == low(t)]
        out.append((i, max(ids), len(ids), i == max(ids)))
    return sorted(out)


@pytest.mark.parametrize("digest", [F.unhex, lambda c: F.substring(c, 1, 1)], ids=["whole digest", "forced collisions"])
def test_exact_dedup_goes_on(spark, tmp_path, digest):
    """Later feeds into the same checkpoint find the copies of earlier ones, and compare their bytes."""
    feeds = [[(1, "a"), (2, "b"), (9, "e"), (10, "f"), (11, None)], [(3, "A"), (4, "c"), (5, "E"), (6, "")], [(7, "a"), (8, "C"), (12, "g")]]
    for n in range(3):
        out = exact_dedup.dedup(spark.createDataFrame(feeds[n], "doc_id long, text string"), digest, str(tmp_path / "state"))
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in out.collect()) == brute_groups(feeds[: n + 1])


def test_exact_dedup_awkward(awkward):
    got = exact_dedup.dedup(awkward).collect()
    assert len(got) == len(AWKWARD)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert {r.keep_id for r in got if r.doc_id in (1, 2)} == {2} and {r.group_size for r in got if r.doc_id == 5} == {3}
    kept = exact_dedup.kept_rows(awkward)
    assert kept.columns == awkward.columns and kept.count() == 7 and set(rows_of(kept)) <= set(rows_of(awkward))
    assert exact_dedup.dedup(awkward.limit(0)).count() == 0


# shared

def test_components(spark):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (250, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = union_find({x for p in links for x in p}, links)
    assert {k: got.get(k, k) for k in want} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_order_of_rows(awkward):
    rows = with_order(awkward, "number", keep=True)
    assert rows_of(rows.drop("number")) == rows_of(awkward)
    rows = rows.collect()
    assert sorted(r.number for r in rows) == list(range(len(AWKWARD))) and min(rows, key=lambda r: r.number).doc_id is None
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.number)] == sorted((r[0] for r in AWKWARD), key=lambda i: -1 if i is None else i)


def test_scratch_removes_what_was_stored(spark, tmp_path):
    import os

    from sparkqa.llm.shared import new_folder, scratch, stored

    kept = stored(spark.range(3), "kept")
    with scratch(spark):
        path = new_folder(spark, "gone")
        spark.range(3).write.parquet(path)
    assert not os.path.exists(path) and kept.count() == 3


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as Of

    from sparkqa.llm.shared import shared_folder

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Of(conf=Of(get=lambda *_: None), sparkContext=Of(master="spark://host:7077")))
