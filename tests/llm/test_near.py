"""Near duplicates against brute force: templates, kinds of edits, resemblances close to the limit."""

import numpy as np

from sparkqa.llm import simhash


def shingles(words, n=5):
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def resemblance(a, b):
    return len(a & b) / len(a | b)


def fresh(rng, n):
    return [f"w{x}" for x in rng.integers(10**9, size=n)]


def groups_of(spark, texts, **options):
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: r.group_id for r in simhash.similar_groups(d, **options).collect()}


def brute_force(texts, similarity=0.8):
    sets = [shingles(w) for w in texts]
    low = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if resemblance(sets[a], sets[b]) >= similarity:
                x, y = low[a], low[b]
                low = [min(x, y) if g in (x, y) else g for g in low]
    return dict(enumerate(low))


def test_families_of_a_template(spark):
    rng = np.random.default_rng(1)
    template, texts = fresh(rng, 247), []
    for _ in range(1000):
        own = fresh(rng, 36)
        texts += [template + own + fresh(rng, 16) for _ in range(2)]
    sets = [shingles(w) for w in texts]
    assert min(resemblance(sets[i], sets[i + 1]) for i in range(0, 2000, 2)) > 0.88
    assert all(0.68 < resemblance(sets[0], s) < 0.8 for s in sets[2:])
    assert groups_of(spark, texts) == {i: i - i % 2 for i in range(2000)}


def test_large_keys_against_brute_force(spark):
    rng = np.random.default_rng(2)
    texts = []
    for _ in range(6):
        base = fresh(rng, 120)
        for _ in range(25):
            words = base.copy()
            for at in rng.integers(120, size=rng.integers(1, 5)):
                words[at] = f"x{rng.integers(3)}"
            texts.append(words[rng.integers(8) :])
    expected = brute_force(texts)
    assert 6 < len(set(expected.values())) < 150
    assert groups_of(spark, texts) == groups_of(spark, texts, key_rows=5, block_shingles=2_000) == expected


def test_kinds_of_edits(spark):
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(60):
        base = fresh(rng, 300)
        replaced, scattered = base.copy(), base.copy()
        at = rng.integers(270)
        replaced[at : at + 26] = fresh(rng, 26)
        for i in rng.choice(300, 6, replace=False):
            scattered[i] = f"y{i}"
        for edit in (base + fresh(rng, 60), fresh(rng, 60) + base, base[:250], replaced, scattered):
            old = {w: f"{fresh(rng, 1)[0]}{w}" for w in base}  # each edit has a base of its own
            texts += [[old[w] for w in base], [old.get(w, w) for w in edit]]
    sets = [shingles(w) for w in texts]
    assert all(0.8 <= resemblance(sets[i], sets[i + 1]) < 0.9 for i in range(0, len(texts), 2))
    assert groups_of(spark, texts) == {i: i - i % 2 for i in range(len(texts))}


def test_close_to_the_limit(spark):
    rng = np.random.default_rng(4)
    texts, near = [], []
    for more in range(200, 300):
        base = fresh(rng, 1004)
        texts += [base, base + fresh(rng, more)]
        near.append(1000 / (1000 + more) >= 0.8)
    assert sum(near) == 51
    got = groups_of(spark, texts)
    assert [got[2 * i] == got[2 * i + 1] for i in range(100)] == near


def test_links_that_others_stand_between(spark):
    """Permutations of the same words have equal word counts and no common shingle, and stand by the thousand between two
    texts that differ in one swap: those two are found, and nothing else."""
    rng = np.random.default_rng(5)
    words = fresh(rng, 120)
    for many in (4, 3000):
        texts = [[words[i] for i in rng.permutation(120)] for _ in range(many)]
        one = [words[i] for i in rng.permutation(120)]
        two = one.copy()
        two[60], two[61] = two[61], two[60]
        assert resemblance(shingles(one), shingles(two)) >= 0.8
        assert groups_of(spark, [*texts, one, two]) == {**{i: i for i in range(many + 1)}, many + 1: many}


def test_short_texts(spark):
    """Sets too small for sketches, against brute force."""
    rng = np.random.default_rng(6)
    vocabulary = fresh(rng, 6)
    texts = [[vocabulary[i] for i in rng.integers(6, size=rng.integers(1, 9))] for _ in range(150)]
    for size in (25, 70):
        for _ in range(10):
            base = fresh(rng, size)
            texts += [base, base[:-2], base[1:-3], fresh(rng, 1) + base[1:]]
    assert groups_of(spark, texts) == brute_force(texts)


def test_families_with_rows_unlike_their_first(spark):
    """Chains of edits lead away from the first text, so that later ones are like each other and not like it; equal sets
    in other order and case; all in one family, with small blocks too."""
    rng = np.random.default_rng(7)
    texts = []
    for _ in range(3):
        words = fresh(rng, 150)
        for step in range(30):
            texts.append(words)
            texts += [[w.upper() for w in words]] * (step % 3 == 0)
            words = words.copy()
            words[5 * step : 5 * step + 4] = fresh(rng, 4)
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order]
    expected = brute_force([[w.lower() for w in t] for t in texts])
    assert len(set(expected.values())) < 30
    assert groups_of(spark, texts) == groups_of(spark, texts, key_rows=7, block_shingles=800) == groups_of(spark, texts, block_shingles=1) == expected


def test_large_families_take_time_in_proportion(spark):
    """Texts that differ in blanks and case alone, and near copies of one text, by the ten thousand: four times the rows may
    not take much more than four times as long."""
    import time

    def took(n):
        rng = np.random.default_rng(8)
        base = fresh(rng, 80)
        rows = [(i, ("  " if i % 2 else " ").join([*base[:40], (base[40].upper() if i % 3 else base[40]), *base[41:]]) + " " * (i % 50)) for i in range(n)]
        other = fresh(rng, 80)
        rows += [(n + i, " ".join([*other, f"x{i}"])) for i in range(n)]
        began = time.time()
        got = {r.group_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
        assert got == {0, n}
        return time.time() - began

    took(100)
    small, large = took(5_000), took(20_000)
    assert large < 6 * small + 20
