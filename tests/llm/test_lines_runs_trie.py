"""Line dedup, periodic runs and the prefix trie: against SQL and brute force, and on nulls, empty and long texts, ties,
repeated rows, empty tables and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from oracle import same
from test_operators import AWKWARD, LONG, SF, awkward, rows_of  # noqa: F401

from sparkqa.llm import line_dedup, periodic_runs, prefix_trie

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# 13 line dedup

def brute_lines(rows, least=10):
    """rows: (order, text). Per order: lines, dropped, kept."""
    held = {}
    for o, text in rows:
        for line in (text or "").split("\n"):
            key = lower(line.strip(SPACE))
            if len(key) >= least:
                held.setdefault(key, set()).add(o)
    out = {}
    for o, text in rows:
        lines = (text or "").split("\n")
        gone = [len(held.get(k := lower(line.strip(SPACE)), ())) > 1 and min(held[k]) != o for line in lines]
        out[o] = (len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g))
    return out


def test_lines_against_brute_force(spark):
    rng = random.Random(3)
    lines = ["", "short", "a line of words", "A LINE of words\t", "  a line of words", "ÄÖÜ ÄÖÜ ÄÖ", "äöü äöü äö", "123456789", "1234567890", "x" * 5000]
    rows = [(i, "\n".join(rng.choice(lines + [f"line of its own {i} {j}"]) for j in range(rng.randint(1, 8)))) for i in range(200)]
    for bits in (line_dedup.MAX_BITS, 8 * line_dedup.BLOCK):  # the smallest filters pass a few keys too many
        got = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), max_bits=bits)
        assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in got.collect()} == brute_lines(rows)


def test_full_filters_lose_nothing(spark):
    """Filters with far more keys than bits: all lines are suspects, the result is the same."""
    rows = [(i, "\n".join(f"line number {(i * 7 + j) % 900:06d}" for j in range(9))) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert line_dedup.twice_seen(frame, max_bits=64).tolist() == [255] * 8
    got = line_dedup.drop_repeated_lines(frame, max_bits=64)
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in got.collect()} == brute_lines(rows)


def test_filters_merge_without_false_negatives():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    parts = [keys[:2000], keys[1000:], np.concatenate((keys[2900:], keys[2900:]))]
    merged, bits = line_dedup.Filters(1 << 16), 1 << 16
    for part in parts:
        own = line_dedup.Filters(bits)
        own.see(part)
        merged.merge(own.once, own.twice)
    found = line_dedup.passes(merged.twice, line_dedup.positions(keys, bits))
    assert found[1000:2000].all() and found[2900:].all() and found[:1000].mean() < 0.1 and found[2000:2900].mean() < 0.1


def test_lines_awkward(spark, awkward):  # noqa: F811
    got = line_dedup.drop_repeated_lines(awkward)
    order = sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = brute_lines([(i, t) for i, (_, t) in enumerate(order)])
    assert sorted((repr(r.doc_id), r.n_lines, r.n_dropped, r.kept) for r in got.collect()) == sorted((repr(order[i][0]), *w) for i, w in want.items())
    assert line_dedup.drop_repeated_lines(awkward.limit(0)).count() == 0
    twice = spark.createDataFrame([(7, "the same long line"), (7, "the same long line"), (8, LONG), (9, LONG)], "doc_id long, text string")
    assert sorted(r.n_dropped for r in line_dedup.drop_repeated_lines(twice).collect()) == [0, 0, 1, 1]


# 11 periodic runs

def brute_runs(words):
    """(start, length, period) of all runs."""
    ids = {}
    x = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    out = {}
    for q in range(1, len(words) // 4 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (x[:-q] == x[q:]).astype(int), [0]))))
        for s, e in zip(edges[::2].tolist(), (edges[1::2] + q).tolist()):
            if e - s >= max(6, 4 * q):
                out.setdefault((s, e), q)  # smaller periods come first
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def told(doc_id, words):
    runs = brute_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_runs_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()
    want = [told(r.doc_id, planted(r.doc_id, (r.text or "").encode().split())) for r in docs]
    got = periodic_runs.op11_periodic_runs(spark, f"/root/testdata/{sf}").collect()
    assert sorted(map(tuple, got)) == sorted(want) and sum(w[1] for w in want) > 10


def random_words(rng):
    k, kind, n = rng.choice([1, 2, 2, 3, 5, 50]), rng.random(), rng.choice([0, 1, 5, 6, 7, 20, 60, 150])
    draw = lambda n: [rng.randrange(k) for _ in range(n)]
    if kind < 0.4:
        return draw(n)
    out = []
    if kind < 0.8:
        while len(out) < n:
            out += (draw(rng.randint(1, 12)) * rng.randint(1, 8))[: rng.randint(1, 60)]
        return out
    out = (draw(rng.randint(1, 6)) * rng.randint(1, 6) + [99]) * rng.randint(1, 7)
    return (out + [98]) * rng.randint(1, 6)


def test_runs_against_brute_force():
    """Words over small alphabets, powers, powers of powers; several documents at once."""
    rng = random.Random(5)
    for _ in range(1500):
        docs = [" ".join(map(str, random_words(rng))) for _ in range(rng.randint(1, 4))]
        for text, (starts, lengths, periods, _) in zip(docs, periodic_runs._told(docs), strict=True):
            assert list(zip(starts, lengths, periods)) == brute_runs(text.split())


def test_grammar_derives_the_words():
    """Each rule's derivations hold the same words; no pair of a final junction occurs twice without overlapping."""
    rng = np.random.default_rng(2)
    words = np.concatenate([rng.integers(0, 3, 400), 3 + np.tile(rng.integers(0, 9, 20), 9)])
    g = periodic_runs.re_pair(words, np.array([0, 400]))
    for rule, at in zip(g.rule, g.derived, strict=True):
        n = g.end[rule] - g.start[rule]
        assert (words[at : at + n] == words[g.start[rule] : g.end[rule]]).all() and g.start[rule] < g.middle[rule] < g.end[rule]
    assert (np.bincount(g.rule) > 1).all()
    inside = {m for rule, at in zip(g.rule, g.derived, strict=True) for m in [at + g.middle[rule] - g.start[rule]]}
    assert sorted([*inside, *g.junctions.tolist()]) == [i for i in range(1, len(words)) if i != 400]


def test_runs_of_long_texts():
    """Powers of one word and of long periods, and Fibonacci words: time must stay near the length."""
    a, b = "a ", "a b "
    while len(b) < 100_000:
        a, b = b, b + a
    rng = random.Random(1)
    period = " ".join(str(rng.randrange(10**6)) for _ in range(10_000))
    one, long, fib = periodic_runs._told(["w " * 100_000, " ".join([period] * 5), b])
    assert [x[0] for x in one[:3]] == [0, 100_000, 1] and one[3] == "w"
    assert [x[0] for x in long[:3]] == [0, 50_000, 10_000] and long[3] == period
    assert fib[0] == []  # its powers stay below four


def test_runs_awkward(awkward):  # noqa: F811
    got = {repr((r.doc_id, r.collapsed)): [tuple(x) for x in r.runs] for r in periodic_runs.periodic_runs(awkward).collect()}
    for doc_id, text in AWKWARD:
        words = (text or "").encode().split()
        runs = brute_runs(words) if len(words) < 1000 else [(0, len(words), 3)]
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert got[repr((doc_id, b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))] == runs
    assert periodic_runs.periodic_runs(awkward).count() == len(AWKWARD) and periodic_runs.periodic_runs(awkward.limit(0)).count() == 0


# 12 prefix trie

def brute_trie(conversations):
    """conversations: {id: [(role, text)]}. Rows in the order of the columns."""
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    low = lambda ids: min((i for i in ids if i is not None), default=None)
    kids = {p: [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p] for p in members}

    def under(p):
        yield p
        for q in kids[p]:
            yield from under(q)

    out = []
    for p, ids in members.items():
        ended = sorted((c for c in ids if len(conversations[c]) == len(p)), key=lambda c: (c is not None, c or 0))
        text = ",".join("null" if c is None else str(c) for c in ended)
        out.append((
            low(ids), len(p), low(members[p[:-1]]) if p else None, len(ids), len(kids[p]), sum(not kids[q] for q in under(p)),
            sum((len(members[q]) - 1) * len(q[-1][1].encode().split()) for q in under(p) if q), hashlib.sha256(text.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def trie_rows(df):
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect()), key=repr)


def turns_frame(spark, conversations):
    rows = [(c, i, r, t) for c, turns in conversations.items() for i, (r, t) in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)


@pytest.mark.parametrize("kind", ["bushy", "long", "hot"])
def test_trie_against_brute_force(spark, kind):
    rng = random.Random(kind)
    words = ["", "one", "one two", "three  of them"]
    draw = lambda n: [(rng.choice(["user", "assistant"]), rng.choice(words)) for _ in range(n)]
    if kind == "bushy":
        every = {c: draw(rng.randint(1, 5)) for c in range(150)}
    elif kind == "long":  # conversations that part late, end within others, or are equal
        base = [("user", f"turn {i}") for i in range(60)]
        every = {c: base[: rng.choice([1, 30, 31, 59, 60])] + draw(rng.choice([0, 0, 1, 2])) for c in range(40)} | {-5: base + draw(30)}
    else:
        every = {c: [("user", "hello"), ("assistant", "hello")] if c % 3 else [("user", "hello"), *draw(2)] for c in range(-50, 150)}
    assert trie_rows(prefix_trie.prefix_trie(prefix_trie.turn_sequences(turns_frame(spark, every)), piece_chars=40)) == brute_trie(every)


def test_trie_awkward(spark):
    rows = [(1, None, None, None, "x"), (1, 0, "user", "b", "y"), (1, 0, "user", "b", "y"), (2, None, "", "", "z"), (None, 1, "user", "null id", "n"), (3, 0, "user", LONG, "l"), (3, 1, "user", " \t ", "l")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path string")
    every = {1: [("", ""), ("user", "b"), ("user", "b")], 2: [("", "")], None: [("user", "null id")], 3: [("user", LONG), ("user", " \t ")]}
    sequences = prefix_trie.turn_sequences(frame)
    assert trie_rows(prefix_trie.prefix_trie(sequences)) == brute_trie(every)
    assert prefix_trie.prefix_trie(sequences.limit(0)).count() == 0
    bare = sequences.selectExpr("conv_id", "slice(turns, 1, 0) AS turns")
    assert trie_rows(prefix_trie.prefix_trie(bare)) == brute_trie({c: [] for c in every})


def test_trie_of_rebuilt_conversations(spark):
    """The query's families: heads taken from the first of each twenty, absent ones, and what has fewer turns than its head."""
    rng = random.Random(8)
    own = {c: [("user", f"{c} {i}") for i in range(rng.randint(1, 4))] for c in [*range(0, 41), *range(61, 70), -20, -7]}
    want = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, int(c / 20) * 20
        want[c] = own.get(base, [])[:h] + turns[h:]
    assert any(not w for w in want.values())
    sequences = prefix_trie.with_shared_heads(prefix_trie.turn_sequences(turns_frame(spark, own)))
    assert trie_rows(prefix_trie.prefix_trie(sequences)) == brute_trie(want)


@pytest.mark.parametrize("query, sql", [(line_dedup.op13_line_dedup, line_dedup.SQL), (prefix_trie.op12_prefix_trie, prefix_trie.SQL)])
def test_against_sql(spark, query, sql):
    same(query(spark, "/root/testdata/sf0.01"), sql, "/root/testdata/sf0.01")
    assert SF
