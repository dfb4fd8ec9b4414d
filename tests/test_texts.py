"""Texts, retrieval, grounding, linking, conversations: the cases of the service, and helpers against plain Python."""

import re
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkqa.functions import scalar as S
from sparkqa.operators import conversation, corpus, grounding, linking, questions, runlog
from sparkqa.sources import catalog as C


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n", max_size=3000))
def test_splitter_properties(text):
    chunks = corpus.split_text(text, 70, 10)
    assert all(len(c) <= 70 for c in chunks)
    at = 0
    squeezed = re.sub(r"\s", "", text)
    for c in chunks:
        part = re.sub(r"\s", "", c)
        found = squeezed.find(part, max(0, at - 10))
        assert found >= 0 and found <= at
        at = found + len(part)
    assert at == len(squeezed)
    if len(text.strip()) and len(text) < 70:
        assert chunks == [text.strip()]


def test_flatten_tables(spark):
    rows = ["| Deposits | Deposits | 3,615.08 |", "|---|---|", "| a | b |", "plain"]
    assert one(spark, corpus.flatten_tables(F.lit("\n".join(rows)))) == "Deposits: 3,615.08\na | b\nplain"


def test_row_text_and_names(spark):
    df = spark.createDataFrame([("a", None), (None, None)], "x string, y int")
    assert [r.text for r in corpus.row_text(df).collect()] == ["x: a"]
    items = spark.createDataFrame([("sales.xlsx", 1), ("sales.xlsx", 2), ("hr.csv", 3)], "document_name string, pos int")
    assert [r.name for r in corpus.document_names(items, ["document_name"], "pos").collect()] == ["sales.xlsx", "hr.csv"]


def test_string_leaves(spark):
    df = spark.createDataFrame([(1, '{"a": ["x", {"b": "y"}], "c": 3, "d": "z"}'), (2, "no json"), (3, None)], "k int, j string")
    assert [(r.k, r.pos, r.line) for r in corpus.string_leaves(df, "k", "j").collect()] == [(1, 0, "x"), (1, 1, "y"), (1, 2, "z")]


def test_sections(spark):
    lines = [(1, i, x) for i, x in enumerate(["intro", "DEPOSITS and checks paid", "10", "Statement Date", "x"])]
    got = corpus.section_chunks(spark.createDataFrame(lines, "d int, pos int, line string"), "d").orderBy("chunk_no").collect()
    assert [(r.id, r.section, r.text) for r in got] == [("chunk_1", "general", "intro"), ("chunk_2", "deposits", "DEPOSITS and checks paid\n10"), ("chunk_3", "statement_information", "Statement Date\nx")]


def fuzzy(q, c):
    norm = lambda t: re.sub("[^a-z0-9]+", " ", t.lower().replace("&", " and ")).strip()
    q, c = norm(q), norm(c)
    if not q or not c:
        return 0.0
    if q == c:
        return 1.0
    if q in c or c in q:
        return 0.82 + 0.18 * min(len(q), len(c)) / max(len(q), len(c))
    best = [1.0 if t in c.split() else max(SequenceMatcher(None, t, o).ratio() for o in c.split()) for t in q.split()]
    return max(sum(best) / len(best), SequenceMatcher(None, q, c).ratio())


def test_fuzzy_score(spark):
    pairs = [("a", ""), ("Net Sales", "net sales"), ("sales", "net sales"), ("Almunium case settlement", "Aluminium cash-settlement (LME)"), ("R&D", "r and d"), ("xyz", "abc"), (None, "x")]
    got = spark.createDataFrame(pairs, "q string, c string").select("q", "c", linking.fuzzy_score(F.col("q"), F.col("c")).alias("s")).collect()
    for r in got:
        assert r.s == pytest.approx(fuzzy(r.q or "", r.c))


def test_link_values(spark):
    metals = spark.createDataFrame([("Aluminium cash-settlement (LME)",), ("Copper cash-settlement (LME)",)], "commodity_name string")
    phrases = spark.createDataFrame([("Almunium cash settlement LME",), ("copper cash settlement lme",), ("xyzzy",), (None,)], "phrase string")
    found = {r.phrase: r.value for r in linking.link_values(phrases, linking.value_dictionary(metals, ["commodity_name"])).collect()}
    assert found == {"Almunium cash settlement LME": "Aluminium cash-settlement (LME)", "copper cash settlement lme": "Copper cash-settlement (LME)"}


TWO = [("two_years", 0, "2023 Revenue = 500\n2024 Revenue = 600"), ("one_year", 0, "2023 Revenue = 500 million"), ("conflict", 0, "2023 revenue was 500. 2023 revenue was 800. 2024 revenue was 600.")]


def test_evidence(spark):
    texts = spark.createDataFrame([*TWO, ("no_metric", 0, "The company reported aluminium production in 2024.")], "query_id string, pos int, text string")
    asked = spark.createDataFrame([(k, "revenue", ["2023", "2024"], True) for k in ("two_years", "one_year", "conflict", "nothing")] + [("no_metric", "milk", ["2024"], False)], "query_id string, metric string, years array<string>, calculation boolean")
    got = {r.query_id: r for r in grounding.evidence_status(asked, texts).collect()}
    assert {k: r.status for k, r in got.items()} == {"two_years": "relevant", "one_year": "insufficient", "conflict": "conflicting", "nothing": "irrelevant", "no_metric": "insufficient"}
    assert got["one_year"].missing == ["2024"] and got["no_metric"].completeness == 0.2
    values = grounding.metric_values(texts.withColumn("metric", F.lit("revenue")))
    grown = {r.query_id: r.growth for r in grounding.growth(grounding.facts(values), asked.where("calculation")).collect()}
    assert grown["two_years"] == 20.0 and grown["one_year"] is None and grown["conflict"] is None


def test_answers(spark):
    check = lambda a, e, r=None: one(spark, grounding.verified(F.lit(a), F.lit(e), F.lit(r) if r is not None else None))
    assert not check("Revenue was 99999 in 2024.", "2024 Revenue = 600")
    assert check("Revenue was 600.04 in 2024.", "2024 Revenue = 600")
    assert check("It grew by 20%.", "2023 500, 2024 600", 20.0)
    assert check("I don't have enough data: 12345", "x")


def test_calculations(spark):
    assert one(spark, S.explicit_percentage(F.lit("What is the percentage increase from 500 to 600?"))) == 20.0
    assert one(spark, S.explicit_percentage(F.lit("from 500 to 600"))) is None
    assert one(spark, S.percentage_change(F.lit(0.0), F.lit(1.0))) is None
    assert one(spark, S.verify_calculation(F.lit("growth"), F.lit(500.0), F.lit(600.0), F.lit(20.0)))
    assert one(spark, S.normalize_text(F.lit(" Straße & Co. "))) == "strasse and co"
    assert one(spark, S.format_number(F.lit(1234.5))) == "1,234.5" and one(spark, S.format_number(F.lit(float("nan")))) is None
    assert one(spark, C.unit_of(F.lit("Price (USD/t)"))) == "USD/t"


def test_questions(spark):
    told = lambda t: one(spark, questions.analysis(F.lit(t)))
    assert told("What was the growth?").is_ambiguous and told("").missing == ["question"]
    r = told("What was the revenue growth?")
    assert (r.metric, r.needs_period, r.requires_calculation) == ("revenue", True, True)
    follow = one(spark, questions.analysis(F.lit("And growth in 2024?"), F.lit("revenue"), F.lit("2023"), F.lit("2024")))
    assert (follow.metric, follow.start_period, follow.end_period) == ("revenue", "2023", "2024")
    op = lambda t: one(spark, questions.operation_of(F.lit(t)))
    assert [op(t) for t in ("How many unique customers", "total revenue by region", "median price", "top 5 products by revenue", "rank the total", "tell me a story", "monthly sales over time")] == ["distinct_count", "group_sum", "median", None, "bottom_n", None, "trend"]
    assert [one(spark, questions.limit_of(F.lit(t))) for t in ("top 7", "bottom three", "top 5000", "x")] == [7, 3, None, None]


METRIC_ASKED, METRIC_OPTIONS = "Do you mean revenue growth, profit growth, or employee growth?", ["revenue growth", "profit growth", "employee growth"]
#: Conversations (text, years that retrieval found) and what each turn must give: resolved, metric, start, end, what is
#: missing, what is asked back, options.
SCRIPTS = {
    "metric": [
        ("What was the growth?", None, ("What was the growth?", "", "", "", "metric", METRIC_ASKED, METRIC_OPTIONS)),
        ("revenue", None, ("What was the revenue growth?", "revenue", "", "", "period", "", [])),
        ("from 2023 to 2024", None, ("What was the revenue growth from 2023 to 2024?", "revenue", "2023", "2024", "", "", [])),
        ("And growth in 2024?", None, ("What was the revenue growth from 2023 to 2024?", "revenue", "2023", "2024", "", "", [])),
    ],
    "period": [
        ("What was the revenue growth?", ["2023", "2021", "2022"], ("What was the revenue growth?", "revenue", "", "", "period", "Which period do you mean: 2021-2022, or 2022-2023?", ["2021-2022", "2022-2023"])),
        ("2021-2022", ["2023", "2021", "2022"], ("What was the revenue growth from 2021 to 2022?", "revenue", "2021", "2022", "", "", [])),
    ],
    "one period is no choice": [("What was the revenue growth?", ["2023", "2022"], ("What was the revenue growth?", "revenue", "", "", "period", "", []))],
    "metric, then period": [
        ("What was the growth?", ["2020", "2021", "2022"], ("What was the growth?", "", "", "", "metric", METRIC_ASKED, METRIC_OPTIONS)),
        ("profit growth", ["2020", "2021", "2022"], ("What was the profit growth?", "profit", "", "", "period", "Which period do you mean: 2020-2021, or 2021-2022?", ["2020-2021", "2021-2022"])),
        ("2020 2021", ["2020", "2021", "2022"], ("What was the profit growth from 2020 to 2021?", "profit", "2020", "2021", "", "", [])),
    ],
    "asked twice at most": [
        ("growth", None, ("growth", "", "", "", "metric", METRIC_ASKED, METRIC_OPTIONS)),
        ("growth?", None, ("growth?", "", "", "", "metric", METRIC_ASKED, METRIC_OPTIONS)),
        ("growth", None, ("growth", "", "", "", "metric", "", [])),
    ],
    "pair": [("What is the percentage increase from 500 to 600?", None, ("What is the percentage increase from 500 to 600?", "", "", "", "", "", []))],
    "nothing": [(None, None, ("", "", "", "", "question", "What would you like to know?", []))],
}


def test_conversation_machine(spark):
    rows = [(key, i, text, years) for key, script in SCRIPTS.items() for i, (text, years, _) in enumerate(script)]
    got = {(r.conv_id, r.turn): r for r in conversation.clarify(spark.createDataFrame(rows, "conv_id string, turn int, text string, years array<string>"), found_years="years").collect()}
    for key, script in SCRIPTS.items():
        for i, (*_, want) in enumerate(script):
            r = got[key, i]
            assert (r.resolved, r.metric, r.start_period, r.end_period, r.pending_slot, r.asked, r.options) == want, (key, i)
            assert r.clarification == bool(want[5])


def test_stream_equals_batch(spark):
    from sparkqa import queries

    sf = "/root/testdata/sf0.001"
    q = queries.queries()
    assert sorted(map(tuple, q["j5_clarify_stream"](spark, sf).collect())) == sorted(map(tuple, q["j2_clarify"](spark, sf).collect()))


def test_prices_and_log(spark):
    rows = spark.createDataFrame([("google", 1_000_000, 1_000_000), ("nobody", 1, 1)], "provider string, input_tokens long, output_tokens long")
    got = {r.provider: r for r in runlog.priced(rows).collect()}
    assert got["google"].total_cost == 2.8 and got["nobody"].price_error and got["nobody"].total_cost is None
    lines = spark.createDataFrame([('{"question": "q", "answer": null}',), ("",), ("{bad",)], "value string")
    assert runlog.parse_jsonl(lines, "question string, answer string").count() == 1
    empty = spark.createDataFrame([], "timestamp string, status string")
    assert tuple(runlog.indicators(empty, F.current_timestamp()).first()) == (0, 0.0, 0.0, 0.0, 0.0)


def test_clear_and_replace(spark):
    store = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "__document_id string, v int")
    assert C.clear_report(store).count() == 3 and C.cleared(store).count() == 0
    new = C.replace_documents(store, spark.createDataFrame([("b", 9)], "__document_id string, v int"))
    assert sorted(map(tuple, new.collect())) == [("a", 1), ("b", 9), ("c", 3)]


def test_links_against_brute_force(spark):
    """Every phrase against every value: no link is lost, swapped and short tokens included."""
    import itertools
    import random

    random.seed(4)
    words = ["us", "uk", "ab", "cd", "kv", "11", "a", "b", "steel", "steal", "copper", "coper", "aluminium", "almunium", "zinc", "settlement", "cash"]
    values = sorted({" ".join(random.sample(words, random.randint(1, 3))) for _ in range(60)})
    phrases = sorted({" ".join(random.sample(words, random.randint(1, 3))) for _ in range(80)} | {"us uk", "uk us", "cd ab", "kv 11", "b a"})
    dictionary = linking.value_dictionary(spark.createDataFrame([(v,) for v in [*values, "uk us", "ab cd", "11 kv", "a b"]], "v string"), ["v"])
    known = {r.value for r in dictionary.collect()}
    want = {}
    for p in phrases:
        scores = sorted(((fuzzy(p, v), v) for v in known), key=lambda x: (-x[0], x[1]))
        (best, value), follower = scores[0], scores[1][0]
        if best == 1.0 or best >= 0.88 or (best >= 0.82 and best - follower >= 0.08):
            want[p] = value if p not in known else p
    got = {r.phrase: r.value for r in linking.link_values(spark.createDataFrame([(p,) for p in phrases], "phrase string"), dictionary).collect()}
    assert set(got) == set(want) and {"us uk", "cd ab", "kv 11", "b a"} <= set(got)
    assert all(fuzzy(p, got[p]) == pytest.approx(fuzzy(p, want[p])) for p in want)
    assert list(itertools.islice(sorted(got), 1))
