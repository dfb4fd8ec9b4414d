"""Queries over all their rows, against plain Python."""

import re

from sparkqa import queries as library
from sparkqa.operators import corpus, questions
from sparkqa.queries.conversations import FORMS, asked

SF = "/root/testdata/sf0.001"


def resolved(text):
    low = text.lower()
    metric = next((m for w, m in questions.METRICS.items() if re.search(rf"\b{w}\b", low)), "")
    start, end, *_ = [*re.findall(r"\b(?:19|20)\d\d\b", text), "", ""]
    grows = re.search(r"\b(growth|increase|decrease|change|yoy|year over year|percent(age)?)\b", low)
    calculates = grows or re.search(r"from\s+-?\d+(\.\d+)?\s+to\s+-?\d+(\.\d+)?", low)
    if re.match(r"(and|what about|how about|also|same for)\b", low) and re.search("growth|increase", low):
        return f"What was the {metric or 'profit'} growth from {start or '2000'} to {end or '2030'}?"
    if metric and start and end and calculates:
        return f"What was the {metric} growth from {start} to {end}?"
    return " ".join(text.split())


def test_resolved_questions_of_all_forms(spark):
    texts = {r.id: r.text for r in asked(spark, SF).collect()}
    assert {i % len(FORMS) for i in texts} == set(range(12))
    got = {r.id: r.question for r in library.queries()["e20_resolved_all"](spark, SF).collect()}
    assert got == {i: resolved(t) for i, t in texts.items()}


def test_chunks_of_both_kinds(spark):
    rows = library.queries()["h2_corpus_chunks_all"](spark, SF).collect()
    got = {(r.doc_id, r.chunk_no): r.content for r in rows}
    assert len(got) == len(rows)
    expected = {(2 * r.p_partkey, 0): r.text for r in corpus.row_text(spark.read.parquet(f"{SF}/part.parquet")).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        expected |= {(2 * r.doc_id + 1, i): c for i, c in enumerate(corpus.split_text(r.text))}
    assert got == expected and len({i for i, _ in got if i % 2}) > 100
