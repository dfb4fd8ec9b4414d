"""Filters that questions name: by place, preposition and mention, on whole questions and through the plan they lead to."""

import random

import pytest
from oracle import same

from sparkqa.operators import filters, linking
from sparkqa.operators.questions import STOP_WORDS
from sparkqa.plans.plan import Filter, Plan, run_plan
from sparkqa.queries import conversations

SALES = "Category string, Revenue double", [("Furniture", 10.0), ("Furniture", 20.0), ("Technology", 100.0), ("Office Supplies", 50.0)]
METALS = "commodity_name string, risk_rating string", [("Aluminium cash-settlement (LME)", "High"), ("Copper cash-settlement (LME)", "Medium"), ("Aluminium cash-settlement (LME)", "Medium")]
REGIONS = "Region string, Revenue double", [("North", 275000.0), ("South", 50000.0), ("North", 330000.0), ("West", 10000.0)]
STAFF = "Department string, Salary double", [("Finance", 120000.0), ("Finance", 80000.0), ("Engineering", 150000.0)]
SHIPS = "`Ship Mode` string, Amount double", [("First Class", 10.0), ("Second Class", 90.0), ("First Class", 15.0)]
DEALS = "region string, status string, amount double", [("EMEA", "Open", 10.0), ("APAC", "Closed", 20.0), ("EMEA", "Open", 30.0), ("AMER", "Open", 40.0)]
GOODS = "`Product Category` string, `Net Sales` double", [("Widgets", 5.0), ("Gadgets", 50.0), ("Widgets", 7.0)]

CASES = [
    (STAFF, "What is the sum of salary where department is Finance", "sum", "Salary", {"Department": "Finance"}, 200000.0),
    (SALES, "Sum of revenue of furniture category is", "sum", "Revenue", {"Category": "Furniture"}, 30.0),
    (METALS, "Give me the count of rows where risk rating is medium for Almunium case settlement", "count", None, {"risk_rating": "Medium", "commodity_name": "Aluminium cash-settlement (LME)"}, 1.0),
    (METALS, "Give me the count of rows where risk rating is High for Almunium case settlement", "count", None, {"risk_rating": "High", "commodity_name": "Aluminium cash-settlement (LME)"}, 1.0),
    (REGIONS, "What is the total revenue for the North region?", "sum", "Revenue", {"Region": "North"}, 605000.0),
    (STAFF, "Average salary of the finance department", "avg", "Salary", {"Department": "Finance"}, 100000.0),
    (SHIPS, "Sum of amount for ship mode first class", "sum", "Amount", {"Ship Mode": "First Class"}, 25.0),
    (DEALS, "Give me the count of rows where status is Open for EMEA", "count", None, {"status": "Open", "region": "EMEA"}, 2.0),
    (GOODS, "Sum of net sales of widgets category", "sum", "Net Sales", {"Product Category": "Widgets"}, 12.0),
    (SALES, "What is the sum of revenue", "sum", "Revenue", {}, 180.0),
    (SALES, "Sum of revenue of office supplies", "sum", "Revenue", {"Category": "Office Supplies"}, 50.0),
]


def known(spark, table):
    schema, rows = table
    frame = spark.createDataFrame(rows, schema)
    texts = [c for c, kind in frame.dtypes if kind == "string"]
    columns = spark.createDataFrame([(c, c in texts) for c in frame.columns], "column string, dimension boolean")
    return frame, linking.value_dictionary(frame, texts), columns


def resolved(spark, table, *questions):
    _, dictionary, columns = known(spark, table)
    frame = spark.createDataFrame([(i, q) for i, q in enumerate(questions)], "id int, question string")
    return {r.id: r for r in filters.resolve_filters(frame, dictionary, columns).collect()}


@pytest.mark.parametrize("table, question, operation, target, want, value", CASES)
def test_questions_lead_to_their_rows(spark, table, question, operation, target, want, value):
    """The values are found and nothing is left over; the plan with these filters gives the expected figure."""
    got = resolved(spark, table, question)[0]
    assert {f.column: f.value for f in got.filters} == want and got.leftover == []
    frame, _, _ = known(spark, table)
    plan = Plan(operation, target=target, filters=tuple(Filter(f.column, "eq", f.value) for f in got.filters))
    answer = run_plan(frame, plan).first()
    assert float(answer[0]) == value


def test_unknown_subset_is_left_over(spark):
    got = resolved(spark, SALES, "Sum of revenue of xyzzy", "Sum of revenue", None, "", "?!")
    assert got[0].filters == [] and got[0].leftover == ["xyzzy"]
    assert all(got[i].filters == [] and got[i].leftover == [] for i in (1, 2, 3, 4))


def test_forms_and_order(spark):
    table = "Region string, City string, `Sales Person` string", [("North", "Bath", "Ann"), ("South", "South", "Cid"), ("East", "Bristol", "Bob Lee")]
    got = resolved(
        spark, table, "revenue of region North", "revenue of the North of region", "rows for South", "rows where region equals the South and city is Bath", "rows with person bob lee in bristol",
        "rows for city Bath with region East", "rows South", "rows Bath Ann East", "rows where region is South South", "North North North region city",
    )
    told = {i: [(f.column, f.value, f.form) for f in r.filters] for i, r in got.items()}
    assert told[0] == [("Region", "North", "bound")]
    assert told[1] == [("Region", "North", "bound")]
    assert told[2] == []  # two columns have it
    assert sorted(told[3]) == [("City", "Bath", "bound"), ("Region", "South", "bound")]
    assert sorted(told[4]) == [("City", "Bristol", "in"), ("Sales Person", "Bob Lee", "bound")]
    assert sorted(told[5]) == [("City", "Bath", "bound"), ("Region", "East", "bound")]
    assert told[6] == []
    assert sorted(told[7]) == [("City", "Bath", "mention"), ("Region", "East", "mention"), ("Sales Person", "Ann", "mention")]
    assert [c for c, _, _ in told[8]].count("Region") == 1
    assert ("Region", "North", "bound") in told[9] and len({c for c, _, _ in told[9]}) == len(told[9])


def plain(question, columns, values):
    """The rules in plain Python, with exact values only. columns: names in normal form; values: {column: [values]}."""
    tokens, used, consumed, out = question.split(), [], set(), []
    owners = {}
    for c in columns:
        for t in set(c.split()):
            owners.setdefault(t, []).append(c)
    aliases = [(c, c) for c in columns] + [(t, o[0]) for t, o in owners.items() if len(o) == 1 and len(t) >= 3 and t not in filters.WEAK_WORDS and t != o[0]]
    for alias, column in sorted(aliases, key=lambda a: (-len(a[0]), a[0] != a[1], a[1])):
        words = alias.split()
        at = next((i for i in range(len(tokens)) if tokens[i : i + len(words)] == words), None)
        if column in used or at is None:
            continue
        before, after = tokens[:at], tokens[at + len(words) :]
        while before and before[-1] in ("of", "the"):
            before.pop()
        if after and after[0] in ("of", "is", "equals", "equal"):
            after = after[2:] if after[1:2] == ["the"] else after[1:]
        found = [" ".join(c) for n in range(1, 5) for c in (before[-n:] if len(before) >= n else [], after[:n] if len(after) >= n else []) if set(c) - set(STOP_WORDS)]
        found = [p for p in found if p in values[column]]
        if found:
            out.append((column, found[0], "bound"))
            used.append(column)
            consumed |= set(found[0].split()) | set(words)
    for p in ("for", "in"):
        if p not in tokens:
            continue
        rest = tokens[tokens.index(p) + 1 :]
        rest = rest[1:] if len(rest) > 1 and rest[0] == "the" else rest
        whole = " ".join(rest[: next((i for i, t in enumerate(rest) if t in ("and", "with")), len(rest))])
        cut = next((whole[len(c) + 1 :] for c in sorted(columns, key=lambda c: -len(c)) if whole.startswith(c + " ")), whole)
        for phrase in dict.fromkeys((cut, whole)):
            hits = [c for c in columns if c not in used and phrase in values[c]]
            if len(hits) == 1:
                out.append((hits[0], phrase, p))
                used.append(hits[0])
                consumed |= set(whole.split())
                break
    kept = [t for t in tokens if t not in STOP_WORDS]
    for n in range(4, 0, -1):
        for i in range(len(kept) - n + 1):
            phrase = " ".join(kept[i : i + n])
            hits = [c for c in columns if c not in used and phrase in values[c]]
            if phrase in {w for c in columns for w in [c, *c.split()]} or not set(phrase.split()) - consumed or len(hits) != 1:
                continue
            out.append((hits[0], phrase, "mention"))
            used.append(hits[0])
            consumed |= set(phrase.split())
    return out


def test_against_plain_rules(spark):
    """Random questions over values that are far from each other, so that only exact ones link."""
    rng = random.Random(4)
    columns = {"zone": ["qqqq", "wwww vvvv"], "shop kind": ["hhhh", "jjjj kkkk", "llll"], "shop owner": ["bbbb", "dddd"]}
    pieces = [*columns, "kind", "owner", "of", "the", "is", "for", "in", "and", "with", "rows", *[v for c in columns.values() for v in c]]
    asked = sorted({" ".join(rng.choice(pieces) for _ in range(rng.randint(1, 8))) for _ in range(600)})
    dictionary = spark.createDataFrame([(c, v, v) for c, values in columns.items() for v in values], "column string, norm string, value string")
    names = spark.createDataFrame([(c, True) for c in columns], "column string, dimension boolean")
    frame = spark.createDataFrame([(q,) for q in asked], "question string")
    exact = filters.resolve_filters(frame, dictionary, names).collect()
    bad = [(r.question, [(f.column, f.value, f.form) for f in r.filters], plain(r.question, list(columns), columns)) for r in exact if all(f.score == 1.0 for f in r.filters)]
    bad = [(q, g, w) for q, g, w in bad if g != w]
    assert not bad, (len(bad), bad[:3])
    assert sum(all(f.score == 1.0 for f in r.filters) and len(r.filters) > 0 for r in exact) > 100


def test_query_against_sql(spark):
    same(conversations.g5_resolved_filters(spark, "/root/testdata/sf0.01"), conversations.SQL["g5_resolved_filters"], "/root/testdata/sf0.01")


def test_leftover_is_told_once_a_question(spark):
    """The rows themselves meet only what was told of their distinct questions: a join, no work on their texts."""
    rows = spark.createDataFrame([(i, "Sum of total price of xyzzy" if i % 2 else None) for i in range(6)], "id int, question string")
    columns = spark.createDataFrame([("Region", True), ("Total Price", False)], "column string, dimension boolean")
    dictionary = spark.createDataFrame([("Region", "ASIA", "asia")], "column string, value string, norm string")
    out = filters.resolve_filters(rows, dictionary, columns)
    assert sorted((r.id, r.leftover) for r in out.collect()) == [(i, ["xyzzy"] if i % 2 else []) for i in range(6)]
    assert "rlike" not in out._jdf.queryExecution().optimizedPlan().toString().split("Join")[0].lower()
