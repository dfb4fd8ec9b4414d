"""Streams of several micro-batches: late rows, closed days, conversations dropped by timeout and begun anew."""

from datetime import datetime, timedelta

import pytest
from oracle import same

from sparkqa.operators import conversation
from sparkqa.queries import conversations, logs as log_queries
from sparkqa.streaming import logs

START = datetime(2024, 1, 1)


class Feed:
    """A folder of Parquet files that a stream reads, one run to its end after each delivery."""

    def __init__(self, spark, tmp_path, schema, make):
        self.spark, self.root, self.schema, self.make, self.dropped = spark, str(tmp_path), schema, make, []

    def deliver(self, rows):
        self.spark.createDataFrame(rows, self.schema).repartition(2).write.mode("append").parquet(f"{self.root}/feed")
        stream = self.spark.readStream.schema(self.schema).parquet(f"{self.root}/feed")
        self.dropped.append(logs.run_to_end(self.make(stream), f"{self.root}/out", f"{self.root}/state"))
        return sorted(map(tuple, self.spark.read.parquet(f"{self.root}/out").collect()), key=repr)


def test_late_rows_of_the_log(spark, tmp_path):
    """Expected by hand: rows behind the watermark are dropped and counted, repeats count once, days come when closed."""
    feed = Feed(spark, tmp_path, "id long, ts timestamp, value double, status string", lambda s: logs.closed_days(s, "id", late="1 day"))
    at = lambda day, hour=12: START + timedelta(days=day, hours=hour)
    assert feed.deliver([(1, at(0), 2.0, "SUCCESS"), (2, at(0, 13), 4.0, "FAILED"), (2, at(0, 13), 4.0, "FAILED"), (3, at(1), 6.0, "SUCCESS")]) == []
    # the watermark is at 12 of day 0: a row of 11 that day is late, one of 13 is not
    assert feed.deliver([(4, at(0, 11), 100.0, "SUCCESS"), (5, at(0, 14), 6.0, "SUCCESS"), (6, at(2, 1), 1.0, "FAILED")]) == [("2024-01-01", 3, 1, 4.0)]
    # now at 1 of day 1
    assert feed.deliver([(7, at(0, 23), 100.0, "FAILED"), (8, at(1, 0), 100.0, "FAILED"), (9, at(1, 2), 8.0, "SUCCESS"), (10, at(9), 1.0, "SUCCESS")]) == [("2024-01-01", 3, 1, 4.0), ("2024-01-02", 2, 0, 7.0), ("2024-01-03", 1, 1, 1.0)]
    assert feed.dropped == [0, 1, 2]


TURNS = "conv_id long, turn long, text string, ts timestamp"


def minute(m):
    return START + timedelta(minutes=m)


def short(rows):
    return [(r[0], r[1], r[2], r[3]) for r in rows]  # conversation, turn, question, metric


def test_conversation_dropped_by_timeout_comes_back_fresh(spark, tmp_path):
    make = lambda s: conversation.clarify_events(s, late="10 minutes", idle=timedelta(minutes=60))
    feed = Feed(spark, tmp_path, TURNS, make)
    # the second turn waits until the watermark passes it
    assert short(feed.deliver([(1, 1, "What was the revenue in 2023?", minute(0)), (2, 1, "What was the profit in 2020?", minute(9))])) == []
    got = short(feed.deliver([(2, 2, "And in 2021?", minute(30))]))
    assert got == [(1, 1, "What was the revenue in 2023?", "revenue"), (2, 1, "What was the profit in 2020?", "profit")]
    # conversation 1 is silent for over an hour and is dropped while conversation 2 goes on
    feed.deliver([(2, 3, "And in 2022?", minute(85))])
    states = spark.read.format("statestore").load(f"{tmp_path}/state")
    assert {r.key.conv_id for r in states.collect()} == {2}
    feed.deliver([(1, 2, "And growth in 2024?", minute(90)), (9, 1, "x", minute(300))])
    got = {(c, t): (q, m) for c, t, q, m in short(feed.deliver([(9, 2, "y", minute(320))]))}
    assert got[2, 2][1] == "profit" and got[2, 3][1] == "profit"
    assert got[1, 2][1] == "" and "revenue" not in got[1, 2][0]  # nothing is carried over
    assert feed.dropped == [0] * 5


def test_late_turns_and_order_across_batches(spark, tmp_path):
    feed = Feed(spark, tmp_path, TURNS, lambda s: conversation.clarify_events(s, late="10 minutes", idle=timedelta(minutes=60)))
    feed.deliver([(1, 2, "And growth in 2024?", minute(5)), (3, 1, "z", minute(8))])
    # an earlier turn of the same conversation, in time: it takes its place before the one that waits
    feed.deliver([(1, 1, "What was the revenue in 2023?", minute(2)), (3, 2, "z", minute(40))])
    got = {(c, t): (q, m) for c, t, q, m in short(feed.deliver([(1, 3, "late", minute(29)), (3, 3, "z", minute(41))]))}
    assert got[1, 1][1] == got[1, 2][1] == "revenue" and (1, 3) not in got
    assert feed.dropped == [0, 0, 1]


def test_turns_without_conversation_stand_alone(spark, tmp_path):
    rows = [(None, 1, "What was the revenue in 2023?", minute(0)), (None, 2, "And growth in 2024?", minute(1))]
    frame = spark.createDataFrame(rows, TURNS)
    assert sorted((r.turn, r.metric) for r in conversation.clarify(frame).collect()) == [(1, "revenue"), (2, "")]
    feed = Feed(spark, tmp_path, TURNS, lambda s: conversation.clarify_events(s, late="1 minute"))
    feed.deliver(rows)
    assert sorted((r[1], r[3]) for r in feed.deliver([(5, 1, "x", minute(99))])) == [(1, "revenue"), (2, "")]


def test_events_equal_batch(spark):
    """All but the newest turns, which wait, come out as from the batch by time."""
    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, conversations.j5_clarify_events(spark, sf).collect()), key=repr)
    rows = conversations.asked(spark, sf).join(spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey AS id", "CAST(o_orderdate AS TIMESTAMP) AS ts"), "id")
    newest = rows.agg({"ts": "max"}).first()[0]
    turns = {r.turn for r in rows.where(rows.ts <= newest - timedelta(days=30)).collect()}
    every = conversation.clarify(rows, time="ts", idle=conversations.IDLE)
    want = sorted((tuple(r) for r in every.collect() if r.turn in turns), key=repr)
    assert got == want and len(got) > 1000


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, sf):
    same(log_queries.j4_closed_days(spark, f"/root/testdata/{sf}"), log_queries.SQL["j4_closed_days"], f"/root/testdata/{sf}")


@pytest.mark.parametrize("make", [lambda s: conversation.clarify_stream(s, idle=None), lambda s: conversation.clarify_events(s)], ids=["stream", "events"])
def test_groups_are_fed_few_columns(spark, tmp_path, make):
    """Each column of a conversation's group costs about as much as all its turns, so turns come packed."""
    spark.createDataFrame([], TURNS).write.parquet(f"{tmp_path}/feed")
    plan = make(spark.readStream.schema(TURNS).parquet(f"{tmp_path}/feed"))._jdf.queryExecution().analyzed()
    while plan.nodeName() != "FlatMapGroupsInPandasWithState":
        plan = plan.children().apply(0)
    assert plan.children().apply(0).output().size() <= 3 and plan.output().size() == 2


def test_packed_turns_equal_batch_on_odd_texts(spark, tmp_path):
    texts = ['a "quoted" \\ question?', "Größe \U0001f600 growth?", "", None, "line\none", "\u0001 revenue 2020", "x" * 100_000 + " growth", "{plain} growth in 2021?"]
    frame = spark.createDataFrame([(i % 2, i, t, minute(i)) for i, t in enumerate(texts)], TURNS)
    frame.write.parquet(f"{tmp_path}/feed")
    stream = conversation.clarify_stream(spark.readStream.schema(TURNS).parquet(f"{tmp_path}/feed"), idle=None)
    logs.run_to_end(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == sorted(map(tuple, conversation.clarify(frame).collect())) and len(got) == len(texts)


@pytest.mark.parametrize("kind", ["long", "string", "date"])
def test_grouped_conversations_equal_batch(spark, tmp_path, kind):
    """Conversations that share a call and a state: each keeps its own, whatever arrives when; ids beyond 2^53 and none."""
    texts = ["What was the revenue in 2023?", "And growth in 2024?", "What was the growth?", "profit growth", "", "And in 2021?"]
    ids = {"long": lambda i: 2**53 + i, "string": lambda i: f"c{i}", "date": lambda i: (START + timedelta(days=i)).date()}[kind]
    rows = [(None if i % 7 == 0 else ids(i % 11), i, texts[i * i % 6], minute(i * 37 % 400)) for i in range(300)]
    schema = TURNS.replace("conv_id long", f"conv_id {kind}")
    feed = Feed(spark, tmp_path, schema, lambda s: conversation.clarify_events(s, late="20 minutes", idle=timedelta(minutes=45), groups=3))
    for first in (0, 100, 200, 300):  # deliveries in the order of time, none of them late
        part = [r for r in rows if minute(first) <= r[3] < minute(first + 100)]
        feed.deliver(part[::-1])
    got = feed.deliver([(ids(99), 999, "x", minute(430))])
    want = conversation.clarify(spark.createDataFrame(rows, schema), time="ts", idle=timedelta(minutes=45))
    assert got == sorted(map(tuple, want.collect()), key=repr) and len(got) == 300 and feed.dropped == [0] * 5


def test_states_go_with_groups_and_not_with_conversations(spark, tmp_path):
    """A call of Python costs some milliseconds, so 200 conversations must not need 200 of them; those over are forgotten."""
    feed = Feed(spark, tmp_path, TURNS, lambda s: conversation.clarify_events(s, late="10 minutes", idle=timedelta(minutes=60), groups=4))
    assert feed.deliver([(i, 1, "What was the revenue in 2023?", minute(i % 5)) for i in range(200)]) == []
    states = spark.read.format("statestore").load(f"{tmp_path}/state")
    held = states.selectExpr("key._group AS g", "value.groupState.ids AS ids").collect()
    assert 1 <= len(held) <= 4 and sorted(i for r in held for i in r.ids) == list(range(200))
    assert len(feed.deliver([(i, 2, "And in 2024?", minute(50)) for i in range(100)])) == 200
    feed.deliver([(500, 1, "x", minute(90))])  # the watermark is at 80: those without a second turn are over
    held = spark.read.format("statestore").load(f"{tmp_path}/state").selectExpr("value.groupState.ids AS ids").collect()
    assert sorted(i for r in held for i in r.ids) == [*range(100), 500]
    assert {r[3] for r in spark.read.parquet(f"{tmp_path}/out").where("turn = 2").selectExpr("conv_id", "turn", "resolved", "metric").collect()} == {"revenue"}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_grouped_stream_equals_batch(spark, tmp_path, kind):
    """The same without time: turns in the order of their numbers over three deliveries."""
    texts = ["What was the revenue in 2023?", "And growth in 2024?", "What was the growth?", "profit growth", "", "And in 2021?"]
    ids = (lambda i: 2**53 + i) if kind == "long" else (lambda i: f"c{i}")
    rows = [(None if i % 7 == 0 else ids(i % 11), i, texts[i * i % 6], minute(i)) for i in range(300)]
    schema = TURNS.replace("conv_id long", f"conv_id {kind}")
    feed = Feed(spark, tmp_path, schema, lambda s: conversation.clarify_stream(s, idle=None, groups=3))
    for first in (0, 100, 200):
        got = feed.deliver(rows[first : first + 100][::-1])
    assert got == sorted(map(tuple, conversation.clarify(spark.createDataFrame(rows, schema)).collect()), key=repr) and len(got) == 300
    held = spark.read.format("statestore").load(f"{tmp_path}/state").selectExpr("value.groupState.ids AS ids").collect()
    assert len(held) <= 3 and sorted(i for r in held for i in r.ids) == sorted(map(ids, range(11)))
    with pytest.raises(ValueError, match="idle"):
        conversation.clarify_stream(spark.createDataFrame(rows, schema), groups=3)
