"""Filling budgets, runs and pruned parameters against plain versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from emberlog.operators import reduce
from emberlog.plans.views import events


def plain_fill(rows, capacity):
    left, out = capacity, []
    for rank, cost in sorted(rows):
        if 1 <= cost <= left:
            left -= cost
            out.append(rank)
    return out


def budgets():
    rng = random.Random(5)
    yield "mixed", [((rng.randrange(4), f"t{i:05d}"), rng.choice([1, 7, 7, 50, 300, 1200, 0, -3])) for i in range(900)], 2000
    yield "stairs", [((0, f"t{i:05d}"), c) for i, c in enumerate(x for n in range(60, 1, -1) for x in (1, n * 3))], 100
    yield "equal", [((1, f"t{i:05d}"), 3) for i in range(3000)], 1000
    yield "all fit", [((i % 3, f"t{i:05d}"), 2) for i in range(50)], 1000
    yield "none fit", [((0, f"t{i:05d}"), 500) for i in range(20)], 499
    yield "large first", [((0, "a"), 900), ((0, "b"), 200), ((0, "c"), 100), ((0, "d"), 1), ((0, "e"), 100)], 1000
    yield "empty", [], 10


@pytest.mark.parametrize(("name", "rows", "capacity"), list(budgets()), ids=[b[0] for b in budgets()])
@pytest.mark.parametrize("chunk", [5, 4096])
def test_greedy_fill(spark, name, rows, capacity, chunk):
    df = spark.createDataFrame([(a, b, c) for (a, b), c in rows], "a int, b string, c int").repartition(3)
    got = reduce.greedy_fill(df, [F.col("a"), F.col("b")], F.col("c"), capacity, chunk=chunk).collect()
    assert sorted((r.a, r.b) for r in got) == plain_fill(rows, capacity)
    many = spark.createDataFrame([(k, a, b, c) for k in (1, 2) for (a, b), c in rows if k == 1 or c % 2], "k int, a int, b string, c int").repartition(3)
    got = reduce.greedy_fill(many, [F.col("a"), F.col("b")], F.col("c"), capacity, ["k"], chunk).collect()
    for k in (1, 2):
        assert sorted((r.a, r.b) for r in got if r.k == k) == plain_fill([r for r in rows if k == 1 or r[1] % 2], capacity)


def test_ten_million_equal_costs_meet_no_window(spark):
    rows = spark.range(10_000_000).select("id", F.lit(7).alias("c"))
    out = reduce.greedy_fill(rows, [F.col("id")], F.col("c"), 7_000)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and "Join" not in plan and "Exchange" not in plan
    assert out.agg(F.count("*"), F.max("id")).first() == (1000, 999)


def test_null_ranks_come_first(spark):
    df = spark.createDataFrame([(None, 6), ("a", 5), ("b", 4)], "r string, c int")
    assert {r.r for r in reduce.greedy_fill(df, [F.col("r")], F.col("c"), 10).collect()} == {None, "b"}


def pruned(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(reduce.pruned_params(F.col("t")).alias("p"))
    return [r.p for r in df.collect()]


def test_parameters_within_the_limit_stay_whole(spark):
    got = pruned(spark, ['{"a": 1, "b": {"c": [true, null]}}', "not json", "", None, '"text"', "[1, 2]", '{"é": "ü"}'])
    assert got == ['{"a":1,"b":{"c":[true,null]}}', '"not json"', None, None, '"text"', "[1,2]", '{"é":"ü"}']


def test_long_objects_keep_their_first_members_in_short(spark):
    value = {"z": "x" * 300, "name": "it's", "deep": {"k": ["it's", 'say "a"', True, None, {"n": -3}]}, "yes": True, "none": None, "n": 12, "text": "true", "list": [], "ninth": 1, "tenth": 2}
    (got,) = pruned(spark, [json.dumps(value)])
    shown = {k: str(v) if len(str(v)) <= 60 else str(v)[:57] + "..." for k, v in list(value.items())[:8]}
    assert json.loads(got) == shown and list(json.loads(got)) == list(shown)


@pytest.mark.parametrize("value", [["é" * 20, "😀", 'q"uote', {"a": "b,c:d"}] * 8, "long text with \"quotes\" and \\ and é " * 20, [[1, 2, {"k": None}]] * 40])
def test_other_long_values_keep_their_first_characters(spark, value):
    assert [json.loads(p) for p in pruned(spark, [json.dumps(value)])] == [json.dumps(value)[:260]]


def test_long_texts_that_are_no_json(spark):
    text = "no json: 'x' \"é\" \\ " * 30
    assert [json.loads(p) for p in pruned(spark, [text])] == [json.dumps(text)[:260]]


def odd_events(spark):
    """Events whose records cost little and much, early and late in rank."""
    e = events(spark, "/root/testdata/sf0.01", {"error": "StopLogging", "click": "ListUsers"})
    k = F.col("source_ip").cast("int")
    none = F.lit(None).cast("string")
    e = e.withColumn("request_params", F.when(k % 3 == 0, none).otherwise(F.concat(F.lit('{"k": "é'), F.repeat(F.lit("y"), k * 5), F.lit('"}'))))
    for name in ("region", "account", "source_ip", "user_agent", "mfa_authenticated", "event_time"):
        e = e.withColumn(name, F.when(k % 97 == 96, none).otherwise(F.col(name)))
    return e.withColumn("error_code", F.when(k % 7 == 1, '"\\é'))


def test_the_least_cost_is_no_more_than_the_cost(spark):
    both = reduce._priced(odd_events(spark)).select("request_params", "error_code", reduce.least_cost().alias("least"), "__chars")
    assert both.filter("least > __chars").count() == 0
    plain = both.filter("request_params IS NULL AND error_code IS NULL")
    assert plain.count() > 1000 and plain.filter("least <> __chars").count() == 0


@pytest.mark.parametrize("tokens", [0, 10, 40, 3_000, 40_000])
def test_few_records_are_written_to_fill_a_budget(spark, monkeypatch, tokens):
    e, sizes, priced = odd_events(spark), [], reduce._priced
    monkeypatch.setattr(reduce, "_priced", lambda rows: sizes.append(rows.count()) or priced(rows))
    got = sorted(r.row_id for r in reduce.fit_budget(e, tokens).collect())
    every = priced(e).select(reduce.signal_rank(F.col("event_name")), F.coalesce("event_time", F.lit("")), "row_id", "__chars").collect()
    assert got == sorted(r[2] for r in plain_fill([(tuple(r[:3]), r[3]) for r in every], int(tokens * 3.5)))
    assert sum(sizes) <= len(every) // 3
