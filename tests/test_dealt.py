"""Queries whose rows are much work are dealt over all cores, and what that work is."""

import json

from pyspark.sql import functions as F

import __spark_entry__
from emberlog.operators import correlate, lineage, reduce

SMALL = "/root/testdata/sf0.001"


def test_slim_records_are_made_on_all_cores(spark):
    assert __spark_entry__.queries()["slim_records"](spark, SMALL).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_lengths_of_odd_texts(spark):
    values = ["", "a,b:c", 'q"\\,:\\"', "é,ü:", "😀", {"a,:": [1, {"b": "\\"}], "é😀": "x\n,"}, [], {}, [None, True, 1.5, " "], "y" * 9000 + ",", {"k": ["v" * 300] * 3}]
    df = spark.createDataFrame([(json.dumps(v, ensure_ascii=False, separators=(",", ":")), len(json.dumps(v))) for v in values], "t string, n int")
    assert df.filter(reduce.dumps_length(F.col("t")) != F.col("n")).count() == 0


def test_steps_are_scored_on_all_cores(spark):
    scored = __spark_entry__.queries()["score_steps"](spark, SMALL)
    assert scored.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_tools_that_need_no_sessions_make_none(spark, monkeypatch):
    made = []
    monkeypatch.setattr(correlate, "stored", lambda df, name: made.append(name) or df)
    assert __spark_entry__.queries()["tool_blind_spot"](spark, SMALL).count() == 200 and not made


def test_most_keys_wait_for_the_chains_they_hang_on(spark, monkeypatch):
    """Only keys that others were minted under take part in the rounds."""
    sizes = []
    whole = lineage._jumped
    monkeypatch.setattr(lineage, "_jumped", lambda known: sizes.append(known.count()) or whole(known))
    edges = [(f"k{i}", f"k{i // 10}" if i >= 10 else None) for i in range(1000)] + [("x", "x"), ("y", "x"), ("z", "gone"), ("e", "")]
    got = {r.key: (r.root, r.depth, r.in_cycle) for r in lineage.closure(spark.createDataFrame(edges, "key string, parent string")).collect()}
    assert sizes and sizes[0] < 60 and len(got) == len(edges)
    assert got["x"] == got["y"] == (None, None, True) and got["z"] == ("gone", 1, False) and got["e"] == ("e", 0, False)
    assert all(got[f"k{i}"] == (f"k{str(i)[0]}", len(str(i)) - 1, False) for i in range(1000))
