"""Sketches, hash trees, tools, minted keys and values as of a time against plain versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from emberlog.operators import lineage, merkle, profiles, tools


def test_an_actor_with_very_many_addresses_is_no_long_row(spark):
    e = spark.range(60_000).select(F.struct(F.lit("svc").alias("arn"), F.lit(None).cast("string").alias("user_name"), F.lit(None).cast("string").alias("principal_id")).alias("actor"), F.lit("1").alias("account"), F.lit(None).cast("string").alias("region"), F.col("id").cast("string").alias("source_ip"))
    values = profiles.actor_values(e)
    assert values.count() == 60_001
    got = {r.dimension: r for r in profiles.bounded_lists(values).collect()}
    assert got["source_ip"].n == 60_000 and len(got["source_ip"]["values"]) == profiles.LISTED and got["source_ip"]["values"][:3] == ["0", "1", "10"] and "region" not in got
    days = profiles.sketches(e, (F.col("source_ip").cast("int") % 7).alias("day"))
    (row,) = profiles.merged(days).collect()
    assert row.events == 60_000 and abs(row.source_ip_count - 60_000) < 3000 and row.account_count == 1 and row.region_count == 0


@pytest.mark.parametrize("n", [0, 1, 5, 16, 17, 300])
def test_tree_has_one_root_and_names_changed_blocks(spark, n):
    rows = spark.range(n).select("id", F.concat(F.lit("row "), F.col("id").cast("string")).alias("t"))
    before = merkle.tree(rows, ["id"], ["id", "t"], block=4, fanout=3)
    top = before.orderBy(F.desc("level")).limit(1).collect()
    assert [(r.node, r.n) for r in top] == ([(0, n)] if n else [])
    assert merkle.changes(before, merkle.tree(rows.repartition(5), ["id"], ["id", "t"], block=4, fanout=3), fanout=3).collect() == []
    edited = rows.withColumn("t", F.when(F.col("id").isin(2, 3, 290), "x").otherwise(F.col("t")))
    changed = {(r.node, r.state) for r in merkle.changes(before, merkle.tree(edited, ["id"], ["id", "t"], block=4, fanout=3), fanout=3).collect()}
    assert changed == {(i // 4, "MODIFIED") for i in (2, 3, 290) if i < n}


def test_tree_of_fewer_rows_misses_blocks(spark):
    full, part = (merkle.tree(spark.range(n).select("id"), ["id"], ["id"], block=4, fanout=3) for n in (40, 30))
    assert {(r.node, r.state) for r in merkle.changes(full, part, fanout=3).collect()} == {(7, "MODIFIED"), (8, "MISSING"), (9, "MISSING")}
    assert {r.state for r in merkle.changes(part, full, fanout=3).collect()} == {"MODIFIED", "ADDED"}


def plain_closure(edges):
    parent, out = dict(edges), {}
    for key in parent:
        at, depth, seen = key, 0, set()
        while at in parent and parent[at] not in (None, "") and at not in seen:
            seen.add(at)
            at, depth = parent[at], depth + 1
        out[key] = (None, None, True) if at in seen else (at, depth, False)
    return out


def test_closure_of_chains_trees_and_cycles(spark):
    rng = random.Random(2)
    edges = [(f"c{i}", f"c{i + 1}") for i in range(70)] + [(f"t{i}", f"t{rng.randrange(i)}" if i else None) for i in range(60)]
    edges += [("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("self", "self"), ("lone", None), ("blank", ""), ("orphan", "gone")]
    got = {r.key: (r.root, r.depth, r.in_cycle) for r in lineage.closure(spark.createDataFrame(edges, "key string, parent string")).collect()}
    assert got == plain_closure(edges)


def test_closure_of_nothing(spark):
    assert lineage.closure(spark.createDataFrame([], "key string, parent string")).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_as_of(spark, seed):
    rng = random.Random(seed)
    stamp = lambda: f"2026-01-{rng.randrange(1, 9):02d} {rng.randrange(3):02d}:00:{rng.randrange(4):02d}"
    left = [(i, rng.choice("abc"), stamp()) for i in range(80)] + [(900, None, stamp()), (901, "a", None)]
    right = [(i, rng.choice("abd"), stamp()) for i in range(30)] + [(990, None, stamp()), (991, "a", None)]
    e = spark.createDataFrame(left, "i int, k string, t string").withColumn("t", F.to_timestamp("t"))
    s = spark.createDataFrame(right, "j int, k string, at string").withColumn("at", F.to_timestamp("at"))
    got = {r.i: r.j for r in lineage.as_of(e, s, ["k"], "t", "at", order="j").select("i", "snapshot.j").collect()}
    want = {i: max(((at, j) for j, key, at in right if key == k and at and at <= t), default=(None, None))[1] if k and t else None for i, k, t in left}
    assert got == want


@pytest.fixture(scope="module")
def toolbox(spark):
    who = F.struct(F.lit("User").alias("type"), F.concat(F.lit("arn:aws:iam::1:user/u"), (F.col("id") % 3).cast("string")).alias("arn"), F.lit(None).cast("string").alias("user_name"))
    none = F.lit(None).cast("string")
    e = spark.range(200).select(F.col("id").cast("string").alias("row_id"), F.format_string("2026-01-01T00:%02d:%02dZ", F.floor(F.col("id") / 60), F.col("id") % 60).alias("event_time"), F.lit("ListUsers").alias("event_name"), who.alias("actor"), F.lit("1.2.3.4").alias("source_ip"), F.lit("1").alias("account"), none.alias("region"), none.alias("error_code"), none.alias("mfa_authenticated"))
    sessions = spark.createDataFrame([("ASIA1234xyz", "me", "t", 1, [{"event": "GetObject"}], ["GetObject"])], "key string, assumed_by string, assumed_at string, action_count bigint, actions array<struct<event:string>>, notable array<string>")
    policies = spark.createDataFrame([("1", "user", "ann", "attached", "Admin"), ("1", "user", "ann", "group", "devs"), ("1", "role", "r", "inline", "x")], "account string, kind string, name string, source string, policy string")
    feed = spark.createDataFrame([("bad.example", 90, "G1", "c2", "f")], "value string, confidence int, group_id string, category string, feed string")
    from emberlog.plans.registry import _steps

    tools.register(spark, e, sessions, policies, feed, _steps(spark, "/root/testdata/sf0.001"))
    return spark


def test_tools_from_sql(toolbox):
    sql = lambda q: toolbox.sql(q).collect()
    assert len(sql("SELECT * FROM query_events(NULL, NULL, NULL, NULL)")) == 50
    assert len(sql("SELECT * FROM query_events(array('ListUsers'), 'u1', '2026-01-01T00:01:00Z', '2026-01-01T00:01:30Z')")) == 10
    assert sql("SELECT * FROM query_events(array('Other'), '', '', '')") == []
    line = sql("SELECT * FROM get_actor_timeline('u2')")
    assert len(line) == 60 and line[0].event_count == 66 and [r.event_time for r in line] == sorted(r.event_time for r in line)
    assert sql("SELECT * FROM get_actor_timeline('')") == []
    assert sql("SELECT assumed_by, actions FROM get_session_detail('ASIA1234...')") == [("me", ["GetObject"])]
    assert sql("SELECT * FROM check_principal_permissions('arn:aws:iam::1:user/ann')") == [("user", "ann", ["Admin"], [], ["devs"])]
    assert sql("SELECT inline FROM check_principal_permissions('arn:aws:sts::1:assumed-role/r/s')") == [(["x"],)]
    assert sql("SELECT matched, confidence FROM lookup_indicator('BAD.example')") == [(True, 90)]
    assert sql("SELECT matched FROM lookup_indicator('good.example')") == [(False,)]


def test_calls_by_name(toolbox):
    (ok,) = tools.call(toolbox, "query_events", {"event_names": ["ListUsers"], "actor_contains": "u1"}).collect()
    assert ok.n == 50 and ok.error is None and len(ok.result) <= tools.RESULT_LIMIT and json.loads(tools.call(toolbox, "lookup_indicator", {"indicator": "bad.example"}).first().result)[0]["confidence"] == 90
    assert tools.call(toolbox, "rm", {}).first().error == "unknown tool rm"
    assert tools.call(toolbox, "query_events", {"x": 1}).first().error == "unknown argument x"
    assert tools.call(toolbox, "get_session_detail", {"session_key": "it's \\ no"}).first().error == "session not found"
    assert tools.call(toolbox, "check_principal_permissions", {"principal_arn": "arn:aws:iam::9:user/ann"}).first().error == "principal not in scope"
