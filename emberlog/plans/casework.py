"""Queries over the driver's tables: values and sketches of actors, hash trees, tools, minted keys, values as of a time; and the SQL of each."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from emberlog import rules
from emberlog.functions.shared import shared_dir
from emberlog.operators import correlate, hunt, lineage, merkle, package, profiles, reduce, timeline, tools
from emberlog.plans.evidence import _MISSING, _missing_feeds
from emberlog.plans.registry import _GAPS, _PATTERNS, NAMES, _gaps, _scores_sql, _steps, joined, query
from emberlog.plans.views import EVENTS_SQL, events, order_sessions, table

# --- what actors touched --------------------------------------------------------------------------------------------------------

_VALUES = """
av AS (SELECT actor, dimension, value, count(*) AS events FROM (SELECT actor, 'account' AS dimension, account AS value FROM e UNION ALL SELECT actor, 'region', region FROM e UNION ALL SELECT actor, 'source_ip', source_ip FROM e) GROUP BY ALL)
"""


@query("actor_values", f"WITH {EVENTS_SQL}, {_VALUES} SELECT * FROM av")
def _(spark, sf_dir):
    return profiles.actor_values(events(spark, sf_dir))


@query(
    "actor_lists",
    f"WITH {EVENTS_SQL}, {_VALUES}, n AS (SELECT *, row_number() OVER (PARTITION BY actor, dimension ORDER BY value) AS i FROM av) SELECT actor, dimension, count(*) AS n, string_agg(value, ',' ORDER BY value) FILTER (i <= 3) AS values FROM n GROUP BY actor, dimension",
)
def _(spark, sf_dir):
    return profiles.bounded_lists(profiles.actor_values(events(spark, sf_dir)), listed=3).select("actor", "dimension", "n", *joined("values"))


@query("actor_sketches", f"WITH {EVENTS_SQL} SELECT actor, CAST(count(*) AS BIGINT) AS events, count(DISTINCT source_ip) AS source_ips, true AS near FROM e GROUP BY actor")
def _(spark, sf_dir):
    e = events(spark, sf_dir)
    found = profiles.merged(profiles.sketches(e, F.substring("event_time", 1, 10).alias("day")))
    exact = profiles.wide(profiles.bounded_lists(profiles.actor_values(e, ("source_ip",))), {"source_ip": ("listed", "source_ips")})
    near = F.abs(F.col("source_ip_count") - F.col("source_ips")) <= 0.05 * F.col("source_ips")
    return found.join(exact, "actor").select("actor", "events", "source_ips", near.alias("near"))


# --- hash trees -----------------------------------------------------------------------------------------------------------------

_LEVEL = """
l{k} AS (SELECT {k} AS level, node // 16 AS node, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(sha256, '' ORDER BY node)) AS sha256 FROM l{i} WHERE (SELECT count(*) FROM l{i}) > 1 GROUP BY node // 16)"""


def _tree_sql(name: str, text: str) -> str:
    levels = "".join("," + _LEVEL.format(i=i, k=i + 1) for i in range(6))
    union = " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(7))
    return f"""{name} AS (WITH r AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS place, sha256(concat_ws('|', CAST(doc_id AS VARCHAR), lang, source, {text})) AS digest FROM documents),
      l0 AS (SELECT 0 AS level, place // 16 AS node, count(*) AS n, sha256(string_agg(digest, '' ORDER BY place)) AS sha256 FROM r GROUP BY place // 16) {levels} {union})"""


def _tree(docs):
    return merkle.tree(docs, ["doc_id"], ["doc_id", "lang", "source", "text"], block=16)


@query("merkle_tree", f"WITH {_tree_sql('t', 'text')} SELECT level, node, n, sha256 FROM t")
def _(spark, sf_dir):
    return _tree(table(spark, sf_dir, "documents"))


@query(
    "merkle_changes",
    f"WITH {_tree_sql('a', 'text')}, {_tree_sql('b', 'CASE WHEN doc_id % 97 = 5 THEN upper(text) ELSE text END')} SELECT node, 'MODIFIED' AS state FROM a JOIN b USING (level, node) WHERE level = 0 AND a.sha256 <> b.sha256",
)
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    edited = docs.withColumn("text", F.when(F.col("doc_id") % 97 == 5, F.upper("text")).otherwise(F.col("text")))
    return merkle.changes(_tree(docs), _tree(edited))


# --- tools ----------------------------------------------------------------------------------------------------------------------


def _policies(spark, sf_dir):
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    source = F.when(k % 3 == 0, "attached").when(k % 3 == 1, "inline").otherwise("group")
    return s.select(F.lpad((k % 7).cast("string"), 12, "0").alias("account"), F.when(k % 2 == 0, "user").otherwise("role").alias("kind"), F.concat(F.lit("p"), (k % 5).cast("string")).alias("name"), source.alias("source"), F.concat(F.lit("policy"), (k % 40).cast("string")).alias("policy"))


def _with_tools(spark, sf_dir):
    feed = _missing_feeds(spark, sf_dir).withColumnRenamed("indicator", "value")
    tools.register(spark, events(spark, sf_dir), correlate.session_chains(order_sessions(spark, sf_dir), keep=False), _policies(spark, sf_dir), feed, _steps(spark, sf_dir))
    return spark


@query("tool_query_events", f"WITH {EVENTS_SQL} SELECT event_time, event_name, actor, account, CASE WHEN k % 2 = 0 THEN 'false' ELSE 'true' END AS mfa FROM e WHERE event_name IN ('error', 'signup') AND contains(actor, 'u1') AND event_time >= '2024-01-03' AND event_time <= '2024-01-20' ORDER BY event_time, row_id LIMIT 50")
def _(spark, sf_dir):
    return _with_tools(spark, sf_dir).sql("SELECT event_time, event_name, actor, account, mfa FROM query_events(array('error', 'signup'), 'u1', '2024-01-03', '2024-01-20')")


@query("tool_actor_timeline", f"WITH {EVENTS_SQL}, m AS (SELECT *, count(*) OVER () AS event_count FROM e WHERE contains(actor, 'user/u1')) SELECT event_count, event_time, event_name, actor, source_ip FROM m ORDER BY event_time, row_id LIMIT 60")
def _(spark, sf_dir):
    return _with_tools(spark, sf_dir).sql("SELECT event_count, event_time, event_name, actor, source_ip FROM get_actor_timeline('user/u1')")


@query(
    "tool_session_detail",
    "WITH o AS (SELECT o_orderkey, 'customer/' || o_custkey AS assumed_by FROM orders WHERE starts_with(printf('K%010d', o_orderkey), 'K0000000') ORDER BY o_orderkey LIMIT 1) SELECT printf('K%010d', o_orderkey) AS key, assumed_by, count(l_orderkey) AS action_count FROM o LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, assumed_by",
)
def _(spark, sf_dir):
    return _with_tools(spark, sf_dir).sql("SELECT key, assumed_by, action_count FROM get_session_detail('K0000000123')")


@query(
    "tool_permissions",
    """WITH p AS (SELECT s_suppkey % 3 AS m, 'policy' || (s_suppkey % 40) AS policy FROM supplier WHERE s_suppkey % 7 = 3 AND s_suppkey % 2 = 1 AND s_suppkey % 5 = 2)
    SELECT 'role' AS kind, 'p2' AS name, coalesce(string_agg(DISTINCT policy, ',' ORDER BY policy) FILTER (m = 0), '') AS attached, coalesce(string_agg(DISTINCT policy, ',' ORDER BY policy) FILTER (m = 1), '') AS inline, coalesce(string_agg(DISTINCT policy, ',' ORDER BY policy) FILTER (m = 2), '') AS groups FROM p HAVING count(*) > 0""",
)
def _(spark, sf_dir):
    return _with_tools(spark, sf_dir).sql("SELECT * FROM check_principal_permissions('arn:aws:sts::000000000003:assumed-role/p2/session')").select("kind", "name", *joined("attached", "inline", "groups"))


@query(
    "tool_indicator",
    f"WITH {_MISSING} SELECT count(*) > 0 AS matched, CAST(max(confidence) AS INTEGER) AS confidence, coalesce(string_agg(DISTINCT category, ',' ORDER BY category), '') AS categories, coalesce(string_agg(DISTINCT feed, ',' ORDER BY feed), '') AS feeds FROM fd WHERE value = '52.12.0.9'",
)
def _(spark, sf_dir):
    return _with_tools(spark, sf_dir).sql("SELECT matched, confidence, categories, feeds FROM lookup_indicator('52.12.0.9')").select("matched", "confidence", *joined("categories", "feeds"))


@query("tool_blind_spot", f"WITH {_scores_sql('(p_partkey % 3)')} SELECT step, score, priority FROM y")
def _(spark, sf_dir):
    return _with_tools(spark, sf_dir).sql("SELECT * FROM resolve_blind_spot(' SPOT 1')")


@query("tool_calls", "SELECT 'query_events' AS tool, least(count(*), 50) AS n, NULL::VARCHAR AS error FROM events WHERE event_type = 'error' UNION ALL SELECT 'drop_tables', 0, 'unknown tool drop_tables' UNION ALL SELECT 'get_session_detail', 0, 'session not found' UNION ALL SELECT 'query_events', 0, 'unknown argument limit'")
def _(spark, sf_dir):
    _with_tools(spark, sf_dir)
    made = [tools.call(spark, "query_events", {"event_names": ["error"]}), tools.call(spark, "drop_tables", {}), tools.call(spark, "get_session_detail", {"session_key": "it's not there"}), tools.call(spark, "query_events", {"limit": 3})]
    out = made[0]
    for m in made[1:]:
        out = out.union(m)
    return out.select("tool", "n", "error")


# --- keys minted under keys -----------------------------------------------------------------------------------------------------


def _minted(spark, sf_dir):
    """Every order's key is minted under that of a third of its number; some under themselves, under an unknown key, or under none."""
    key = F.substring("minted_key_id", 2, 10).cast("bigint")
    parent = F.when(key % 1000 == 7, key).when(key % 500 == 499, key + 1_000_000_000).when(key >= 3, F.floor(key / 3))
    under = F.when(F.col("event_name") == "AssumeRole", F.concat(F.lit("K"), F.lpad(parent.cast("string"), 10, "0"))).otherwise(F.col("access_key_id"))
    return order_sessions(spark, sf_dir).withColumn("access_key_id", under)


_CLOSURE = """
k AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 1000 = 7 THEN o_orderkey WHEN o_orderkey % 500 = 499 THEN o_orderkey + 1000000000 WHEN o_orderkey >= 3 THEN o_orderkey // 3 END AS parent FROM orders),
c AS (SELECT key, coalesce(parent, key) AS root, CASE WHEN parent IS NULL THEN 0 ELSE 1 END::BIGINT AS depth FROM k WHERE parent IS NULL OR parent NOT IN (SELECT key FROM k) UNION ALL SELECT k.key, c.root, c.depth + 1 FROM k JOIN c ON k.parent = c.key)
"""


@query("session_closure", f"WITH RECURSIVE {_CLOSURE} SELECT printf('K%010d', key) AS key, printf('K%010d', root) AS root, depth, false AS in_cycle FROM c UNION ALL SELECT printf('K%010d', key), NULL, NULL, true FROM k WHERE key NOT IN (SELECT key FROM c)")
def _(spark, sf_dir):
    return lineage.closure(lineage.minted_under(_minted(spark, sf_dir)))


@query(
    "session_rollup",
    f"""WITH RECURSIVE {_CLOSURE}, a AS (SELECT key, (SELECT count(*) FROM lineitem WHERE l_orderkey = key) + (SELECT count(*) FROM k x WHERE x.parent = c.key AND x.key <> c.key) AS n, root, depth FROM c)
    SELECT printf('K%010d', root) AS root, count(*) AS keys, max(depth) AS depth, CAST(sum(n) AS BIGINT) AS action_count FROM a GROUP BY root""",
)
def _(spark, sf_dir):
    e = _minted(spark, sf_dir)
    return lineage.rolled_up(lineage.closure(lineage.minted_under(e)), correlate.session_chains(e, keep=False)).select("root", "keys", "depth", "action_count")


# --- values as of a time --------------------------------------------------------------------------------------------------------


@query(
    "readiness_as_of",
    f"""WITH {EVENTS_SQL}, s AS (SELECT account, ts, arg_max(k, row_id) AS score FROM e WHERE event_name = 'view' AND k < 30 GROUP BY account, ts), l AS (SELECT row_id, account, ts FROM e WHERE event_name <> 'view')
    SELECT row_id, l.account, score FROM l ASOF LEFT JOIN s ON l.account = s.account AND l.ts >= s.ts""",
)
def _(spark, sf_dir):
    e, k = events(spark, sf_dir), F.col("source_ip").cast("int")
    taken = e.filter((F.col("event_name") == "view") & (k < 30)).select("account", F.col("event_ts").alias("taken"), "row_id", k.alias("score"))
    return lineage.as_of(e.filter("event_name <> 'view'"), taken, ["account"], "event_ts", "taken", order="row_id").select("row_id", "account", F.col("snapshot.score").alias("score"))


# --- the real rules over all event names -----------------------------------------------------------------------------------------

#: All names that a rule knows, and some that none does; an event gets one by its number.
_EVERY = tuple(dict.fromkeys([n for g in rules.EVENT_GROUPS.values() for n in g] + [n for m in rules.MECHANISMS.values() for n in m[0]] + list(rules.LOGGING_RESTORE) + list(rules.CORRELATED_ONLY))) + ("ListTags", "Unknown", "")
_LISTED = "[" + ", ".join(f"'{n}'" for n in _EVERY) + "]"
_NAMED = f"nm AS (SELECT e.*, list_extract({_LISTED}, CAST(CAST(row_id AS BIGINT) * 7 % {len(_EVERY)} AS INTEGER) + 1) AS name FROM e)"


def _named(spark, sf_dir):
    at = (F.col("row_id").cast("bigint") * 7 % len(_EVERY)).cast("int")
    return events(spark, sf_dir).withColumn("event_name", F.get(F.array(*[F.lit(n) for n in _EVERY]), at))


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


@query("allowlisted_events", f"WITH {EVENTS_SQL}, {_NAMED} SELECT row_id, name AS event_name, name IN {_in(reduce.allowlist(strict=True))} AS strict FROM nm WHERE name IN {_in(reduce.allowlist())}")
def _(spark, sf_dir):
    return reduce.with_names(_named(spark, sf_dir), reduce.allowlist()).select("row_id", "event_name", reduce.has_name(reduce.allowlist(strict=True)).alias("strict"))


@query("signal_ranks", f"WITH {EVENTS_SQL}, {_NAMED} SELECT row_id, CASE WHEN name IN {_in(rules.CRITICAL_EVENTS)} THEN 0 WHEN name IN {_in(rules.EVENT_GROUPS['identity_mutation'])} THEN 1 WHEN name IN {_in(rules.EVENT_GROUPS['data_access'])} THEN 2 WHEN name IN {_in(rules.EVENT_GROUPS['persistence'])} THEN 3 ELSE 4 END AS rank FROM nm")
def _(spark, sf_dir):
    return _named(spark, sf_dir).select("row_id", reduce.signal_rank(F.col("event_name")).alias("rank"))


_MECHANISM_ROWS = ", ".join(f"('{n}', '{m}', '{t}', '{s}', '{d}')" for m, (names, t, _, s, d) in rules.MECHANISMS.items() for n in names)


@query(
    "persistence_mechanisms",
    f"""WITH {EVENTS_SQL}, {_NAMED}, m(name, mechanism, technique, severity, effect) AS (VALUES {_MECHANISM_ROWS})
    SELECT row_id, mechanism, technique, 'https://aws-samples.github.io/threat-technique-catalog-for-aws/Techniques/' || technique || '.html' AS url, CASE WHEN k < 10 THEN 'low' ELSE severity END AS severity, name || ' ' || effect AS detail FROM nm JOIN m USING (name)""",
)
def _(spark, sf_dir):
    e = _named(spark, sf_dir)
    found = hunt.hunt_events(e).join(e.select("row_id", F.col("actor.arn").alias("actor"), F.col("event_time").alias("time"), "event_name"), ["actor", "time", "event_name"])
    return found.select("row_id", "mechanism", "technique", "url", "severity", "detail")


# --- exports, bundles, the package -----------------------------------------------------------------------------------------------


@query("timeline_export", f"WITH {EVENTS_SQL} SELECT event_name || ' by u' || user_id || ' from ' || source_ip AS message, event_time AS datetime, actor, account FROM e")
def _(spark, sf_dir):
    """Exported as CSV and read back."""
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    e = events(spark, sf_dir)
    none = e.limit(0).select(F.lit("").alias("actor"), F.lit("").alias("time"), F.lit("").alias("tag"))
    timeline.export(timeline.timeline(e, none), path)
    return spark.read.option("header", True).csv(path).select("message", "datetime", "actor", "account")


_BUNDLE = """
b AS (SELECT 'conversations' AS artifact, count(*) AS n FROM conversations UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'labels', count(*) FROM labels),
bl AS (SELECT artifact, unnest(range(0, CAST(ceil(n / 1024) AS BIGINT))) AS block, n FROM b)
"""


def _bundle(spark, sf_dir):
    folder = f"{shared_dir(spark)}/bundles"
    case = f"case-{uuid.uuid4().hex}"
    return folder, case, timeline.preserve({n: table(spark, sf_dir, n) for n in ("conversations", "documents", "labels")}, folder, case)


@query("bundle_manifest", f"WITH {_BUNDLE} SELECT artifact, block AS node, least(1024, n - block * 1024) AS n FROM bl")
def _(spark, sf_dir):
    return _bundle(spark, sf_dir)[2].filter("level = 0").select("artifact", "node", "n")


@query("bundle_verified", f"WITH {_BUNDLE} SELECT artifact, block, block * 1024 AS first_row, block * 1024 + 1023 AS last_row, 'OK' AS state FROM bl")
def _(spark, sf_dir):
    folder, case, _ = _bundle(spark, sf_dir)
    return timeline.verify(spark, folder, case)


def _json_list(fields: dict[str, str], source: str, order: str) -> str:
    item = ", ".join(f"{n}: {c}" for n, c in fields.items())
    return f"(SELECT to_json({{total: (SELECT count(*) FROM {source}), items: (SELECT list({{{item}}} ORDER BY {order}) FROM (SELECT * FROM {source} ORDER BY {order} LIMIT 4))}})::VARCHAR)"


@query(
    "evidence_package",
    f"""WITH {EVENTS_SQL}, {_GAPS}, {_PATTERNS} SELECT {_json_list({"start": "start", "disabled_by": "disabled_by", "still_open": "still_open"}, "g", "start, disabled_by, account, region")} AS gaps,
    {_json_list({"pattern": "pattern", "actor": "actor", "severity": "severity"}, "p", "actor, pattern")} AS patterns, {_json_list({"row_id": "row_id", "event_name": "event_name"}, "e", "event_time, row_id")} AS events,
    to_json({{first: (SELECT min(event_time) FROM e), last: (SELECT max(event_time) FROM e)}})::VARCHAR AS "window" """,
)
def _(spark, sf_dir):
    e, by = events(spark, sf_dir), lambda *names: [F.col(n) for n in names]
    row = package.package(
        {
            "gaps": package.part(_gaps(spark, sf_dir), by("start", "disabled_by", "account", "region"), ["start", "disabled_by", "still_open"], 4),
            "patterns": package.part(correlate.attack_patterns(events(spark, sf_dir, NAMES)), by("actor", "pattern"), ["pattern", "actor", "severity"], 4),
            "events": package.part(e, by("event_time", "row_id"), ["row_id", "event_name"], 4),
        },
        {"window": e.agg(F.min("event_time").alias("first"), F.max("event_time").alias("last"))},
    )
    return row.select(*[F.to_json(c).alias(c) for c in row.columns])
