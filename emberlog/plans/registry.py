"""Queries over the driver's tables by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import correlate, hunt, intel, landscape, profiles, redact, reduce, scoring, timeline
from emberlog.plans.views import EVENTS_SQL, dealt, events, order_sessions, table
from emberlog.sources import feeds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def joined(*columns: str) -> list[F.Column]:
    """Array columns as text."""
    return [F.array_join(c, ",").alias(c) for c in columns]


START, END = "2024-01-02T00:00:00Z", "2024-01-05T00:00:00Z"
KEPT = ("purchase", "signup", "error")


@query("tier_time_allowlist", f"WITH {EVENTS_SQL} SELECT row_id, event_time, event_name FROM e WHERE ts BETWEEN '2024-01-02' AND '2024-01-05' AND event_name IN ('purchase', 'signup', 'error')")
def _(spark, sf_dir):
    return reduce.with_names(reduce.in_window(events(spark, sf_dir), START, END), KEPT).select("row_id", "event_time", "event_name")


@query("tier_actor_scope", f"WITH {EVENTS_SQL} SELECT row_id, actor FROM e WHERE contains(actor, 'u1') OR contains(actor, '7')")
def _(spark, sf_dir):
    return reduce.with_actors(events(spark, sf_dir), ("u1", "7")).select("row_id", F.col("actor.arn").alias("actor"))


@query(
    "dedup_runs",
    f"""WITH {EVENTS_SQL}, w AS (SELECT *, count(*) OVER g AS n, row_number() OVER (g ORDER BY event_time, row_id) AS up, row_number() OVER (g ORDER BY event_time DESC, row_id DESC) AS down,
      min(event_time) OVER g AS a, max(event_time) OVER g AS b FROM e WINDOW g AS (PARTITION BY event_name, actor, source_ip, account, region))
    SELECT row_id, event_name, actor, CASE WHEN n > 2 AND up = 1 THEN n END AS repeat_count, CASE WHEN n > 2 AND up = 1 THEN a || ',' || b END AS repeat_window FROM w WHERE n <= 2 OR up = 1 OR down = 1""",
)
def _(spark, sf_dir):
    return reduce.collapse_runs(events(spark, sf_dir)).select("row_id", "event_name", F.col("actor.arn").alias("actor"), "repeat_count", *joined("repeat_window"))


@query(
    "budget_select",
    f"""WITH RECURSIVE {EVENTS_SQL}, r AS (SELECT row_id, day, cost, row_number() OVER (PARTITION BY day ORDER BY kind, event_time, row_id) AS i FROM
      (SELECT row_id, event_time, substr(event_time, 1, 10) AS day, strlen(event_name) + k AS cost, CASE event_name WHEN 'error' THEN 0 WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS kind FROM e) WHERE cost BETWEEN 1 AND 1500),
    f(day, i, used, row_id, cost) AS (SELECT day, 0::BIGINT, 0::BIGINT, NULL::VARCHAR, NULL::BIGINT FROM (SELECT DISTINCT day FROM r)
      UNION ALL SELECT f.day, r.i, CASE WHEN used + r.cost <= 1500 THEN used + r.cost ELSE used END, CASE WHEN used + r.cost <= 1500 THEN r.row_id END, r.cost FROM f JOIN r ON r.day = f.day AND r.i = f.i + 1)
    SELECT day, row_id, cost FROM f WHERE row_id IS NOT NULL""",
)
def _(spark, sf_dir):
    name = F.col("event_name")
    e = events(spark, sf_dir).select("row_id", "event_time", F.substring("event_time", 1, 10).alias("day"), (F.length(name) + F.col("source_ip").cast("bigint")).alias("cost"), F.when(name == "error", 0).when(name == "signup", 1).when(name == "purchase", 2).otherwise(3).alias("kind"))
    return reduce.greedy_fill(e, [F.col("kind"), F.col("event_time"), F.col("row_id")], F.col("cost"), 1500, ["day"]).select("day", "row_id", "cost")


@query(
    "reduction_stats",
    f"""WITH {EVENTS_SQL}, t1 AS (SELECT * FROM e WHERE ts BETWEEN '2024-01-02' AND '2024-01-05'), t2 AS (SELECT * FROM t1 WHERE event_name IN ('purchase', 'signup', 'error')),
    n AS (SELECT count(*) AS c FROM t2 GROUP BY event_name, actor, source_ip, account, region)
    SELECT (SELECT count(*) FROM e) AS raw, (SELECT count(*) FROM t1) AS in_window, (SELECT count(*) FROM t2) AS allowed, (SELECT CAST(coalesce(sum(least(c, 2)), 0) AS BIGINT) FROM n) AS collapsed,
      round(1 - (SELECT CAST(coalesce(sum(least(c, 2)), 0) AS DOUBLE) FROM n) / (SELECT count(*) FROM e), 4) AS reduction_ratio""",
)
def _(spark, sf_dir):
    return reduce.tier_counts(events(spark, sf_dir), {"in_window": reduce.is_in_window(START, END), "allowed": reduce.has_name(KEPT)})


PHASES = {"access": ("signup",), "impact": ("purchase", "error"), "recon": ("view", "click")}


@query(
    "actor_timelines",
    f"""WITH {EVENTS_SQL} SELECT actor, count(*) AS event_count, string_agg(DISTINCT account, ',' ORDER BY account) AS accounts, string_agg(DISTINCT region, ',' ORDER BY region) AS regions,
      string_agg(DISTINCT source_ip, ',' ORDER BY source_ip) AS source_ips, min(event_time) AS first_seen, max(event_time) AS last_seen,
      concat_ws(',', CASE WHEN bool_or(event_name = 'signup') THEN 'access' END, CASE WHEN bool_or(event_name IN ('purchase', 'error')) THEN 'impact' END, CASE WHEN bool_or(event_name IN ('view', 'click')) THEN 'recon' END) AS phases,
      count(*) FILTER (k % 2 = 0) AS mfa_absent_events, count(DISTINCT account) > 1 AS cross_account FROM e GROUP BY actor""",
)
def _(spark, sf_dir):
    lines = correlate.timelines(events(spark, sf_dir), PHASES)
    return lines.select("actor", "event_count", *joined("accounts", "regions", "source_ips"), "first_seen", "last_seen", *joined("phases"), "mfa_absent_events", "cross_account")


_GAPS = """
t AS (SELECT *, lead(event_name) OVER w AS nn, lead(event_time) OVER w AS "end", lead(ts) OVER w AS end_ts FROM e WHERE event_name IN ('error', 'signup') WINDOW w AS (PARTITION BY account, region, actor ORDER BY event_time, row_id)),
g AS (SELECT event_time AS start, "end", ts, end_ts, actor AS disabled_by, account, region, nn IS NULL AS still_open FROM t WHERE event_name = 'error' AND (nn IS NULL OR nn = 'signup'))
"""


def _gaps(spark, sf_dir):
    return correlate.logging_gaps(events(spark, sf_dir), ("error",), ("signup",), F.col("actor.arn"))


@query(
    "logging_gaps",
    f"""WITH {EVENTS_SQL}, {_GAPS} SELECT start, "end", round((epoch_us(end_ts) - epoch_us(g.ts)) / CAST(6e7 AS DOUBLE), 1) AS duration_minutes, disabled_by, g.account, g.region, still_open,
      (SELECT count(*) FROM e WHERE NOT still_open AND e.event_time > start AND e.event_time < "end") AS events_during_gap FROM g""",
)
def _(spark, sf_dir):
    return _gaps(spark, sf_dir).select("start", "end", "duration_minutes", "disabled_by", "account", "region", "still_open", "events_during_gap")


_CHAINS = """
c AS (SELECT a.actor, a.row_id AS access_row, a.event_time AS access_time, b.event_time AS step_time, b.row_id AS step_row FROM e a JOIN e b ON a.actor = b.actor AND a.event_name = 'signup' AND b.event_name = 'purchase'
  AND (b.event_time, b.row_id) > (a.event_time, a.row_id) AND b.ts <= a.ts + INTERVAL 6 HOURS)
"""


def _chains(spark, sf_dir):
    return correlate.escalation_chains(events(spark, sf_dir), ("signup",), ("purchase",), 360, listed=1000)


@query("escalation_chains", f"WITH {EVENTS_SQL}, {_CHAINS} SELECT actor, access_row, access_time, count(*) AS n, string_agg(step_time, ',' ORDER BY step_time, step_row) AS steps FROM c GROUP BY ALL")
def _(spark, sf_dir):
    return _chains(spark, sf_dir).select("actor", "access_row", "access_time", F.col("escalation_count").alias("n"), F.array_join("escalation_events.time", ",").alias("steps"))


_SESSIONS = """
a AS (SELECT o_orderkey, 'customer/' || o_custkey AS assumed_by, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') AS t, CASE l_returnflag WHEN 'R' THEN 'StopLogging' WHEN 'A' THEN 'GetObject' ELSE 'DescribeInstances' END AS event,
  printf('l-%d-%03d-%010d-%010d', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS r FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey),
n AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY t, r) AS i FROM a)
"""


@query(
    "session_chains",
    f"""WITH {_SESSIONS} SELECT printf('K%010d', o_orderkey) AS key, assumed_by, count(t) AS action_count, coalesce(string_agg(event, ',' ORDER BY t, r) FILTER (i <= 25 AND t IS NOT NULL), '') AS actions,
      coalesce(string_agg(DISTINCT event, ',' ORDER BY event) FILTER (t IS NOT NULL AND event IN ('StopLogging', 'GetObject')), '') AS notable FROM n GROUP BY o_orderkey, assumed_by""",
)
def _(spark, sf_dir):
    s = correlate.session_chains(order_sessions(spark, sf_dir))
    return s.select("key", "assumed_by", "action_count", F.array_join("actions.event", ",").alias("actions"), *joined("notable"))


@query("cross_account_pivots", f"WITH {EVENTS_SQL} SELECT event_time AS time, actor, account AS source_account, CAST(k % 7 AS VARCHAR) AS target_account, 'arn:aws:iam::' || (k % 7) || ':role/r' || k AS target_role, source_ip FROM e WHERE event_name = 'purchase' AND k % 7 <> user_id % 7")
def _(spark, sf_dir):
    return correlate.pivots(events(spark, sf_dir, {"purchase": "AssumeRole"}))


NAMES = {"purchase": "RunInstances", "error": "DeleteObject", "signup": "GetSecretValue", "click": "ModifyImageAttribute", "view": "ListUsers"}
_PATTERNS = """
n AS (SELECT actor, count(*) AS event_count, min(event_time) AS first_seen, max(event_time) AS last_seen, string_agg(DISTINCT account, ',' ORDER BY account) AS accounts, count(DISTINCT region) AS regions,
  count(*) FILTER (event_name = 'purchase') AS runs, count(*) FILTER (event_name = 'error') AS deletes, count(*) FILTER (event_name = 'signup') AS secrets, count(*) FILTER (event_name = 'click') AS shares, count(*) FILTER (event_name = 'view') AS listing FROM e GROUP BY actor),
p AS (
  SELECT 'cryptomining_indicator' AS pattern, 'T1496' AS technique, CASE WHEN runs >= 10 OR regions >= 3 THEN 'high' ELSE 'medium' END AS severity, runs || ' RunInstances across ' || regions || ' region(s)' AS detail, * FROM n WHERE runs >= 3
  UNION ALL SELECT 's3_ransomware_indicator', 'T1485', 'critical', deletes || ' delete calls, 0 lifecycle/versioning changes', * FROM n WHERE deletes >= 20
  UNION ALL SELECT 'snapshot_exfiltration', 'T1537', 'high', shares || ' snapshot/image sharing change(s)', * FROM n WHERE shares > 0
  UNION ALL SELECT 'discovery_burst', 'T1580', 'medium', listing || ' enumeration calls', * FROM n WHERE listing >= 30
  UNION ALL SELECT 'secrets_harvesting', 'T1552.005', 'high', secrets || ' secret/parameter retrievals', * FROM n WHERE secrets >= 5)
"""


@query("attack_patterns", f"WITH {EVENTS_SQL}, {_PATTERNS} SELECT pattern, technique, 'https://aws-samples.github.io/threat-technique-catalog-for-aws/Techniques/' || technique || '.html' AS url, severity, detail, actor, first_seen, last_seen, event_count, accounts FROM p")
def _(spark, sf_dir):
    p = correlate.attack_patterns(events(spark, sf_dir, NAMES))
    return p.select("pattern", "technique", "url", "severity", "detail", "actor", "first_seen", "last_seen", "event_count", *joined("accounts"))


def _findings(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    user = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("user/u"), F.col("s_suppkey").cast("string")))
    return s.select(F.col("s_suppkey").alias("finding_id"), user.alias("user_name"), F.lit(None).cast("string").alias("principal_id"), F.array((F.col("s_suppkey") % 150).cast("string")).alias("ips"))


@query(
    "findings_link",
    f"""WITH {EVENTS_SQL}, a AS (SELECT actor, min(event_time) AS first_seen FROM e GROUP BY actor), f AS (SELECT s_suppkey AS finding_id, CASE WHEN s_suppkey % 2 = 0 THEN 'user/u' || s_suppkey END AS who, CAST(s_suppkey % 150 AS VARCHAR) AS ip FROM supplier),
    x AS (SELECT finding_id, actor, 'principal' AS matched_by FROM f JOIN a ON who = actor),
    y AS (SELECT finding_id, arg_min(a.actor, (first_seen, a.actor)) AS actor, 'address' AS matched_by FROM f JOIN (SELECT DISTINCT actor, source_ip FROM e) s ON ip = source_ip JOIN a ON a.actor = s.actor WHERE finding_id NOT IN (SELECT finding_id FROM x) GROUP BY finding_id)
    SELECT * FROM x UNION ALL SELECT * FROM y""",
)
def _(spark, sf_dir):
    e = events(spark, sf_dir)
    return correlate.link_findings(_findings(spark, sf_dir), correlate.timelines(e), addresses=profiles.actor_values(e))


_IPV4_SQL = r"regexp_extract_all(coalesce(text, ''), '\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b')"
_ROUTABLE_SQL = """(list_filter([n.a, n.b, n.c, n.d], lambda x: x > 255) = [] AND NOT (a = 0 OR a = 10 OR a = 127 OR a >= 224 OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168)
  OR (a = 192 AND b = 0 AND c = 2) OR (a = 192 AND b = 0 AND c = 0 AND (d < 8 OR d IN (170, 171))) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113))
  AND NOT regexp_matches(value, '(^|\\.)0[0-9]'))"""
_INDICATORS = rf"""
f AS (SELECT doc_id, unnest(list_distinct({_IPV4_SQL})) AS value FROM documents),
n AS (SELECT doc_id, value, CAST(split_part(value, '.', 1) AS INTEGER) AS a, CAST(split_part(value, '.', 2) AS INTEGER) AS b, CAST(split_part(value, '.', 3) AS INTEGER) AS c, CAST(split_part(value, '.', 4) AS INTEGER) AS d FROM f),
ip AS (SELECT doc_id, 'ip' AS kind, value FROM n WHERE {_ROUTABLE_SQL}),
dm AS (SELECT DISTINCT doc_id, 'domain' AS kind, lower(value) AS value FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{{0,61}}[a-zA-Z0-9])?\.)+(?:com|net|org|io|ru|cn|info|biz|top|xyz|club|online|site|tk|ml|ga|cf|gq|su|pw)\b')) AS value FROM documents)
  WHERE NOT regexp_matches(lower(value), '(^|\.)(amazonaws\.com|aws\.amazon\.com|console\.aws\.amazon\.com|signin\.aws\.amazon\.com|s3\.amazonaws\.com|cloudfront\.net|amazon\.com|microsoft\.com|windows\.net|google\.com)$')),
i AS (SELECT * FROM ip UNION ALL SELECT * FROM dm)
"""


def _indicators(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(intel.indicators_in(F.col("text"), hashes=False)).alias("i")).select("doc_id", "i.kind", "i.value")


@query("ioc_extract", f"WITH {_INDICATORS} SELECT doc_id, kind, value FROM i")
def _(spark, sf_dir):
    return _indicators(spark, sf_dir)


#: A feed of the first two digits of addresses and of domains, derived from the table itself.
def _feed(spark, sf_dir):
    lines = _indicators(spark, sf_dir).select("kind", "value").distinct()
    odd = F.pmod(F.length("value"), F.lit(3)) == 0
    line = F.concat(F.upper("value"), F.lit(" | "), F.when(odd, "Cozy Bear infrastructure").otherwise(""), F.lit("|"), F.when(odd, "90").otherwise("n/a"), F.lit("|x|y|z|"), F.when(odd, "").otherwise("seen with TeamTNT"))
    parsed = [feeds.parse(lines.filter(F.col("kind") == kind).select(line.alias("line"), F.lit(1).alias("at")), f"{kind}s", kind) for kind in ("ip", "domain")]
    return parsed[0].union(parsed[1])


_FEED = """
fd AS (SELECT DISTINCT kind, value, kind || 's' AS feed, CASE WHEN length(value) % 3 = 0 THEN 'Cozy Bear infrastructure' ELSE 'suspicious' END AS category, CASE WHEN length(value) % 3 = 0 THEN 90 ELSE 75 END AS confidence,
  CASE WHEN length(value) % 3 = 0 THEN '' ELSE 'seen with TeamTNT' END AS description, CASE WHEN length(value) % 3 = 0 THEN 'G0016' ELSE 'G0139' END AS group_id FROM i)
"""


@query("feed_attribution", f"WITH {_INDICATORS}, {_FEED} SELECT feed, kind, value AS indicator, CAST(confidence AS INTEGER) AS confidence, category, description, group_id FROM fd")
def _(spark, sf_dir):
    return _feed(spark, sf_dir)


@query(
    "ioc_enrich",
    f"""WITH {_INDICATORS}, {_FEED}, u AS (SELECT kind, value, min(doc_id) AS first_doc FROM i GROUP BY kind, value)
    SELECT u.kind, u.value, 'doc ' || first_doc AS context, true AS malicious, CAST(confidence AS INTEGER) AS confidence, group_id AS groups, CASE group_id WHEN 'G0016' THEN 'APT29' ELSE 'TeamTNT' END AS group_names, category AS categories, feed AS feeds FROM u JOIN fd USING (kind, value)""",
)
def _(spark, sf_dir):
    found = _indicators(spark, sf_dir).groupBy("kind", "value").agg(F.concat(F.lit("doc "), F.min("doc_id").cast("string")).alias("context"))
    return intel.enrich(found, _feed(spark, sf_dir)).select("kind", "value", "context", "malicious", "confidence", *joined("groups", "group_names", "categories", "feeds"))


def _mechanisms(spark):
    rows = [("signup", "iam_backdoor", "T1136.003", "Create Account: Cloud Account", "high", "adds"), ("error", "mfa_removal", "T1556.006", "Modify Authentication Process", "critical", "weakens"), ("purchase", "compute_persistence", "T1578", "Modify Cloud Compute Infrastructure", "medium", "starts")]
    return spark.createDataFrame(rows, "event_name string, mechanism string, technique string, technique_name string, base_severity string, effect string")


_HUNT = """
h AS (SELECT row_id, CASE event_name WHEN 'signup' THEN 'iam_backdoor' WHEN 'error' THEN 'mfa_removal' ELSE 'compute_persistence' END AS mechanism,
  CASE WHEN k < 10 AND user_id % 10 <> 0 THEN 'low' WHEN event_name = 'signup' THEN 'high' WHEN event_name = 'error' THEN 'critical' ELSE 'medium' END AS severity, actor, account, region, event_time AS time,
  event_name || CASE event_name WHEN 'signup' THEN ' adds' WHEN 'error' THEN ' weakens' ELSE ' starts' END AS detail, event_name, k < 10 AS likely_automation FROM e WHERE event_name IN ('signup', 'error', 'purchase'))
"""


def _hunt(spark, sf_dir):
    e = events(spark, sf_dir)
    suspects = e.select(F.upper("actor.arn").alias("actor")).filter(F.col("actor").endswith("0")).distinct()
    return hunt.hunt_events(e, suspects, _mechanisms(spark))


@query("persistence_events", f"WITH {EVENTS_SQL}, {_HUNT} SELECT mechanism, severity, actor, account, region, time, detail, event_name, likely_automation FROM h")
def _(spark, sf_dir):
    return _hunt(spark, sf_dir).select("mechanism", "severity", "actor", "account", "region", "time", "detail", "event_name", "likely_automation")


@query(
    "persistence_summary",
    f"""WITH {EVENTS_SQL}, {_HUNT} SELECT 'mechanism' AS dimension, mechanism AS value, count(*) AS n FROM h GROUP BY mechanism UNION ALL SELECT 'severity', severity, count(*) FROM h GROUP BY severity
    UNION ALL SELECT 'critical_or_high', 'yes', count(*) FROM h WHERE severity IN ('critical', 'high') HAVING count(*) > 0 UNION ALL SELECT 'likely_automation', 'yes', count(*) FROM h WHERE likely_automation HAVING count(*) > 0""",
)
def _(spark, sf_dir):
    return hunt.persistence_summary(_hunt(spark, sf_dir))


@query(
    "trust_external",
    """WITH r AS (SELECT CAST(s_nationkey AS VARCHAR) AS account, s_name AS role, s_suppkey % 5 AS m, s_suppkey FROM supplier),
    p AS (SELECT account, role, CASE m WHEN 0 THEN '*' WHEN 1 THEN 'arn:x:' || (s_suppkey + 1000) WHEN 2 THEN 'arn:x:' || account END AS who, m FROM r)
    SELECT account, role AS resource, CASE WHEN m = 0 THEN 'critical' ELSE 'high' END AS severity, 'role trusts external principal(s): ' || who AS detail FROM p WHERE m = 0 OR (m = 1 AND NOT contains(who, account))""",
)
def _(spark, sf_dir):
    s, m = table(spark, sf_dir, "supplier"), F.col("s_suppkey") % 5
    account = F.col("s_nationkey").cast("string")
    allow = lambda p: F.concat(F.lit('{"Statement": [{"Effect": "Allow", "Principal": '), p, F.lit("}]}"))
    arn = lambda c: F.concat(F.lit('"arn:x:'), c, F.lit('"'))
    policy = (
        F.when(m == 0, allow(F.lit('"*"')))
        .when(m == 1, allow(F.concat(F.lit('{"AWS": '), arn((F.col("s_suppkey") + 1000).cast("string")), F.lit("}"))))
        .when(m == 2, allow(F.concat(F.lit('{"AWS": ['), arn(account), F.lit("]}"))))
        .when(m == 3, F.lit('{"Statement": [{"Effect": "Deny", "Principal": "*"}]}'))
        .otherwise(F.lit("not json"))
    )
    return hunt.external_trust(s.select(account.alias("account"), F.col("s_name").alias("role_name"), policy.alias("trust_policy"))).select("account", "resource", "severity", "detail")


@query("multi_key_users", "SELECT CAST(c_nationkey AS VARCHAR) AS account, c_name AS resource, n || ' active access keys' AS detail FROM (SELECT c_nationkey, c_name, count(*) FILTER (o_orderstatus = 'O') AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) WHERE n > 1")
def _(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    keys = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").cast("string").alias("account"), F.col("c_name").alias("user_name"), F.col("o_orderkey").cast("string").alias("access_key_id"), F.when(F.col("o_orderstatus") == "O", "Active").otherwise("Inactive").alias("status"))
    return hunt.many_keys(keys, None).select("account", "resource", "detail")


def _regions(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("account"), (F.col("s_suppkey") % 4).cast("string").alias("region"), "s_name", "s_suppkey", "s_acctbal")
    key = F.col("s_suppkey")
    work = s.select("account", "region").distinct()
    trails = s.select("account", "region", F.col("s_name").alias("name"), (key % 3 == 0).alias("is_multi_region"), (F.col("s_acctbal") > 0).alias("is_logging"), (key % 5 == 0).alias("has_log_file_validation"), (key % 7 == 0).alias("data_events_configured"))
    pick = lambda n: s.filter(key % n == 0).select("account", "region")
    failures = work.filter((F.col("region") == "3") & (F.col("account") == "7")).withColumn("error", F.lit("AccessDenied"))
    return landscape.readiness(landscape.snapshot(work, trails, pick(3), pick(4), pick(5), pick(6), failures))


_REGIONS = """
s AS (SELECT CAST(s_nationkey AS VARCHAR) AS account, CAST(s_suppkey % 4 AS VARCHAR) AS region, s_suppkey AS k, s_acctbal > 0 AS act FROM supplier),
q AS (SELECT account, region, NOT (region = '3' AND account = '7') AS reachable, count(*) AS trails, count(*) FILTER (act) AS active, coalesce(bool_or(act AND k % 3 = 0), false) AS m, coalesce(bool_or(act AND k % 5 = 0), false) AS v, coalesce(bool_or(act AND k % 7 = 0), false) AS d,
  bool_or(k % 3 = 0) AS gd, bool_or(k % 4 = 0) AS cf, count(*) FILTER (k % 5 = 0) AS fl, bool_or(k % 6 = 0) AS hb FROM s GROUP BY account, region),
z AS (SELECT *, CASE WHEN reachable THEN CAST((CASE WHEN active > 0 THEN 35 ELSE 0 END) + 10 * m::INT + 5 * v::INT + 10 * d::INT + 20 * gd::INT + 8 * cf::INT + (CASE WHEN fl > 0 THEN 7 ELSE 0 END) + 5 * hb::INT AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS score FROM q),
gp AS (SELECT account, region, reachable, unnest([CASE WHEN active > 0 AND NOT m THEN 'No multi-region CloudTrail' END, CASE WHEN active > 0 AND NOT v THEN 'Log file validation off' END, CASE WHEN active > 0 AND NOT d THEN 'No S3/Lambda data events' END, CASE WHEN active = 0 THEN 'CRITICAL' END,
  CASE WHEN active = 0 THEN trails || ' trail(s) exist but are not logging' END, CASE WHEN NOT gd THEN 'GuardDuty disabled' END, CASE WHEN NOT cf THEN 'AWS Config not recording' END, CASE WHEN fl = 0 THEN 'No VPC flow logs' END]) AS gap FROM z WHERE reachable)
"""


@query("readiness_score", f"WITH {_REGIONS} SELECT account, region, reachable, score AS readiness_score, CASE WHEN NOT reachable THEN 'no_access' WHEN score >= 80 THEN 'strong' WHEN score >= 60 THEN 'adequate' WHEN score >= 35 THEN 'degraded' ELSE 'severely_limited' END AS readiness_band, (SELECT count(gap) FROM gp WHERE gp.account = z.account AND gp.region = z.region) AS n_gaps FROM z")
def _(spark, sf_dir):
    return _regions(spark, sf_dir).select("account", "region", "reachable", "readiness_score", "readiness_band", F.size("gaps").cast("bigint").alias("n_gaps"))


@query(
    "estate_summary",
    f"""WITH {_REGIONS} SELECT count(*) AS total_regions, count(*) FILTER (reachable) AS reachable, round(coalesce(avg(score) FILTER (reachable), 0), 1) AS mean_readiness,
    coalesce(string_agg(account || ':' || region, ',' ORDER BY account || ':' || region) FILTER (reachable AND active = 0), '') AS without_cloudtrail, coalesce(string_agg(account || ':' || region, ',' ORDER BY account || ':' || region) FILTER (reachable AND NOT gd), '') AS without_guardduty FROM z""",
)
def _(spark, sf_dir):
    return landscape.estate_summary(_regions(spark, sf_dir)).select("total_regions", "reachable", "mean_readiness", *joined("without_cloudtrail", "without_guardduty"))


@query("gap_frequency", f"WITH {_REGIONS} SELECT gap, count(*) AS n FROM gp WHERE gap IS NOT NULL GROUP BY gap")
def _(spark, sf_dir):
    return landscape.gap_frequency(_regions(spark, sf_dir))


def _steps(spark, sf_dir):
    p, k = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey"), F.col("p_partkey")
    pick = lambda n, *v: F.get(F.array(*[F.lit(x) for x in v]), (k % n).cast("int"))
    some = lambda n, text: F.transform(F.sequence(F.lit(1), (k % n).cast("int") + 1), lambda i: F.concat(F.lit(text), i.cast("string")))
    gaps = F.map_from_entries(F.transform(some(2, "gap "), lambda s: F.struct(s, F.lit("x"))))
    return p.select(
        k.cast("int").alias("step"), F.col("p_name").alias("action"),
        F.struct((k % 6).cast("int").alias("criticality_tier"), pick(4, "severe", "high", "moderate", "low").alias("impact_if_compromised"), pick(5, "PCI", "customer", "internal", "public", "other").alias("data_sensitivity"), (k % 2 == 0).alias("sla_breach_risk")).alias("business_criticality"),
        F.struct((k % 101).cast("int").alias("confidence"), F.when(k % 3 == 0, F.array(F.lit("cozy bear"), F.lit("nobody"))).when(k % 3 == 1, F.array(F.lit("G0139"))).otherwise(F.array().cast("array<string>")).alias("associated_threat_groups"), some(4, "ioc").alias("linked_iocs"), some(3, "src").alias("data_sources")).alias("threat_intel_enrichment"),
        F.struct((k % 100).cast("int").alias("completeness"), (k % 90).cast("int").alias("reliability"), (k % 80).cast("int").alias("confidence"), some(3, "spot ").alias("blind_spots"), gaps.alias("evidence_gaps")).alias("evidence_quality"),
        (k % 7).cast("int").alias("response_effort"), (k % 4).cast("int").alias("assigned_analysts"),
        F.struct((k % 48).cast("int").alias("incident_age_hours"), F.lit(24).alias("optimal_response_window_hours"), F.lit(None).cast("boolean").alias("overdue")).alias("time_sensitivity"),
    )


def _scores_sql(spots: str) -> str:
    d = "CAST({} AS DECIMAL(38, 12))".format
    return f"""
    k AS (SELECT p_partkey AS k, {spots} AS spots FROM part),
    v AS (SELECT k, CASE k % 6 WHEN 1 THEN 10 WHEN 2 THEN 8 WHEN 3 THEN 5 WHEN 4 THEN 2 ELSE 5 END AS t, CASE k % 4 WHEN 0 THEN 10 WHEN 1 THEN 8 WHEN 2 THEN 5 ELSE 2 END AS i, CASE k % 5 WHEN 0 THEN 10 WHEN 1 THEN 7.5 WHEN 2 THEN 5 WHEN 3 THEN 1 ELSE 5 END AS s, CASE WHEN k % 2 = 0 THEN 10 ELSE 0 END AS sla,
      CASE k % 3 WHEN 0 THEN 2.0 WHEN 1 THEN 1.5 ELSE 0 END AS bonus, CASE k % 7 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 4 THEN 7.5 WHEN 5 THEN 10 ELSE 5 END AS eff, greatest(k % 4, 1) AS an, spots FROM k),
    w AS (SELECT k, round({d("t")} * 0.40 + {d("i")} * 0.35 + {d("s")} * 0.15 + {d("sla")} * 0.10, 2) AS bi, round(least(10, {d("(k % 101)")} / 10 + {d("bonus")} + least(2.0, (k % 4) * 0.5) + least(1.0, (k % 3) * 0.5)), 2) AS tc,
      round(CAST(greatest(0, CAST(k % 100 + k % 90 + k % 80 AS DOUBLE) / 30 - spots - 0.5 * (k % 2 + 1)) AS DECIMAL(18, 8)), 2) AS eq, round(CAST(greatest(1, CAST(eff AS DOUBLE) / (1 + CAST(0.35 AS DOUBLE) * (an - 1))) AS DECIMAL(18, 8)), 2) AS ef FROM v),
    x AS (SELECT *, round(CAST(bi * 0.40 + tc * 0.30 + (10 - ef) * 0.20 + eq * 0.10 AS DECIMAL(18, 8)), 2) AS sc, k % 48 > 24 AS od FROM w),
    y AS (SELECT CAST(k AS INTEGER) AS step, CAST(bi AS DOUBLE) AS business_impact, CAST(tc AS DOUBLE) AS threat_confidence, CAST(eq AS DOUBLE) AS quality, CAST(ef AS DOUBLE) AS effort, CAST(sc AS DOUBLE) AS score,
      CASE WHEN sc >= 7.5 THEN 'critical' WHEN sc >= 5 THEN 'high' WHEN sc >= 2.5 THEN 'medium' ELSE 'low' END AS priority, od AS is_overdue FROM x)
    """


_SCORED = ("step", "business_impact", "threat_confidence", "quality", "effort", "score", "priority", "is_overdue")


@query("score_steps", f"WITH {_scores_sql('(p_partkey % 3 + 1)')} SELECT * FROM y")
def _(spark, sf_dir):
    return scoring.score_steps(_steps(spark, sf_dir)).select(*_SCORED)


@query("critical_path", f"WITH {_scores_sql('(p_partkey % 3 + 1)')} SELECT step, score, priority, CASE WHEN priority = 'critical' OR is_overdue THEN 0 ELSE 1 END AS path_bucket FROM y WHERE priority IN ('critical', 'high')")
def _(spark, sf_dir):
    return scoring.critical_path(scoring.score_steps(_steps(spark, sf_dir))).select("step", "score", "priority", "path_bucket")


@query("rescore", f"WITH {_scores_sql('(p_partkey % 3)')} SELECT * FROM y")
def _(spark, sf_dir):
    return scoring.score_steps(scoring.resolve(_steps(spark, sf_dir), ["SPOT 1"])).select(*_SCORED)


def _pivots(spark, sf_dir):
    return correlate.pivots(events(spark, sf_dir, {"view": "AssumeRole"}))


def _sessions(spark, sf_dir):
    """A third of the sign-ups mint a key of their user; errors of other users are actions under keys."""
    e, k = events(spark, sf_dir, {"signup": "AssumeRole", "error": "StopLogging"}), F.col("source_ip").cast("int")
    user = F.regexp_extract("actor.arn", r"\d+", 0).cast("int")
    mint = (F.col("event_name") == "AssumeRole") & (k % 3 == 0)
    key = F.when(F.col("event_name") == "StopLogging", F.concat(F.lit("K"), (user * 7 % 400).cast("string")))
    return correlate.session_chains(e.withColumns({"minted_key_id": F.when(mint, F.concat(F.lit("K"), user.cast("string"))), "access_key_id": key}))


@query(
    "timeline_tags",
    f"""WITH {EVENTS_SQL}, {_GAPS}, {_CHAINS}, tg AS (SELECT actor, access_time AS time, 'escalation_chain_start' AS tag, 1 AS p, access_time || ' 0' AS o FROM c UNION ALL SELECT actor, step_time, 'escalation', 1, access_time || ' 1' FROM c
      UNION ALL SELECT disabled_by, start, 'logging_disabled', 2, start || ' 0' FROM g UNION ALL SELECT disabled_by, "end", 'logging_restored', 2, start || ' 1' FROM g WHERE NOT still_open
      UNION ALL SELECT actor, event_time, 'cross_account_pivot', 3, '' FROM e WHERE event_name = 'view' AND k % 7 <> user_id % 7
      UNION ALL SELECT actor, max(event_time), 'session_start', 4, '' FROM e WHERE event_name = 'signup' AND k % 3 = 0 GROUP BY actor),
    b AS (SELECT actor, time, arg_max(tag, (p, o, tag)) AS tag FROM tg GROUP BY actor, time)
    SELECT e.event_name || ' by u' || user_id || ' from ' || source_ip AS message, event_time AS datetime, e.actor, coalesce(tag, '') AS tag FROM e LEFT JOIN b ON b.actor = e.actor AND b.time = event_time""",
)
def _(spark, sf_dir):
    steps = correlate.escalation_steps(events(spark, sf_dir), ("signup",), ("purchase",), 360)
    tagged = timeline.tags(steps, _gaps(spark, sf_dir), _pivots(spark, sf_dir), _sessions(spark, sf_dir), steps)
    return timeline.timeline(events(spark, sf_dir), tagged).select("message", "datetime", "actor", "tag")


@query("pseudonymize", "SELECT 'arn:aws:iam::' || printf('%012d', c_nationkey) || ':user/' || c_name AS value, 'PRINCIPAL' AS kind, 'PRINCIPAL-N' AS token, c_custkey FROM customer")
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    arn = F.concat(F.lit("arn:aws:iam::"), F.lpad(F.col("c_nationkey").cast("string"), 12, "0"), F.lit(":user/"), F.col("c_name"))
    rows = c.select("c_custkey", F.concat(F.lit("seen "), arn, F.lit(" today")).alias("text"))
    tokens = redact.mapping(rows, "text")
    shown = redact.redact(rows, "c_custkey", "text", tokens).withColumn("token", F.regexp_replace("text", r"^seen (PRINCIPAL)-\d+ today$", "$1-N"))
    back = redact.restore(shown, "c_custkey", "text", tokens)
    return back.select(F.regexp_extract("text", "^seen (.*) today$", 1).alias("value"), F.lit("PRINCIPAL").alias("kind"), "token", "c_custkey")


@query("manifest_hashes", "SELECT doc_id, sha256(concat_ws('|', CAST(doc_id AS VARCHAR), lang, source, text)) AS sha256 FROM documents")
def _(spark, sf_dir):
    return timeline.row_hashes(table(spark, sf_dir, "documents"), "doc_id", ["doc_id", "lang", "source", "text"])


@query("sequences_summary", "SELECT CAST(conv_id AS VARCHAR) AS id, count(*) FILTER (role = 'user') AS signal_count, CASE WHEN strlen(t) = length(t) AND length(t) > 400 THEN t[1:397] || '...' WHEN length(t) > 400 THEN substr(t, 1, 397) || '...' ELSE t END AS description FROM (SELECT conv_id, role, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS t FROM conversations) GROUP BY conv_id, t")
def _(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    none = F.lit(None).cast("string")
    f = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("description"), F.collect_list(F.when(F.col("role") == "user", "s")).alias("signals")).select(F.col("conv_id").cast("string").alias("id"), F.lit("AttackSequence").alias("type"), F.lit(8.0).alias("severity"), none.alias("title"), "description", none.alias("account"), none.alias("region"), "signals", F.array(F.struct(none.alias("id"))).alias("actors"))
    return correlate.sequences(f.filter(correlate.is_sequence())).select("id", F.col("signal_count").cast("bigint").alias("signal_count"), "description")


@query("correlation_summary", f"WITH {EVENTS_SQL}, {_GAPS}, {_CHAINS}, {_PATTERNS} SELECT (SELECT count(DISTINCT actor) FROM e) AS actors, (SELECT count(*) FROM g) AS logging_gaps, (SELECT count(*) FROM g WHERE still_open) AS open_gaps, (SELECT count(DISTINCT access_row) FROM c) AS escalation_chains, (SELECT count(*) FROM p) AS attack_patterns")
def _(spark, sf_dir):
    e, gaps = events(spark, sf_dir), _gaps(spark, sf_dir)
    return correlate.summary(actors=correlate.timelines(e), logging_gaps=gaps, open_gaps=gaps.filter("still_open"), escalation_chains=_chains(spark, sf_dir), attack_patterns=correlate.attack_patterns(events(spark, sf_dir, NAMES)))


@query("compromised_principals", f"""WITH {EVENTS_SQL}, {_CHAINS}, {_PATTERNS} SELECT DISTINCT actor FROM (SELECT actor FROM c UNION ALL SELECT actor FROM p WHERE severity IN ('critical', 'high')
    UNION ALL SELECT actor FROM e WHERE event_name = 'signup' AND k % 3 = 0 AND user_id IN (SELECT user_id * 7 % 400 FROM e WHERE event_name = 'error'))""")
def _(spark, sf_dir):
    return correlate.compromised_principals(_chains(spark, sf_dir), _sessions(spark, sf_dir), correlate.attack_patterns(events(spark, sf_dir, NAMES)))


@query("query_events", f"WITH {EVENTS_SQL} SELECT row_id, event_time, actor FROM e WHERE event_name IN ('error', 'signup') AND contains(actor, 'u1') AND event_time >= '2024-01-03' AND event_time <= '2024-01-20'")
def _(spark, sf_dir):
    return timeline.matching(events(spark, sf_dir), ("error", "signup"), "u1", "2024-01-03", "2024-01-20").select("row_id", "event_time", F.col("actor.arn").alias("actor"))


@query("work_list", "SELECT CAST(s_suppkey AS VARCHAR) AS account, unnest(CASE WHEN s_suppkey % 3 = 0 THEN ['own'] ELSE ['r1', 'r2'] END) AS region FROM supplier")
def _(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    own = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("own"))).otherwise(F.array().cast("array<string>"))
    return landscape.work_list(s.select(F.col("s_suppkey").cast("string").alias("account"), own.alias("regions")), ["r1", "r2"])
