"""More queries over the driver's tables: slim records, scans, indicators, live state, containment, redaction; and the SQL of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog import schema
from emberlog.functions import dates
from emberlog.functions.shared import stored
from emberlog.operators import correlate, hunt, intel, landscape, redact, reduce, scoring, timeline
from emberlog.plans.registry import joined, query
from emberlog.plans.views import EVENTS_SQL, dealt, events, table
from emberlog.sources import events as sources
from emberlog.sources import feeds

# --- slim records and the budget ------------------------------------------------------------------------------------------------

_NAMES = {"error": "StopLogging", "signup": "CreateUser", "purchase": "GetObject", "view": "CreateFunction", "click": "ListUsers"}
_RENAMED = "CASE event_name WHEN 'error' THEN 'StopLogging' WHEN 'signup' THEN 'CreateUser' WHEN 'purchase' THEN 'GetObject' WHEN 'view' THEN 'CreateFunction' ELSE 'ListUsers' END"


def _long_params(k):
    """Parameters of growing length, with non-ASCII letters; past the limit for large k."""
    many = F.array_join(F.transform(F.sequence(F.lit(1), k % 14), lambda i: F.concat(F.lit('"k'), i.cast("string"), F.lit('": "'), F.repeat(F.lit("vé"), k.cast("int")), F.lit('"'))), ", ")
    return F.when(k % 14 == 0, F.lit(None)).when(k % 5 == 1, F.concat(F.lit("not json "), F.repeat(F.lit("y"), (k * 5).cast("int")))).otherwise(F.concat(F.lit("{"), many, F.lit("}")))


def _slim_events(spark, sf_dir):
    k = F.col("source_ip").cast("int")
    return events(spark, sf_dir, _NAMES, deal=True).withColumn("request_params", _long_params(k)).withColumn("user_agent", F.repeat("user_agent", (k % 12).cast("int")))


_SLIM = f"""
p AS (SELECT e.*, {_RENAMED} AS name, CASE WHEN k % 14 = 0 THEN NULL WHEN k % 5 = 1 THEN 'not json ' || repeat('y', k * 5) ELSE '{{' || array_to_string(list_transform(range(1, k % 14 + 1), lambda i: '"k' || i || '": "' || repeat('vé', k) || '"'), ', ') || '}}' END AS params,
  repeat(CASE WHEN k < 10 THEN 'terraform/1.0' ELSE 'console' END, k % 12) AS ua FROM e),
q AS (SELECT *, length(params) + 5 * length(regexp_replace(params, '[\\x00-\\x7F]+', '', 'g')) AS full_length FROM p),
r AS (SELECT *, CASE WHEN params IS NULL THEN NULL WHEN k % 5 = 1 THEN CASE WHEN length(params) + 2 > 260 THEN '"\\"' || substr(params, 1, 259) || '"' ELSE '"' || params || '"' END
    WHEN full_length <= 260 THEN replace(params, '": "', '":"')
    ELSE '{{' || array_to_string(list_transform(range(1, least(k % 14, 8) + 1), lambda i: '"k' || i || '":"' || CASE WHEN 2 * k <= 60 THEN repeat('vé', k) ELSE substr(repeat('vé', k), 1, 57) || '...' END || '"'), ',') || '}}' END AS pruned FROM q),
s AS (SELECT row_id, event_time, name, '{{"eventTime":"' || event_time || '","eventName":"' || name || '","awsRegion":"' || region || '","sourceIPAddress":"' || source_ip || '","userAgent":"' || CASE WHEN length(ua) > 80 THEN substr(ua, 1, 77) || '...' ELSE ua END
    || '","account":"' || account || '","actor":{{"type":null,"arn":"' || actor || '","userName":null}}' || CASE WHEN pruned IS NULL THEN '' ELSE ',"requestParameters":' || replace(pruned, ', "', ',"') END || ',"mfaAuthenticated":"' || CASE WHEN k % 2 = 0 THEN 'false' ELSE 'true' END || '"}}' AS slim FROM r),
c AS (SELECT *, length(slim) + length(regexp_replace(regexp_replace(slim, '"(?:[^"\\\\]|\\\\.)*"', '""', 'g'), '[^,:]', '', 'g')) + 5 * length(regexp_replace(slim, '[\\x00-\\x7F]+', '', 'g')) AS cost FROM s)
"""


@query("slim_records", f"WITH {EVENTS_SQL}, {_SLIM} SELECT row_id, event_time, slim, CAST(cost AS INTEGER) AS cost FROM c")
def _(spark, sf_dir):
    return reduce.slim(_slim_events(spark, sf_dir))


@query(
    "slim_budget",
    f"""WITH RECURSIVE {EVENTS_SQL}, {_SLIM}, o AS (SELECT row_id, event_time, name, cost, row_number() OVER (ORDER BY CASE name WHEN 'StopLogging' THEN 0 WHEN 'CreateUser' THEN 0 WHEN 'GetObject' THEN 2 WHEN 'CreateFunction' THEN 3 ELSE 4 END, event_time, row_id) AS i FROM c),
    f(i, used, taken) AS (SELECT 0::BIGINT, 0::BIGINT, false UNION ALL SELECT o.i, CASE WHEN used + cost <= 140000 THEN used + cost ELSE used END, used + cost <= 140000 FROM f JOIN o ON o.i = f.i + 1)
    SELECT row_id, event_time, name AS event_name, row_number() OVER (ORDER BY event_time, row_id) AS place FROM f JOIN o USING (i) WHERE taken""",
)
def _(spark, sf_dir):
    from pyspark.sql import Window

    kept = reduce.fit_budget(_slim_events(spark, sf_dir))
    # the budget bounds the rows here
    return kept.select("row_id", "event_time", "event_name", F.row_number().over(Window.orderBy("event_time", "row_id")).cast("bigint").alias("place"))


# --- scans of tables ------------------------------------------------------------------------------------------------------------


def _flat(spark, sf_dir):
    """An audit-log table with partition columns, some cells blank."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    blank = lambda c, n: F.when(k % n == 0, "").otherwise(c)
    text = lambda c: c.cast("string")
    return e.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("eventtime"), F.col("event_type").alias("eventname"), F.lit("svc").alias("eventsource"), blank(text(k % 5), 11).alias("awsregion"), text(k).alias("sourceipaddress"),
        F.repeat(F.lit("agent "), (k % 20).cast("int")).alias("useragent"), text(F.col("user_id") % 7).alias("recipientaccountid"), F.lit("IAMUser").alias("actor_type"), blank(F.concat(F.lit("user/u"), text(F.col("user_id"))), 3).alias("actor_arn"),
        F.concat(F.lit("name"), text(F.col("user_id"))).alias("actor_username"), F.lit("false").alias("mfa"), F.lit("").alias("errorcode"), F.lit("").alias("requestparameters"),
        F.date_format("ts", "yyyy").cast("int").alias("year"), F.date_format("ts", "M").cast("int").alias("month"), F.date_format("ts", "d").cast("int").alias("day"), F.col("event_id"), dates.compact_day(F.col("ts")).alias("eventday"), F.col("ts"), k.alias("k"),
    )


@query(
    "audit_table_scan",
    f"""WITH {EVENTS_SQL}, s AS (SELECT event_time, event_name, nullif(CASE WHEN k % 11 = 0 THEN '' ELSE region END, '') AS region, account, source_ip, nullif(CASE WHEN k % 20 > 13 THEN substr(repeat('agent ', k % 20), 1, 77) || '...' ELSE repeat('agent ', k % 20) END, '') AS user_agent,
      CASE WHEN k % 3 = 0 THEN 'name' || user_id ELSE actor END AS actor FROM e)
    SELECT * FROM s WHERE event_time BETWEEN '2024-01-03T00:00:00Z' AND '2024-01-20T12:00:00Z' AND event_name IN ('error', 'signup', 'view') AND account IN ('1', '2', '3') AND region IN ('0', '1', '2') AND (contains(actor, 'u1') OR contains(actor, 'name2'))""",
)
def _(spark, sf_dir):
    got = sources.scan(_flat(spark, sf_dir), sources.ADAPTERS["cloudtrail"], "2024-01-03T00:00:00Z", "2024-01-20T12:00:00Z", ("error", "signup", "view"), ("1", "2", "3"), ("0", "1", "2"), ("u1", "name2"), scheme="ymd")
    return got.select("event_time", "event_name", "region", "account", "source_ip", "user_agent", schema.actor_of().alias("actor"))


@query(
    "ocsf_table_scan",
    f"""WITH {EVENTS_SQL} SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS event_time, event_name, region, account, source_ip, actor, CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END AS mfa_authenticated, CASE WHEN k % 4 = 0 THEN 'denied' END AS error_code FROM e
    WHERE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') BETWEEN '2024-01-05T00:00:00Z' AND '2024-01-09T00:00:00Z' AND event_name IN ('purchase', 'click')""",
)
def _(spark, sf_dir):
    f = _flat(spark, sf_dir)
    none = F.lit(None).cast("string")
    user = F.struct(F.lit("User").alias("type"), F.concat(F.lit("user/u"), F.regexp_extract("actor_username", r"\d+", 0)).alias("uid"), none.alias("name"))
    rows = f.select(
        F.col("ts").alias("time_dt"), F.struct(F.col("eventname").alias("operation"), F.struct(F.lit("svc").alias("name")).alias("service")).alias("api"), (F.col("k") % 5).cast("string").alias("region"), F.struct(F.col("sourceipaddress").alias("ip")).alias("src_endpoint"),
        F.struct(F.lit("agent").alias("user_agent")).alias("http_request"), F.struct(F.struct(F.col("recipientaccountid").alias("uid")).alias("account")).alias("cloud"), F.struct(user.alias("user")).alias("actor"), (F.col("k") % 2 == 0).alias("mfa"), F.when(F.col("k") % 4 == 0, "denied").alias("status_code"), "eventday",
    )
    got = sources.scan(rows, sources.ADAPTERS["security_lake"], "2024-01-05T00:00:00Z", "2024-01-09T00:00:00Z", ("purchase", "click"))
    return got.select("event_time", "event_name", "region", "account", "source_ip", schema.actor_of().alias("actor"), "mfa_authenticated", "error_code")


@query(
    "oldest_rows_scan",
    f"""WITH {EVENTS_SQL} SELECT event_time, event_name, CAST(year(ts) AS VARCHAR) || lpad(CAST(month(ts) AS VARCHAR), 2, '0') || lpad(CAST(day(ts) AS VARCHAR), 2, '0') AS day FROM e WHERE event_time BETWEEN '2024-01-03T00:00:00Z' AND '2024-01-05T00:00:00Z' AND event_name IN ('error', 'signup') ORDER BY event_time LIMIT 40""",
)
def _(spark, sf_dir):
    got = sources.scan(_flat(spark, sf_dir), sources.ADAPTERS["cloudtrail"], "2024-01-03T00:00:00Z", "2024-01-05T00:00:00Z", ("error", "signup"), row_cap=40, scheme="ymd")
    return got.select("event_time", "event_name", dates.compact_day(F.col("event_ts")).alias("day"))


@query(
    "embedded_events",
    f"""WITH {EVENTS_SQL} SELECT CASE WHEN k % 9 = 0 THEN event_name ELSE 'In' || event_name END AS event_name, CASE WHEN k % 9 = 0 THEN NULL ELSE event_time END AS event_time, account, CASE WHEN k % 9 = 0 OR k % 4 = 0 THEN 'r9' ELSE region END AS region, CASE WHEN k % 9 > 0 THEN actor ELSE '' END AS actor,
      CASE WHEN k % 9 > 0 AND k % 2 = 0 THEN 'AKIA' || k END AS minted_key_id FROM e""",
)
def _(spark, sf_dir):
    e, k = events(spark, sf_dir), F.col("source_ip").cast("int")
    inner = F.to_json(
        F.struct(
            F.col("row_id").alias("eventID"), F.col("event_time").alias("eventTime"), F.concat(F.lit("In"), "event_name").alias("eventName"), F.when(k % 4 == 0, "").otherwise(F.col("region")).alias("awsRegion"), F.struct(F.col("actor.arn").alias("arn")).alias("userIdentity"),
            F.when(k % 2 == 0, F.struct(F.struct(F.concat(F.lit("AKIA"), "source_ip").alias("accessKeyId"), F.lit("hidden").alias("secretAccessKey")).alias("credentials"))).alias("responseElements"),
        )
    )
    wrapped = e.select(F.when(k % 9 == 0, F.lit("{broken")).otherwise(inner).alias("event_json"), "event_name", "account", F.lit("r9").alias("region"))
    return sources.parse_embedded(wrapped).select("event_name", "event_time", "account", "region", schema.actor_of().alias("actor"), "minted_key_id")


# --- indicators -----------------------------------------------------------------------------------------------------------------


def _addressed(spark, sf_dir):
    """Events with IPv4 and IPv6 addresses, routable or not, and service names as their sources."""
    k = F.col("source_ip").cast("int")
    u = F.regexp_extract("actor.arn", r"\d+", 0).cast("int")
    text = lambda c: c.cast("string")
    ip = (
        F.when(k % 8 == 0, F.concat(F.lit("10."), text(k), F.lit(".0.1")))
        .when(k % 8 == 1, F.concat(F.lit("2001:DB8::"), text(k)))
        .when(k % 8 == 2, F.concat(F.lit("2600:1F18::"), text(k)))
        .when(k % 8 == 3, F.concat(F.lit("Svc"), text(k), F.lit(".Example.com")))
        .when(k % 8 == 4, F.lit("ec2.amazonaws.com"))
        .when(k % 8 == 5, F.concat(F.lit("203.0.113."), text(k)))
        .when(k % 8 == 6, F.lit(""))
        .otherwise(F.concat(F.lit("52."), text(k), F.lit("."), text(u % 5), F.lit(".9")))
    )
    return events(spark, sf_dir).withColumn("source_ip", ip)


_ADDRESSED = """
x AS (SELECT row_id, event_time, event_name, actor, CASE k % 8 WHEN 2 THEN 'ip' WHEN 3 THEN 'domain' WHEN 7 THEN 'ip' END AS kind, CASE k % 8 WHEN 2 THEN '2600:1f18::' || k WHEN 3 THEN 'svc' || k || '.example.com' WHEN 7 THEN '52.' || k || '.' || (user_id % 5) || '.9' END AS value FROM e),
ei AS (SELECT kind, value, arg_min(event_name || ' by ' || actor, (event_time, row_id)) AS context FROM x WHERE kind IS NOT NULL GROUP BY kind, value)
"""


@query("event_indicators", f"WITH {EVENTS_SQL}, {_ADDRESSED} SELECT * FROM ei")
def _(spark, sf_dir):
    return intel.event_indicators(_addressed(spark, sf_dir))


def _page_findings(spark, sf_dir):
    """``pages`` as findings: what their addresses name, and addresses in the action."""
    p, n = table(spark, sf_dir, "pages"), F.col("page_id").cast("string")
    action = F.to_json(F.struct(F.concat(F.lit("52."), (F.col("page_id") % 90).cast("string"), F.lit(".0.9")).alias("ipAddressV4")))
    md5 = F.when(F.col("page_id") % 3 == 0, F.md5(n)).otherwise(F.sha2(n, 256))
    return p.select(
        F.lpad(n, 12, "0").alias("finding_id"), F.concat(F.lit("Finding "), n).alias("title"), F.concat_ws(" ", "url", md5).alias("description"), F.when(F.col("page_id") % 5 == 0, "AttackSequence:X").otherwise("Recon:Y").alias("type"), action.alias("action"),
        (F.col("page_id") % 9 + 0.5).alias("severity"), (F.col("page_id") % 4).cast("string").alias("account"), F.lit("r1").alias("region"), F.when(F.col("page_id") % 7 == 0, F.array(F.lit("s"))).otherwise(F.array().cast("array<string>")).alias("signals"),
    )


_PAGE_FINDINGS = r"""
pf AS (SELECT printf('%012d', page_id) AS finding_id, 'Finding ' || page_id AS title, concat_ws(' ', url, CASE WHEN page_id % 3 = 0 THEN md5(CAST(page_id AS VARCHAR)) ELSE sha256(CAST(page_id AS VARCHAR)) END) AS description, page_id FROM pages),
pi AS (SELECT finding_id, title, 'domain' AS kind, lower(unnest(regexp_extract_all(description, '\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+(?:com|net|org|io|ru|cn|info|biz|top|xyz|club|online|site|tk|ml|ga|cf|gq|su|pw)\b'))) AS value FROM pf
  UNION ALL SELECT finding_id, title, 'ip', '52.' || (page_id % 90) || '.0.9' FROM pf
  UNION ALL SELECT finding_id, title, CASE WHEN page_id % 3 = 0 THEN 'md5' ELSE 'sha256' END, CASE WHEN page_id % 3 = 0 THEN md5(CAST(page_id AS VARCHAR)) ELSE sha256(CAST(page_id AS VARCHAR)) END FROM pf),
fi AS (SELECT kind, value, arg_min(title, finding_id) AS context FROM pi GROUP BY kind, value)
"""


@query("finding_indicators", f"WITH {_PAGE_FINDINGS} SELECT * FROM fi")
def _(spark, sf_dir):
    return intel.finding_indicators(_page_findings(spark, sf_dir))


_BOTH = "ai AS (SELECT kind, value, arg_max(context, src) AS context, max(src) AS source FROM (SELECT *, 'event' AS src FROM ei UNION ALL SELECT *, 'finding' FROM fi) GROUP BY kind, value)"


@query("all_indicators", f"WITH {EVENTS_SQL}, {_ADDRESSED}, {_PAGE_FINDINGS}, {_BOTH} SELECT kind, value, context, source FROM ai")
def _(spark, sf_dir):
    return intel.all_indicators(_addressed(spark, sf_dir), _page_findings(spark, sf_dir))


def _missing_feeds(spark, sf_dir):
    """Two feeds that know some of the addresses and many others: lines with commas and bars, comments, blanks and duplicates."""
    p, n = table(spark, sf_dir, "part"), F.col("p_partkey")
    text = lambda c: c.cast("string")
    ip = F.concat(F.lit("52."), text(n % 200), F.lit(".0.9"))
    bars = F.concat(ip, F.lit("|"), F.when(n % 3 == 0, "APT28 relay").otherwise("scanner"), F.lit("|"), text(n % 100))
    commas = F.concat(F.lit(" "), ip, F.lit(" , , bad ,,,, seen with Hidden Cobra"))
    one = p.select(F.when(n % 10 == 9, "# comment").when(n % 10 == 8, "  ").when(n % 10 == 7, "52.1.0.9 x|y|1").otherwise(bars).alias("line"), n.alias("at"))
    two = p.filter(n % 4 == 0).select(commas.alias("line"), n.alias("at"))
    return feeds.parse(one, "bars", "ip").union(feeds.parse(two, "commas", "ip"))


_MISSING = """
l1 AS (SELECT '52.' || (p_partkey % 200) || '.0.9' AS value, p_partkey AS pos, CASE WHEN p_partkey % 3 = 0 THEN 'APT28 relay' ELSE 'scanner' END AS category, p_partkey % 100 AS confidence, CASE WHEN p_partkey % 3 = 0 THEN 'APT28' END AS grp, 'bars' AS feed FROM part WHERE p_partkey % 10 < 7),
l2 AS (SELECT '52.' || (p_partkey % 200) || '.0.9' AS value, p_partkey AS pos, 'suspicious' AS category, 75 AS confidence, 'Lazarus Group' AS grp, 'commas' AS feed FROM part WHERE p_partkey % 4 = 0),
fd AS (SELECT feed, value, arg_max(category, pos) AS category, arg_max(confidence, pos) AS confidence, CASE WHEN feed = 'commas' THEN 'Lazarus Group' WHEN max(pos) % 3 = 0 THEN 'APT28' END AS grp FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2) GROUP BY feed, value)
"""


@query(
    "indicators_and_misses",
    f"""WITH {EVENTS_SQL}, {_ADDRESSED}, {_PAGE_FINDINGS}, {_BOTH}, {_MISSING} SELECT kind, ai.value, context, count(feed) > 0 AS malicious, CAST(max(confidence) AS INTEGER) AS confidence, coalesce(string_agg(DISTINCT grp, ',' ORDER BY grp), '') AS group_names,
      coalesce(string_agg(DISTINCT category, ',' ORDER BY category), '') AS categories, coalesce(string_agg(DISTINCT feed, ',' ORDER BY feed), '') AS feeds FROM ai LEFT JOIN fd ON kind = 'ip' AND fd.value = ai.value GROUP BY kind, ai.value, context""",
)
def _(spark, sf_dir):
    found = intel.enrich(intel.all_indicators(_addressed(spark, sf_dir), _page_findings(spark, sf_dir)), _missing_feeds(spark, sf_dir))
    return found.select("kind", "value", "context", "malicious", "confidence", *joined("group_names", "categories", "feeds"))


@query("attributed_groups", f"WITH {EVENTS_SQL}, {_ADDRESSED}, {_PAGE_FINDINGS}, {_BOTH}, {_MISSING} SELECT DISTINCT grp AS group_name FROM ai JOIN fd ON kind = 'ip' AND fd.value = ai.value WHERE grp IS NOT NULL")
def _(spark, sf_dir):
    return intel.attributed_groups(intel.enrich(intel.all_indicators(_addressed(spark, sf_dir), _page_findings(spark, sf_dir)), _missing_feeds(spark, sf_dir)))


@query("indicator_lookup", f"WITH {_MISSING} SELECT feed, value AS indicator, CAST(confidence AS INTEGER) AS confidence, category FROM fd WHERE value = '52.12.0.9'")
def _(spark, sf_dir):
    return intel.lookup(_missing_feeds(spark, sf_dir), "52.12.0.9").select("feed", "indicator", "confidence", "category")


@query("routable_addresses", "SELECT a || '.' || b || '.' || c || '.' || d AS address, NOT (a IN (0, 10, 127) OR a >= 224 OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 192 AND b = 0 AND c = 2) OR (a = 192 AND b = 0 AND c = 0 AND (d < 8 OR d IN (170, 171))) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113)) AS routable FROM (SELECT o_orderkey * 7 % 256 AS a, o_orderkey * 31 % 256 AS b, o_orderkey % 120 AS c, o_orderkey * 3 % 256 AS d FROM orders)")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    ip = F.concat_ws(".", *[x.cast("string") for x in (k * 7 % 256, k * 31 % 256, k % 120, k * 3 % 256)])
    return o.select(ip.alias("address")).withColumn("routable", intel.routable_ipv4(F.col("address")))


# --- findings -------------------------------------------------------------------------------------------------------------------


@query(
    "findings_summary",
    f"WITH {_PAGE_FINDINGS} SELECT 'Recon:Y' AS type, page_id % 9 + CAST(0.5 AS DOUBLE) AS severity, title, CAST(page_id % 4 AS VARCHAR) AS account, 'r1' AS region FROM pf WHERE page_id % 5 <> 0 AND page_id % 7 <> 0",
)
def _(spark, sf_dir):
    return correlate.findings_summary(_page_findings(spark, sf_dir))


@query("findings_split", "SELECT CASE WHEN page_id % 5 = 0 OR page_id % 7 = 0 THEN 'sequence' ELSE 'finding' END AS part, count(*) AS n FROM pages GROUP BY 1")
def _(spark, sf_dir):
    single, sequences = correlate.split_findings(_page_findings(spark, sf_dir))
    return sequences.select(F.lit("sequence").alias("part")).union(single.select(F.lit("finding").alias("part"))).groupBy("part").agg(F.count("*").alias("n"))


# --- live state, reachability, containment --------------------------------------------------------------------------------------


def _live_state(spark, sf_dir):
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    k = F.col("s_suppkey")
    account = F.col("s_nationkey").cast("string")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (k % 60).cast("int")).cast("timestamp")
    users = s.select(account.alias("account"), F.col("s_name").alias("user_name"), day.alias("create_date"))
    keys = c.select(F.col("c_nationkey").cast("string").alias("account"), F.concat(F.lit("u"), (F.col("c_custkey") % 40).cast("string")).alias("user_name"), F.col("c_custkey").cast("string").alias("access_key_id"), F.when(F.col("c_custkey") % 3 == 0, "Active").otherwise("Inactive").alias("status"))
    roles = s.select(account.alias("account"), F.col("s_name").alias("role_name"), F.when(k % 6 == 0, '{"Statement": [{"Effect": "Allow", "Principal": {"AWS": "*"}}]}').otherwise('{"Statement": []}').alias("trust_policy"))
    stamp = F.when(k % 5 == 0, "no time").otherwise(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    functions = s.select(account.alias("account"), (k % 3).cast("string").alias("region"), F.concat(F.lit("fn"), k.cast("string")).alias("function_name"), stamp.alias("last_modified"))
    return hunt.hunt_state(users, keys, roles, functions, "2024-02-10T00:00:00Z")


_LIVE = """
s AS (SELECT *, CAST(s_nationkey AS VARCHAR) AS account, DATE '2024-01-01' + CAST(s_suppkey % 60 AS INTEGER) AS d FROM supplier),
ls AS (SELECT 'iam_backdoor' AS mechanism, 'T1136.003' AS technique, 'high' AS severity, account, 'global' AS region, s_name AS resource, 'IAM user created recently: ' || s_name AS detail FROM s WHERE d >= DATE '2024-02-10'
  UNION ALL SELECT 'iam_backdoor', 'T1098.001', 'high', account, 'global', name, n || ' active access keys' FROM (SELECT CAST(c_nationkey AS VARCHAR) AS account, 'u' || (c_custkey % 40) AS name, count(*) FILTER (c_custkey % 3 = 0) AS n FROM customer GROUP BY ALL) WHERE n > 1
  UNION ALL SELECT 'role_trust_modification', 'T1098.003', 'critical', account, 'global', s_name, 'role trusts external principal(s): *' FROM s WHERE s_suppkey % 6 = 0
  UNION ALL SELECT 'lambda_persistence', 'T1546', 'medium', account, CAST(s_suppkey % 3 AS VARCHAR), 'fn' || s_suppkey, 'function modified recently: fn' || s_suppkey FROM s WHERE s_suppkey % 5 <> 0 AND d >= DATE '2024-02-10')
"""


@query("live_state", f"WITH {_LIVE} SELECT * FROM ls")
def _(spark, sf_dir):
    return _live_state(spark, sf_dir).select("mechanism", "technique", "severity", "account", "region", "resource", "detail")


@query(
    "containment_steps",
    f"""WITH {EVENTS_SQL}, {_LIVE}, a AS (SELECT DISTINCT user_id AS u FROM e), w AS (SELECT CASE u % 3 WHEN 0 THEN 'arn:aws:iam::1:user/u' WHEN 1 THEN 'arn:aws:sts::1:assumed-role/r/u' ELSE 'svc' END || u AS who, u % 3 AS m FROM a)
    SELECT 'immediate' AS term, unnest(CASE m WHEN 0 THEN ['deactivate access keys', 'attach deny-all policy'] WHEN 1 THEN ['revoke active sessions'] ELSE [] END) AS action, who AS target FROM w
    UNION SELECT 'immediate', 're-enable logging', 'trail' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0
    UNION SELECT 'short_term', CASE mechanism WHEN 'role_trust_modification' THEN 'review trust policy' ELSE 'review identity' END, resource FROM ls WHERE severity IN ('critical', 'high')""",
)
def _(spark, sf_dir):
    u = F.regexp_extract("actor", r"\d+", 0)
    m = u.cast("int") % 3
    who = events(spark, sf_dir).select(F.col("actor.arn").alias("actor")).distinct()
    who = who.select(F.concat(F.when(m == 0, "arn:aws:iam::1:user/u").when(m == 1, "arn:aws:sts::1:assumed-role/r/u").otherwise("svc"), u).alias("actor"))
    gaps = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 2 == 0).alias("still_open"), F.concat(F.lit("trail"), F.col("s_suppkey").cast("string")).alias("resource"))
    return timeline.containment(who, gaps, _live_state(spark, sf_dir))


@query(
    "reachability",
    """SELECT CAST(s_suppkey AS VARCHAR) AS account, 'arn:aws-us-gov:iam::' || s_suppkey || ':role/Reader' AS role_arn, CASE s_suppkey % 6 WHEN 0 THEN 'access_denied' WHEN 1 THEN 'not_found' WHEN 2 THEN 'throttled' WHEN 3 THEN 'other' END AS error_kind FROM supplier WHERE s_suppkey % 4 <> 3""",
)
def _(spark, sf_dir):
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    accounts = s.select(k.cast("string").alias("account"), F.when(k % 4 == 3, "SUSPENDED").otherwise("ACTIVE").alias("status"), F.when(k % 6 == 0, "AccessDeniedException").when(k % 6 == 1, "NoSuchEntity").when(k % 6 == 2, "ThrottlingException").when(k % 6 == 3, "Boom").alias("message"))
    return landscape.active_accounts(accounts).select("account", landscape.role_arn(F.col("account"), "Reader", "aws-us-gov").alias("role_arn"), landscape.error_kind(F.col("message")).alias("error_kind"))


# --- actors, timelines, tools ---------------------------------------------------------------------------------------------------


@query(
    "timeline_rows",
    f"""WITH {EVENTS_SQL} SELECT event_name || ' by u' || user_id || ' from ' || source_ip AS message, event_time AS datetime, 'CloudTrail Event Time' AS timestamp_desc, event_name, CAST(NULL AS VARCHAR) AS event_source, actor, CAST(NULL AS VARCHAR) AS actor_type, account, region, source_ip,
      CASE WHEN k < 10 THEN 'terraform/1.0' ELSE 'console' END AS user_agent, CASE WHEN k % 2 = 0 THEN 'false' ELSE 'true' END AS mfa, CAST(NULL AS VARCHAR) AS error_code, CAST(NULL AS BIGINT) AS repeat_count, CASE WHEN event_name = 'error' THEN 'logging_disabled' ELSE '' END AS tag FROM e""",
)
def _(spark, sf_dir):
    e = events(spark, sf_dir)
    tagged = e.filter(F.col("event_name") == "error").select(F.col("actor.arn").alias("actor"), F.col("event_time").alias("time"), F.lit("logging_disabled").alias("tag")).distinct()
    return timeline.timeline(e, tagged)


_SESSION_COUNTS = "s AS (SELECT printf('K%010d', o_orderkey) AS key, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)"


@query("actor_detail", f"WITH {EVENTS_SQL}, m AS (SELECT *, count(*) OVER () AS event_count, row_number() OVER (ORDER BY event_time, row_id) AS place FROM e WHERE contains(actor, 'user/u1')) SELECT event_count, place, event_time, event_name, actor FROM m WHERE place <= 60")
def _(spark, sf_dir):
    return timeline.actor_detail(events(spark, sf_dir), "user/u1").select("event_count", "place", "event_time", "event_name", "actor")


@query("busiest_actors", f"WITH {EVENTS_SQL} SELECT actor, count(*) AS event_count, min(event_time) AS first_seen FROM e GROUP BY actor ORDER BY event_count DESC, first_seen LIMIT 12")
def _(spark, sf_dir):
    return correlate.by_count(correlate.timelines(events(spark, sf_dir))).select("actor", "event_count", "first_seen").limit(12)


_EXPOSED = {"purchase": "AuthorizeSecurityGroupIngress", "error": "DeleteObjects", "signup": "PutBucketVersioning", "view": "Decrypt", "click": "DescribeInstances"}


@query(
    "tamper_patterns",
    f"""WITH {EVENTS_SQL}, n AS (SELECT actor, count(*) FILTER (event_name = 'purchase') AS exposed, count(*) FILTER (event_name = 'error') AS deletes, count(*) FILTER (event_name = 'signup') AS tamper FROM e GROUP BY actor)
    SELECT actor, 'resource_exposure' AS pattern, 'T1562.007' AS technique, 'high' AS severity, exposed || ' exposure-related change(s)' AS detail FROM n WHERE exposed >= 3
    UNION ALL SELECT actor, 's3_ransomware_indicator', 'T1485', 'critical', deletes || ' delete calls, ' || tamper || ' lifecycle/versioning changes' FROM n WHERE deletes >= 20 OR (deletes > 0 AND tamper > 0)""",
)
def _(spark, sf_dir):
    found = correlate.attack_patterns(events(spark, sf_dir, _EXPOSED))
    return found.filter(F.col("pattern").isin("resource_exposure", "s3_ransomware_indicator")).select("actor", "pattern", "technique", "severity", "detail")


@query("busiest_sessions", f"WITH {_SESSION_COUNTS} SELECT key, n AS action_count FROM s ORDER BY n DESC, key LIMIT 8")
def _(spark, sf_dir):
    from emberlog.plans.views import order_sessions

    return correlate.by_actions(correlate.session_chains(order_sessions(spark, sf_dir))).select("key", "action_count").limit(8)


@query("brief_events", f"WITH {EVENTS_SQL} SELECT event_time, event_name, actor, account, region, source_ip, CAST(NULL AS VARCHAR) AS error_code, CAST(NULL AS BIGINT) AS repeat_count FROM e WHERE event_name = 'signup'")
def _(spark, sf_dir):
    return timeline.brief_rows(timeline.matching(events(spark, sf_dir), ("signup",)))


@query(
    "actor_names",
    f"""WITH {EVENTS_SQL}, a AS (SELECT row_id, CASE k % 5 WHEN 0 THEN 'arn:aws:iam::1:user/path/u' || user_id WHEN 1 THEN 'arn:aws:sts::1:assumed-role/r' || user_id || '/s' WHEN 2 THEN 'arn:aws:iam::1:role/r' || user_id WHEN 3 THEN '' ELSE 'svc' || user_id END AS a, k % 5 AS m, user_id FROM e)
    SELECT row_id, CASE m WHEN 0 THEN 'u' || user_id WHEN 1 THEN 's' WHEN 2 THEN 'r' || user_id WHEN 3 THEN 'unknown principal' ELSE a END AS short, CASE m WHEN 0 THEN 'user' WHEN 1 THEN 'role' WHEN 2 THEN 'role' ELSE 'unknown' END AS kind, CASE m WHEN 0 THEN 'u' || user_id WHEN 1 THEN 'r' || user_id WHEN 2 THEN 'r' || user_id ELSE a END AS name FROM a""",
)
def _(spark, sf_dir):
    m, u = F.col("source_ip").cast("int") % 5, F.regexp_extract("actor.arn", r"\d+", 0)
    arn = F.when(m == 0, F.concat(F.lit("arn:aws:iam::1:user/path/u"), u)).when(m == 1, F.concat(F.lit("arn:aws:sts::1:assumed-role/r"), u, F.lit("/s"))).when(m == 2, F.concat(F.lit("arn:aws:iam::1:role/r"), u)).when(m == 3, "").otherwise(F.concat(F.lit("svc"), u))
    rows = events(spark, sf_dir).select("row_id", arn.alias("arn"))
    return rows.select("row_id", schema.short_name(F.col("arn")).alias("short"), schema.arn_parts(F.col("arn")).alias("p")).select("row_id", "short", "p.kind", "p.name")


@query(
    "event_resources",
    f"""WITH {EVENTS_SQL} SELECT row_id, CASE k % 5 WHEN 0 THEN 'n' || k WHEN 1 THEN 't' || k WHEN 2 THEN 'd' || k ELSE 'unknown' END AS gap_resource, CASE k % 5 WHEN 0 THEN 'n' || k WHEN 3 THEN 'role' || k END AS target FROM e""",
)
def _(spark, sf_dir):
    k = F.col("source_ip")
    m = k.cast("int") % 5
    member = lambda name, v: F.concat(F.lit(f'{{"x": 1, "{name}": "{v}'), k, F.lit('"}'))
    params = F.when(m == 0, member("name", "n")).when(m == 1, member("trailName", "t")).when(m == 2, member("detectorId", "d")).when(m == 3, member("roleName", "role")).otherwise("not json")
    e = events(spark, sf_dir).withColumn("request_params", params)
    return e.select("row_id", correlate.gap_resource().alias("gap_resource"), schema.first_param("request_params", hunt.TARGETS).alias("target"))


@query(
    "session_lookup",
    "SELECT printf('K%010d', o_orderkey) AS key, 'customer/' || o_custkey AS assumed_by FROM orders WHERE starts_with(printf('K%010d', o_orderkey), 'K0000000') ORDER BY 1 LIMIT 1",
)
def _(spark, sf_dir):
    from emberlog.plans.views import order_sessions

    return timeline.session_detail(correlate.session_chains(order_sessions(spark, sf_dir)), "K0000000123").select("key", "assumed_by")


@query("permissions_lookup", "SELECT 'arn:policy/' || (s_suppkey % 6) AS policy_arn, s_suppkey % 2 = 0 AS inline FROM supplier WHERE s_suppkey % 9 = 4 AND s_suppkey % 2 = 0")
def _(spark, sf_dir):
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    attached = s.select(F.when(k % 2 == 0, "user").otherwise("role").alias("kind"), F.concat(F.lit("p"), (k % 9).cast("string")).alias("name"), F.concat(F.lit("arn:policy/"), (k % 6).cast("string")).alias("policy_arn"), (k % 2 == 0).alias("inline"))
    return hunt.principal_permissions(attached, "user", "p4")


@query("effort_levels", "SELECT p_partkey AS step, CAST(greatest(1, least(5, round(CAST(CASE WHEN contains(p_name, 'ring') THEN 2 WHEN contains(p_name, 'small') THEN 4 ELSE 3 END AS DOUBLE) * CAST(1.4 AS DOUBLE)))) AS INTEGER) AS level FROM part")
def _(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("step"), scoring.effort_level(F.col("p_name"), (("RING", 2), ("small", 4)), 1.4).alias("level"))


# --- redaction ------------------------------------------------------------------------------------------------------------------


def _secrets(spark, sf_dir):
    """JSON texts that hold ARNs, keys, accounts, addresses, buckets and bare names, in values and in keys."""
    c, k = dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey"), F.col("c_custkey")
    text = lambda x: x.cast("string")
    who = F.concat(F.lit("svc-prod-eu-west-1-data-platform-etl-job-"), text(k % 50))
    account, key = F.lpad(text(F.col("c_nationkey")), 12, "0"), F.concat(F.lit("AKIA"), F.lpad(text(k % 30), 16, "0"))
    arn = F.concat(F.lit("arn:aws:iam::"), account, F.lit(":user/"), who)
    obj = F.to_json(F.struct(F.struct(F.when(k % 2 == 0, arn).alias("arn"), F.when(k % 2 == 1, who).alias("userName")).alias("userIdentity"), key.alias("key"), F.concat(F.lit("10.0.0."), text(k % 9)).alias("inner"), F.concat(F.lit("8.8.4."), text(k % 7)).alias("outer")))
    said = F.concat(F.lit('{"said": "login by '), who, F.lit(" in "), account, F.lit('", "'), key, F.lit('": {"bucket": "b'), text(k % 5), F.lit('-data"}}'))
    return stored(redact.plain_json(c.select("c_custkey", F.when(k % 3 == 0, said).otherwise(obj).alias("text")), "text"), "secrets")


_TOKENED = """
t AS (SELECT c_custkey, c_custkey % 3 = 0 AS said, 'svc-prod-eu-west-1-data-platform-etl-job-' || (c_custkey % 50) AS who, printf('%012d', c_nationkey) AS account, 'AKIA' || lpad(CAST(c_custkey % 30 AS VARCHAR), 16, '0') AS key, c_custkey % 9 AS inr, c_custkey % 7 AS outr, c_custkey % 5 AS b, c_custkey % 2 = 0 AS even FROM customer)
"""


def _tokens(rows):
    return redact.mapping(rows, "text", redact.harvested(rows, "text"))


@query(
    "redacted_texts",
    f"""WITH {_TOKENED} SELECT c_custkey, CASE WHEN said THEN '{{"KEY-N":{{"bucket":"BUCKET-N"}},"said":"login by PRINCIPAL-N in ACCOUNT-N"}}' ELSE '{{"inner":"IP-PRIVATE-N","key":"KEY-N","outer":"IP-N","userIdentity":{{' || CASE WHEN even THEN '"arn":"PRINCIPAL-N"' ELSE '"userName":"PRINCIPAL-N"' END || '}}}}' END AS shape FROM t""",
)
def _(spark, sf_dir):
    rows = _secrets(spark, sf_dir)
    return redact.redact_json(rows, "c_custkey", "text", _tokens(rows)).select("c_custkey", F.regexp_replace("text", r"-\d+", "-N").alias("shape"))


@query(
    "redaction_tokens",
    f"""WITH {_TOKENED}, v AS (SELECT who AS value, 'PRINCIPAL' AS kind, who AS owner FROM t UNION ALL SELECT 'arn:aws:iam::' || account || ':user/' || who, 'PRINCIPAL', 'arn:aws:iam::' || account || ':user/' || who FROM t WHERE NOT said AND even
      UNION ALL SELECT key, 'KEY', key FROM t UNION ALL SELECT account, 'ACCOUNT', account FROM t WHERE said UNION ALL SELECT '10.0.0.' || inr, 'IP-PRIVATE', '10.0.0.' || inr FROM t WHERE NOT said UNION ALL SELECT '8.8.4.' || outr, 'IP', '8.8.4.' || outr FROM t WHERE NOT said UNION ALL SELECT 'b' || b || '-data', 'BUCKET', 'b' || b || '-data' FROM t WHERE said),
    o AS (SELECT who AS name, min('arn:aws:iam::' || account || ':user/' || who) AS arn FROM t WHERE NOT said AND even GROUP BY who),
    h AS (SELECT DISTINCT who AS name FROM t WHERE NOT said AND NOT even),
    n AS (SELECT DISTINCT v.value, v.kind, CASE WHEN v.value = o2.name THEN o2.arn WHEN o1.name IS NOT NULL THEN o1.arn ELSE v.owner END AS owner FROM v LEFT JOIN o o2 ON v.value = o2.name LEFT JOIN o o1 ON v.kind = 'PRINCIPAL' AND starts_with(v.value, 'arn:') AND v.value LIKE '%:user/' || o1.name WHERE v.kind <> 'PRINCIPAL' OR starts_with(v.value, 'arn:') OR o2.name IS NOT NULL OR v.value IN (SELECT name FROM h))
    SELECT kind, count(DISTINCT owner) AS n, count(*) AS identifiers, count(DISTINCT owner) AS highest FROM n GROUP BY kind""",
)
def _(spark, sf_dir):
    tokens = _tokens(_secrets(spark, sf_dir))
    facts = tokens.groupBy("kind").agg(F.count("*").alias("identifiers"), F.max(F.regexp_extract("token", r"(\d+)$", 1).cast("bigint")).alias("highest"))
    return redact.mapping_summary(tokens).join(facts, "kind").select("kind", "n", "identifiers", "highest")


@query(
    "redaction_restored",
    f"""WITH {_TOKENED}, o AS (SELECT who, min('arn:aws:iam::' || account || ':user/' || who) AS arn FROM t WHERE NOT said AND even GROUP BY who), b AS (SELECT t.*, coalesce(o.arn, t.who) AS owner FROM t LEFT JOIN o USING (who))
    SELECT c_custkey, CASE WHEN said THEN '{{"' || key || '":{{"bucket":"b' || b || '-data"}},"said":"login by ' || owner || ' in ' || account || '"}}' ELSE '{{"inner":"10.0.0.' || inr || '","key":"' || key || '","outer":"8.8.4.' || outr || '","userIdentity":{{' || CASE WHEN even THEN '"arn":"' || owner || '"' ELSE '"userName":"' || owner || '"' END || '}}}}' END AS text FROM b""",
)
def _(spark, sf_dir):
    """Every text comes back, a bare name as the ARN whose token it shares."""
    rows = _secrets(spark, sf_dir)
    tokens = _tokens(rows)
    # restore reads its rows twice, so that the plan would hold the whole redaction twice
    hidden = stored(redact.redact_json(rows, "c_custkey", "text", tokens), "redacted")
    return redact.restore(hidden, "c_custkey", "text", tokens).select("c_custkey", "text")
