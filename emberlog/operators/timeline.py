"""The tagged timeline, hashed evidence bundles, and short texts over small results."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.functions.shared import placed
from emberlog.operators import merkle
from emberlog.schema import filled, short_name

# The columns of the export, and below the tags.
COLUMNS = ("message", "datetime", "timestamp_desc", "event_name", "event_source", "actor", "actor_type", "account", "region", "source_ip", "user_agent", "mfa", "error_code", "repeat_count", "tag")


def tags(chains: DataFrame, gaps: DataFrame, pivots: DataFrame, sessions: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """(actor, time, tag): of several tags for one key, that of the later source stands.

    steps: of ``escalation_steps``, for chains that have more than they list.

    Sources in order: the chains by access time, each start before its steps, then gaps, pivots and sessions.
    """
    row = lambda df, actor, time, tag, phase, order: df.select(F.col(actor).alias("actor"), F.col(time).alias("time"), F.lit(tag).alias("tag"), F.struct(F.lit(phase).alias("phase"), order.cast("string").alias("at"), F.lit(tag).alias("kind")).alias("ord"))
    steps = steps if steps is not None else chains.select("actor", "access_time", F.explode("escalation_events.time").alias("time"))
    found = [
        row(chains, "actor", "access_time", "escalation_chain_start", 1, F.concat("access_time", F.lit(" 0"))),
        row(steps, "actor", "time", "escalation", 1, F.concat("access_time", F.lit(" 1"))),
        row(gaps, "disabled_by", "start", "logging_disabled", 2, F.concat("start", F.lit(" 0"))),
        row(gaps.filter(~F.col("still_open")), "disabled_by", "end", "logging_restored", 2, F.concat("start", F.lit(" 1"))),
        row(pivots, "actor", "time", "cross_account_pivot", 3, F.lit("")),
        row(sessions, "assumed_by", "assumed_at", "session_start", 4, F.lit("")),
    ]
    every = found[0]
    for f in found[1:]:
        every = every.union(f)
    return every.groupBy("actor", "time").agg(F.max_by("tag", "ord").alias("tag"))


def timeline(events: DataFrame, tagged: DataFrame) -> DataFrame:
    """One row for each event, with the tag of its actor and time."""
    who = filled(F.col("actor.arn"), F.col("actor.user_name"))
    brief = F.when(who == "", "").otherwise(short_name(who))
    rows = events.select(
        F.concat(F.coalesce("event_name", F.lit("None")), F.lit(" by "), brief, F.lit(" from "), F.coalesce("source_ip", F.lit("?"))).alias("message"),
        F.coalesce("event_time", F.lit("")).alias("datetime"), F.lit("CloudTrail Event Time").alias("timestamp_desc"), "event_name", "event_source", who.alias("actor"),
        F.col("actor.type").alias("actor_type"), "account", "region", "source_ip", "user_agent", F.col("mfa_authenticated").alias("mfa"), "error_code", "repeat_count",
    )
    t = tagged.select(F.col("actor").alias("__a"), F.col("time").alias("__t"), "tag")
    return rows.join(t, (F.col("actor") == F.col("__a")) & (F.col("datetime") == F.col("__t")), "left").withColumn("tag", F.coalesce("tag", F.lit(""))).select(*COLUMNS)


def export(rows: DataFrame, path: str, fmt: str = "csv") -> None:
    """Writes a timeline in time order, as CSV with a header or as JSON lines; parts are ranges of time."""
    out = rows.orderBy("datetime").write.mode("overwrite")
    out.option("header", True).csv(path) if fmt == "csv" else out.json(path)


def case_id(text: str) -> str:
    """A name that is safe as a folder: no separators or parent steps, 128 characters at most."""
    if any(x in text for x in ("/", "\\", "..")):
        raise ValueError(f"unsafe case id: {text!r}")
    name = re.sub(r"[^A-Za-z0-9._-]", "_", text).strip("._")[:128]
    if not name:
        raise ValueError("empty case id")
    return name


def preserve(artifacts: dict[str, DataFrame], folder: str, case: str, rows_in_file: int = 500_000) -> DataFrame:
    """Writes every artifact as JSON lines under the case, and a manifest of hash trees over the lines; returns the manifest: (artifact, level, node, n, sha256).

    Lines carry their number (``_row``), so that a block is the same rows whatever file they lie in; neither files nor artifacts are ever read as one value.
    """
    root = _case_root(folder, case)
    for name, df in artifacts.items():
        if "_row" in df.columns:
            raise ValueError(f"artifact {name!r} has a column _row")
        placed(df).select(F.col("place").alias("_row"), *[F.col(f"`{c}`") for c in df.columns]).write.mode("overwrite").option("maxRecordsPerFile", rows_in_file).json(f"{root}/artifacts/{name}")
    spark = next(iter(artifacts.values())).sparkSession
    merkle.grown(_blocks(spark, root), ["artifact"]).write.mode("overwrite").json(f"{root}/manifest")
    return _manifest(spark, root)


def _case_root(folder: str, case: str) -> str:
    return str(PurePosixPath(folder) / case_id(case)) if "://" not in folder else f"{folder.rstrip('/')}/{case_id(case)}"


def _manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("artifact string, level int, node bigint, n bigint, sha256 string").json(f"{root}/manifest")


def _artifact(path: Column) -> Column:
    return F.regexp_extract(path, r"/artifacts/([^/]+)/", 1)


def _blocks(spark: SparkSession, root: str) -> DataFrame:
    """The blocks of lines of all artifacts; lines without a number are in no block."""
    lines = spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("pathGlobFilter", "part-*").text(f"{root}/artifacts")
    rows = lines.select(_artifact(F.col("_metadata.file_path")).alias("artifact"), F.get_json_object("value", "$._row").try_cast("bigint").alias("place"), F.sha2("value", 256).alias("digest"))
    return merkle.leaves(rows.filter("place IS NOT NULL"), "place", "digest", ["artifact"])


def verify(spark: SparkSession, folder: str, case: str) -> DataFrame:
    """(artifact, block, first_row, last_row, state): OK, MODIFIED, MISSING or ADDED for every block of lines.

    Blocks whose hashes differ are found from the root of each artifact's tree down.  A block that is gone counts as missing where no file of its artifact is left, else as modified.
    """
    root = _case_root(folder, case)
    listed = _manifest(spark, root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{root}/artifacts")  # no contents are read
    there = files.select(_artifact(F.col("path")).alias("artifact")).distinct().withColumn("there", F.lit(True))
    found = merkle.changes(listed, merkle.grown(_blocks(spark, root), ["artifact"]), ["artifact"])
    found = found.join(there, "artifact", "left").select("artifact", "node", F.when((F.col("state") == "MISSING") & F.col("there"), "MODIFIED").otherwise(F.col("state")).alias("state"))
    blocks = listed.filter("level = 0").select("artifact", "node").join(found, ["artifact", "node"], "full_outer")
    return blocks.select("artifact", F.col("node").alias("block"), (F.col("node") * merkle.BLOCK).alias("first_row"), ((F.col("node") + 1) * merkle.BLOCK - 1).alias("last_row"), F.coalesce("state", F.lit("OK")).alias("state"))


def row_hashes(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, sha256) of the columns of each row joined by bars."""
    return rows.select(key, F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256).alias("sha256"))


def containment(principals: DataFrame, gaps: DataFrame, findings: DataFrame) -> DataFrame:
    """(term, action, target): what to do at once and soon, by rules over the results."""
    kind = F.when(F.col("actor").contains(":user/"), "user").when(F.col("actor").rlike(":(assumed-)?role/"), "role").otherwise("unknown")
    act = lambda t, a, c: F.struct(F.lit(t).alias("term"), F.lit(a).alias("action"), c.alias("target"))
    who = principals.withColumn("kind", kind).select(
        F.explode(
            F.when(F.col("kind") == "user", F.array(act("immediate", "deactivate access keys", F.col("actor")), act("immediate", "attach deny-all policy", F.col("actor"))))
            .when(F.col("kind") == "role", F.array(act("immediate", "revoke active sessions", F.col("actor"))))
            .otherwise(F.array().cast("array<struct<term:string,action:string,target:string>>"))
        ).alias("x")
    ).select("x.*")
    dark = gaps.filter("still_open").select(F.lit("immediate").alias("term"), F.lit("re-enable logging").alias("action"), F.col("resource").alias("target"))
    severe = findings.filter(F.col("severity").isin("critical", "high"))
    m = F.col("mechanism")
    what = F.when(m == "role_trust_modification", "review trust policy").when(m == "lambda_persistence", "review function code and triggers").when((m == "iam_backdoor") & (F.col("source") == "state"), "review identity").when(m == "mfa_removal", "re-enroll MFA")
    soon = severe.withColumn("action", what).filter("action IS NOT NULL").select(F.when(m == "mfa_removal", "immediate").otherwise("short_term").alias("term"), "action", F.coalesce("resource", "actor").alias("target"))
    return who.union(dark).union(soon).distinct()


def oxford(items: Sequence[str]) -> str:
    items = [str(i) for i in items]
    return items[0] if len(items) == 1 else " and ".join(items) if len(items) == 2 else ", ".join(items[:-1]) + f", and {items[-1]}" if items else ""


def report(title: str, sections: Iterable[tuple[str, DataFrame]], limit: int = 50) -> str:
    """A Markdown report of small tables; empty ones are left out."""
    out = [f"# {title}"]
    for head, df in sections:
        rows = df.limit(limit).collect()
        if rows:
            cells = lambda r: " | ".join("" if v is None else json.dumps(v, default=str) if isinstance(v, (list, dict)) else str(v) for v in r)
            out += [f"\n## {head}\n", "| " + " | ".join(df.columns) + " |", "|" + " - |" * len(df.columns), *[f"| {cells(r)} |" for r in rows]]
    return "\n".join(out) + "\n"


def brief(counts: dict[str, int]) -> str:
    """At most five sentences out of the summary's counts."""
    said = [
        (counts.get("logging_gaps", 0), "{n} window(s) without logging were found"),
        (counts.get("escalation_chains", 0), "{n} access event(s) led to privilege escalation"),
        (counts.get("attack_patterns", 0), "{n} known attack pattern(s) match"),
        (counts.get("persistence", 0), "{n} persistence finding(s) need review"),
    ]
    lines = [f"The window holds {counts.get('events', 0)} events by {counts.get('actors', 0)} actors.", *[t.format(n=n) + "." for n, t in said if n]]
    return " ".join(lines[:5])


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def matching(events: DataFrame, names: Sequence[str] = (), actor_part: str = "", after: str = "", before: str = "") -> DataFrame:
    """Events by names, part of the actor, and times as text; count it for the true number, limit it for a page."""
    out = events
    if names:
        out = out.filter(F.col("event_name").isin(*names))
    if actor_part:
        out = out.filter(filled(F.col("actor.arn"), F.col("actor.user_name")).contains(actor_part))
    for bound, cond in ((after, F.col("event_time") >= after), (before, F.col("event_time") <= before)):
        if bound:
            out = out.filter(cond)
    return out


def actor_detail(events: DataFrame, actor_part: str, listed: int = 60) -> DataFrame:
    """(event_count, place, ...): the first events of the matching actors in time order, with the number of all."""
    found = brief_rows(matching(events, actor_part=actor_part), "row_id")
    count = found.agg(F.count("*").alias("event_count"))
    first = found.orderBy(F.coalesce("event_time", F.lit("")), "row_id").limit(listed)  # so few that one task numbers them
    place = F.row_number().over(Window.orderBy(F.coalesce("event_time", F.lit("")), "row_id")).cast("bigint")
    return first.withColumn("place", place).crossJoin(count).drop("row_id")


def brief_rows(events: DataFrame, *more: str) -> DataFrame:
    """Events in eight columns."""
    return events.select("event_time", "event_name", filled(F.col("actor.arn"), F.col("actor.user_name")).alias("actor"), "account", "region", "source_ip", "error_code", "repeat_count", *more)


def session_detail(sessions: DataFrame, key: str) -> DataFrame:
    return sessions.filter(F.col("key").startswith(key[:8])).orderBy("key").limit(1)


def in_words(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 3), F.lit("..."))).otherwise(c)
