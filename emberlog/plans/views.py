"""The driver's tables read as canonical events, findings and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: DuckDB's reading of the same.
EVENTS_SQL = """
e AS (SELECT printf('%012d', event_id) AS row_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS event_time, ts, event_type AS event_name, user_id,
  'user/u' || user_id AS actor, CAST(user_id % 7 AS VARCHAR) AS account, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k,
  CAST(CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 5 AS VARCHAR) AS region, regexp_extract(props, '[0-9]+') AS source_ip FROM events)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by keys to four tasks a core: a table that compresses well has few splits, however much work its rows are."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def events(spark: SparkSession, sf_dir: str, names: dict[str, str] | None = None, deal: bool = False) -> DataFrame:
    """``events`` as canonical events; ``names`` maps event types to API names, ``deal`` deals the rows over all cores."""
    e = table(spark, sf_dir, "events")
    e = dealt(e, "event_id") if deal else e
    k = F.get_json_object("props", "$.k").cast("int")
    name = F.coalesce(*[F.when(F.col("event_type") == t, n) for t, n in names.items()], F.col("event_type")) if names else F.col("event_type")
    none = F.lit(None).cast("string")
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return e.select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("row_id"), time.alias("event_time"), F.try_to_timestamp(time).alias("event_ts"), name.alias("event_name"), none.alias("event_source"),
        (k % 5).cast("string").alias("region"), (F.col("user_id") % 7).cast("string").alias("account"), k.cast("string").alias("source_ip"), F.when(k < 10, "terraform/1.0").otherwise("console").alias("user_agent"),
        F.struct(none.alias("type"), F.concat(F.lit("user/u"), F.col("user_id").cast("string")).alias("arn"), none.alias("user_name"), none.alias("principal_id")).alias("actor"),
        none.alias("access_key_id"), none.alias("minted_key_id"), none.alias("error_code"),
        F.concat(F.lit('{"roleArn": "arn:aws:iam::'), (k % 7).cast("string"), F.lit(":role/r"), k.cast("string"), F.lit('"}')).alias("request_params"),
        F.when(k % 2 == 0, "false").otherwise("true").alias("mfa_authenticated"), F.lit(None).cast("bigint").alias("repeat_count"), F.lit(None).cast("array<string>").alias("repeat_window"),
    )


def order_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as events that mint a key, ``lineitem`` as events under it."""
    none = F.lit(None).cast("string")
    actor = lambda c: F.struct(none.alias("type"), c.alias("arn"), none.alias("user_name"), none.alias("principal_id"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    o, i = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    key = lambda c: F.concat(F.lit("K"), F.lpad(c.cast("string"), 10, "0"))
    rest = [none.alias("error_code"), F.lit(None).cast("bigint").alias("repeat_count")]
    mint = o.select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("row_id"), stamp("o_orderdate").alias("event_time"), F.lit("AssumeRole").alias("event_name"), none.alias("account"), none.alias("region"), none.alias("source_ip"),
        actor(F.concat(F.lit("customer/"), F.col("o_custkey").cast("string"))).alias("actor"), none.alias("access_key_id"), key(F.col("o_orderkey")).alias("minted_key_id"), F.lit('{"roleArn": "r"}').alias("request_params"), *rest,
    )
    name = F.when(F.col("l_returnflag") == "R", "StopLogging").when(F.col("l_returnflag") == "A", "GetObject").otherwise("DescribeInstances")
    done = i.select(
        F.concat_ws("-", F.lit("l"), F.col("l_orderkey").cast("string"), F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), F.lpad(F.col("l_partkey").cast("string"), 10, "0"), F.lpad(F.col("l_suppkey").cast("string"), 10, "0")).alias("row_id"),
        stamp("l_shipdate").alias("event_time"), name.alias("event_name"), none.alias("account"), none.alias("region"), none.alias("source_ip"), actor(none).alias("actor"), key(F.col("l_orderkey")).alias("access_key_id"), none.alias("minted_key_id"), none.alias("request_params"), *rest,
    )
    return mint.unionByName(done)
