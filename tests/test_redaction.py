"""Redaction: buckets, addresses, and names found by their rarest word."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from emberlog.operators import redact


def hidden(spark, texts, names=()):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    tokens = redact.mapping(df, "t", spark.createDataFrame([(n,) for n in names], "name string"))
    out = redact.redact(df, "id", "t", tokens)
    back = {r.id: r.t for r in redact.restore(out, "id", "t", tokens).collect()}
    assert [back[i] for i in range(len(texts))] == texts
    shown = {r.id: r.t for r in out.collect()}
    return [shown[i] for i in range(len(texts))], {r.value: r.token for r in tokens.collect()}


def test_nothing_is_found_inside_the_name_of_a_bucket(spark):
    texts = ["bucket: my-secret-bucket then more", 'Bucket="other.bucket" or bucket none', '{"bucketName":"third-bucket"}', "bucket arn:aws:s3:::fourth/x and bucket: 123456789012", "bucket=8.8.8.8", "my-secret-bucket; alone"]
    got, token = hidden(spark, texts)
    assert set(token) == {"my-secret-bucket", "other.bucket", "none", "third-bucket", "arn:aws:s3:::fourth/x", "123456789012", "8.8.8.8"}
    assert got[0] == f"bucket: {token['my-secret-bucket']} then more"
    assert got[1] == f'Bucket="{token["other.bucket"]}" or bucket {token["none"]}'
    assert got[3] == f"bucket {token['arn:aws:s3:::fourth/x']} and bucket: {token['123456789012']}" and token["123456789012"].startswith("ACCOUNT")
    assert got[5] == f"{token['my-secret-bucket']}; alone"


def test_addresses(spark):
    private = ["10.0.0.1", "203.0.113.7", "198.18.4.4", "192.0.2.1", "172.31.0.1", "240.0.0.1"]
    public = ["8.8.8.8", "224.0.0.5", "172.32.0.1"]
    none = ["999.1.1.1", "01.2.3.4", "1.2.3.256"]
    got, token = hidden(spark, [f"from {ip} on" for ip in [*private, *public, *none]])
    assert all(token[ip].startswith("IP-PRIVATE-") for ip in private)
    assert all(token[ip].startswith("IP-") and "PRIVATE" not in token[ip] for ip in public)
    assert got[-3:] == [f"from {ip} on" for ip in none] and not set(none) & set(token)


def test_names_with_a_common_word_meet_their_own_texts_only(spark):
    names = spark.range(2000).select(F.concat(F.lit("svc-platform-"), F.col("id").cast("string")).alias("old"), F.lit("T").alias("new"))
    rows = spark.range(500).select("id", F.concat(F.lit("by svc-platform-"), F.col("id").cast("string"), F.lit(" of platform svc")).alias("t"))
    assert redact.candidates(rows, "id", "t", names).count() == 500
    absent = names.withColumn("old", F.concat("old", F.lit("-never")))
    assert redact.candidates(rows, "id", "t", absent).count() == 0


def test_names_of_odd_characters(spark):
    names = ["---", "a b\nc", "Ωμ!", "x.y-z", "y-z", "\\Q.\\E", "bucket ab"]
    texts = ["<--->", "(a b\nc)", "Ωμ!", "x.y-z, y-z; ax.y-z", "\\Q.\\E", "bucket ab", "ab", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    tokens = redact.mapping(df, "t", spark.createDataFrame([(n,) for n in names], "name string"))
    token = {r.value: r.token for r in tokens.collect()}
    got = {r.id: r.t for r in redact.redact(df, "id", "t", tokens).collect()}
    assert [got[i] for i in range(9)] == [f"<{token['---']}>", f"({token['a b\nc']})", token["Ωμ!"], f"{token['x.y-z']}, {token['y-z']}; ax.{token['y-z']}", token["\\Q.\\E"], token["bucket ab"], "ab", None, ""]


def test_a_mapping_can_be_forgotten(spark):
    df = spark.createDataFrame([(1, "from 8.8.8.8")], "id int, t string")
    tokens = redact.mapping(df, "t")
    assert tokens.count() == 1
    redact.forgotten(tokens)
    with pytest.raises(Exception, match="FILE|does not exist|not found"):
        tokens.collect()


def test_texts_are_never_sent_whole_to_every_task(spark, tmp_path):
    """A table of equal texts is a small file, by which Spark guessed that it may be broadcast."""
    spark.range(3000).select("id", F.lit("job-1 from 8.8.8.8 by " * 20).alias("t")).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    tokens = redact.mapping(rows, "t", spark.createDataFrame([("job-1",)], "name string"))
    out = redact.redact(rows, "id", "t", tokens)
    for df in (out, redact.restore(out, "id", "t", tokens)):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        on_id = [line for line in plan.splitlines() if "Join [id#" in line]
        assert len(on_id) >= 2 and all("SortMergeJoin" in line for line in on_id), on_id
    assert out.select("t").distinct().collect()[0].t == "PRINCIPAL-1 from IP-1 by " * 20


def test_texts_are_redacted_once_before_they_are_restored(spark):
    out = __spark_entry__.queries()["redaction_restored"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join [") == 2, plan  # of the tokens found with the mapping, and of the texts with their pairs
