"""What an archive consists of when tasks are lost, repeated and aborted."""

import uuid

import pytest

from emberlog.llm import warc



def written(spark, path, ids, **options):
    warc.register(spark)
    rows = spark.createDataFrame([(f"<urn:page:{i}>", "response", b"x" * 50) for i in ids], "record_id string, record_type string, payload binary")
    rows.repartition(3).write.format("warc").options(**options).mode("append").save(str(path))


def ids(spark, path):
    return sorted(r.record_id for r in spark.read.format("warc").load(str(path)).select("record_id").collect())


def test_one_list_makes_a_job_visible(spark, tmp_path):
    written(spark, tmp_path, range(20), bytes_per_file=100)
    (job,) = tmp_path.glob("warc-job-*")
    names = (job / "_files").read_text().split()
    assert len(names) > 3 and sorted(names) == sorted(f.name for f in job.glob("*.warc.gz"))
    assert len(ids(spark, tmp_path)) == 20
    lost = tmp_path / f"warc-job-{uuid.uuid4().hex}"  # a job that never ended
    lost.mkdir()
    (lost / "a.warc.gz").write_bytes((job / names[0]).read_bytes())
    (job / "straggler.warc.gz").write_bytes((job / names[0]).read_bytes())  # an attempt that wrote on after the job ended
    assert len(ids(spark, tmp_path)) == 20
    (tmp_path / "foreign.warc.gz").write_bytes((job / names[0]).read_bytes())  # an archive of another writer
    assert len(ids(spark, tmp_path)) > 20


def test_commit_clears_lost_attempts_and_abort_all(tmp_path):
    writer = warc.WarcWriter({"path": str(tmp_path)}, type("S", (), {"names": ["record_id", "payload"]})(), False)
    kept, _ = writer.write(iter([("a", b"1")])), writer.write(iter([("a", b"1")]))
    writer.commit([kept, None])
    assert [f.name for f in tmp_path.glob("*/*.warc.gz")] == kept.names
    other = warc.WarcWriter({"path": str(tmp_path)}, type("S", (), {"names": ["record_id", "payload"]})(), False)
    other.write(iter([("b", b"2")]))
    other.abort([None])
    assert len(list(tmp_path.glob("warc-job-*"))) == 1


def test_jobs_add_up_and_overwriting_starts_anew(spark, tmp_path):
    written(spark, tmp_path, range(3))
    written(spark, tmp_path, range(3, 5))
    assert ids(spark, tmp_path) == [f"<urn:page:{i}>" for i in range(5)]
    spark.createDataFrame([("<urn:page:9>", "response", b"y", "kept apart")], "record_id string, record_type string, payload binary, other string").select("record_id", "record_type", "payload").write.format("warc").mode("overwrite").save(str(tmp_path))
    assert ids(spark, tmp_path) == ["<urn:page:9>"]


@pytest.mark.parametrize("extra", ["payload_bytes", "digest", "smallest", "n", "Payload"])
def test_pages_with_clashing_columns(spark, extra):
    df = spark.createDataFrame([(1, "u", "<p>" * 50, "x"), (2, "u", "<p>" * 50, "x"), (3, None, None, "x"), (2, "u", "<p>" * 50, "x")], f"page_id long, url string, html string, `{extra}` string")
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(df).collect())
    assert [(i, t) for i, t, _ in got] == [(1, "response"), (2, "revisit"), (2, "revisit"), (3, "response")]
