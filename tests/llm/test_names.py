"""Stages on tables whose columns have the names that the stages would like to use themselves."""

import corpus_pipeline

NAMES = ("__id", "__key", "__pii", "__PII_", "__text", "__letters", "__lang_pred", "__score", "__known", "id", "key", "goes", "copies", "row", "digest")


def test_columns_of_any_name_come_back_as_they_were(spark, tmp_path):
    words = "the quick brown fox jumps over the lazy dog and runs far away from every hunter in the wide green wood".split()
    rows = [(i, " ".join(words[i % 7 :] + [f"w{i}"] * (i % 3)) + (" mail me@example.com now" if i % 4 == 0 else ""), "en", *[f"{n} {i}" for n in NAMES]) for i in range(30)]
    schema = "doc_id long, text string, lang string, " + ", ".join(f"`{n}` string" for n in NAMES)
    docs = spark.createDataFrame(rows, schema)
    item = " ".join(words[3:])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    before = {r.doc_id: tuple(r[n] for n in NAMES) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = out.collect()
        assert all(tuple(r[n] for n in NAMES) == before[r.doc_id] for r in got), name
        if name == "pii":
            assert len(got) == 30 and not any("me@example.com" in r.text for r in got)
        if name == "decontamination":
            assert not any(item in r.text for r in got)
