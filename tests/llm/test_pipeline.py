"""The pipeline as a whole, against plain versions of its stages."""

import random
import re
import struct
import zlib
from collections import defaultdict

import corpus_pipeline
from emberlog.llm import pii
from tests.llm.test_llm import plain_groups

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(21)
    en, fr = ["the", "of", "thing", "and", "other", "that", "inner", "ther"], ["le", "eau", "été", "quelle", "aux", "mentoi", "çion", "les"]
    some = lambda w, n: [r.choice(w) + (r.choice(w) if r.random() < 0.7 else "") for _ in range(n)]
    items = [some(en, 30), some(fr, 9)]
    texts = []
    for i in range(60):
        texts.append(some(en if i % 2 else fr, r.randint(20, 200)))
    for i in range(12):  # near copies, and copies of those
        near = list(texts[i])
        near[r.randrange(len(near))] = "changed"
        texts += [near, near]
    for i in range(20, 26):  # passages of the benchmark
        texts[i][5:5] = items[i % 2]
    texts = [" ".join(t) for t in texts] + ["", "123 456 !!", None, "one"]
    texts[30] += " write to a.b@example.com or +1 (743) 555-3824, card 4111 1111 1111 1111"
    texts[31] += " password=ab12cd34ef"
    rows = [(i, t, ("en" if i % 2 else "fr") if i < 60 else None, "s", len(t or "")) for i, t in enumerate(texts)]
    return rows, [(i, " ".join(x)) for i, x in enumerate(items)]


def contained(text, item):
    sets = []
    for t in (text, item):
        w = [x for x in re.split(r"[\W_]+", t.lower()) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    return 10 * len(sets[0] & sets[1]) >= 8 * len(sets[1])


def test_pipeline_against_plain_stages(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows, items = corpus()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [(i, t) for i, t, *_ in rows if any(c.isalpha() for c in t or "")]
    groups = plain_groups([t for _, t in kept], 5, 80)
    kept = [x for k, x in enumerate(kept) if groups[k][1] == k]
    kept = [(i, t) for i, t in kept if not any(contained(t, item) for _, item in items)]
    assert {20, 21, 22, 23, 24, 25}.isdisjoint(i for i, _ in kept) and 60 < len(rows) - 20 and len(kept) < 62
    spans = {x["doc_id"]: x["spans"] for x in pii.report(spark.createDataFrame(kept, "doc_id long, text string")).collect()}
    masks = {k.name: k.mask for k in pii.KINDS}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, t in kept:
        for start, stop, kind in sorted(((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans[i].split(",") if s)), reverse=True):
            t = t[:start] + masks[kind] + t[stop:]
        assert "4111" not in t and "ab12cd34ef" not in t
        want[i] = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
    by_doc = defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        piece = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(piece)}I", *piece))
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
    assert {i: sum(n for _, n in p) for i, p in by_doc.items()} == {i: len(x) for i, x in want.items()}


def test_stages_keep_the_columns_and_run_on_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], COLUMNS)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0, name
