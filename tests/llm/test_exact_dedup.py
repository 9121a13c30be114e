"""Exact de-duplication against a plain version."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest

from emberlog.llm import exact_dedup

SCHEMA = "doc_id long, text string, digest string, id int, row int"


def rows_of(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA).repartition(parts)


def plain(rows):
    best, size = {}, Counter((t or "") for _, t in rows)
    for i, t in rows:
        best[t or ""] = max(best.get(t or "", (False, 0)), (i is not None, i or 0))
    return sorted(((str(i), best[t or ""][1] if best[t or ""][0] else None, size[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=str)


def cases():
    rng = random.Random(4)
    yield "mixed", [(i, rng.choice(["hot", "hot", "hot", f"t{rng.randrange(40)}", f"own {i}", None, "", " hot", "Hot"])) for i in range(400)]
    yield "ties", [(7, "a"), (7, "a"), (7, "b"), (None, "a"), (None, "c"), (None, "c"), (3, None), (3, "")]
    yield "long", [(1, "é" * 300_000), (2, "é" * 300_000), (3, "é" * 300_000 + "x")]
    yield "empty", []


@pytest.mark.parametrize(("name", "rows"), list(cases()), ids=lambda c: c if isinstance(c, str) else "")
@pytest.mark.parametrize("counters", [1, 3, 1023])
def test_groups(spark, name, rows, counters):
    got = exact_dedup.groups(rows_of(spark, rows), counters=counters).collect()
    assert sorted(((str(r.doc_id), r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == plain(rows)
    kept = [(r.doc_id, r.text_sha256) for r in got if r.kept]
    assert sorted(kept, key=str) == sorted({(r.keep_id, r.text_sha256) for r in got}, key=str)  # one of each group


@pytest.mark.parametrize("counters", [1, 1023])
@pytest.mark.parametrize(("name", "rows"), list(cases()), ids=lambda c: c if isinstance(c, str) else "")
def test_drop_copies_keeps_whole_rows(spark, name, rows, counters):
    out = exact_dedup.drop_copies(rows_of(spark, rows), counters=counters)
    assert out.columns == ["doc_id", "text", "digest", "id", "row"]
    got = out.collect()
    assert sorted((str(r.doc_id), r.text or "") for r in got) == sorted({(str(k), t or "") for (i, t), k in zip(rows, [max((x for x, u in rows if (u or "") == (t or "") and x is not None), default=None) for _, t in rows])})
    assert all((r.digest, r.id, r.row) == ("x", 1, 2) for r in got)


def test_counters_miss_no_frequent_digest():
    rng = random.Random(9)
    stream = [rng.choice([b"a", b"a", b"b", bytes([rng.randrange(256), rng.randrange(256)])]) for _ in range(3000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(stream[i : i + 100], pa.binary())], ["digest"]) for i in range(0, 3000, 100)]
    for counters in (1, 2, 5, 50):
        (out,) = exact_dedup.misra_gries(counters)(iter(batches))
        held, true = dict(zip(out["digest"].to_pylist(), out["at_least"].to_pylist())), Counter(stream)
        assert len(held) <= counters
        assert all(true[d] - 3000 / (counters + 1) <= held.get(d, 0) <= true[d] for d in true)


def test_frequent_digests_do_not_reach_the_shuffle(spark):
    rows = rows_of(spark, [(i, "hot" if i % 2 else str(i)) for i in range(200)])
    digests = rows.select("doc_id", exact_dedup._digest("text").alias("digest"))
    assert exact_dedup.frequent(digests, 3).count() == 1
