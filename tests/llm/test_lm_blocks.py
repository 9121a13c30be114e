"""How language-model scoring deals tokens to blocks, and that its scores don't depend on tasks."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from emberlog.llm import lm_scoring
from emberlog.llm.lm_scoring import Settings


def block_sizes(v, texts):
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts), "held_out": pa.array([i % 5 == 1 for i in range(len(texts))])})
    size = {}
    for out in lm_scoring._deal(SimpleNamespace(value=v))(iter([batch])):
        for block, data in zip(out["block"].to_pylist(), out["data"].to_pylist()):
            if block >= 0:
                size[block] = size.get(block, 0) + int(np.frombuffer(data, "<u4", 4).sum())
    return size


@pytest.mark.parametrize("texts", [["buy now " * 160] * 3000, ["buy now " * 480_000], ["a " * 100] * 4000 + ["b c d " * 50] * 2000], ids=["a line in many texts", "one long text", "one word"])
def test_no_block_is_much_larger_than_wanted(spark, texts):
    s = Settings(block_tokens=4096, dealt_tokens=1 << 30)
    v = lm_scoring.vocabulary(spark.createDataFrame([(t,) for i, t in enumerate(texts) if i % 5 != 1], "text string"), s)
    size = block_sizes(v, texts)
    assert sum(size.values()) == sum(len(t.split()) + 1 for t in texts)
    assert max(size.values()) <= 2 * s.block_tokens, (max(size.values()), len(size))


def test_blocks_without_hot_pairs_keep_pairs_together(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(300)]
    v = lm_scoring.vocabulary(spark.createDataFrame([(t,) for t in texts], "text string"), Settings(block_tokens=2000))
    assert (v.pair_pieces == 1).all() and v.pieces.max() > 1


def test_scores_do_not_depend_on_partitions(spark):
    rng = random.Random(8)
    words = [f"w{i % 90}" for i in range(300)] + ["the", "of"] * 60
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(400)] + [(1000 + i, "buy now " * 50) for i in range(60)] + [(None, "the end"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    s = Settings(known_words=80, block_tokens=1500, dealt_tokens=3000, step=256)
    key = lambda r: (str(r.doc_id), r.n_tokens, round(r.score, 3))
    one = sorted((key(r), r.score) for r in lm_scoring.score(df.coalesce(1), s).collect())
    for other in (df.repartition(7), df.orderBy("text").repartition(3)):
        got = sorted((key(r), r.score) for r in lm_scoring.score(other, s).collect())
        assert [k for k, _ in got] == [k for k, _ in one]
        assert np.allclose([x for _, x in got], [x for _, x in one], atol=1e-4)


def test_many_short_texts_in_one_batch(spark):
    v = lm_scoring.vocabulary(spark.createDataFrame([("a b",)], "text string"), Settings())
    assert sum(block_sizes(v, ["a"] * 140_000).values()) == 280_000
