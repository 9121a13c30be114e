"""Ranked lexical search against a plain version."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from emberlog.llm import ranked_search
from emberlog.llm.ranked_search import Graph, Settings

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = ["the", "The", "of", "blue", "Grün", "x1", "été", "ÉTÉ", "a-b", "under_score", "rare", "日本", "don't", "o"]


def split(text):
    return TERM.findall((text or "").translate(UPPER))


def plain(docs, items, top=10):
    held = [(i, Counter(split(t))) for i, t in docs]
    lengths = [sum(c.values()) for _, c in held]
    n_docs, n_terms = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for (i, c), n in zip(held, lengths):
            score = 0
            for t in split(text):
                if t in c:
                    m = 25 + 75 * n * n_docs // n_terms
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score:
                found.append((-score, i is not None, i or 0))
        out += [(item, rank, i if there else None, -score) for rank, (score, there, i) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def tables(spark, docs, items, parts=3):
    return (
        spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id long, text string, n int, terms int, score int").repartition(parts),
        spark.createDataFrame([(i, t, 1) for i, t in items], "item_id int, text string, rank int"),
    )


def some(seed, n_docs, n_items):
    rng = random.Random(seed)
    phrase = "the blue of under grün x1"
    docs = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(0, 30)))) for i in range(n_docs)]
    docs += [(n_docs + i, phrase) for i in range(30)] + [(5, phrase), (5, phrase), (None, phrase), (None, "rare"), (9999, None), (9998, ""), (9997, " .,;! ")]
    items = [(i, " ".join([phrase] * rng.randrange(2) + rng.choices(WORDS, k=rng.randrange(0, 9)))) for i in range(n_items)]
    return docs, items + [(0, phrase), (None, "rare rare"), (77, None), (78, "nowhere"), (79, "")]


@pytest.mark.parametrize("s", [Settings(), Settings(block_items=3, cells=50, parts=2), Settings(top=1, block_bytes=40)])
def test_search(spark, s):
    docs, items = some(3, 120, 14)
    got = ranked_search.search(*tables(spark, docs, items), s)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["item_id"] == "int"
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(docs, items, s.top)


def test_long_texts_and_one_document(spark):
    docs, items = [(1, "été " * 400_000 + "rare"), (2, "rare")], [(1, "rare été"), (2, "été " * 2000)]
    assert sorted((tuple(r) for r in ranked_search.search(*tables(spark, docs, items)).collect()), key=str) == plain(docs, items)


@pytest.mark.parametrize(("docs", "items"), [([], [(1, "a")]), ([(1, "a")], []), ([], []), ([(1, None), (2, "-")], [(1, "a")])])
def test_nothing_to_find(spark, docs, items):
    assert ranked_search.search(*tables(spark, docs, items)).collect() == []


def test_graph_computes_shared_sums_once():
    rng = random.Random(7)
    shared = [f"s{i}" for i in range(12)]
    texts = [" ".join(shared[: 4 * rng.randrange(4)] + [f"own{i}"] * 2 + rng.choices(shared, k=2)) for i in range(40)] + [None, "", "own3"]
    g = Graph(texts)
    row = {h: k for k, h in enumerate(g.hashes.tolist())}
    name = {t: row[int(ranked_search.terms(pa.array([t])).hash[0])] for t in {t for x in texts for t in split(x)}}
    weight = {t: rng.randrange(1, 1000) for t in name}
    at = [(name[t], d, weight[t] * (d + 1)) for t in name for d in range(3)]
    got = g.scores(*(np.array(x) for x in zip(*at)), 3)
    assert got.tolist() == [[(d + 1) * sum(weight[t] for t in split(x)) for d in range(3)] for x in texts]
    plain_adds = sum(len(set(split(x))) for x in texts)
    assert len(g.sum_of) + sum(len(n) for n, _, _ in g.levels) + sum(map(len, g.parts)) < plain_adds  # fewer sums than item by item
    pairs = Counter(p for part in g.parts for p in zip(part, part[1:]))
    assert max(pairs.values(), default=0) <= 1  # nothing shared is left
