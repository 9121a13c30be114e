"""Centroid clustering against a plain version."""

import hashlib
import math
import random

import numpy as np
import pytest

from emberlog.llm import centroids
from emberlog.llm.centroids import Settings

SCHEMA = "vec_id long, embedding array<float>, label int, id int, cluster string, dots int"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 0, 1, "x", 2) for i, v in rows], SCHEMA).repartition(parts)


def plain(rows, s):
    kept = [(i, tuple(math.floor(float(np.float32(x)) * s.scale) for x in v)) for i, v in rows if v is not None and len(v) == s.dimensions and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"{s.seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    middle = [list(v) for _, v in kept[: s.clusters]]
    for left in range(s.rounds, -1, -1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(middle)) for _, v in kept]
        for c in range(len(middle)) if left else ():
            mine = [v for (_, v), (_, n) in zip(kept, near) if n == c]
            if mine:
                middle[c] = [sum(x) // len(mine) for x in zip(*mine)]
    inertia = [sum(d for d, n in near if n == c) for c in range(len(middle))]
    shas = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in middle]
    return sorted(((i, c, d, inertia[c], sum(inertia), shas[c]) for (i, _), (d, c) in zip(kept, near)), key=str)


def odd_rows(n, dims, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-1, 0, 1]) + rng.gauss(0, 0.3) for _ in range(dims)]) for i in range(n)]
    rows += [rows[0], rows[0], (rows[1][0], rows[2][1]), (None, rows[3][1]), (None, rows[4][1])]  # repeated rows and ids, no id
    return rows + [(900, None), (901, []), (902, [1.0] * (dims - 1)), (903, [None] + [1.0] * (dims - 1)), (904, [float("nan")] * dims), (905, [float("inf")] * dims), (906, [0.0] * dims)]


@pytest.mark.parametrize(
    ("n", "s"),
    [(120, Settings(dimensions=4)), (150, Settings(dimensions=64)), (60, Settings(dimensions=3, clusters=40, rounds=5, scale=2)), (40, Settings(dimensions=1, rounds=0)), (5, Settings(dimensions=5))],
)
def test_cluster(spark, n, s):
    rows = odd_rows(n, s.dimensions, n)
    got = centroids.cluster(table(spark, rows), s)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, s)


def test_ties_and_empty_centroids(spark):
    rows = [(i, [float(i % 2)] * 64) for i in range(40)]  # equal first centroids: all but the smallest numbers stay empty
    assert sorted((tuple(r) for r in centroids.cluster(table(spark, rows)).collect()), key=str) == plain(rows, Settings())


def test_empty_table(spark):
    assert centroids.cluster(table(spark, [])).collect() == []


def test_integers_too_large_for_exact_distances(spark):
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(table(spark, [(1, [3e9] * 64)])).collect()


def test_only_changed_components_move_the_dot_products():
    rng = np.random.default_rng(1)
    v, old = rng.integers(-64, 64, (50, 8)), rng.integers(-64, 64, (3, 8))
    new = old.copy()
    new[1, 2] += 5
    new[2, [0, 7]] -= 1
    assert (centroids.moved(v @ old.T, v, old, new) == v @ new.T).all()
    untouched = v.copy()
    untouched[:, [1, 3, 4, 5, 6]] = 1 << 40  # components without a change aren't read
    assert (centroids.moved(v @ old.T, untouched, old, new) == v @ new.T).all()
