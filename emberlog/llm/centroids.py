"""Centroid clustering of integer vectors with an incremental distance matrix.

Components become the integers ``floor(scale * x)``.  Beside each vector lie its squared length and its exact dot product with every centroid; the squared
distance is ``length - 2 * dot + centroid's length``, in 64-bit integers.  A centroid's step changes few of its components by an integer each, so a round adds
to the dot products only those components' share, then takes the least distance again.  The first round is the same step, from centroids of zeros.

Vectors are kept that have exactly ``dimensions`` components, none null or not finite; others have no row.  Ties of distance go to the smaller number.
The first centroids are the kept vectors with the smallest SHA-256 of ``seed:id``; a null id counts as the empty text, and vectors of one id are in order
of their components.  Fewer vectors than clusters make fewer centroids, an empty table an empty result.  Repeated rows are clustered each on its own.  An integer
beyond ``LARGEST`` raises an error, as distances might not be whole.  Further columns don't matter.  Only centroids and sums by cluster reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written

#: So that 64 squared differences fit in 62 bits.
LARGEST = 1 << 27

_STATE = "id long, vector array<int>, length long, dots array<long>, cluster int, distance long"


@dataclass(frozen=True)
class Settings:
    dimensions: int = 64
    scale: int = 64
    clusters: int = 16
    rounds: int = 3
    seed: int = 1


def integers(vectors: DataFrame, s: Settings, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Kept vectors as (id, vector array<int>)."""
    x = F.col("x").cast("array<double>")
    fits = (F.size("x") == s.dimensions) & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    scaled = F.transform(x, lambda e: F.floor(e * F.lit(float(s.scale))))
    large = F.exists(x, lambda e: F.abs(e) * s.scale > LARGEST)
    whole = F.when(large, F.raise_error(F.lit("a component is too large for exact distances")).cast("array<int>")).otherwise(scaled.cast("array<int>"))
    return vectors.select(F.col(id).alias("id"), F.col(vector).alias("x")).filter(fits).select("id", whole.alias("vector"))


def _array(column: pa.ListArray, rows: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(rows, -1)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), kind))


def moved(dots: np.ndarray, vectors: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Dot products with ``new``, from those with ``old``: only components that change are read."""
    change = new - old
    for c in np.flatnonzero(change.any(axis=1)):
        at = np.flatnonzero(change[c])
        dots[:, c] += vectors[:, at] @ change[c, at]
    return dots


def _assigned(old: np.ndarray, new: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The state after centroids go from ``old`` to ``new``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in filter(len, batches):
            v = _array(b["vector"], len(b), np.int64)
            dots = _array(b["dots"], len(b), np.int64).copy() if "dots" in b.schema.names else np.zeros((len(b), len(new)), np.int64)
            length = (v * v).sum(axis=1)
            dots = moved(dots, v, old, new)
            distance = length[:, None] - 2 * dots + (new * new).sum(axis=1)[None, :]
            best = distance.argmin(axis=1)  # the first of equals
            yield pa.RecordBatch.from_arrays(
                [b["id"], b["vector"], pa.array(length), _lists(dots, pa.int64()), pa.array(best.astype(np.int32)), pa.array(distance[np.arange(len(b)), best])],
                ["id", "vector", "length", "dots", "cluster", "distance"],
            )

    return run


def _first(kept: DataFrame, s: Settings) -> np.ndarray:
    key = F.sha2(F.concat(F.lit(f"{s.seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = kept.orderBy(key, "vector").limit(s.clusters).select("vector").collect()
    return np.array([r.vector for r in rows], np.int64).reshape(len(rows), s.dimensions)


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floors of the exact means; a centroid without vectors stays."""
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("vector")[j]) for j in range(centroids.shape[1])]).alias("sums")).collect()
    new = centroids.copy()
    for r in sums:
        new[r.cluster] = [x // r.n for x in r.sums]
    return new


def cluster(vectors: DataFrame, s: Settings = Settings(), id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for each kept vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    state = written(integers(vectors, s, id, vector), "vectors")
    centroids = _first(state, s)
    old = np.zeros_like(centroids)
    for left in range(s.rounds, -1, -1):
        last, state = state, written(state.mapInArrow(_assigned(old, centroids), _STATE), "dot-products")
        forget(last)
        if left:
            old, centroids = centroids, _means(state, centroids)
    sums = {r.cluster: r.inertia for r in state.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    facts = [(c, sums.get(c, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c in range(len(centroids))]
    about = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select(F.col("id").alias(id), "cluster", "distance").join(F.broadcast(about), "cluster").select(id, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
