"""Trees of hashes over ordered rows: what has changed is found from the root down, block by block.

Rows are numbered in order and cut into blocks of so many rows; a block's hash is that of its rows' hashes, a node's that of its children's.
Neither a block nor a node grows with the data, and rows may be moved from file to file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.shared import placed, stored

BLOCK, FANOUT = 1024, 16


def _node_hash(place: Column, digest: Column) -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("place"), digest.alias("digest")))), lambda x: x["digest"]), ""), 256)


def leaves(rows: DataFrame, place: str, digest: str, keys: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """(keys, level 0, node, n, sha256): the blocks of numbered rows with hashes."""
    node = F.floor(F.col(place) / block).cast("bigint").alias("node")
    return rows.groupBy(*keys, node).agg(F.count("*").alias("n"), _node_hash(F.col(place), F.col(digest)).alias("sha256")).select(*keys, F.lit(0).alias("level"), "node", "n", "sha256")


def grown(blocks: DataFrame, keys: Sequence[str] = (), fanout: int = FANOUT) -> DataFrame:
    """The blocks with all levels above them, up to the one node of each key that is its root."""
    level = out = stored(blocks, "merkle")
    most = level.agg(F.max("node")).first()[0] or 0
    depth = 0
    while most > 0:
        depth, most = depth + 1, most // fanout
        level = level.groupBy(*keys, F.floor(F.col("node") / fanout).cast("bigint").alias("up")).agg(F.sum("n").alias("n"), _node_hash(F.col("node"), F.col("sha256")).alias("sha256"))
        level = level.select(*keys, F.lit(depth).alias("level"), F.col("up").alias("node"), "n", "sha256")
        out = out.unionByName(level)
    return out


def tree(rows: DataFrame, order: Sequence[str], columns: Sequence[str], block: int = BLOCK, fanout: int = FANOUT) -> DataFrame:
    """(level, node, n, sha256) over the rows in an order that tells them apart; a row's hash is that of its columns joined by bars."""
    digest = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256)
    return grown(leaves(placed(rows.select(*order, digest.alias("__digest")), *order), "place", "__digest", block=block), fanout=fanout)


def changes(before: DataFrame, after: DataFrame, keys: Sequence[str] = (), fanout: int = FANOUT) -> DataFrame:
    """(keys, node, state) of the blocks that differ: MODIFIED, MISSING or ADDED.

    From the top down, the children of nodes that differ are looked at; what is alike is left alone.
    """
    on = [*keys, "level", "node"]
    old, new = (t.select(*on, F.col("sha256").alias(name)) for t, name in ((before, "was"), (after, "now")))
    both = old.join(new, on, "full_outer").filter(~F.col("was").eqNullSafe(F.col("now")))
    both = stored(both, "merkle-changes")
    top = both.agg(F.max("level")).first()[0]
    if top is None:
        return both.select(*keys, "node", F.lit("MODIFIED").alias("state"))
    found = both.filter(F.col("level") == top)
    for level in range(top - 1, -1, -1):
        up = found.select(*keys, F.col("node").alias("__up")).distinct()
        here = both.filter(F.col("level") == level).withColumn("__up", F.floor(F.col("node") / fanout).cast("bigint"))
        found = here.join(up, [*keys, "__up"], "left_semi").drop("__up")
    state = F.when(F.col("now").isNull(), "MISSING").when(F.col("was").isNull(), "ADDED").otherwise("MODIFIED")
    return found.select(*keys, "node", state.alias("state"))
