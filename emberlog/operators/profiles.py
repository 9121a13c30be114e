"""What an actor touched: exact values as rows, bounded lists of them, and sketches that merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.schema import actor_of

#: Values of a kind that an actor's row lists; beyond it the row has their number only, and ``actor_values`` has them all.
LISTED = 256
DIMENSIONS = ("account", "region", "source_ip")
_PRECISION = 12  #: of sketches: 4096 registers, a standard error of 1.6 %


def actor_values(events: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """(actor, dimension, value, events): every value that an actor has, neither null nor empty, however many."""
    each = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dimensions])
    rows = events.select(actor_of().alias("actor"), F.inline(each)).filter("actor <> '' AND value <> ''")
    return rows.groupBy("actor", "dimension", "value").agg(F.count("*").alias("events"))


def bounded_lists(values: DataFrame, listed: int = LISTED) -> DataFrame:
    """(actor, dimension, n, values): the number of distinct values and the first ones in order.

    Values are distinct before they meet by actor, and tasks send on no more than ``listed`` of each.
    """
    n = values.groupBy("actor", "dimension").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("actor", "dimension").orderBy("value"))
    first = values.select("actor", "dimension", "value").withColumn("nth", nth).filter(F.col("nth") <= listed)
    first = first.groupBy("actor", "dimension").agg(F.array_sort(F.collect_list("value")).alias("values"))
    return n.join(first, ["actor", "dimension"])


def wide(lists: DataFrame, names: dict[str, tuple[str, str]]) -> DataFrame:
    """One row for each actor; names: dimension to (column of the list, column of the number)."""
    pick = lambda d, c: F.max(F.when(F.col("dimension") == d, F.col(c)))
    return lists.groupBy("actor").agg(*[pick(d, c).alias(name) for d, pair in names.items() for name, c in zip(pair, ("values", "n"), strict=True)])


def sketches(events: DataFrame, *by: Column, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """(actor, by..., events, <dimension>_sketch): sketches of bounded size of the distinct values, to be kept by day, say, and merged."""
    known = events.withColumn("actor", actor_of()).filter("actor <> ''")
    return known.groupBy("actor", *by).agg(F.count("*").alias("events"), *[F.hll_sketch_agg(F.nullif(F.col(d), F.lit("")), F.lit(_PRECISION)).alias(f"{d}_sketch") for d in dimensions])


def merged(kept: DataFrame, *by: Column, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """(actor, by..., events, <dimension>_count): estimates of the distinct values over all sketches of an actor."""
    return kept.groupBy("actor", *by).agg(F.sum("events").alias("events"), *[F.hll_sketch_estimate(F.hll_union_agg(f"{d}_sketch")).alias(f"{d}_count") for d in dimensions])
