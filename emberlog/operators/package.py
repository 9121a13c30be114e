"""The case in one nested row: counts, and bounded lists of the first rows of each result."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a part that the package lists; its ``total`` counts them all.
LISTED = 25


def part(rows: DataFrame, order: Sequence[Column], columns: Sequence[str], listed: int = LISTED) -> DataFrame:
    """One row: total, and items, the first rows in an order that tells them apart.  Tasks keep so many rows each; no list grows with the input."""
    keys = [c.alias(f"o{i}") for i, c in enumerate(order)]
    first = rows.select(F.struct(*keys).alias("rank"), F.struct(*columns).alias("item")).orderBy("rank").limit(listed)
    items = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]).alias("items"))
    return rows.agg(F.count("*").alias("total")).crossJoin(items)  # one row each


def package(parts: Mapping[str, DataFrame], facts: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """One row with a struct (total, items) for each part, and a struct for each of ``facts``, tables of one row."""
    out = None
    for name, df in [*parts.items(), *(facts or {}).items()]:
        one = df.select(F.struct(*df.columns).alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out
