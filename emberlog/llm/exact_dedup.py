"""Exact de-duplication with a heavy-hitter split.

Every text becomes its SHA-256, written once beside its row's id.  Misra-Gries counters, a bounded number for each task, find the digests that
many rows have; their exact counts and winners are then taken in one more pass and broadcast, so that their rows are decided where they lie.  Only the
rows of the other digests are shuffled, and no such digest can have more than ``2 / (counters + 1)`` of all rows.

Of equal texts the row with the largest id stays.  A null text counts as empty.  A null id is smaller than any other.  Of repeated rows with the
winning id and text exactly one stays.  An empty table gives an empty result.  Texts may be of any length: only digests are kept and moved.
Further columns, whatever their names, don't matter: those of ``documents`` come back as they are from ``drop_copies``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

COUNTERS = 1023


def misra_gries(counters: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's counters over its column ``digest``: (digest, at_least), at most ``counters`` rows.

    A batch's own counts are added to the counters; then the largest count that has no counter left is taken from all.  So a digest's
    ``at_least`` falls short of its rows in the task by no more than ``rows / (counters + 1)``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pd.Series(dtype="int64")
        for b in batches:
            held = held.add(pd.Series(b["digest"].to_pylist(), dtype=object).value_counts(), fill_value=0)
            if len(held) > counters:
                held -= held.nlargest(counters + 1).iloc[-1]
                held = held[held > 0]
        yield pa.RecordBatch.from_arrays([pa.array(held.index, pa.binary()), pa.array(held.to_numpy("int64"), pa.int64())], ["digest", "at_least"])

    return run


def frequent(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Digests that may have ``1 / (counters + 1)`` of all rows, ``counters + 1`` at most; those with twice as much are all among them.

    Counters of tasks are added up: what a digest lacks then is no more than ``rows / (counters + 1)`` in all, and all counts together are no more than the rows.
    """
    found = digests.select("digest").mapInArrow(misra_gries(counters), "digest binary, at_least long").groupBy("digest").agg(F.sum("at_least").alias("at_least"))
    return found.filter(F.col("at_least") * (counters + 1) >= digests.count()).select("digest")


def _winners(digests: DataFrame) -> DataFrame:
    """Rows and winner of each digest; tasks combine before the shuffle."""
    return digests.groupBy("digest").agg(F.count("*").alias("group_size"), F.max(F.struct("id", "row")).alias("winner"))


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def _split(digests: DataFrame, counters: int) -> tuple[DataFrame, DataFrame]:
    """The winners of frequent digests, verified by an exact count, and the rows of all other digests."""
    heavy = written(_winners(digests.join(F.broadcast(frequent(digests, counters)), "digest", "left_semi")), "heavy-digests")
    return heavy, digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")


def groups(docs: DataFrame, id: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    digests = written(docs.select(F.col(id).alias("id"), _digest(text).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
    heavy, rest = _split(digests, counters)
    return digests.join(F.broadcast(heavy), "digest").unionByName(rest.join(_winners(rest), "digest")).select(
        F.col("id").alias(id), F.col("winner.id").alias("keep_id"), "group_size", (F.col("row") == F.col("winner.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Copies of frequent texts go before anything is shuffled.  Of the rest, whole rows meet the winner of their digest.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id).alias("id"), _digest(text).alias("digest"))
    heavy, rest = _split(written(rows.select("id", "digest", F.lit(0).alias("row")), "digests"), counters)

    def first(of: DataFrame) -> DataFrame:
        return of.filter(F.col("id").eqNullSafe(F.col("winner.id"))).groupBy("digest").agg(F.first("doc").alias("doc")).select("doc.*")

    light = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").join(_winners(rest), "digest")
    return first(rows.join(F.broadcast(heavy), "digest")).unionByName(first(light))
