"""Sharding by a minimax contiguous partition of atomic groups.

Equal texts are a group and stay together; groups are ordered by the MD5 of their text.  The
smallest capacity for which a greedy pass over the ordered group sizes needs no more than the
given number of shards is found by binary search, and the shards are cut where that pass cuts.

The driver never holds all groups.  It starts from the sizes of slices of the order (by the
first hex digits of the MD5) and knows of a slice only its size.  A greedy pass that may cut
anywhere in a slice shows which capacities can't suffice, one that cuts only between slices
shows which do; only the slices in between, where some cut may fall, are split by further
digits in another pass over the groups, until the smallest capacity is exact.

The law is ``bytes``: shard sizes are near equal, as far as the largest group allows.

Defined results: a null text has no bytes (size 1), belongs with the empty text, and has the
CRC of it; repeated rows are each put into a shard; with fewer groups than shards some shards stay empty;
columns other than id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed


@dataclass(frozen=True)
class Settings:
    shards: int = 16
    first_digits: int = 3  #: hex digits of the first slices: 4096 of them
    more_digits: int = 2
    slot_parts: int = 256  #: parts in which the rows of a shard are numbered


class Slices:
    """Ordered slices (key prefix, bytes, groups); a slice of one group is exact."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.rows = sorted(rows)

    def split(self, parts: list[tuple[str, int, int]], prefixes: set[str]) -> None:
        self.rows = sorted([r for r in self.rows if r[0] not in prefixes] + parts)

    def passes(self, capacity: int, shards: int) -> tuple[bool, bool, set[int]]:
        """Whether a cut anywhere suffices, whether cuts between slices do, and the slices where they differ."""
        loose_shards, loose_room = 1, capacity
        tight_shards, tight_room = 1, capacity
        tight_ok, doubt = True, set()
        for i, (_, size, groups) in enumerate(self.rows):
            if groups == 1:
                if size > loose_room:
                    loose_shards, loose_room = loose_shards + 1, capacity
                loose_room -= size
            else:
                if size > loose_room:  # fills the shard to the brim
                    doubt.add(i)
                    more = -(-(size - loose_room) // capacity)
                    loose_room += more * capacity
                    loose_shards += more
                loose_room -= size
            if size > capacity and groups > 1:
                tight_ok = False
                doubt.add(i)
            if size > tight_room:
                if groups > 1:
                    doubt.add(i)
                tight_shards, tight_room = tight_shards + 1, capacity
            tight_room = max(0, tight_room - size)
        return loose_shards <= shards, tight_ok and tight_shards <= shards, doubt

    def between(self, low: int, high: int, shards: int) -> set[str]:
        """Prefixes of the slices that have to be split to tell capacities from low to high apart."""
        found: set[int] = set()
        for capacity in (low, (low + high) // 2, high):
            found |= self.passes(capacity, shards)[2]
        return {self.rows[i][0] for i in found}

    def bounds(self, low: int, high: int, shards: int) -> tuple[int, int]:
        """The smallest capacity that may suffice, and the smallest that surely does."""
        out = []
        for which in (0, 1):
            a, b = low, high
            while a < b:
                mid = (a + b) // 2
                if self.passes(mid, shards)[which]:
                    b = mid
                else:
                    a = mid + 1
            out.append(a)
        return out[0], out[1]


def _level(groups: DataFrame, digits: int, inside: set[str] | None) -> list[tuple[str, int, int]]:
    """Slices by so many digits, as far as they lie in the given ones; at full length each is a group."""
    if inside is not None:
        lengths = sorted({len(p) for p in inside})
        hit = F.lit(False)
        for n in lengths:
            hit = hit | F.substring("key", 1, n).isin([p for p in inside if len(p) == n])
        groups = groups.filter(hit)
    rows = groups.groupBy(F.substring("key", 1, digits).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("groups"))
    return [tuple(r) for r in rows.collect()]  # 16**digits rows at most, in slices that hold a cut


def cuts(groups: DataFrame, settings: Settings) -> tuple[int, list[str]]:
    """The smallest capacity for groups (key, bytes), and the key at which each shard but the first begins."""
    total, largest = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("bytes"), F.lit(0))).first()
    if not total:
        return 0, []
    slices = Slices(_level(groups, settings.first_digits, None))
    low, high, digits = max(largest, -(-total // settings.shards)), total, settings.first_digits
    while True:
        low, high = slices.bounds(low, high, settings.shards)
        doubt = slices.between(low, high, settings.shards)
        if low == high and not doubt or digits >= 32:
            break
        digits = min(32, digits + settings.more_digits)
        slices.split(_level(groups, digits, doubt), doubt)
    begins, room = [], high
    for prefix, size, _ in slices.rows:
        if size > room:
            begins.append(prefix)
            room = high
        room -= size
    return high, begins


def shard(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id",
        F.octet_length(text).cast("long").alias("octets"),
        F.crc32(text).alias("text_crc32"),
        F.md5(text).alias("key"),
    )
    rows = checkpointed(rows.withColumn("size", F.col("octets") + 1).drop("octets"))
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    groups = checkpointed(groups)
    _, begins = cuts(groups, settings)
    number = sum((F.when(F.col("key") >= b, 1).otherwise(0) for b in begins), F.lit(0))
    placed = rows.withColumn("shard", number.cast("int"))
    # rows are numbered in parts of a shard, dealt by id, so that copies of a text spread out
    part = F.pmod(F.xxhash64("doc_id"), F.lit(settings.slot_parts))
    placed = placed.withColumn("part", part.cast("int"))
    ahead = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    order = Window.partitionBy("shard", "part").orderBy("doc_id", "key")
    numbered = placed.withColumn("place", F.row_number().over(order) - 1).join(F.broadcast(counts), ["shard", "part"])  # shards * slot_parts rows at most
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + F.col("place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
