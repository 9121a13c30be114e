"""Session keys minted under session keys, and values as they were when an event happened."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog import rules
from emberlog.functions.shared import stored
from emberlog.schema import actor_of


def minted_under(events: DataFrame) -> DataFrame:
    """(key, parent, minted_by, minted_at): by each key's last minting event; the parent is the key that it was called with, if any."""
    mint = events.filter(F.col("event_name").isin(*rules.MINTING) & (F.coalesce("minted_key_id", F.lit("")) != ""))
    last = F.max(F.struct("event_time", "row_id", F.nullif("access_key_id", F.lit("")).alias("parent"), actor_of().alias("by")))
    return mint.groupBy(F.col("minted_key_id").alias("key")).agg(last.alias("o")).select("key", "o.parent", F.col("o.by").alias("minted_by"), F.col("o.event_time").alias("minted_at"))


def closure(edges: DataFrame) -> DataFrame:
    """(key, root, depth, in_cycle) of edges (key, parent), each key once.

    Pointer jumping: every round each key takes over the pointer of the key it points to, so steps double and a chain of n keys needs log2(n) rounds.  A parent that has no row of its own is a root.
    What has come to no root after as many rounds as there are keys to double to is below a cycle: its root is null.  The driver sees one count a round.
    Before, keys that are nobody's parent are left out as long as that halves the rows, all others' chains lie within the rest; they take over their parents' roots at the end.
    """
    levels = [stored(edges.select("key", F.nullif("parent", F.lit("")).alias("parent")), "session-edges")]
    counts = [levels[0].count()]
    while counts[-1]:
        parents = levels[-1].filter("parent IS NOT NULL").select(F.col("parent").alias("key")).distinct()
        rest = stored(levels[-1].join(parents, "key", "left_semi"), "session-edges")
        if (n := rest.count()) * 2 > counts[-1]:
            break
        levels, counts = [*levels, rest], [*counts, n]
    closed = _jumped(levels.pop())
    for rows in reversed(levels):
        above = closed.select(F.col("key").alias("parent"), "root", F.col("depth").alias("__depth"), "in_cycle")
        in_cycle = F.coalesce("in_cycle", F.lit(False))
        closed = rows.join(above, "parent", "left").select(
            "key", F.when(~in_cycle, F.coalesce("root", "parent", "key")).alias("root"),
            F.when(~in_cycle, F.when(F.col("parent").isNull(), 0).otherwise(F.coalesce("__depth", F.lit(0)) + 1)).cast("bigint").alias("depth"), in_cycle.alias("in_cycle"),
        )
    return closed


def _jumped(known: DataFrame) -> DataFrame:
    """The closure of (key, parent) by pointer jumping alone."""
    inner = known.select(F.col("key").alias("parent"), F.lit(True).alias("__has"))
    # a pointer leads to a key; ``open`` tells whether that key has a pointer of its own
    state = known.join(inner, "parent", "left").select("key", F.coalesce("parent", "key").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("depth"), (F.col("parent").isNotNull() & F.col("__has").isNotNull()).alias("open"))
    state = stored(state, "session-closure")
    left, rounds = state.count(), 0
    while left >> rounds and not state.filter("open").isEmpty():
        to = state.select(F.col("key").alias("up"), F.col("up").alias("__up"), F.col("depth").alias("__depth"), F.col("open").alias("__open"))
        step = F.col("open") & F.col("__up").isNotNull()
        state = stored(
            state.join(to, "up", "left").select(
                "key", F.when(step, F.col("__up")).otherwise(F.col("up")).alias("up"), F.when(step, F.col("depth") + F.col("__depth")).otherwise(F.col("depth")).alias("depth"), (step & F.col("__open")).alias("open")
            ),
            "session-closure",
        )
        rounds += 1
    return state.select("key", F.when(~F.col("open"), F.col("up")).alias("root"), F.when(~F.col("open"), F.col("depth")).alias("depth"), F.col("open").alias("in_cycle"))


def rolled_up(closed: DataFrame, sessions: DataFrame) -> DataFrame:
    """(root, keys, depth, action_count, notable): what was done under a root key and all that were minted under it.  sessions: of ``session_chains``."""
    rows = closed.filter("NOT in_cycle").join(sessions.select("key", "action_count", "notable"), "key", "left")
    return rows.groupBy("root").agg(F.count("*").alias("keys"), F.max("depth").alias("depth"), F.coalesce(F.sum("action_count"), F.lit(0)).alias("action_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("notable")))).alias("notable"))


def as_of(events: DataFrame, snapshots: DataFrame, keys: Sequence[str], at: str, taken: str, bucket: Column | None = None, order: str | None = None) -> DataFrame:
    """The events with ``snapshot``: the last one of their keys taken not after them, as a struct, else null.

    An event without a key or time has none, and a snapshot without them is nobody's.  at, taken: comparable columns of events and snapshots; ``order`` decides between snapshots of one time.  Both sides are dealt by key and bucket of time (a day, by default), so that no task
    sees a key's whole log.  Each bucket begins with the last snapshot of the buckets before it, carried forward over a table of one row for each bucket that has any.
    """
    day = lambda c: F.col(c).cast("timestamp").cast("date") if bucket is None else bucket(F.col(c))
    whole = F.struct(*snapshots.columns)
    rank = F.struct(F.col(taken).alias("taken"), *([F.col(order).alias("order")] if order else []))
    right = snapshots.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], day(taken).alias("__bucket"), rank.alias("__rank"), whole.alias("__snapshot")).filter("__bucket IS NOT NULL")
    on = [f"__k{i}" for i in range(len(keys))]
    left = events.withColumns({k: F.col(c) for k, c in zip(on, keys, strict=True)}).withColumn("__bucket", day(at))
    ends = right.groupBy(*on, "__bucket").agg(F.max_by("__snapshot", "__rank").alias("__last"))
    asked = left.select(*on, "__bucket").distinct().join(ends, [*on, "__bucket"], "full_outer")
    before = Window.partitionBy(*on).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = asked.withColumn("__carried", F.last("__last", ignorenulls=True).over(before)).select(*on, "__bucket", "__carried")
    # a snapshot comes before an event of its time
    none = F.lit(None)
    rows = left.select(*on, "__bucket", F.struct(F.col(at).alias("at"), F.lit(1).alias("side")).alias("__place"), none.cast(right.schema["__rank"].dataType).alias("__rank"), none.cast(right.schema["__snapshot"].dataType).alias("__snapshot"), F.struct(*events.columns).alias("__event"))
    rows = rows.unionByName(right.select(*on, "__bucket", F.struct(F.col("__rank.taken").alias("at"), F.lit(0).alias("side")).alias("__place"), "__rank", "__snapshot", none.cast(rows.schema["__event"].dataType).alias("__event")))
    upto = Window.partitionBy(*on, "__bucket").orderBy("__place", "__rank").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("__within", F.last("__snapshot", ignorenulls=True).over(upto)).filter("__event IS NOT NULL")
    found = found.join(carried, [*on, "__bucket"], "left")
    nowhere = left.filter(" OR ".join(f"{c} IS NULL" for c in [*on, "__bucket"])).select(*events.columns, none.cast(right.schema["__snapshot"].dataType).alias("snapshot"))
    return found.filter(" AND ".join(f"{c} IS NOT NULL" for c in [*on, "__bucket"])).select("__event.*", F.coalesce("__within", "__carried").alias("snapshot")).unionByName(nowhere)
