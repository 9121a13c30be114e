"""N-gram Jaccard join with PartEnum signatures, and the groups that its links make.

A text's set is that of its distinct word shingles (64-bit hashes of them).  Two sets link when
``100 * |A and B| >= percent * |A or B|``; then their sizes differ little and their symmetric
difference is at most (|A| + |B|) * (100 - percent) / (100 + percent).

Sizes are cut into bands that overlap so far that two linked sets have a band in common.  With
k the largest difference in a band, the domain of shingles is dealt to k // 2 + 1 partitions, of
which one has at most one differing shingle between two linked sets, and each partition to two
or three parts.  Every subset of a partition's parts that leaves out one part is a signature: what the
set has there.  Linked sets share at least one.

Empty subsets would be shared by sets that have nothing in common, so they are no signatures.  To take from a set all
its filled subsets, two shingles have to change in each partition with two or three filled parts, and one in each with one
filled part.  A set that needs more changes than it may differ in from any other shares a filled subset with each
that it links with.  The other sets are few; they are dealt again with another seed, and add the signatures of
that: of two linked sets that were both among the few, either one is not any more, or both are dealt once more.  Only what is left after
``deals`` rounds has signatures of empty subsets.  Where a change takes one signature at most, one more than the
changes is enough: each set takes its least, and the least that two linked sets share is among those of both.

Signatures are made and shuffled once: a window over each signature's rows keeps those that two sets share.

Texts with equal sets are one node.  Nodes that share a signature are candidates, in two rounds, so that a large group of
near copies costs a few pairs for each member, not all pairs.  First each node is compared with its anchor: of the nodes in its
signatures' hubs (who meet the most others for their size) the one of most signatures.  Then come the nodes that are still in different components:

* Nodes of a signature with at most ``crowd`` nodes are compared with each other.
* Nodes of a larger one (a passage that very many texts share) must meet once more: linked sets have one of their first shingles in
  common, if all sets are put into one order and each gives as many as it may lack, plus one; the order is from rare to frequent by a table
  of counts of fixed size, so that such a passage comes last.
* Where more than ``crowd`` nodes differ from one representative by at most twice what linked sets may, they are a crowd, and its nodes meet
  each other by those differences only: two sets differ in as many shingles as their differences do, so the same order tells which may link.

A pair is given up early where sizes or the parities of the sets' shingles in 512 cells, for large sets also in 16384 (a lower bound of their difference), rule
a link out; each other pair is decided on the sets themselves, and no pair that links is left out.

Defined results: texts without words have an empty set and are linked with nothing; null ids
stay null and count as the smallest; repeated rows are a group; columns other than id and text
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, as_long, checkpointed, forget, fresh, mix, narrow, sliced, small_batches, written


@dataclass(frozen=True)
class Settings:
    words: int = 3  #: words of a shingle
    percent: int = 90
    growth: float = 1.3  #: of the sizes from one band to the next
    crowd: int = 20  #: nodes of a signature that are all compared; those of larger ones meet by their rare shingles
    deals: int = 8  #: rounds of dealing shingles to partitions, for sets that are badly dealt
    seen: int = 100_000  #: sets that a task remembers so as to sign copies once; a matter of speed only
    slice_bytes: int = 1 << 20  #: bytes of text at a time
    broadcast_rows: int = 1_000_000  #: ids up to this number are broadcast, more are joined by a shuffle


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    w = Words(texts)
    h = w.hash * np.uint64(0x9E3779B97F4A7C15)
    rolled = h.copy()
    for i in range(1, words):
        rolled[: len(h) - i] = mix(rolled[: len(h) - i]) + h[i:]
    rolled = mix(rolled)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= words:
            s = np.sort(rolled[a : b - words + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif b > a:  # the whole sequence is the one shingle
            x = np.full(1, b - a, np.uint64)
            for i in range(a, b):
                x = mix(x) + h[i : i + 1]
            out.append(mix(x))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _node(s: np.ndarray) -> int:
    """A hash of a set."""
    return int(as_long(mix(np.array([mix(s ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)))[0]) if len(s) else 0


def _bands(settings: Settings, most: int) -> list[tuple[int, int, int]]:
    """(smallest size, largest size, largest difference) of each band up to a size."""
    out, low, p = [], 1, settings.percent
    while low <= most:
        high = max(low, int(low * settings.growth))
        out.append((-(-low * p // 100), high, 2 * high * (100 - p) // (100 + p)))
        low = high + 1
    return out


def signatures(s: np.ndarray, bands: list[tuple[int, int, int]], seed: int, percent: int = 90, deals: int = 8) -> np.ndarray:
    """The signatures of a set; none where only equal sets can link."""
    out = []
    value = mix(s + np.uint64(0x632BE59BD9B4E019))
    low, high = (value & np.uint64(0xFFFFFFFF)).astype(np.float64), (value >> np.uint64(32)).astype(np.float64)
    for number, (least, most, k) in enumerate(bands):
        if not least <= len(s) <= most or not k:
            continue
        n1 = k // 2 + 1
        n2 = 3 if n1 <= 8 else 2
        largest = min(most, len(s) * 100 // percent)  # of the sets that this one may link with
        differing = (len(s) + largest) * (100 - percent) // (100 + percent)
        for deal in range(deals):
            dealt = mix(s ^ np.uint64(seed + deal))
            part = ((dealt >> np.uint64(32)) * np.uint64(n1)) >> np.uint64(32)
            cell = (part * np.uint64(n2) + (((dealt & np.uint64(0xFFFFFFFF)) * np.uint64(n2)) >> np.uint64(32))).astype(np.int64)
            sums = np.bincount(cell, low, n1 * n2).astype(np.uint64) + (np.bincount(cell, high, n1 * n2).astype(np.uint64) << np.uint64(32))
            sums = sums.reshape(n1, n2)
            without = sums.sum(1, dtype=np.uint64)[:, None] - sums
            found = mix(without.ravel() + mix(np.arange(n1 * n2, dtype=np.uint64) + np.uint64((number << 32) + (deal << 48))))
            filled = np.bincount(cell, minlength=n1 * n2).reshape(n1, n2) > 0
            parts = filled.sum(1)
            well = np.minimum(parts, 2).sum() > differing
            if well or deal < deals - 1:
                found = found[(parts[:, None] > filled).ravel()]
            if well and n2 == 2:  # each change takes one of them, so any linked set has one of these
                found = np.sort(found)[: differing + 1]
            out.append(found)
            if well:
                break
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _nodes(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, settings.slice_bytes):
            sets = shingle_sets(b["text"], settings.words)
            yield pa.record_batch({"id": b["id"], "key": b["key"], "n": pa.array([len(s) for s in sets], pa.int64()), "node": pa.array([_node(s) for s in sets], pa.int64())})

    return run


def _signed(settings: Settings, seed: int):
    """(signature, node) of each text; of a text that a task has seen lately, nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands: list[tuple[int, int, int]] = []
        seen: set[int] = set()
        for b in sliced(batches, settings.slice_bytes):
            sets = shingle_sets(b["text"], settings.words)
            most = max(map(len, sets), default=0)
            if not bands or bands[-1][1] < most:
                bands = _bands(settings, max(most, 1000))
            sig, node, n = [], [], []
            for s in sets:
                k = _node(s)
                if k in seen:
                    continue
                if len(seen) >= settings.seen:
                    seen.clear()
                seen.add(k)
                sig.append(signatures(s, bands, seed, settings.percent, settings.deals))
                node.append(k)
                n.append(len(sig[-1]))
            if sig:
                yield pa.record_batch({"sig": as_long(np.concatenate(sig)), "node": np.repeat(np.array(node, np.int64), n)})

    return run


def _sets(settings: Settings):
    """The set of each text, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, settings.slice_bytes):
            sets = shingle_sets(b["text"], settings.words)
            yield pa.record_batch({"node": pa.array([_node(s) for s in sets], pa.int64()), "members": pa.array([s.tobytes() for s in sets], pa.binary())})

    return run


#: Cells of a set's outline, and of the finer one by which large sets are told apart, from so many shingles on.
_CELLS, _FINE_CELLS, _LARGE = 1 << 9, 1 << 14, 512


def parities(s: np.ndarray, cells: int = _CELLS) -> np.ndarray:
    """Whether each cell holds an odd number of the set's shingles, as 64-bit words: two sets differ in at least as many shingles as cells."""
    odd = np.bincount((mix(s ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(65 - cells.bit_length())).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _outlines(settings: Settings, cells: int = _CELLS):
    """Size and parities of the set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, settings.slice_bytes):
            sets = shingle_sets(b["text"], settings.words)
            odd = pa.array([parities(s, cells) for s in sets], pa.list_(pa.int64()))
            yield pa.record_batch({"node": pa.array([_node(s) for s in sets], pa.int64()), "n": pa.array([len(s) for s in sets], pa.int32()), "odd": odd})

    return run


_ORDER_BITS, _ORDER_BLOCK = 22, 1 << 12


def _slot(s: np.ndarray) -> np.ndarray:
    return (mix(s ^ np.uint64(0x14057B7EF767814F)) >> np.uint64(64 - _ORDER_BITS)).astype(np.int64)


def _counted(settings: Settings):
    """How many sets have a shingle in each slot of a table of fixed size, by blocks of slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << _ORDER_BITS, np.int32)
        for b in sliced(batches, settings.slice_bytes):
            for s in shingle_sets(b["text"], settings.words):
                np.add.at(table, _slot(s), 1)
        for i, block in enumerate(table.reshape(-1, _ORDER_BLOCK)):
            if block.any():
                yield pa.record_batch({"block": pa.array([i], pa.int32()), "counts": pa.array([block.tobytes()], pa.binary())})

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for i, x in zip(b["block"].to_pylist(), b["counts"].to_pylist(), strict=True):
            total[i] = total.get(i, 0) + np.frombuffer(x, np.int32).astype(np.int64)
    if total:
        most = (1 << 31) - 1
        yield pa.record_batch({"block": pa.array(list(total), pa.int32()), "counts": pa.array([np.minimum(x, most).astype(np.int32).tobytes() for x in total.values()], pa.binary())})


def _first_shingles(settings: Settings, order):
    """(shingle, node): of each set as many shingles as a linked one may lack, plus one, the rare ones first.  What no other set has is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: np.ndarray = order.value
        for b in sliced(batches, settings.slice_bytes):
            sets = [s for s in shingle_sets(b["text"], settings.words) if len(s)]
            if sets:
                first = []
                for s in sets:
                    often = table[_slot(s)]
                    kept = np.lexsort((s, often))[: len(s) + 1 - -(-settings.percent * len(s) // 100)]
                    first.append(s[kept[often[kept] > 1]])
                yield pa.record_batch({"shingle": as_long(np.concatenate(first)), "node": np.repeat(np.array([_node(s) for s in sets], np.int64), [len(f) for f in first])})

    return run


def _compared(settings: Settings, reach: int):
    """The pairs (a, b, x, y) whose sets differ by at most ``reach`` times what linked sets may: with linked, m and, for a reach of 2, the difference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = settings.percent
        for b in batches:
            out = []
            for i, (x, y) in enumerate(zip(b["x"], b["y"], strict=True)):
                s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate([s, t])
                both.sort()
                again = both[1:] == both[:-1]
                m, k = len(both) - 2 * int(np.count_nonzero(again)), len(both) * (100 - p) // (100 + p)
                if m <= reach * k:
                    kept = as_long(both[~(np.append(again, False) | np.append(False, again))]) if reach > 1 else None
                    out.append((i, m <= k, m, len(t), kept))
            at = pa.array([o[0] for o in out], pa.int64())
            columns = [b["a"].take(at), b["b"].take(at), pa.array([o[1] for o in out], pa.bool_()), *(pa.array([o[i] for o in out], pa.int32()) for i in (2, 3)), pa.array([o[4] for o in out], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _PAIR.split(", ")])

    return run


_PAIR = "a long, b long, linked boolean, m int, n int, difference array<long>"
_SALTS, _OFTEN = 16, 500  #: a set of more than so many pairs is copied to so many places


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``links`` (a, b): the smallest node that links reach."""
    edges = narrow(links.select("a", "b").union(links.select("b", "a")).distinct(), 1)
    labels = narrow(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")), 1)
    while True:
        near = edges.join(labels.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("root").alias("near"))
        stepped = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("next"))
        # a jump: the root's own root
        up = labels.select(F.col("node").alias("next"), F.col("root").alias("far"))
        moved = narrow(stepped.join(up, "next").select("node", F.col("root").alias("old"), F.least("next", "far").alias("root")), 1)
        labels = moved.select("node", "root")
        if moved.filter(F.col("old") != F.col("root")).isEmpty():
            return labels


_NULL = -(1 << 63)


class Join:
    def __init__(self, docs: DataFrame, settings: Settings = Settings()):
        self.settings = settings
        small_batches(docs.sparkSession)
        self.docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
        keyed = self.docs.withColumn("key", F.xxhash64("text"))
        self.nodes = checkpointed(keyed.mapInArrow(_nodes(settings), "id long, key long, n long, node long"))
        distinct = narrow(self.nodes.filter("n > 0").groupBy("node").agg(F.min("id").alias("id"), F.max("n").alias("n")))
        self.first, self.sizes = distinct.select("node", "id"), distinct.select("node", "n")

    def texts(self, nodes: DataFrame) -> DataFrame:
        """(id, text) of one row for each node."""
        ids = narrow(self.first.join(nodes, "node", "left_semi").select("id"))
        few = ids.count() <= self.settings.broadcast_rows
        return self.docs.join(F.broadcast(ids) if few else ids, "id", "left_semi")

    def all_links(self) -> DataFrame:
        """Links that make the same components as all links do."""
        signed = self.docs.mapInArrow(_signed(self.settings, 1), "sig long, node long")
        own = Window.partitionBy("sig")
        shared = signed.withColumns({"low": F.min("node").over(own), "high": F.max("node").over(own)}).filter("low < high")
        members = written(shared.select("sig", "node").distinct(), "jaccard-members")
        # how many others a node meets in its signatures, for its size: copies with few changes meet the most, and of a common passage the texts with little else
        size = narrow(members.groupBy("sig").agg((F.count("*") - 1).alias("others")))
        met = members.join(size, "sig").groupBy("node").agg(F.sum("others").alias("others"))
        weight = narrow(met.join(self.sizes, "node").select("node", (F.col("others") / F.col("n")).alias("weight")))
        hubs = members.join(weight, "node").groupBy("sig").agg(F.max(F.struct("weight", "node")).alias("hub"))
        votes = members.join(hubs, "sig").groupBy("node", "hub").agg(F.count("*").alias("votes"))
        anchors = narrow(votes.groupBy("node").agg(F.max(F.struct("votes", "hub"))["hub"]["node"].alias("anchor")))
        anchored = anchors.filter("node <> anchor").select(F.col("anchor").alias("a"), F.col("node").alias("b"))
        near = self._near(anchored, 2)
        links = narrow(near.filter("linked").select("a", "b"))
        roots = components(links)
        crowds = self._crowds(near, anchored, weight, roots)
        pairs = self._met(members.join(size.filter(F.col("others") < self.settings.crowd), "sig", "left_semi"), "sig", roots, crowds)
        large = self._mixed(members.join(size.filter(F.col("others") >= self.settings.crowd), "sig", "left_semi"), "sig", roots, crowds)
        if not large.isEmpty():
            pairs = pairs.union(self._met(self._rare_shingles(large.select("node")), "shingle", roots, crowds))
        if not crowds.isEmpty():
            pairs = pairs.union(self._met_in_crowds(crowds, roots))
        tried = anchors.select(F.least("anchor", "node").alias("a"), F.greatest("anchor", "node").alias("b"))
        found = self._near(pairs.distinct().join(tried, ["a", "b"], "left_anti"), 1)
        inside = crowds.filter("linked AND node <> chief").select(F.col("chief").alias("a"), F.col("node").alias("b"))
        out = narrow(links.union(inside).union(found.filter("linked").select("a", "b")))
        forget(members)
        return out

    def _near(self, pairs: DataFrame, reach: int) -> DataFrame:
        """Of the pairs of nodes (a, b) those whose sets differ by at most ``reach`` (1 or 2) times what linked sets may: with linked, m, n, difference.

        The sets of nodes that are the ``a`` of very many pairs are dealt to several tasks.
        """
        pairs = narrow(pairs)
        p, settings = self.settings.percent, self.settings

        def with_both(df: DataFrame, made, schema: str) -> DataFrame:
            """What ``made`` tells of the sets of a and b, joined to the pairs; rows with equal ids may bring a set twice."""
            a, b = (self.texts(df.select(F.col(c).alias("node")).distinct()).mapInArrow(made, schema) for c in "ab")
            values = [c for c in a.columns if c != "node"]
            a = a.select(F.col("node").alias("a"), *[F.col(c).alias(f"{c}_a") for c in values])
            b = b.select(F.col("node").alias("b"), *[F.col(c).alias(f"{c}_b") for c in values])
            often = df.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > _OFTEN).select("a", F.lit(True).alias("often"))
            if often.isEmpty():
                return df.join(a, "a").join(b, "b")
            salts = F.when(F.col("often"), F.array(*[F.lit(i) for i in range(_SALTS)])).otherwise(F.array(F.lit(0)))
            salted = df.join(often, "a", "left").withColumn("salt", F.when(F.col("often"), F.pmod(F.xxhash64("b"), F.lit(_SALTS)).cast("int")).otherwise(0)).drop("often")
            a = a.join(often, "a", "left").withColumn("salt", F.explode(salts)).drop("often")
            return salted.join(a, ["a", "salt"]).drop("salt").join(b, "b")

        apart = F.aggregate(F.zip_with("odd_a", "odd_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
        may = (100 + p) * apart <= reach * (100 - p) * (F.col("n_a") + F.col("n_b"))
        if reach == 1:
            may = may & (100 * F.least("n_a", "n_b") >= p * F.greatest("n_a", "n_b"))
        outline = "node long, n int, odd array<long>"
        left = narrow(with_both(pairs, _outlines(settings), outline).filter(may).select("a", "b", (F.greatest("n_a", "n_b") >= _LARGE).alias("large")).distinct())
        # outlines of so few cells are full for large sets, whose members are long to ship
        large = left.filter("large").drop("large")
        if not large.isEmpty():
            fine = with_both(large, _outlines(settings, _FINE_CELLS), outline).filter(may).select("a", "b").distinct()
            left = narrow(left.filter("NOT large").drop("large").union(fine))
        both = with_both(left.select("a", "b"), _sets(settings), "node long, members binary").select("a", "b", F.col("members_a").alias("x"), F.col("members_b").alias("y"))
        return checkpointed(both.mapInArrow(_compared(settings, reach), _PAIR).dropDuplicates(["a", "b"]))

    def _crowds(self, near: DataFrame, anchored: DataFrame, weight: DataFrame, roots: DataFrame) -> DataFrame:
        """(label, chief, node, linked, m, n, difference): nodes near the representative of more than ``crowd`` nodes that had their anchors in one component.

        The representative, or chief, is the anchor that meets the most others; it is in the table itself.
        """
        named = near.join(roots.withColumnRenamed("node", "a"), "a", "left").select(F.coalesce("root", "a").alias("label"), "a", "b")
        large = named.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") > self.settings.crowd)
        named = narrow(named.join(large, "label", "left_semi"))
        if named.isEmpty():
            return named.select("label", F.col("a").alias("chief"), F.col("b").alias("node"), F.lit(False).alias("linked"), F.lit(0).alias("m"), F.lit(0).alias("n"), F.array().cast("array<long>").alias("difference"))
        chief = named.select("label", F.col("a").alias("node")).distinct().join(weight, "node").groupBy("label").agg(F.max(F.struct("weight", "node"))["node"].alias("chief"))
        nodes = named.select("label", F.col("b").alias("node")).union(named.select("label", F.col("a").alias("node"))).distinct()
        nodes = narrow(nodes.groupBy("node").agg(F.min("label").alias("label")).join(chief, "label"))
        # most have been compared with the chief as their anchor
        wanted = nodes.filter("node <> chief").select(F.col("chief").alias("a"), F.col("node").alias("b"))
        known = near.join(wanted, ["a", "b"], "left_semi")
        compared = known.unionByName(self._near(wanted.join(anchored, ["a", "b"], "left_anti"), 2))
        others = compared.join(nodes.withColumnRenamed("node", "b"), "b").select("label", "chief", F.col("b").alias("node"), "linked", "m", "n", "difference")
        own = chief.select("label", "chief", F.col("chief").alias("node"), F.lit(True).alias("linked"), F.lit(0).alias("m"), F.lit(0).alias("n"), F.array().cast("array<long>").alias("difference"))
        return checkpointed(others.union(own))

    def _mixed(self, rows: DataFrame, key: str, roots: DataFrame, crowds: DataFrame) -> DataFrame:
        """The rows (key, node) with root and unit, of keys that more than one unit has.

        A unit are the nodes of a crowd that link with its representative, its other nodes, or the nodes of a component outside crowds.
        """
        crowd = crowds.select("node", F.col("label").alias("crowd"), "linked")
        rows = rows.join(roots, "node", "left").join(crowd, "node", "left").select(key, "node", F.coalesce("root", "node").alias("root"), "crowd", "linked")
        # (component or crowd, kind): 0 a component outside crowds, 1 a crowd's nodes in the component of its representative, 2 its other nodes
        kind = F.when(F.col("crowd").isNull(), 0).when(F.col("linked") | (F.col("crowd") == F.col("root")), 1).otherwise(2)
        rows = rows.withColumn("unit", F.struct(F.when(kind == 0, F.col("root")).otherwise(F.col("crowd")).alias("of"), kind.alias("kind")))
        mixed = rows.groupBy(key).agg(F.min("unit").alias("low"), F.max("unit").alias("high")).filter("low <> high").select(key)
        return narrow(rows.join(mixed, key))

    def _met(self, rows: DataFrame, key: str, roots: DataFrame, crowds: DataFrame) -> DataFrame:
        """Pairs of nodes of different components in one ``key``, but for those of one crowd.

        Units meet before nodes do, so a key that only one component or crowd has costs nothing, and one that a few more nodes have costs those.
        """
        p = self.settings.percent
        rows = self._mixed(rows, key, roots, crowds).join(self.sizes, "node")
        units = rows.select(key, "unit").distinct()
        # units of one name may hold links only where one is a component outside crowds and the other a crowd's other nodes
        may = (F.col("unit_a.of") != F.col("unit_b.of")) | (F.struct("unit_a.kind", "unit_b.kind") == F.struct(F.lit(0), F.lit(2)))
        met = units.withColumnRenamed("unit", "unit_a").join(units.withColumnRenamed("unit", "unit_b"), key).filter((F.col("unit_a") < F.col("unit_b")) & may)
        one, two = (rows.select(key, F.col("unit").alias(f"unit_{n}"), F.col("node").alias(f"node_{n}"), F.col("root").alias(f"root_{n}"), F.col("n").alias(f"n_{n}")) for n in "ab")
        near = 100 * F.least("n_a", "n_b") >= p * F.greatest("n_a", "n_b")
        pairs = met.join(one, [key, "unit_a"]).join(two, [key, "unit_b"]).filter((F.col("root_a") != F.col("root_b")) & near)
        return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))

    def _met_in_crowds(self, crowds: DataFrame, roots: DataFrame) -> DataFrame:
        """Pairs of nodes of one crowd that may link, where at least one doesn't link with the representative.

        Sets that differ from the representative's in X and Y differ from each other in as many shingles as X and Y do.  So with k the
        largest difference that sets of the crowd may have, a pair links only if |X and Y| >= (|X| + |Y| - k) / 2.  One of them, the
        outsider, has at least the smallest difference ``least`` of all outsiders, hence the other shares at least (its own + least - k) / 2
        shingles with it; and an outsider shares at least |X| - k with a node inside.  With shingles ordered from rare to frequent, the
        first |X| - overlap + 1 of both have one in common.  Where no overlap is needed a mark stands for it.
        """
        p = self.settings.percent
        d = crowds.filter("node <> chief").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        facts = d.groupBy("label").agg(F.floor(2 * F.max("n") * (100 - p) / (100 + p)).alias("k"), F.min(F.when(~F.col("linked"), F.col("m"))).alias("least")).filter("least IS NOT NULL")
        d = checkpointed(d.join(facts, "label"))
        each = d.select("label", "node", F.explode("difference").alias("shingle"))
        often = each.groupBy("label", "shingle").agg(F.count("*").alias("often"))
        listed = each.join(often, ["label", "shingle"]).groupBy("label", "node").agg(F.array_sort(F.collect_list(F.struct("often", "shingle"))).alias("listed"))
        need = lambda o: F.greatest(o.cast("int"), F.lit(1))
        first_of = lambda overlap: F.slice("listed.shingle", F.lit(1), F.greatest(F.col("m") - overlap + 1, F.lit(0)))
        mark = lambda c, cond: F.when(cond, F.concat(c, F.array(F.lit(0).cast("long")))).otherwise(c)
        half = F.ceil((F.col("m") + F.col("least") - F.col("k")) / 2)
        x = d.drop("difference").join(listed, ["label", "node"]).select(
            "label", "node", "root", "linked", "m", "k",
            mark(first_of(need(half)), F.col("m") <= F.col("k") - F.col("least")).alias("half"), mark(first_of(need(F.col("m") - F.col("k"))), F.col("m") < F.col("k")).alias("long"),
        )
        x = checkpointed(x)
        side = lambda rows, c, n: rows.select("label", F.explode(c).alias("shingle"), F.col("node").alias(f"node_{n}"), F.col("root").alias(f"root_{n}"))
        outside, inside = x.filter(~F.col("linked")), x.filter("linked")
        apart = side(outside, "half", "a").join(side(outside, "half", "b"), ["label", "shingle"]).filter("node_a < node_b")
        across = side(outside.filter(F.col("m") <= 2 * F.col("k")), "long", "a").join(side(inside, "half", "b"), ["label", "shingle"])
        return apart.union(across).filter("root_a <> root_b").select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))

    def _rare_shingles(self, nodes: DataFrame) -> DataFrame:
        """(shingle, node) of the first shingles of each of the nodes."""
        texts = self.texts(nodes)
        context = texts.sparkSession.sparkContext
        blocks = texts.mapInArrow(_counted(self.settings), "block int, counts binary").repartition("block").mapInArrow(_summed, "block int, counts binary")
        table = np.zeros(1 << _ORDER_BITS, np.int32)
        for block, counts in blocks.toLocalIterator():  # 2**22 counts at most
            table[block * _ORDER_BLOCK : (block + 1) * _ORDER_BLOCK] = np.frombuffer(counts, np.int32)
        order = context.broadcast(table)
        return texts.mapInArrow(_first_shingles(self.settings, order), "shingle long, node long").distinct()

    def named(self) -> DataFrame:
        """node and the least id of its component, with the component's root."""
        roots = components(self.all_links())
        named = self.first.join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
        least = named.groupBy("root").agg(F.min("id").alias("least"))
        return named.join(least, "root").select("node", "root", "least")

    def groups(self) -> DataFrame:
        """doc_id, n_shingles, component_id of every row."""
        null = lambda c: F.when(F.col(c) != _NULL, F.col(c))
        full = self.nodes.filter("n > 0").join(self.named(), "node").select("id", "n", "least")
        empty = self.nodes.filter("n = 0").select("id", "n", F.col("id").alias("least"))
        return full.union(empty).select(null("id").alias("doc_id"), F.col("n").alias("n_shingles"), null("least").alias("component_id"))


def join_groups(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``."""
    return Join(docs, settings).groups()


def keep_first(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row of ``docs`` for each group of links: that of the smallest id, and of the smallest text hash among those.

    A null id is the smallest.  Of rows with equal ids and texts any one stays.  Texts without words are no group and stay.
    """
    join = Join(docs, settings)
    rows = narrow(join.nodes.filter("n > 0").join(join.named().select("node", "root"), "node").groupBy("root", "id", "key").agg(F.count("*").alias("copies")))
    first = rows.groupBy("root").agg(F.min(F.struct("id", "key")).alias("f")).select("root", F.col("f.id").alias("first"), F.col("f.key").alias("first_key"))
    marked = rows.join(first, "root").withColumn("goes", (F.col("id") != F.col("first")) | (F.col("key") != F.col("first_key")))
    id, key = fresh(docs, "__id", "__key")
    marked = narrow(marked.select(F.col("id").alias(id), F.col("key").alias(key), "goes", "copies").filter("goes OR copies > 1"))
    few = marked.count() <= settings.broadcast_rows  # of two numbers each
    on = (F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)) == F.col(id)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(key))
    gone = marked.select(id, key).distinct()
    kept = docs.join(F.broadcast(gone) if few else gone, on, "left_anti")
    repeated = marked.groupBy(id, key).agg(F.every("goes").alias("goes")).filter("NOT goes").select(id, key)
    if repeated.isEmpty():
        return kept
    return kept.unionByName(docs.join(repeated, on, "left_semi").dropDuplicates(["doc_id", "text"]))
