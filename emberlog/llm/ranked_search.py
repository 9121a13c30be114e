"""Ranked lexical search for many items at once, with common subexpressions evaluated once.

Texts are read once: each becomes its number of terms and the counts of those terms that some item may have (a bitmap of fixed size tells; a few others
pass, which do no harm).  Items are then taken in blocks of bounded size.  In a block, terms that the same items have equally often are one sum; the items,
as sequences of such sums from the most to the least shared, are mined for neighbours that two or more of them have, and each such pair becomes a node of
a directed graph, again and again until nothing is shared.  For a slice of documents every sum and every node is computed once, children first, as an array
over the slice; an item's scores are the sum of the nodes that its sequence has shrunk to.  A task keeps the best documents of each item
only, so what is ranked after the shuffle grows with tasks, not with documents, and is ranked in two steps.

Scores are exact integers; equal scores go by ascending id.  A null text has no terms; a null id comes before all others.  Repeated documents have each
a rank of their own, repeated items each a ranking.  An item without terms, or without a document of a score above 0, has no rows; empty
tables give an empty result.  Texts are taken in slices of bounded bytes, so a long one costs no more memory than it needs itself.  Further columns don't matter.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_TERM, HashTable, Words, as_long, shared_dir, sliced, written

#: Bits of the bitmap of terms.
BITS = 1 << 24
_NO_ID = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Settings:
    top: int = 10
    block_items: int = 1024
    block_bytes: int = 1 << 20
    #: Cells of sums and nodes times documents that a task holds at once.
    cells: int = 1 << 21
    #: Parts in which an item's candidates are ranked first.
    parts: int = 64


def terms(texts: pa.Array) -> Words:
    """Maximal runs of ASCII letters, digits and characters beyond ASCII; A-Z lower-cased."""
    return Words(texts, NO_TERM)


# --- the block's graph ----------------------------------------------------------------------------------------------------------


class Graph:
    """How the items of a block share sums.

    ``hashes``: the terms.  A term of row ``t`` adds ``times`` its weight to each of the sums ``sum_of[first[t]:first[t + 1]]``.  Nodes are numbered after the
    sums; ``levels`` has (nodes, left, right) of nodes that rest on earlier levels alone.  Item ``i`` is the sum of ``parts[i]``.
    """

    def __init__(self, texts: list[str | None]):
        w = terms(pa.array(texts, pa.string()))
        has: dict[tuple[int, int], list[int]] = defaultdict(list)  # (term, times): items
        for i, (a, b) in enumerate(zip(w.first, w.first[1:])):
            for term, times in Counter(w.hash[a:b].tolist()).items():
                has[term, times].append(i)
        sums: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)  # items: their terms
        for term, items in has.items():
            sums[tuple(items)].append(term)
        order = sorted(sums, key=lambda items: (-len(items), items))
        self.hashes = np.array(sorted({term for term, _ in has}), np.uint64)
        row = {h: k for k, h in enumerate(self.hashes.tolist())}
        uses = sorted((row[term], k, times) for k, items in enumerate(order) for term, times in sums[items])
        self.first = np.searchsorted([u[0] for u in uses], np.arange(len(self.hashes) + 1))
        self.sum_of, self.times = np.array([u[1] for u in uses], np.int64), np.array([u[2] for u in uses], np.int64)
        self.parts: list[list[int]] = [[] for _ in texts]
        for k, items in enumerate(order):
            for i in items:
                self.parts[i].append(k)
        self.sums = self.nodes = len(order)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while self._mine():
            pass

    def _mine(self) -> bool:
        """One level: neighbours that several items have become nodes; the items' sequences shrink."""
        met = Counter(pair for part in self.parts for pair in zip(part, part[1:]))
        shared = {pair for pair, n in met.items() if n > 1}
        node: dict[tuple[int, int], int] = {}
        for i, part in enumerate(self.parts):
            out, at = [], 0
            while at < len(part):
                pair = tuple(part[at : at + 2])
                if pair in shared:
                    out.append(node.setdefault(pair, self.nodes + len(node)))
                else:
                    out.append(part[at])
                at += 2 if pair in shared else 1
            self.parts[i] = out
        if node:
            pairs = np.array(list(node), np.int64)
            self.levels.append((np.array(list(node.values()), np.int64), pairs[:, 0], pairs[:, 1]))
            self.nodes += len(node)
        return bool(node)

    def scores(self, term: np.ndarray, doc: np.ndarray, weight: np.ndarray, docs: int) -> np.ndarray:
        """Items times documents, from what each term adds to each document that has it."""
        n = self.first[term + 1] - self.first[term]
        use = np.repeat(self.first[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
        at = np.zeros((self.nodes, docs), np.int64)
        np.add.at(at, (self.sum_of[use], np.repeat(doc, n)), np.repeat(weight, n) * self.times[use])
        for nodes, left, right in self.levels:
            at[nodes] = at[left] + at[right]
        out = np.zeros((len(self.parts), docs), np.int64)
        for i, part in enumerate(self.parts):
            for k in part:
                out[i] += at[k]
        return out


# --- documents ------------------------------------------------------------------------------------------------------------------


def _counted(bitmap: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, text) as (id, n, terms, counts), without texts that have no term of the bitmap but for their n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(bitmap, np.uint8)).view(bool)
        for b in sliced(batches):
            w = terms(b["text"])
            here = np.flatnonzero(wanted[w.hash & np.uint64(BITS - 1)])
            doc, h = w.doc_of()[here], w.hash[here]
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            at = np.flatnonzero(new)
            counts = np.diff(np.append(at, len(h)))
            offsets = pa.array(np.searchsorted(doc[at], np.arange(len(b) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b["id"], pa.array(np.diff(w.first)), pa.ListArray.from_arrays(offsets, pa.array(as_long(h[at]))), pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32)))],
                ["id", "n", "terms", "counts"],
            )

    return run


def _best(item: np.ndarray, id: np.ndarray, score: np.ndarray, top: int) -> np.ndarray:
    """Indices of each item's first rows, highest scores first, then by id."""
    order = np.lexsort((id, -score, item))
    start = np.searchsorted(item[order], item[order])
    return order[np.arange(len(order)) - start < top]


def _ranked(graph: Graph, weights: np.ndarray, n_docs: int, n_terms: int, s: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's best documents of each item: (slot, doc, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = HashTable(graph.hashes)
        least, least_id = np.zeros(len(graph.parts), np.int64), np.full(len(graph.parts), _NO_ID)
        item = id = score = np.zeros(0, np.int64)
        step = max(1, s.cells // max(1, graph.nodes + len(graph.parts)))
        for b in (x.slice(at, step) for x in batches for at in range(0, len(x), step)):
            ids = b["id"].fill_null(int(_NO_ID)).to_numpy(zero_copy_only=False)
            offsets = np.diff(b["terms"].offsets.to_numpy())
            row = table.find(b["terms"].flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            known = row >= 0
            doc, row, tf = np.repeat(np.arange(len(b)), offsets)[known], row[known], b["counts"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)[known]
            m = np.array([25 + 75 * n * n_docs // n_terms if n else 0 for n in b["n"].to_pylist()], np.int64)
            got = graph.scores(row, doc, weights[row] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])), len(b))
            i, d = np.nonzero((got > 0) & ((got > least[:, None]) | ((got == least[:, None]) & (ids[None, :] < least_id[:, None]))))
            item, id, score = np.append(item, i), np.append(id, ids[d]), np.append(score, got[i, d])
            keep = _best(item, id, score, s.top)
            item, id, score = item[keep], id[keep], score[keep]
            last = np.flatnonzero(np.append(item[1:] != item[:-1], True)) if len(item) else np.zeros(0, np.int64)
            full = last[np.bincount(item, minlength=len(least))[item[last]] == s.top]
            least[item[full]], least_id[item[full]] = score[full], id[full]
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(id, mask=id == _NO_ID), pa.array(score)], ["slot", "doc", "score"])

    return run


# --- the search -----------------------------------------------------------------------------------------------------------------


def _bitmap(items: DataFrame, text: str) -> bytes:
    """Marks of the terms of all items; tasks mark their own, the driver joins marks of fixed size."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BITS, bool)
        for b in sliced(batches):
            seen[terms(b["text"]).hash & np.uint64(BITS - 1)] = True
        on = np.packbits(seen)
        at = np.flatnonzero(on)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(on[at].astype(np.int32))], ["at", "bits"])

    on = np.zeros(BITS // 8, np.uint8)
    for r in items.select(F.col(text).alias("text")).mapInArrow(marks, "at int, bits int").groupBy("at").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        on[r.at] = r.bits
    return on.tobytes()


def _blocks(items: DataFrame, id: str, text: str, s: Settings) -> Iterator[list[tuple[object, str | None]]]:
    block: list[tuple[object, str | None]] = []
    size = 0
    for r in items.select(F.col(id).alias("id"), F.col(text).alias("text")).toLocalIterator():
        if block and (len(block) == s.block_items or size + len(r.text or "") > s.block_bytes):
            yield block
            block, size = [], 0
        block.append((r.id, r.text))
        size += len(r.text or "")
    if block:
        yield block


def _first(found: DataFrame, top: int, *keys: str) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_first("doc")))).filter(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, s: Settings = Settings(), id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Each item's best documents: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    index = written(docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(_counted(_bitmap(items, item_text)), "id long, n long, terms array<long>, counts array<int>"), "terms")
    all_ = index.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    holders = written(index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "document-frequencies")
    kind = items.schema[item_id].dataType.simpleString()
    path = f"{shared_dir(spark).rstrip('/')}/rankings-{uuid.uuid4().hex}"
    schema = f"{item_id} {kind}, rank int, {id} long, score long"
    spark.createDataFrame([], schema).write.parquet(f"{path}/block=0")
    for k, block in enumerate(_blocks(items, item_id, item_text, s), 1):
        graph = Graph([t for _, t in block])
        asked = spark.createDataFrame(pa.table({"term": pa.array(as_long(graph.hashes))}))
        df = dict(holders.join(F.broadcast(asked), "term").select("term", "df").toLocalIterator())
        weights = np.array([math.floor(1000 * math.log((2 * all_.docs + 2) / (2 * df[h] + 1))) if h in df else 0 for h in as_long(graph.hashes).tolist()], np.int64)
        found = index.mapInArrow(_ranked(graph, weights, all_.docs, all_.terms, s), "slot int, doc long, score long")
        found = _first(found.withColumn("part", F.spark_partition_id() % s.parts), s.top, "slot", "part").drop("part", "rank")
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], f"slot int, item {kind}")
        out = _first(found, s.top, "slot").join(F.broadcast(names), "slot").select(F.col("item").alias(item_id), "rank", F.col("doc").alias(id), "score")
        out.write.parquet(f"{path}/block={k}")
    return spark.read.schema(f"{schema}, block int").parquet(path).drop("block")
