"""Benchmark decontamination: which test items lie, to a large part, inside which documents.

An item is contained in a document when the document has at least ``share`` of the item's
distinct shingles of five words (an item of fewer words is one shingle of all its words).
Words are runs of letters and digits, lower-cased; everything else parts them.

Search by MinHash containment: every item's signature are its shingles with the least hashes,
and a document is a candidate for the item when it has one of them.  Items are partitioned by
size, in bands of powers of two, and a band's signatures are as long as its largest items need:
a document that has the share of n shingles lacks at most n - ceil(share * n), so one more
than that always suffices and no contained item is missed, however long the document is.
(Banding whole documents' MinHash values, as for short documents, can't reach this: an item of 30
shingles in a document of 20,000 has a Jaccard similarity of 0.0015.)  Candidates are verified by
counting the item's shingles in the document.

Spark SQL throughout.  Items with equal shingle sets are one item, that of the smallest id.

Defined results: null and empty texts, and items without words, contain nothing and are
contained nowhere; repeated documents are each reported; columns other than ids and texts are
ignored; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh


@dataclass(frozen=True)
class Settings:
    words: int = 5
    share: float = 0.8
    broadcast_rows: int = 200_000  #: item shingles up to this number are broadcast, more are joined by a shuffle


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles_of(words: Column, n: int) -> Column:
    """Hashes of all runs of n words, in order."""
    one = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(F.lit(n), *[F.get(words, i + k) for k in range(n)]))
    return F.when(F.size(words) >= n, one).otherwise(F.array().cast("array<bigint>"))


def _items(benchmark: DataFrame, settings: Settings) -> DataFrame:
    """(item_id, copies, width, shingles, need, keys) of each distinct item."""
    rows = benchmark.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    width = F.least(F.size("words"), F.lit(settings.words))
    by_width = F.lit(None).cast("array<bigint>")
    for n in range(1, settings.words + 1):
        by_width = F.when(F.col("width") == n, shingles_of(F.col("words"), n)).otherwise(by_width)
    rows = rows.withColumn("width", width).withColumn("shingles", F.array_sort(F.array_distinct(by_width)))
    rows = rows.groupBy("width", "shingles").agg(F.min("item_id").alias("item_id"), F.count("*").alias("copies"))
    n = F.size("shingles")
    need = F.ceil(n * settings.share - 1e-9)
    # the longest signature that an item of the band may need
    top = F.pow(2.0, F.floor(F.log2(n.cast("double"))) + 1) - 1
    keys = F.least(n, top - F.ceil(top * settings.share - 1e-9) + 1).cast("int")
    # xxhash64 values are as good as any other least hashes: they are sorted already
    return rows.withColumn("need", need).withColumn("keys", F.slice("shingles", F.lit(1), keys))


def candidates(held: DataFrame, keys: DataFrame) -> DataFrame:
    """(row, held, item_id): documents with the items that they hold a key of.

    held: (row, held), the items' shingles in each document, and what else there is; keys: (item_id, shingle).
    """
    found = held.select("*", F.explode("held").alias("shingle")).join(keys, "shingle")
    return found.dropDuplicates(["row", "item_id"]).drop("shingle")


def find(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, item_id, shared, item_shingles, containment, item_copies: one row for each contained item."""
    items = checkpointed(_items(benchmark, settings))
    size, widths = items.agg(F.sum(F.size("shingles")), F.collect_set("width")).first()  # widths: 1 to 5
    small = (size or 0) <= settings.broadcast_rows
    held = lambda df: F.broadcast(df) if small else df
    keys = items.select("item_id", F.explode("keys").alias("shingle"))
    members = items.select(F.explode("shingles").alias("shingle")).distinct()
    # repeated rows are rows of their own; the number is only used within this plan
    words = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("words"))
    found = F.array().cast("array<bigint>")
    for n in sorted(widths):
        found = F.concat(found, shingles_of(F.col("words"), n))
    shingles = words.select("row", "doc_id", "text_key", F.explode(found).alias("shingle"))
    # of the documents' shingles only the items' own matter; most are gone before any shuffle
    hits = shingles.join(held(members), "shingle", "left_semi")
    found = candidates(hits.groupBy("row", "doc_id", "text_key").agg(F.collect_set("shingle").alias("held")), held(keys))
    facts = items.select("item_id", "copies", "shingles", F.size("shingles").alias("item_shingles"), "need")
    shared = found.join(held(facts), "item_id").withColumn("shared", F.size(F.array_intersect("held", "shingles")))
    out = shared.filter("shared >= need")
    return out.select(
        "doc_id",
        "text_key",
        "item_id",
        F.col("shared").cast("long").alias("shared"),
        F.col("item_shingles").cast("long").alias("item_shingles"),
        F.round(F.col("shared") / F.col("item_shingles"), 4).alias("containment"),
        F.col("copies").cast("long").alias("item_copies"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that contain no item; rows are told apart by id and text."""
    id, key = fresh(docs, "__id", "__key")
    hit = checkpointed(find(docs, benchmark, settings).select(F.col("doc_id").alias(id), F.col("text_key").alias(key)).distinct())
    few = hit.count() <= settings.broadcast_rows  # of two numbers each
    on = F.col("doc_id").eqNullSafe(F.col(id)) & (F.xxhash64("text") == F.col(key))
    return docs.join(F.broadcast(hit) if few else hit, on, "left_anti")
