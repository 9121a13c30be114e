"""Document fingerprints by consistent weighted sampling.

The terms of a text are its words, weighted by how often they occur.  For each of
``samples`` draws a term has gamma variables r and c and a uniform b, all taken from hashes of
the term and the draw; with t = floor(ln(weight) / r + b) its value is c * exp(-r (t - b + 1)),
and the term with the least value is the sample.  Two texts have the same sample with a
probability equal to their generalised Jaccard similarity (sum of the smaller weights over the
sum of the larger ones).  The least value itself stands for the sample, as it depends on the
term and t alone; a fingerprint holds 16 bits of a hash of each.

Defined results: a null text counts as empty; a text without words has a fingerprint of its
own, which only equals that of another such text; repeated rows come back each on its own;
rows with equal ids follow each other by text, in one task, and null ids come first; an empty table gives an empty result; other
columns are ignored.  Ties of the least value go to neither term, as the value stands for the sample.  A long text is taken alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, mix, sliced


@dataclass(frozen=True)
class Settings:
    samples: int = 64  #: a multiple of 16
    rows_at_once: int = 512
    chars_at_once: int = 4_000_000  #: or one text
    rows_in_range: int = 5000  #: ids that one task orders, about
    most_ranges: int = 1 << 16  #: of which the driver knows the first ids; beyond it ranges grow, which tasks sort with spilling and read in slices


_F = np.float32


def _exponentials(terms: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Exponential variables, two for each term and seed; small ones keep their precision."""
    v = mix(terms[:, None] ^ seeds[None, :]).view(np.uint32).astype(np.float32)
    v += _F(0.5)
    v *= _F((1 - 2.0**-24) * 2.0**-32)
    series = v * (_F(1) + v * (_F(0.5) + v * _F(1 / 3)))
    return np.where(v < _F(2.0**-7), series, -np.log(_F(1) - v))


def sampled(texts: pa.Array, samples: int) -> np.ndarray:
    """One row of ``samples`` 16-bit values for each text.

    From independent exponentials e, f, g of a term and draw come c = e + f (gamma), the gap
    d = ln(1 + f / e) (exponential, independent of c), r = d + g (gamma) and b = 1 - d / r
    (uniform).  A term of weight 1 has t = 0 and the value c * exp(-d) = e.
    """
    w = Words(texts)
    n = len(w.first) - 1
    out = np.zeros((n, samples), np.uint16)
    if not len(w.hash):
        return out
    terms, code = np.unique(w.hash, return_inverse=True)
    cell, tf = np.unique(w.doc_of() * len(terms) + code, return_counts=True)
    doc, term = cell // len(terms), cell % len(terms)
    at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    many = np.flatnonzero(tf > 1)
    log_tf = np.log(tf[many]).astype(np.float32)[:, None]
    often, rows = np.unique(term[many], return_inverse=True)
    salt = mix((np.arange(3 * samples // 2, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    for k in range(0, samples, 16):  # 16 draws at a time, so that the tables stay small
        part, seeds = slice(k, k + 16), [salt[i * samples // 2 :][k // 2 : k // 2 + 8] for i in range(3)]
        e = _exponentials(terms, seeds[0])
        value = e.take(term, 0)
        e, f, g = e[often], _exponentials(terms[often], seeds[1]), _exponentials(terms[often], seeds[2])
        d = np.log1p(f / e)
        r, c = (d + g).take(rows, 0), (e + f).take(rows, 0)
        b = _F(1) - d.take(rows, 0) / r
        t = np.floor(log_tf / r + b)
        value[many] = np.where(t == 0, e.take(rows, 0), c * np.exp(-r * (t - b + _F(1))))  # for t = 0 to the last bit as of weight 1
        least = np.minimum.reduceat(value, at, 0)
        bits = mix(np.ascontiguousarray(least).view(np.uint32).astype(np.uint64) + np.uint64(1))
        out[doc[at], part] = (bits >> np.uint64(48)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal samples, row by row."""
    return (a == b).mean(1)


def as_text(rows: np.ndarray) -> list[str]:
    return [x.tobytes().hex() for x in rows.astype(">u2")]


def edited(text: str, following: str) -> str:
    """``text`` with its last half, rounded down, replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id and fingerprint of each row, without any shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in sliced(batches):
            for i in range(0, len(whole), settings.rows_at_once):
                b = whole.slice(i, settings.rows_at_once)
                yield pa.record_batch({"doc_id": b["doc_id"], "fingerprint": as_text(sampled(b["text"], settings.samples))})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


_NULL = -(1 << 63)


def _compare(settings: Settings):
    """For rows in the order of slice, ahead, id, text: each row with the one after it in its slice."""

    def report(ids: list[int], texts: list[str]) -> pa.RecordBatch:
        changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        prints = sampled(pa.array(texts + changed, pa.large_string()), settings.samples)
        n, edits = len(changed), prints[len(texts) :]
        return pa.record_batch(
            {
                "doc_id": pa.array([None if i == _NULL else i for i in ids[:n]], pa.int64()),
                "n_chars": pa.array([len(t) for t in texts[:n]], pa.int64()),
                "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
                "fingerprint": as_text(prints[:n]),
                "edited_fingerprint": as_text(edits),
                "near_edited": likeness(prints[:n], edits),
                "near_next": likeness(prints[:n], prints[1 : n + 1]),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, closed, size = None, False, 0
        ids: list[int] = []
        texts: list[str] = []
        for b in sliced(batches):
            for part, ahead, i, text in zip(*(b[c].to_pylist() for c in ("slice", "ahead", "id", "text")), strict=True):
                if part != now or len(ids) > settings.rows_at_once or size > settings.chars_at_once:
                    if len(ids) > 1:
                        yield report(ids, texts)
                    same = part == now
                    ids, texts, now, closed = (ids[-1:], texts[-1:], part, closed) if same else ([], [], part, False)
                    size = sum(map(len, texts))
                if not closed:
                    ids.append(i)
                    texts.append(text)
                    size += len(text)
                    closed = ahead
        if len(ids) > 1:
            yield report(ids, texts)

    return run


def edit_report(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Fingerprints of every text and of its edit with the text of the next higher id.

    Tasks get ranges of ids and order them.  The first row of each range is also sent to the
    range before it (that of the first range to the last one), so every row meets the next one
    in its own task and the texts are shuffled once.  The driver has one id for each task.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.coalesce("doc_id", F.lit(_NULL)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    n = rows.count()
    if not n:
        return spark.createDataFrame([], _OUT)
    ranges = min(-(-n // settings.rows_in_range), settings.most_ranges)
    cuts = np.array(sorted({int(c) for c in rows.approxQuantile("id", [i / ranges for i in range(1, ranges)], 0.1 / ranges)}) if ranges > 1 else [], np.int64)

    @F.pandas_udf("long")
    def slice_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(), "right").astype(np.int64))

    lows = sorted(rows.select("id", slice_of("id").alias("slice")).groupBy("slice").agg(F.min("id")).collect())
    starts = spark.createDataFrame([(low, lows[i - 1][0]) for i, (_, low) in enumerate(lows)], "id long, slice long")
    ahead = rows.join(F.broadcast(starts), "id").select("id", "text", "slice", F.lit(True).alias("ahead"))  # a row for each task
    placed = rows.select("id", "text", slice_of("id").alias("slice"), F.lit(False).alias("ahead"))
    dealt = placed.unionByName(ahead).repartition(len(lows), "slice").sortWithinPartitions("slice", "ahead", "id", "text")
    return dealt.mapInArrow(_compare(settings), _OUT)
