"""Indicator feeds: text files and inline rows in one shape."""

from __future__ import annotations

import importlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators.intel import group_of


def parse(lines: DataFrame, feed: str, kind: str) -> DataFrame:
    """lines: (line, at).  Fields part by bars, or by commas where a line has no bar; later lines win.

    Blank lines, comments and indicators with a space are passed over.  Confidence that is no number is 75.
    """
    line = F.trim("line")
    rows = lines.filter((line != "") & ~line.startswith("#")).select("at", F.when(line.contains("|"), F.split(line, r"\|")).otherwise(F.split(line, ",")).alias("f"))
    field = lambda i: F.nullif(F.trim(F.get("f", F.lit(i))), F.lit(""))
    value = F.lower(F.trim(F.get("f", F.lit(0))))
    entry = F.struct(F.coalesce(field(1), F.lit("suspicious")).alias("category"), F.coalesce(field(2).try_cast("int"), F.lit(75)).alias("confidence"), F.coalesce(field(6), F.lit("")).alias("description"))
    rows = rows.withColumn("indicator", value).filter((F.col("indicator") != "") & ~F.col("indicator").contains(" "))
    last = rows.groupBy("indicator").agg(F.max_by(entry, "at").alias("e"))
    return last.select(F.lit(feed).alias("feed"), F.lit(kind).alias("kind"), "indicator", "e.confidence", "e.category", "e.description", _group().alias("group_id"))


def _group() -> Column:
    return group_of(F.concat_ws(" ", "e.category", "e.description"))


def read(spark: SparkSession, path: str, feed: str, kind: str) -> DataFrame:
    """A feed file (or several); the place of a line decides which duplicate wins."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()).alias("at"))
    return parse(lines, feed, kind)


_ENTRY = "feed string, kind string, indicator string, confidence int, category string, description string, error string"


def lookup(indicators: DataFrame, client: str, feed: str, batch: int = 100) -> tuple[DataFrame, DataFrame]:
    """(entries, failures) of a provider that answers for single indicators, in the shape of the other feeds; failures: (feed, kind, indicator, error).

    indicators: (kind, value).  ``client`` names a function, "module:function", that gets the feed's name and returns an object whose ``lookup(kind, values)`` takes ``batch`` values at most and
    returns a mapping of those it knows to dicts with category, confidence and description.  Each distinct indicator is asked for once, by the task that holds it; a request that
    fails is a failure for its indicators and the others go on.  No network client is shipped.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        module, _, function = client.partition(":")
        provider = getattr(importlib.import_module(module), function)(feed)
        for rows in batches:
            out = []
            for kind, values in rows.groupby("kind")["value"]:
                every = list(values)
                for part in (every[i : i + batch] for i in range(0, len(every), batch)):
                    try:
                        found = provider.lookup(kind, part)
                    except Exception as e:  # a failed request is a row for each of its indicators
                        out += [(feed, kind, v, None, None, None, f"{type(e).__name__}: {e}"[:300]) for v in part]
                        continue
                    out += [(feed, kind, v, int(e.get("confidence", 75)), e.get("category") or "suspicious", e.get("description") or "", None) for v, e in found.items() if v in set(part)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _ENTRY.split(", ")]).astype({"confidence": "Int32"})

    asked = indicators.select("kind", F.lower("value").alias("value")).distinct()
    rows = asked.mapInPandas(ask, _ENTRY)
    entries = rows.filter("error IS NULL").select("feed", "kind", "indicator", "confidence", "category", "description", group_of(F.concat_ws(" ", "category", "description")).alias("group_id"))
    return entries, rows.filter("error IS NOT NULL").select("feed", "kind", "indicator", "error")
