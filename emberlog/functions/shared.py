"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session without that setting gets one of its own."""
    context = spark.sparkContext
    there = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if there:
        return there.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="emberlog-"))
    return context.getCheckpointDir()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: its lineage is cut, columns are still pruned and filters pushed down."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(table: DataFrame) -> None:
    """Deletes the files of a table that ``stored`` made."""
    spark = table.sparkSession
    first = next(iter(table.inputFiles()), None)
    if first is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(first).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``place``: 0, 1, ... as a prefix sum in two passes, in the order of columns that tell all rows apart, or as the rows lie without any.

    Rows are dealt by ranges of the order and numbered within their range as they are written; then the sizes of all ranges before are added.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    table = stored(dealt.withColumn("__at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("__at", 33)
    sizes = table.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # a row for each range
    ahead = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__part", ahead.alias("__ahead"))
    return table.withColumn("__part", part).join(F.broadcast(sizes), "__part").withColumn("place", F.col("__ahead") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at", "__part", "__ahead")
