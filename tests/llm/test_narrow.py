"""Small tables between the steps of the Jaccard join don't keep the partitions of the shuffle that made them."""

import pytest
from pyspark.sql import functions as F

from emberlog.llm import common, jaccard_join


@pytest.fixture
def wide(spark):
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_small_components_take_one_task(wide):
    links = wide.createDataFrame([(i, i + 1) for i in range(0, 40) if i % 10 != 9], "a long, b long")
    found = jaccard_join.components(links)
    assert {r.node: r.root for r in found.collect()} == {i: i - i % 10 for i in range(40)}
    assert found.rdd.getNumPartitions() == 1


def test_partitions_grow_with_the_rows(wide, monkeypatch):
    rows = wide.range(1000).groupBy((7 * F.col("id")).alias("id")).count()
    least = wide.sparkContext.defaultParallelism
    assert common.narrow(rows).rdd.getNumPartitions() == least
    monkeypatch.setattr(common, "_NARROW_ROWS", 50)
    out = common.narrow(rows)
    assert out.rdd.getNumPartitions() == 20 and out.distinct().count() == 1000
    assert common.narrow(rows.filter("id < 0")).count() == 0
