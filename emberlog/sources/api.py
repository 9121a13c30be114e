"""A Python data source for audit-log APIs: one partition for each account and region.

``spark.read.format("audit_api").option("client", "module:function")``; the function gets
(account, region) and returns a client whose ``pages(start, end)`` yields lists of event records with ``EventName`` and
``CloudTrailEvent`` (JSON).  For findings the client has ``detectors()``, ``finding_ids(detector)`` and ``findings(detector, ids)``, which
gets ``batch`` ids at a time and returns dicts.  A target that fails becomes a row with its error; the scan goes on.  No network client is shipped.

Options: client, targets (JSON list of [account, region]), kind (events or findings), start, end, names (JSON list of event names; none keeps all), batch.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from emberlog.sources.events import parse_embedded, parse_findings

SCHEMA = "event_json string, event_name string, account string, region string, error string"


@dataclass
class Target(InputPartition):
    account: str
    region: str


class ApiReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.client, self.start, self.end = options["client"], options.get("start", ""), options.get("end", "")
        self.targets = [Target(str(a), str(r)) for a, r in json.loads(options["targets"])]
        self.names = frozenset(json.loads(options.get("names", "[]")))
        self.kind, self.batch = options.get("kind", "events"), int(options.get("batch", "50"))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Accounts and regions choose partitions; Spark applies everything else."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if name in ("account", "region") and values is not None:
                self.targets = [t for t in self.targets if getattr(t, name) in values]
            yield f

    def partitions(self) -> list[InputPartition]:
        return list(self.targets)

    def read(self, partition: Target) -> Iterator[tuple]:
        try:
            module, _, function = self.client.partition(":")
            client = getattr(importlib.import_module(module), function)(partition.account, partition.region)
            for text, name in self.findings(client) if self.kind == "findings" else self.events(client):
                yield text, name, partition.account, partition.region, None
        except Exception as e:  # a failed target is a row, so that it can't end the scan of the others
            yield None, None, partition.account, partition.region, f"{type(e).__name__}: {e}"[:300]


    def events(self, client) -> Iterator[tuple]:
        for page in client.pages(self.start, self.end):
            for record in page:
                if not self.names or record.get("EventName") in self.names:
                    yield record.get("CloudTrailEvent"), record.get("EventName")

    def findings(self, client) -> Iterator[tuple]:
        for detector in client.detectors():
            ids: list = []
            for one in client.finding_ids(detector):
                ids.append(one)
                if len(ids) == self.batch:
                    yield from ((json.dumps(f, default=str), None) for f in client.findings(detector, ids))
                    ids = []
            if ids:
                yield from ((json.dumps(f, default=str), None) for f in client.findings(detector, ids))


class ApiSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "audit_api"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ApiReader:
        return ApiReader(self.options)


def _rows(spark: SparkSession, client: str, targets: list[tuple[str, str]], **options: str) -> tuple[DataFrame, DataFrame]:
    spark.dataSource.register(ApiSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format("audit_api").options(client=client, targets=json.dumps(targets), **options).load()
    return rows.filter("error IS NULL"), rows.filter("error IS NOT NULL").select("account", "region", "error")


def read(spark: SparkSession, client: str, targets: list[tuple[str, str]], start: str = "", end: str = "", names: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(canonical events, failures) of the targets; failures: (account, region, error)."""
    rows, failed = _rows(spark, client, targets, start=start, end=end, names=json.dumps(names))
    return parse_embedded(rows), failed


def read_findings(spark: SparkSession, client: str, targets: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(findings, failures) of the targets' detectors; a target that fails has no findings."""
    rows, failed = _rows(spark, client, targets, kind="findings")
    return parse_findings(rows.select(F.col("event_json").alias("j"), "account", "region")), failed
