"""Collection of yearly API responses as a Python data source.

One partition a year; the transport is a function named ``module:function`` that takes
(endpoint, year) and gives the response's JSON text, so the source works offline with any
stand-in and needs no network itself.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillspan.sources.sinks import collect_once, with_retry


class YearPartition(InputPartition):
    def __init__(self, year: int):
        self.year = year


class YearlyApi(DataSource):
    """``spark.read.format("yearly_api")`` with endpoint, first, last and fetch."""

    @classmethod
    def name(cls) -> str:
        return "yearly_api"

    def schema(self) -> str:
        return "year int, name string, headers array<string>, values array<string>"

    def reader(self, schema) -> YearlyReader:
        return YearlyReader(self.options)


class YearlyReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self) -> Sequence[YearPartition]:
        return [YearPartition(y) for y in range(int(self.options["first"]), int(self.options["last"]) + 1)]

    def read(self, partition: YearPartition) -> Iterator[tuple]:
        module, _, function = self.options["fetch"].partition(":")
        fetch: Callable[[str, int], str] = getattr(importlib.import_module(module), function)
        wait = float(self.options.get("wait", "2"))
        body = json.loads(with_retry(lambda: fetch(self.options["endpoint"], partition.year), first_wait=wait))
        found = body.get("resultSets", body.get("resultSet"))
        for part in found if isinstance(found, list) else [found] if found else []:
            for row in part.get("rowSet", []):
                yield partition.year, part.get("name"), part.get("headers"), [None if v is None else str(v) for v in row]


def collect_endpoint(spark: SparkSession, endpoint: str, first: int, last: int, fetch: str, path: str, force: bool = False, wait: float = 2.0) -> str:
    """Write an endpoint's years to ``path`` unless they are there: written, kept or failed."""
    spark.dataSource.register(YearlyApi)
    load = lambda: spark.read.format("yearly_api").options(endpoint=endpoint, first=first, last=last, fetch=fetch, wait=wait).load()
    return collect_once(path, load, force)


@dataclass(frozen=True)
class Step:
    """One endpoint of a collection and its years, which may reach beyond those asked for."""

    endpoint: str
    beyond: int = 0


# The endpoints of a whole collection, in order; the crosswalk of identities reaches two
# years beyond the last draft.
COLLECTION = (
    Step("drafthistory"), Step("draftcombinestats"), Step("draftcombineplayeranthro"), Step("draftcombinedrillresults"), Step("draftcombinespotshooting"), Step("draftcombinenonstationaryshooting"),
    Step("leaguedashplayerstats"), Step("player_box"), Step("identity_crosswalk", beyond=2),
)


def collect_all(spark: SparkSession, first: int, last: int, fetch: str, folder: str, steps: Sequence[Step] = COLLECTION, force: bool = False, wait: float = 2.0, keep_going: bool = False) -> DataFrame:
    """(endpoint, first, last, path, status) of each step; what is there already is kept.

    A failure ends the collection unless ``keep_going``; the rest is then ``skipped``, and a later
    call goes on from there.
    """
    rows, stopped = [], False
    for step in steps:
        path = f"{folder}/{step.endpoint}.parquet"
        status = "skipped" if stopped else collect_endpoint(spark, step.endpoint, first, last + step.beyond, fetch, path, force, wait)
        stopped = stopped or (status == "failed" and not keep_going)
        rows.append((step.endpoint, first, last + step.beyond, path, status))
    return spark.createDataFrame(rows, "endpoint string, first int, last int, path string, status string")
