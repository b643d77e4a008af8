"""Requests by host: many hosts side by side, each in turn with a pause between its requests.

A host's URLs are asked by one task, in their order, up to a budget a host, so that its pace holds whatever the
cluster's size; a task that has several hosts asks whichever may be asked next. An answer is a row, and so is a failure.
What an earlier call has asked (its rows, kept by the caller) isn't asked again, so that a run that died goes on where its
last written rows end; rows of a task that died are asked again.

``paced`` takes URLs of any number as a table. ``PacedRequests`` is the same as a data source, a partition a host, for
lists that are given by hand: spark.dataSource.register(PacedRequests), then spark.read.format("paced_requests").
"""

from __future__ import annotations

import heapq
import importlib
import json
import time
from collections.abc import Callable, Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pagewarden.functions import urls as U
from pagewarden.sources.transport import RESPONSE

FIELDS = [c.split(" ", 1) for c in RESPONSE.split(", ")]
_ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string())}
ARROW = pa.schema([(n, _ARROW[k]) for n, k in FIELDS])


def asked(hosts: Mapping[str, Iterable[str]], client: Callable[[str], Mapping], *, interval: float, retries: int = 1, clock=time.monotonic, sleep=time.sleep) -> Iterator[dict]:
    """Answers to each host's URLs in their order, the hosts interleaved by when each may be asked again. A retry keeps the pause, too."""
    turns = [(0.0, i, host, iter(urls)) for i, (host, urls) in enumerate(hosts.items())]
    heapq.heapify(turns)
    names = [n for n, _ in FIELDS]
    while turns:
        ready, i, host, rest = heapq.heappop(turns)
        url = next(rest, None)
        if url is None:
            continue
        got: Mapping = {}
        for _ in range(retries + 1):
            wait = ready - clock()
            if wait > 0:
                sleep(wait)
            began = clock()
            ready = began + interval
            try:
                got = client(url)
                break
            except Exception as e:  # a failed request is a row
                got = {"error": f"{type(e).__name__}: {e}"}
        yield {**dict.fromkeys(names), "elapsed_seconds": clock() - began, **got, "url": url}
        heapq.heappush(turns, (ready, i, host, rest))


def _batch(rows: list[dict]) -> pa.RecordBatch:
    held = [{**r, "headers": list(r["headers"].items()) if r["headers"] is not None else None} for r in rows]
    return pa.RecordBatch.from_pylist(held, schema=ARROW)


def paced(urls: DataFrame, client: Callable[[str], Mapping], *, interval: float = 1.0, budget: int = 10, retries: int = 1, order: Iterable[str] = ("url",), before: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Live answers to the distinct URLs (url, and the columns of order) that are no URL of before, the first of each host up to the budget.

    A host of any number of URLs sends few of them: row numbers up to a limit are cut in each task before the shuffle. URLs without a host aren't asked.
    """
    order = list(order)
    one = urls.groupBy("url").agg(F.min(F.struct(*order)).alias("o")) if order != ["url"] else urls.select("url").distinct()
    if before is not None:
        one = one.join(before.select("url").distinct(), "url", "left_anti")
    by = [F.col("url")] if order == ["url"] else [F.col("o"), F.col("url")]
    hosts = one.withColumn("host", U.host(F.col("url"))).where("host <> ''")
    first = hosts.withColumn("turn", F.row_number().over(Window.partitionBy("host").orderBy(*by))).where(F.col("turn") <= budget)
    n = tasks or urls.sparkSession.sparkContext.defaultParallelism
    dealt = first.select("host", "turn", "url").repartition(n, "host").sortWithinPartitions("host", "turn")

    def run(batches):
        own: dict[str, list[str]] = {}  # the budget of each of the task's hosts at most
        for batch in batches:
            for host, url in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own.setdefault(host, []).append(url)
        for row in asked(own, client, interval=interval, retries=retries):
            yield _batch([row])

    return dealt.mapInArrow(run, RESPONSE)


class Host(InputPartition):
    def __init__(self, host: str, urls: list[str]):
        self.value = host
        self.host, self.urls = host, urls


class PacedReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        from urllib.parse import urlsplit

        self.interval, self.retries, budget = float(options.get("interval", "1.0")), int(options.get("retries", "1")), int(options.get("budget", "10"))
        self.client = options["client"]
        self.hosts: dict[str, list[str]] = {}
        done = set(json.loads(options.get("asked", "[]")))
        for url in dict.fromkeys(json.loads(options["urls"])):
            host = (urlsplit(url).hostname or "").lower()
            held = self.hosts.setdefault(host, [])
            if host and url not in done and len(held) < budget:
                held.append(url)

    def partitions(self) -> list[Host]:
        return [Host(h, u) for h, u in self.hosts.items() if u]

    def read(self, partition: Host) -> Iterator[pa.RecordBatch]:
        module, _, name = self.client.partition(":")
        client = getattr(importlib.import_module(module), name)
        for row in asked({partition.host: partition.urls}, client, interval=self.interval, retries=self.retries):
            yield _batch([row])


class PacedRequests(DataSource):
    """Options: urls (JSON array), client (module:function of a URL), asked (JSON array of URLs that were), interval, budget, retries."""

    @classmethod
    def name(cls) -> str:
        return "paced_requests"

    def schema(self) -> str:
        return RESPONSE

    def reader(self, schema) -> PacedReader:
        return PacedReader(self.options)
