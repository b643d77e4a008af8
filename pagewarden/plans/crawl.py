"""Crawls with requests between rounds: breadth first within each target, as far as its budget and that of the whole crawl reach.

A round asks for the frontier's first URLs, writes the answers once, parses them, and takes the links that weren't seen as the
next frontier. The order is that of a queue: by the page that named a URL first, then by its place there. What was seen grows by
one small table a round; a Bloom filter of fixed size, sent to the tasks, lets links that surely are new pass, and only
the others are joined with these tables. A crawl that died goes on from the rounds that were written.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewarden.functions import urls as U
from pagewarden.sources import dom, requests
from pagewarden.sources.state import _fs

BITS, HASHES = 1 << 23, 4
FOUND = "target_id string, url string, depth int, turn bigint"


class Bloom:
    """Bits of what was seen: 1 MB on the driver and in each task."""

    def __init__(self, bits: int = BITS):
        self.words = np.zeros(bits // 64, np.uint64)

    @staticmethod
    def places(keys: np.ndarray, bits: int) -> np.ndarray:
        """HASHES places of each 64-bit key."""
        keys = keys.view(np.uint64)
        step = (keys >> np.uint64(32)) | np.uint64(1)
        return (keys[:, None] + np.arange(HASHES, dtype=np.uint64)[None, :] * step[:, None]) % np.uint64(bits)

    def add(self, keyed: DataFrame) -> None:
        """keyed: (key: a 64-bit hash). Words of bits are put together by Spark; at most as many as the filter has reach the driver."""
        bits = len(self.words) * 64

        def run(batches):
            own = np.zeros(bits // 64, np.uint64)
            for batch in batches:
                at = Bloom.places(batch.column(0).to_numpy(), bits).ravel()
                np.bitwise_or.at(own, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(own[some].view(np.int64))], names=["word", "held"])

        for r in keyed.select("key").mapInArrow(run, "word int, held bigint").groupBy("word").agg(F.bit_or("held").alias("held")).collect():
            self.words[r.word] |= np.int64(r.held).view(np.uint64)

    def marked(self, keyed: DataFrame) -> DataFrame:
        """keyed with maybe: false for what surely wasn't added."""
        sent, bits = keyed.sparkSession.sparkContext.broadcast(self.words), len(self.words) * 64
        at = keyed.columns.index("key")

        def run(batches):
            words = sent.value
            for batch in batches:
                places = Bloom.places(batch.column(at).to_numpy(), bits)
                hit = ((words[places >> np.uint64(6)] >> (places & np.uint64(63))) & np.uint64(1)).all(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit.astype(bool))], names=[*batch.schema.names, "maybe"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema)
        return keyed.mapInArrow(run, f"{kinds}, maybe boolean")


def unseen(found: DataFrame, seen: DataFrame, filter_: Bloom) -> DataFrame:
    """Rows (target_id, url, ...) that aren't in seen (target_id, url): those that the filter doesn't know, and those that it might but the tables don't."""
    keyed = filter_.marked(found.withColumn("key", F.xxhash64("target_id", "url")))
    new, known = keyed.where("not maybe").drop("key", "maybe"), keyed.where("maybe").drop("key", "maybe")
    return new.unionByName(known.join(seen.select("target_id", "url"), ["target_id", "url"], "left_anti"))


def dealt_budget(frontier: DataFrame, left: DataFrame, total: int) -> DataFrame:
    """(target_id, url, depth, turn) of the frontier that is asked: of each target what its budget leaves (target_id, left), and of all targets together
    the total, dealt out in the order of targets by a running sum over what each of them wants."""
    wanted = frontier.join(F.broadcast(left), "target_id").withColumn("n", F.row_number().over(Window.partitionBy("target_id").orderBy("turn"))).where("n <= left").drop("left")
    sums = wanted.groupBy("target_id").agg(F.count(F.lit(1)).alias("wants"))  # a row a target
    running = sums.withColumn("before", F.sum("wants").over(Window.orderBy("target_id")) - F.col("wants"))
    return wanted.join(running.select("target_id", (F.lit(total) - F.col("before")).alias("share")), "target_id").where("n <= share").select("target_id", "url", "depth", "turn")


class Rounds:
    """The tables of a crawl, a folder a round: frontier (what was found), asked, answers. A round counts when its answers are whole."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, what: str, k: int) -> str:
        return f"{self.root}/{what}/round={k}"

    def whole(self, what: str, k: int) -> bool:
        fs, p = _fs(self.spark, f"{self.path(what, k)}/_SUCCESS")
        return fs.exists(p)

    def written(self, what: str, k: int, df: DataFrame) -> DataFrame:
        """The table of a round, written unless it is there."""
        schema = df.schema
        if not self.whole(what, k):
            df.write.mode("overwrite").parquet(self.path(what, k))
        return self.spark.read.schema(schema).parquet(self.path(what, k))

    def all(self, what: str, rounds: int, schema) -> DataFrame:
        paths = [self.path(what, k) for k in range(rounds)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


def links(answers: DataFrame, asked: DataFrame, policy: U.Policy) -> DataFrame:
    """(target_id, url, depth, parent, seq): links of the answers that stay within their site, in one form each, with the turn of the page that names them and their place there."""

    @F.pandas_udf("string")
    def normal(raw: pd.Series, base: pd.Series) -> pd.Series:
        return pd.Series([U.normalize_one(r, b, policy)[0] if isinstance(r, str) else None for r, b in zip(raw, base, strict=True)], dtype=object)

    pages = answers.where("html is not null").join(asked.withColumnRenamed("turn", "parent"), "url").select("target_id", "url", "html", "depth", "parent")
    parsed = dom.parsed(pages, ["target_id", "url", "depth", "parent"])
    anchors = dom.having(lambda e: (e["tag"] == "a") & dom.attribute(e, "href").isNotNull() & (U.resource_kind(e["tag"], dom.attribute(e, "href"), dom.attribute(e, "download").isNotNull()) == "link"))
    rows = parsed.select("target_id", F.col("url").alias("page"), (F.col("depth") + 1).alias("depth"), "parent", F.explode(F.transform(anchors, lambda e: F.struct(e["seq"].alias("seq"), dom.attribute(e, "href").alias("href")))).alias("a"))
    rows = rows.select("target_id", "page", "depth", "parent", "a.seq", normal("a.href", "page").alias("url"))
    return rows.where((U.host(F.col("url")) == U.host(F.col("page"))) & (U.scheme(F.col("url")) == "https")).select("target_id", "url", "depth", "parent", "seq")


def crawl(targets: DataFrame, client: Callable[[str], Mapping], root: str, *, budget: int = 10, total: int | None = None, interval: float = 1.0, retries: int = 1, policy: U.Policy = U.Policy(), max_rounds: int | None = None) -> DataFrame:
    """targets: (target_id, base_url), few and configured by hand. The answers (target_id, depth, turn and a transport's columns) of a crawl whose tables are kept under root.

    turn is a URL's place in its target's queue, from 0. budget: requests of a target; total: of all of them. The result equals a queue's that asks one URL after another.
    """
    spark = targets.sparkSession
    held = Rounds(spark, root)
    start = targets.select("target_id", U.normalize_any(F.concat(F.regexp_replace("base_url", "/+$", ""), F.lit("/")), F.lit(None).cast("string"), policy)["url"].alias("url"), F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("turn"))
    frontier, k, filter_ = start, 0, Bloom()
    left_total = total if total is not None else budget * targets.count()
    answer_schema = f"target_id string, depth int, turn bigint, {requests.RESPONSE}"
    while max_rounds is None or k < max_rounds:
        frontier = held.written("frontier", k, frontier)
        filter_.add(frontier.select(F.xxhash64("target_id", "url").alias("key")))
        used = held.all("answers", k, answer_schema).groupBy("target_id").agg(F.count(F.lit(1)).alias("used"))
        left = targets.select("target_id").join(used, "target_id", "left").select("target_id", (F.lit(budget) - F.coalesce("used", F.lit(0))).alias("left"))
        asked = held.written("asked", k, dealt_budget(frontier, left, left_total))
        n = asked.count()
        if not n:
            break
        got = requests.paced(asked, client, interval=interval, budget=n, retries=retries, order=("turn",))
        answers = held.written("answers", k, asked.join(got, "url").select("target_id", "depth", "turn", *[c for c, _ in requests.FIELDS]))
        left_total -= n
        k += 1
        found = links(answers.drop("target_id", "depth", "turn"), asked, policy)
        first = found.groupBy("target_id", "url").agg(F.min("depth").alias("depth"), F.min(F.struct("parent", "seq")).alias("at"))
        new = unseen(first, held.all("frontier", k, FOUND), filter_)
        ahead = held.all("frontier", k, FOUND).groupBy("target_id").agg((F.max("turn") + 1).alias("ahead"))
        # Only what the budget can still reach gets a turn: a limit that is cut before the shuffle.
        queued = new.withColumn("n", F.row_number().over(Window.partitionBy("target_id").orderBy("at", "url"))).where(F.col("n") <= budget)
        frontier = queued.join(F.broadcast(ahead), "target_id").select("target_id", "url", "depth", (F.col("ahead") + F.col("n") - 1).alias("turn"))
    return held.all("answers", k, answer_schema)
