"""Answers to requests as a DataFrame: recorded ones, live ones through an injected client, and fallback between transports."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from pagewarden.functions import checks as C

RESPONSE = "url string, status_code int, html string, body binary, headers map<string,string>, elapsed_seconds double, final_url string, redirect_count int, error string, transport string"
TRANSPORTS = {"auto": ("proxy_http", "http", "browser"), "http": ("http",), "proxy_http": ("proxy_http",), "browser": ("browser",)}


def order_of(name: str) -> tuple[str, ...]:
    try:
        return TRANSPORTS[name]
    except KeyError:
        raise ValueError(f"unknown transport: {name}") from None


def recorded(urls: DataFrame, responses: DataFrame) -> DataFrame:
    """Each URL with its recorded response: of the exact URL, else of it without its last slashes, else an empty 200."""
    names = [c for c in responses.columns if c != "url"]
    order = F.struct(*[c for c in names if not isinstance(responses.schema[c].dataType, MapType)])
    one = responses.groupBy("url").agg(F.min_by(F.struct(*names), order).alias("r")).select("url", "r.*")  # of several the least
    held = F.struct(*names)
    exact = one.select("url", held.alias("exact"))
    loose = one.select(F.regexp_replace("url", "/+$", "").alias("bare"), "url", held.alias("loose")).groupBy("bare").agg(F.min_by("loose", "url").alias("loose"))
    rows = urls.select("url").distinct().join(exact, "url", "left").withColumn("bare", F.regexp_replace("url", "/+$", "")).join(loose, "bare", "left").withColumn("r", F.coalesce("exact", "loose"))
    named = [F.col(f"r.{c}").alias(c) for c in one.columns if c not in ("url", "status_code")]
    return rows.select("url", F.coalesce("r.status_code", F.lit(200)).alias("status_code"), *named)


def fallback(attempts: DataFrame, order: Iterable[str]) -> DataFrame:
    """Of attempts (url, transport, status_code, html, error, ...) the one that counts for each URL.

    Transports are tried in order while the connection fails; an answer ends it, and so does a refusal.
    """
    names = list(order)
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("transport"))
    tried = attempts.where(F.col("transport").isin(*names)).withColumn("place", place)
    answered = F.col("error").isNull() | C.transport_blocked(F.col("status_code"), F.col("html"))
    w = Window.partitionBy("url").orderBy(answered.desc(), F.when(answered, F.col("place")).otherwise(-F.col("place")))
    first = F.min("place").over(Window.partitionBy("url"))
    return tried.withColumn("fallback_used", F.col("place") > first).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "place")


def fetched(urls: DataFrame, client: Callable[[str], Mapping], *, interval: float = 1.0, budget: int = 10, retries: int = 1) -> DataFrame:
    """Live answers: one task asks for each URL in turn, with a pause between requests, up to the budget of distinct URLs.

    The order of URLs is theirs; what goes beyond the budget is left out, and failures are rows with an error.
    """
    chosen = urls.select("url").distinct().orderBy("url").limit(budget).coalesce(1)

    def run(batches):
        import pandas as pd

        names = [c.split()[0] for c in RESPONSE.split(", ")]
        last = 0.0
        for batch in batches:
            rows = []
            for url in batch["url"]:
                got: Mapping = {}
                for attempt in range(retries + 1):
                    time.sleep(max(0.0, last + interval - time.monotonic()))
                    last = time.monotonic()
                    try:
                        got = client(url)
                        break
                    except Exception as e:  # a failed request is a row
                        got = {"error": f"{type(e).__name__}: {e}"}
                rows.append({**dict.fromkeys(names), **got, "url": url})
            yield pd.DataFrame(rows, columns=names)

    return chosen.mapInPandas(run, RESPONSE)


RESOURCE = "url string, method string, status_code int, content_type string, content_length bigint, body binary, final_url string, hops int, error string"


def resource_answers(refs: DataFrame, client: Callable[[str, str], Mapping], *, interval: float = 1.0, budget: int = 10, retries: int = 1) -> DataFrame:
    """Live answers to checks of resources (normalized_url, kind): what rules.checked_resources takes.

    Each safe URL is asked for once, whatever refers to it, by HEAD; by GET too if that was refused (405, none, 403 of an
    attachment) or an attachment's may have bytes to look at. One task asks in turn, with a pause between requests; all requests
    share the budget, and URLs beyond it have no row. Failures are rows with an error. client(method, url) gives a row's fields.
    """
    from pagewarden.functions.urls import safe_destination

    known = refs.where(safe_destination(F.col("normalized_url"))).groupBy(F.col("normalized_url").alias("url")).agg(F.max(F.col("kind") == "attachment").alias("attached"))
    chosen = known.orderBy("url").limit(budget).coalesce(1)

    def run(batches):
        import pandas as pd

        names = [c.split()[0] for c in RESOURCE.split(", ")]
        left, last = budget, 0.0

        def ask(method: str, url: str) -> dict:
            nonlocal left, last
            left -= 1
            got: Mapping = {}
            for _ in range(retries + 1):
                time.sleep(max(0.0, last + interval - time.monotonic()))
                last = time.monotonic()
                try:
                    got = client(method, url)
                    break
                except Exception as e:  # a failed request is a row
                    got = {"status_code": 0, "error": f"{type(e).__name__}: {e}"}
            return {**dict.fromkeys(names), **got, "url": url, "method": method}

        for batch in batches:
            rows = []
            for url, attached in zip(batch["url"], batch["attached"], strict=True):
                if left <= 0:
                    break
                head = ask("HEAD", url)
                rows.append(head)
                status = head["status_code"]
                if left > 0 and (status in (405, 0, None) or attached and status in (403, 200)):
                    rows.append(ask("GET", url))
            yield pd.DataFrame(rows, columns=names)

    return chosen.mapInPandas(run, RESOURCE)
