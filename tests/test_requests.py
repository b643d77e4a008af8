import json
import random
import time
from collections import deque

import pytest
from pyspark.sql import functions as F

from pagewarden.plans import crawl as K
from pagewarden.sources import requests


def test_hosts_are_interleaved_and_each_keeps_its_pace():
    now, log = [0.0], []

    def client(url):
        log.append((now[0], url))
        if url.endswith("bad"):
            raise OSError("no")
        return {"status_code": 200}

    hosts = {"a": ["a1", "a bad", "a3"], "b": ["b1", "b2"], "c": []}
    rows = list(requests.asked(hosts, client, interval=1.0, retries=1, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s)))
    assert [r["url"] for r in rows if r["url"][0] == "a"] == hosts["a"] and [r["url"] for r in rows if r["url"][0] == "b"] == hosts["b"]
    assert [r["error"] for r in rows if r["url"] == "a bad"] == ["OSError: no"] and len(log) == 6
    for h in "ab":
        times = [t for t, u in log if u[0] == h]
        assert all(y - x >= 1.0 for x, y in zip(times, times[1:], strict=False))
    assert now[0] < 4.0  # b waits for no a


def test_twenty_hosts_side_by_side(spark, tmp_path):
    folder = str(tmp_path)

    def client(url):
        import uuid

        began = time.time()
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(json.dumps([began, url]))
        if url.endswith("/3"):
            raise OSError("no")
        return {"status_code": 200, "html": "x", "headers": {"a": "b"}}

    urls = spark.createDataFrame([(f"https://h{h}.test/{i}",) for h in range(20) for i in (5, 4, 3, 2, 1, 1, 0)] + [("nohost",)], "url string")
    before = spark.createDataFrame([("https://h0.test/0",)], "url string")
    began = time.time()
    rows = requests.paced(urls, client, interval=0.2, budget=4, retries=0, before=before).collect()
    took = time.time() - began
    asked = sorted(json.loads(p.read_text()) for p in tmp_path.iterdir())
    for h in range(20):
        own = [(t, u) for t, u in asked if f"//h{h}.test/" in u]
        assert [u[-1] for _, u in own] == (["1", "2", "3", "4"] if h == 0 else ["0", "1", "2", "3"])
        assert all(b[0] - a[0] >= 0.195 for a, b in zip(own, own[1:], strict=False))
    assert len(rows) == 80 and {r.error for r in rows} == {None, "OSError: no"} and {r.status_code for r in rows} == {200, None}
    assert took < 20 * 4 * 0.2 + 25  # hosts don't wait for each other
    assert requests.paced(urls.where("false"), client, interval=0.0).count() == 0


def test_data_source_has_a_partition_a_host(spark, tmp_path):
    (tmp_path / "paced_client.py").write_text("def client(url):\n    return {'status_code': len(url), 'headers': {'k': 'v'}, 'body': b'x'}\n")
    spark.sparkContext.addPyFile(str(tmp_path / "paced_client.py"))
    spark.dataSource.register(requests.PacedRequests)
    urls = ["https://a.test/1", "https://b.test/1", "https://a.test/22", "https://a.test/22", "https://a.test/333", "nohost"]
    df = spark.read.format("paced_requests").option("urls", json.dumps(urls)).option("client", "paced_client:client").option("interval", "0").option("budget", "2").option("asked", '["https://a.test/1"]').load()
    assert df.rdd.getNumPartitions() == 2
    got = {(r.url, r.status_code, r.headers["k"], bytes(r.body)) for r in df.collect()}
    assert got == {(u, len(u), "v", b"x") for u in ("https://b.test/1", "https://a.test/22", "https://a.test/333")}


def site(seed, n=16):
    rng = random.Random(seed)
    url = lambda i: f"https://s{seed}.test/" + (f"p{i}" if i else "")
    pages = {}
    for i in range(n):
        to = [rng.randrange(n) for _ in range(rng.randint(0, 5))] + ([i + 1] if i + 1 < n and i % 2 == 0 else [])
        rng.shuffle(to)
        pages[url(i)] = "".join(f'<p><a href="{url(t) if rng.random() < 0.5 else "/" + (f"p{t}" if t else "")}">x</a><a href="https://other.test/">o</a></p>' for t in to)
    return pages


def queue(pages, start, budget):
    """One URL after another, as a queue."""
    import re

    todo, seen, out = deque([start]), {start}, []
    while todo and len(out) < budget:
        url = todo.popleft()
        out.append(url)
        for href in re.findall(r'href="([^"]*)"', pages.get(url, "")):
            to = href if href.startswith("http") else start.rstrip("/") + href
            if to.startswith(start) and to not in seen:
                seen.add(to)
                todo.append(to)
    return out


def test_crawl_is_a_queue_with_the_same_budget(spark, tmp_path):
    sites = {f"t{s}": site(s) for s in (1, 2)}
    pages = {**sites["t1"], **sites["t2"]}
    starts = {t: min(p, key=len) for t, p in sites.items()}
    targets = spark.createDataFrame([(t, u.rstrip("/")) for t, u in starts.items()], "target_id string, base_url string")

    def client(url):
        if url.endswith("p7"):
            raise OSError("down")
        return {"status_code": 200, "html": pages[url]} if url in pages else {"status_code": 404, "html": ""}

    out = K.crawl(targets, client, f"file://{tmp_path}/c", budget=12, interval=0.0, retries=0)
    rows = sorted((r.target_id, r.turn, r.url) for r in out.collect())
    shown = {u: ("" if u.endswith("p7") else h) for u, h in pages.items()}
    for t, start in starts.items():
        own = [(n, u) for x, n, u in rows if x == t]
        assert [u for _, u in own] == queue(shown, start, 12) and [n for n, _ in own] == list(range(len(own)))
    # A crawl that is called again reads what was written and asks nothing.
    again = K.crawl(targets, lambda url: 1 / 0, f"file://{tmp_path}/c", budget=12, interval=0.0, retries=0)
    assert sorted((r.target_id, r.turn, r.url) for r in again.collect()) == rows
    few = K.crawl(targets, client, f"file://{tmp_path}/d", budget=12, total=5, interval=0.0, retries=0, max_rounds=3)
    assert few.count() == 5


def test_filter_lets_only_new_links_pass(spark):
    seen = spark.range(2000).select(F.lit("t").alias("target_id"), F.concat(F.lit("u"), "id").alias("url"))
    small = K.Bloom(1 << 12)
    small.add(seen.select(F.xxhash64("target_id", "url").alias("key")))
    found = spark.range(1500, 2600).select(F.lit("t").alias("target_id"), F.concat(F.lit("u"), "id").alias("url"))
    assert {r.url for r in K.unseen(found, seen, small).collect()} == {f"u{i}" for i in range(2000, 2600)}
    big = K.Bloom()
    big.add(seen.select(F.xxhash64("target_id", "url").alias("key")))
    maybe = big.marked(found.withColumn("key", F.xxhash64("target_id", "url")))
    assert maybe.where("maybe").count() == 500
    with pytest.raises(ValueError):
        requests.PacedReader({"urls": "[", "client": "a:b"})
