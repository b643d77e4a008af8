"""Queries over pages that share their URLs, some of them with equal texts."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from pagewarden.functions import terms as T
from pagewarden.operators import rules as R
from pagewarden.plans import queries as own

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def shared(tmp_path_factory):
    c, path = duckdb.connect(), tmp_path_factory.mktemp("shared")
    c.execute(f"CREATE TABLE p AS SELECT page_id, CASE WHEN page_id = 1 THEN NULL ELSE max(url) OVER (PARTITION BY page_id // 8) END AS url, html FROM '{SF}/pages.parquet'")
    c.execute(f"COPY (SELECT * FROM p UNION ALL SELECT page_id + 1001, url, html FROM p UNION ALL SELECT page_id + 2002, url, html FROM p) TO '{path}/pages.parquet'")
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/pages.parquet'")
    return c, str(path)


@pytest.mark.parametrize("name", ["a11y_cache_reuse", "anchor_targets", "mixed_content"])
def test_pages_that_share_a_url_are_told_apart(spark, shared, name):
    duck, path = shared
    r = duck.execute(own.SQL[name])
    columns = [d[0] for d in r.description]
    assert Counter(tuple(row[c] for c in columns) for row in own.QUERIES[name](spark, path).collect()) == Counter(r.fetchall())


def test_cached_checks_of_a_url_give_one_row(spark):
    hashes = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "x", 3), ("b", None, 4), ("c", "x", 5), ("d", "x", 6)], "url string, content_hash string, n int")
    cache = [("a", "x", "p", "완료"), ("a", "x", "p", "완료"), ("a", "x", "q", "완료"), ("a", "z", "p", "완료"), ("b", None, "p", "완료"), ("c", "x", "p", T.UNCHECKABLE), ("d", "x", "p", None)]
    cache = spark.createDataFrame(cache, "url string, content_hash string, policy_version string, last_result string")
    assert sorted((r.n, r.reuse) for r in R.reused(hashes, cache, "p").collect()) == [(1, True), (2, False), (3, True), (4, False), (5, False), (6, False)]
    assert R.reused(hashes, cache, "p", force=True).where(F.col("reuse")).count() == 0
