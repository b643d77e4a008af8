import random
import time

import pytest

from pagewarden.operators import search as X


def test_search_by_index_is_the_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 16)
    rng = random.Random(3)
    rows = [(i * 3, "".join(rng.choice("abAB가 ") for _ in range(rng.randint(0, 12)))) for i in range(300)] + [(5000, None), (None, "abab"), (7, "xyz" * 9), (7, "other")]
    df = spark.createDataFrame(rows, "id bigint, t string").selectExpr("*", "'clash' gram", "'clash' block", "'clash' place")
    index = X.written(X.index(df, "id", "t"), f"file://{tmp_path}/x")
    for needle in ("aba", "ABAB", "b a", "가b가", "xyzx", "zzz", "ab", ""):
        got = sorted((r.id, r.t) for r in X.search(df, index, needle, "id", "t").where("id is not null").collect())
        assert got == sorted((i, t) for i, t in rows if i is not None and t is not None and needle.lower() in t.lower()), needle
    assert X.index(df.where("false"), "id", "t").count() == 0 and max(len(r.places) for r in index.collect()) <= 16
    with pytest.raises(ValueError):
        X.candidates(index, "ab")


def test_only_rows_of_the_needle_are_read(spark, tmp_path):
    df = spark.range(5000).selectExpr("id", "concat('https://s.test/', hex(hash(id))) t")
    index = X.written(X.index(df, "id", "t"), f"file://{tmp_path}/y")
    found = X.candidates(index, "ABCD")
    found.write.format("noop").mode("overwrite").save()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram, [abc,bcd])" in plan


def test_long_texts_take_time_in_proportion(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh가😀\n ") for _ in range(320_000))

    def took(texts):
        df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string").coalesce(1)
        at = time.monotonic()
        found = {r.gram for r in X.index(df, "id", "t").select("gram").collect()}
        return time.monotonic() - at, found

    took(["warm up"])
    short, _ = took([text[i : i + 20_000] for i in range(0, len(text), 20_000)])
    whole, found = took([text])
    assert found == {text[i : i + 3] for i in range(len(text) - 2)}  # of whole characters, line ends among them
    assert whole < 5 * short + 2


def test_an_index_is_made_once_a_search(spark):
    df = spark.range(50).selectExpr("id", "concat('License ', id) t")
    plan = X.candidates(X.index(df, "id", "t"), "License")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1
