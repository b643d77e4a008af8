import random
import re

import pytest
from pyspark.sql import functions as F

from pagewarden.llm import decontaminate as D

from .texts import HARD, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    out = {}
    for d, text in docs:
        w, hit, met = words(text), set(), set()
        for i, t in items:
            own = words(t)
            n = min(window, len(own))
            for q in range(len(own) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == own[q : q + n]:
                        hit |= set(range(p, p + n))
                        met.add(str(i))
        out[d] = (len(w), len(hit), sorted(met))
    return out


def table(spark):
    rng = random.Random(3)
    vocabulary = ["the", "of", "Größe", "a1", "x", "y"]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    items = [(1, " ".join(passage)), (2, "one two three"), (3, ""), (4, None), (5, "x " * 14), (6, "Ten, ten; ten. ten! TEN ten ten ten ten"), (7, "solo"), (1, " ".join(passage)), (10, " ".join(passage[5:22]))]
    docs = list(enumerate(HARD))
    for k in range(60):
        body = [rng.choice(vocabulary + ["one", "two", "three", "ten", "solo"]) for _ in range(rng.randint(0, 50))]
        at, n = rng.randint(0, len(body)), rng.randint(1, 30)
        a = rng.randint(0, 20)
        docs.append((100 + k, " ".join(body[:at] + passage[a : a + n] + body[at:])))
    docs += [(300, "ONE, two THREE"), (301, " ".join(["x"] * 30)), (302, "ten " * 9), (303, " ".join(passage))]
    return docs, items


@pytest.mark.parametrize("limit", [D.BROADCAST_BYTES, 0])
def test_against_brute_force_both_ways(spark, limit):
    docs, items = table(spark)
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("items", F.lit(1)).withColumn("key", F.lit(1))
    i = spark.createDataFrame(items, "item_id bigint, text string").withColumn("words", F.lit(1))
    got = D.decontaminate(d, i, broadcast_bytes=limit).collect()
    want = brute(docs, items)
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) == want[r.doc_id], docs[0]


@pytest.mark.parametrize("limit", [D.BROADCAST_BYTES, 0])
def test_clean_rows_stay_with_their_columns(spark, limit):
    docs, items = table(spark)
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("items", F.lit(1))
    i = spark.createDataFrame(items, "item_id bigint, text string")
    kept = D.clean(d, i, broadcast_bytes=limit)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, v in brute(docs, items).items() if not v[1])


@pytest.mark.parametrize("limit", [D.BROADCAST_BYTES, 0])
def test_nothing_to_look_for_repeated_rows_and_no_documents(spark, limit):
    docs = documents(spark)
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert {r.n_words for r in D.decontaminate(docs, none, broadcast_bytes=limit).where("size(items) > 0").collect()} == set()
    one = spark.createDataFrame([(9, "hello world")], "item_id bigint, text string")
    twice = D.decontaminate(docs.union(docs), one, broadcast_bytes=limit).where("size(items) > 0").collect()
    assert [r.doc_id for r in twice] == [5, 5]
    assert D.decontaminate(docs.where("false"), one, broadcast_bytes=limit).count() == 0


def test_every_shared_span_of_window_words_has_a_fingerprint():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(200):
        h = rng.integers(0, 5, rng.integers(1, 40)).astype(np.uint64)
        chosen = set(D.winnowed(h, 6).tolist())
        for a in range(max(1, len(h) - 5)):
            part = h[a : a + 6]
            assert any(a + j in chosen for j in np.flatnonzero(part == part.min()))
