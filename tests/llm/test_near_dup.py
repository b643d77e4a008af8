import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewarden.llm import near_dup as N

from .texts import HARD, documents, saved

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


def brute(rows, threshold=0.8):
    """Class of each row by comparing all pairs of texts."""
    texts = {}
    for i, t in rows:
        if t is not None and i is not None:
            w = words(t)
            texts.setdefault(tuple(w) if w else t, []).append(i)
    keys = list(texts)
    parent = list(range(len(keys)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    grams = [list(dict.fromkeys(zip(k, k[1:], k[2:], k[3:], k[4:], strict=False))) if isinstance(k, tuple) else [] for k in keys]
    for x in range(len(keys)):
        for y in range(x):
            a, b = grams[x], grams[y]
            if a and b and lcs(a, b) / (len(a) + len(b) - lcs(a, b)) >= threshold:
                parent[root(x)] = root(y)
    least = {}
    for x, k in enumerate(keys):
        least[root(x)] = min(least.get(root(x), 10**9), *texts[k])
    of = {k: least[root(x)] for x, k in enumerate(keys)}
    return sorted((i, i if t is None else of[tuple(words(t)) if words(t) else t]) for i, t in rows if i is not None)


def lcs(a, b):
    if not set(a) & set(b):
        return 0
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    rows = []
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(6, 90))]
        if g % 3 == 0:
            base = base[:10] + passage + base[10:]
        for _ in range(rng.choice([1, 2, 5, 9])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            sep = rng.choice([" ", ", ", "\n"])
            rows.append((len(rows), sep.join(w).upper() if rng.random() < 0.3 else sep.join(w)))
    for _ in range(6):  # the same text with and without a passage of its own once more
        base = [rng.choice(vocabulary) for _ in range(120)]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base + base[40:52])), (len(rows) + 2, " ".join(base[:8] * 3 + base))]
    long = [rng.choice(vocabulary) for _ in range(4000)]
    rows += [(500, " ".join(long)), (501, " ".join(long[:1500] + ["x"] * 5 + long[1500:])), (502, " ".join(long[2000:] + long[:2000]))]
    rows += [(600 + i, t) for i, t in enumerate(HARD)] + [(700, "hello, WORLD"), (701, "repeat the line\n" * 80), (702, ""), (703, "!!!"), (704, "!!!"), (705, None), (1, rows[1][1]), (706, rows[4][1])]
    rng.shuffle(rows)
    return rows


def test_against_all_pairs(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for name in ("id", "key", "n", "buckets", "class_id"):
        docs = docs.withColumn(name, F.lit("clash"))
    got = N.query(spark, saved(spark, tmp_path, documents=docs))
    assert got.columns == ["doc_id", "class_id"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)
    assert sorted(tuple(r) for r in N.classes(docs, broadcast_bytes=0).collect()) == brute(rows)


def test_small_classes_of_a_hot_bucket_meet(spark, monkeypatch):
    rng = random.Random(6)
    text = lambda n: [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(99)) for _ in range(n)]
    near = lambda w, i: " ".join([*w[:i], "other" + str(rng.randrange(10**6)), *w[i + 1 :]])
    hot, small = text(60), [text(60) for _ in range(5)]
    texts = [near(hot, i % 60) for i in range(60)] + [near(w, i) for w in small for i in (1, 55, 58)]
    rows = [(i, t) for i, t in enumerate(rng.sample(texts, len(texts)))]
    monkeypatch.setattr(N, "sketch", lambda kmers: [7])
    got = N.classes(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_pairs_of_a_large_bucket_by_their_rarest_kmers(spark):
    rng = random.Random(8)
    base = [rng.randrange(10**9) for _ in range(60)]
    rows = []
    for i in range(90):
        own = [x if rng.random() > i / 300 else rng.randrange(10**9) for x in base][: rng.randint(50, 60)]
        rows.append((bytes([i]), len(own), bytes([rng.randrange(100)]) if i % 3 else b"same", own))
    each = spark.createDataFrame([(k, n, c, g) for k, n, c, own in rows for g in own], "key binary, n bigint, of binary, g bigint")
    bits = spark.createDataFrame([(k, *N.parity(np.array(sorted({*own}), np.uint64) << np.uint64(13)).tolist()) for k, _, _, own in rows], "key binary, " + ", ".join(f"{p} bigint" for p in N.PARITIES))
    pairs = N.close(N.prefixes(each, 0.8).join(bits, "key"), 0.8)
    got = {(bytes(r.a), bytes(r.b)) for r in pairs.collect()}
    share = lambda a, b: len({*a} & {*b}) / len({*a} | {*b})
    want = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[2] != y[2] and share(x[3], y[3]) >= 0.8}
    assert want <= got and len(want) > 100 and len(got) < len(rows) ** 2 / 3


def family(n, seed=21):
    """Texts of one template of 150 words with four words changed each: hardly two are similar enough, all share most k-mers."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(n):
        w = list(base)
        for at in rng.sample(range(150), 4):
            w[at] = f"c{rng.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    return rows


def test_template_families_verify_pairs_in_proportion(spark, monkeypatch):
    seen, plain = [], N.verified
    monkeypatch.setattr(N, "verified", lambda pairs, *rest: seen.append(pairs.count()) or plain(pairs, *rest))
    rows = family(40)
    assert sorted(tuple(r) for r in N.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()) == brute(rows)
    seen.clear()
    N.classes(spark.createDataFrame(family(300), "doc_id bigint, text string")).count()
    few = sum(seen)
    seen.clear()
    N.classes(spark.createDataFrame(family(1200), "doc_id bigint, text string")).count()
    assert sum(seen) < few * 4**1.2, (few, sum(seen))


def test_parities_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(3)
    for n in (5, 60, 700, 5000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([np.delete(a, rng.choice(n, n // 7, replace=False)), rng.integers(0, 2**63, n // 30).astype(np.uint64)])
        apart = sum(int(x ^ y).bit_count() if x ^ y >= 0 else (int(x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(N.parity(a).tolist(), N.parity(b).tolist(), strict=True))
        assert apart <= len(np.setxor1d(a, b))


def shares(a, b):
    return bool({x for x in N.sketch(a) if x is not None} & {x for x in N.sketch(b) if x is not None})


@pytest.mark.parametrize("seed", range(40))
def test_similar_texts_share_a_bucket_whatever_repeats_or_length(seed):
    rng = np.random.default_rng(seed)
    new = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    base, line = new(400), new(8)
    changed = base.copy()
    changed[200:205] = new(5)
    assert shares(np.concatenate([base, np.tile(line, 5)]), np.concatenate([changed, np.tile(line, 200)]))
    assert shares(base, np.concatenate([changed, base[:1]]))
    for n in (5, 6, 10, 40, 41, 50):
        long = new(n)
        assert shares(long, np.delete(long, rng.choice(n, n // 5, replace=False)))


def test_one_of_each_group_stays(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("class_id", F.lit(0))
    kept = N.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({i for i, c in brute(rows) if i == c})
    assert N.one_of_each(docs.where("false")).count() == 0


def test_nulls_and_empty_tables(spark):
    docs = documents(spark)
    docs = docs.unionByName(docs.withColumn("doc_id", F.lit(None).cast("bigint")).limit(3))
    assert N.classes(docs).count() == len(HARD) + 3
    assert N.classes(docs.where("false")).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_alignment_is_the_longest_common_subsequence_when_it_counts(seed):
    rng = np.random.default_rng(seed)
    a = rng.permutation(200)[: rng.integers(1, 120)].astype(np.uint64)
    b = list(a)
    for _ in range(rng.integers(0, 12)):
        x, y = rng.integers(0, len(b), 2)
        if rng.random() < 0.5:
            b.insert(int(y), b.pop(int(x)))
        else:
            b[x] = 1000 + int(rng.integers(0, 10**6))
    b = np.array(b, np.uint64)
    m = lcs(a.tolist(), b.tolist())
    want = m / (len(a) + len(b) - m)
    got = N.aligned(a, b)
    assert got == (pytest.approx(want) if want >= 0.8 else 0.0)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 80)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in N.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}


def test_components_leave_out_edges_with_a_null_end(spark):
    edges = spark.createDataFrame([(1, 2), (None, 2), (3, None), (None, None), (2, 5)], "a bigint, b bigint")
    assert {(r.node, r.component) for r in N.components(edges).collect()} == {(1, 1), (2, 1), (5, 1)}
