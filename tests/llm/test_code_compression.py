import hashlib
import math
import random

import numpy as np
import pytest

from pagewarden.llm import code_compression as cc

from .texts import saved

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def plain(rows):
    """The contract, word by word, with Python integers."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return {}
    cut = lambda v: [v[k : k + len(v) // 8] for k in range(0, len(v), len(v) // 8)]
    books = [list(x) for x in zip(*[cut(v) for _, v, _ in sorted(kept)[:16]], strict=True)]
    away = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    nearest = lambda x, book: min(range(len(book)), key=lambda e: (away(x, book[e]), e))
    for _ in range(6):
        for p, book in enumerate(books):
            members = [[] for _ in book]
            for _, v, _ in kept:
                members[nearest(cut(v)[p], book)].append(cut(v)[p])
            books[p] = [[sum(c) // len(m) for c in zip(*m, strict=True)] if m else e for m, e in zip(members, book, strict=True)]
    out = {}
    for i, v, label in kept:
        code = [nearest(x, book) for x, book in zip(cut(v), books, strict=True)]
        out[i] = ["".join(f"{c:02x}" for c in code), sum(away(x, book[c]) for x, book, c in zip(cut(v), books, code, strict=True)), label]
    total = {}
    for _, error, label in out.values():
        total[label] = total.get(label, 0) + error
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return {i: (code, error, total[label], sha) for i, (code, error, label) in out.items()}


def got(df):
    return {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()}


def vectors(n, width=16, seed=3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(width)] for _ in range(9)]
    return [(i * 3 - 50, [x + rng.gauss(0, 0.05) for x in rng.choice(centres)], rng.choice([0, 1, 2, None])) for i in range(n)]


@pytest.mark.parametrize("width", [8, 16, 64])
def test_query_is_the_plain_definition(spark, tmp_path, width):
    rows = vectors(400, width)
    rows += [(5000 + i, rows[7][1], 1) for i in range(300)]  # copies
    rows += [(9001, None, 1), (9002, [None] * width, 1), (9003, [float("nan")] * width, None), (9004, [float("inf")] + [0.0] * (width - 1), 2)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' id", "'clash' code", "'clash' trees", "'clash' of")
    sf = saved(spark, tmp_path, embeddings=df.repartition(3))
    assert got(cc.query(spark, sf)) == plain(rows)


def test_ties_few_rows_repeats_and_empty_tables(spark, tmp_path):
    grid = [(i, [float(i % 3 - 1)] * 8, 0) for i in range(40)]  # ties between entries
    few = vectors(5, 8)
    none = [(1, None, 0)]
    for k, rows in enumerate((grid, few, none, [])):
        sf = saved(spark, tmp_path / str(k), embeddings=spark.createDataFrame(rows, SCHEMA))
        assert got(cc.query(spark, sf)) == plain(rows)
    df = spark.createDataFrame([*few, *few, (None, [0.5] * 8, None)], SCHEMA)
    out, books = cc.compress(df)
    assert out.count() == 11 and books.shape == (8, 6, 1)


def test_other_lengths_and_huge_components_are_errors(spark):
    for rows in ([(1, [0.0] * 8, 0), (2, [0.0] * 16, 0)], [(1, [0.0] * 9, 0)], [(1, [1e30] * 8, 0)]):
        with pytest.raises(Exception, match="vectors must have|smaller scale"):
            cc.compress(spark.createDataFrame(rows, SCHEMA))[0].collect()


@pytest.mark.parametrize("seed", range(4))
def test_trees_cover_separate_and_assign_like_all_pairs(seed):
    rng = np.random.default_rng(seed)
    points = np.concatenate([rng.integers(-900, 900, (700, 4)), rng.normal(0, 30, (900, 4)).astype(np.int64), np.tile(rng.integers(-9, 9, (1, 4)), (200, 1))])
    tree = cc.Tree.read(cc.Tree.built(points).packed())
    assert sorted(tree.order.tolist()) == list(range(len(points)))
    assert (tree.points == points[tree.order]).all()
    for k, n in enumerate(tree.nodes):
        own = tree.points[n["start"] : n["end"]]
        assert (tree.total[k] == own.sum(axis=0)).all()
        assert np.sqrt(cc._squares(own, tree.centre[k]).max()) <= n["radius"] + 1e-9
        children = range(n["child"], n["child"] + n["children"])
        if n["children"]:
            assert n["children"] > 1 and sum(tree.nodes[c]["end"] - tree.nodes[c]["start"] for c in children) == n["end"] - n["start"]
            most = max(tree.nodes[c]["radius"] for c in children)
            assert all(np.sqrt(cc._squares(tree.centre[[c]], tree.centre[d])[0]) > most - 1e-9 for c in children for d in children if c < d)
    book = points[rng.choice(len(points), 16)]
    sums, numbers, code = tree.assigned(book)
    want = np.stack([cc._squares(tree.points, e) for e in book], axis=1).argmin(axis=1)
    assert (code == want).all() and (numbers == np.bincount(want, minlength=16)).all()
    assert all((sums[e] == tree.points[want == e].sum(axis=0)).all() for e in range(16))


def test_whole_subtrees_are_assigned_without_their_points(monkeypatch):
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c, 20, (2000, 4)).astype(np.int64) for c in (-3000, 0, 3000)])
    tree, compared = cc.Tree.built(points), []
    nearest = cc._nearest
    monkeypatch.setattr(cc, "_nearest", lambda p, b: compared.append(len(p)) or nearest(p, b))
    tree.assigned(np.array([[-3000] * 4, [0] * 4, [3000] * 4]))
    assert sum(compared) < 100
