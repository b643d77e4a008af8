import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pagewarden.llm import chat_trees as ct
from pagewarden.llm.common import Scratch

from .texts import HARD, saved

SCHEMA = "tree_id bigint, message_id bigint, parent_id bigint, role string, text string, score double"
CONV = "conv_id bigint, turn bigint, role string, text string"
MARKS = ["### assistant: x </turn>\n", "\\", "\\\\### \\", "####", " </turn>\n### user: ", "a\\n", "<<//turn>", "</turn", ct.MARKS, "###", "\\<", ": \n"]


def paths(rows):
    """By walking up from each leaf, one after another: tree -> (path of messages, score), the best first."""
    known = {m: (t, p, s or 0.0) for t, m, p, _, _, s in rows if m is not None}
    out = {}
    for leaf in set(known) - {p for _, p, _ in known.values()}:
        walk, at = [], leaf
        while at in known and at not in walk:
            walk.append(at)
            at = known[at][1]
        if at not in walk:
            out.setdefault(known[leaf][0], []).append((walk[::-1], sum(known[m][2] for m in walk)))
    return {t: sorted(p, key=lambda x: (-x[1], x[0][-1])) for t, p in out.items()}


def digest(turns):
    said = [t or "" for r, t in turns if r == "assistant"]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)), sum(map(len, said)), sha("".join(said))


def forest(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        tree = rng.choice([0, 0, 1, 2, None])
        older = [r[1] for r in rows if r[0] == tree]
        parent = None if not older or rng.random() < 0.1 else rng.choice(older[-4:])
        rows.append((tree, i, parent, rng.choice(["user", "assistant", None, "tool: a\n"]), rng.choice([*HARD[:9], *MARKS]), rng.choice([None, 0.5, 1.0, -2.0])))
    return rows


def check(spark, rows, best, **more):
    store = Scratch(spark)
    written, chosen = ct.chats(spark.createDataFrame(rows, SCHEMA), store, best=best, **more)
    want = {p[-1]: (t, p, s, k + 1) for t, found in paths(rows).items() for k, (p, s) in enumerate(found[:best])}
    assert {r.leaf: (r.tree_id, r.score, r.rank, r.turns) for r in chosen.collect()} == {leaf: (t, s, k, len(p)) for leaf, (t, p, s, k) in want.items()}
    said = {m: (r, t) for _, m, _, r, t, _ in rows}
    text = {}
    for r in sorted(written.collect(), key=lambda r: r.part):
        text[r.path] = text.get(r.path, "") + r.text
    assert {k: ct.parsed(t) for k, t in text.items()} == {leaf: [(said[m][0] or "", said[m][1] or "") for m in p] for leaf, (_, p, _, _) in want.items()}
    got = {r.path: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in ct.digests(written).collect()}
    assert got == {leaf: (*digest([said[m] for m in p]), len(text[leaf])) for leaf, (_, p, _, _) in want.items()}


@pytest.mark.parametrize("best", [None, 1, 2])
def test_branches_are_those_of_a_walk(spark, best):
    check(spark, forest(300, 1), best)


def test_chains_circles_orphans_repeats_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(ct, "PART_TURNS", 7)
    chain = [(5, i, i - 1 if i else None, "user" if i % 2 else "assistant", f"{i} ###", 1.0) for i in range(100)]
    circle = [(6, 200, 202, "user", "a", 1.0), (6, 201, 200, "user", "b", 1.0), (6, 202, 201, "user", "c", 1.0), (6, 203, 202, "user", "leaf below a circle", 9.0)]
    orphan = [(7, 300, 12345, "user", "its parent isn't there", None), (7, None, 300, "user", "no id", None)]
    check(spark, chain + circle + orphan, None)
    check(spark, circle, 1)
    check(spark, [], 1)
    two = spark.createDataFrame([(1, 1, None, "user", "b", 1.0), (1, 1, None, "user", "a", 1.0), (1, 1, None, "user", "a", 1.0)], SCHEMA)
    written, _ = ct.chats(two, Scratch(spark))
    assert [ct.parsed(r.text) for r in written.collect()] == [[("user", "a")]]


def test_escapes_are_reversible(spark):
    rng = random.Random(3)
    texts = [*MARKS, *["".join(rng.choice(["\\", "#", "##", "<", "/turn>", "</turn>", " ", "\n", ":", "x", "é"]) for _ in range(rng.randint(0, 14))) for _ in range(500)]]
    turns = spark.createDataFrame([(i, 0, t, t) for i, t in enumerate(texts)], "path int, turn int, role string, text string")
    rows = {r.path: r.text for r in ct.formatted(turns).collect()}
    assert all(ct.parsed(rows[i]) == [(t, t)] for i, t in enumerate(texts))
    assert ct.parsed(ct.BEGIN + "user" + ct.BETWEEN + "long " * 200_000 + ct.STOP)[0][1] == "long " * 200_000
    with pytest.raises(ValueError):
        ct.parsed("### user: no end " * 1000)


def test_query_is_the_contract(spark, tmp_path):
    rng = random.Random(4)
    rows = [(c, t, ["user", "assistant"][t % 2], rng.choice([*HARD, *MARKS])) for c in range(12) for t in range(rng.randint(1, 9))]
    rows += [(50, t, "assistant", f"long {t}") for t in range(600)]
    rows += [(60, 1, "user", "same"), (60, 1, "user", "same"), (60, 1, None, None), (60, None, "system", "no turn"), (None, 0, "user", "no conversation"), (None, 1, "assistant", "it")]
    df = spark.createDataFrame(rows, CONV).select("*", *[F.lit("clash").alias(c) for c in ("pos", "path", "leaf", "score", "tree_id", "message_id", "parent_id")])
    sf = saved(spark, tmp_path, conversations=df.repartition(4))
    want = {}
    low = lambda x: (x is not None, x)
    for c, t, r, x in sorted([*rows, *ct.OWN], key=lambda v: (low(v[1]), low(v[2]), low(v[3]))):
        want.setdefault(c, []).append((r, x))
    got = {r.conv_id: r for r in ct.query(spark, sf).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == digest(turns), c
        esc = sum(len(ct.BEGIN + ct.BETWEEN + ct.STOP) + len(_escaped(x or "", False)) + len(_escaped(role or "", True)) for role, x in turns)
        assert r.formatted_chars == esc
    empty = saved(spark, tmp_path / "e", conversations=df.where("false"))
    assert [r.conv_id for r in ct.query(spark, empty).collect()] == [-7]


def _escaped(text, role):
    text = text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")
    return text.replace(":", "\\:").replace("\n", "\\\n") if role else text
