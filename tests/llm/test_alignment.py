import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pagewarden.llm import alignment
from pagewarden.llm.token_count import byte_letters

from .texts import HARD, documents, saved

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
MORE = ["x▁y", "▁", "word" * 300, "Größe über ñandú " * 40, "a b", "ﬁne ２", "one  two", "trailing ", "\\x41 <0x41> <s> </s> <unk>", "中文字符没有空格" * 300, "\r\n\t\v", "é ́ à", "the the the the cat"]


@pytest.fixture(scope="module")
def own():
    return alignment.aligner(A, B)


@pytest.fixture(scope="module")
def plain():
    """The contract by the libraries, one token after another: (ids and bytes of A, of B) of a text."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = byte_letters()

    def of_b(i):
        name = b.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if b.is_byte(i) else name.replace("▁", " ").encode()

    def run(text):
        if not text:
            return [], []
        x = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = [(i, of_b(i)) for i in b.encode(text)]
        whole = (" " + text).encode()
        return (x, y) if b"".join(t for _, t in x) == b"".join(t for _, t in y) == whole else ([], [])

    return run


def groups(x, y):
    """(ids of A, ids of B) of each group, by comparing the ends' sets."""
    ends = lambda tokens: np.cumsum([len(t) for _, t in tokens]).tolist()
    cuts = sorted(set(ends(x)) & set(ends(y)))
    side = lambda tokens, a, b: [i for (i, _), e in zip(tokens, ends(tokens), strict=True) if a < e <= b]
    return [(side(x, a, b), side(y, a, b)) for a, b in zip([0, *cuts], cuts, strict=False)]


def written(found):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in found)


def test_groups_are_those_between_common_ends(own, plain):
    rng = random.Random(8)
    texts = [t or "" for t in HARD] + MORE
    texts += ["".join(rng.choice(["a", "the", " ", " ", "\n", "'s", "r", "é", "9", "!", "ing", "▁", "\x1c", "中", "Word", ".", ", "]) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    found = own.align(texts)
    for text, got in zip(texts, own.texts_of(found), strict=True):
        assert got == written(groups(*plain(text))), repr(text[:60])
    assert own.align([]).a.size == 0 and own.texts_of(own.align(["", ""])) == ["", ""]


def test_intervals_without_a_common_end_are_leaves():
    rng = np.random.default_rng(4)
    for n, p in ((2000, 0.5), (5000, 0.02), (5000, 0.0)):
        a = np.flatnonzero(rng.random(n) < 0.5) * 2
        b = np.where(rng.random(n) < p, np.arange(n) * 2, np.arange(n) * 2 + 1)
        x, y = alignment.common_ends(a, b, np.array([0, len(a) // 3]), np.array([len(a) // 3, len(a)]))
        assert a[x].tolist() == np.intersect1d(a, b).tolist() == b[y].tolist()


def test_every_end_is_looked_up_a_few_times_at_most(monkeypatch):
    n, looked = 20_000, []
    a, b = np.arange(n) * 2, np.concatenate([np.arange(n - 3) * 2 + 1, np.arange(n - 3, n) * 2])  # common ends at one side only
    find = np.searchsorted
    monkeypatch.setattr(alignment.np, "searchsorted", lambda x, v: looked.append(len(v)) or find(x, v))
    alignment.common_ends(a, b, np.array([0]), np.array([n]))
    assert sum(looked) < 3 * n and len(looked) < 300


def test_all_linked_pairs_are_in_the_table(own):
    assert len(own.pairs) < 500_000
    assert own.pairs.tolist()[:100] == sorted(set(own.pairs.tolist()))[:100]
    x = own.align(["Größe über ñandú 中文 the cat, sat. 123 <0x41>\n"])
    places = own.places(x)
    assert (own.pairs[places] >> 32 == x.a[x.cut_a]).all() and (own.pairs[places] & 0xFFFFFFFF == x.b[x.cut_b]).all()


def test_query_is_the_contract(spark, tmp_path, plain):
    texts = [*HARD, *MORE, HARD[5], HARD[5]]
    sf = saved(spark, tmp_path, documents=documents(spark, texts, extra=True).withColumnRenamed("items", "links").repartition(3))
    found = [groups(*plain(t)) for t in texts]
    linked = [[(a[-1], b[-1]) for a, b in f] for f in found]
    count = Counter(x for f in linked for x in f)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    rows = {r.doc_id: r for r in alignment.query(spark, sf).collect()}
    assert len(rows) == len(texts)
    for i, (text, f, own) in enumerate(zip(texts, found, linked, strict=True)):
        x, y = plain(text)
        sha = hashlib.sha256(written(f).encode()).hexdigest() if f else ""
        want = (len(x), len(y), len(f), len(own), sum(count[p] == most[p[1]] for p in own), sum(count[p] for p in own), sha)
        r = rows[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == want, repr(text)


def test_groups_as_rows_repeats_and_empty_table(spark, plain):
    docs = documents(spark, ["the cat sat", "", None, "unbelievable Größe"])
    rows = {r.doc_id: r for r in alignment.groups(docs.union(docs), A, B).collect()}
    for i, text in enumerate(["the cat sat", "", None, "unbelievable Größe"]):
        x, y = plain(text)
        assert rows[i].a == [j for j, _ in x] and rows[i].b == [j for j, _ in y]
        at = [(0, 0), *[(g.a_end, g.b_end) for g in rows[i].groups]]
        assert [(rows[i].a[p:q], rows[i].b[r:s]) for (p, r), (q, s) in zip(at, at[1:], strict=False)] == groups(x, y)
    empty = alignment.links(docs.where("false"), A, B)
    assert alignment.scored(empty, A, B).count() == 0 and alignment.groups(docs.where("false"), A, B).count() == 0

