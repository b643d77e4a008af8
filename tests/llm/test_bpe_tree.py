import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from pagewarden.llm import bpe_tree
from pagewarden.llm.bpe import Transducer, merged, merged_parts, ranks_of

from .texts import HARD, documents, saved

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def known():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks_of(PATH), special_tokens={})


@pytest.mark.parametrize("leaf", [1, 2, 3, 7, 64, 16_384])
def test_ids_are_those_of_the_library_at_any_leaf_size(known, leaf):
    own = bpe_tree.Codec(PATH, P.PATTERN, leaf)
    for text in HARD:
        text = text or ""
        if leaf < 7:
            text = text[:600]
        ids = own.encode(text)
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == known.encode_ordinary(text), (leaf, text[:40])
        assert own.decode(ids) == text.encode()


def test_random_texts(known):
    rng = random.Random(5)
    own = bpe_tree.Codec(PATH, P.PATTERN, 4)
    for _ in range(400):
        text = "".join(rng.choice(["a", "the", " ", " ", "\n", "'s", "'", "r", "e", "é", "9", "!", " ", "\x1c", "中"]) for _ in range(rng.randint(0, 60)))
        ids = own.encode(text)
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == known.encode_ordinary(text), repr(text)


def test_long_texts_at_the_default_leaf(known):
    rng = random.Random(9)
    own = bpe_tree.Codec(PATH, P.PATTERN)
    letters = "".join(rng.choice("etaoinshrdlu") for _ in range(60_000))
    for text in (letters, "".join(rng.choice("ABCDabcd0123+/") for _ in range(60_000)), "中文字符没有空格" * 4000, "two words " * 5000, "a" * 50_000, "word " * 4000 + letters, " " * 40_000 + "x"):
        ids = own.encode(text)
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == known.encode_ordinary(text), text[:20]
        assert own.decode(ids) == text.encode()


def test_words_merged_side_by_side_are_those_of_the_library(known):
    rng = random.Random(6)
    own = bpe_tree.Codec(PATH, P.PATTERN)
    parts = ["in", "th", "an", "re", "er", "tion", "ß", "É", "ü", "a", "b", "q", "zz", "the", "Ing", "aaaa"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) + rng.choice(sorted(bpe_tree.ENDINGS))
    texts = [" ".join(word() for _ in range(60)) for _ in range(100)] + ["don't x'S. ªb A1 " + "a" * 25, "ÿ × é  two"]
    own.prepare(texts)
    assert own.side is not None and len(own.spaced) > 3000
    for text in texts:
        ids = own.encode(text)
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == known.encode_ordinary(text), text


def test_pieces_merge_as_defined_and_counts_agree(known):
    own = Transducer(ranks_of(PATH))
    for piece in (b"the" * 90, b"abcabd" * 100, bytes(range(97, 123)) * 10, b"a" * 999):
        ids = merged(piece, ranks_of(PATH))
        assert ids == [ranks_of(PATH)[p] for p in merged_parts(piece, ranks_of(PATH))] == known.encode_ordinary(piece.decode())
        assert own.count(piece) == len(ids)


def test_query(spark, tmp_path, known):
    docs = documents(spark, extra=True)
    sf = saved(spark, tmp_path, documents=docs.union(docs.where("doc_id < 3")))
    rows = bpe_tree.query(spark, sf).collect()
    assert len(rows) == len(HARD) + 3
    for r in rows:
        text = HARD[r.doc_id] or ""
        ids = known.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_encode_then_decode_and_empty_table(spark):
    docs = documents(spark)
    back = {r.doc_id: bytes(r.bytes) for r in bpe_tree.decode(bpe_tree.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(HARD)}
    assert bpe_tree.encode(docs.where("false"), PATH, P.PATTERN).count() == 0
