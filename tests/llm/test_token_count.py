import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from pagewarden.llm import bpe
from pagewarden.llm import token_count as T

from .texts import HARD, documents, saved

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def known():
    return Tokenizer.from_file(PATH)


def n(known, text):
    return len(known.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("chunk", [1, 2, 5, 33, 32_768])
def test_counts_are_those_of_the_library_at_any_chunk_size(known, chunk):
    own = T.counter(PATH, chunk)
    for text in HARD:
        text = (text or "")[: 400 if chunk < 5 else None]
        assert own.count(text) == n(known, text), (chunk, text[:40])


def test_random_texts(known):
    rng = random.Random(7)
    own = T.counter(PATH, 6)
    for _ in range(500):
        text = "".join(rng.choice(["a", "the", "tion", "er", " ", " ", "\n", "'s", "'", "r", "e", "é", "9", "!", " ", "\x1c", "中", "<|endoftext|>"]) for _ in range(rng.randint(0, 40)))
        assert own.count(text) == n(known, text), repr(text)


def test_tables_start_anew_without_changing_counts(known, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_STATES", 20)
    own = T.Counter(PATH)
    for text in ("internationalization of tokenizers", "Größe und Länge", "x" * 400):
        assert own.count(text) == n(known, text)


@pytest.mark.parametrize("meet", [0, 1, 3, 64])
def test_prefix_scan_gives_the_count_up_to_each_chunk(known, meet, monkeypatch):
    monkeypatch.setattr(T, "MEET", meet)
    own = T.Counter(PATH, 5)
    rng = random.Random(3)
    for piece in ("internationalizationalities" * 3, "中文字符没有空格" * 4, "".join(rng.choice("aeinrst") for _ in range(60)), "a" * 64, "x" * 5):
        chunks = [piece[i : i + 5] for i in range(0, len(piece), 5)]
        maps = own.scan([own.map(chunks, i) for i in range(len(chunks))], chunks)
        for i, m in enumerate(maps):
            assert (m.first, m.last, m.n) == (0, i + 1, n(known, piece[: 5 * (i + 1)]))
            assert len(m.passed) <= max(meet, 1)


def test_long_texts_without_blanks_at_the_default_chunk(known):
    import tracemalloc

    rng = random.Random(5)
    own = T.Counter(PATH)
    letters = [rng.choice("etaoinshrdlu") for _ in range(70_000)]
    for text in ("".join(letters), "".join(rng.choice("ABCDabcd0123+/") for _ in range(70_000)), "中文字符没有空格" * 9000, "word " * 20_000 + "".join(letters[:40_000]), "a" * 80_000):
        assert own.count(text) == n(known, text)
    long = "".join(rng.choices("ABCDabcd0123+/", k=1000)) * 2000
    tracemalloc.start()
    own.count(long)
    assert tracemalloc.get_traced_memory()[1] < 30e6  # of 2 million characters, with what the memo keeps
    tracemalloc.stop()


def test_query(spark, tmp_path, known):
    docs = documents(spark, extra=True)
    sf = saved(spark, tmp_path, documents=docs.union(docs.limit(0)).union(docs.where("doc_id = 5")))
    rows = T.query(spark, sf).collect()
    assert len(rows) == len(HARD) + 1
    for r in rows:
        text = HARD[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n(known, text), n(known, text) > 1024)
    assert T.count_tokens(docs.where("false"), PATH).count() == 0
