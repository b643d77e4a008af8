import random
import time
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pagewarden.llm import token_files as T

from .texts import HARD, documents, saved

PATH = P.path("word_bpe_49k.json")


@pytest.mark.parametrize("seed", range(4))
def test_blocks_come_back(seed):
    rng = np.random.default_rng(seed)
    blocks = [rng.integers(0, rng.choice([1, 2, 300, 65536]), rng.integers(1, 500)).astype(np.uint32) for _ in range(60)] + [np.zeros(0, np.uint32), np.full(2048, 65535, np.uint32)]
    coded = T.encode_blocks(blocks)
    back = T.decode_blocks(coded, [len(b) for b in blocks])
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, back, strict=True))
    # a block's bytes don't depend on its neighbours
    assert T.encode_blocks(blocks[3:4]) == coded[3:4]


def test_predictions_pay():
    rng = np.random.default_rng(1)
    phrase = rng.integers(0, 49000, 40)
    ids = np.concatenate([phrase] * 40).astype(np.uint32)
    assert sum(map(len, T.pack([ids]))) < len(ids) * 0.6
    noise = rng.integers(0, 49000, 5000).astype(np.uint32)
    assert sum(map(len, T.pack([noise]))) < len(noise) * 2.3


def test_a_flipped_bit_is_found():
    ids = np.arange(5000, dtype=np.uint32)
    (p,) = T.pack([ids])
    assert (T.unpack([p])[0] == ids).all()
    bad = bytearray(p)
    bad[len(p) // 2] ^= 1
    with pytest.raises((ValueError, Exception)):
        T.unpack([bytes(bad)])


def test_encoder_is_the_library(monkeypatch):
    known = Tokenizer.from_file(PATH)
    own = T.Encoder(PATH)
    own.memo.most = 3
    rng = random.Random(2)
    texts = [t or "" for t in HARD] + ["".join(rng.choice(["a", "The", "É", "é", " ", "\n", "'s", "9", "!", " ", "\x1c", " ", "<|endoftext|>", "\t"]) for _ in range(30)) for _ in range(300)]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == known.encode(t, add_special_tokens=False).ids, repr(t)


def test_words_merged_side_by_side_are_those_of_the_library():
    known = Tokenizer.from_file(PATH)
    own = T.Encoder(PATH)
    rng = random.Random(4)
    parts = ["in", "th", "an", "re", "er", "tion", "ß", "É", "ü", "a", "b", "q", "zz", "the", "Ing", "aaaa"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) + rng.choice(sorted(T.ENDINGS)) for _ in range(6000)] + ["", ".", "ÿ", "a" * 24, "a" * 25, "don't", "x'S.", "×", "ªb", "A1", "é"]
    for w, ids in zip(words, own.encode(words), strict=True):
        assert ids.tolist() == known.encode(w, add_special_tokens=False).ids, w


def test_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "SEGMENT", 900)
    known = Tokenizer.from_file(PATH)
    docs = documents(spark, extra=True).repartition(3)
    docs = docs.union(docs.where("doc_id = 5"))
    rows = sorted(T.query(spark, saved(spark, tmp_path, documents=docs)).collect(), key=lambda r: (r.doc_id, r.start))
    assert len(rows) == len(HARD) + 1
    at = 0
    for r in rows:
        ids = known.encode(HARD[r.doc_id] or "", add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert T.query(spark, saved(spark, tmp_path / "none", documents=docs.where("false"))).count() == 0


def test_null_ids_come_first(spark, tmp_path):
    docs = documents(spark, ["b", "a", "hello world"])
    none = documents(spark, ["lost"]).selectExpr("cast(null as bigint) doc_id", "text", "lang", "source", "n_chars")
    rows = T.query(spark, saved(spark, tmp_path, documents=docs.unionByName(none))).collect()
    found = {r.doc_id: (r.start, r.n_tokens) for r in rows}
    assert found[None][0] == 0 and found[0][0] == found[None][1] and len(rows) == 4


def test_order_0_knows_whole_ids():
    # four ids in random order: neither of the other orders predicts them, each takes two bits
    rng = np.random.default_rng(3)
    ids = rng.choice(np.array([5, 300, 301, 48000], np.uint32), 20000)
    (p,) = T.pack([ids])
    assert len(p) < len(ids) * 0.4 and (T.unpack([p])[0] == ids).all()


def test_coding_takes_a_small_multiple_of_sorting():
    rng = np.random.default_rng(5)
    ids = (rng.zipf(1.3, 400_000) % 49000).astype(np.uint32)
    spin = []
    for _ in range(3):
        at = time.process_time()
        sorted(ids.tolist())
        spin.append(time.process_time() - at)
    at = time.process_time()
    (back,) = T.unpack(T.pack([ids]))
    assert time.process_time() - at < 8 * sorted(spin)[1] and (back == ids).all()


@pytest.mark.parametrize("ids", [np.zeros(0), np.zeros(1), np.array([65535, 0]), np.arange(65536), np.full(9000, 7), np.tile([1, 2, 1, 3], 5000), np.arange(30000) ** 2 % 65536])
def test_segments_of_odd_ids_come_back(ids, monkeypatch):
    ids = ids.astype(np.uint32)
    for segment in (T.SEGMENT, 100):  # tables over all ids, and over the first of a long document
        monkeypatch.setattr(T, "SEGMENT", segment)
        (back,) = T.unpack(T.pack([ids]))
        assert len(back) == len(ids) and (back == ids).all()


def test_carries_run_through_many_words():
    # ids whose ranges all hold one number, with its words nothing but ones or zeros, then an id above or below
    ids = (np.random.default_rng(7).zipf(1.4, 9000) % 60000).astype(np.uint32)
    for model in (T.Model(), T.Model.of(ids, 65535)):
        for number in (0x80000000, 0x7FFFFFFF, 0x00010000, 0xFFFF0000):
            payload = np.array([number] + [0] * 60, "<u4").tobytes()
            (held,) = T.decode_blocks([payload], [40], model)
            blocks = [np.append(held[:j], [x, 3]).astype(np.uint32) for j in range(1, 40) for x in (0, held[j - 1], 700, 40000, 65535)]
            coded = T.encode_blocks(blocks, model)
            assert all((a == b).all() for a, b in zip(blocks, T.decode_blocks(coded, [len(b) for b in blocks], model), strict=True))


def test_a_flipped_bit_anywhere_is_found():
    ids = (np.arange(3000) * 7 % 500).astype(np.uint32)
    (p,) = T.pack([ids])
    for at in range(0, len(p), 37):
        bad = bytearray(p)
        bad[at] ^= 4
        with pytest.raises((ValueError, IndexError)):
            T.unpack([bytes(bad)])


@pytest.mark.parametrize(("most", "room", "piece"), [(400_000, 20_000_000, 8_000_000), (400_000, 40, 50), (5, 20_000_000, 1), (0, 0, 300)])
def test_words_that_are_kept_change_nothing(monkeypatch, most, room, piece):
    known = Tokenizer.from_file(PATH)
    monkeypatch.setattr(T, "PIECE", piece)
    own = T.Encoder(PATH)
    own.memo = T.Words(most, room)
    texts = [*HARD, "", None, "ab ab, AB. \n ÀÉ Àé, ß. " * 3, *HARD]
    for _ in range(2):
        for t, ids in zip(texts, own.encode(pa.array(texts)), strict=True):
            assert ids.tolist() == known.encode(t or "", add_special_tokens=False).ids, repr(t)
        assert len(own.memo.words) <= most and len(own.memo.words) == len(own.memo.sizes) and own.memo.sizes.sum() == len(own.memo.ids)


def test_all_of_a_long_document_is_counted(monkeypatch):
    # what comes after twice a segment is as easy to predict as what comes before
    rng = np.random.default_rng(9)
    ids = np.concatenate([np.tile(rng.integers(0, 49000, 50), 200) for _ in range(4)]).astype(np.uint32)
    monkeypatch.setattr(T, "SEGMENT", 5000)
    (p,) = T.pack([ids])
    assert (T.unpack([p])[0] == ids).all() and len(p) < len(ids) * 0.4
    first = T.pack([ids[:10000]])[0]
    for bad in (p[:-1], p[:20], p[: len(first) - 1], b""):
        with pytest.raises((ValueError, IndexError)):
            T.unpack([bad])


def test_a_missing_part_is_found(monkeypatch):
    monkeypatch.setattr(T, "SEGMENT", 1000)
    p = T.pack([np.arange(4000, dtype=np.uint32)])[0]
    second = len(T._packed(np.arange(2000, dtype=np.uint32), 1))
    for bad in (p[:second], p[second:] + p[:second], p[:second] + p):
        with pytest.raises(ValueError):
            T.unpack([bad])
