"""Byte-level BPE encoding and decoding as a reduction over a tree of text halves.

A text is halved until parts are short, parts are encoded, and neighbours are
joined. What the joined parts say about a text [lo, hi) is a monoid element:

- head: the text before the first cut of the part (see bpe.Segments), all of it if there is none;
- body: the ids between the first cut and the last; no text around can change them;
- tail: the text from the last cut on.

The join re-encodes the window tail + head between the two bodies. If the right part
has no cut the window grows by it and stays open; so ids are fixed only between two
cuts, where matches of the splitting pattern provably begin anew. A single match that is
longer than a leaf is halved too: its halves' tokens are joined by encoding a window of
tokens around the border again; it grows on each side until the tokens outside and in it
provably stay as they are, since each pair of neighbours encodes to itself (bpe.Borders).
Decoding halves the ids likewise and concatenates bytes up the tree.

Null text is empty text. Every text round-trips; ids are those of the rank file. Repeated rows and
null ids are rows of their own, an empty table gives no rows, other columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.llm.bpe import ENDINGS, LETTERS, Borders, Memo, Segments, SideBySide, Unclosed, merged, ranks_of, segments, white
from pagewarden.llm.common import spread, table

LEAF_CHARS = 16_384
LEAF_IDS = 16_384
BATCH = 250


@dataclass(slots=True)
class Part:
    head: str
    body: list[bytes] | None  # None: no cut, all is head
    tail: str


class Codec:
    def __init__(self, path: str, pattern: str, leaf: int = LEAF_CHARS, ranks: dict[bytes, int] | None = None):
        """ranks: those of path if it isn't a rank file itself."""
        self.ranks, self.leaf = ranks_of(path) if ranks is None else ranks, leaf
        self.find, self.iterate = regex.compile(pattern).findall, regex.compile(pattern).finditer
        self.borders = Borders(self.ranks)
        self.side = _side_by_side(path, pattern) if ranks is None else _all_merges(ranks, pattern)
        self.pieces = Memo(self._piece, 150_000)
        self.spaced = Segments(self._segment)
        self.bytes = {i: b for b, i in self.ranks.items()}

    def prepare(self, texts: list[str]) -> None:
        """Merges the new words of texts side by side, which is faster than one by one: a space, letters, and maybe a known ending, which is a match of its own."""
        if self.side is None:
            return
        known, old, words, ends = self.spaced, self.spaced.old, [], []
        for x in {x for t in texts for x in t.split(" ")}:
            if x and x not in known and x not in old:
                m = LETTERS.match(x)
                if m and x[m.end() :] in ENDINGS:
                    words.append(x)
                    ends.append(m.end())
        if words:
            data = [(" " + x[:e]).encode() for x, e in zip(words, ends, strict=True)]
            whole = map(self.ranks.get, data)  # a match that is a token is that token
            found = [f if w is None else w.to_bytes(4, "little") for f, w in zip(self.side.ids(data, "<u4"), whole, strict=True)]
            known.fill({x: ids + self.pieces[x[e:]] if len(x) > e else ids for x, e, ids in zip(words, ends, found, strict=True)})

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.ranks.get(data)
        ids = [whole] if whole is not None else self._halved(data)
        return array("I", ids).tobytes()

    def _halved(self, data: bytes) -> array:
        """Ids of a piece's bytes."""
        if len(data) <= self.leaf:
            return array("I", merged(data, self.ranks))
        half = len(data) // 2
        return self._bordered(self._halved(data[:half]), self._halved(data[half:]))

    def _bordered(self, x: array, y: array) -> array:
        """Ids of two neighbouring stretches of a piece as those of both together."""
        left, right, of, fits = 1, 1, self.bytes, self.borders.allowed
        while True:
            left, right = min(left, len(x)), min(right, len(y))
            window = merged(b"".join([of[i] for i in [*x[len(x) - left :], *y[:right]]]), self.ranks)
            grow_left = left < len(x) and not fits(of[x[len(x) - left - 1]], of[window[0]])
            grow_right = right < len(y) and not fits(of[window[-1]], of[y[right]])
            if not (grow_left or grow_right):
                return x[: len(x) - left] + array("I", window) + y[right:]
            left, right = left * 2 if grow_left else left, right * 2 if grow_right else right

    def _segment(self, segment: str) -> bytes:
        if len(segment) > self.leaf:
            out = bytearray()
            for m in self.iterate(segment):
                out += self.pieces[m[0]] if len(m[0]) <= self.leaf else self._piece(m[0])
            return bytes(out)
        pieces = self.find(segment)
        return b"".join([self.pieces[p] for p in pieces])

    def closed(self, text: str) -> bytes:
        """Ids of text that begins and ends at a cut (or at an end of the whole text)."""
        first, *rest = text.split(" ")
        try:
            if first and white(first[-1]):
                raise Unclosed(first)
            return self._segment(first) + b"".join(map(self.spaced.__getitem__, rest))
        except Unclosed:
            return b"".join(map(self._segment, segments(text)))

    def _leaf(self, text: str) -> Part:
        a = b = -1
        i = text.find(" ")
        while i >= 0 and (i == 0 or white(text[i - 1])):
            i = text.find(" ", i + 1)
        a = i
        if a < 0:
            return Part(text, None, "")
        i = text.rfind(" ")
        while i > a and white(text[i - 1]):
            i = text.rfind(" ", 0, i)
        b = max(a, i)
        return Part(text[:a], [self.closed(text[a:b])] if b > a else [], text[b:])

    def joined(self, x: Part, y: Part) -> Part:
        window = x.tail + y.head if x.body is not None else x.head + y.head
        # A cut may lie just where the parts meet.
        edge = (x.tail if x.body is not None else x.head)[-1:]
        meets = bool(edge) and not white(edge) and y.head[:1] == " "
        if meets:
            left, right = (x.tail if x.body is not None else x.head), y.head
            if x.body is None:
                return Part(left, [], right) if y.body is None else Part(left, [self.closed(right), *y.body], y.tail)
            return Part(x.head, [*x.body, self.closed(left)], right) if y.body is None else Part(x.head, [*x.body, self.closed(left), self.closed(right), *y.body], y.tail)
        if x.body is None:
            return Part(window, y.body, y.tail)
        return Part(x.head, x.body, window) if y.body is None else Part(x.head, [*x.body, self.closed(window), *y.body], y.tail)

    def part(self, text: str) -> Part:
        if len(text) <= self.leaf:
            return self._leaf(text)
        half = len(text) // 2
        return self.joined(self.part(text[:half]), self.part(text[half:]))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        p = self.part(text)
        if p.body is None:
            return self.closed(p.head)
        return b"".join([self.closed(p.head), *p.body, self.closed(p.tail)])

    def decode(self, ids: bytes) -> bytes:
        n = len(ids) // 4
        if n <= LEAF_IDS:
            return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        half = n // 2 * 4
        return self.decode(ids[:half]) + self.decode(ids[half:])


#: The pattern's alternatives for which a space and letters are one match, and an ending the next (a fixed value).
_LETTERS_FIRST = r" ?\p{L}"


@functools.lru_cache(2)
def _side_by_side(path: str, pattern: str) -> SideBySide | None:
    return _all_merges(ranks_of(path), pattern)


def _all_merges(ranks: dict[bytes, int], pattern: str) -> SideBySide | None:
    """All merges of the ranks as pairs; None if ids or the pattern don't fit it."""
    fits = regex.compile(pattern).findall
    if max(ranks.values()) > 65535 or _LETTERS_FIRST not in pattern or any(fits(f" Wörd{e}") != [" Wörd", *([e] if e else [])] for e in ENDINGS):
        return None
    of = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    get = ranks.get
    merges = []
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = get(token[:i]), get(token[i:])
            if a is not None and b is not None:
                merges.append((a, b, rank, rank))
    return SideBySide(of, of, merges)


_CODECS: dict[tuple, Codec] = {}


def codec(path: str, pattern: str, leaf: int) -> Codec:
    """One for each worker process, so that its memo serves all its tasks."""
    if (path, pattern, leaf) not in _CODECS:
        _CODECS[path, pattern, leaf] = Codec(path, pattern, leaf)
    return _CODECS[path, pattern, leaf]


def _encoder(path: str, pattern: str, leaf: int):
    def run(batches):
        own = codec(path, pattern, leaf)
        for batch in batches:
            ids = []
            for a in range(0, batch.num_rows, BATCH):
                texts = [t or "" for t in batch.column(1).slice(a, BATCH).to_pylist()]
                own.prepare(texts)
                ids += map(own.encode, texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["id", "ids"])

    return run


def encode(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", leaf: int = LEAF_CHARS) -> DataFrame:
    """(id, ids: binary of little-endian unsigned 32-bit ids) per row."""
    docs = docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    return spread(docs).mapInArrow(_encoder(path, pattern, leaf), f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id") -> DataFrame:
    """(id, bytes) per row of encode()."""

    def run(batches):
        own = codec(path, pattern, LEAF_CHARS)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x.as_py() or b"") for x in batch.column(1)], pa.binary())], names=["id", "bytes"])

    rows = encoded.select(F.col(id_col).alias("id"), "ids")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, bytes binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", leaf: int = LEAF_CHARS) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode, decode what came of it, and digest both, in one pass."""

    def run(batches):
        own = codec(path, pattern, leaf)
        for batch in batches:
            n, a, b = [], [], []
            for i in range(0, batch.num_rows, BATCH):
                texts = [t or "" for t in batch.column(1).slice(i, BATCH).to_pylist()]
                own.prepare(texts)
                for text in texts:
                    ids = own.encode(text)
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    b.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    return spread(docs).mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
