"""Token counts by finite-state transducers.

The merges of a byte-pair tokenizer are compiled into a deterministic transducer over
bytes. Its state after some bytes of a piece holds, for every place where a token
still under way could have begun, the trie node reached from there, the last token
before that place, and how many tokens fewer there were. Reading a byte ends
exactly one token that the pair rule allows: the tokens of a text are those of which
every token encodes to itself and every neighbouring pair encodes to itself. The
transition carries the change of the token count. States and transitions are compiled
when first reached and shared by all texts of a worker; if there are more than
bpe.MOST_STATES the tables start anew.

A text is read in chunks that end at a cut (see bpe.Segments) if there is one: there every
state is the first one again, so the map of such a chunk is a constant, its count, and
maps compose by adding. A piece that is longer than a chunk (a text without blanks may be
one piece) has chunks that end anywhere. Map is what such a chunk makes of the state before
it: the state after it and the tokens added. It holds the run from the first state and, of
its first MEET bytes, the states passed through; another state is read until it meets one of
these, as states soon depend on the last bytes only (or to the chunk's end, if it meets none).
A map has a fixed size however long the text is. Maps compose, and a parallel prefix scan by
doubling gives the map, hence the count, up to each chunk's end.

Special strings count as one token each, as the tokenizers library does by default.
Null text is empty text: no tokens. Repeated rows and null ids are rows of their own, an empty
table gives no rows, other columns are not read, whatever their names.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.llm.bpe import Memo, Segments, Transducer, Unclosed, segments, white
from pagewarden.llm.common import spread, table

CHUNK_CHARS, MEET = 32_768, 64
LIMIT = 1024
#: The splitting pattern that a ByteLevel pre-tokenizer has (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(slots=True)
class Map:
    """What the chunks [first, last) of a piece make of the state before them."""

    first: int
    last: int
    passed: list[tuple]  # state and count after each of the first MEET bytes, from the first state on
    out: tuple  # the state after it, from the first state on
    n: int  # the tokens added


class Counter:
    def __init__(self, path: str, chunk: int = CHUNK_CHARS):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        kind = held["pre_tokenizer"]
        if held["model"]["type"] != "BPE" or held["normalizer"] or kind["type"] != "ByteLevel" or kind["add_prefix_space"] or not kind["use_regex"]:
            raise ValueError("a byte-level BPE tokenizer without a normalizer is needed")
        letters = byte_letters()
        of = lambda s: bytes(letters[c] for c in s)
        ranks = {bytes([b]): b - 256 for b in range(256)}
        for i, pair in enumerate(held["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            ranks.setdefault(of(a) + of(b), i)
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(held["added_tokens"], key=lambda t: -len(t["content"]))) or r"(?!)")
        self.transducer, self.chunk = Transducer(ranks), chunk
        self.find, self.iterate = regex.compile(PATTERN).findall, regex.compile(PATTERN).finditer
        self.pieces = Memo(lambda p: self.transducer.count(p.encode()), 200_000)
        self.spaced = Segments(self._segment)

    def _piece(self, piece: str) -> int:
        if len(piece) > self.chunk:
            chunks = [piece[i : i + self.chunk] for i in range(0, len(piece), self.chunk)]
            return self.scan([self.map(chunks, i) for i in range(len(chunks))], chunks)[-1].n
        return self.pieces[piece]

    def _segment(self, segment: str) -> int:
        if len(segment) > self.chunk:
            return sum(self._piece(m[0]) for m in self.iterate(segment))
        return sum([self.pieces[p] for p in self.find(segment)])

    def closed(self, text: str) -> int:
        """Tokens of text from one cut to another."""
        first, *rest = text.split(" ")
        try:
            if first and white(first[-1]):
                raise Unclosed(first)
            return self._segment(first) + sum(map(self.spaced.__getitem__, rest))
        except Unclosed:
            return sum(map(self._segment, segments(text)))

    def map(self, chunks: list[str], i: int) -> Map:
        t, passed = self.transducer, []

        def watch(_, key, n):
            passed.append((key, n))
            return len(passed) == MEET

        data = chunks[i].encode()
        state, n = t.run(t.start, data[:MEET], watch)
        out, more = t.run(state, data[MEET:])
        return Map(i, i + 1, passed, out, n + more)

    def after(self, m: Map, state: tuple, chunks: list[str]) -> tuple[tuple, int]:
        """What a map makes of any state: the state after it, and the tokens added."""
        t, met = self.transducer, []
        if state[0] == t.start[0]:
            return m.out, m.n

        def watch(i, key, n):
            if key == m.passed[i][0]:
                met.append(n - m.passed[i][1])
            return bool(met)

        data = chunks[m.first].encode()
        at, n = t.run(state, data[: len(m.passed)], watch)
        if met:
            return m.out, m.n + met[0]
        at, more = t.run(at, data[len(m.passed) :])  # it met none: to the end of the first chunk, and on
        n += more
        for i in range(m.first + 1, m.last):
            at, more = self.after(self.map(chunks, i), at, chunks)
            n += more
        return at, n

    def then(self, x: Map, y: Map, chunks: list[str]) -> Map:
        out, n = self.after(y, x.out, chunks)
        return Map(x.first, y.last, x.passed, out, x.n + n)

    def scan(self, maps: list[Map], chunks: list[str]) -> list[Map]:
        """Inclusive prefix scan: the map of each chunk composed with all before it, pairs first."""
        if len(maps) < 2:
            return maps
        pairs = self.scan([self.then(maps[i], maps[i + 1], chunks) for i in range(0, len(maps) - 1, 2)], chunks)
        out = [maps[0]]
        for i in range(1, len(maps)):
            out.append(pairs[i // 2] if i % 2 else self.then(pairs[i // 2 - 1], maps[i], chunks))
        return out

    def plain(self, text: str) -> int:
        n, at = 0, 0
        while len(text) - at > self.chunk:
            end = _cut(text, at + self.chunk)
            n += self.closed(text[at:end])
            at = end
        return n + self.closed(text[at:] if at else text)

    def count(self, text: str) -> int:
        n, at = 0, 0
        for m in self.special.finditer(text):
            n += self.plain(text[at : m.start()]) + 1
            at = m.end()
        return n + self.plain(text[at:])


def _cut(text: str, at: int) -> int:
    """The first cut of text from a place on, or its end."""
    i = text.find(" ", at)
    while i > 0 and white(text[i - 1]):
        i = text.find(" ", i + 1)
    return i if i > 0 else len(text)


_COUNTERS: dict[tuple, Counter] = {}


def counter(path: str, chunk: int = CHUNK_CHARS) -> Counter:
    """One for each worker process: its transducer and memo serve all its tasks."""
    if (path, chunk) not in _COUNTERS:
        _COUNTERS[path, chunk] = Counter(path, chunk)
    return _COUNTERS[path, chunk]


def count_tokens(docs: DataFrame, path: str, *, id_col: str = "doc_id", limit: int = LIMIT, chunk: int = CHUNK_CHARS) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per row."""

    def run(batches):
        own = counter(path, chunk)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [own.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["id", "n_bytes", "n_tokens", "over_limit"])

    docs = docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    return spread(docs).mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
