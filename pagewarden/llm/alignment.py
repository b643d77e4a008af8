"""Alignment of two tokenizers' tokens: groups between byte offsets at which tokens of both end.

A text is encoded twice, its tokens' ends are byte offsets in the same bytes, and the
groups are found by divide and conquer: an interval of tokens is halved at its middle
token, the first end from there on that the other tokenizer has too is located by bisection
of the other's ends, and both halves go on; of what was passed without a common end
nothing is looked at again, so every end is looked up once. An interval without a common
end inside is a leaf group. The intervals of many texts are halved side by side, a level
at a time.

A link is a pair of tokens that end together. Its pair is one of few that the two
vocabularies allow, for the bytes of one token then end with those of the other: a table
of all such pairs is made from the vocabularies alone, so its size is bounded by
these, whatever the texts are. Links are kept as places in that table; their corpus-wide counts
are one number a place, summed by Spark, and small enough to be sent to all tasks.

Defined cases: a null or empty text, and a text whose bytes a tokenizer changes (white space or
letters that it normalizes), has no tokens, groups or links; repeated rows and null ids are rows of
their own; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.llm.bpe_tree import Codec
from pagewarden.llm.common import Scratch, pieces, spread, table
from pagewarden.llm.token_count import PATTERN, byte_letters

BATCH_CHARS = 1_000_000
#: Texts with a match of the splitting pattern that may be longer go to bpe_tree, which takes n log n for it.
LONG_MATCH = 2000
_BLANKS = re.compile(r"\s\s++")
SPACE = "▁"


def byte_vocabulary(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level BPE file, without its added tokens, whose strings are plain text."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    kind, letters = held["pre_tokenizer"], byte_letters()
    if held["model"]["type"] != "BPE" or held["normalizer"] or kind["type"] != "ByteLevel" or kind["add_prefix_space"] or not kind["use_regex"]:
        raise ValueError("a byte-level BPE tokenizer without a normalizer is needed")
    added = {t["id"] for t in held["added_tokens"]}
    of = {i: bytes(letters[c] for c in s) for s, i in held["model"]["vocab"].items() if i not in added}
    for i, pair in enumerate(held["model"]["merges"]):
        if of[256 + i] != bytes(letters[c] for c in "".join(pair if isinstance(pair, list) else pair.split(" "))):
            raise ValueError("ids must follow the merges")
    return [of[i] for i in range(len(of))]


def piece_vocabulary(model) -> list[bytes]:
    """Bytes of each id of a sentence-piece model; control pieces have none."""
    none = lambda i: model.is_control(i) or model.is_unknown(i)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(n[3:5], 16)]) if model.is_byte(i) else b"" if none(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)]


@dataclass
class Aligned:
    """Tokens of both in a row of texts, and the groups: group g ends with token cut_a[g] and cut_b[g]."""

    a: np.ndarray
    b: np.ndarray
    from_a: np.ndarray  # tokens [from_a[i], from_a[i + 1]) are text i's
    from_b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray

    def groups_of(self) -> np.ndarray:
        """Groups [i] to [i + 1) are text i's."""
        return np.searchsorted(self.cut_a, self.from_a)


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ends_a and ends_b of equal ends, found in intervals [first, last) of ends_a."""
    cuts_a, cuts_b = [], []
    live = first < last
    low, high = first[live], last[live]
    while len(low):
        middle = (low + high) // 2
        found, other = _first_common(ends_a, ends_b, middle, high)
        hit = found < high
        cuts_a.append(found[hit])
        cuts_b.append(other[hit])
        # Ends from the middle to the one found aren't common, or are cuts now. Intervals stay in order.
        low, high = np.stack([low, found + 1], axis=1).ravel(), np.stack([middle, high], axis=1).ravel()
        live = low < high
        low, high = low[live], high[live]
    if not cuts_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(cuts_a), np.concatenate(cuts_b)
    order = np.argsort(a)
    return a[order], b[order]


def _first_common(ends_a: np.ndarray, ends_b: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each interval of ends_a its first place whose end is in ends_b, and the place there; stop if there is none. Looks at 1, 2, 4 and so on at a time."""
    near = np.searchsorted(ends_b, ends_a[start])
    hit = ends_b[np.minimum(near, len(ends_b) - 1)] == ends_a[start]
    found, other, step = np.where(hit, start, stop), np.where(hit, near, 0), 2
    live = np.flatnonzero(~hit & (start + 1 < stop))
    at = start[live] + 1
    while len(live):
        size = np.minimum(step, stop[live] - at)
        before = np.cumsum(size) - size
        place = np.arange(int(size.sum())) + np.repeat(at - before, size)
        near = np.searchsorted(ends_b, ends_a[place])
        hit = ends_b[np.minimum(near, len(ends_b) - 1)] == ends_a[place]
        best = np.minimum.reduceat(np.where(hit, np.arange(len(place)), len(place)), before)
        got = best < len(place)
        found[live[got]], other[live[got]] = place[best[got]], near[best[got]]
        more = ~got & (at + size < stop[live])
        live, at, step = live[more], (at + size)[more], step * 2
    return found, other


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken

        self.bytes_a = byte_vocabulary(path_a)
        ranks = {t: i for i, t in enumerate(self.bytes_a)}
        self.encoding, self.codec = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), Codec(path_a, PATTERN, ranks=ranks)
        self.model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = piece_vocabulary(self.model)
        self.size_a, self.size_b = (np.array([len(t) for t in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        self.pairs = allowed_pairs(self.bytes_a, self.bytes_b)
        # Names of tokens with what follows them: a comma within a group's side, the border of the sides, of groups.
        self.names_a = np.array([f"{i}{x}" for x in ",|" for i in range(len(self.bytes_a))], object)
        self.names_b = np.array([f"{i}{x}" for x in ",;" for i in range(len(self.bytes_b))], object)

    def encode(self, text: str) -> np.ndarray:
        """Ids of A: ids follow the merges, so that they are ranks, too."""
        if len(text) > LONG_MATCH and (max(map(len, text.split(" "))) >= LONG_MATCH or any(len(m) >= LONG_MATCH for m in _BLANKS.findall(text))):
            return np.frombuffer(self.codec.encode(text), "<u4")
        return self.encoding.encode_to_numpy(text, disallowed_special=())

    def align(self, texts: list[str]) -> Aligned:
        lead = [" " + t if t else "" for t in texts]
        a, b, none = [], [], np.zeros(0, np.uint32)
        for text, own, pieces_ in zip(texts, lead, self.model.encode(texts, num_threads=1), strict=True):
            x, y = (self.encode(own), pieces_) if text else (none, [])
            if b"".join(map(self.bytes_b.__getitem__, y)) != own.encode():  # those of A are the text's in any case
                x, y = none, []
            a.append(x)
            b.append(np.array(y, np.uint32))
        from_a, from_b = (np.cumsum([0, *map(len, x)]) for x in (a, b))
        a, b = (np.concatenate([np.zeros(0, np.uint32), *x]) for x in (a, b))
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        # The last tokens of a text end together; the others are looked for.
        full = np.flatnonzero(np.diff(from_a))
        cut_a, cut_b = common_ends(ends_a, ends_b, from_a[full], from_a[full + 1] - 1)
        cut_a = np.concatenate([cut_a, from_a[full + 1] - 1])
        order = np.argsort(cut_a)
        cut_b = np.concatenate([cut_b, from_b[full + 1] - 1])
        return Aligned(a, b, from_a, from_b, cut_a[order], cut_b[order])

    def texts_of(self, x: Aligned) -> list[str]:
        """The groups of each text as a1,a2|b1;a3|b2,b3."""
        n_a, n_b = len(self.bytes_a), len(self.bytes_b)
        start_a, start_b = np.concatenate([[0], x.cut_a + 1]), np.concatenate([[0], x.cut_b + 1])
        name_a, name_b = x.a.astype(np.int64), x.b.astype(np.int64)
        name_a[x.cut_a] += n_a
        name_b[x.cut_b] += n_b
        # A token's place: all tokens of its side before it, and those of the other side before its group, or up to its end.
        out = np.empty(len(x.a) + len(x.b), object)
        size_a, size_b = np.diff(start_a), np.diff(start_b)
        out[np.arange(len(x.a)) + np.repeat(start_b[:-1], size_a)] = self.names_a[name_a]
        out[np.arange(len(x.b)) + np.repeat(start_a[1:], size_b)] = self.names_b[name_b]
        at = (x.from_a + x.from_b).tolist()
        return ["".join(out[i:j].tolist())[:-1] for i, j in zip(at, at[1:], strict=False)]

    def places(self, x: Aligned) -> np.ndarray:
        """The place of each link in the table of pairs."""
        return np.searchsorted(self.pairs, x.a[x.cut_a].astype(np.int64) << 32 | x.b[x.cut_b].astype(np.int64))


def allowed_pairs(of_a: list[bytes], of_b: list[bytes]) -> np.ndarray:
    """All pairs of ids, as a << 32 | b in ascending order, of which the bytes of one end with those of the other."""
    places: dict[bytes, list[int]] = {}
    for i, t in enumerate(of_b):
        if t:
            places.setdefault(t, []).append(i)
    own: dict[bytes, list[int]] = {}
    for i, t in enumerate(of_a):
        own.setdefault(t, []).append(i)
    out = {i << 32 | j for i, t in enumerate(of_a) for k in range(len(t)) for j in places.get(t[k:], ())}
    out |= {i << 32 | j for j, t in enumerate(of_b) for k in range(1, len(t)) for i in own.get(t[k:], ())}
    return np.array(sorted(out), np.int64)


@functools.lru_cache(2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker process."""
    return Aligner(path_a, path_b)


def _texts(batches):
    """(ids, texts) of parts of about BATCH_CHARS."""
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for i, j in pieces(len(texts), [len(t) for t in texts], BATCH_CHARS):
            yield batch.column(0).slice(i, j - i), texts[i:j]


def _rows(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"))
    return spread(rows), rows.schema["id"].dataType.simpleString()


def groups(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id") -> DataFrame:
    """(id, a, b: ids of both, groups: numbers of tokens of a and of b up to the end of each group) per row."""
    rows, kind = _rows(docs, id_col)

    def run(batches):
        own = aligner(path_a, path_b)
        for ids, texts in _texts(batches):
            x = own.align(texts)
            g = x.groups_of()
            size = np.diff(g)
            parts = [pa.array(cut + 1 - np.repeat(at[:-1], size), pa.int32()) for cut, at in ((x.cut_a, x.from_a), (x.cut_b, x.from_b))]
            ends = pa.StructArray.from_arrays(parts, names=["a_end", "b_end"])
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), v) for at, v in ((x.from_a, pa.array(x.a, pa.int32())), (x.from_b, pa.array(x.b, pa.int32())), (g, ends))]
            yield pa.RecordBatch.from_arrays([ids, *lists], names=["id", "a", "b", "groups"])

    return rows.mapInArrow(run, f"id {kind}, a array<int>, b array<int>, groups array<struct<a_end: int, b_end: int>>").withColumnRenamed("id", id_col)


def links(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id") -> DataFrame:
    """(id, n_a, n_b, n_groups, groups_sha256, links: places in the table of pairs as unsigned 32-bit integers) per row."""
    rows, kind = _rows(docs, id_col)

    def run(batches):
        own = aligner(path_a, path_b)
        for ids, texts in _texts(batches):
            x = own.align(texts)
            g, places = x.groups_of(), own.places(x).astype("<u4")
            sha = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in own.texts_of(x)]
            each = [places[i:j].tobytes() for i, j in zip(g.tolist(), g.tolist()[1:], strict=False)]
            numbers = [pa.array(np.diff(n), pa.int64()) for n in (x.from_a, x.from_b, g)]
            yield pa.RecordBatch.from_arrays([ids, *numbers, pa.array(sha, pa.string()), pa.array(each, pa.binary())], names=["id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    return rows.mapInArrow(run, f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links binary").withColumnRenamed("id", id_col)


def pair_counts(linked: DataFrame) -> DataFrame:
    """(place, n): how many links hold each pair of the table."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0):
                more = np.bincount(np.frombuffer(x.as_py(), "<u4"))
                if len(more) > len(total):
                    total = np.concatenate([total, np.zeros(len(more) - len(total), np.int64)])
                total[: len(more)] += more
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["place", "n"])

    return linked.select("links").mapInArrow(run, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n"))


def scored(linked: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id") -> DataFrame:
    """links() with n_links, n_best and count_sum in place of the links."""
    spark = linked.sparkSession
    pairs = aligner(path_a, path_b).pairs
    counts = np.zeros(len(pairs), np.int64)
    got = pair_counts(linked).toArrow()  # a row for each pair of the table at most
    counts[got.column("place").to_numpy()] = got.column("n").to_numpy()
    b = (pairs & 0xFFFFFFFF).astype(np.int64)
    most = np.zeros(int(b.max(initial=0)) + 1, np.int64)
    np.maximum.at(most, b, counts)
    sent = spark.sparkContext.broadcast((counts, counts == most[b]))
    rest = [c for c in linked.columns if c != "links"]

    def run(batches):
        n, best = sent.value
        for batch in batches:
            each = [np.frombuffer(x.as_py(), "<u4") for x in batch.column("links")]
            columns = [pa.array(v, pa.int64()) for v in ([len(x) for x in each], [int(best[x].sum()) for x in each], [int(n[x].sum()) for x in each])]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], *columns], names=[*rest, "n_links", "n_best", "count_sum"])

    kinds = ", ".join(f"`{c}` {linked.schema[c].dataType.simpleString()}" for c in rest)
    return linked.mapInArrow(run, f"{kinds}, n_links bigint, n_best bigint, count_sum bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    linked = Scratch(spark)(links(table(spark, sf_dir, "documents"), a, b), "links")
    return scored(linked, a, b)
