"""Token ids in files of range-coded blocks.

Ids are cut into segments, and these into blocks of BLOCK ids. A segment has its model's tables in front, counted over all of
its own ids (one that a long document makes larger is several parts, each with its tables); each block is coded on its own by
them, and has its number of ids, of words, and a checksum. The next id is predicted by

- order 2 and order 1: the id that most often follows the two ids (by hash), or the one id, before, with a confidence by how
  often it does;
- order 0: frequencies of the ids that neither of the two predicts, each id with its own.

Counts under the confidences of order 2 and of order 1 are mixed with those under both: the mixture says how likely either
prediction holds, or none, in which case order 0 shares out what is left. A range coder with carries takes the product of both as one
range. All is integer arithmetic. Many blocks are coded side by side, an id of each at a time, in numpy.

Files: documents are dealt by ranges of their id, sorted, encoded and appended with the
end id; a row of the table holds a segment: its place, ids and lengths of its documents,
and its tables and blocks. Starts follow from the totals of the parts and running sums within them.
Null text is empty text (the end id alone). Rows with equal ids follow each other by text, those
without an id come first. An empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewarden.llm.bpe import ENDINGS, LETTERS, NO_PAIR, SideBySide
from pagewarden.llm.common import pieces, shared_dir, table
from pagewarden.llm.token_count import byte_letters

BLOCK, LANES, SEGMENT, END = 1024, 4096, 4_000_000, 1
#: Bits of a range: of the mixed counts, and of order 0.
FLAG_BITS, ID_BITS = 10, 20
BITS, SURE = np.uint64(FLAG_BITS + ID_BITS), 8
SHARES = [8, 16, 29, 42, 54, 61]  # in 64: bounds of confidences
BOTTOM, WORD = np.uint64(1 << 32), np.uint64(32)
HEAD = struct.Struct("<III")
ZERO = np.uint64(0)


def _best(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted keys context << 16 | id: each context, its most frequent id (the last of equal ones), how often that is, and how often the context is."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    count = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    context = keys >> keys.dtype.type(16)
    begin = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    top = np.maximum.reduceat(count.astype(np.uint64) << np.uint64(16) | (keys & keys.dtype.type(0xFFFF)), begin)
    return context[begin].astype(np.int64), (top & np.uint64(0xFFFF)).astype(np.uint32), (top >> np.uint64(16)).astype(np.int64), np.add.reduceat(count, begin)


class Model:
    """Predictions of ids: entries are an id, and its confidence (1 to SURE - 1, 0: none) above its 16 bits."""

    def __init__(self, most: int = 0xFFFF, slots: int = 8):
        self.most, self.slots = most, slots  # the greatest id; bits of a slot of order 2
        self.one, self.two = np.zeros(1 << 16, np.uint32), np.zeros(1 << slots, np.uint32)
        self.mixed = np.zeros((SURE * SURE, 2), np.uint32)  # by confidences: what is left to order 2, and to order 1
        self.listed, self.extra = np.zeros(0, np.uint16), np.zeros(0, np.uint32)
        self._ready()

    def _ready(self) -> None:
        """Ranges of order 0: what the listed ids leave is shared out equally."""
        n = self.most + 1
        free = (1 << ID_BITS) - int(self.extra.sum(dtype=np.int64))
        size = np.full(n, free // n, np.int64)
        size[: free % n] += 1
        size[self.listed] += self.extra
        self.size, self.start = size.astype(np.uint64), (np.cumsum(size) - size).astype(np.uint64)
        self.id_at: np.ndarray | None = None
        up = np.uint64(ID_BITS)
        self.second = self.mixed[:, 0].astype(np.uint64)
        self.third = self.second + self.mixed[:, 1]
        self.left = (1 << FLAG_BITS) - self.third
        self.second, self.third = self.second << up, self.third << up

    @classmethod
    def of(cls, ids: np.ndarray, most: int) -> Model:
        """Counted over ids; the greatest id to be coded."""
        if len(ids) < 3:
            return cls(most)
        m = cls(most, min(max(len(ids).bit_length() - 4, 8), 18))
        before, last, ids = ids[:-2], ids[1:-1], ids[2:]
        for entries, context, fewest in ((m.one, last, 3), (m.two, m.slot(last, before), 4)):
            # Keys of order 1 fit into 32 bits, which sort faster. Order 2 counts where order 1 isn't sure.
            some = slice(None) if entries is m.one else np.flatnonzero(m.one[last] >> 16 < SURE - 1)
            keys = context[some].astype(np.uint32 if entries is m.one else np.uint64)
            if not len(keys):
                continue
            keys <<= keys.dtype.type(16)
            keys |= ids[some]
            keys.sort()
            at, best, hits, all_ = _best(keys)
            sure = np.searchsorted(SHARES, hits * 64 // all_, side="right") + 1
            kept = (hits >= fewest) & (hits * 16 >= all_)
            entries[at[kept]] = best[kept] | sure[kept].astype(np.uint32) << 16
        counts, missed = np.zeros(SURE * SURE * 3, np.int64), np.zeros(most + 1, np.int64)
        for a in range(0, len(ids), 1 << 18):
            x = ids[a : a + (1 << 18)]
            two, one, c = m.predict(last[a : a + len(x)], before[a : a + len(x)])
            flag = np.where((two == x) & (c >= SURE), 0, np.where((one == x) & (c % SURE > 0), 1, 2))
            counts += np.bincount(c * 3 + flag, minlength=len(counts))
            missed += np.bincount(x[flag == 2], minlength=most + 1)
        m.mixed = _mix(counts.reshape(SURE, SURE, 3))
        m._list(missed)
        m._ready()
        return m

    def _list(self, counts: np.ndarray) -> None:
        """Gives a frequency of their own to ids that save more than the room of their row (48 bits)."""
        n, total = int(counts.sum()), 1 << ID_BITS
        if not n:
            return
        share = counts / n
        worth = counts * np.log2(np.maximum(share * (self.most + 1), 1)) > 64
        rest = max(n - int(counts[worth].sum()), 1) / n
        # Each id keeps a share of what is left, of one at least.
        free = min(max(int(total * rest), 2 * (self.most + 1)), total)
        self.listed = np.flatnonzero(worth).astype(np.uint16)
        of = counts[worth]
        self.extra = (of * (total - free) // max(int(of.sum()), 1)).astype(np.uint32)

    @staticmethod
    def slot_of(last: np.ndarray, before: np.ndarray, bits: int) -> np.ndarray:
        return ((last * np.uint32(0x85EBCA6B)) ^ (before * np.uint32(0xC2B2AE35))) >> np.uint32(32 - bits)

    def slot(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        return self.slot_of(last, before, self.slots)

    def predict(self, last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What order 2 and order 1 say, and the row of the mixture."""
        two, one = self.two.take(self.slot(last, before)), self.one.take(last)
        c = (two >> np.uint32(16)) * np.uint32(SURE) + (one >> np.uint32(16))
        return two & np.uint32(0xFFFF), one & np.uint32(0xFFFF), c

    def ranges(self, ids: np.ndarray, last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of ids' ranges."""
        two, one, c = self.predict(last, before)
        second, third, left = self.second.take(c), self.third.take(c), self.left.take(c)
        by_two, by_one = (ids == two) & (second > 0), (ids == one) & (third > second)
        start = np.where(by_two, ZERO, np.where(by_one, second, third + self.start.take(ids) * left))
        size = np.where(by_two, second, np.where(by_one, third - second, self.size.take(ids) * left))
        return start, size

    def found(self, value: np.ndarray, last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids whose ranges hold value; start and size of these."""
        two, one, c = self.predict(last, before)
        second, third, left = self.second.take(c), self.third.take(c), self.left.take(c)
        if self.id_at is None:
            self.id_at = np.repeat(np.arange(self.most + 1, dtype=np.uint32), self.size.astype(np.int64))
        rest = np.maximum(value, third) - third
        ids = self.id_at.take((rest // left).view(np.int64), mode="clip")
        by_two, by_one = value < second, value < third
        start = np.where(by_two, ZERO, np.where(by_one, second, third + self.start.take(ids) * left))
        size = np.where(by_two, second, np.where(by_one, third - second, self.size.take(ids) * left))
        return np.where(by_two, two, np.where(by_one, one, ids)), start, size

    def packed(self) -> bytes:
        parts = [struct.pack("<II", self.most, self.slots), self.mixed.astype("<u2").tobytes()]
        for entries in (self.one, self.two):
            at = np.flatnonzero(entries)
            parts += [struct.pack("<I", len(at)), np.diff(at, prepend=0).astype("<u2" if entries is self.one else "<u4").tobytes(), entries[at].astype("<u2").tobytes(), (entries[at] >> 16).astype("u1").tobytes()]
        return b"".join([*parts, struct.pack("<I", len(self.listed)), self.listed.astype("<u2").tobytes(), self.extra.astype("<u4").tobytes()])

    @classmethod
    def unpacked(cls, data: bytes) -> Model:
        m, at = cls(*struct.unpack_from("<II", data)), 8

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, n, at)
            at += found.nbytes
            return found

        m.mixed = take("<u2", SURE * SURE * 2).reshape(-1, 2).astype(np.uint32)
        for entries, kind in ((m.one, "<u2"), (m.two, "<u4")):
            n = int(take("<u4", 1)[0])
            rows = np.cumsum(take(kind, n), dtype=np.int64)
            entries[rows] = take("<u2", n).astype(np.uint32)
            entries[rows] |= take("u1", n).astype(np.uint32) << 16
        n = int(take("<u4", 1)[0])
        m.listed, m.extra = take("<u2", n), take("<u4", n).astype(np.uint32)
        m._ready()
        return m


def _mix(counts: np.ndarray) -> np.ndarray:
    """Shares of both predictions: counts by both confidences, with those by either of them as 16 more counts each."""
    mixed = counts << 12
    for axis in (0, 1):
        some = counts[1:].sum(axis=0, keepdims=True) if axis == 0 else counts[:, 1:].sum(axis=1, keepdims=True)
        mixed = mixed + (some << 16) // np.maximum(some.sum(axis=2, keepdims=True), 1)
    mixed[0, :, 0], mixed[:, 0, 1] = 0, 0  # no prediction, no share
    room = (1 << FLAG_BITS) - 3
    out = mixed[:, :, :2] * room // np.maximum(mixed.sum(axis=2, keepdims=True), 1) + 1
    out[0, :, 0], out[:, 0, 1] = 0, 0
    return out.reshape(SURE * SURE, 2).astype(np.uint32)


def _matrix(blocks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lanes of blocks, the longest first: their order, sizes, and ids by steps, after two rows of zeros."""
    sizes = np.array([len(b) for b in blocks], np.int64)
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    ids = np.zeros((int(sizes.max(initial=0)) + 2, len(blocks)), np.uint32)
    for lane, i in enumerate(order.tolist()):
        ids[2 : 2 + sizes[lane], lane] = blocks[i]
    return order, sizes, ids


def encode_blocks(blocks: list[np.ndarray], model: Model | None = None) -> list[bytes]:
    """Payloads of blocks of ids under 65536, coded side by side."""
    model = model or Model()
    order, sizes, ids = _matrix(blocks)
    n, most = len(blocks), len(ids) - 2
    low, span = np.zeros(n, np.uint64), np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
    width = most + 2  # a range has 30 bits at most, so that a step writes one word of 32 at most
    out, at = np.zeros(n * width, np.uint32), np.arange(n) * width
    begin = at.copy()
    ahead = max(1, (1 << 16) // max(n, 1))  # steps whose ranges are looked up at once
    for t in range(most):
        k = int(np.searchsorted(-sizes, -t, side="left"))  # lanes longer than t
        if t % ahead == 0:
            starts, widths = model.ranges(ids[t + 2 : t + 2 + ahead], ids[t + 1 : t + 1 + ahead][: most - t], ids[t : t + ahead][: most - t])
        lo, r = low[:k], span[:k]
        r >>= BITS
        more = starts[t % ahead, :k] * r
        lo += more
        r *= widths[t % ahead, :k]
        carry = np.flatnonzero(lo < more)
        if len(carry):
            where = at[carry] - 1
            out[where] += np.uint32(1)
            while len(where := where[out[where] == 0]):
                where -= 1
                out[where] += np.uint32(1)
        full = np.flatnonzero(r < BOTTOM)
        if len(full):
            where = at[full]
            out[where] = lo[full] >> WORD
            at[full] = where + 1
            lo[full] <<= WORD
            r[full] <<= WORD
    for part in (low >> WORD, low & (BOTTOM - np.uint64(1))):
        out[at] = part
        at += 1
    found: list[bytes] = [b""] * n
    for lane, i in enumerate(order.tolist()):
        found[i] = out[begin[lane] : at[lane]].astype("<u4").tobytes()
    return found


def decode_blocks(payloads: list[bytes], lengths: list[int], model: Model | None = None) -> list[np.ndarray]:
    model = model or Model()
    sizes = np.array(lengths, np.int64)
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    n, most = len(payloads), int(sizes.max(initial=0))
    data = np.frombuffer(b"".join([payloads[i] for i in order.tolist()]) + bytes(8), "<u4").astype(np.uint64)
    words = np.array([len(payloads[i]) // 4 for i in order.tolist()], np.int64)
    at = np.cumsum(words) - words
    # How far the code is above the range's low end is all that is needed of both.
    code, span = data[at] << WORD | data[at + 1], np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
    at += 2
    ids = np.zeros((most + 2, n), np.uint32)
    for t in range(most):
        k = int(np.searchsorted(-sizes, -t, side="left"))
        above, r = code[:k], span[:k]
        r >>= BITS
        x, start, size = model.found(above // r, ids[t + 1, :k], ids[t, :k])
        ids[t + 2, :k] = x
        above -= start * r
        r *= size
        full = np.flatnonzero(r < BOTTOM)
        if len(full):
            where = at[full]
            above[full] = above[full] << WORD | data.take(where, mode="clip")
            r[full] <<= WORD
            at[full] = where + 1
    back = np.ascontiguousarray(ids[2:].T)
    found: list[np.ndarray] = [np.zeros(0, np.uint32)] * n
    for lane, i in enumerate(order.tolist()):
        found[i] = back[lane, : sizes[lane]]
    return found


def _packed(ids: np.ndarray, later: int) -> bytes:
    """A part as tables and checksummed blocks; later: how many parts of the segment follow, which the checksum holds."""
    model = Model.of(ids, int(ids.max(initial=0)))
    cut = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
    coded: list[bytes] = []
    for i in range(0, len(cut), LANES):
        coded += encode_blocks(cut[i : i + LANES], model)
    places = np.array([[len(b), len(c), zlib.crc32(b.astype("<u4").tobytes())] for b, c in zip(cut, coded, strict=True)], "<u4").reshape(-1, 3).tobytes()
    tables = model.packed()
    return b"".join([HEAD.pack(len(cut), len(tables), zlib.crc32(tables, zlib.crc32(places, later))), places, tables, *coded])


def pack(segments: list[np.ndarray]) -> list[bytes]:
    """Each segment's ids as parts of 2 * SEGMENT ids at most, of about one size; few are larger than one part."""
    out = []
    for ids in segments:
        parts = np.array_split(ids, max(-(-len(ids) // (2 * SEGMENT)), 1))
        out.append(b"".join([_packed(x, later) for later, x in zip(range(len(parts) - 1, -1, -1), parts, strict=True)]))
    return out


def unpack(packed: list[bytes]) -> list[np.ndarray]:
    """The ids of each segment; tables or a block whose checksum doesn't hold, or a part that is missing, are an error."""
    out = []
    for p in packed:
        heads, at = [], 0  # of each part: where it begins, its tables, and its blocks
        while at < len(p) or not heads:
            if len(p) < at + HEAD.size:
                raise ValueError("a segment ends within a part")
            n, size, crc = HEAD.unpack_from(p, at)
            places = np.frombuffer(p, "<u4", 3 * n, at + HEAD.size).reshape(n, 3)
            begin = at + HEAD.size + 12 * n
            heads.append((at, begin, size, crc, places))
            at = begin + size + int(places[:, 1].sum(dtype=np.int64))
        blocks: list[np.ndarray] = []
        for later, (at, begin, size, crc, places) in zip(range(len(heads) - 1, -1, -1), heads, strict=True):
            tables, own = p[begin : begin + size], len(blocks)
            if zlib.crc32(tables, zlib.crc32(p[at + HEAD.size : begin], later)) != crc:
                raise ValueError("the checksum of a segment's tables doesn't hold")
            model = Model.unpacked(tables)
            ends = np.cumsum(places[:, 1], dtype=np.int64) + begin + size
            payloads = [p[e - k : e] for e, k in zip(ends.tolist(), places[:, 1].tolist(), strict=True)]
            for i in range(0, len(payloads), LANES):
                blocks += decode_blocks(payloads[i : i + LANES], places[i : i + LANES, 0].tolist(), model)
            for b, crc in zip(blocks[own:], places[:, 2].tolist(), strict=True):
                if zlib.crc32(b.astype("<u4").tobytes()) != crc:
                    raise ValueError("a block's checksum doesn't hold")
        out.append(np.concatenate(blocks) if blocks else np.zeros(0, np.uint32))
    return out


#: What the file's normalizer and pre-tokenizer must be for texts to be cut at blanks (fixed values).
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: What endings consist of, and letters: to strip either from words.
_MARKS = "".join(sorted({c for e in ENDINGS for c in e}))
_LETTERS = "".join(c for c in map(chr, range(256)) if LETTERS.fullmatch(c))
#: Bytes of text that are cut into words at once.
PIECE = 8_000_000


def _gathered(values: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lists that follow each other in values: those at the places at, one after the other, and their sizes."""
    own = sizes[at]
    ends = np.cumsum(own)
    return values[np.repeat((np.cumsum(sizes) - sizes)[at] - ends + own, own) + np.arange(own.sum())], own


class Columns(SideBySide):
    """Merges of words that are the columns of a matrix, which shrink by links between the places that are left."""

    def __init__(self, plain: np.ndarray, last: np.ndarray, merges: list[tuple[int, int, int, int]]):
        super().__init__(plain, last, merges)
        self.made = np.zeros(1 + max(r for _, _, r, _ in merges), np.int64)
        self.made[[r for _, _, r, _ in merges]] = [made for _, _, _, made in merges]

    def merged(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words of under 64 bytes, none of them empty, one word after the other in an order of their own; how many each has; places of the words in that order."""
        words = words.cast(pa.large_binary())
        if not len(words):
            return np.zeros(0, "<u2"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        begin = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
        data, size = np.frombuffer(words.buffers()[2], np.uint8), np.diff(begin)
        order = np.argsort(size, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        found = [self._columns(data, begin[:-1][rows], size[rows]) for rows in (order[a : a + 4096] for a in range(0, len(order), 4096))]
        return np.concatenate([ids for ids, _ in found]), np.concatenate([n for _, n in found]), place

    def _columns(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, most = len(size), int(size.max())
        row = np.arange(most)[:, None]
        raw = data.take(begin + row, mode="clip")
        ids = np.where(row == size - 1, self.last[raw], self.plain[raw])
        # Of a pair, at its first place: rank and place, so that the least is the next to merge.
        none = np.uint32(0xFFFFFFFF)
        pair = np.full((most + 1, n), none, np.uint32)
        if most > 1:
            ranked = self.ranked(ids[:-1].ravel(), ids[1:].ravel()).reshape(most - 1, n)
            pair[: most - 1] = np.where((ranked < NO_PAIR) & (row[1:] < size), ranked >> 16 << 6 | row[:-1], none)
        ids, flat, left = ids.ravel(), pair.ravel(), (row < size).ravel()
        # Links are places in the flat matrix; the row below the last is beyond it, on either side.
        beyond = most * n
        after, before = np.arange(n, beyond + n), np.arange(-n, beyond)
        before[:n] = beyond
        ends = size * n
        while True:
            best = pair.min(axis=0)
            live = np.flatnonzero(best != none)
            if not len(live):
                break
            best = best[live].astype(np.int64)
            at = (best & 63) * n + live
            gone = after[at]
            then, prior, end = after[gone], before[at], ends[live]
            ids[at] = self.made[best >> 6]
            left[gone], flat[gone], flat[at] = False, none, none
            after[at] = then
            before[then] = at
            # The pairs on both sides anew.
            right, also = then < end + live, prior < beyond
            first = np.concatenate([at[right], prior[also]])
            ranked = self.ranked(ids[first], ids[np.concatenate([then[right], at[also]])])
            flat[first] = np.where(ranked < NO_PAIR, ranked >> 16 << 6 | first // n, none)
        left = left.reshape(most, n)
        return ids.reshape(most, n).T[left.T].astype("<u2"), left.sum(axis=0)


class Words:
    """Words whose ids are known, of bounded number and bytes: ids of each follow those of the one before."""

    def __init__(self, most: int, most_bytes: int = 20_000_000):
        self.most, self.most_bytes = most, most_bytes
        self.keep(pa.array([], pa.large_string()), np.zeros(0, "<u2"), np.zeros(0, np.int64))

    def keep(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.words, self.ids, self.sizes = words, ids, sizes

    def add(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Takes in new words; if they don't fit, the older ones go, and if they don't fit then, they aren't kept."""
        size = (pc.sum(pc.binary_length(words)).as_py() or 0) + 1
        for old in (len(self.words), 0):
            held = self.words.slice(0, old)
            if old + len(words) <= self.most and size + (pc.sum(pc.binary_length(held)).as_py() or 0) <= self.most_bytes:
                self.keep(pa.concat_arrays([held, words]), np.concatenate([self.ids if old else self.ids[:0], ids]), np.concatenate([self.sizes[:old], sizes]))
                return
        self.keep(self.words.slice(0, 0), self.ids[:0], self.sizes[:0])


class Encoder:
    """Ids of the tokenizer's file. Text between blanks is encoded apart, as its white space counts for nothing, and remembered."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        if self.own.get_vocab_size() > 65536:
            raise ValueError("ids under 65536 are needed")
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model, pre = held["model"], (held["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        split = {"type": "Split", "pattern": {"Regex": _PIECES}, "behavior": "Removed", "invert": True}
        level = {k: v for k, v in pre[-1].items() if k != "trim_offsets"}
        if (held["normalizer"] or {}).get("normalizers") != _NORMALIZERS or pre[:-1] != [split] or level != {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False} or held["post_processor"]:
            raise ValueError("a tokenizer is needed that drops white space and merges each run of letters apart")
        if any(" " in t["content"] or t["lstrip"] or t["rstrip"] for t in held["added_tokens"]):
            raise ValueError("special strings must not hold blanks")
        plain = model["type"] == "BPE" and not any(model[k] for k in ("dropout", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")) and model["end_of_word_suffix"]
        self.merges = self._merges(model) if plain else None
        self.memo = Words(400_000)
        self.ends = pa.array(sorted(ENDINGS), pa.large_string())
        self.end_ids = self._library(self.ends.to_pylist())

    @staticmethod
    def _merges(model: dict) -> Columns:
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        plain, last = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for c, b in byte_letters().items():
            plain[b], last[b] = vocab[c], vocab[c + end]
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        return Columns(plain, last, [(vocab[a], vocab[b], i, vocab[a + b]) for i, (a, b) in enumerate(pairs)])

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null((texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string()), "")
        return [ids for a, b in pieces(len(texts), pc.binary_length(texts).to_pylist(), PIECE) for ids in self._piece(texts.slice(a, b - a))]

    def _piece(self, texts: pa.Array) -> list[np.ndarray]:
        """Words are told apart in Arrow, and ids are looked up for each word that isn't known."""
        cut = pc.split_pattern(pc.replace_substring_regex(texts, "[\n\t\r]", " "), " ")
        known, words = self.memo, cut.flatten()
        # Known words come first, so that they keep their places.
        coded = pa.concat_arrays([known.words, words]).dictionary_encode()
        new = coded.dictionary.slice(len(known.words))
        ids, sizes = self._ids(new)
        found, own = _gathered(np.concatenate([known.ids, ids]), np.concatenate([known.sizes, sizes]), coded.indices.to_numpy()[len(known.words) :])
        known.add(new, ids, sizes)
        ends = np.append(0, np.cumsum(own))[np.cumsum(np.append(0, pc.list_value_length(cut).to_numpy()))].tolist()
        found = found.astype(np.uint32)
        return [found[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and how many each has: those of letters and a known ending by merging the letters side by side."""
        heads, ends = pc.utf8_rtrim(words, _MARKS), pc.index_in(pc.utf8_ltrim(words, _LETTERS), self.ends)
        plain = pc.and_(pc.match_substring_regex(heads, f"^{LETTERS.pattern}$"), pc.is_valid(ends))
        if self.merges is None:
            plain = pa.array(np.zeros(len(words), bool))
        coded = pc.utf8_lower(heads.filter(plain)).dictionary_encode()
        merged, sizes, place = self.merges.merged(coded.dictionary) if len(coded) else (np.zeros(0, "<u2"), np.zeros(0, np.int64), np.zeros(0, np.int64))
        others = self._library(words.filter(pc.invert(plain)).to_pylist())
        # A word is two of these parts: letters and ending, or the whole word and nothing.
        parts = [*self.end_ids, *others, b""]
        at, mask = np.full((len(words), 2), len(sizes) + len(parts) - 1), plain.to_numpy(zero_copy_only=False)
        at[mask, 0], at[mask, 1] = place[coded.indices.to_numpy()], ends.filter(plain).to_numpy() + len(sizes)
        at[~mask, 0] = np.arange(len(others)) + len(sizes) + len(self.end_ids)
        ids, sizes = _gathered(np.append(merged, np.frombuffer(b"".join(parts), "<u2")), np.append(sizes, [len(p) // 2 for p in parts]), at.ravel())
        return ids, sizes.reshape(-1, 2).sum(axis=1)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in self.own.encode_batch_fast(texts, add_special_tokens=False)] if texts else []


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write(docs: DataFrame, path: str, folder: str, *, id_col: str = "doc_id", end: int = END) -> DataFrame:
    """Writes the ids of docs to a table of segments in folder; the table."""
    rows = docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        own, part, seq = encoder(path), TaskContext.get().partitionId(), 0
        ids: list = []
        held: list[np.ndarray] = []
        stop = np.array([end], np.uint32)
        total = 0

        def flush():
            nonlocal ids, held, seq, total
            row = {"part": part, "seq": seq, "ids": ids, "lengths": [len(h) for h in held], "n_tokens": total, "blocks": pack([np.concatenate(held)])[0]}
            ids, held, seq, total = [], [], seq + 1, 0
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = None
        for batch in batches:
            schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("ids", pa.list_(batch.schema.field(0).type)), ("lengths", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("blocks", pa.binary())])
            for a, b in pieces(batch.num_rows, pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), PIECE):
                one = batch.slice(a, b - a)
                for i, x in zip(one.column(0).to_pylist(), own.encode(one.column(1)), strict=True):
                    ids.append(i)
                    held.append(np.concatenate([x, stop]))
                    total += len(x) + 1
                    if total >= SEGMENT:
                        yield flush()
        if held:
            yield flush()

    made = rows.repartitionByRange("id").sortWithinPartitions("id", "text").mapInArrow(run, f"part int, seq int, ids array<{kind}>, lengths array<bigint>, n_tokens bigint, blocks binary")
    made.write.parquet(folder)
    return docs.sparkSession.read.schema(made.schema).parquet(folder)


def read(segments: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, from the files."""
    spark = segments.sparkSession
    kind = segments.schema["ids"].dataType.elementType.simpleString()
    # A number for each part, of which there are no more than tasks that wrote; their order is that of the ids.
    totals = sorted((r.part, r.n) for r in segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    starts, at = [], 0
    for part, n in totals:
        starts.append((part, at))
        at += n
    offsets = spark.createDataFrame(starts, "part int, part_start bigint")
    w = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    places = segments.select("part", "seq", "n_tokens").withColumn("before", F.coalesce(F.sum("n_tokens").over(w), F.lit(0))).join(F.broadcast(offsets), "part").select("part", "seq", (F.col("part_start") + F.col("before")).alias("seg_start"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                found = unpack(one.column(4).to_pylist())
                for part, seq, ids, lengths, got in zip(one.column(0).to_pylist(), one.column(1).to_pylist(), one.column(2), one.column(3).to_pylist(), found, strict=True):
                    ends = np.cumsum(lengths)
                    raw = got.astype("<u4").tobytes()
                    crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths, strict=True)]
                    n = len(lengths)
                    yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), ids.values, pa.array(ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], names=["part", "seq", "id", "local", "n_tokens", "ids_crc32"])

    docs = segments.select("part", "seq", "ids", "lengths", "blocks").mapInArrow(run, f"part int, seq int, id {kind}, local bigint, n_tokens bigint, ids_crc32 bigint")
    return docs.join(places, ["part", "seq"]).select("id", (F.col("seg_start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    segments = write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return read(segments).withColumnRenamed("id", "doc_id")
