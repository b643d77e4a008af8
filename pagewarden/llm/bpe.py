"""Byte-pair merging of one piece of text by ranks, and text segments that can be encoded apart."""

from __future__ import annotations

import base64
import heapq
import re
from functools import lru_cache

import numpy as np
import regex


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(4)
def ranks_of(path: str) -> dict[bytes, int]:
    return read_ranks(path)


MOST_STATES = 250_000


class Borders:
    """Which tokens may stand side by side: the tokens of a piece are those of which every one encodes to itself and every neighbouring pair encodes to itself."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.halves: dict[bytes, tuple[bytes, bytes] | None] = {}  # what a token last merged from; None: a text of its bytes is other tokens
        self.pairs: dict[tuple[bytes, bytes], bool] = {}

    def split(self, token: bytes) -> tuple[bytes, bytes] | None:
        if token not in self.halves:
            parts = merged_parts(token, self.ranks, len(token) > 1 and 2 or 1)
            self.halves[token] = tuple(parts) if len(parts) == 2 and b"".join(parts) == token and token in self.ranks else None
        return self.halves[token]

    def allowed(self, before: bytes, token: bytes) -> bool:
        """Whether before and token stay as they are when their bytes are merged together.

        The merges of both are undone, the latest first. While two parts stood side by
        side across the border, they would have merged if their own rank came before
        that of the next merge on either side (on the right side also at the same rank,
        for the leftmost merges first).
        """
        if len(token) > 1 and self.split(token) is None:
            return False
        if not before:
            return True
        found = self.pairs.get((before, token))
        if found is None:
            if len(self.pairs) > 300_000:
                self.pairs.clear()
            found = self.pairs[before, token] = self._border(before, token)
        return found

    def _border(self, x: bytes, y: bytes) -> bool:
        ranks, x_next, y_next = self.ranks, 1 << 30, 1 << 30  # rank of the merge that x and y went into
        while True:
            r = ranks.get(x + y)
            if r is not None and r < x_next and r <= y_next:
                return False
            x_made, y_made = (ranks[p] if len(p) > 1 else -1 for p in (x, y))
            if x_made < 0 and y_made < 0:
                return True
            if x_made > y_made:
                x_next, x = x_made, self.split(x)[1]
            else:
                y_next, y = y_made, self.split(y)[0]


class Transducer(Borders):
    """Deterministic transducer over the bytes of one piece, compiled from ranks as far as texts need it.

    A state holds, for every place where a token still under way could have begun, the
    trie node reached from there, the last token before that place, and how many tokens
    fewer there were. Reading a byte ends exactly one token that the pair rule allows.
    A transition carries the change of the count.
    """

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__(ranks)
        self.hopes: dict[tuple[int, bytes], bool] = {}
        self.root: dict = {}
        for token in ranks:
            node = self.root
            for b in token:
                node = node.setdefault(b, {})
            node[-1] = token
        self.few: dict[int, list[bytes] | None] = {}
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple] = []
        self.index: dict[tuple, int] = {}
        self.step: dict[int, int] = {}
        self.state(((id(self.root), b"", 0),), (self.root,))

    def state(self, key: tuple, nodes: tuple) -> int:
        if key not in self.index:
            self.index[key] = len(self.states)
            self.states.append((key, nodes))
        return self.index[key]

    def hope(self, node: dict, before: bytes) -> bool:
        """False if no token below node may follow before; only looked into if few are below."""
        key = (id(node), before)
        found = self.hopes.get(key)
        if found is None:
            if id(node) not in self.few:
                self.few[id(node)] = below(node, 12)
            tokens = self.few[id(node)]
            if len(self.hopes) > 300_000:
                self.hopes.clear()
            found = self.hopes[key] = tokens is None or any(self.allowed(before, t) for t in tokens)
        return found

    def compiled(self, at: int, b: int) -> int:
        """Transition from state at by byte b: the next state times 512, plus the change of the count plus 256."""
        key, nodes = self.states[at]
        live, last, change = [], None, 0
        for (_, before, fewer), node in zip(key, nodes, strict=True):
            child = node.get(b)
            if child is None:
                continue
            live.append((child, before, fewer))
            token = child.get(-1)
            if last is None and token is not None and self.allowed(before, token):
                last, change = token, fewer + 1
        if last is None:
            raise ValueError("the vocabulary lacks a byte")
        kept = [(child, before, fewer - change) for child, before, fewer in live if len(child) > (-1 in child) and self.hope(child, before)]
        kept.append((self.root, last, 0))
        to = self.state(tuple((id(child), before, fewer) for child, before, fewer in kept), tuple(child for child, _, _ in kept))
        out = self.step[at << 8 | b] = to << 9 | change + 256
        return out

    @property
    def start(self) -> tuple:
        """The state before a piece, as states are kept: good after the tables start anew."""
        return self.states[0]

    def run(self, state: tuple, data: bytes, watch=None) -> tuple[tuple, int]:
        """The state after data and how many tokens were added; watch(i, state, n) is told of each byte and ends the run if it returns true."""
        if len(self.states) > MOST_STATES:
            self.clear()
        at, n, get = self.state(*state), 0, self.step.get
        for i, b in enumerate(data):
            to = get(at << 8 | b)
            if to is None:
                to = self.compiled(at, b)
            at = to >> 9
            n += (to & 511) - 256
            if watch is not None and watch(i, self.states[at][0], n):
                break
        return self.states[at], n

    def count(self, piece: bytes) -> int:
        if len(self.states) > MOST_STATES:
            self.clear()
        at, n, get = 0, 0, self.step.get
        for b in piece:
            to = get(at << 8 | b)
            if to is None:
                to = self.compiled(at, b)
            at = to >> 9
            n += (to & 511) - 256
        return n


def merged_parts(text: bytes, ranks: dict[bytes, int], stop: int = 1) -> list[bytes]:
    """The definition: of adjacent parts, single bytes at first, the pair of lowest rank merges, the leftmost of equal ones.

    Ends early when stop parts are left.
    """
    parts = [text[i : i + 1] for i in range(len(text))]
    get = ranks.get
    pair = [get(a + b, 1 << 30) for a, b in zip(parts, parts[1:], strict=False)]
    while len(parts) > stop:
        best = min(pair)
        if best == 1 << 30:
            break
        i = pair.index(best)
        parts[i] += parts.pop(i + 1)
        pair.pop(i)
        if i:
            pair[i - 1] = get(parts[i - 1] + parts[i], 1 << 30)
        if i < len(pair):
            pair[i] = get(parts[i] + parts[i + 1], 1 << 30)
    return parts


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ranks of a piece's tokens; for long pieces in n log n, by a linked list of parts and a heap of pairs."""
    if len(piece) < 200:
        return [ranks[p] for p in merged_parts(piece, ranks)]
    n = len(piece)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int]] = []

    def push(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != e:
            continue  # one of the two has merged meanwhile
        alive[j] = False
        end[i] = e
        if e < n:
            before[e] = i
            push(i)
        if before[i] >= 0:
            push(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def below(node: dict, most: int) -> list[bytes] | None:
    """Tokens under a trie node, itself left out; None if there are more than most."""
    out, todo = [], [c for b, c in node.items() if b >= 0]
    while todo:
        n = todo.pop()
        if -1 in n:
            out.append(n[-1])
            if len(out) > most:
                return None
        todo += [c for b, c in n.items() if b >= 0]
    return out


class Unclosed(KeyError):
    """A piece whose neighbours may change its tokens."""


class Memo(dict):
    """What make gives for a text, kept in two generations of bounded size: the older one goes when the younger is full."""

    def __init__(self, make, most: int, most_chars: int = 20_000_000):
        self.make, self.most, self.most_chars, self.chars = make, most, most_chars, 0
        self.old: dict = {}

    def __missing__(self, text: str):
        out = self.old.get(text)
        if out is None:
            out = self.make(text)
        self.chars += len(text)
        if len(self) >= self.most or self.chars > self.most_chars:
            self.old, self.chars = dict(self), len(text)
            self.clear()
        self[text] = out
        return out

    def fill(self, found: dict) -> None:
        """Takes over what was made elsewhere."""
        self.chars += sum(map(len, found))
        if len(self) + len(found) > self.most or self.chars > self.most_chars:
            self.old, self.chars = dict(self), sum(map(len, found))
            self.clear()
        self.update(found)


class Segments(Memo):
    """Memo from what stands between two spaces to what make gives for it and the space before it.

    Texts split at cuts. A cut is a place before a space that follows a character which
    isn't white space: no match of the splitting pattern spans it, whatever stands
    around, and matches after it depend on what follows only. A stretch that is empty
    or ends with white space is refused, as the space after it isn't at a cut.
    """

    def __init__(self, make, most: int = 250_000):
        super().__init__(lambda x: make(" " + x), most)

    def __missing__(self, text: str):
        if not text or white(text[-1]):
            raise Unclosed(text)
        return super().__missing__(text)


def white(c: str) -> bool:
    """White space in any library's view."""
    return c.isspace() or c in "\x1c\x1d\x1e\x1f\x85"


#: Segments of any text, by a slower way: white space and what follows up to the next white space.
_SLOW = regex.compile(r"[\s\x1c-\x1f\x85]*[^\s\x1c-\x1f\x85]+|[\s\x1c-\x1f\x85]+")


def segments(text: str) -> list[str]:
    return _SLOW.findall(text)


#: Letters that are letters to any library and that lower-casing keeps so, of one or two bytes of UTF-8; words of them are merged side by side.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]{1,24}")
#: What may follow the letters of a word and is matched apart from them.
ENDINGS = frozenset(["", ".", ",", ";", ":", "!", "?", "...", ")", '"', ".)", ",)", '."', ',"', "-", "!!", *(p + x for p in ("", ".", ",") for x in ("%%%", "***", "###", "$$$", "&&&"))])
NO_PAIR = 1 << 40


class SideBySide:
    """Byte-pair merges of many words at once: each round merges, in every word, the pair of lowest rank, the leftmost of equal ones."""

    def __init__(self, plain: np.ndarray, last: np.ndarray, merges: list[tuple[int, int, int, int]]):
        """plain, last: the id of each byte, and of a word's last byte; merges: (left id, right id, rank, id made), ids and ranks under 65536."""
        self.plain, self.last = plain, last
        left, right, rank, made = (np.array(x, np.int64) for x in zip(*merges, strict=True))
        keys, values = left << 16 | right, rank << 16 | made
        # A table of keys by hash; the bits after a pair's rank say what it becomes.
        self.bits, self.probes = max(16, int(len(keys)).bit_length() + 2), 0
        self.key, self.value = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NO_PAIR, np.int64)
        todo = np.sort(np.unique(keys, return_index=True)[1])  # of a repeated pair the first counts
        at = self._hash(keys)
        while len(todo):
            free = todo[self.key[at[todo]] == -1]
            first = free[np.unique(at[free], return_index=True)[1]]
            self.key[at[first]], self.value[at[first]] = keys[first], values[first]
            todo = np.setdiff1d(todo, first)
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank and result of pairs, NO_PAIR if they don't merge."""
        keys = a << 16 | b
        at = self._hash(keys)
        found = self.key[at]
        out = np.where(found == keys, self.value[at], NO_PAIR)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.key[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.value[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def ids(self, words: list[bytes], kind: str = "<u2") -> list[bytes]:
        """Ids of each word as integers of that kind."""
        size = np.array([len(w) for w in words])
        order = np.argsort(size, kind="stable")
        out: list[bytes] = [b""] * len(words)
        for a in range(0, len(words), 4096):
            rows = order[a : a + 4096]
            for i, found in zip(rows.tolist(), self._block([words[i] for i in rows.tolist()], size[rows], kind), strict=True):
                out[i] = found
        return out

    def _block(self, words: list[bytes], size: np.ndarray, kind: str) -> list[bytes]:
        n, width = len(words), int(size.max())
        raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(n, width)
        at = np.arange(width)
        ids = np.where(at == size[:, None] - 1, self.last[raw], self.plain[raw])
        size = size.copy()
        rank = np.full((n, width), NO_PAIR, np.int64)
        if width > 1:
            inside = at[1:] < size[:, None]
            rank[:, :-1][inside] = self.ranked(ids[:, :-1][inside], ids[:, 1:][inside])
        live = np.arange(n)
        while len(live):
            best = rank[live].argmin(axis=1)
            value = rank[live, best]
            more = value != NO_PAIR
            live, best, value = live[more], best[more], value[more]
            if not len(live):
                break
            own, held = ids[live], rank[live]
            shift = np.minimum(at + (at > best[:, None]), width - 1)
            own, held = np.take_along_axis(own, shift, 1), np.take_along_axis(held, shift, 1)
            j = np.arange(len(live))
            own[j, best] = value & 0xFFFF
            size[live] -= 1
            now = size[live]
            held[j, now - 1] = NO_PAIR
            some = np.flatnonzero(best > 0)
            held[some, best[some] - 1] = self.ranked(own[some, best[some] - 1], own[some, best[some]])
            some = np.flatnonzero(best < now - 1)
            held[some, best[some]] = self.ranked(own[some, best[some]], own[some, best[some] + 1])
            ids[live], rank[live] = own, held
        small = ids.astype(kind)
        return [small[i, :k].tobytes() for i, k in enumerate(size.tolist())]
