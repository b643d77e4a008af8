"""Vector codes: k-means of vector parts by cover trees (Lloyd's rounds over subtrees).

Components become integers, floor(scale * x); a vector is cut into equal parts, each with a
codebook of its own. A task gathers up to BLOCK_ROWS vectors and builds one cover tree a
part over them: a node covers its points within a power of two of its centre, children of
a node are further apart than half of it, and every node holds the number of its points
and their cumulative sum. The trees are written once as rows of a table; nothing else of
the vectors is read in the rounds.

In a round, an entry takes a whole subtree if the triangle inequality says so: if the
centre's distance to its nearest entry and twice the radius stay below the distance to
the next one. Only the other nodes are opened, down to leaves, whose points are compared
exactly in integers (ties to the lower index). Sums and numbers of the points of an entry
are added up over trees by Spark; what reaches the driver is one row an entry.

Vectors that are null or hold null or non-finite components are left out. Defined cases: no
vector kept: no rows; fewer vectors than entries: as many entries as there are; repeated rows are
rows of their own, of a repeated id the least vector is an entry; a null id comes after all others;
null labels are one label; other columns are not read, whatever their names. Vectors of different
lengths, lengths that the parts don't divide, and components of 2^27 and more after scaling
(which 64-bit integers couldn't add up) are errors.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.llm.common import Scratch, spread, table

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
BLOCK_ROWS, LEAF_POINTS = 8192, 12
MOST = 1 << 27
NODE = np.dtype([("start", "<i4"), ("end", "<i4"), ("child", "<i4"), ("children", "<i4"), ("radius", "<f8")])


@dataclass
class Tree:
    """A cover tree over points: those of node i are order[start[i] : end[i]], its children nodes child[i] and on."""

    order: np.ndarray  # rows in the order of the leaves
    nodes: np.ndarray  # NODE
    points: np.ndarray  # in that order
    centre: np.ndarray  # of each node
    total: np.ndarray  # cumulative sum of each node

    @classmethod
    def built(cls, points: np.ndarray) -> Tree:
        """Level by level from one node over all points."""
        order = np.arange(len(points))
        far = _squares(points, points[0]) if len(points) else np.zeros(0, np.int64)
        top = int(np.ceil(np.log2(max(1.0, float(far.max(initial=0)) ** 0.5)))) + 1
        nodes: list[list] = [[0, len(points), 0, 0, float(far.max(initial=0)) ** 0.5]]
        centres, todo = [points[0]] if len(points) else [], [(0, top)] if len(points) else []
        for at, level in todo:  # grows meanwhile: nodes of a level stand side by side
            a, b, _, _, radius = nodes[at]
            if b - a <= LEAF_POINTS or radius == 0:
                continue
            while 2.0 ** (level - 1) >= radius:
                level -= 1  # all points would be in one child
            rest, taken, first = order[a:b], a, len(nodes)
            centre = centres[at]
            while len(rest):
                away = _squares(points[rest], centre)
                near = away <= 4.0 ** (level - 1)
                own = rest[near]
                order_end = taken + len(own)
                nodes.append([taken, order_end, 0, 0, float(away[near].max()) ** 0.5])
                centres.append(centre)
                todo.append((len(nodes) - 1, level - 1))
                held = rest[~near]
                order[taken:order_end], rest, taken = own, held, order_end
                if len(rest):
                    centre = points[rest[0]]
            nodes[at][2:4] = first, len(nodes) - first
        flat = np.array([tuple(n) for n in nodes], NODE) if len(points) else np.zeros(0, NODE)
        held = points[order]
        sums = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(held, axis=0, dtype=np.int64)])
        return cls(order, flat, held, np.array(centres, np.int64).reshape(len(flat), points.shape[1]), sums[flat["end"]] - sums[flat["start"]])

    def packed(self) -> bytes:
        head = np.array([len(self.order), len(self.nodes), self.points.shape[1]], "<i8")
        return b"".join([head.tobytes(), self.order.astype("<i4").tobytes(), self.nodes.tobytes(), self.points.astype("<i4").tobytes(), self.centre.astype("<i4").tobytes(), self.total.astype("<i8").tobytes()])

    @classmethod
    def read(cls, data: bytes) -> Tree:
        n, k, d = np.frombuffer(data, "<i8", 3).tolist()
        at, out = 24, []
        for kind, count in (("<i4", n), (NODE, k), ("<i4", n * d), ("<i4", k * d), ("<i8", k * d)):
            out.append(np.frombuffer(data, kind, count, at))
            at += out[-1].nbytes
        order, nodes, points, centre, total = out
        return cls(order, nodes, points.reshape(n, d).astype(np.int64), centre.reshape(k, d).astype(np.int64), total.reshape(k, d))

    def assigned(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums and numbers of the points of each entry, and the entry of each point in leaf order."""
        sums, numbers = np.zeros((len(book), book.shape[1]), np.int64), np.zeros(len(book), np.int64)
        code = np.zeros(len(self.order), np.uint8)
        front = np.arange(min(1, len(self.nodes)))
        while len(front):
            found, near, next_ = _nearest(self.centre[front], book)
            radius = self.nodes["radius"][front]
            # Roots of exact squares are off by far less than this slack.
            whole = near + 2 * radius + 1e-6 * (1 + next_) < next_ if len(book) > 1 else np.ones(len(front), bool)
            whole |= radius == 0  # all points are the centre, which was compared exactly
            mine, entry = front[whole], found[whole]
            start, end = self.nodes["start"][mine], self.nodes["end"][mine]
            np.add.at(sums, entry, self.total[mine])
            np.add.at(numbers, entry, end - start)
            code[_ranges(start, end)] = np.repeat(entry, end - start)
            open_ = front[~whole]
            leaf = self.nodes["children"][open_] == 0
            rows = _ranges(self.nodes["start"][open_[leaf]], self.nodes["end"][open_[leaf]])
            if len(rows):
                entry, _, _ = _nearest(self.points[rows], book)
                np.add.at(sums, entry, self.points[rows])
                np.add.at(numbers, entry, 1)
                code[rows] = entry
            child = self.nodes["child"][open_[~leaf]]
            front = _ranges(child, child + self.nodes["children"][open_[~leaf]])
        return sums, numbers, code


def _squares(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    away = points - centre
    return np.einsum("ij,ij->i", away, away)


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All of start[0]..end[0]-1, start[1]..end[1]-1, and so on."""
    size = (end - start).astype(np.int64)
    return np.arange(int(size.sum())) + np.repeat(start - np.cumsum(size) + size, size)


def _nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry (of equal ones the lowest), its distance, and that of the next one."""
    squares = np.stack([_squares(points, entry) for entry in book], axis=1)
    found = squares.argmin(axis=1)
    at = np.arange(len(points))
    near = np.sqrt(squares[at, found])
    if len(book) == 1:
        return found, near, near
    squares[at, found] = np.iinfo(np.int64).max
    return found, near, np.sqrt(squares.min(axis=1))


def _kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(fine).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("vector"))


def _scaled(lists: pa.Array, scale: int, parts: int, width: int) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    size = np.diff(lists.offsets.to_numpy())
    if (size != width).any() or width % parts or not width:
        raise ValueError(f"all vectors must have the same length, a positive multiple of {parts}")
    out = np.floor(scale * flat.astype(np.float64))
    if len(out) and np.abs(out).max() >= MOST:
        raise ValueError(f"components of {MOST / scale:g} and more need a smaller scale")
    return out.astype(np.int64).reshape(len(size), width)


def trees(kept: DataFrame, width: int, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """(ids, labels, trees) of blocks of rows as they come: one tree a part, packed."""
    kinds = {c: kept.schema[c].dataType.simpleString() for c in ("id", "label")}

    def run(batches):
        held, n = [], 0

        def block():
            got = pa.Table.from_batches(held).combine_chunks()
            points = np.concatenate([_scaled(c, scale, parts, width) for c in got.column(2).chunks])
            packed = [Tree.built(p).packed() for p in np.split(points, parts, axis=1)]
            one = lambda values, kind: pa.ListArray.from_arrays([0, len(values)], values, type=pa.list_(kind))
            ids, labels = (got.column(i).combine_chunks() for i in (0, 1))
            ids, labels = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (ids, labels))
            return pa.RecordBatch.from_arrays([one(ids, ids.type), one(labels, labels.type), one(pa.array(packed, pa.binary()), pa.binary())], names=["ids", "labels", "trees"])

        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(a, BLOCK_ROWS)
                if n + part.num_rows > BLOCK_ROWS:
                    yield block()
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield block()

    return spread(kept).mapInArrow(run, f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, trees array<binary>")


def first_books(kept: DataFrame, entries: int, scale: int, parts: int) -> np.ndarray | None:
    """The vectors of the least ids as (part, entry, position); None if no vector is kept."""
    names = [r.id for r in kept.select("id").distinct().orderBy(F.asc_nulls_last("id")).limit(entries).collect()]
    if not names:
        return None
    one_of = F.col("id").isin([n for n in names if n is not None])
    rows = kept.where(one_of | F.col("id").isNull() if None in names else one_of)
    least = rows.groupBy("id").agg(F.min("vector").alias("vector")).orderBy(F.asc_nulls_last("id")).collect()
    width = len(least[0].vector)
    rows = _scaled(pa.array([r.vector for r in least], pa.list_(pa.float64())), scale, parts, width)
    return np.stack(np.split(rows, parts, axis=1))


def renewed(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: assigns all parts, and replaces each entry by the floor of its parts' mean; unused entries stay."""

    def run(batches):
        sums, numbers = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for packed in batch.column(0):
                for p, data in enumerate(packed):
                    more, n, _ = Tree.read(data.as_py()).assigned(books[p])
                    sums[p] += more
                    numbers[p] += n
        p, e = np.nonzero(numbers)
        arrays = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(numbers[p, e], pa.int64()), *[pa.array(x, pa.int64()) for x in sums[p, e].reshape(len(p), -1).T]]
        yield pa.RecordBatch.from_arrays(arrays, names=["part", "entry", "n", *[f"s{i}" for i in range(books.shape[2])]])

    names = [f"s{i}" for i in range(books.shape[2])]
    found = blocks.select("trees").mapInArrow(run, "part int, entry int, n bigint, " + ", ".join(f"{s} bigint" for s in names))
    out = books.copy()
    for r in found.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).collect():
        out[r.part, r.entry] = [r[s] // r.n for s in names]
    return out


def coded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, code, error) of each vector of the blocks."""
    ids, labels = (blocks.schema[c].dataType.elementType.simpleString() for c in ("ids", "labels"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                names, marks, packed = (batch.column(c)[i].values for c in range(3))
                codes, error = np.zeros((len(names), len(books)), np.uint8), np.zeros(len(names), np.int64)
                for p, data in enumerate(packed):
                    tree = Tree.read(data.as_py())
                    _, _, code = tree.assigned(books[p])
                    away = tree.points - books[p][code]
                    codes[tree.order, p] = code
                    error[tree.order] += np.einsum("ij,ij->i", away, away)
                text = codes.tobytes().hex()
                size = 2 * len(books)
                yield pa.RecordBatch.from_arrays([names, marks, pa.array([text[k : k + size] for k in range(0, len(text), size)], pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"id {ids}, label {labels}, code string, error bigint")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """(id, label, code, error) per kept vector, and the codebooks."""
    if entries > 256:
        raise ValueError("a code has two hex digits: 256 entries at most")
    kept = _kept(vectors, id_col, vector_col, label_col)
    books = first_books(kept, entries, scale, parts)
    if books is None:
        return kept.where("false").select("id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")), None
    blocks = Scratch(vectors.sparkSession)(trees(kept, books.shape[2] * parts, scale, parts), "trees")
    for _ in range(rounds):
        books = renewed(blocks, books)
    return coded(blocks, books), books


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = compress(table(spark, sf_dir, "embeddings"))
    out = Scratch(spark)(out, "codes")
    labels = out.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = out.join(labels, F.col("label").eqNullSafe(F.col("of")), "left")
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit("" if books is None else digest(books)).alias("codebooks_sha256"))
