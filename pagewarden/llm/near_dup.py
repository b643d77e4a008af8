"""Near-duplicate documents by order MinHash with banded alignment.

A text's k-mers are its spans of five words. Each of BANDS random orders picks the LENGTH
smallest of its distinct k-mers, the set that is verified, and keeps them in order of first
occurrence: two texts share such a tuple with a probability that falls with their edit
distance. Texts with repeated k-mers have BANDS more of k-mers labelled with their
occurrence number, texts of few k-mers SHORT_BANDS more of SHORT_LENGTH. Texts that share a
tuple are in one bucket.

1. Exact copies (equal word sequences; texts without words: equal texts) are one class
   from the start and go on as one text.
2. In each bucket the most central text (the one whose buckets hold most texts) is
   compared with all others. After that, all pairs of a bucket that still are in two classes
   are compared: in buckets of up to LARGE texts outright; texts of larger ones by their rarest
   k-mers. A pair of n and m distinct k-mers can reach THRESHOLD only with a common one among
   the first n - o + 1 of one and the first m - o + 1 of the other, rarest first, where o is
   the overlap that THRESHOLD asks of these sizes. So each text keeps few k-mers, and texts of
   a large bucket meet only where that holds; nothing is capped or lost. A k-mer of one class
   is left out, one of several pairs the rest of its texts with those of its largest class, never
   these with each other. Each text has PARITY bits, of its k-mers' numbers by hash, even or odd: two
   texts differ in as many k-mers at least as in bits, so that most pairs of a template's texts
   that only differ too much are dropped within the join. The classes are those of all pairs that share a bucket.
3. A pair is verified by an alignment of both texts' distinct k-mers in their order
   within a band. Matched k-mers over all distinct k-mers must be THRESHOLD or more. The
   band is as wide as that threshold allows, so it loses no pair.
4. Classes are the connected components of verified pairs, by alternating stars: first of
   those with central texts, then of those that were found between the classes so far.

Each row gets class_id, the least id of its class. Rows without id or text are classes of
their own (class_id is their id). Texts of under five words only have exact copies.
Repeated rows are copies. A pair with m of u distinct k-mers in common shares no tuple with
a chance of (1 - C(m, LENGTH) / C(u, LENGTH)) ** BANDS at most: at similarity 0.8 that is
under 6e-6 for texts without short tuples (3e-6 for long ones), under 3e-6 with them.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewarden.llm.common import Scratch, spread, table
from pagewarden.llm.words import each_words, grams, mixed, utf8

K, LENGTH, BANDS, THRESHOLD, SEED = 5, 4, 24, 0.8, 5
#: Texts of so many distinct k-mers also have tuples of this length, in so many bands.
SHORT, SHORT_LENGTH, SHORT_BANDS = 40, 2, 14
LARGE = 50
PARITY = 512
#: Ids of the texts to be compared are broadcast up to so many bytes.
BROADCAST_BYTES = 16_000_000
U64 = np.uint64
_SEEDS = np.random.default_rng(SEED).integers(0, 2**63, 2 * BANDS + SHORT_BANDS).astype(U64)


def labelled(kmers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """K-mers mixed with their occurrence number, and the distinct k-mers in order of first occurrence."""
    order = np.argsort(kmers, kind="stable")
    ranked = kmers[order]
    new = np.ones(len(kmers), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    first = np.flatnonzero(new)
    occurrence = np.empty(len(kmers), U64)
    occurrence[order] = (np.arange(len(kmers)) - np.repeat(first, np.diff(np.append(first, len(kmers))))).astype(U64)
    return mixed(kmers + occurrence * U64(0x9E3779B97F4A7C15)), kmers[np.sort(order[new])]


def sketch(kmers: np.ndarray, length: int = LENGTH) -> list[int | None]:
    """Buckets of a text: one a band of its distinct k-mers, one of all of them as they come, and, each None if it has none, those of short tuples and of labelled k-mers."""
    if not len(kmers):
        return []
    own, distinct = labelled(kmers)
    whole = int.from_bytes(hashlib.blake2b(distinct.tobytes(), digest_size=8).digest(), "little", signed=True)
    short = _tuples(distinct, SHORT_LENGTH, _SEEDS[BANDS : BANDS + SHORT_BANDS]) if len(distinct) <= SHORT / THRESHOLD else [None] * SHORT_BANDS
    repeated = _tuples(own, length, _SEEDS[BANDS + SHORT_BANDS :]) if len(own) > len(distinct) else [None] * BANDS
    return [*_tuples(distinct, length, _SEEDS[:BANDS]), whole, *short, *repeated]


def _tuples(own: np.ndarray, length: int, all_seeds: np.ndarray) -> list[int]:
    """Of each seed the tuple of the length smallest, in text order, hashed with the seed."""
    n, length = len(own), min(length, len(own))
    out = np.empty(len(all_seeds), U64)
    step = max(1, 200_000 // n)
    for a in range(0, len(out), step):
        seeds = all_seeds[a : a + step, None]
        ranks = mixed(own[None, :] ^ seeds)
        at = np.sort(np.argpartition(ranks, length - 1, axis=1)[:, :length], axis=1)
        value = seeds[:, 0].copy()
        for j in range(length):
            value = mixed(value * U64(0x100000001B3) + own[at[:, j]])
        out[a : a + len(value)] = value
    return out.view(np.int64).tolist()


def aligned(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Matched over all k-mers, of two arrays of distinct k-mers in text order; 0 as soon as it must be below threshold."""
    n, m = len(a), len(b)
    least = threshold / (1 + threshold) * (n + m) - 1e-9  # matches needed
    if not n or not m or min(n, m) < least:
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(i) < least:
        return 0.0
    order = np.argsort(i)
    i, j = i[order], j[order]
    # A match further off its diagonal leaves more than max(n, m) - least k-mers without a partner.
    j = j[np.abs(i - j) <= max(n, m) - least + 1]
    found = len(j)
    if found and (np.diff(j) < 0).any():
        ends: list[int] = []
        for x in j.tolist():
            at = bisect_left(ends, x)
            ends[at : at + 1] = [x]
        found = len(ends)
    return found / (n + m - found) if found >= least else 0.0


PARITIES = [f"p{i}" for i in range(PARITY // 64)]


def parity(kmers: np.ndarray) -> np.ndarray:
    """PARITY bits of distinct k-mers, as 64-bit integers: whether an odd number of them falls on each."""
    odd = np.bincount((kmers >> U64(13)).astype(np.int64) & (PARITY - 1), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _texts(with_kmers: bool, k: int):
    """(id, key, n, buckets) or (key, kmers, parities) of each text."""

    def run(batches):
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            data, offsets = utf8(column)
            keys, sizes, found = [], [], []
            for a, w in each_words(column):
                for r in range(len(w.doc) - 1):
                    own = w.hash[w.doc[r] : w.doc[r + 1]]
                    digest = hashlib.blake2b(own.tobytes() if len(own) else data[offsets[a + r] : offsets[a + r + 1]].tobytes(), digest_size=16, person=b"words" if len(own) else b"bytes")
                    keys.append(digest.digest())
                    kmers = grams(own, k)
                    sizes.append(len(np.unique(kmers)))
                    found.append(labelled(kmers)[1] if with_kmers else sketch(kmers))
            if with_kmers:
                bits = np.array([parity(x) for x in found], np.int64).reshape(len(found), len(PARITIES))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([x.tobytes() for x in found], pa.binary()), *[pa.array(b) for b in bits.T]], names=["key", "kmers", *PARITIES])
            else:
                yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["id", "key", "n", "buckets"])

    return run


def _verify(threshold: float):
    def run(batches):
        for batch in batches:
            keep = [aligned(np.frombuffer(x, U64), np.frombuffer(y, U64), threshold) >= threshold for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(pairs: DataFrame, kmers: DataFrame, threshold: float) -> DataFrame:
    left = kmers.select(F.col("key").alias("a"), F.col("kmers").alias("x"))
    right = kmers.select(F.col("key").alias("b"), F.col("kmers").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_verify(threshold), "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, component: its least node) of a graph of edges (a, b), by alternating large and small stars.

    A round keeps as many edges as there are nodes at most; rounds grow with the
    logarithm of the largest component. Edges with a null end count for nothing.
    """
    keep = Scratch(edges.sparkSession)
    edges = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = keep(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        keep.drop(edges, least)
        least = keep(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u")
        edges = keep(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        keep.drop(large, least)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            # Each node points at its component's least node, which itself has no edge upwards.
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now


def _pairs(members: DataFrame, leaders: DataFrame) -> DataFrame:
    """Distinct pairs of a group's leader with its other members."""
    met = members.join(leaders, "g").where("key <> leader")
    return met.select(F.least("key", "leader").alias("a"), F.greatest("key", "leader").alias("b")).distinct()


def _distinct(met: DataFrame) -> DataFrame:
    return met.select(F.least("key", "b").alias("a"), F.greatest("key", "b").alias("b")).distinct()


def _other(members: DataFrame) -> DataFrame:
    return members.withColumnsRenamed({"key": "b", "n": "m", "of": "with", "rank": "at", **{p: f"{p}_" for p in PARITIES}})


def crossing(members: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a, b) of keys in one small group g and two classes of, whose sizes n allow that threshold."""
    met = members.join(_other(members), "g")
    return _distinct(met.where((F.col("of") != F.col("with")) & (F.col("key") < F.col("b")) & (F.least("n", "m") >= threshold * F.greatest("n", "m") - 1e-6)))


def _overlap(n: str, m: str, threshold: float):
    """Common k-mers that texts of n and m need to reach the threshold."""
    return F.ceil(threshold / (1 + threshold) * (F.col(n) + F.col(m)) - 1e-6)


def _near(threshold: float):
    """Whether the parities of texts of n and m k-mers differ in no more bits than such texts may in k-mers."""
    apart = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"{p}_"))) for p in PARITIES), F.lit(0))
    return apart <= F.col("n") + F.col("m") - 2 * _overlap("n", "m", threshold)


def near(pairs: DataFrame, bits: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that bits (key, n, parities) don't rule out."""
    return pairs.join(bits.withColumnRenamed("key", "a"), "a").join(_other(bits), "b").where(_near(threshold)).select("a", "b")


def close(prefixes: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a, b) of keys in two classes of that share a k-mer g within the ranks that their sizes allow, and whose parities don't rule them out."""
    need = _overlap("n", "m", threshold)
    # Of each k-mer of several classes the one with most texts: of a pair in two classes one at least is outside it.
    most = prefixes.groupBy("g", "of").agg(F.count(F.lit(1)).alias("held")).groupBy("g").agg(F.max(F.struct("held", "of")).alias("top"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("g", F.col("top.of").alias("top"))
    marked = prefixes.join(most, "g").withColumn("minor", F.col("of") != F.col("top")).drop("top")
    shorter = marked.where(F.col("rank") <= F.col("n") - _overlap("n", "n", threshold) + 1)
    fits = (F.col("of") != F.col("with")) & (F.col("n") <= F.col("m")) & (F.col("n") >= threshold * F.col("m") - 1e-6) & (F.col("rank") <= F.col("n") - need + 1) & (F.col("at") <= F.col("m") - need + 1) & _near(threshold)
    pairs = [shorter.where(one).drop("minor").join(_other(marked.where(other).drop("minor")), "g").where(fits) for one, other in (("minor", "true"), ("not minor", "minor"))]
    return _distinct(pairs[0].select("key", "b").unionByName(pairs[1].select("key", "b")))


def _each_kmer(batches):
    for batch in batches:
        own = [np.frombuffer(x, np.int64) for x in batch.column(3).to_pylist()]
        at = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
        yield pa.RecordBatch.from_arrays([*[batch.column(i).take(at) for i in range(3)], pa.array(np.concatenate(own) if own else [], pa.int64())], names=["key", "n", "of", "g"])


def prefixes(each: DataFrame, threshold: float) -> DataFrame:
    """(key, n, of, g, rank) of k-mers (key, n, of, g): each text's rarest, as many as a text of any size can need, without those of one text alone."""
    ranked = each.join(each.groupBy("g").agg(F.count(F.lit(1)).alias("texts")), "g")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("texts", "g")))
    return ranked.where((F.col("rank") <= F.col("n") - F.ceil(threshold * F.col("n") - 1e-6) + 1) & (F.col("texts") > 1)).select("key", "n", "of", "g", "rank")


def classes(docs: DataFrame, *, id_col: str = "doc_id", k: int = K, threshold: float = THRESHOLD, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, class_id) per row of docs."""
    keep = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    alone = rows.where("id is null or text is null").select("id", F.col("id").alias("class_id"))
    rows = rows.where("id is not null and text is not null")
    texts = keep(spread(rows).mapInArrow(_texts(False, k), f"id {kind}, key binary, n bigint, buckets array<bigint>"), "texts")
    one = keep(texts.groupBy("key").agg(F.min("id").alias("id"), F.first("buckets").alias("buckets"), F.first("n").alias("n")), "one")

    # Buckets of two texts or more, and of each text in one: its buckets, and how many texts they hold together.
    placed = one.select("key", "id", "n", F.posexplode("buckets").alias("band", "bucket")).where("bucket is not null").select("key", "id", "n", F.xxhash64("band", "bucket").alias("g"))
    sizes = keep(placed.groupBy("g").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    central = placed.join(sizes, "g").groupBy("key").agg(F.sum("size").alias("central"), F.min("id").alias("id"), F.first("n").alias("n"), F.collect_set("g").alias("groups"))
    central = keep(central, "central")
    keep.drop(sizes)

    # K-mers of those texts.
    ids = central.select("id").distinct()
    held = ids.agg(F.sum(F.length(F.col("id").cast("string")) + 40)).first()[0] or 0
    again = rows.join(F.broadcast(ids) if held <= broadcast_bytes else ids, "id", "left_semi")
    kmers = keep(spread(again).mapInArrow(_texts(True, k), "key binary, kmers binary, " + ", ".join(f"{p} bigint" for p in PARITIES)).dropDuplicates(["key"]), "kmers")

    # First the most central text of each bucket.
    members = central.select("key", "central", F.explode("groups").alias("g"))
    leaders = keep(members.groupBy("g").agg(F.max(F.struct("central", "key")).alias("l")).select("g", F.col("l.key").alias("leader")), "leaders")
    pairs = keep(_pairs(members, leaders), "pairs")
    links = keep(verified(pairs, kmers, threshold), "links")
    found = keep(components(links), "found")
    keep.drop(leaders, pairs, links)

    # Then all pairs of a bucket that still are in two classes: those of larger buckets by their rarest k-mers.
    own = F.coalesce("component", "key")
    classed = keep(central.join(found.withColumnRenamed("node", "key"), "key", "left").select("key", "n", own.alias("of"), "groups"), "classed")
    members = classed.select("key", "n", "of", F.explode("groups").alias("g"))
    met = keep(members.groupBy("g").agg(F.min("of").alias("x"), F.max("of").alias("y"), F.count(F.lit(1)).alias("size")).where("x <> y").select("g", "size"), "met")
    mixed = keep(members.join(met, "g"), "mixed")
    keep.drop(central, met)
    many = mixed.where(f"size > {LARGE}").select("key", "n", "of").distinct()
    each = keep(many.join(kmers, "key").select("key", "n", "of", "kmers").mapInArrow(_each_kmer, "key binary, n bigint, of binary, g bigint"), "each")
    rare = keep(prefixes(each, threshold).join(kmers.select("key", *PARITIES), "key"), "prefixes")
    keep.drop(each)
    bits = classed.select("key", "n").join(kmers.select("key", *PARITIES), "key")
    small = near(crossing(mixed.where(f"size <= {LARGE}").drop("size"), threshold), bits, threshold)
    rest = keep(small.unionByName(close(rare, threshold)).distinct(), "rest")
    more = keep(verified(rest, kmers, threshold), "more")
    of = classed.select("key", "of")
    more = more.join(of.toDF("a", "of_a"), "a").join(of.toDF("b", "of_b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    joined = keep(components(more), "joined")

    # Least id of each class.
    last = classed.join(joined.withColumnRenamed("node", "of"), "of", "left").select("key", F.coalesce("component", "of").alias("of"))
    named = keep(one.select("key", "id").join(last, "key", "left").select("key", "id", F.coalesce("of", "key").alias("of")), "named")
    of_text = named.join(named.groupBy("of").agg(F.min("id").alias("class_id")), "of").select("key", "class_id")
    of_text = keep(of_text, "classes")
    keep.drop_all_but(texts, of_text)
    out = texts.select("id", "key").join(of_text, "key").select("id", "class_id").unionByName(alone)
    return out.withColumnRenamed("id", id_col)


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", **settings) -> DataFrame:
    """The rows, with their columns, that give their class its id (and rows without id or text). Of rows with one id one stays."""
    found = classes(docs, id_col=id_col, **settings)
    rows = found.where(f"`{id_col}` = class_id").select(id_col).distinct()
    kept = docs.join(rows, id_col, "left_semi").dropDuplicates([id_col])
    return kept.unionByName(docs.where(F.col(id_col).isNull())).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
