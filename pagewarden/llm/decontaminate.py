"""Benchmark decontamination by winnowing.

Texts become k-gram hashes; of each window of ``window - k + 1`` consecutive
hashes the smallest is a fingerprint. Two texts that share ``window`` words share
such a window, hence its minimum: no shared span of that length is missed.
Fingerprints of documents are joined with those of the items and every hit is
extended, word by word, to the longest shared span around it.

Items of fewer than ``window`` words count as one span of their own length n: their
fingerprint is the hash of all n words, looked up at every place of a document.

The item side is broadcast only if its texts are under ``broadcast_bytes``; beyond
that the fingerprints are joined by a shuffle, with the same result.

Null or wordless texts have no words, no hits. Rows are treated one by one, so
repeated rows give repeated results; item ids that repeat are reported once; null
item ids are ignored. No items: nothing is hit. Columns other than the id and the
text are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.llm.common import small_batches, spread, table
from pagewarden.llm.words import each_words, grams

WINDOW, K = 10, 5
#: Items up to so many bytes go to each worker; their index there takes some twenty times as many.
BROADCAST_BYTES = 4_000_000
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def winnowed(hashed: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the minimum of some window of width hashes (of all, if there are fewer)."""
    n = len(hashed)
    if n == 0:
        return np.zeros(0, np.int64)
    width = min(width, n)
    low = hashed[: n - width + 1].copy()
    for j in range(1, width):
        np.minimum(low, hashed[j : j + n - width + 1], out=low)
    chosen = np.zeros(n, bool)
    for j in range(width):
        chosen[j : j + n - width + 1] |= hashed[j : j + n - width + 1] == low
    return np.flatnonzero(chosen)


class Items:
    """Items' words with an index from fingerprint to (item, position)."""

    def __init__(self, rows: list[tuple[str, str]], window: int, k: int):
        self.window, self.k = window, k
        self.ids, self.words, self.at = [], [], {}
        where: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))  # gram length -> hash -> places
        for item, text in sorted(set(rows)):
            _, w = next(each_words(pa.array([text])))
            n = len(w.hash)
            if not n:
                continue
            i = len(self.ids)
            self.ids.append(item)
            self.words.append([w.word(j) for j in range(n)])
            if n < window:
                where[-n][int(grams(w.hash, n)[0])].append((i, 0))
            else:
                h = grams(w.hash, k)
                for p in winnowed(h, window - k + 1):
                    where[k][int(h[p])].append((i, int(p)))
        self.at = {n: dict(v) for n, v in where.items()}
        self.keys = {n: np.sort(np.fromiter(v, np.uint64, len(v))) for n, v in self.at.items()}

    def found(self, keys: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
        return np.flatnonzero(keys[i] == hashed)

    def places(self, w) -> dict[int, list[tuple[int, int, int]]]:
        """Row -> (position in the batch's words, item, position in the item) of fingerprints in common."""
        out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for n, keys in self.keys.items():
            h = grams(w.hash, abs(n))
            if not len(h):
                continue
            if n > 0:
                chosen = winnowed(h, self.window - self.k + 1)
                chosen = chosen[self.found(keys, h[chosen])]
            else:
                chosen = self.found(keys, h)
            rows = np.searchsorted(w.doc, chosen, side="right") - 1
            inside = chosen + abs(n) <= w.doc[rows + 1]
            for p, r in zip(chosen[inside].tolist(), rows[inside].tolist(), strict=True):
                out[r] += [(p, i, q) for i, q in self.at[n][int(h[p])]]
        return out

    def spans(self, w, first: int, last: int, places) -> tuple[set[int], list[tuple[int, int]]]:
        """Items met and the spans of words hit, by extending each common fingerprint."""
        met, spans, seen = set(), set(), set()
        for p, i, q in sorted(places):
            own = self.words[i]
            if (i, p - q, p) in seen:
                continue
            a, b = 0, 0
            while p - a > first and q - a > 0 and w.word(p - a - 1) == own[q - a - 1]:
                a += 1
            while p + b < last and q + b < len(own) and w.word(p + b) == own[q + b]:
                b += 1
                seen.add((i, p - q, p + b))
            if a + b >= min(self.window, len(own)):
                met.add(i)
                spans.add((p - a - first, p + b - first))
        return met, sorted(spans)


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scan(items: Items):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            n_words, found, hit = np.zeros(n, np.int64), [[] for _ in range(n)], [[] for _ in range(n)]
            for a, w in each_words(batch.column(1)):
                n_words[a : a + len(w.doc) - 1] = np.diff(w.doc)
                for r, places in items.places(w).items():
                    met, spans = items.spans(w, w.doc[r], w.doc[r + 1], places)
                    found[a + r] = sorted({items.ids[i] for i in met})
                    hit[a + r] = [{"start": s, "end": e} for s, e in _united(spans)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(found, pa.list_(pa.string())), pa.array(hit, kind)], names=["id", "n_words", "items", "spans"])

    return run


def _fingerprints(of_items: bool, window: int, k: int, lengths: list[int]):
    """Rows (id, gram length, hash) of a table, for the join by a shuffle."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for a, w in each_words(batch.column(1)):
                for r in range(len(w.doc) - 1):
                    own = w.hash[w.doc[r] : w.doc[r + 1]]
                    h = grams(own, k)
                    got = {(k, int(x)) for x in h[winnowed(h, window - k + 1)]} if len(own) >= window or not of_items else set()
                    for n in [len(own)] if of_items and 0 < len(own) < window else [] if of_items else lengths:
                        got |= {(-n, int(x)) for x in grams(own, n).tolist()}
                    if got:
                        n, x = zip(*sorted(got), strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array([ids[a + r].as_py()] * len(got), ids.type), pa.array(n, pa.int32()), pa.array(np.array(x, np.uint64).view(np.int64))], names=["id", "n", "hash"])

    return run


def _extended(window: int, k: int):
    def run(batches):
        for batch in batches:
            out = []
            for key, text, item, words in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                one = Items([(item, words)], window, k)
                w = next(x for _, x in each_words(pa.array([text])))
                met, spans = one.spans(w, 0, len(w.hash), one.places(w).get(0, []))
                out += [{"key": key, "item": item, "spans": [{"start": a, "end": b} for a, b in spans]}] if met else []
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("key", pa.string()), ("item", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))

    return run


def _unite_batches(batches):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        spans = [_united(sorted((s["start"], s["end"]) for part in row for s in part)) for row in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], kind)], names=["key", "items", "spans"])


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", item_col: str = "item_id", window: int = WINDOW, k: int = K, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, n_words, items: sorted item ids as strings, spans: united word ranges that are hit) per row of docs."""
    if not 0 < k <= window:
        raise ValueError("k must be from 1 to window")
    docs = docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col(item_col).cast("string").alias("item"), F.col("text").cast("string").alias("words")).where("item is not null and words is not null").distinct()
    kind = docs.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words bigint, items array<string>, spans array<struct<start: bigint, end: bigint>>"
    if _bytes(items) <= broadcast_bytes:
        known = Items([(r.item, r.words) for r in items.collect()], window, k)
        return spread(docs).mapInArrow(_scan(known), schema).withColumnRenamed("id", id_col)
    keyed = docs.withColumn("key", F.sha2(F.concat_ws("\0", F.coalesce(F.col("id").cast("string"), F.lit("\1")), F.coalesce("text", F.lit("\1"))), 256))
    one = keyed.dropDuplicates(["key"])
    prints = items.mapInArrow(_fingerprints(True, window, k, []), "id string, n int, hash bigint").withColumnRenamed("id", "item")
    lengths = [-r.n for r in prints.where("n < 0").select("n").distinct().collect()]  # under window of them
    own = one.select("key", "text").mapInArrow(_fingerprints(False, window, k, lengths), "id string, n int, hash bigint").withColumnRenamed("id", "key")
    pairs = own.join(prints, ["n", "hash"]).select("key", "item").distinct()
    hits = pairs.join(one.select("key", "text"), "key").join(items, "item").select("key", "text", "item", "words").mapInArrow(_extended(window, k), "key string, item string, spans array<struct<start: bigint, end: bigint>>")
    met = hits.groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"), F.collect_list("spans").alias("spans")).mapInArrow(_unite_batches, "key string, items array<string>, spans array<struct<start: bigint, end: bigint>>")
    counted = keyed.mapInArrow(_count_words, f"id {kind}, key string, n_words bigint")
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    return counted.join(met, "key", "left").select(F.col("id").alias(id_col), "n_words", F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", none).alias("spans"))


def clean(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", item_col: str = "item_id", window: int = WINDOW, k: int = K, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows, with their columns, whose text holds no window of an item."""
    few = items.select(F.col(item_col).cast("string").alias("item"), F.col("text").cast("string").alias("words")).where("item is not null and words is not null").distinct()
    if _bytes(few) <= broadcast_bytes:
        known, where = Items([(r.item, r.words) for r in few.collect()], window, k), docs.columns.index("text")

        def run(batches):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for a, w in each_words(batch.column(where)):
                    for r, places in known.places(w).items():
                        keep[a + r] = not known.spans(w, w.doc[r], w.doc[r + 1], places)[0]
                yield batch.filter(pa.array(keep))

        return small_batches(docs).mapInArrow(run, docs.schema)
    hit = decontaminate(docs, items, id_col=id_col, item_col=item_col, window=window, k=k, broadcast_bytes=broadcast_bytes).where("size(items) > 0")
    return docs.join(hit.select(id_col).distinct(), id_col, "left_anti").select(*docs.columns)


def _bytes(items: DataFrame) -> int:
    return items.agg(F.sum(F.octet_length("words") + F.octet_length("item") + 64)).first()[0] or 0


def _count_words(batches):
    for batch in batches:
        n = np.zeros(batch.num_rows, np.int64)
        for a, w in each_words(batch.column(1)):
            n[a : a + len(w.doc) - 1] = np.diff(w.doc)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n)], names=["id", "key", "n_words"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"))


SQL = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
gram AS (SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS g
         FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM low, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, p, n, item_id FROM gram JOIN win USING (n, g)),
word AS (SELECT doc_id, count(DISTINCT p + j) AS n_hit FROM (SELECT doc_id, p, unnest(range(0, n)) AS j FROM hit) GROUP BY doc_id),
met AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN word USING (doc_id) LEFT JOIN met USING (doc_id)
"""
