"""Quality of texts by a factorisation machine.

A text's features are its hashed words (each 1 over the root of their number), statistics
of its structure, and the length it is recorded with. The machine adds to a linear
score all pairwise products of features, weighted by products of low-rank factors, in
linear time: half of the squared sum less the sum of squares, over all factors. It is
trained on labelled rows by stochastic gradients with adaptive steps.

At most ``max_rows`` labelled rows are used to train, those with the smallest hash of
their id, so what comes to the driver is bounded (``max_rows`` texts' distinct hashed
words, 2 ** BITS each at most). All rows are scored. A document with several labels counts
by the largest. Without labelled rows the score is 0.5. Null or empty texts are
scored by their structure. Rows are treated one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.llm.common import spread, table
from pagewarden.llm.language import held_out
from pagewarden.llm.words import each_words, grams, utf8

BITS, FACTORS, MAX_ROWS, EPOCHS, RATE, DECAY, SEED = 16, 8, 12_000, 5, 0.08, 2e-5, 4
LIMIT = 0.7
# Classes of bytes: 0 other, 1 a-z, 2 A-Z, 3 digit, 4 blank, 5 line end, 6 sentence marks, 7 brackets and quotes, 8 other marks, 9 beyond ASCII.
_KIND = np.zeros(256, np.uint8)
for _chars, _k in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b" \t", 4), (b"\n\r", 5), (b".,;:?", 6), (b"()[]{}\"'", 7), (b"!#$%&*+-/<=>@\\^_`|~", 8)):
    _KIND[np.frombuffer(_chars, np.uint8)] = _k
_KIND[128:] = 9
STATS = 18


def structure(data: np.ndarray, hashed: np.ndarray, n_chars: float) -> np.ndarray:
    n, m = len(data), len(hashed)
    kinds = np.bincount(_KIND[data], minlength=10)[:10] / max(n, 1)
    threes = grams(hashed, 3)
    _, counts = np.unique(hashed, return_counts=True)
    return np.array(
        [
            *kinds,
            np.log1p(n),
            np.log1p(m),
            np.log1p(max(n_chars, 0.0)),
            n / (m + 1) / 10,
            len(counts) / m if m else 0.0,
            counts.max() / m if m else 0.0,
            len(np.unique(threes)) / len(threes) if len(threes) else 0.0,
            float((hashed[1:] == hashed[:-1]).mean()) if m > 1 else 0.0,
        ]
    )


def _features(batch_texts: pa.Array, lengths: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed word cells and structure statistics of each text."""
    data, offsets = utf8(batch_texts)
    out = []
    for a, w in each_words(batch_texts):
        for r in range(len(w.doc) - 1):
            own = w.hash[w.doc[r] : w.doc[r + 1]]
            cells = np.unique((own >> np.uint64(64 - BITS)).astype(np.int32))
            i = a + r
            out.append((cells, structure(data[offsets[i] : offsets[i + 1]], own, float(lengths[i] if lengths[i] is not None else 0))))
    return out


class Machine:
    """Factorisation machine over 2 ** BITS word cells and STATS statistics."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        d = 2**BITS + STATS
        self.bias, self.linear = 0.0, np.zeros(d, np.float32)
        self.factors = rng.normal(0, 0.01, (d, FACTORS)).astype(np.float32)
        self.mean, self.scale, self.fitted = np.zeros(STATS), np.ones(STATS), False

    def row(self, cells: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.clip((stats - self.mean) / self.scale, -5, 5) / 4
        x = np.concatenate([np.full(len(cells), 1 / np.sqrt(max(len(cells), 1))), z]).astype(np.float32)
        return np.concatenate([cells, np.arange(2**BITS, 2**BITS + STATS)]), x

    def raw(self, i: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        v = self.factors[i] * x[:, None]
        s = v.sum(axis=0)
        return float(self.bias + self.linear[i] @ x + 0.5 * (s @ s - (v * v).sum())), v, s

    def score(self, cells: np.ndarray, stats: np.ndarray) -> float:
        if not self.fitted:
            return 0.5
        return float(1 / (1 + np.exp(-np.clip(self.raw(*self.row(cells, stats))[0], -30, 30))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> Machine:
        if not rows:
            return self
        stats = np.array([s for _, s, _ in rows])
        self.mean, self.scale, self.fitted = stats.mean(axis=0), stats.std(axis=0) + 1e-6, True
        share = np.clip(np.mean([y for *_, y in rows]), 0.01, 0.99)
        self.bias = float(np.log(share / (1 - share)))
        made = [(*self.row(c, s), y) for c, s, y in rows]
        seen_w, seen_v, seen_b = np.full(len(self.linear), 0.1, np.float32), np.full(self.factors.shape, 0.1, np.float32), 1.0
        rng = np.random.default_rng(SEED)
        for _ in range(epochs):
            for k in rng.permutation(len(made)):
                i, x, y = made[k]
                raw, v, s = self.raw(i, x)
                g = float(1 / (1 + np.exp(-np.clip(raw, -30, 30)))) - y
                gw = g * x + DECAY * self.linear[i]
                gv = g * x[:, None] * (s - v) + DECAY * self.factors[i]
                seen_w[i] += gw * gw
                seen_v[i] += gv * gv
                seen_b += g * g
                self.linear[i] -= RATE * gw / np.sqrt(seen_w[i])
                self.factors[i] -= RATE * gv / np.sqrt(seen_v[i])
                self.bias -= RATE * g / seen_b**0.5
        return self


def _prepared(docs: DataFrame, id_col: str) -> DataFrame:
    length = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.length("text").cast("double")
    return docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"), length.alias("length"))


def _train_rows(batches):
    for batch in batches:
        made = _features(batch.column(0), batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c, _ in made], pa.binary()), pa.array([s.tobytes() for _, s in made], pa.binary()), batch.column(2)], names=["cells", "stats", "label"])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Machine:
    """A machine from the labelled rows of docs."""
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label")).where("id is not null")
    known = known.join(docs.where("text is not null").select(F.col(id_col).alias("id")), "id", "left_semi")  # labels without a document take no place in the sample
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = _prepared(docs, id_col).join(F.broadcast(chosen), "id").select("text", "length", "label")
    got = spread(rows).mapInArrow(_train_rows, "cells binary, stats binary, label int").orderBy(F.xxhash64("cells", "stats")).collect()
    return Machine().fit([(np.frombuffer(r.cells, np.int32), np.frombuffer(r.stats, np.float64), r.label) for r in got])


def score(docs: DataFrame, machine: Machine, *, id_col: str = "doc_id") -> DataFrame:
    """(id, score from 0 to 1) per row; from the text and its recorded length alone."""
    held = docs.sparkSession.sparkContext.broadcast(machine)  # 2 MB, whatever the corpus

    def run(batches):
        for batch in batches:
            own = held.value
            scores = [own.score(c, s) for c, s in _features(batch.column(1), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    rows = _prepared(docs, id_col)
    return spread(rows).mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = fit(docs, labels.where(~held_out()))
    return score(docs, machine).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))
