"""Language identification with hyperdimensional letter profiles.

Each letter has a random vector of +1 and -1. A trigram (a, b, c) is bound as
rho(rho(A)) * rho(B) * C, where rho rotates a vector by one place; a text's trigrams are
bundled by adding them up. A language's prototype bundles all its training texts. A text
gets the language whose prototype has the largest cosine with its own bundle, after the
mean of all prototypes, which every language shares, is taken off both.

Letters are lower-cased; a run of anything else is one gap. Letters beyond a-z share
``ALPHABET - 27`` vectors by code point. Training reduces to trigram counts per language
(at most ALPHABET cubed each, whatever the corpus), so all training rows are used.

A text may be in none of the languages. ``floors`` learns, for each language and size of
text, the mean and the deviation of the cosine of its labelled texts with the prototype
itself (nothing taken off); ``identified`` rejects texts that are further below the mean
than FLOOR deviations, and those without a letter. Sizes of which fewer than LEAST texts
are known reject nothing.

A text that is null or has no letter is ``und`` with score 0; so are all if nothing could
be learned. Ties go to the language that sorts first. Rows are treated one by one.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.llm.common import small_batches, spread, table

ALPHABET, DIMENSIONS, SEED = 40, 512, 20
FLOOR, LEAST = 6.0, 30
CELLS = ALPHABET**3


@functools.lru_cache(1)
def letter_codes() -> np.ndarray:
    """Code point -> 0 for a gap, 1-26 for a-z, 27 on for other letters."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = ord(s.lower()[0])
            out[c] = low - 96 if 97 <= low <= 122 else 27 + low * 2654435761 % 2**32 % (ALPHABET - 27)
    return out


@functools.lru_cache(4)
def vectors(dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of single letters, and of bound pairs rho(rho(A)) * rho(B)."""
    letter = np.random.default_rng(SEED).choice(np.array([-1, 1], np.float32), (ALPHABET, dimensions))
    pair = np.roll(letter, 2, axis=1)[:, None, :] * np.roll(letter, 1, axis=1)[None, :, :]
    return letter, np.ascontiguousarray(pair.reshape(ALPHABET * ALPHABET, dimensions))


def trigrams(text: str) -> np.ndarray:
    """Cell numbers of a text's trigrams; none if it has no letter."""
    code = letter_codes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = code != 0
    if not keep.any():
        return np.zeros(0, np.int32)
    keep[1:] |= code[:-1] != 0
    code = np.concatenate(([0], code[keep], [0])).astype(np.int32)
    return (code[:-2] * ALPHABET + code[1:-1]) * ALPHABET + code[2:]


def bundle(counts: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Sum of the bound vectors of trigrams, times their counts."""
    letter, pair = vectors(dimensions)
    cells = counts.reshape(ALPHABET * ALPHABET, ALPHABET)
    rows = np.flatnonzero(cells.any(axis=1))
    return np.einsum("pd,pd->d", cells[rows].astype(np.float32) @ letter, pair[rows])


def _count(batches):
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = held.setdefault(lang, np.zeros(CELLS, np.int64))
            cells = trigrams(text.as_py())
            own += np.bincount(cells, minlength=CELLS) if len(cells) > CELLS // 4 else 0
            if len(cells) <= CELLS // 4:
                np.add.at(own, cells, 1)
    for lang, own in held.items():
        cells = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cells), pa.string()), pa.array(cells.astype(np.int32)), pa.array(own[cells])], names=["lang", "cell", "n"])


def learn(docs: DataFrame, *, label_col: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Language -> prototype, from rows with text and label. What comes to the driver is CELLS counts a language at most."""
    rows = docs.select(F.col(label_col).cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    counted = spread(rows).mapInArrow(_count, "lang string, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    counts: dict[str, np.ndarray] = {}
    for r in counted.toLocalIterator():
        counts.setdefault(r.lang, np.zeros(CELLS, np.float64))[r.cell] = r.n
    return {lang: _unit(bundle(own / own.sum(), dimensions).astype(np.float64)) for lang, own in sorted(counts.items())}


def _unit(x: np.ndarray) -> np.ndarray:
    return x / (np.sqrt((x * x).sum()) or 1.0)


class Model:
    def __init__(self, prototypes: dict[str, np.ndarray]):
        self.langs = sorted(prototypes)
        all_ = np.array([prototypes[k] for k in self.langs])
        self.mean = all_.mean(axis=0) if len(self.langs) > 1 else np.zeros(all_.shape[1:] or DIMENSIONS)
        self.apart = np.array([_unit(p - self.mean) for p in all_])
        self.own = all_
        self.dimensions = all_.shape[1] if len(self.langs) else DIMENSIONS

    def predict(self, text: str | None) -> tuple[str, float]:
        lang, score, _, _ = self.fitted(text)
        return lang, score

    def fitted(self, text: str | None) -> tuple[str, float, int, float]:
        """Language, score, size (the number of trigrams in powers of two), and cosine with the language's prototype."""
        cells = trigrams(text) if text else ()
        if not len(cells) or not self.langs:
            return "und", 0.0, 0, 0.0
        own = _unit(bundle(np.bincount(cells, minlength=CELLS), self.dimensions).astype(np.float64))
        cosine = self.apart @ _unit(own - self.mean)
        best = int(np.argmax(np.round(cosine, 12)))
        return self.langs[best], float(min(1.0, max(0.0, cosine[best]))), len(cells).bit_length(), float(self.own[best] @ own)


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], *, id_col: str = "doc_id") -> DataFrame:
    """(id, lang_pred, score: the cosine, 0 if below) per row; from the text alone."""
    model = Model(prototypes)

    def run(batches):
        for batch in batches:
            got = [model.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=["id", "lang_pred", "score"])

    docs = docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    return spread(docs).mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def floors(docs: DataFrame, prototypes: dict[str, np.ndarray], *, label_col: str = "lang") -> dict[tuple[str, int], float]:
    """(language, size) -> least cosine of its texts, from all labelled rows. What comes to the driver is a row a language and size."""
    model = Model(prototypes)

    def run(batches):
        for batch in batches:
            got = [model.fitted(t.as_py()) for t in batch.column(0)]
            keep = [x for x in got if x[0] != "und"]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in keep], pa.string()), pa.array([x[2] for x in keep], pa.int32()), pa.array([x[3] for x in keep], pa.float64())], names=["lang", "size", "cosine"])

    rows = docs.where(F.col(label_col).isNotNull() & F.col("text").isNotNull()).select(F.col("text").cast("string").alias("text"))
    seen = spread(rows).mapInArrow(run, "lang string, size int, cosine double").groupBy("lang", "size").agg(F.count(F.lit(1)).alias("n"), F.avg("cosine").alias("mean"), F.stddev("cosine").alias("deviation"))
    return {(r.lang, r.size): r.mean - FLOOR * r.deviation for r in seen.where(f"n >= {LEAST}").collect()}


def identified(docs: DataFrame, prototypes: dict[str, np.ndarray], least: dict[tuple[str, int], float]) -> DataFrame:
    """The rows, with their columns, whose text is in one of the languages; least: what floors() gives."""
    model = Model(prototypes)
    where = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            got = [model.fitted(t.as_py()) for t in batch.column(where)]
            yield batch.filter(pa.array([lang != "und" and cosine >= least.get((lang, size), -1.0) for lang, _, size, cosine in got]))

    return small_batches(docs).mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = learn(docs.where(~held_out()))
    return predict(docs, prototypes).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
