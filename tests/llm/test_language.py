import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewarden.llm import language as L

from .texts import HARD, documents, saved

VOCABULARY = {"en": "the of and that with house water thing".split(), "fr": "où été leçon maison eau château élève garçon".split(), "de": "straße über größe haus wasser möchte schön".split()}


def corpus(spark, n=240):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        lang = rng.choice(list(VOCABULARY))
        rows.append((i, " ".join(rng.choice(VOCABULARY[lang]) for _ in range(rng.randint(3, 60))), lang if i % 7 else None, "s", 1))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_bundle_is_the_sum_of_bound_trigrams():
    text = "Über aé"
    letter, _ = L.vectors()
    cells = L.trigrams(text)
    want = sum(np.roll(letter[c // 1600], 2) * np.roll(letter[c // 40 % 40], 1) * letter[c % 40] for c in cells.tolist())
    assert np.allclose(L.bundle(np.bincount(cells, minlength=L.CELLS)), want)
    assert len(L.trigrams("12 !?")) == 0 and len(L.trigrams("a")) == 1


def test_held_out_accuracy_and_contract(spark, tmp_path):
    docs = corpus(spark)
    sf = saved(spark, tmp_path, documents=docs)
    rows = L.query(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 240
    held = [r for r in rows if r.held_out and r.lang]
    assert len(held) > 30 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_rows_are_not_used(spark, tmp_path):
    docs = corpus(spark)
    a = L.query(spark, saved(spark, tmp_path / "a", documents=docs))
    spoiled = docs.withColumn("lang", F.when(L.held_out(), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("z"))
    b = L.query(spark, saved(spark, tmp_path / "b", documents=spoiled))
    assert sorted(a.collect()) == sorted(b.collect())


def test_hard_texts_nulls_and_empty_tables(spark, tmp_path):
    docs = documents(spark, extra=True)
    model = L.learn(corpus(spark))
    rows = {r.doc_id: r for r in L.predict(docs.union(docs), model).collect()}
    assert L.predict(docs.union(docs), model).count() == 2 * len(HARD)
    for i, t in enumerate(HARD):
        has = any(c.isalpha() for c in t or "")
        assert (rows[i].lang_pred == "und") == (not has)
    kept = L.identified(docs, model, {})
    assert kept.columns == docs.columns and kept.count() == sum(any(c.isalpha() for c in t or "") for t in HARD)
    none = L.learn(docs.where("false"))
    assert none == {} and {r.lang_pred for r in L.predict(docs, none).collect()} == {"und"}
    assert L.predict(docs.where("false"), model).count() == 0
    assert L.query(spark, saved(spark, tmp_path, documents=docs.where("false"))).count() == 0


def test_texts_in_no_learned_language_go(spark):
    docs = corpus(spark, 1500)
    model = L.learn(docs)
    least = L.floors(docs, model)
    assert {lang for lang, _ in least} == set(VOCABULARY)
    rng = random.Random(3)
    junk = ["".join(rng.choice("qxzjkvwy ") for _ in range(200)), " ".join("zxqj" for _ in range(40)), "привет мир как дела сегодня " * 6, "12 % a 34 % b 56 !! c " * 9, None, "!!!"]
    clean = ["the water and the house", "die straße über das große haus " * 4, "où été maison château " * 3]
    mixed = spark.createDataFrame([(i, t) for i, t in enumerate(junk + clean)], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in L.identified(mixed, model, least).collect()) == [6, 7, 8]
    labelled = docs.where("lang is not null")
    assert L.identified(labelled, model, least).count() == labelled.count()


@pytest.mark.parametrize("seed", range(3))
def test_counts_of_all_training_rows(spark, seed):
    docs = corpus(spark, 50)
    want = {}
    for r in docs.where("lang is not null").collect():
        want.setdefault(r.lang, np.zeros(L.CELLS))
        np.add.at(want[r.lang], L.trigrams(r.text), 1)
    got = L.learn(docs)
    assert set(got) == set(want)
    for lang, counts in want.items():
        assert np.allclose(got[lang], L._unit(L.bundle(counts / counts.sum()).astype(float)), atol=1e-5)
