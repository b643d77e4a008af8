import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewarden.llm import quality as Q
from pagewarden.llm.language import held_out

from .texts import HARD, documents, saved


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    m = Q.Machine()
    i = rng.choice(2**Q.BITS, 9, replace=False)
    x = rng.normal(size=9).astype(np.float32)
    m.linear[i] = rng.normal(size=9)
    m.factors[i] = rng.normal(size=(9, Q.FACTORS))
    pairs = sum((m.factors[i[a]] @ m.factors[i[b]]) * x[a] * x[b] for a in range(9) for b in range(a))
    assert m.raw(i, x)[0] == pytest.approx(m.bias + m.linear[i] @ x + pairs, rel=1e-4)


def test_held_out_accuracy_on_given_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = Q.query(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and auc([(r.score, r.quality) for r in rows]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_labels_of_held_out_rows_lang_source_are_not_used(spark, tmp_path):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, ("fine plain words here " if i % 3 else "!! ## $$ ") * rng.randint(1, 9), "en", "s", 9) for i in range(90)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 > 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    a = Q.query(spark, saved(spark, tmp_path / "a", documents=docs, labels=labels)).collect()
    spoiled = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    b = Q.query(spark, saved(spark, tmp_path / "b", documents=docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")), labels=spoiled)).collect()
    assert sorted(a) == sorted(b) and len(a) == 90
    assert auc([(r.score, r.doc_id % 3 > 0) for r in a]) == 1.0


def test_nulls_empty_tables_and_clashes(spark, tmp_path):
    docs = documents(spark, extra=True).withColumn("n_chars", F.when(F.col("doc_id") > 3, F.col("n_chars")))
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = Q.query(spark, saved(spark, tmp_path, documents=docs.union(docs), labels=none)).collect()
    assert len(rows) == 2 * len(HARD) and {(r.score, r.predicted) for r in rows} == {(0.5, 0)}
    some = spark.createDataFrame([(5, 1, 0), (12, 0, 1), (5, 0, 0), (6, None, None), (None, 1, 1), (999, 1, 0)], "doc_id bigint, quality int, toxic int")
    machine = Q.fit(docs, some)
    assert machine.fitted and Q.score(docs, machine).where("score between 0 and 1").count() == len(HARD)
    assert Q.score(docs.where("false"), machine).count() == 0
