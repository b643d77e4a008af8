import hashlib
import random
import re

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as C
from pagewarden.llm import secrets
from pagewarden.llm.bpe import ranks_of

from .test_decontaminate import brute as contaminated
from .test_near_dup import brute as grouped
from .texts import HARD, saved


def corpus():
    rng = random.Random(8)
    vocabulary = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    item = text(14)
    rows = [(i, t) for i, t in enumerate(HARD)]
    for k in range(40):
        w = text(rng.randint(8, 60))
        if k % 5 == 0:
            w[3:3] = item
        if k % 7 == 0:
            w[2:2] = ['token = "0123456789abcdef0123456789abcdef01234567"']
        rows.append((100 + 3 * k, " ".join(w)))
        if k % 4 == 0:
            rows.append((101 + 3 * k, " ".join(w).replace(" ", ", ")))
    return rows, [(1, " ".join(item)), (2, None)]


def test_stages_take_effect_and_agree_with_brute_force(spark, tmp_path):
    rows, items = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    sf = saved(spark, tmp_path, documents=docs, benchmark=spark.createDataFrame(items, "item_id bigint, text string"))
    assert [name for name, _ in C.STAGES] == ["language", "near_duplicates", "decontamination", "secrets", "tokens"]

    one = C.STAGES[0][1](spark, docs, sf).collect()
    assert {r.doc_id for r in one} <= {i for i, t in rows if any(c.isalpha() for c in t or "")}
    assert {r.doc_id for r in one} >= {i for i, t in rows if i >= 100}
    left = [(r.doc_id, r.text) for r in one]
    left = [(i, t) for i, t in left if (i, i) in set(grouped(left))]
    hit = contaminated(left, items)
    left = [(i, secrets.redacted(t)) for i, t in left if not hit[i][1]]
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks_of(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = sorted((i, len(known.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in left)
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in C.run(spark, sf).collect()) == want
    assert any("[SECRET]" in t for _, t in left) and len(left) < len(one)


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    rows, items = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("key", F.lit("clash"))
    sf = saved(spark, tmp_path, benchmark=spark.createDataFrame(items, "item_id bigint, text string"))
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        assert stage(spark, docs.where("false"), sf).count() == 0, name
    masked = C.secret_stage(spark, docs, sf).where("text like '%[SECRET]%'").collect()
    assert masked and all(r.n_chars == len(r.text) and not re.search("[0-9a-f]{32}", r.text) for r in masked)
