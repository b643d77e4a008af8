"""Texts that are hard for the operators, and helpers of their tests."""

HARD = [
    None,
    "",
    " ",
    "   \n\t ",
    "a",
    "hello world",
    "  two  spaces   and\n\nlines \n x",
    "tabs\tand\r\nreturns    nbsp em \x1c fs \x85 nel",
    "it's we're they'll I'd 'tis 'r 'e  'll",
    "Größe über ñandú 中文字符没有空格 日本語 한국어 emoji 👩‍👩‍👧 é ́",
    "12345678901234567890 3.14 1,000,000",
    "<|endoftext|> inside <|endoftext|><|startoftext|> <|endoftext",
    "$$$ %%% ### &&& *** !!! ~~~~~~~~~~",
    "a" * 3000,
    "ab" * 2500 + " " + "x" * 700,
    " " * 500 + "end",
    "word " * 2000,
    "\u0000null\u0007bell",
    "ΑΣ ΣΑΣ İstanbul ſ K",
    "repeat the line\n" * 50,
]


def documents(spark, texts=HARD, extra=False):
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    if extra:
        from pyspark.sql import functions as F

        for name in ("id", "key", "ids", "items", "words", "hash", "score"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def saved(spark, folder, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
