"""Substring search by an index of trigrams.

Each text's distinct trigrams, in lower case, point to its id. Ids are kept in blocks of BLOCK consecutive ones: a row of the
index is a trigram, a block, and the differences of the sorted places within it, so that a trigram that every text has is many
rows of bounded size. A search reads the rows of its own trigrams only (the index is written in their order, so that Parquet's
statistics drop the rest), keeps the blocks that all of them name, intersects their places, and looks at the texts that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16
GRAM = 3
#: Characters of a text at most.
MOST = (1 << 31) - 1


def _grams(text: Column) -> Column:
    """Distinct trigrams of a text; a shorter one has none.

    They are cut in GRAM passes, each from one of the first places on: a substring for each place would walk to it from the text's start.
    """
    return F.array_distinct(F.concat(*[F.regexp_extract_all(F.substring(text, k, MOST), F.lit(f"(?s).{{{GRAM}}}"), 0) for k in range(1, GRAM + 1)]))


def _differences(places: Column) -> Column:
    return F.transform(places, lambda x, i: x - F.when(i > 0, F.get(places, i - 1)).otherwise(0))


def _unfolded(found: DataFrame) -> DataFrame:
    """Rows of an index with their places, one a row, from the differences."""
    w = Window.partitionBy("gram", "block").orderBy("i")
    rows = found.select("gram", "block", F.posexplode("places").alias("i", "d"))
    return rows.select("gram", "block", F.sum("d").over(w).alias("place"))


def index(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(gram, block, places: differences) of rows with ids from 0; null ids and texts aren't in it."""
    text = F.lower(F.col(text_col))
    each = rows.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.explode(_grams(text)).alias("gram"))
    placed = each.select("gram", F.floor(F.col("id") / BLOCK).cast("bigint").alias("block"), F.pmod(F.col("id"), F.lit(BLOCK)).cast("int").alias("place"))
    return placed.groupBy("gram", "block").agg(F.array_sort(F.collect_set("place")).alias("places")).select("gram", "block", _differences(F.col("places")).alias("places"))


def written(found: DataFrame, path: str) -> DataFrame:
    """An index, written in the order of its trigrams."""
    found.repartitionByRange("gram").sortWithinPartitions("gram", "block").write.mode("overwrite").parquet(path)
    return found.sparkSession.read.schema(found.schema).parquet(path)


def needle_grams(needle: str) -> list[str]:
    low = needle.lower()
    return sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})


def candidates(found: DataFrame, needle: str) -> DataFrame:
    """(id) of texts that have all trigrams of a needle of GRAM characters or more."""
    grams = needle_grams(needle)
    if not grams:
        raise ValueError(f"a needle of {GRAM} characters is needed")
    # A block has a row for each of the needle's trigrams at most; counted beside the rows, so that the index is made or read once.
    mine = found.where(F.col("gram").isin(grams)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("block")))
    met = _unfolded(mine.where(F.col("n") == len(grams))).groupBy("block", "place").agg(F.count(F.lit(1)).alias("n"))
    return met.where(F.col("n") == len(grams)).select((F.col("block") * BLOCK + F.col("place")).alias("id"))


def search(rows: DataFrame, found: DataFrame, needle: str, id_col: str, text_col: str) -> DataFrame:
    """The rows whose text holds the needle, in any case; a needle too short for the index looks at all rows."""
    holds = F.contains(F.lower(F.col(text_col)), F.lit(needle.lower()))
    if len(needle) < GRAM:
        return rows.where(holds)
    ids = candidates(found, needle).withColumnRenamed("id", "_id")
    return rows.join(ids, F.col(id_col).cast("bigint") == F.col("_id"), "left_semi").where(holds)
