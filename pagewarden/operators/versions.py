"""Versions of a page: hashes of what doesn't change at each load, and the parts that changed between two versions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.sources import dom


def content_hashes(pages: DataFrame, keys: Iterable[str], *, selector: str = "", volatile_selectors: Iterable[str] = (), volatile_attributes: Iterable[str] = (), patterns: Iterable[str] = (), html_col: str = "html") -> DataFrame:
    """(keys, content_hash, hash_scope, removed): a SHA-256 of the part of each page that the selector scopes, after patterns were taken out.

    hash_scope is the selector, or dom.FULL if nothing fits it. removed tells what was left out: selectors, ``@attribute``, ``pattern:...`` of those
    that were found, ``invalid-pattern:...``. Null HTML has a null hash.
    """
    keys = list(keys)
    rows = dom.content(pages, keys, html_col=html_col, selector=selector, volatile_selectors=volatile_selectors, volatile_attributes=volatile_attributes)
    text, told = F.col("content"), [F.col("removed")]
    for p in patterns:
        try:
            re.compile(p)
        except re.error:
            told.append(F.array(F.lit("invalid-pattern:" + p)))
            continue
        told.append(F.when(text.rlike(p), F.array(F.lit("pattern:" + p))).otherwise(F.array().cast("array<string>")))
        text = F.regexp_replace(text, p, "")
    return rows.select(*keys, F.sha2(text, 256).alias("content_hash"), F.col("scope").alias("hash_scope"), F.array_sort(F.array_distinct(F.concat(*told))).alias("removed"))


def changed_subtrees(old: DataFrame, new: DataFrame, keys: Iterable[str]) -> DataFrame:
    """(keys, status, tag, location, before, after) of the parts that differ between two versions of the pages in both, each parsed with digests=True.

    added, removed: the topmost element of a subtree that only one version has, at its place among those of its tag; changed: an element whose own tag,
    attributes, texts or order of children differ. An element that only holds changed ones is not among them. Pages whose roots have equal digests
    are dropped before their elements are looked at; a page's two versions meet once, by its keys, and nothing is shuffled after that but the few differences.
    """
    keys = list(keys)
    roots = lambda c: F.transform(F.filter(c, lambda e: e["parent"] == -1), lambda e: e["digest"])
    slim = lambda df, name: df.select(*keys, F.transform("elements", lambda e: F.struct(*[e[c].alias(c) for c in ("place", "up", "own", "digest", "tag", "nth", "own_text")])).alias(name), roots(F.col("elements")).alias(name + "_roots"))
    both = slim(old, "old").join(slim(new, "new"), keys).where("old_roots <> new_roots")
    side = lambda name, is_new: F.transform(name, lambda e: F.struct(e.alias("e"), F.lit(is_new).alias("is_new")))
    rows = both.select(*keys, F.explode(F.concat(side("old", False), side("new", True))).alias("x")).select(*keys, "x.*")
    one = lambda flag: F.max(F.when(F.col("is_new") == flag, F.col("e")))
    paired = rows.groupBy(*keys, F.col("e.place").alias("place")).agg(one(False).alias("a"), one(True).alias("b"))
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a.own") != F.col("b.own"), "changed")
    e = F.coalesce("b", "a")
    found = paired.withColumn("status", status).where("status is not null").select(*keys, "place", "status", e["up"].alias("up"), e["tag"].alias("tag"), F.concat(e["tag"], F.lit("["), e["nth"].cast("string"), F.lit("]")).alias("location"), F.col("a.own_text").alias("before"), F.col("b.own_text").alias("after"))
    whole = found.where("status <> 'changed'").select(*keys, F.col("place").alias("up"), "status")
    return found.join(whole, [*keys, "up", "status"], "left_anti").select(*keys, "status", "tag", "location", "before", "after")

