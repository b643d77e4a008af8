"""Inventory of URLs: discovery, merging of occurrences, comparison of runs."""

from __future__ import annotations

import zlib
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewarden.functions import terms as T
from pagewarden.functions import urls as U

SETS = ("original_urls", "discovery_sources", "menu_paths", "discovered_from", "titles", "link_texts")
REQUEST_LIMIT = "요청 상한 도달"
MERGED_ROUNDS = 8
COMPARED = ("titles", "link_texts", "menu_paths", "discovery_sources", "discovered_from", "classification", "other_target_id")


def classified(occurrences: DataFrame, targets: DataFrame, policy: U.Policy = U.Policy(), *, plain: bool = False) -> DataFrame:
    """occurrences (target_id, original_url, discovered_from, ...) with normalized_url, classification, other_target_id, removed.

    targets: (target_id, base_url, allowed_domains array). plain: all URLs are absolute ASCII, so no Python is needed.
    The targets' hosts are few and configured by hand; the join is left to the optimizer.
    """
    hosts = F.array_union(F.array(U.host(F.col("base_url"))), F.transform(F.coalesce("allowed_domains", F.array().cast("array<string>")), F.lower))
    own = targets.select("target_id", "base_url", hosts.alias("hosts"))
    rows = occurrences.join(own, "target_id", "left")
    base = F.when(F.coalesce("discovered_from", F.lit("")) == "", F.col("base_url")).otherwise(F.col("discovered_from"))
    rows = rows.withColumn("n", F.struct(U.normalize(F.col("original_url"), policy).alias("url"), F.array().cast("array<string>").alias("removed")) if plain else U.normalize_any(F.col("original_url"), base, policy))
    kind = U.kind(F.col("original_url"), F.col("n.url"), F.coalesce("hosts", F.array().cast("array<string>")), policy)
    rows = rows.withColumn("classification", kind).withColumn("host", U.host(F.col("n.url")))
    managed = own.select(F.col("target_id").alias("other"), F.explode("hosts").alias("host")).groupBy("host").agg(F.min("other").alias("other"))
    rows = rows.join(managed, "host", "left")
    other = F.when((F.col("classification") == "external"), F.col("other"))
    return rows.select(*occurrences.columns, F.col("n.url").alias("normalized_url"), "classification", other.alias("other_target_id"), F.col("n.removed").alias("removed"))


def merged(rows: DataFrame) -> DataFrame:
    """One record a target and normalized URL; URLs that aren't one are keyed by kind and text."""
    text = lambda c: F.array_sort(F.collect_set(F.coalesce(c, F.lit(""))))
    key = F.coalesce("normalized_url", F.concat_ws(":", "classification", F.coalesce("original_url", F.lit(""))))
    return rows.groupBy("target_id", key.alias("normalized_url")).agg(
        F.min("classification").alias("classification"),
        F.min("other_target_id").alias("other_target_id"),
        text("original_url").alias("original_urls"),
        text("source").alias("discovery_sources"),
        text("menu_path").alias("menu_paths"),
        text("discovered_from").alias("discovered_from"),
        text("title").alias("titles"),
        text("title").alias("link_texts"),
        F.min("discovered_at").alias("first_discovered_at"),
        F.max("discovered_at").alias("last_discovered_at"),
        F.count(F.lit(1)).alias("occurrences"),
    )


def stats(records: DataFrame) -> DataFrame:
    """Counts of merged records by kind, and how many occurrences fell together."""
    n = lambda k: F.count_if(F.col("classification") == k).alias(k)
    return records.groupBy("target_id").agg(F.sum("occurrences").alias("original_url_count"), F.count(F.lit(1)).alias("normalized_url_count"), (F.sum("occurrences") - F.count(F.lit(1))).alias("duplicate_removed_count"), *[n(k) for k in ("internal", "external", "invalid", "non_http")])


def health(sources: DataFrame, max_requests: int | None = None) -> DataFrame:
    """(target_id, healthy, reason) from (target_id, source, success, request_count)."""
    failed = F.array_sort(F.collect_set(F.when(~F.coalesce("success", F.lit(False)), F.coalesce("source", F.lit("unknown")))))
    out = sources.groupBy("target_id").agg(failed.alias("failed"), F.max("request_count").alias("requests"))
    full = F.lit(False) if max_requests is None else F.coalesce(F.col("requests") >= max_requests, F.lit(False))
    reason = F.when(F.size("failed") > 0, F.concat(F.lit("수집원 실패: "), F.array_join("failed", ", "))).when(full, REQUEST_LIMIT)
    return out.select("target_id", reason.isNull().alias("healthy"), reason.alias("reason"))


def changes(before: Column, after: Column, fields=COMPARED) -> Column:
    """Array of (field, previous, current) of the fields that differ, of two structs of a record."""
    text = lambda s, f: F.to_json(F.struct(s[f].alias("v")))
    rows = [F.struct(F.lit(f).alias("field"), text(before, f).alias("previous"), text(after, f).alias("current")) for f in fields]
    return F.filter(F.array(*rows), lambda r: ~r["previous"].eqNullSafe(r["current"]))


def compared(previous: DataFrame, current: DataFrame, healths: DataFrame, fields=COMPARED) -> DataFrame:
    """A full outer join of two runs' records: (target_id, normalized_url, status, changed_fields, reason). Kept URLs are among the rows.

    A URL that is missing while a source failed is only unsure to be deleted.
    """
    held = lambda df, name: df.select("target_id", "normalized_url", F.struct(*fields).alias(name))
    rows = held(previous, "old").join(held(current, "new"), ["target_id", "normalized_url"], "full_outer").join(healths, "target_id", "left")
    healthy = F.coalesce("healthy", F.lit(False))
    reason = F.when(~healthy, F.coalesce("reason", F.lit("수집원 상태 정보 없음")))
    diff = F.when(F.col("old").isNotNull() & F.col("new").isNotNull(), changes(F.col("old"), F.col("new"), fields))
    status = F.when(F.col("old").isNull(), T.ADDED).when(F.col("new").isNull(), F.when(healthy, T.DELETED).otherwise(T.DELETION_UNSURE)).when(F.size(diff) > 0, T.CHANGED).otherwise(T.KEPT)
    return rows.select("target_id", "normalized_url", status.alias("status"), F.when(F.size(diff) > 0, diff).alias("changed_fields"), F.when(F.col("new").isNull(), reason).alias("reason"))


def outside_menu(current: DataFrame, healths: DataFrame) -> DataFrame:
    """Internal URLs that only a sitemap names; where sources failed, one row says that this can't be told."""
    only = current.where((F.col("classification") == "internal") & (F.size(F.array_except("discovery_sources", F.array(F.lit("sitemap")))) == 0)).join(healths, "target_id", "left")
    healthy = F.coalesce("healthy", F.lit(False))
    sure = only.where(healthy).select("target_id", "normalized_url", F.lit(T.OUTSIDE_MENU).alias("status"))
    unsure = only.where(~healthy).select("target_id", F.lit(None).cast("string").alias("normalized_url"), F.lit(T.MENU_UNSURE).alias("status")).distinct()
    return sure.unionByName(unsure)


def comparison_status(previous_header: DataFrame, current_header: DataFrame, healths: DataFrame) -> DataFrame:
    """(target_id, status, baseline_updated) by target from headers (target_id, schema_version, policy_fingerprint)."""
    old = previous_header.select("target_id", F.col("schema_version").alias("old_schema"), F.col("policy_fingerprint").alias("old_policy"), F.lit(True).alias("had"))
    rows = current_header.join(old, "target_id", "left").join(healths, "target_id", "left")
    same = F.col("old_schema").eqNullSafe(F.col("schema_version")) & F.col("old_policy").eqNullSafe(F.col("policy_fingerprint"))
    healthy = F.coalesce("healthy", F.lit(False))
    status = F.when(F.col("had").isNull(), T.BASELINE_MADE).when(~same | ~healthy, T.INCOMPARABLE).otherwise(T.COMPARED)
    return rows.select("target_id", status.alias("status"), (F.col("had").isNull() | (same & healthy)).alias("baseline_updated"))


def comparable(previous_header: DataFrame, current_header: DataFrame) -> DataFrame:
    """(target_id) of targets without an earlier record, or with one of the same schema and policy, whatever their sources' health."""
    old = previous_header.select("target_id", F.struct("schema_version", "policy_fingerprint").alias("old"))
    rows = current_header.join(old, "target_id", "left")
    return rows.where(F.col("old").isNull() | F.col("old").eqNullSafe(F.struct("schema_version", "policy_fingerprint"))).select("target_id").distinct()


def first_occurrences(occurrences: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in that order. Minima combine before the shuffle, so a key found everywhere is no hot group."""
    rest = [c for c in occurrences.columns if c not in key and c not in order]
    least = F.min(F.struct(*order, *rest)).alias("least")
    return occurrences.groupBy(*key).agg(least).select(*[F.col(c) if c in key else F.col(f"least.`{c}`").alias(c) for c in occurrences.columns])


def reachable(edges: DataFrame, roots: DataFrame, *, max_depth: int | None = None) -> DataFrame:
    """(url, depth: least number of links from a root) over edges (src, dst), breadth first, up to max_depth if there is one.

    Each round only extends the frontier, and drops what was seen by an anti join. What was seen is one table and
    the rounds since it was written, MERGED_ROUNDS at most, so that a round of a long chain doesn't read all before it one by one. Lineage is
    cut by writing each round to the shared checkpoint folder; a session in local mode may do without.
    """
    context = edges.sparkSession.sparkContext
    folder = edges.sparkSession.conf.get("spark.checkpoint.dir", None)
    if folder and context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    if context.getCheckpointDir() is None and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    cut = (lambda df: df.checkpoint()) if context.getCheckpointDir() else (lambda df: df.persist())
    frontier = cut(roots.select(F.col("url"), F.lit(0).alias("depth")).distinct())
    seen, parts, depth = frontier, 1, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = edges.join(frontier.select(F.col("url").alias("src")), "src", "left_semi").select(F.col("dst").alias("url")).distinct()
        frontier = cut(step.join(seen, "url", "left_anti").select("url", F.lit(depth).alias("depth")))
        if frontier.isEmpty():
            break
        seen, parts = seen.unionByName(frontier), parts + 1
        if parts > MERGED_ROUNDS:
            seen, parts = cut(seen), 1
    return seen


def _sitemap(pieces) -> list[tuple[str, str]]:
    """(kind, loc) of a sitemap's entries, read piece by piece; ValueError if it isn't whole XML of that kind."""
    parser = expat.ParserCreate()  # prefixes stay as written, declared or not
    out: list[tuple[str, str]] = []
    path: list[str] = []
    held: list[str] = []

    def start(name, _):
        path.append(name.rpartition(":")[2])
        if len(path) == 1 and path[0] not in ("urlset", "sitemapindex"):
            raise ValueError(f"no sitemap: <{path[0]}>")
        held.clear()

    def end(_):
        if len(path) == 3 and path[2] == "loc" and path[1] in ("url", "sitemap") and (loc := "".join(held).strip()):
            out.append(("page" if path[1] == "url" else "sitemap", loc))
        path.pop()

    def entity(*_):
        raise ValueError("a sitemap declares no entities")

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.EntityDeclHandler = start, end, held.append, entity
    try:
        for piece in pieces:
            parser.Parse(piece, False)
        parser.Parse(b"", True)
    except expat.ExpatError as e:
        raise ValueError(str(e)) from e
    return out


def _unpacked(body: bytes, most: int, step: int = 1 << 20):
    """A body in pieces; one in gzip form is unpacked piece by piece, up to so many bytes."""
    if body[:2] != b"\x1f\x8b":
        for i in range(0, len(body), step):
            yield body[i : i + step]
        return
    gzip, rest, n = zlib.decompressobj(31), body, 0
    while rest and not gzip.eof:
        piece = gzip.decompress(rest, step)
        n += len(piece)
        if n > most:
            raise ValueError(f"more than {most} bytes")
        rest = gzip.unconsumed_tail
        yield piece
        if not piece and not rest:
            break
    if not gzip.eof:
        raise ValueError("the gzip form ends early")


#: What a sitemap may have unpacked.
MOST_SITEMAP_BYTES = 52_428_800


def sitemap_entries(responses: DataFrame) -> DataFrame:
    """(url, kind, loc, error) of sitemap XML in (url, text, and maybe body: bytes, also in gzip form): a row an entry (page, or a further sitemap), or one with an error for a sitemap that can't be read.

    A sitemap is read by an incremental parser; its entries count once all of it was read. Answers that are no sitemap have no rows.
    """
    body = F.col("body") if "body" in responses.columns else F.lit(None).cast("binary")
    text = F.col("text").cast("string")
    packed = F.hex(F.substring(body, 1, 2)) == "1F8B"
    named = F.coalesce(text, F.substring(body, 1, 4000).cast("string")).rlike(r"<(?:\w+:)?(urlset|sitemapindex)\b")
    rows = responses.select("url", F.when(packed | text.isNull(), body).otherwise(F.encode(F.regexp_replace(text, r"^\s*<\?xml[^>]*\?>", ""), "UTF-8")).alias("source"), (F.coalesce(packed, F.lit(False)) | F.coalesce(named, F.lit(False))).alias("is_map"))

    def run(batches):
        for batch in batches:
            for url, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    found, error = _sitemap(_unpacked(source.as_py() or b"", MOST_SITEMAP_BYTES)), None
                except (ValueError, zlib.error) as e:
                    found, error = [(None, None)], str(e)
                yield pa.RecordBatch.from_arrays([pa.array([url] * len(found), pa.string()), pa.array([k for k, _ in found], pa.string()), pa.array([loc for _, loc in found], pa.string()), pa.array([error] * len(found), pa.string())], names=["url", "kind", "loc", "error"])

    return rows.where("is_map").select("url", "source").mapInArrow(run, "url string, kind string, loc string, error string")


def sitemap_urls(responses: DataFrame) -> DataFrame:
    """(url, kind, loc) of sitemap_entries(). XML that can't be read has no rows."""
    return sitemap_entries(responses).where("error is null").select("url", "kind", "loc")


def sitemap_pages(responses: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(target_id, url, loc): page entries of sitemaps, following the entries of indexes, also around cycles.

    responses: (target_id, url, text). roots: (url) of the first sitemaps; without them, those that no index names.
    """
    entries = sitemap_urls(responses.select("url", "text", *(["body"] if "body" in responses.columns else [])))
    edges = entries.where("kind = 'sitemap'").select(F.col("url").alias("src"), F.col("loc").alias("dst")).distinct()
    if roots is None:
        roots = entries.select("url").distinct().join(edges.where("src <> dst").select(F.col("dst").alias("url")), "url", "left_anti")
    read = reachable(edges, roots)
    pages = entries.where("kind = 'page'").join(read.select("url"), "url", "left_semi").select("url", "loc")
    return pages.join(responses.select("target_id", "url").distinct(), "url").select("target_id", "url", "loc")


def sitemap_status(sources: DataFrame) -> DataFrame:
    """(target_id, status, reason) of each target's sitemap, from sources (target_id, source, kind, success, reason); its first one counts."""
    maps = F.min(F.when(F.col("kind") == "sitemap", F.struct("source", "success", "reason")))
    rows = sources.groupBy("target_id").agg(maps.alias("m"))
    return rows.select("target_id", F.when(F.col("m.success"), T.OK).otherwise(T.UNCHECKABLE).alias("status"), F.when(F.col("m").isNull(), "기존 sitemap 수집 결과 없음").otherwise(F.col("m.reason")).alias("reason"))


def upgraded(records: DataFrame) -> DataFrame:
    """Records of an older state with a schema_version: "legacy" where they have none. All fields stay."""
    return records if "schema_version" in records.columns else records.withColumn("schema_version", F.lit("legacy"))


def menu(pages: DataFrame, keys: list[str], selector: str = "nav a, header a") -> DataFrame:
    """Menu links of pages that were parsed with the selector: (keys, seq, href, title, menu_path). The path joins the labels of the list items around, the outermost first."""
    from pagewarden.sources.dom import attribute, first, fits, having, inside, let, text_of

    els, fit = F.col("elements"), fits(pages)
    links = having(lambda e: fit(e, selector) & attribute(e, "href").isNotNull(), els)
    anchors = having(lambda e: e["tag"] == "a", els)
    label = lambda i, of: let(first(F.filter(of, lambda a: a["parent"] == i["seq"])), lambda a: F.coalesce(text_of(a), i["own_text"]))
    items = let(anchors, lambda of: F.transform(having(lambda e: e["tag"] == "li", els), lambda i: F.struct(i["seq"].alias("seq"), i["end"].alias("end"), label(i, of).alias("label"))))
    around = lambda a, many: F.array_join(F.transform(F.filter(many, lambda i: inside(a, i) & (i["label"] != "")), lambda i: i["label"]), " > ")
    rows = let(items, lambda many: F.transform(links, lambda a: F.struct(a["seq"].alias("seq"), attribute(a, "href").alias("href"), text_of(a).alias("title"), around(a, many).alias("menu_path"))))
    return pages.select(*keys, F.explode(rows).alias("m")).select(*keys, "m.*")
