"""One run over the answers of a site's pages: from discovery to verdicts, issues and report, as lazy tables."""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.functions import checks as C
from pagewarden.functions import terms as T
from pagewarden.functions import urls as U
from pagewarden.operators import inventory as I
from pagewarden.operators import rules as R
from pagewarden.operators import verdicts as V
from pagewarden.operators import versions as VS
from pagewarden.sources import dom
from pagewarden.sources.state import State, state_payload

KEYS = ["target_id", "url"]
RECORD = "target_id string, normalized_url string, classification string, other_target_id string, original_urls array<string>, discovery_sources array<string>, menu_paths array<string>, discovered_from array<string>, titles array<string>, link_texts array<string>, first_discovered_at timestamp, last_discovered_at timestamp, occurrences bigint"
ISSUE = "issue_key string, target_id string, page_url string, check_code string, result string, reason string, evidence string, severity string, lifecycle_status string, manual_status string, first_seen timestamp, last_seen timestamp, discovery_count int, recurred_count int, changed_fields array<string>, blocked_reason string, history array<struct<at: timestamp, status: string>>"
HEADER = "target_id string, schema_version string, policy_fingerprint string"
ATTACHMENT = "normalized_url string, policy_version string, content_hash string, filename string, link_text string, verdict string, next_recheck_date date"
A11Y = "target_id string, url string, content_hash string, hash_scope string, removed array<string>, policy_version string, last_result string"
A11Y_ISSUE = "target_id string, url string, code string, result string, severity string, element string, location string, evidence string, manual boolean, issue_key string"
SCREENSHOT = "issue_key string, content_hash string, evidence string, policy_version string"
SCHEMA_VERSION = "1.0"
OK, PARTIAL, FAILED = 0, 2, 1
#: Tables of a state and their columns; each run reads them and saves them anew.
TABLES = {"inventory": RECORD, "issues": ISSUE, "header": HEADER, "attachments": ATTACHMENT, "a11y": A11Y, "a11y_issues": A11Y_ISSUE, "screenshots": SCREENSHOT}


@dataclass
class Run:
    inventory: DataFrame
    health: DataFrame
    comparison: DataFrame
    header: DataFrame
    baseline: DataFrame
    diff: DataFrame
    outside: DataFrame
    freshness: DataFrame
    lists: DataFrame
    resources: DataFrame
    attachments: DataFrame
    issues: DataFrame
    a11y: DataFrame
    performance: DataFrame
    pages: DataFrame
    lifecycle: DataFrame
    screenshots: DataFrame
    coverage: DataFrame
    missing: DataFrame
    summary: DataFrame
    sitemaps: DataFrame
    accounts: dict[str, DataFrame]
    held: list[DataFrame]

    def release(self) -> None:
        """Lets go of the tables that a run keeps for its results; to be called when these were written."""
        for df in self.held:
            df.unpersist()


def loaded(state: State) -> dict[str, DataFrame]:
    """The tables of the last run, empty ones at first."""
    return {name: state.load(name, schema) for name, schema in TABLES.items()}


def menu_selectors(rules: Mapping[str, Any]) -> tuple[str, str]:
    """Of the main menu and of the whole menu."""
    return ", ".join(rules.get("menu_selectors", ["nav a", "header a"])), ", ".join(rules.get("all_menu_selectors", ["a"]))


def own_selectors(targets: DataFrame) -> DataFrame:
    """(target_id, own_names, own_selectors) of each target's configured selectors of dates (date.<kind>, all of them) and lists (list.<part>, the first)."""
    kind = "map<string,array<string>>"
    held = {c: F.coalesce(F.col(c).cast(kind), F.create_map().cast(kind)) if c in targets.columns else F.create_map().cast(kind) for c in ("date_selectors", "list_selectors")}
    rows = lambda name, c, many: F.flatten(F.transform(F.map_entries(c), lambda e: F.transform(many(e["value"]), lambda s: F.struct(F.concat(F.lit(name), e["key"]).alias("n"), s.alias("s")))))
    both = F.concat(rows("date.", held["date_selectors"], lambda v: v), rows("list.", held["list_selectors"], lambda v: F.slice(v, 1, 1)))
    return targets.select("target_id", both.alias("x")).select("target_id", F.transform("x", lambda x: x["n"]).alias("own_names"), F.transform("x", lambda x: x["s"]).alias("own_selectors"))


def found_in_menus(parsed: DataFrame, rules: Mapping[str, Any], at: dt.datetime) -> DataFrame:
    """Links of the main menu of all pages, and of the whole menu on the pages that are named for it (all_menu_paths)."""
    row = lambda links, source: links.select("target_id", F.col("href").alias("original_url"), F.lit(source).alias("source"), "menu_path", F.col("url").alias("discovered_from"), "title", F.lit(at).alias("discovered_at"))
    main = row(I.menu(parsed, KEYS, menu_selectors(rules)[0]), "main_menu")
    paths = [str(p) for p in rules.get("all_menu_paths", ())]
    if not paths:
        return main
    return main.unionByName(row(I.menu(parsed.where(U.path(F.col("url")).isin(paths)), KEYS, menu_selectors(rules)[1]), "all_menu"))


def crawled(parsed: DataFrame, targets: DataFrame, at: dt.datetime) -> DataFrame:
    """Links within a site, breadth first from its first page along the pages that were read."""
    base = targets.select("target_id", F.col("base_url").alias("base"))
    links = R.references(parsed, KEYS, F.col("url")).where("kind = 'link'").select(*KEYS, "text", U.local(F.col("url"), F.col("original_url")).alias("dst")).where("dst is not null")
    bare = lambda c: F.regexp_replace(c, r"/+$", "")
    reached = I.reachable(links.select(bare("url").alias("src"), bare("dst").alias("dst")).distinct(), base.select(bare("base").alias("url")))
    rows = links.withColumn("at", bare("url")).join(reached.select(F.col("url").alias("at")), "at", "left_semi")
    return rows.select("target_id", F.col("dst").alias("original_url"), F.lit("internal_crawl").alias("source"), F.lit("").alias("menu_path"), F.col("url").alias("discovered_from"), F.coalesce("text", F.lit("")).alias("title"), F.lit(at).alias("discovered_at"))


def checked_attachments(refs: DataFrame, cache: DataFrame, today, policy: str, force: bool) -> DataFrame:
    """One row an attachment: what is known of it now, and the cached verdict where that still holds."""
    name = F.regexp_extract("normalized_url", r"([^/?#]*)(?:[?#].*)?$", 1)
    one = refs.where("kind = 'attachment'").groupBy("normalized_url").agg(F.min(F.coalesce("text", F.lit(""))).alias("link_text"))
    one = one.select("normalized_url", F.lit("").alias("content_hash"), name.alias("filename"), "link_text")
    decided = R.attachment_decisions(one, cache, today, policy, force)
    return decided.join(cache.select("normalized_url", F.col("verdict").alias("old_verdict"), "next_recheck_date"), "normalized_url", "left")


def run(responses: DataFrame, targets: DataFrame, *, rules: Mapping[str, Any], exclusions: Mapping[str, Any], at: dt.datetime, old: Mapping[str, DataFrame] | None = None, crawl: bool = False, force: bool = False) -> Run:
    """responses: target_id and the columns of a transport's answers; the elements of all pages are parsed once.

    old: the tables of the last run (loaded()). Pages under excluded paths count as excluded. Sources are the pages
    that were asked for: one that failed keeps its target's URLs from being reported as deleted and its issues from
    being resolved; other targets go on. Pages whose content is that of a checked one keep its accessibility issues,
    attachments whose cached check still holds keep their verdict. force: caches don't count.
    """
    spark = responses.sparkSession
    old = {name: (old or {}).get(name) if (old or {}).get(name) is not None else spark.createDataFrame([], schema) for name, schema in TABLES.items()}
    policy = U.Policy.of(exclusions)
    fresh, perf, access, kept = (rules.get(k, {}) for k in ("freshness", "performance", "accessibility", "resources"))
    reference = F.lit(at.date())
    accounts: dict[str, DataFrame] = {}
    held: list[DataFrame] = []

    def kept_for_all(df: DataFrame) -> DataFrame:
        held.append(df.persist())
        return held[-1]

    def counted(df: DataFrame, stage: str, failed) -> DataFrame:
        out = kept_for_all(df)
        accounts[stage] = out.agg(F.lit(stage).alias("stage"), F.count(F.lit(1)).alias("processed"), F.count_if(failed).alias("failed"))
        return out

    # One form of each URL, for all joins.
    normal = U.normalize_any(F.col("url"), F.lit(None).cast("string"), policy)
    responses = kept_for_all(responses.withColumn("normalized_url", F.coalesce(normal["url"], F.col("url"))))
    pages = responses.where("html is not null").select(*KEYS, "normalized_url", "html", *[F.col(c) if c in responses.columns else F.lit(default).alias(c) for c, default in (("page_type", "unknown"), ("list_type", ""))])
    pages = pages.join(own_selectors(targets), "target_id", "left")
    parsed = kept_for_all(dom.parsed(pages, [*KEYS, "page_type", "list_type", "own_names"], own="own_selectors", selectors=[*menu_selectors(rules), *(s for many in (fresh.get("date_selectors") or {}).values() for s in many)]))

    found = found_in_menus(parsed, rules, at)
    if crawl:
        found = found.unionByName(crawled(parsed, targets, at))
    sitemap = I.sitemap_pages(responses.select("target_id", "url", F.col("html").alias("text"), "body"))
    sitemap = sitemap.select("target_id", F.col("loc").alias("original_url"), F.lit("sitemap").alias("source"), F.lit("").alias("menu_path"), F.col("url").alias("discovered_from"), F.lit("").alias("title"), F.lit(at).alias("discovered_at"))
    inventory = kept_for_all(I.merged(I.classified(found.unionByName(sitemap), targets, policy)))
    refused = C.blocked(F.col("status_code"), F.col("html"))
    answered = F.col("error").isNull() & (F.coalesce("status_code", F.lit(0)) > 0) & ~refused
    kind = F.when(F.coalesce("html", F.lit("")).rlike(r"<(?:\w+:)?(urlset|sitemapindex)\b") | F.col("url").rlike(r"(?i)sitemap[^/]*\.xml$"), "sitemap").otherwise("page")
    sources = responses.select("target_id", F.col("url").alias("source"), kind.alias("kind"), answered.alias("success"), F.when(~answered, C.redacted(F.coalesce("error", F.lit("차단 또는 응답 없음")))).alias("reason"))
    sources = counted(sources.join(responses.groupBy("target_id").agg(F.count(F.lit(1)).alias("request_count")), "target_id"), "sources", ~F.col("success"))
    limit = (rules.get("crawl") or {}).get("max_urls")
    health = kept_for_all(I.health(sources, int(limit) if limit is not None else None))
    header = targets.select("target_id", F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(policy.fingerprint()).alias("policy_fingerprint"))
    comparison = kept_for_all(I.comparison_status(old["header"], header, health))
    # Records of another policy aren't compared, whether their sources failed or not.
    diff = I.compared(old["inventory"], inventory, health).join(I.comparable(old["header"], header), "target_id", "left_semi")
    outside = I.outside_menu(inventory, health)
    # A target's baseline moves on only if its sources were healthy and its records can be compared.
    moved = comparison.where("baseline_updated").select("target_id").join(health.where("healthy"), "target_id", "left_semi")
    baseline = inventory.join(moved, "target_id", "left_semi").unionByName(old["inventory"].join(moved, "target_id", "left_anti"))
    headers = header.join(moved, "target_id", "left_semi").unionByName(old["header"].join(moved, "target_id", "left_anti"))

    patterns = fresh.get("content_type_patterns", {})
    dates = R.chosen_dates(R.date_candidates(parsed, KEYS, selectors=fresh.get("date_selectors") or None), KEYS)
    freshness = R.content_freshness(pages, dates, KEYS, reference, required=patterns.get("required", ()), not_required=patterns.get("not_required", ()), review_days=int(fresh.get("default_review_days", 730)), tolerance=int(fresh.get("future_tolerance_days", 1)))
    lists = R.page_lists(parsed, KEYS, reference, months=int(fresh.get("list_calendar_months", 3)), empty=fresh.get("list_empty_phrases", R.EMPTY_LISTS), issue=str(fresh.get("list_latest_issue_type", T.STALE_LIST)))

    absolute = U.normalize_any(F.col("absolute_url"), F.lit(None).cast("string"), policy)
    refs = R.references(parsed, KEYS, F.col("url")).withColumn("normalized_url", F.coalesce(absolute["url"], F.col("absolute_url")))
    refs = kept_for_all(refs)
    answers = responses.select(F.col("normalized_url").alias("url"), "status_code", F.element_at("headers", F.lit("content-type")).alias("content_type"), F.element_at("headers", F.lit("content-length")).cast("bigint").alias("content_length"), F.coalesce("body", F.col("html").cast("binary")).alias("body"), "error", "final_url", F.col("redirect_count").alias("hops"))
    checked = R.checked_resources(refs.where("kind <> 'anchor'"), answers, cached=old["attachments"], max_hops=int(kept.get("max_redirect_hops", 3)))
    decided = checked_attachments(refs, old["attachments"], reference, str(kept.get("policy_version", "resources-1")), force)
    reused = decided.where("reuse").select("normalized_url", "old_verdict")
    checked = checked.join(reused, "normalized_url", "left")
    hit = F.col("old_verdict").isNotNull() & (F.col("kind") == "attachment")
    checked = checked.select(*KEYS, "seq", "kind", "original_url", "normalized_url", "text", "alt", "location", "status_code", F.when(hit, F.col("old_verdict")).otherwise(F.col("verdict")).alias("verdict"), F.when(hit, "정상 첨부파일 캐시 재사용").otherwise(F.col("reason")).alias("reason"), F.when(hit, T.TO_REVIEW).otherwise(F.col("severity")).alias("severity"), hit.alias("cache_used"))
    at_anchor = refs.where("kind = 'anchor'").select("*", F.col("url").alias("document_url"), F.regexp_extract("original_url", "#(.*)$", 1).alias("fragment"))
    names = parsed.select(F.col("url").alias("document_url"), F.explode("elements").alias("e")).select("document_url", F.explode(F.array(F.lit(""), dom.attribute(F.col("e"), "id"), dom.attribute(F.col("e"), "name"))).alias("ref")).where("ref is not null")
    anchored = R.anchors(at_anchor, names).select(*KEYS, "seq", "kind", "original_url", "normalized_url", "text", "alt", "location", F.lit(None).cast("int").alias("status_code"), "verdict", F.when(F.col("verdict") == T.ERROR, "앵커 대상 없음").otherwise("앵커 존재").alias("reason"), F.lit(T.LOW).alias("severity"), F.lit(False).alias("cache_used"))
    resources = counted(checked.unionByName(anchored), "resources", F.col("verdict") == T.ERROR)
    now_known = checked.where("kind = 'attachment' and not cache_used").groupBy("normalized_url").agg(F.max(F.struct(C.rank(F.col("verdict")).alias("rank"), F.col("verdict").alias("verdict")))["verdict"].alias("verdict"))
    version = F.lit(str(kept.get("policy_version", "resources-1")))
    new = decided.join(now_known, "normalized_url").select("normalized_url", version.alias("policy_version"), "content_hash", "filename", "link_text", "verdict", F.date_add(reference, int(kept.get("attachment_recheck_days", 30))).alias("next_recheck_date"))
    attachments = new.unionByName(old["attachments"].join(new.select("normalized_url"), "normalized_url", "left_anti").select(*new.columns))

    a11y_policy = str(access.get("policy_version", "accessibility-1"))
    volatile = [*access.get("volatile_selectors", ()), *(f".{c}" for c in access.get("volatile_classes", ()))]
    hashes = kept_for_all(VS.content_hashes(pages, KEYS, selector=str(access.get("content_selector", "")), volatile_selectors=volatile, volatile_attributes=access.get("volatile_attributes", ()), patterns=access.get("volatile_patterns", ())))
    known = R.reused(hashes.select(*KEYS, "content_hash").withColumn("page", F.col("url")).withColumn("url", F.concat_ws(" ", "target_id", "url")), old["a11y"].withColumn("url", F.concat_ws(" ", "target_id", "url")), a11y_policy, force)
    known = kept_for_all(known.select("target_id", F.col("page").alias("url"), "content_hash", "reuse"))
    again = known.where("not reuse").select(*KEYS)
    settings = {"langs": access.get("allowed_langs", R.LANGS), "titles": [str(t).lower() for t in access.get("generic_title_keywords", R.GENERIC_TITLES)], "skip": [str(w).lower() for w in access.get("skip_link_keywords", R.SKIP_WORDS)]}
    issues = R.page_issues(pages.join(again, KEYS, "left_semi"), KEYS, **settings).unionByName(R.element_issues(parsed.join(again, KEYS, "left_semi"), KEYS, skip=settings["skip"]))
    issues = issues.unionByName(old["a11y_issues"].join(known.where("reuse").select(*KEYS), KEYS, "left_semi").select(*issues.columns))
    issues = counted(issues, "accessibility", F.col("result") == T.ERROR)
    uncheckable = issues.where(F.col("code") == "parse").select(*KEYS).distinct().withColumn("bad", F.lit(True))
    a11y = known.join(uncheckable, KEYS, "left").join(hashes.select(*KEYS, "hash_scope", "removed"), KEYS, "left").select(*KEYS, "content_hash", "hash_scope", "removed", F.lit(a11y_policy).alias("policy_version"), F.when(F.col("bad"), T.UNCHECKABLE).otherwise("완료").alias("last_result"))

    mixed = R.mixed_content(refs.withColumnRenamed("url", "page_url")).withColumnRenamed("page_url", "url")
    seen = responses.select("target_id", "url", "status_code", F.col("error").alias("failure_reason"), F.coalesce("redirect_count", F.lit(0)).alias("redirect_count"), F.col("elapsed_seconds").alias("total_seconds"), F.octet_length(F.coalesce("body", F.col("html").cast("binary"))).cast("bigint").alias("received_bytes"), "html").join(mixed, "url", "left")
    seen = seen.withColumn("mixed_content", F.coalesce("mixed_content", F.array().cast("array<string>")))
    limits = lambda a, b, d: (float(perf.get(a, d[0])), float(perf.get(b, d[1])))
    performance = R.performance(seen, slow=limits("response_warning_seconds", "response_error_seconds", (3, 5)), large=limits("page_size_warning_mb", "page_size_error_mb", (3, 5)), soft_words=perf.get("soft_404_keywords", R.SOFT_404))
    performance = counted(performance, "performance", F.col("verdict") == T.ERROR)

    checks = _checks(freshness, issues, performance)
    banned = [str(p) for p in exclusions.get("excluded_paths", ())]
    inside = F.lit(False)
    for p in banned:
        inside = inside | U.path(F.col("url")).startswith(p)
    checks = kept_for_all(checks)
    verdicts = V.page_verdicts(checks, KEYS).withColumn("verdict", F.when(inside, T.EXCLUDED).otherwise(F.col("verdict")))

    lifecycle = kept_for_all(V.reconciled(old["issues"], _issue_rows(issues, performance, resources), health, F.lit(at)))
    shots = lifecycle.join(hashes.select(F.col("target_id"), F.col("url").alias("page_url"), "content_hash"), ["target_id", "page_url"], "left").select("issue_key", "lifecycle_status", "content_hash", "evidence")
    screenshots = V.screenshots(shots, old["screenshots"], "screenshots-1", force=force)

    asked = responses.select("target_id", "normalized_url", F.lit(True).alias("asked")).distinct()
    urls = inventory.join(asked, ["target_id", "normalized_url"], "left")
    urls = urls.select("target_id", "normalized_url", "classification", (F.col("occurrences") > 1).alias("duplicate"), F.lit(False).alias("excluded"), F.when(F.col("asked"), T.SUCCESS).otherwise(T.NOT_RUN).alias("status"), ((F.col("classification") == "internal") & F.col("asked").isNull()).alias("uninspected"))
    coverage = V.coverage(urls, sources, checks.select(F.col("result").alias("status"), "required"))
    capped = health.where(F.col("reason") == I.REQUEST_LIMIT).select(F.lit("limit").alias("kind"), F.col("target_id").alias("subject"), "reason")
    missing = V.missing_scope(urls, sources).unionByName(capped)
    scope = urls.where("uninspected").select("target_id").union(sources.where("not success").select("target_id"))
    summary = V.report_summary(verdicts, diff, scope)
    return Run(inventory, health, comparison, headers, baseline, diff, outside, freshness, lists, resources, attachments, issues, a11y, performance, verdicts, lifecycle, screenshots, coverage, missing, summary, I.sitemap_status(sources), accounts, held)


def _checks(freshness: DataFrame, issues: DataFrame, performance: DataFrame) -> DataFrame:
    """The three checks of each page; that of accessibility is as bad as its worst issue."""
    base = lambda df, code, result, severity: df.select(*KEYS, F.lit(code).alias("code"), result.alias("result"), severity.alias("severity"), F.lit(True).alias("required"), F.lit(False).alias("manual"), F.lit("").alias("location"))
    none = F.lit(None).cast("string")
    rank = F.when(F.col("result") == T.MANUAL, 1).otherwise(C.rank(F.col("result")))
    worst = issues.groupBy(*KEYS).agg(F.max_by("result", rank).alias("worst"))
    a11y = performance.select(*KEYS).join(worst, KEYS, "left")
    return (
        base(freshness, "content_basic", F.col("verdict"), none)
        .unionByName(base(a11y, "accessibility", F.coalesce("worst", F.lit(T.OK)), none))
        .unionByName(base(performance, "connectivity", F.col("verdict"), none))
    )


def _issue_rows(issues: DataFrame, performance: DataFrame, resources: DataFrame) -> DataFrame:
    def rows(df, page, code, subject, problem, result, reason, evidence, severity):
        return df.select(V.issue_key(F.col("target_id"), page, code, subject, problem).alias("issue_key"), "target_id", page.alias("page_url"), code.alias("check_code"), result.alias("result"), reason.alias("reason"), evidence.alias("evidence"), severity.alias("severity"))

    url, col, lit = F.col("url"), F.col, F.lit
    a = rows(issues, url, col("code"), col("location"), col("code"), col("result"), col("code"), col("evidence"), col("severity"))
    gone = performance.where("status_code in (404, 410)")
    b = rows(gone, url, lit("connectivity"), url, lit("http_status"), lit(T.ERROR), col("reason"), col("status_code").cast("string"), lit(T.HIGH))
    bad = resources.where(F.col("verdict") == T.ERROR)
    c = rows(bad, url, lit("resources"), col("normalized_url"), col("kind"), col("verdict"), col("reason"), col("location"), F.coalesce(col("severity"), lit(T.MIDDLE)))
    return a.unionByName(b).unionByName(c)


#: Results of a run that later runs don't read; they are kept for those who ask what it found.
RESULTS = ("diff", "outside", "comparison", "coverage", "summary", "freshness", "lists", "sitemaps", "pages", "performance", "resources", "missing")


def saved(state: State, out: Run, run_id: str) -> int:
    """Writes a run's tables under its lease as one commit: a run that dies in between leaves those of the run before. Of a target with a failed source neither the baseline moves nor are issues resolved; others go on."""
    spark = state.spark
    with state.lock() as lease, state.commit(lease, run_id) as to:
        healthy = out.health.where("not healthy").isEmpty()
        for name in RESULTS:
            to.save(name, getattr(out, name).drop("html"))
        to.save("issues", out.lifecycle, keys=["issue_key"])
        to.save("inventory", out.baseline, keys=["target_id", "normalized_url"])
        to.save("header", out.header)
        to.save("attachments", out.attachments, keys=["normalized_url"])
        to.save("a11y", out.a11y, keys=KEYS)
        to.save("a11y_issues", out.issues.select(*[c.split()[0] for c in A11Y_ISSUE.split(", ")]))
        shots = out.screenshots.where("decision <> 'skip'").select("issue_key", "content_hash", "evidence", F.lit("screenshots-1").alias("policy_version"))
        to.save("screenshots", shots)
        for name, rows in {"freshness": out.freshness, "list_freshness": out.lists, "resources": out.resources, "accessibility": out.issues.withColumnRenamed("result", "verdict"), "performance": out.performance, "composite": out.pages, "coverage": out.missing.withColumnRenamed("kind", "verdict")}.items():
            to.save(f"payload_{name}", state_payload(rows, name))
            lease.renew()
        code = OK if healthy else PARTIAL
        stages = functools.reduce(DataFrame.unionByName, out.accounts.values())
        to.save("stages", stages.select(F.lit(run_id).alias("run_id"), "stage", "processed", "failed"))
        to.save("runs", spark.createDataFrame([(run_id, code)], "run_id string, exit_code int"))
    state.append_history(spark.createDataFrame([(run_id, code)], "run_id string, exit_code int"))
    return code
