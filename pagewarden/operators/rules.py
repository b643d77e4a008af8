"""Rules over pages: accessibility, response, freshness, resources."""

from __future__ import annotations

import json
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewarden.functions import checks as C
from pagewarden.functions import terms as T
from pagewarden.functions import urls as U
from pagewarden.sources.dom import attribute, before, blank, first, fits, has_class, having, inside, let, places, text_of

GENERIC_TITLES = ("홈", "페이지", "home", "untitled")
LANGS = ("ko", "ko-KR", "en", "en-US")
SKIP_WORDS = ("본문 바로가기", "콘텐츠 바로가기", "skip to content")
BALANCED = ("html", "head", "body", "title", "main", "form")
DATE_LABELS = {"published": ("게시일", "등록일", "작성일", "발행일"), "modified": ("수정일", "최종수정일", "변경일", "갱신일")}
ARCHIVE_WORDS = ("연혁", "지난자료", "아카이브")
# Fixed values of list pages: phrases, labels of rows' dates, contexts whose dates don't count, kinds of lists that need no check.
EMPTY_LISTS = ("게시물이 없습니다", "등록된 게시물이 없습니다", "검색 결과가 없습니다", "조회된 결과가 없습니다")
POSTED = ("게시일", "등록일", "작성일", "발행일")
OTHER_DATES = ("수정일", "최종수정", "행사기간", "접수기간", "조회수", "첨부")
UNCHECKED_LISTS, UNCHECKED_WORDS = ("calendar", "history", "table_stat", "menu", "gallery"), ("연혁", "달력", "관련 사이트")
UNDATED_PAGES = ("list", "listing", "search")
SOFT_404 = ("페이지를 찾을 수 없습니다", "존재하지 않습니다", "오류가 발생했습니다")
#: Codes of source_issues' rules, in their order.
SOURCE_CODES = ("doctype", *["html-syntax"] * len(BALANCED), "encoding", "encoding", "title", "title-generic", "lang", "lang", "skip-link", "viewport", "viewport-width", "viewport-zoom")
ISSUE_COLUMNS = ("code", "result", "severity", "element", "location", "evidence", "manual")


def _issue(when: Column, code: str, result: Column | str, severity: Column | str, element: str = "", evidence: Column | None = None, manual: Column | bool = False) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(when, F.struct(F.lit(code).alias("code"), lit(result).alias("result"), lit(severity).alias("severity"), F.lit(element).alias("element"), F.lit("").alias("location"), F.substring(F.coalesce(evidence, F.lit("")) if evidence is not None else F.lit(""), 1, 500).alias("evidence"), lit(manual).alias("manual")))


def tag_count(html: Column, token: str) -> Column:
    low = F.lower(html)
    return ((F.length(low) - F.length(F.replace(low, F.lit(token), F.lit("")))) / len(token)).cast("int")


def source_issues(html: Column, http_charset: Column | None = None, langs: Iterable[str] = LANGS, titles: Iterable[str] = GENERIC_TITLES, skip: Iterable[str] = SKIP_WORDS, codes: Iterable[str] | None = None) -> Column:
    """Array of issues that the HTML source tells without a tree, in one scan: declaration, balance, charset, title, language, viewport, skip link.

    codes: only these rules are computed (and parse, for pages without HTML).
    """
    declared = F.regexp_extract(F.lower(F.substring(html, 1, 500)), r"^\s*<!doctype\s+html([^>]*)>", 1)
    has_type = F.lower(F.substring(html, 1, 500)).rlike(r"^\s*<!doctype\s+html[^>]*>")
    metas = F.transform(F.regexp_extract_all(html, F.lit(r"(?i)<meta\s+charset\s*=\s*[\"']?([\w-]+)"), 1), F.lower)
    typed = F.transform(F.regexp_extract_all(html, F.lit(r"(?i)<meta\s[^>]*content-type[^>]*charset\s*=\s*([\w-]+)"), 1), F.lower)
    charsets = F.concat(metas, typed) if http_charset is None else F.concat(F.filter(F.array(F.lower(http_charset)), lambda c: c.isNotNull()), metas, typed)
    conflict = F.size(F.array_distinct(charsets)) > 1
    foreign = F.exists(charsets, lambda c: ~c.isin("utf-8", "utf8"))
    found = F.regexp_extract_all(html, F.lit(r"(?is)<title[^>]*>(.*?)</title>"), 1)
    title = F.lower(F.trim(F.regexp_replace(F.get(found, F.lit(0)), r"\s+", " ")))
    title_bad = (F.size(found) != 1) | (F.coalesce(title, F.lit("")) == "")
    lang = F.trim(F.regexp_extract(html, r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([^\"'\s>]*)", 1))
    lang_bad = ~lang.rlike(r"^[A-Za-z]{2,3}(-[A-Za-z]{2,4})?$")
    meta = F.regexp_extract(html, r"(?is)(<meta\b[^>]*name\s*=\s*[\"']?viewport[^>]*>)", 1)
    view = F.lower(F.regexp_extract(meta, r"(?is)content\s*=\s*[\"']([^\"']*)[\"']", 1))
    has_skip = F.exists(F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*href\s*=\s*[\"']?#[^>]*>(.*?)</a>"), 1), lambda t: F.lower(t).rlike("|".join(skip)))
    rows = [
        _issue(~has_type | (F.trim(declared) != ""), "doctype", T.REVIEW, T.TO_REVIEW, evidence=F.substring(html, 1, 120)),
        *[_issue(tag_count(html, f"<{t}") > tag_count(html, f"</{t}"), "html-syntax", T.REVIEW, T.TO_REVIEW, t) for t in BALANCED],
        _issue(F.size(charsets) == 0, "encoding", T.UNCHECKABLE, T.TO_REVIEW),
        _issue((F.size(charsets) > 0) & (conflict | foreign), "encoding", F.when(conflict, T.ERROR).otherwise(T.REVIEW), F.when(conflict, T.MIDDLE).otherwise(T.TO_REVIEW), evidence=F.array_join(charsets, ", ")),
        _issue(title_bad, "title", T.ERROR, T.MIDDLE, "title", F.concat(F.lit("title count="), F.size(found).cast("string"))),
        _issue(~title_bad & title.isin(*titles), "title-generic", T.REVIEW, T.LOW, "title", title),
        _issue(lang_bad, "lang", T.REVIEW, T.TO_REVIEW, "html", F.when(lang == "", "lang 없음").otherwise(lang)),
        _issue(~lang_bad & ~lang.isin(*langs), "lang", T.MANUAL, T.TO_REVIEW, "html", lang, True),
        _issue(~has_skip, "skip-link", T.REVIEW, T.TO_REVIEW),
        _issue(F.trim(view) == "", "viewport", T.REVIEW, T.TO_REVIEW, evidence=F.lit("viewport 없음")),
        _issue((F.trim(view) != "") & ~view.contains("width=device-width"), "viewport-width", T.REVIEW, T.TO_REVIEW, evidence=view),
        _issue(view.contains("user-scalable=no") | view.contains("maximum-scale=1"), "viewport-zoom", T.REVIEW, T.TO_REVIEW, evidence=view, manual=True),
    ]
    rows = [r for c, r in zip(SOURCE_CODES, rows, strict=True) if codes is None or c in codes]
    missing = F.array(_issue(html.isNull(), "parse", T.UNCHECKABLE, T.TO_REVIEW, evidence=F.lit("HTML 본문 없음")))
    return F.when(html.isNull(), missing).otherwise(F.filter(F.array(*rows), lambda r: r.isNotNull()))


def page_issues(pages: DataFrame, keys: list[str], **settings) -> DataFrame:
    """Exploded source_issues with an issue key; keys are (target_id, url) or such."""
    rows = pages.select(*keys, F.explode(source_issues(F.col("html"), **settings)).alias("i")).select(*keys, "i.*")
    return rows.withColumn("issue_key", C.key(*[F.col(k) for k in keys], F.col("code"), F.col("location"), size=20))


def _found(e: Column, code: str, result, severity, evidence: Column | None = None, manual: bool = False, location: Column | None = None, element: Column | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        F.lit(code).alias("code"), lit(result).alias("result"), lit(severity).alias("severity"), (e["tag"] if element is None else element).alias("element"), (places(e) if location is None else location).alias("location"),
        F.substring(F.coalesce(F.lit("") if evidence is None else evidence, F.lit("")), 1, 500).alias("evidence"), F.lit(manual).alias("manual"),
    )


def _id_issues(els: Column) -> Column:
    held = F.transform(having(lambda e: attribute(e, "id").isNotNull(), els), lambda e, i: F.struct(attribute(e, "id").alias("id"), e["tag"].alias("tag"), i.cast("string").alias("i")))
    empty = lambda h: F.transform(F.filter(h, lambda x: blank(x["id"])), lambda x: _found(x, "empty-id", T.REVIEW, T.LOW, location=F.concat(F.lit("id["), x["i"], F.lit("]"))))
    # Equal ids are neighbours once sorted.
    ranked = lambda h: F.array_sort(F.transform(F.filter(h, lambda x: ~blank(x["id"])), lambda x: F.struct(x["id"].alias("id"), x["i"].cast("int").alias("i"), x["tag"].alias("tag"))))
    again = lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1)["id"] == x["id"], F.lit(False)) | (F.when(i > 0, F.get(s, i - 1)["id"] == x["id"]).otherwise(False)))
    place = lambda x: F.concat(x["tag"], F.lit("["), x["i"].cast("string"), F.lit("]"))

    def told(d: Column) -> Column:
        where = lambda k: F.array_join(F.transform(F.filter(d, lambda x: x["id"] == k), place), "|")
        return F.transform(F.array_distinct(F.transform(d, lambda x: x["id"])), lambda k: let(where(k), lambda w: _found(w, "duplicate-id", T.ERROR, T.MIDDLE, w, location=w, element=k)))

    return let(held, lambda h: F.concat(empty(h), let(ranked(h), lambda s: let(again(s), told))))


def _control_issues(els: Column, names: Column, fit) -> Column:
    kinds = lambda e: e["tag"].isin("input", "select", "textarea") & ~F.lower(F.coalesce(attribute(e, "type"), F.lit(""))).isin("hidden", "submit", "button", "reset", "image")
    every = F.transform(having(lambda e: e["tag"].isin("input", "select", "textarea"), els), lambda e, i: F.struct(e.alias("e"), F.concat(e["tag"], F.lit("["), i.cast("string"), F.lit("]")).alias("at")))
    pointed = lambda e: F.split(F.trim(F.coalesce(attribute(e, "aria-labelledby"), F.lit(""))), r"\s+")
    lost = lambda e, n: ~blank(attribute(e, "aria-labelledby")) & (F.size(F.array_except(pointed(e), n)) > 0)
    labels = F.transform(having(lambda e: (e["tag"] == "label") & attribute(e, "for").isNotNull(), els), lambda e: attribute(e, "for"))
    bare = lambda e, f: blank(attribute(e, "aria-label")) & blank(attribute(e, "aria-labelledby")) & ~fit(e, "label *") & ~(~blank(attribute(e, "id")) & F.array_contains(f, F.coalesce(attribute(e, "id"), F.lit(""))))
    hint = lambda e: ~blank(attribute(e, "placeholder"))
    issue = lambda x, n, f: (
        F.when(~kinds(x["e"]), None)
        .when(lost(x["e"], n), _found(x["e"], "input-label-ref", T.ERROR, T.MIDDLE, attribute(x["e"], "aria-labelledby"), location=x["at"]))
        .when(bare(x["e"], f), _found(x["e"], "input-label", F.when(hint(x["e"]), T.REVIEW).otherwise(T.ERROR), F.when(hint(x["e"]), T.TO_REVIEW).otherwise(T.MIDDLE), location=x["at"]))
    )
    return let(names, lambda n: let(labels, lambda f: F.transform(every, lambda x: issue(x, n, f))))


def _name_issues(els: Column, ids: Column) -> Column:
    every = F.transform(having(lambda e: e["tag"].isin("a", "button"), els), lambda e, i: F.struct(e.alias("e"), F.concat(e["tag"], F.lit("["), i.cast("string"), F.lit("]")).alias("at")))
    images = having(lambda e: e["tag"] == "img", els)
    pointed = lambda e: F.split(F.trim(F.coalesce(attribute(e, "aria-labelledby"), F.lit(""))), r"\s+")
    nameless = lambda e: blank(text_of(e)) & blank(attribute(e, "aria-label"))
    gone = lambda e, n: F.array_except(pointed(e), n)
    image = lambda e, m: first(F.filter(m, lambda i: inside(i, e)))
    issue = lambda x, n, m: (
        F.when(~nameless(x["e"]), None)
        .when(~blank(attribute(x["e"], "aria-labelledby")), F.when(F.size(gone(x["e"], n)) > 0, _found(x["e"], "accessible-name-ref", T.ERROR, T.MIDDLE, F.concat(F.lit("aria-labelledby 대상 없음: "), F.array_join(gone(x["e"], n), ",")), location=x["at"])))
        .otherwise(
            let(image(x["e"], m), lambda i: F.when(i.isNull(), _found(x["e"], "empty-control", T.REVIEW, T.TO_REVIEW, location=x["at"])).when(blank(attribute(i, "alt")), _found(x["e"], "icon-control", T.MANUAL, T.TO_REVIEW, manual=True, location=x["at"])))
        )
    )
    return let(ids, lambda n: let(images, lambda m: F.transform(every, lambda x: issue(x, n, m))))


def element_issues(pages: DataFrame, keys: list[str], *, skip: Iterable[str] = SKIP_WORDS) -> DataFrame:
    """Issues that need the tree, of parsed pages: ids, labels of controls, names of links and buttons, targets of skip links, alternative texts.

    All rules are one projection over the array of a page's elements: one parse, no shuffle.
    """
    els = F.col("elements")
    ids = F.transform(having(lambda e: ~blank(attribute(e, "id")), els), lambda e: attribute(e, "id"))
    names = F.array_distinct(F.concat(ids, F.transform(having(lambda e: ~blank(attribute(e, "name")), els), lambda e: attribute(e, "name"))))
    skips = having(lambda e: (e["tag"] == "a") & attribute(e, "href").startswith("#") & F.lower(text_of(e)).rlike("|".join(skip)), els)
    target = lambda e: F.substring(attribute(e, "href"), F.lit(2), F.length(attribute(e, "href")))
    lost = let(names, lambda n: F.transform(F.filter(skips, lambda e: ~F.array_contains(n, target(e))), lambda e: _found(e, "skip-link-target", T.ERROR, T.MIDDLE, attribute(e, "href"), location=F.lit(""))))
    bare = F.transform(having(lambda e: (e["tag"] == "img") & attribute(e, "alt").isNull() & (F.coalesce(attribute(e, "role"), F.lit("")) != "presentation"), els), lambda e: _found(e, "image-alt", T.ERROR, T.MIDDLE))
    found = F.filter(F.concat(_id_issues(els), _control_issues(els, names, fits(pages)), _name_issues(els, ids), lost, bare), lambda i: i.isNotNull())
    out = pages.select(*keys, F.explode(found).alias("i")).select(*keys, "i.*")
    return out.withColumn("issue_key", C.key(*[F.col(k) for k in keys], F.col("code"), F.col("location"), size=20))


def reused(hashes: DataFrame, cache: DataFrame, policy: str, force: bool = False) -> DataFrame:
    """hashes (url, content_hash), each once, with reuse: whether a cached check (url, content_hash, policy_version, last_result) of its URL still holds."""
    held = cache.where((F.col("policy_version") == policy) & (F.col("last_result") != T.UNCHECKABLE)).select("url", "content_hash", F.lit(True).alias("_held")).distinct()
    return hashes.join(held, ["url", "content_hash"], "left").select(*hashes.columns, (F.coalesce("_held", F.lit(False)) & F.lit(not force)).alias("reuse"))


def performance(seen: DataFrame, *, slow: tuple[float, float] = (3.0, 5.0), large: tuple[float, float] = (3.0, 5.0), hops: int = 3, soft_words: Iterable[str] = SOFT_404) -> DataFrame:
    """Verdict, reason and notes of observations (url, status_code, failure_reason, redirect_count, total_seconds, received_bytes, html, mixed_content)."""
    mb = F.col("received_bytes") / (1024 * 1024)
    limit = lambda v, lo, hi, what: F.when(v >= hi, F.lit(f"{what} 초과")).when(v >= lo, F.lit(f"{what} 주의"))
    review = lambda c: F.when(F.coalesce(c, F.lit(False)), T.REVIEW)
    soft = (F.col("status_code") == 200) & F.col("html").rlike("|".join(soft_words))
    found = [
        (C.status_verdict(F.col("status_code")), F.concat(F.lit("HTTP "), F.coalesce(F.col("status_code").cast("string"), F.lit("없음")))),
        (F.when(F.col("failure_reason").isNotNull(), T.UNCHECKABLE), F.col("failure_reason")),
        (review(F.col("redirect_count") > hops), F.lit("리다이렉트 초과")),
        (review(F.col("total_seconds") >= slow[0]), limit(F.col("total_seconds"), *slow, "응답시간")),
        (review(mb >= large[0]), limit(mb, *large, "페이지 크기")),
        (F.when(F.coalesce(soft, F.lit(False)), T.REVIEW), F.lit("soft 404 의심")),
        (review(F.size("mixed_content") > 0), F.lit("혼합 콘텐츠")),
    ]
    ssl = F.when(U.scheme(F.col("url")) != "https", T.NOT_APPLICABLE).when(F.col("failure_reason").rlike("(?i)ssl|certificate"), T.ERROR).otherwise(T.OK)
    notes = F.filter(F.array(*[F.when(v.isNotNull() & (v != T.OK), r) for v, r in found]), lambda x: x.isNotNull())
    return seen.withColumn("w", C.worst(found)).select(*seen.columns, F.col("w.verdict").alias("verdict"), F.col("w.reason").alias("reason"), notes.alias("notes"), ssl.alias("ssl_result"))


def mixed_content(refs: DataFrame, keys: Iterable[str] = ("page_url",)) -> DataFrame:
    """(keys, mixed_content) of https pages that load http resources; keys: what tells pages apart, page_url among them."""
    hit = refs.where((U.scheme(F.col("page_url")) == "https") & (U.scheme(F.col("normalized_url")) == "http") & ~F.col("kind").isin("link", "anchor"))
    return hit.groupBy(*keys).agg(F.array_sort(F.collect_set("normalized_url")).alias("mixed_content"))


def _walked(text: str) -> list[tuple[str, str]]:
    """Dates of a JSON-LD text, objects before what they hold."""
    try:
        todo = [json.loads(text)]
    except (ValueError, RecursionError):
        return []
    out = []
    while todo:
        at = todo.pop()
        if isinstance(at, dict):
            out += [(kind, str(at[key])) for kind, key in (("published", "datePublished"), ("modified", "dateModified")) if at.get(key)]
            todo += reversed(at.values())
        elif isinstance(at, list):
            todo += reversed(at)
    return out


def _json_dates(scripts: Column) -> Column:
    @F.pandas_udf("array<struct<seq: int, kind: string, raw: string>>")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda held: [{"seq": s["seq"], "kind": k, "raw": r} for s in held for k, r in _walked(s["text"])])

    return run(scripts)


def date_candidates(pages: DataFrame, keys: list[str], labels=DATE_LABELS, selectors: dict[str, list[str]] | None = None) -> DataFrame:
    """(keys, kind, day, original, method, confidence, priority, seq) of parsed pages: every place of a page that may date it.

    Pages whose page_type (if they have that column) is a list have none. selectors, by kind: those that the pages were parsed with.
    A column own_names names the selectors of each page's own (dom.parsed(own=...)); those of dates are date.published and date.modified.
    """
    els, fit = F.col("elements"), fits(pages)
    of = lambda text: F.when(F.lower(text).rlike("|".join(labels["modified"])), "modified").when(F.lower(text).rlike("|".join(labels["published"])), "published")

    def row(e, kind, original, method, confidence, priority):
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(lit(kind).alias("kind"), original.alias("original"), lit(method).alias("method"), lit(confidence).cast("double").alias("confidence"), F.lit(priority).alias("priority"), e["seq"].alias("seq"))

    explicit = lambda e: ~blank(attribute(e, "datetime"))
    stamp = lambda e: F.when(explicit(e), attribute(e, "datetime")).otherwise(text_of(e))
    own = lambda e: of(F.concat_ws(" ", before(e), F.split(F.coalesce(attribute(e, "class"), F.lit("")), r"\s+")[0]))
    times = F.transform(having(lambda e: e["tag"] == "time", els), lambda e: F.struct(e.alias("e"), own(e).alias("own")))
    # The first unlabelled time is the publication's, unless an earlier one was taken for it.
    taken = lambda t: F.array_position(F.transform(t, lambda x: F.coalesce(x["own"], F.lit("published"))), "published")
    kind = lambda x, i, at: F.coalesce(x["own"], F.when((at == 0) | (i + 1 <= at), "published").otherwise("modified"))
    timed = let(times, lambda t: let(taken(t), lambda at: F.transform(t, lambda x, i: row(x["e"], kind(x, i, at), stamp(x["e"]), F.when(explicit(x["e"]), "time_datetime").otherwise("label"), F.when(explicit(x["e"]), 0.98).otherwise(0.88), 1))))
    prop = lambda e: F.coalesce(attribute(e, "property"), attribute(e, "name"))
    metas = F.transform(having(lambda e: (e["tag"] == "meta") & prop(e).isin("article:published_time", "article:modified_time") & ~blank(attribute(e, "content")), els), lambda e: row(e, F.when(prop(e) == "article:published_time", "published").otherwise("modified"), attribute(e, "content"), "article_meta", 0.96, 2))
    said = F.transform(F.col("said"), lambda x: row(x, x["kind"], x["raw"], "json_ld", 0.94, 3))
    date = lambda e: F.regexp_extract(text_of(e), C.DATE, 0)
    labelled = F.transform(having(lambda e: ~e["tag"].isin("script", "style") & of(e["own_text"]).isNotNull() & (date(e) != ""), els), lambda e: row(e, of(e["own_text"]), date(e), "label", 0.90, 4))
    chosen = [F.slice(F.transform(having(lambda e, s=s: fit(e, s), els), lambda e, name=name: row(e, name, stamp(e), "configured_selector", 0.86, 5)), 1, 1) for name, many in (selectors or {}).items() for s in many]
    if "own_names" in pages.columns:
        named = F.filter(F.transform("own_names", lambda n, i: F.struct(n.alias("n"), i.alias("i"))), lambda x: x["n"].startswith("date."))
        chosen.append(F.flatten(F.transform(named, lambda x: F.slice(F.transform(having(lambda e: fit(e, x["i"]), els), lambda e: row(e, F.substring(x["n"], 6, 99), stamp(e), "configured_selector", 0.86, 5)), 1, 1))))
    scripts = F.transform(having(lambda e: (e["tag"] == "script") & F.lower(attribute(e, "type")).contains("ld+json"), els), lambda e: F.struct(e["seq"].alias("seq"), text_of(e).alias("text")))
    if "page_type" in pages.columns:
        pages = pages.where(~F.lower(F.coalesce("page_type", F.lit(""))).isin(*UNDATED_PAGES))
    rows = pages.withColumn("said", _json_dates(scripts)).select(*keys, F.explode(F.concat(timed, metas, said, labelled, *chosen)).alias("c"))
    return rows.select(*keys, "c.kind", C.parsed_date(F.col("c.original")).alias("day"), "c.original", "c.method", "c.confidence", "c.priority", "c.seq")


def chosen_dates(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """For each page and kind the first candidate that is a date; if none is, the last one as a failure."""
    w = Window.partitionBy(*keys, "kind")
    ok = F.col("day").isNotNull()
    order = w.orderBy(ok.desc(), F.when(ok, F.col("priority")).otherwise(-F.col("priority")), F.when(ok, F.col("seq")).otherwise(-F.col("seq")))
    return candidates.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn", "priority", "seq")


def content_freshness(pages: DataFrame, dates: DataFrame, keys: list[str], reference: Column, *, required: Iterable[str] = (), not_required: Iterable[str] = (), review_days: int = 730, tolerance: int = 1, archive: Iterable[str] = ARCHIVE_WORDS) -> DataFrame:
    """pages (keys, url, page_type, html) with published, modified, elapsed_days, verdict; the modification's date goes first."""
    flat = dates.groupBy(*keys).agg(*[F.min(F.when(F.col("kind") == k, F.col("day"))).alias(k) for k in ("published", "modified")])
    rows = pages.join(flat, keys, "left").withColumn("day", F.coalesce("modified", "published"))
    archived = F.lower(F.concat_ws(" ", "url", F.regexp_replace("html", r"(?s)<[^>]*>", " "))).rlike("|".join(archive))
    applies = C.applicability(U.path(F.col("url")), F.col("page_type"), required, not_required)
    applied = rows.withColumn("applicability", applies)
    verdict = C.freshness_verdict(F.col("applicability"), F.col("day"), archived, reference, review_days, tolerance)
    return applied.select(*keys, *([] if "url" in keys else ["url"]), "applicability", "published", "modified", F.when(F.col("applicability") == "required", F.datediff(reference, F.col("day"))).alias("elapsed_days"), verdict.alias("verdict"))


def _chosen(pages: DataFrame, selectors: dict[str, list[str]]):
    """A function of a part of lists (container, row, title, link, date): (whether a selector is configured for it, whether an element fits it)."""
    fit, own = fits(pages), "own_names" in pages.columns

    def of(name: str):
        fixed = (selectors.get(name) or [None])[0]
        if fixed is not None:
            return F.lit(True), lambda e: fit(e, fixed)
        if not own:
            return F.lit(False), lambda e: F.lit(False)
        at = F.array_position("own_names", f"list.{name}").cast("int")
        return F.coalesce(at > 0, F.lit(False)), lambda e: (at > 0) & fit(e, at - 1)

    any_own = F.exists("own_names", lambda n: n.startswith("list.")) if own else F.lit(False)
    return of, F.lit(bool(selectors)) | F.coalesce(any_own, F.lit(False))


def _rows_of(els: Column, chosen, fit) -> Column:
    """The rows of a page's list: by selector, or the first kind of container of which there are two at least."""
    of, configured = chosen
    has_row, is_row = of("row")
    has_container, is_container = of("container")
    rows = having(is_row, els)
    within = let(first(having(is_container, els)), lambda c: F.when(c.isNull(), rows).otherwise(having(lambda e: inside(e, c), rows)))
    kinds = [lambda e: fit(e, "table tbody tr"), lambda e: e["tag"] == "article", lambda e: has_class(e, "item"), lambda e: has_class(e, "card"), lambda e: e["tag"] == "li"]
    several = [F.filter(F.array(having(kind, els)), lambda k: F.size(k) >= 2) for kind in kinds]
    none = F.slice(els, 1, 0)
    return F.when(configured, F.when(has_row & has_container, within).when(has_row, rows).otherwise(none)).otherwise(F.coalesce(first(F.concat(*several)), none))


def _items(els: Column, rows: Column, chosen, fit) -> Column:
    """(seq, day, original, title, href, timed) of each row; dates of other contexts don't count unless a posted one is named too."""
    named, _ = chosen
    tagged = lambda *tags: having(lambda e: e["tag"].isin(*tags), els)
    of = lambda name, default: F.when(named(name)[0], having(named(name)[1], els)).otherwise(default)
    any_of = lambda text, words: text.rlike("|".join(words))
    table = lambda r: F.element_at(F.filter(tagged("table"), lambda t: inside(r, t)), -1)
    heads = lambda t: F.transform(having(lambda e: fit(e, "thead th") & inside(e, t), els), lambda e: any_of(F.lower(text_of(e)), POSTED))
    # The column under a head that names the posting date, from 1; 0 if there is none.
    column = F.when(named("date")[0], 0).otherwise(let(first(rows), lambda r: F.when(F.exists(tagged("table"), lambda t: inside(r, t)), let(table(r), lambda t: F.array_position(heads(t), True).cast("int"))).otherwise(0)))
    text = text_of

    def item(r, at, times, cells, titles, links):
        within = lambda many: first(F.filter(many, lambda e: inside(e, r)))
        stamp = F.when(F.coalesce(at, F.lit(0)) > 0, F.get(F.filter(cells, lambda c: c["parent"] == r["seq"]), at - 1)).otherwise(within(times))
        other = any_of(text(r), OTHER_DATES) & ~any_of(text(r), POSTED)
        raw = lambda s: F.when(~blank(attribute(s, "datetime")), attribute(s, "datetime")).when(other, "").otherwise(F.when(s.isNull(), text(r)).otherwise(text(s)))
        return let(stamp, lambda s: F.struct(r["seq"].alias("seq"), C.parsed_date(raw(s)).alias("day"), raw(s).alias("original"), F.coalesce(text(within(titles)), F.lit("")).alias("title"), F.coalesce(attribute(within(links), "href"), F.lit("")).alias("href"), s.isNotNull().alias("timed")))

    return let(
        column,
        lambda at: let(of("date", tagged("time")), lambda times: let(tagged("td"), lambda cells: let(of("title", tagged("h1", "h2", "h3", "h4", "a")), lambda titles: let(of("link", having(lambda e: (e["tag"] == "a") & attribute(e, "href").isNotNull(), els)), lambda links: F.transform(rows, lambda r: item(r, at, times, cells, titles, links)))))),
    )


def list_items(pages: DataFrame, keys: list[str], selectors: dict[str, list[str]] | None = None) -> DataFrame:
    """(keys, seq, day, original, title, href, timed) of the rows of parsed pages' lists."""
    fit, chosen = fits(pages), _chosen(pages, selectors or {})
    own = ["own_names"] if "own_names" in pages.columns and "own_names" not in keys else []
    rows = pages.select(*keys, *own, "elements", "texts", _rows_of(F.col("elements"), chosen, fit).alias("rows"))
    return rows.select(*keys, F.explode(_items(F.col("elements"), F.col("rows"), chosen, fit)).alias("i")).select(*keys, "i.*")


def _list_verdict(valid: Column, future: Column, latest: Column, boundary: Column) -> Column:
    return F.when(future > 0, T.MANUAL).when(valid == 0, T.UNCHECKABLE).when(latest <= boundary, T.REVIEW).otherwise(T.OK)


def page_lists(pages: DataFrame, keys: list[str], reference: Column, *, months: int = 3, selectors: dict[str, list[str]] | None = None, empty: Iterable[str] = EMPTY_LISTS, issue: str = T.STALE_LIST) -> DataFrame:
    """Freshness of the list that each parsed page holds, by the first rule that fits: a phrase that says it is empty, a kind of list that needs no check, no rows, then the dates of its rows.

    pages may have list_type, and own_names of their own selectors (dom.parsed(own=...)): list.container, list.row, list.title, list.link, list.date. Only what the page shows is looked at.
    """
    els, fit, chosen = F.col("elements"), fits(pages), _chosen(pages, selectors or {})
    own = ["own_names"] if "own_names" in pages.columns and "own_names" not in keys else []
    seen = F.array_join(F.transform(having(lambda e: ~e["tag"].isin("script", "style", "template"), els), lambda e: e["own_text"]), " ")
    kind = F.lower(F.coalesce("list_type", F.lit(""))) if "list_type" in pages.columns else F.lit("")
    rows = pages.select(*keys, *own, "elements", "texts", seen.alias("seen"), kind.alias("list_type"), _rows_of(els, chosen, fit).alias("rows"))
    rows = rows.select(*keys, "seen", "list_type", F.size("rows").alias("n"), _items(els, F.col("rows"), chosen, fit).alias("items"))
    count = lambda when: F.size(F.filter("items", when))
    usable = F.array_max(F.transform(F.filter("items", lambda i: i["day"] <= reference), lambda i: F.struct(i["day"].alias("day"), (-i["seq"]).alias("order"), i["title"].alias("title"), i["href"].alias("href"))))
    rows = rows.select("*", count(lambda i: i["day"].isNotNull()).alias("valid"), count(lambda i: i["day"].isNull()).alias("failed"), count(lambda i: i["day"] > reference).alias("future"), usable.alias("latest"))
    none, skipped = F.col("seen").rlike("|".join(empty)), F.col("list_type").isin(*UNCHECKED_LISTS) | F.lower("seen").rlike("|".join(UNCHECKED_WORDS))
    boundary = C.months_before(reference, months)
    dated = ~none & ~skipped & (F.col("n") > 0)
    verdict = F.when(none, T.REVIEW).when(skipped, T.NOT_APPLICABLE).when(F.col("n") == 0, T.MANUAL).otherwise(_list_verdict(F.col("valid"), F.col("future"), F.col("latest.day"), boundary))
    applies = F.when(none, "required").when(skipped, "not_required").when(F.col("n") >= 2, "required").otherwise("uncertain")
    only = lambda c: F.when(dated, c)
    return rows.select(
        *keys, applies.alias("applicability"), F.coalesce(only(F.col("valid")), F.lit(0)).alias("valid"), F.coalesce(only(F.col("failed")), F.lit(0)).alias("failed"), only(F.col("latest.day")).alias("latest_day"), only(F.col("latest.title")).alias("latest_title"), only(F.col("latest.href")).alias("latest_href"),
        boundary.alias("boundary"), verdict.alias("verdict"), F.when(dated & (verdict == T.REVIEW), issue).alias("issue_type"), (verdict == T.MANUAL).alias("manual"),
    )


def list_freshness(items: DataFrame, keys: list[str], reference: Column, months: int = 3) -> DataFrame:
    """Verdict of each list from items (keys, seq, day, title): by its newest item that isn't in the future; of equal days the first."""
    usable = F.when(F.col("day") <= reference, F.struct("day", (-F.col("seq")).alias("order"), "title"))
    boundary = C.months_before(reference, months)
    out = items.groupBy(*keys).agg(F.count("day").alias("valid"), (F.count(F.lit(1)) - F.count("day")).alias("failed"), F.count_if(F.col("day") > reference).alias("future"), F.max(usable).alias("latest"))
    verdict = _list_verdict(F.col("valid"), F.col("future"), F.col("latest.day"), boundary)
    return out.withColumn("verdict", verdict).select(*keys, "valid", "failed", "future", F.col("latest.day").alias("latest_day"), F.col("latest.title").alias("latest_title"), "verdict", F.when(F.col("verdict") == T.REVIEW, T.STALE_LIST).alias("issue_type"))


def references(pages: DataFrame, keys: list[str], base: Column) -> DataFrame:
    """Links, attachments, anchors, images, scripts and stylesheets of parsed pages, in page order with their place among their kind."""
    of = having(lambda e: e["tag"].isin("a", "img", "script", "link"))
    href = lambda e: F.when(e["tag"].isin("a", "link"), attribute(e, "href")).otherwise(attribute(e, "src"))
    alt = lambda e: F.when((attribute(e, "role") == "presentation") & attribute(e, "alt").isNull(), "").otherwise(attribute(e, "alt"))
    many = lambda e: F.when((e["tag"] == "img") & attribute(e, "srcset").isNotNull(), U.srcset(attribute(e, "srcset"))).otherwise(F.array().cast("array<string>"))
    urls = lambda e: F.filter(F.concat(F.array(href(e)), many(e)), lambda h: h.isNotNull())
    row = lambda e, h: F.struct(e["seq"].alias("seq"), e["tag"].alias("tag"), h.alias("href"), text_of(e).alias("text"), alt(e).alias("alt"), attribute(e, "download").isNotNull().alias("download"))
    rows = pages.select(*keys, F.posexplode(F.flatten(F.transform(of, lambda e: F.transform(urls(e), lambda h: row(e, h))))).alias("at", "r")).select(*keys, "at", "r.*")
    rows = rows.withColumn("kind", U.resource_kind(F.col("tag"), F.col("href"), F.col("download")))
    place = F.concat("kind", F.lit("["), (F.row_number().over(Window.partitionBy(*keys, "kind").orderBy("at")) - 1).cast("string"), F.lit("]"))
    return rows.select(*keys, "seq", "kind", F.col("href").alias("original_url"), U.join(base, F.col("href")).alias("absolute_url"), "text", "alt", place.alias("location"))


ANSWER = {"status_code": "int", "error": "string", "content_type": "string", "content_length": "bigint", "final_url": "string", "hops": "int"}


def answered(answers: DataFrame) -> DataFrame:
    """One answer a URL, without its body: (url, head, got), of HEAD and of GET requests, each the facts that verdicts need.

    answers: (url, status_code, content_type, content_length, body, error) and maybe method (GET if missing), final_url, hops. The length of the
    header counts, else that of the body. Of several answers to one request the least in the order of its fields counts.
    """
    cols = {c: F.col(c).cast(t) if c in answers.columns else F.lit(None).cast(t) for c, t in ANSWER.items()}
    cols["content_length"] = F.coalesce(cols["content_length"], F.octet_length("body").cast("bigint"))
    start = F.col("body")
    facts = F.struct(*[c.alias(n) for n, c in cols.items()], F.hex(F.substring(start, 1, 8)).alias("start"), F.lower(F.substring(start, 1, 1000).cast("string")).contains("captcha").alias("captcha"))
    method = F.upper("method") if "method" in answers.columns else F.lit("GET")
    rows = answers.select("url", method.alias("method"), facts.alias("a"))
    return rows.groupBy("url").agg(F.min(F.when(F.col("method") == "HEAD", F.col("a"))).alias("head"), F.min(F.when(F.col("method") != "HEAD", F.col("a"))).alias("got"))


def checked_resources(refs: DataFrame, answers: DataFrame, *, cached: DataFrame | None = None, max_hops: int = 3) -> DataFrame:
    """References (page_url, seq, kind, normalized_url, alt) with the verdict of their URL's answer.

    Answers are brought to one row a URL before the join, and bodies stay behind. A HEAD counts unless it was refused (405, none, 403
    of an attachment) or an attachment's had no bytes; then the GET does. 304 keeps an attachment's cached verdict (cached: normalized_url, verdict).
    Unsafe destinations, unsafe or too many redirects, and URLs without an answer can't be checked.
    """
    one = answered(answers).withColumnRenamed("url", "normalized_url")
    rows = refs.join(one, "normalized_url", "left")
    old = cached.select("normalized_url", F.col("verdict").alias("old_verdict")) if cached is not None else None
    rows = rows.join(old, "normalized_url", "left") if old is not None else rows.withColumn("old_verdict", F.lit(None).cast("string"))
    head, kind = F.col("head.status_code"), F.col("kind")
    refused = F.coalesce(head.isin(405, 0), F.lit(True)) | (head == 403) & (kind == "attachment") | (head == 200) & (kind == "attachment") & F.col("got").isNotNull()
    rows = rows.withColumn("a", F.when(F.col("head").isNull() | refused & F.col("got").isNotNull(), F.col("got")).otherwise(F.col("head")))
    a = lambda name: F.col(f"a.{name}")
    unchanged = (a("status_code") == 304) & (kind == "attachment") & F.col("old_verdict").isNotNull()
    moved = F.coalesce(a("final_url") != F.col("normalized_url"), F.lit(False))
    plain = C.resource_verdict(a("status_code"), a("error"), F.when(a("captcha"), "captcha"))
    http = F.concat(F.lit("HTTP "), a("status_code").cast("string"))
    base = [
        (~U.safe_destination(F.col("normalized_url")), T.UNCHECKABLE, F.lit("점검 제외 대상")),
        (F.col("a").isNull(), T.UNCHECKABLE, F.lit("응답 없음")),
        (unchanged, F.col("old_verdict"), F.lit("304 Not Modified")),
        (moved & ~U.safe_destination(a("final_url")), T.UNCHECKABLE, F.lit("위험한 리다이렉트 목적지")),
        (moved & (a("hops") > max_hops), T.UNCHECKABLE, F.lit("리다이렉트 횟수 상한 초과")),
    ]
    first_of = lambda i, last: F.coalesce(*[F.when(c, r[i]) for c, *r in base], last)
    rows = rows.withColumn("v", first_of(0, plain)).withColumn("why", first_of(1, F.coalesce(a("error"), http)))
    ok = F.col("v") == T.OK
    size0 = F.coalesce(a("content_length") == 0, F.lit(False))
    image_type = ~F.lower(F.coalesce(a("content_type"), F.lit(""))).startswith("image/")
    wrong = C.attachment_mismatch(F.col("normalized_url"), a("content_type"), a("start"))
    found = [
        (ok & (kind == "image") & F.col("alt").isNull(), F.lit("이미지 alt 속성 누락"), T.LOW),
        (ok & (kind == "image") & (image_type | size0), F.lit("이미지 Content-Type 또는 크기 오류"), T.MIDDLE),
        (ok & (kind == "attachment") & ~unchanged & (wrong | size0), F.lit("첨부파일 크기 또는 시그니처 불일치"), T.MIDDLE),
    ]
    bad = F.coalesce(*[F.when(c, F.struct(why.alias("why"), F.lit(s).alias("severity"))) for c, why, s in found])
    severity = F.when(F.col("bad").isNotNull(), F.col("bad.severity")).when(F.col("v") == T.ERROR, T.HIGH).otherwise(T.TO_REVIEW)
    rows = rows.withColumn("bad", bad).withColumn("status_code", a("status_code")).withColumn("content_length", a("content_length"))
    return rows.select(*refs.columns, "status_code", "content_length", F.when(F.col("bad").isNotNull(), T.ERROR).otherwise(F.col("v")).alias("verdict"), F.coalesce("bad.why", "why").alias("reason"), severity.alias("severity"))


def anchors(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """Anchor references (document_url, fragment) against ids and names (document_url, ref) of documents that were read."""
    known = targets.select("document_url", F.col("ref").alias("fragment"), F.lit(True).alias("hit")).distinct()
    read = targets.select("document_url", F.lit(True).alias("read")).distinct()
    rows = refs.join(known, ["document_url", "fragment"], "left").join(read, "document_url", "left")
    return rows.select(*refs.columns, F.when(F.col("hit") | (F.col("fragment") == ""), T.OK).when(F.col("read"), T.ERROR).otherwise(T.UNCHECKABLE).alias("verdict"))


def attachment_decisions(refs: DataFrame, cache: DataFrame, today: Column, policy: str, force: bool = False) -> DataFrame:
    """Whether a cached check of an attachment still holds, and if not, the first reason why: refs (normalized_url, content_hash, filename, link_text)."""
    old = cache.select("normalized_url", F.lit(True).alias("known"), F.col("policy_version"), F.col("content_hash").alias("old_hash"), F.col("filename").alias("old_name"), F.col("link_text").alias("old_text"), F.col("verdict").alias("old_verdict"), "next_recheck_date")
    differs = ~F.col("old_name").eqNullSafe(F.col("filename")) | ~F.col("old_text").eqNullSafe(F.col("link_text"))
    reason = (
        F.when(F.lit(force), "force").when(F.col("known").isNull(), "none").when(~F.col("policy_version").eqNullSafe(F.lit(policy)), "policy").when(~F.col("old_hash").eqNullSafe(F.col("content_hash")), "content").when(differs, "name").when(F.col("old_verdict") != T.OK, "verdict").when(today >= F.col("next_recheck_date"), "due")
    )
    return refs.join(old, "normalized_url", "left").select(*refs.columns, reason.isNull().alias("reuse"), reason.alias("reason"))


def updated_cache(cache: DataFrame, checked: DataFrame, today: Column, days: int = 30) -> DataFrame:
    """Cache rows (normalized_url, verdict, next_recheck_date) after checks (normalized_url, page_url, verdict); of several verdicts the worst counts."""
    new = checked.groupBy("normalized_url").agg(F.max(F.struct(C.rank(F.col("verdict")).alias("rank"), F.col("verdict").alias("verdict"))).alias("new"))
    rows = cache.select("normalized_url", "verdict", "next_recheck_date").join(new, "normalized_url", "full_outer")
    return rows.select("normalized_url", F.coalesce("new.verdict", "verdict").alias("verdict"), F.when(F.col("new").isNotNull(), F.date_add(today, days)).otherwise(F.col("next_recheck_date")).alias("next_recheck_date"))


def cached_pages(relations: DataFrame, checked: DataFrame) -> DataFrame:
    """Which pages (page_url) refer to which attachment (normalized_url): a row for each pair, as an attachment may be on every page."""
    return relations.select("normalized_url", "page_url").unionByName(checked.select("normalized_url", "page_url")).distinct()
