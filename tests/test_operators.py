import datetime as dt

from pyspark.sql import functions as F

from pagewarden.functions import checks as C
from pagewarden.functions import terms as T
from pagewarden.functions import urls as U
from pagewarden.operators import inventory as I
from pagewarden.operators import rules as R
from pagewarden.operators import verdicts as V
from pagewarden.sources import dom

PAGE = """<!DOCTYPE html><html lang="ko"><head><title>공지</title><meta charset="utf-8"><meta name="viewport" content="width=device-width, maximum-scale=1">
<meta property="article:modified_time" content="2026-02-03T10:00:00+09:00"></head><body><a href="#main">본문 바로가기</a><nav><ul><li><a href="/a">A</a><ul><li><a href="/a/b">B</a></li></ul></li></ul></nav>
<main id="main"><p>등록일 <time datetime="2026-01-02">2일</time></p><a href="/f.pdf">file</a><img src="x.png"><img src="y.png" alt="" srcset="z.png 2x"><a href="/e"></a><button><img src="i.png"></button>
<input id="n"><label for="n">name</label><input placeholder="p"><input type="hidden"><label>q<select></select></label><input aria-labelledby="none"><p id="d"></p><p id="d"></p><p id=" "></p></main></body></html>"""


def elements(spark, html=PAGE):
    return dom.parsed(spark.createDataFrame([("t", "https://s.test/p", html)], "target_id string, url string, html string"), ["target_id", "url"])


def test_issues_of_source_and_tree(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, '<!doctype html PUBLIC "x"><html lang="xx"><meta charset="euc-kr"><title>Home</title><title></title>')], "page_id int, html string")
    got = {(r.page_id, r.code, r.result, r.element) for r in R.page_issues(pages, ["page_id"]).collect()}
    assert {g for g in got if g[0] == 1} == {(1, "viewport-zoom", T.REVIEW, "")}
    assert {g for g in got if g[0] == 2} == {(2, "parse", T.UNCHECKABLE, "")}
    assert {g[1] for g in got if g[0] == 3} == {"doctype", "encoding", "title", "lang", "skip-link", "viewport"}
    assert {g[1:] for g in got if g[0] == 4} == {("doctype", T.REVIEW, ""), ("html-syntax", T.REVIEW, "html"), ("encoding", T.REVIEW, ""), ("title", T.ERROR, "title"), ("lang", T.MANUAL, "html"), ("skip-link", T.REVIEW, ""), ("viewport", T.REVIEW, "")}
    tree = sorted((r.code, r.result, r.location) for r in R.element_issues(elements(spark), ["target_id", "url"]).collect())
    assert tree == sorted(
        [
            ("duplicate-id", T.ERROR, "p[2]|p[3]"), ("empty-id", T.REVIEW, "id[4]"), ("empty-control", T.REVIEW, "a[4]"), ("icon-control", T.MANUAL, "button[5]"),
            ("image-alt", T.ERROR, "img[0]"), ("image-alt", T.ERROR, "img[2]"), ("input-label", T.REVIEW, "input[1]"), ("input-label-ref", T.ERROR, "input[4]"),
        ]
    )


def test_menu_dates_and_references(spark):
    e = elements(spark).persist()
    keys = ["target_id", "url"]
    assert sorted((r.href, r.menu_path) for r in I.menu(e, keys).collect()) == [("/a", "A"), ("/a/b", "A > B")]
    dates = {r.kind: (r.day, r.method) for r in R.chosen_dates(R.date_candidates(e, keys), keys).collect()}
    assert dates == {"published": (dt.date(2026, 1, 2), "time_datetime"), "modified": (dt.date(2026, 2, 3), "article_meta")}
    refs = R.references(e, keys, F.col("url"))
    assert sorted((r.kind, r.absolute_url) for r in refs.collect()) == sorted([("anchor", "https://s.test/p#main"), ("link", "https://s.test/a"), ("link", "https://s.test/a/b"), ("attachment", "https://s.test/f.pdf"), ("image", "https://s.test/x.png"), ("image", "https://s.test/y.png"), ("image", "https://s.test/z.png"), ("link", "https://s.test/e"), ("image", "https://s.test/i.png")])


def test_dates_that_fail_and_lists(spark):
    keys = ["target_id", "url"]
    e = elements(spark, "<p>수정일 2024.99.01</p><time>soon</time><time>2024-01-05</time>")
    got = {r.kind: (r.day, r.original) for r in R.chosen_dates(R.date_candidates(e, keys), keys).collect()}
    assert got == {"modified": (dt.date(2024, 1, 5), "2024-01-05")}  # both times stand behind the label
    e = elements(spark, "<p><time>soon</time></p><p><time>2024-01-05</time></p>")
    got = {r.kind: (r.day, r.original) for r in R.chosen_dates(R.date_candidates(e, keys), keys).collect()}
    assert got == {"published": (None, "soon"), "modified": (dt.date(2024, 1, 5), "2024-01-05")}
    page = "<ul>" + "".join(f'<li><a href="/{i}">n{i}</a> {d}</li>' for i, d in enumerate(["2026-05-25", "2026-05-20", "none"])) + "</ul>"
    items = R.list_items(elements(spark, page), keys)
    row = R.list_freshness(items, keys, F.lit("2026-08-25").cast("date")).first()
    assert (row.valid, row.failed, row.latest_day, row.latest_title, row.verdict, row.issue_type) == (2, 1, dt.date(2026, 5, 25), "n0", T.REVIEW, T.STALE_LIST)
    assert R.list_freshness(items.withColumn("day", F.date_add("day", 1)), keys, F.lit("2026-08-25").cast("date")).first().verdict == T.OK


def test_resources_anchors_cache(spark):
    refs = spark.createDataFrame([("p", 1, "link", "https://a.test/1", None), ("p", 2, "image", "https://a.test/i", None), ("p", 3, "attachment", "https://a.test/f.pdf", None), ("p", 4, "link", "http://localhost/", None), ("p", 5, "link", "https://a.test/none", None)], "page_url string, seq int, kind string, normalized_url string, alt string")
    answers = spark.createDataFrame([("https://a.test/1", 503, "text/html", 1, b"", None), ("https://a.test/i", 200, "image/png", 5, b"x", None), ("https://a.test/f.pdf", 200, "application/pdf", 5, b"PK..", None), ("https://a.test/f.pdf", 200, "application/pdf", 5, b"PK..", None)], "url string, status_code int, content_type string, content_length long, body binary, error string")
    got = {r.seq: r.verdict for r in R.checked_resources(refs, answers).collect()}
    assert got == {1: T.REVIEW, 2: T.ERROR, 3: T.ERROR, 4: T.UNCHECKABLE, 5: T.UNCHECKABLE}
    a = spark.createDataFrame([("d", "x"), ("d", "y"), ("e", "x"), ("d", "")], "document_url string, fragment string")
    seen = R.anchors(a, spark.createDataFrame([("d", "x")], "document_url string, ref string"))
    assert sorted((r.document_url, r.fragment, r.verdict) for r in seen.collect()) == sorted([("d", "x", T.OK), ("d", "y", T.ERROR), ("e", "x", T.UNCHECKABLE), ("d", "", T.OK)])
    cache = spark.createDataFrame([("u", T.OK, dt.date(2026, 1, 1))], "normalized_url string, verdict string, next_recheck_date date")
    checked = spark.createDataFrame([("u", "p1", T.ERROR), ("u", "p1", T.OK), ("v", "p1", T.OK)], "normalized_url string, page_url string, verdict string")
    new = R.updated_cache(cache, checked, F.lit("2026-01-01").cast("date"))
    assert sorted(map(tuple, new.collect())) == [("u", T.ERROR, dt.date(2026, 1, 31)), ("v", T.OK, dt.date(2026, 1, 31))]
    old = spark.createDataFrame([("u", "p0")], "normalized_url string, page_url string")
    assert sorted(map(tuple, R.cached_pages(old, checked).collect())) == [("u", "p0"), ("u", "p1"), ("v", "p1")]


def test_performance_boundaries(spark):
    rows = [(i, "https://a.test/", 200, None, h, s, b, "", []) for i, (h, s, b) in enumerate([(0, 2.99, 0), (0, 3.0, 0), (0, 5.0, 0), (3, 1.0, 0), (4, 1.0, 0), (0, 1.0, 3 << 20)])] + [(6, "http://a.test/", None, "Timeout", 0, None, None, None, ["http://x/"])]
    df = spark.createDataFrame(rows, "i int, url string, status_code int, failure_reason string, redirect_count int, total_seconds double, received_bytes long, html string, mixed_content array<string>")
    got = {r.i: (r.verdict, r.ssl_result) for r in R.performance(df).collect()}
    assert [got[i][0] for i in range(7)] == [T.OK, T.REVIEW, T.REVIEW, T.OK, T.REVIEW, T.REVIEW, T.UNCHECKABLE] and got[6][1] == T.NOT_APPLICABLE


def test_merge_compare_and_menu(spark):
    at = dt.datetime(2026, 1, 1)
    occ = spark.createDataFrame([("t", u, s, "m", "", "x", at) for u, s in [("https://a.test/p?utm=1", "main_menu"), ("https://A.test/p", "sitemap"), ("https://b.test/", "sitemap"), ("tel:1", "main_menu")]] + [("t", "/rel/", "sitemap", "m", "https://a.test/q/", "x", at)], "target_id string, original_url string, source string, menu_path string, discovered_from string, title string, discovered_at timestamp")
    targets = spark.createDataFrame([("t", "https://a.test", []), ("o", "https://b.test", ["c.test"])], "target_id string, base_url string, allowed_domains array<string>")
    rec = I.merged(I.classified(occ, targets, U.Policy(ignored=frozenset({"utm"})))).persist()
    got = {r.normalized_url: (r.classification, r.other_target_id, r.discovery_sources) for r in rec.collect()}
    assert got == {"https://a.test/p": ("internal", None, ["main_menu", "sitemap"]), "https://b.test/": ("external", "o", ["sitemap"]), "non_http:tel:1": ("non_http", None, ["main_menu"]), "https://a.test/rel/": ("internal", None, ["sitemap"])}
    s = I.stats(rec).first()
    assert (s.original_url_count, s.normalized_url_count, s.duplicate_removed_count, s.internal) == (5, 4, 1, 2)
    src = spark.createDataFrame([("t", "menu", True, 3)], "target_id string, source string, success boolean, request_count int")
    for limit, want in ((None, T.DELETED), (3, T.DELETION_UNSURE)):
        h = I.health(src, limit)
        new = rec.where("normalized_url <> 'https://b.test/'").withColumn("titles", F.array(F.lit("y")))
        diff = {r.normalized_url: r.status for r in I.compared(rec, new, h).collect()}
        assert diff == {"https://a.test/p": T.CHANGED, "https://b.test/": want, "non_http:tel:1": T.CHANGED, "https://a.test/rel/": T.CHANGED}
        out = [(r.normalized_url, r.status) for r in I.outside_menu(rec, h).collect()]
        assert out == ([("https://a.test/rel/", T.OUTSIDE_MENU)] if limit is None else [(None, T.MENU_UNSURE)])
    old, now = (spark.createDataFrame(x, "target_id string, schema_version string, policy_fingerprint string") for x in ([("t", "1.0", "a"), ("u", "1.0", "a")], [("t", "1.0", "a"), ("u", "1.0", "b"), ("n", "1.0", "a")]))
    hs = spark.createDataFrame([("t", True), ("u", True), ("n", True)], "target_id string, healthy boolean")
    assert {r.target_id: (r.status, r.baseline_updated) for r in I.comparison_status(old, now, hs).collect()} == {"t": (T.COMPARED, True), "u": (T.INCOMPARABLE, False), "n": (T.BASELINE_MADE, True)}


def test_sitemaps(spark):
    df = spark.createDataFrame([("a", '<?xml version="1.0"?><urlset xmlns="x"><url><loc> https://a.test/?x=1&amp;y=2 </loc></url><url><loc><![CDATA[https://a.test/b]]></loc></url></urlset>'), ("b", "<sm:sitemapindex><sm:sitemap><sm:loc>https://a.test/s.xml</sm:loc></sm:sitemap></sm:sitemapindex>"), ("c", "<urlset><url><loc>broken"), ("d", None)], "url string, text string")
    assert sorted(map(tuple, I.sitemap_urls(df).collect())) == [("a", "page", "https://a.test/?x=1&y=2"), ("a", "page", "https://a.test/b"), ("b", "sitemap", "https://a.test/s.xml")]


def test_reachability_with_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("x", "y")], "src string, dst string")
    got = {r.url: r.depth for r in I.reachable(e, spark.createDataFrame([("a",)], "url string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 2}


def test_reachability_along_a_chain(spark, monkeypatch):
    monkeypatch.setattr(I, "MERGED_ROUNDS", 2)
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(9)] + [("n5", "n0")], "src string, dst string")
    got = {r.url: r.depth for r in I.reachable(e, spark.createDataFrame([("n0",), ("n0",)], "url string")).collect()}
    assert got == {f"n{i}": i for i in range(10)}


def test_page_verdict_and_completeness(spark):
    rows = [("a", "x", T.OK, None, True, False), ("a", "y", T.NOT_RUN, None, True, False), ("a", "z", T.UNCHECKABLE, None, False, False), ("b", "x", T.OK, T.HIGH, True, False), ("c", "x", T.UNCHECKABLE, None, True, False), ("d", "x", T.OK, None, True, True), ("e", "x", T.NOT_APPLICABLE, T.LOW, True, False), ("e", "w", T.REVIEW, T.LOW, True, False)]
    df = spark.createDataFrame(rows, "url string, code string, result string, severity string, required boolean, manual boolean").withColumn("location", F.lit(""))
    got = {r.url: (r.verdict, r.completeness, r.issue_count, r.representative_code) for r in V.page_verdicts(df, ["url"]).collect()}
    assert got == {"a": (T.OK, 0.5, 1, "z"), "b": (T.ERROR, 1.0, 0, None), "c": (T.UNCHECKABLE, 0.0, 1, "x"), "d": (T.REVIEW, 1.0, 0, None), "e": (T.REVIEW, 1.0, 2, "w")}


def test_lifecycle_over_runs(spark):
    from pagewarden.plans.daily import ISSUE

    issues = spark.createDataFrame([], ISSUE)
    told = []
    for day, (seen, healthy) in enumerate([("r", True), ("r", True), ("s", True), (None, False), (None, True), (None, True), ("s", True)], 1):
        now = spark.createDataFrame([("k", "t", "p", "c", T.ERROR, seen, "e", T.MIDDLE)] if seen else [], "issue_key string, target_id string, page_url string, check_code string, result string, reason string, evidence string, severity string")
        issues = spark.createDataFrame(V.reconciled(issues, now, healthy, F.timestamp_seconds(F.lit(86400 * day))).collect(), ISSUE)
        row = issues.first()
        told.append((row.lifecycle_status, row.discovery_count, row.recurred_count, list(row.changed_fields), row.blocked_reason is not None))
    assert [t[0] for t in told] == [T.NEW, T.PERSISTING, T.CHANGED, T.CHANGED, T.RESOLVED, T.RESOLVED, T.RECURRED]
    assert told[2][3] == ["reason"] and told[3][4] and told[-1][1:3] == (4, 1)
    assert len(issues.first().history) == 7


def test_fingerprint_is_that_of_sorted_json(spark):
    import hashlib
    import json

    facts = {"result": "오류", "reason": 'a "q" \\ 한', "evidence": None, "severity": "중"}
    want = hashlib.sha256(json.dumps(facts, ensure_ascii=False, sort_keys=True).encode()).hexdigest()
    lit = {k: F.lit(v).cast("string") for k, v in facts.items()}
    assert spark.range(1).select(V.fingerprint(lit["result"], lit["reason"], lit["evidence"], lit["severity"]).alias("f")).first().f == want


def test_query_interface(spark):
    rows = spark.createDataFrame([(f"k{i}", f"t{i % 2}", "m", f"T{i}", f"https://a.test/{i}", T.OK if i % 3 else T.ERROR, "x", T.NEW, 200) for i in range(30)], "issue_key string, target_id string, menu_path string, title string, url string, verdict string, issue_type string, lifecycle string, status_code int")
    f = V.filtered(rows, {"target_id": "t1"}, "A.TEST/1")
    assert f.count() == 6 and V.summary(f).first().error == f.where(F.col("verdict") == T.ERROR).count()
    assert [r.url for r in V.page_of(rows, "title", True, 2, 3).collect()] == ["https://a.test/6", "https://a.test/5", "https://a.test/4"]
    assert V.one(rows, "k3").first().title == "T3" and len(V.context(rows, ["t1", "오류"], ["url"], 2).collect()) == 2
    assert {T.ERROR in r.json or T.NEW in r.json for r in V.context(rows, [], ["url"], question="어떤 오류?").collect()} == {True}
    cut = [len(r.json) for r in V.context(rows, [], ["url"], 5, most_chars=400).collect()]
    assert sum(cut) == 400 and len(cut) == 3
    for bad in ({"page": 0}, {"size": 101}, {"sort": "x"}):
        try:
            V.page_of(rows, **bad)
            raise AssertionError
        except ValueError:
            pass


def test_screenshots_retention_and_keys(spark):
    i = spark.createDataFrame([("a", T.PERSISTING, "h", "e"), ("b", T.NEW, "h", "e"), ("c", T.PERSISTING, "x", "e")], "issue_key string, lifecycle_status string, content_hash string, evidence string")
    taken = spark.createDataFrame([(k, "h", "e", "p") for k in "abc"], "issue_key string, content_hash string, evidence string, policy_version string")
    assert {r.issue_key: r.decision for r in V.screenshots(i, taken, "p").collect()} == {"a": "reuse", "b": "capture", "c": "skip"}
    f = spark.createDataFrame([(n,) for n in ("2026-01-01", "2026-08-20", "latest", "2026-99-01")], "name string")
    assert [r.name for r in V.expired(f, F.lit("2026-08-26").cast("date"), 30).collect()] == ["2026-01-01"]
    assert len(spark.range(1).select(C.key(F.lit("a"), F.lit(None), size=20).alias("k")).first().k) == 20


def test_large_and_broken_sitemaps(spark):
    import gzip

    many = "<urlset>" + "".join(f"<url><loc>https://s.test/{i}?a=1&amp;b</loc></url>" for i in range(50_000)) + "</urlset>"
    packed = gzip.compress(many.encode())
    rows = [("big", None, packed), ("cut", None, packed[: len(packed) // 2]), ("open", many[:-20], None), ("html", "<html>no map</html>", None), ("null", None, None), ("bomb", '<!DOCTYPE x [<!ENTITY a "b">]><urlset><url><loc>&a;</loc></url></urlset>', None), ("empty", "<urlset/>", None)]
    out = I.sitemap_entries(spark.createDataFrame(rows, "url string, text string, body binary")).persist()
    assert {r.url: r.n for r in out.where("error is null").groupBy("url").agg(F.count("*").alias("n")).collect()} == {"big": 50_000}
    assert out.where("loc = 'https://s.test/49999?a=1&b' and kind = 'page'").count() == 1
    assert {r.url for r in out.where("error is not null").collect()} == {"cut", "open", "bomb"}
    assert I.sitemap_urls(spark.createDataFrame(rows[1:], "url string, text string, body binary")).count() == 0
