import datetime as dt

import pytest
from pyspark.sql import functions as F

from pagewarden.functions import checks as C
from pagewarden.functions import terms as T
from pagewarden.functions import urls as U

BASE = "https://Example.test/base/page.html"
POLICY = U.Policy(ignored=frozenset({"utm_source", "sessionid"}))


def one(spark, *values):
    """Values as columns of one row."""
    return spark.range(1).select(*values).first()


@pytest.mark.parametrize(
    ("raw", "policy", "want"),
    [
        ("../a/./b/", POLICY, "https://example.test/a/b/"),
        ("HTTPS://EXAMPLE.TEST:443", POLICY, "https://example.test/"),
        ("/x?utm_source=x&b=2&sessionid=abc", POLICY, "https://example.test/x?b=2"),
        ("/한글 문서", POLICY, "https://example.test/%ED%95%9C%EA%B8%80%20%EB%AC%B8%EC%84%9C"),
        ("https://example.test/a/?z=2&a=1&z=3", U.Policy(trailing_slash="remove", sort_query=True), "https://example.test/a?a=1&z=2&z=3"),
        ("http://h.test:8080/a//b?x#f", U.Policy(trailing_slash="add"), "http://h.test:8080/a/b/?x="),
        ("mailto:a@b.test", POLICY, None),
        ("http://h.test:x/", POLICY, None),
        ("", POLICY, None),
        (None, POLICY, None),
    ],
)
def test_normalize_any(spark, raw, policy, want):
    row = one(spark, U.normalize_any(F.lit(raw).cast("string"), F.lit(BASE), policy).alias("n"))
    assert row.n.url == want


def test_plain_and_full_normalization_agree_and_are_stable(spark):
    urls = ["http://A.test/x/../y/?b=1&a", "https://a.test:443", "https://a.test:8443/./p//q/#top", "http://a.test/?ref=1&REF=2&c=3", "ftp://a.test/", "https://a.test/a/.."]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    for policy in (U.Policy(), U.Policy(ignored=frozenset({"ref"}), trailing_slash="remove"), U.Policy(trailing_slash="add", sort_query=True)):
        for r in df.select(U.normalize(F.col("u"), policy).alias("a"), U.normalize_any(F.col("u"), F.col("u"), policy)["url"].alias("b"), U.normalize(U.normalize(F.col("u"), policy), policy).alias("c")).collect():
            assert r.a == r.b == r.c


def test_policy():
    with pytest.raises(ValueError):
        U.Policy(trailing_slash="x")
    a = U.Policy.of({"ignored_query_parameters": ["A"], "url_normalization": {"excluded_schemes": ["TEL"]}})
    assert a.ignored == {"a"} and a.excluded_schemes == {"tel"} and len(a.fingerprint()) == 16 and a.fingerprint() != U.Policy().fingerprint()


@pytest.mark.parametrize(("url", "want"), [("https://a.test/x", True), ("http://localhost/", False), ("http://x.local/", False), ("http://10.1.2.3/", False), ("http://172.20.0.1/", False), ("http://172.40.0.1/", True), ("http://127.0.0.1:8000/", False), ("http://[::1]/", False), ("http://[2001:4860::8888]/", True), ("ftp://a.test/", False), ("http://8.8.8.8/", True), ("http://169.254.1.1/", False)])
def test_safe_destination(spark, url, want):
    assert one(spark, U.safe_destination(F.lit(url)).alias("s")).s is want


def test_kind_join_srcset(spark):
    own = F.array(F.lit("a.test"))
    k = lambda u: U.kind(F.lit(u), U.normalize(F.lit(u)), own)
    assert list(one(spark, *[k(u).alias(str(i)) for i, u in enumerate(["https://a.test/x", "https://b.test/", "tel:1", "ftp://a.test/", "::"])])) == ["internal", "external", "non_http", "non_http", "invalid"]
    j = lambda h: U.join(F.lit("https://a.test/d/p.html?q#f"), F.lit(h))
    assert list(one(spark, *[j(h).alias(str(i)) for i, h in enumerate(["/x/../y", "z.html#g", "//b.test/c", "?n=1", "#top", "../up/"])])) == ["https://a.test/y", "https://a.test/d/z.html#g", "https://b.test/c", "https://a.test/d/p.html?n=1", "https://a.test/d/p.html?q#top", "https://a.test/up/"]
    assert one(spark, U.srcset(F.lit("a.png 1x, b.png  2x,")).alias("s")).s == ["a.png", "b.png"]
    r = one(spark, *[U.resource_kind(F.lit(t), F.lit(h), F.lit(d)).alias(str(i)) for i, (t, h, d) in enumerate([("a", "/x.PDF?y", False), ("a", "#t", False), ("a", "/x", True), ("img", "/x.pdf", False), ("a", "/x", False)])])
    assert list(r) == ["attachment", "anchor", "attachment", "image", "link"]


@pytest.mark.parametrize(("text", "want"), [("2024-02-29T23:00:00-05:00", dt.date(2024, 2, 29)), ("등록일 2024년 2월 9일", dt.date(2024, 2, 9)), ("2024.13.40", None), ("2023-02-29", None), ("", None), (None, None), ("on 2020/1/2 at", dt.date(2020, 1, 2))])
def test_dates(spark, text, want):
    assert one(spark, C.parsed_date(F.lit(text).cast("string")).alias("d")).d == want


@pytest.mark.parametrize(("day", "want"), [("2026-05-31", dt.date(2026, 2, 28)), ("2024-05-31", dt.date(2024, 2, 29)), ("2026-03-30", dt.date(2025, 12, 30))])
def test_calendar_months(spark, day, want):
    assert one(spark, C.months_before(F.lit(day).cast("date"), 3).alias("d")).d == want


@pytest.mark.parametrize(("status", "page", "resource"), [(200, T.OK, T.OK), (404, T.ERROR, T.ERROR), (403, T.UNCHECKABLE, T.UNCHECKABLE), (503, T.ERROR, T.REVIEW), (0, T.UNCHECKABLE, T.UNCHECKABLE), (None, T.UNCHECKABLE, T.UNCHECKABLE), (301, T.REVIEW, T.REVIEW), (418, T.REVIEW, T.REVIEW)])
def test_status(spark, status, page, resource):
    s, none = F.lit(status).cast("int"), F.lit(None).cast("string")
    assert list(one(spark, C.status_verdict(s).alias("a"), C.resource_verdict(s, none, none).alias("b"))) == [page, resource]


def test_texts(spark):
    row = one(spark, C.cell(F.lit("=CMD()\x01")).alias("a"), C.cell(F.lit("x" * 40000)).alias("b"), C.redacted(F.lit("Token: abc, API_KEY=zz")).alias("c"), C.collapsed(F.lit("\n a \t b ")).alias("d"), C.link_cell(F.lit("javascript:1")).alias("e"), C.cell(F.lit(None).cast("string")).alias("f"), C.blocked(F.lit(200), F.lit("Access Denied")).alias("g"))
    assert (row.a, len(row.b), row.c, row.d, row.e, row.f, row.g) == ("'=CMD()", 32767, "Token=[REDACTED], API_KEY=[REDACTED]", "a b", "", "", True)


def test_worst_keeps_the_first_of_equals(spark):
    w = C.worst([(F.lit(T.OK), F.lit("a")), (F.lit(T.REVIEW), F.lit("b")), (F.lit(None).cast("string"), F.lit("c")), (F.lit(T.REVIEW), F.lit("d"))])
    assert one(spark, w.alias("w")).w.reason == "b"


def test_freshness_boundary_and_applicability(spark):
    ref = F.lit("2026-08-25").cast("date")
    v = lambda d, a="required": C.freshness_verdict(F.lit(a), F.lit(d).cast("date"), F.lit(False), ref)
    assert list(one(spark, *[x.alias(str(i)) for i, x in enumerate([v("2024-08-25"), v("2024-08-26"), v("2026-08-26"), v("2026-08-27"), v(None), v("2026-01-01", "uncertain"), v("2026-01-01", "not_required")])])) == [T.REVIEW, T.OK, T.OK, T.REVIEW, T.UNCHECKABLE, T.MANUAL, T.NOT_APPLICABLE]
    a = lambda p, t: C.applicability(F.lit(p), F.lit(t), ["news"], ["about"])
    assert list(one(spark, a("/news/about", None).alias("1"), a("/about", "x").alias("2"), a("/x", "LIST").alias("3"), a("/x", "notice").alias("4"), a("/x", "").alias("5"))) == ["required", "not_required", "not_required", "required", "uncertain"]
