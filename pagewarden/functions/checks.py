"""Column expressions of the rules: verdicts, dates, texts, keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewarden.functions import terms as T

RANKS = {T.OK: 0, T.REVIEW: 1, T.UNCHECKABLE: 2, T.ERROR: 3}
DATE = r"(\d{4})\s*[-./년]\s*(\d{1,2})\s*[-./월]\s*(\d{1,2})"
BLOCK_WORDS = r"captcha|waf"


def status_verdict(status: Column) -> Column:
    """Of a page's HTTP status; 0 stands for a failed connection."""
    return (
        F.when(status.isNull() | (status == 0), T.UNCHECKABLE)
        .when(status.between(200, 299), T.OK)
        .when(status.isin(301, 302, 307, 308), T.REVIEW)
        .when(status.isin(401, 403, 429), T.UNCHECKABLE)
        .when(status.isin(404, 410) | (status >= 500), T.ERROR)
        .otherwise(T.REVIEW)
    )


def resource_verdict(status: Column, error: Column, body_start: Column) -> Column:
    """Of a resource: server errors are for review, unlike a page's."""
    blocked = error.isNotNull() | status.isin(401, 403, 429) | F.lower(F.coalesce(body_start, F.lit(""))).rlike("captcha")
    return F.when(blocked | status.isNull() | (status == 0), T.UNCHECKABLE).when(status.isin(404, 410), T.ERROR).when(status.between(200, 299), T.OK).otherwise(T.REVIEW)


def rank(verdict: Column) -> Column:
    out = F.lit(None).cast("int")
    for v, r in RANKS.items():
        out = F.when(verdict == v, r).otherwise(out)
    return out


def worst(found: Iterable[tuple[Column, Column]]) -> Column:
    """Struct (verdict, reason) of the worst of (verdict, reason) in order; of equal ones the first. Null verdicts don't count."""
    rows = [F.struct(rank(v).alias("rank"), F.lit(-i).alias("order"), v.alias("verdict"), r.alias("reason")) for i, (v, r) in enumerate(found)]
    return F.array_max(F.filter(F.array(*rows), lambda x: x["verdict"].isNotNull()))


def parsed_date(text: Column) -> Column:
    """ISO dates (the calendar day as written, whatever the offset), else the first year-month-day; null if it is none."""
    iso = F.regexp_extract(F.trim(text), r"^(\d{4}-\d{2}-\d{2})(?:$|[T ]\d{2})", 1)
    part = lambda i: F.regexp_extract(text, DATE, i)
    other = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))
    return F.coalesce(F.try_to_date(F.when(iso != "", iso), "yyyy-MM-dd"), F.try_to_date(F.when(part(1) != "", other), "yyyy-MM-dd"))


def months_before(day: Column, months: int) -> Column:
    return F.add_months(day, -months)


def applicability(url_path: Column, page_type: Column, required: Iterable[str], not_required: Iterable[str]) -> Column:
    """required, not_required or uncertain: by type, else by words in the path."""
    t, p = F.lower(F.coalesce(page_type, F.lit(""))), F.lower(url_path)
    any_of = lambda words: F.exists(F.array(*[F.lit(str(w).lower()) for w in words]), lambda w: F.contains(p, w)) if list(words) else F.lit(False)
    return (
        F.when(t.isin("list", "listing", "search", "static", "guide", "institution", "facility"), "not_required")
        .when(t.isin("detail", "notice", "post", "press", "article", "news"), "required")
        .when(any_of(required), "required")
        .when(any_of(not_required), "not_required")
        .otherwise("uncertain")
    )


def freshness_verdict(applies: Column, day: Column, archived: Column, reference: Column, review_days: int = 730, tolerance: int = 1) -> Column:
    age = F.datediff(reference, day)
    return (
        F.when(applies == "not_required", T.NOT_APPLICABLE)
        .when(applies == "uncertain", T.MANUAL)
        .when(day.isNull(), T.UNCHECKABLE)
        .when(archived, T.OK)
        .when((age < -tolerance) | (age >= review_days), T.REVIEW)
        .otherwise(T.OK)
    )


def blocked(status: Column, text: Column) -> Column:
    """A page that refuses robots."""
    start = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 4000))
    return F.coalesce(status.isin(403, 429), F.lit(False)) | start.rlike(r"captcha|access denied|\bwaf\b|web application firewall")


def transport_blocked(status: Column, text: Column) -> Column:
    """An answer after which no other transport is tried."""
    return F.coalesce(status.isin(401, 403, 429), F.lit(False)) | F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 4000)).rlike(BLOCK_WORDS)


def key(*parts: Column | str, size: int = 64) -> Column:
    """Hex digest of the parts, joined by bars; null is written as None."""
    cols = [F.coalesce(p.cast("string"), F.lit("None")) if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.substring(F.sha2(F.concat_ws("|", *cols), 256), 1, size)


def collapsed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))


def without_volatile(html: Column, classes: Iterable[str] = (), attributes: Iterable[str] = (), comments: bool = True) -> Column:
    """HTML less scripts, comments, flat elements of the given classes, and attributes that change at each load."""
    out = F.regexp_replace(html, r"(?s)<script\b.*?</script>", "")
    if comments:
        out = F.regexp_replace(out, r"(?s)<!--.*?-->", "")
    for c in classes:
        out = F.regexp_replace(out, rf'(?s)<div class="{c}">[^<]*</div>', "")
    for a in [*attributes, "nonce", "data-nonce"]:
        out = F.regexp_replace(out, rf' {a}="[^"]*"', "")
    return out


def content_hash(html: Column, patterns: Iterable[str] = ()) -> Column:
    out = collapsed(html)
    for p in patterns:
        out = F.regexp_replace(out, p, "")
    return F.sha2(out, 256)


def redacted(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, r"(?i)(api[_-]?key|token|authorization)(\s*[:=]\s*)[^\s,;&]+", "$1=[REDACTED]"), 1, 500)


def cell(value: Column) -> Column:
    """Text for a worksheet: no control characters, at most 32767 characters, and a quote before what could be a formula."""
    plain = F.substring(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), 1, 32767)
    return F.when(plain.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), plain)).otherwise(plain)


def link_cell(value: Column) -> Column:
    return F.when(F.lower(value).rlike(r"^https?://"), cell(value)).otherwise(F.lit(""))


def attachment_mismatch(url: Column, content_type: Column, start: Column) -> Column:
    """Whether an attachment's first bytes (as hex) or type don't fit the extension of its URL."""
    name, t, begin = F.lower(F.regexp_extract(url, r"^([^?#]*)", 1)), F.lower(F.coalesce(content_type, F.lit(""))), F.coalesce(start, F.lit(""))
    packed = name.rlike(r"\.(zip|docx|xlsx|pptx|hwpx)$")
    signed = F.when(name.endswith(".pdf"), begin.startswith("255044462D")).when(packed, begin.startswith("504B")).when(name.endswith(".hwp"), begin.startswith("D0CF11E0")).otherwise(True)
    typed = F.when(name.endswith(".pdf"), t.contains("pdf")).when(packed, t.rlike("zip|office|octet-stream")).otherwise(True)
    return ((begin != "") & ~signed) | ((t != "") & ~typed)
