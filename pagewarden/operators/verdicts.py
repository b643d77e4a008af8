"""Folding checks into page verdicts, issue lifecycles across runs, coverage, and the query interface."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewarden.functions import checks as C
from pagewarden.functions import terms as T

ACTIVE = (T.NEW, T.PERSISTING, T.CHANGED, T.RECURRED)
HISTORY = 50
SEVERITY_RANKS = {T.HIGH: 0, T.MIDDLE: 1, T.LOW: 2, T.TO_REVIEW: 3}


def severity_rank(severity: Column) -> Column:
    out = F.lit(9)
    for s, r in SEVERITY_RANKS.items():
        out = F.when(severity == s, r).otherwise(out)
    return out


def page_verdicts(checks: DataFrame, keys: list[str], excluded: Column | None = None) -> DataFrame:
    """One verdict a page from checks (keys, code, result, severity, required, manual, location): one shuffle, combined before it."""
    result, required = F.col("result"), F.coalesce("required", F.lit(True))
    done = ~result.isin(T.NOT_RUN, T.UNCHECKABLE)
    n_required, n_done = F.count_if(required), F.count_if(required & done)
    counts = ~result.isin(T.OK, T.NOT_RUN, T.EXCLUDED)
    first = F.min(F.when(counts, F.struct(severity_rank(F.col("severity")).alias("rank"), "code", F.coalesce("location", F.lit("")).alias("location"), "result", "severity")))
    flags = checks.groupBy(*keys).agg(
        F.coalesce(F.bool_or((result == T.ERROR) | (F.coalesce("severity", F.lit("")) == T.HIGH)), F.lit(False)).alias("bad"),
        F.coalesce(F.bool_or(required & (result == T.UNCHECKABLE)), F.lit(False)).alias("unknown"),
        F.coalesce(F.bool_or(result.isin(T.REVIEW, T.MANUAL) | F.coalesce("manual", F.lit(False))), F.lit(False)).alias("unsure"),
        F.coalesce(F.bool_or(F.coalesce("manual", F.lit(False)) | (result == T.MANUAL)), F.lit(False)).alias("manual_review_required"),
        F.when(n_required == 0, 1.0).otherwise(F.bround(n_done / n_required, 3)).alias("completeness"),
        F.count_if(counts).alias("issue_count"),
        first.alias("first"),
    )
    verdict = F.when(F.col("bad"), T.ERROR).when(F.col("unknown"), T.UNCHECKABLE).when(F.col("unsure"), T.REVIEW).otherwise(T.OK)
    if excluded is not None:
        verdict = F.when(excluded, T.EXCLUDED).otherwise(verdict)
    return flags.select(*keys, verdict.alias("verdict"), "completeness", "issue_count", "manual_review_required", F.col("first.code").alias("representative_code"), F.col("first.result").alias("representative_result"), F.col("first.severity").alias("representative_severity"))


def site_stats(pages: DataFrame, by: list[str]) -> DataFrame:
    """Pages by verdict, zeros included."""
    return pages.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.coalesce("verdict", F.lit(T.UNCHECKABLE)) == v).alias(n) for v, n in zip(T.VERDICTS, ("ok", "review", "error", "uncheckable", "excluded"), strict=True)])


def counts(rows: DataFrame, by: str = "verdict") -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def issue_key(target: Column, page: Column, code: Column, subject: Column, problem: Column) -> Column:
    return C.key(target, page, code, subject, problem)


def fingerprint(result: Column, reason: Column, evidence: Column, severity: Column) -> Column:
    """Digest of the JSON object of the four, with sorted names and spaces after its marks."""
    q = lambda c: F.when(c.isNull(), "null").otherwise(F.to_json(F.struct(c.cast("string").alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.cast("string").alias("v")))) - 6))
    text = F.concat(F.lit('{"evidence": '), q(evidence), F.lit(', "reason": '), q(reason), F.lit(', "result": '), q(result), F.lit(', "severity": '), q(severity), F.lit("}"))
    return F.sha2(text, 256)


def reconciled(previous: DataFrame, current: DataFrame, healthy: DataFrame | Column | bool, run_at: Column) -> DataFrame:
    """Issues after a run, by a full outer join on issue_key.

    previous: issue_key, target_id, page_url, check_code, result, reason, evidence, severity, lifecycle_status,
    manual_status, first_seen, last_seen, discovery_count, recurred_count, history. current: the first eight.
    Of rows of one key the last by all columns counts. An issue that isn't seen is resolved if the sources
    were healthy, else it stays as it was with a reason. healthy: (target_id, healthy) of each target, a target
    without a row isn't; or one value for all. A resolved issue that stays away stays resolved.
    """
    facts = ("target_id", "page_url", "check_code", "result", "reason", "evidence", "severity")
    new = current.groupBy("issue_key").agg(F.max(F.struct(*facts)).alias("new"))
    old = previous.select("issue_key", F.struct(*[c for c in previous.columns if c != "issue_key"]).alias("old"))
    rows = old.join(new, "issue_key", "full_outer")
    if isinstance(healthy, DataFrame):
        rows = rows.withColumn("target", F.coalesce("old.target_id", "new.target_id")).join(healthy.select(F.col("target_id").alias("target"), "healthy"), "target", "left")
        ok = F.coalesce("healthy", F.lit(False))
    else:
        ok = healthy if isinstance(healthy, Column) else F.lit(healthy)
    seen, was = F.col("new").isNotNull(), F.col("old.lifecycle_status")
    diff = [~F.col(f"old.{f}").eqNullSafe(F.col(f"new.{f}")) for f in ("result", "reason", "evidence", "severity")]
    names = F.filter(F.array(*[F.when(d, F.lit(f)) for d, f in zip(diff, ("result", "reason", "evidence", "severity"), strict=True)]), lambda x: x.isNotNull())
    manual = F.col("old.manual_status")
    status = (
        F.when(seen & F.col("old").isNull(), T.NEW)
        .when(seen & (was == T.RESOLVED), T.RECURRED)
        .when(seen & manual.isin(T.EXCEPTION, T.FALSE_POSITIVE), manual)
        .when(seen & (F.size(names) > 0), T.CHANGED)
        .when(seen, T.PERSISTING)
        .when(was == T.RESOLVED, T.RESOLVED)
        .when(ok, T.RESOLVED)
        .otherwise(was)
    )
    held = F.coalesce(F.col("old.history"), F.array().cast("array<struct<at: timestamp, status: string>>"))
    rows = rows.withColumn("s", status)
    moved = F.concat(held, F.array(F.struct(run_at.cast("timestamp").alias("at"), F.col("s").alias("status"))))
    one = lambda f: F.when(seen, F.col(f"new.{f}")).otherwise(F.col(f"old.{f}")).alias(f)
    return rows.select(
        "issue_key",
        *[one(f) for f in facts],
        F.col("s").alias("lifecycle_status"),
        manual.alias("manual_status"),
        F.coalesce("old.first_seen", run_at.cast("timestamp")).alias("first_seen"),
        F.when(seen, run_at.cast("timestamp")).otherwise(F.col("old.last_seen")).alias("last_seen"),
        (F.coalesce("old.discovery_count", F.lit(0)) + seen.cast("int")).alias("discovery_count"),
        (F.coalesce("old.recurred_count", F.lit(0)) + (F.col("s") == T.RECURRED).cast("int")).alias("recurred_count"),
        F.when(F.col("s") == T.CHANGED, names).otherwise(F.array().cast("array<string>")).alias("changed_fields"),
        F.when(~seen & ~ok & (was != T.RESOLVED), "수집원 비정상으로 해결 판정 보류").alias("blocked_reason"),
        F.slice(moved, F.greatest(F.size(moved) - HISTORY + 1, F.lit(1)), HISTORY).alias("history"),
    )


def buckets(issues: DataFrame) -> DataFrame:
    """issues with bucket: active, resolved, or manual."""
    s = F.col("lifecycle_status")
    return issues.withColumn("bucket", F.when(s == T.RESOLVED, "resolved").when(s.isin(T.EXCEPTION, T.FALSE_POSITIVE), "manual").otherwise("active"))


def lifecycle(seen: DataFrame, key: list[str], run: str, facts: list[str]) -> DataFrame:
    """Status of each appearance of an issue over many consecutive runs (a day number), in one window pass."""
    w = Window.partitionBy(*key).orderBy(run)
    before = F.lag(run).over(w)
    same = F.lit(True)
    for f in facts:
        same = same & F.lag(f).over(w).eqNullSafe(F.col(f))
    status = F.when(before.isNull(), T.NEW).when(F.col(run) - before > 1, T.RECURRED).when(same, T.PERSISTING).otherwise(T.CHANGED)
    return seen.withColumn("status", status)


def coverage(urls: DataFrame, sources: DataFrame, checks: DataFrame) -> DataFrame:
    """One row of how much was covered: urls (classification, duplicate, excluded, status), sources (success), checks (status, required)."""
    u = urls.agg(
        F.count(F.lit(1)).alias("discovered"), F.count_if(F.col("classification") == "internal").alias("internal"), F.count_if(F.col("classification") == "external").alias("external"),
        F.count_if(F.coalesce("duplicate", F.lit(False))).alias("duplicates"), F.count_if(F.coalesce("excluded", F.lit(False))).alias("excluded"), F.count_if(F.col("status") == T.SUCCESS).alias("inspected"),
    )
    s = sources.agg(F.count_if("success").alias("sources_ok"), F.count_if(~F.coalesce("success", F.lit(False))).alias("sources_failed"))
    req = F.coalesce("required", F.lit(True))
    n, done = F.count_if(req), F.count_if(req & ~F.col("status").isin(T.NOT_RUN, T.UNCHECKABLE))
    c = checks.agg(F.when(n == 0, 1.0).otherwise(F.bround(done / n, 3)).alias("completion"))
    one = lambda df: df.withColumn("all", F.lit(1))
    return one(u).join(one(s), "all").join(one(c), "all").drop("all")


def missing_scope(urls: DataFrame, sources: DataFrame, limit_reached: Column | bool = False) -> DataFrame:
    """What wasn't inspected: pages, failed sources, and whether the limit was reached."""
    limit = limit_reached if isinstance(limit_reached, Column) else F.lit(limit_reached)
    pages = urls.where(F.coalesce("uninspected", F.lit(False))).select(F.lit("page").alias("kind"), F.col("normalized_url").alias("subject"), F.coalesce("status", F.lit(T.NOT_RUN)).alias("reason"))
    failed = sources.where(~F.coalesce("success", F.lit(False))).select(F.lit("source").alias("kind"), F.col("source").alias("subject"), "reason")
    capped = sources.limit(1).where(limit).select(F.lit("limit").alias("kind"), F.lit(None).cast("string").alias("subject"), F.lit("요청 상한 도달").alias("reason"))
    return pages.unionByName(failed).unionByName(capped)


def screenshots(issues: DataFrame, taken: DataFrame, policy: str, states: Iterable[str] = (T.NEW, T.RECURRED, T.CHANGED, T.MANUAL), force: bool = False) -> DataFrame:
    """capture, reuse or skip for each issue (issue_key, lifecycle_status, content_hash, evidence) by what was taken before."""
    old = taken.select("issue_key", F.col("content_hash").alias("old_hash"), F.col("evidence").alias("old_evidence"), "policy_version")
    same = (F.col("lifecycle_status") == T.PERSISTING) & F.col("old_hash").eqNullSafe(F.col("content_hash")) & F.col("old_evidence").eqNullSafe(F.col("evidence")) & (F.col("policy_version") == policy)
    choice = F.when(F.lit(force), "capture").when(F.coalesce(same, F.lit(False)), "reuse").when(F.col("lifecycle_status").isin(*states), "capture").otherwise("skip")
    return issues.join(old, "issue_key", "left").select(*issues.columns, choice.alias("decision"))


def redacted_failures(failures: DataFrame) -> DataFrame:
    return failures.withColumn("reason", C.redacted(F.col("reason")))


FILTERS = ("target_id", "menu_path", "verdict", "issue_type", "lifecycle")
SORTS = ("url", "title", "target_id", "menu_path", "verdict", "lifecycle", "status_code")


def filtered(rows: DataFrame, where: Mapping[str, str], search: str | None = None) -> DataFrame:
    """Rows whose columns equal the given texts, and whose URL holds the search text in any case."""
    for name, value in where.items():
        if name not in FILTERS:
            raise ValueError(f"no filter by {name}")
        rows = rows.where(F.coalesce(F.col(name).cast("string"), F.lit("")) == value)
    return rows.where(F.contains(F.lower("url"), F.lit(search.lower()))) if search else rows


def page_of(rows: DataFrame, sort: str = "url", descending: bool = False, page: int = 1, size: int = 25, tie: str = "url") -> DataFrame:
    if sort not in SORTS or page < 1 or not 1 <= size <= 100:
        raise ValueError("unknown column, or page or size out of range")
    by = F.coalesce(F.col(sort).cast("string"), F.lit(""))
    return rows.orderBy(by.desc() if descending else by.asc(), tie).offset((page - 1) * size).limit(size)


def summary(rows: DataFrame) -> DataFrame:
    """Totals over what is filtered: by verdict and by lifecycle."""
    v = [F.count_if(F.col("verdict") == x).alias(n) for x, n in zip(T.VERDICTS, ("ok", "review", "error", "uncheckable", "excluded"), strict=True)]
    s = [F.count_if(F.col("lifecycle") == x).alias(n) for x, n in zip((*ACTIVE, T.RESOLVED), ("new", "persisting", "changed", "recurred", "resolved"), strict=True)]
    return rows.agg(F.count(F.lit(1)).alias("total"), *v, *s)


def one(rows: DataFrame, key: str) -> DataFrame:
    return rows.where((F.col("issue_key") == key) | (F.col("url") == key)).orderBy("issue_key", "url").limit(1)


# Words of a question about issues, and of the rows that answer it.
ISSUE_QUESTIONS, ISSUE_ROWS = ("오류", "문제", "신규", "재발"), ("오류", "신규", "재발")
CONTEXT_FILTERS = ("target_id", "url", "menu_path", "verdict", "issue_type", "lifecycle")


def context(rows: DataFrame, words: Iterable[str], order: list[str], most: int = 30, *, question: str = "", most_chars: int | None = None) -> DataFrame:
    """The first rows, as JSON, that hold all words; without words, a question about issues gets the rows that tell of some.

    With most_chars, the JSON of all rows together is cut off there (the feature: a prompt has that room).
    """
    words = list(words)
    found = rows.withColumn("json", F.to_json(F.struct(*rows.columns)))
    for w in words:
        found = found.where(F.contains(F.lower("json"), F.lit(w.lower())))
    if not words and any(q in question.lower() for q in ISSUE_QUESTIONS):
        found = found.where(F.col("json").rlike("|".join(ISSUE_ROWS)))
    top = found.orderBy(*order).limit(most).select(*order, "json")
    if most_chars is None:
        return top
    before = F.coalesce(F.sum(F.length("json")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over most rows
    return top.withColumn("room", F.lit(most_chars) - before).where("room > 0").select(*order, F.expr("substring(json, 1, cast(room as int))").alias("json"))


def status(runs: DataFrame) -> DataFrame:
    """The last run of the history (run_id, recorded_at, ...)."""
    return history(runs, 1)


def history(rows: DataFrame, most: int = HISTORY) -> DataFrame:
    return rows.orderBy(F.desc("recorded_at"), F.desc("run_id")).limit(most)


def report_summary(pages: DataFrame, diff: DataFrame, missing: DataFrame) -> DataFrame:
    """Per target: pages by verdict, URLs by change, and whether scope is missing."""
    p = site_stats(pages, ["target_id"])
    d = diff.groupBy("target_id").agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in ((T.ADDED, "added"), (T.DELETED, "deleted"), (T.CHANGED, "changed"), (T.RESOLVED, "resolved"))])
    m = missing.select("target_id").distinct().withColumn("m", F.lit("Y"))
    names = ("added", "deleted", "changed", "resolved")
    return p.join(d, "target_id", "left").join(m, "target_id", "left").select(*p.columns, *[F.coalesce(n, F.lit(0)).alias(n) for n in names], F.coalesce("m", F.lit("N")).alias("missing_scope")).orderBy("target_id")


def expired(folders: DataFrame, today: Column, keep_days: int = 90) -> DataFrame:
    """Dated folders strictly older than the cutoff; others, such as latest, never."""
    return folders.where(F.col("name").rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.try_to_date("name", "yyyy-MM-dd") < F.date_sub(today, keep_days)))
