"""A run's tables as the sheets of the report."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.plans.daily import Run

_SUMMARY = {"target_id": "대상 사이트", "total": "전체 페이지", "ok": "정상", "review": "검토 필요", "error": "오류", "uncheckable": "점검 불가", "excluded": "제외", "added": "신규", "deleted": "삭제", "changed": "변경", "resolved": "해결", "missing_scope": "누락범위 존재"}


def frames(run: Run, at: dt.datetime) -> dict[str, DataFrame]:
    """Columns of nested results are flattened to the sheets' names; of several menu paths the first in order is shown."""
    paths = run.inventory.select("target_id", F.col("normalized_url").alias("url"), F.array_min("menu_paths").alias("menu_path"), F.array_min("titles").alias("page_title"))
    placed = lambda df: df.join(paths, ["target_id", "url"], "left").withColumn("checked_at", F.lit(at))
    summary = run.summary.select(*[F.col(a).alias(b) for a, b in _SUMMARY.items()], F.lit("").alias("수집 성공"))
    fresh = placed(run.freshness).withColumnsRenamed({"published": "published_date", "modified": "modified_date"})
    refs = placed(run.resources).withColumnsRenamed({"url": "source_url", "kind": "resource_type", "normalized_url": "target_url", "reason": "problem_type", "page_title": "source_page"})
    a11y = placed(run.issues)
    perf = placed(run.performance.withColumn("mixed_content", F.array_join("mixed_content", ", ")))
    scope = run.missing.select(F.col("kind").alias("failure_type"), F.col("subject").alias("url"), "reason")
    issues = run.lifecycle.where("blocked_reason is not null").select("target_id", F.col("page_url").alias("url"), F.col("blocked_reason").alias("reason"), "issue_key", F.col("lifecycle_status"))
    return {
        "종합현황": summary,
        "콘텐츠 최신성": fresh,
        "링크·이미지·첨부": refs,
        "HTML·접근성": a11y,
        "접속상태·성능": perf,
        "점검범위·누락·실패": scope.unionByName(issues, allowMissingColumns=True),
    }
