"""Terms of verdicts, severities and lifecycles.

Fixed values: these strings are part of the data and of the reports.
"""

OK, REVIEW, ERROR, UNCHECKABLE, EXCLUDED = "정상", "검토 필요", "오류", "점검 불가", "제외"
MANUAL, NOT_APPLICABLE, NOT_RUN = "수동확인 필요", "해당 없음", "미실행"
HIGH, MIDDLE, LOW, TO_REVIEW = "상", "중", "하", "검토"
NEW, PERSISTING, CHANGED, RESOLVED, RECURRED = "신규", "지속", "변경", "해결", "재발"
EXCEPTION, FALSE_POSITIVE = "예외", "오탐"
BASELINE_MADE, COMPARED, INCOMPARABLE = "기준자료 생성", "정상 비교", "비교 불가"
ADDED, DELETED, DELETION_UNSURE, KEPT = "신규", "삭제", "삭제 확인 필요", "유지"
OUTSIDE_MENU, MENU_UNSURE, BASELINE = "메뉴 외 페이지", "메뉴 연결 여부 점검 불가", "기준자료"
STALE_LIST = "게시 최신성 지연"
SUCCESS, FAILURE = "성공", "실패"
VERDICTS = (OK, REVIEW, ERROR, UNCHECKABLE, EXCLUDED)
