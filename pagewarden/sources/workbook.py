"""A workbook of a report's sheets, which are bounded tables of one run."""

from __future__ import annotations

import io
import os
import shutil
import zipfile
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.functions import checks as C

#: Sheets and columns of the report.
SHEETS = {
    "종합현황": ["대상 사이트", "전체 페이지", "정상", "검토 필요", "오류", "점검 불가", "제외", "신규", "삭제", "변경", "해결", "수집 성공", "누락범위 존재"],
    "콘텐츠 최신성": ["target_id", "menu_path", "page_title", "url", "published_date", "modified_date", "extraction_method", "problem_type", "verdict", "evidence", "checked_at"],
    "링크·이미지·첨부": ["target_id", "menu_path", "source_page", "source_url", "resource_type", "target_url", "status_code", "final_url", "problem_type", "severity", "recommendation"],
    "HTML·접근성": ["target_id", "menu_path", "url", "code", "name", "element", "location", "result", "severity", "evidence", "recommendation", "content_hash", "cache_used", "checked_at"],
    "접속상태·성능": ["target_id", "menu_path", "url", "status_code", "final_url", "redirect_count", "total_seconds", "received_bytes", "console_error_count", "ssl_result", "mixed_content", "verdict", "reason", "checked_at"],
    "점검범위·누락·실패": ["target_id", "source", "url", "normalized_url", "classification", "status", "stage", "failure_type", "reason", "retry_count", "screenshot_path", "checked_at", "issue_key", "lifecycle_status"],
}
EMPTY = "결과 없음"
COLORS = {"정상": "C6EFCE", "검토 필요": "FFEB9C", "오류": "FFC7CE", "점검 불가": "D9E1F2", "제외": "E7E6E6"}
HEAD_FILL, HEAD_TEXT = "1F4E78", "FFFFFF"
LINKED, LINKED_FILES = ("url", "source_url", "target_url"), ("screenshot_path",)
MOST_ROWS = 1_048_575  # what a worksheet can hold under its header


def sheet(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cells as text, columns that df lacks left blank."""
    return df.select(*[C.cell(F.col(f"`{c}`")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns])


def _column(i: int) -> str:
    return (_column(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)


def _xml(columns: list[str], rows: list[tuple]) -> tuple[str, list[str]]:
    """A sheet, and where its links go, in their order: links outside the workbook are relationships of the sheet."""
    styles = {v: i + 2 for i, v in enumerate(COLORS)}  # 0: plain, 1: the head
    width = [len(c) for c in columns]
    for r in rows:
        width = [max(w, len(str(v))) for w, v in zip(width, r, strict=True)]
    cell = lambda c, r, v, s: f'<c r="{_column(c)}{r}" t="inlineStr" s="{s}"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
    head = "".join(cell(i, 1, c, 1) for i, c in enumerate(columns))
    lines = [f'<row r="1">{head}</row>', *(f'<row r="{k}">{"".join(cell(i, k, str(v), styles.get(v, PLAIN)) for i, v in enumerate(r))}</row>' for k, r in enumerate(rows, 2))]
    last = f"{_column(len(columns) - 1)}{len(rows) + 1}"
    goes, links = [], []
    for k, r in enumerate(rows, 2):
        for i, (c, v) in enumerate(zip(columns, r, strict=True)):
            if c in LINKED and str(v).startswith(("http://", "https://")) or c in LINKED_FILES and v:
                goes.append(str(v))
                links.append(f'<hyperlink ref="{_column(i)}{k}" r:id="l{len(goes)}"/>')
    text = (
        '<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><cols>'
        + "".join(f'<col min="{i}" max="{i}" width="{min(45, max(10, w + 2))}" customWidth="1"/>' for i, w in enumerate(width, 1))
        + f'</cols><sheetData>{"".join(lines)}</sheetData><autoFilter ref="A1:{last}"/>'
        + (f"<hyperlinks>{''.join(links)}</hyperlinks>" if links else "")
        + "</worksheet>"
    )
    return text, goes


PLAIN = len(COLORS) + 2  # of cells without a verdict: at the top, wrapped


def workbook(sheets: dict[str, tuple[list[str], list[tuple]]]) -> bytes:
    out = io.BytesIO()
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        n = len(sheets)
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, n + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{rel}"><sheets>{"".join(f"<sheet name={quoteattr(s)} sheetId=\"{i}\" r:id=\"r{i}\"/>" for i, s in enumerate(sheets, 1))}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(f"<Relationship Id=\"r{i}\" Type=\"{rel}/worksheet\" Target=\"worksheets/sheet{i}.xml\"/>" for i in range(1, n + 1))}<Relationship Id="s" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        fills = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c}"/></patternFill></fill>' for c in (HEAD_FILL, *COLORS.values()))
        top = '<alignment vertical="top" wrapText="1"/>'
        z.writestr("xl/styles.xml", f'<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><fonts count="2"><font/><font><b/><color rgb="FF{HEAD_TEXT}"/></font></fonts><fills count="{len(COLORS) + 3}"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fills}</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{len(COLORS) + 3}"><xf/><xf fontId="1" fillId="2" applyFont="1" applyFill="1" applyAlignment="1"><alignment wrapText="1"/></xf>{"".join(f"<xf fillId=\"{i}\" applyFill=\"1\" applyAlignment=\"1\">{top}</xf>" for i in range(3, len(COLORS) + 3))}<xf applyAlignment="1">{top}</xf></cellXfs></styleSheet>')
        for i, (columns, rows) in enumerate(sheets.values(), 1):
            text, goes = _xml(columns, rows or [(EMPTY, *[""] * (len(columns) - 1))])
            z.writestr(f"xl/worksheets/sheet{i}.xml", text)
            if goes:
                targets = "".join(f'<Relationship Id="l{k}" Type="{rel}/hyperlink" Target={quoteattr(v)} TargetMode="External"/>' for k, v in enumerate(goes, 1))
                z.writestr(f"xl/worksheets/_rels/sheet{i}.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{targets}</Relationships>')
    return out.getvalue()


def save(frames: dict[str, DataFrame], path: str) -> str:
    """Writes a report whose sheets are frames, by name; a sheet without a frame says that it is empty.

    Rows are counted before they come to the driver; more than a worksheet can hold are refused.
    """
    held = {}
    for name, columns in SHEETS.items():
        if name not in frames:
            held[name] = (columns, [])
            continue
        rows = sheet(frames[name], columns)
        if rows.limit(MOST_ROWS + 1).count() > MOST_ROWS:
            raise ValueError(f"{name} doesn't fit into a worksheet; write it as a table")
        held[name] = (columns, [tuple(r) for r in rows.toLocalIterator()])
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    temporary = f"{path}.part"
    with open(temporary, "wb") as f:
        f.write(workbook(held))
    os.replace(temporary, path)
    return path


def save_dated(frames: dict[str, DataFrame], root: str, day: str) -> str:
    """The report of a day in a folder of its own, and the same as the latest one."""
    path = save(frames, f"{root}/{day}/페이지별_점검결과_{day}.xlsx")
    latest = f"{root}/latest/페이지별_점검결과.xlsx"
    os.makedirs(os.path.dirname(latest), exist_ok=True)
    shutil.copyfile(path, f"{latest}.part")
    os.replace(f"{latest}.part", latest)
    return path
