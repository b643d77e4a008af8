"""The SQL surface: table functions over pages, whose columns follow those of the table that they are given.

    register(spark)
    SELECT * FROM page_elements(TABLE(SELECT page_id, html FROM pages))
    SELECT * FROM page_elements(TABLE(pages), selector => 'article > p:first-child')
    SELECT * FROM menu_links(TABLE(pages), selector => '#menu a')

Each needs a column html; all other columns of the table come back before those of the function.
"""

from __future__ import annotations

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult
from pyspark.sql.types import IntegerType, MapType, StringType, StructField, StructType

from pagewarden.sources import dom

TEXT = StringType()


def _analyzed(table: AnalyzeArgument, own: list[StructField], selector: AnalyzeArgument | None) -> AnalyzeResult:
    if not table.isTable:
        raise ValueError("a table is needed: TABLE(...)")
    if "html" not in table.dataType.names:
        raise ValueError("the table has no column html")
    if selector is not None:
        if not selector.isConstantExpression or not isinstance(selector.value, str):
            raise ValueError("selector must be a constant text")
        dom.compiled((selector.value,))
    kept = [f for f in table.dataType.fields if f.name != "html"]
    clash = {f.name for f in kept} & {f.name for f in own}
    if clash:
        raise ValueError(f"the table has columns of the result's names: {', '.join(sorted(clash))}")
    return AnalyzeResult(schema=StructType([*kept, *own]))


def _others(row: Row) -> tuple:
    return tuple(v for k, v in row.asDict(recursive=False).items() if k != "html")


class PageElements:
    """Elements of pages in order, all of them or those that fit a selector: place, tag, attributes, and all text in them."""

    @staticmethod
    def analyze(table: AnalyzeArgument, selector: AnalyzeArgument | None = None) -> AnalyzeResult:
        return _analyzed(table, [StructField("seq", IntegerType()), StructField("parent", IntegerType()), StructField("tag", TEXT), StructField("attrs", MapType(TEXT, TEXT)), StructField("text", TEXT)], selector)

    def eval(self, table: Row, selector: str | None = None):
        tree = dom.elements_of(table["html"], (selector,) if selector else ())
        c, others = tree.columns, _others(table)
        for i in range(len(c["seq"])):
            if not selector or c["fits"][i]:
                yield (*others, c["seq"][i], c["parent"][i], c["tag"][i], dict(c["attrs"][i]), " ".join(tree.texts[c["text_start"][i] : c["text_end"][i]]))


class MenuLinks:
    """Links of menus: href, title, and the labels of the list items around, the outermost first."""

    @staticmethod
    def analyze(table: AnalyzeArgument, selector: AnalyzeArgument | None = None) -> AnalyzeResult:
        return _analyzed(table, [StructField("href", TEXT), StructField("title", TEXT), StructField("menu_path", TEXT)], selector)

    def eval(self, table: Row, selector: str | None = None):
        tree = dom.elements_of(table["html"], (selector or "nav a, header a",))
        c, others = tree.columns, _others(table)
        text = lambda i: " ".join(tree.texts[c["text_start"][i] : c["text_end"][i]])
        label: dict[int, str] = {}
        for i, tag in enumerate(c["tag"]):
            if tag == "a" and c["parent"][i] >= 0 and c["tag"][c["parent"][i]] == "li":
                label.setdefault(c["parent"][i], text(i))
        for i, tag in enumerate(c["tag"]):
            attrs = dict(c["attrs"][i]) if c["fits"][i] else {}
            if "href" in attrs:
                names, up = [], c["parent"][i]
                while up >= 0:
                    if c["tag"][up] == "li":
                        names.append(label.get(up, c["own_text"][up]))
                    up = c["parent"][up]
                yield (*others, attrs["href"], text(i), " > ".join(n for n in reversed(names) if n))


FUNCTIONS = {"page_elements": PageElements, "menu_links": MenuLinks}


def register(spark: SparkSession) -> None:
    from pyspark.sql.functions import udtf

    for name, cls in FUNCTIONS.items():
        spark.udtf.register(name, udtf(cls))
