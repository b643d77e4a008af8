import pytest

from pagewarden.plans import tables


def test_table_functions(spark):
    tables.register(spark)
    page = '<nav><ul><li><a href="/a">A</a><ul><li><a href="/b">B</a></li></ul></li></ul></nav><article><p>one</p><p>two <b>x</b></p></article>'
    spark.createDataFrame([(1, "u", page), (2, "v", None), (3, "w", "")], "page_id int, url string, html string").createOrReplaceTempView("own_pages")
    rows = spark.sql("SELECT * FROM page_elements(TABLE(own_pages), selector => 'article > p:nth-child(2)')").collect()
    assert [(r.page_id, r.url, r.tag, r.text, r.attrs) for r in rows] == [(1, "u", "p", "two x", {})]
    assert spark.sql("SELECT count(*) n FROM page_elements(TABLE(SELECT page_id, html FROM own_pages))").first().n == 11
    links = spark.sql("SELECT href, title, menu_path FROM menu_links(TABLE(own_pages)) ORDER BY href").collect()
    assert [tuple(r) for r in links] == [("/a", "A", "A"), ("/b", "B", "A > B")]
    for bad in ("page_elements(TABLE(SELECT 1 AS x))", "page_elements(TABLE(own_pages), selector => 'a:hover')", "page_elements(TABLE(SELECT html, 1 AS tag FROM own_pages))"):
        with pytest.raises(Exception, match="html|pseudo|names"):
            spark.sql(f"SELECT * FROM {bad}").collect()
