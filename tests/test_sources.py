import zipfile
from xml.etree import ElementTree

import pytest
import yaml
from pyspark.sql import functions as F

from pagewarden.functions import terms as T
from pagewarden.sources import config, state, transport, workbook


def write(folder, rules=None, targets=None):
    crawl = {"concurrency": 1, "request_interval_seconds": 1.0, "timeout_seconds": 15, "max_urls": 10} | (rules or {})
    (folder / "rules.yaml").write_text(yaml.safe_dump({"crawl": crawl}))
    (folder / "targets.yaml").write_text(yaml.safe_dump({"targets": targets or {"a": {"name": "A", "base_url": "https://a.test/", "allowed_domains": ["b.test"]}}}))
    (folder / "exclusions.yaml").write_text(yaml.safe_dump({"ignored_query_parameters": ["x"]}))
    return folder


def test_config(spark, tmp_path):
    held = config.load(write(tmp_path))
    assert held.targets[0].base_url == "https://a.test" and config.targets_frame(spark, held).first().allowed_domains == ["b.test"]
    for bad in ({"concurrency": 2}, {"concurrency": True}, {"request_interval_seconds": 0.5}, {"max_urls": 11}, {"timeout_seconds": True}):
        with pytest.raises(config.ConfigError):
            config.load(write(tmp_path, bad))
    for bad in ("http://a.test", "https://a.test/x", "", None):
        with pytest.raises(config.ConfigError):
            config.load(write(tmp_path, targets={"a": {"name": "A", "base_url": bad}}))
    with pytest.raises(config.ConfigError):
        config.read(tmp_path / "none.yaml")


def test_environment_never_overrides(tmp_path, monkeypatch):
    monkeypatch.setenv("HELD_NAME", "1")
    (tmp_path / "e").write_text("HELD_NAME=2\n# c\nexport FRESH_NAME='a b'\n")
    monkeypatch.delenv("FRESH_NAME", raising=False)
    assert config.load_environment(tmp_path / "e") == {"FRESH_NAME": "a b"}
    monkeypatch.delenv("FRESH_NAME", raising=False)
    assert config.load_environment(tmp_path / "none") == {}


def test_state_versions_history_and_lock(spark, tmp_path):
    s = state.State(spark, f"file://{tmp_path}/s")
    assert s.load("t", "x long").count() == 0
    for i in range(4):
        old = s.load("t", "id long")
        s.save("t", old.union(spark.range(i, i + 1)))  # reads what it replaces
    assert s.load("t", "id long").count() == 4 and s.load("t", "id long", back=1).count() == 3 and s.versions("t") == [3, 4]
    s.append_history(spark.createDataFrame([("r", 0)], "run_id string, exit_code int"))
    assert s.history("run_id string, exit_code int").first().run_id == "r"
    with s.lock(), pytest.raises(state.LockedError), s.lock():
        pass
    with s.lock():
        pass


def test_tables_of_a_run_are_seen_together(spark, tmp_path):
    """A run that dies between any two tables leaves those of the run before, and the next one clears away what it left."""
    s = state.State(spark, f"file://{tmp_path}/s")
    tables = ("a", "b", "c")
    with s.commit(run="1") as c:
        for t in tables:
            c.save(t, spark.range(1))
    for dies_after in range(len(tables) + 1):
        with pytest.raises(RuntimeError), s.lock() as lease, s.commit(lease, "2") as c:
            for t in tables[:dies_after]:
                c.save(t, spark.range(9))
            raise RuntimeError
        assert [s.load(t, "id long").count() for t in tables] == [1, 1, 1]
    with s.commit(run="3") as c:
        c.save("a", spark.range(2))
    assert [s.load(t, "id long").count() for t in tables] == [2, 1, 1] and s.manifests()[-1]["run"] == "3"
    assert s.load("a", "id long", back=1).count() == 1
    assert [len(s._written(t)) for t in tables] == [2, 1, 1]


def test_a_lease_that_ended_is_taken_over_and_its_holder_refused(spark, tmp_path):
    now = [1000.0]
    s = state.State(spark, f"file://{tmp_path}/s", clock=lambda: now[0])
    dead = s.acquire(seconds=60)
    with pytest.raises(state.LockedError):
        s.acquire()
    now[0] += 50
    dead.renew()
    now[0] += 50
    with pytest.raises(state.LockedError):
        s.acquire()
    now[0] += 61
    late = s.commit(dead, "late")
    writer = late.__enter__()
    writer.save("t", spark.range(7))
    with s.lock() as lease:
        assert lease.epoch == dead.epoch + 1
        with pytest.raises(state.FencedError):
            writer.save("t", spark.range(8))
        with s.commit(lease, "new") as c:
            c.save("t", spark.range(3))
        with pytest.raises(state.FencedError):
            late.__exit__(None, None, None)
        dead.release()  # of no effect
        with pytest.raises(state.LockedError):
            s.acquire()
    assert s.load("t", "id long").count() == 3 and [m["run"] for m in s.manifests()] == ["new"]
    # A manifest of an older epoch that got in all the same is never the newest.
    s._write(f"manifests/{dead.epoch:012d}-000009.json", {"epoch": dead.epoch, "run": "late", "tables": {"t": 99}})
    assert s.manifests()[-1]["run"] == "new" and s.acquire().epoch == 3


def exchanges(df):
    """Plan lines of exchanges, and of scans, in the plan as it ran."""
    df.write.format("noop").mode("overwrite").save()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.count("Exchange hashpartitioning"), text


def test_joins_with_bucketed_state_leave_it_in_place(spark, tmp_path):
    """The kept side of a comparison and of a reconciliation is neither shuffled nor, with a file a bucket, sorted."""
    from pagewarden.operators import inventory as I
    from pagewarden.operators import verdicts as V
    from pagewarden.plans import daily

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        s = state.State(spark, f"file://{tmp_path}/s")
        fill = lambda schema, rows: spark.createDataFrame(rows, schema)
        names = [c.split()[0] for c in daily.RECORD.replace("array<string>", "a").split(", ")]
        record = lambda i, title: tuple("t" if n == "target_id" else f"u{i}" if n == "normalized_url" else [title] if n == "titles" else None for n in names)
        old, new = fill(daily.RECORD, [record(i, "a") for i in range(60)]), fill(daily.RECORD, [record(i, "a" if i % 2 else "b") for i in range(5, 70)])
        with s.commit() as c:
            c.save("inventory", old, keys=["target_id", "normalized_url"])
            c.save("plain", old)
        healths = fill("target_id string, healthy boolean, reason string", [("t", True, None)])
        other = state.State(spark.newSession(), s.root)  # a session that didn't write it
        for held in (s.load("inventory", daily.RECORD), other.load("inventory", daily.RECORD)):
            kept = I.compared(held, new, healths)
            assert sorted(map(str, kept.collect())) == sorted(map(str, I.compared(s.load("plain", daily.RECORD), new, healths).collect()))
        n_plain, _ = exchanges(I.compared(s.load("plain", daily.RECORD), new, healths))
        n_kept, plan = exchanges(I.compared(s.load("inventory", daily.RECORD), new, healths))
        assert n_kept < n_plain and "SelectedBucketsCount" in plan, plan

        issue = "issue_key string, target_id string, page_url string, check_code string, result string, reason string, evidence string, severity string"
        seen = fill(issue, [(f"k{i}", "t", "p", "c", "r", "x", "e", "s") for i in range(40)])
        empty = s.load("issues", daily.ISSUE)
        first = V.reconciled(empty, seen, True, F.lit("2026-01-01").cast("timestamp"))
        with s.commit() as c:
            c.save("issues", first, keys=["issue_key"])
            c.save("plain_issues", first)
        again = lambda name: V.reconciled(s.load(name, daily.ISSUE), seen.where("issue_key <> 'k3'"), True, F.lit("2026-01-02").cast("timestamp"))
        assert sorted(map(str, again("issues").collect())) == sorted(map(str, again("plain_issues").collect()))
        assert exchanges(again("issues"))[0] < exchanges(again("plain_issues"))[0]
        with s.commit() as c:
            c.save("inventory", new, keys=["target_id", "normalized_url"], buckets=2)
        assert s.load("inventory", daily.RECORD).count() == 65 and s.load("inventory", daily.RECORD, back=1).count() == 60
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_accounts_and_payload(spark):
    df, seen = state.accounted(spark.range(5), "checks", F.col("id") > 2)
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"processed": 5, "failed": 2}
    rows = spark.createDataFrame([(T.OK,), (T.ERROR,), (T.OK,)], "verdict string")
    assert state.state_payload(rows, "x").first().payload == '{"schema_version":"1.0","issue_type":"x","counts":{"오류":1,"정상":2}}'


def test_fixture_is_read_strictly(spark, tmp_path):
    (tmp_path / "f.json").write_text('[{"url": "u", "status_code": 200}]')
    assert state.read_fixture(spark, f"file://{tmp_path}/f.json", "url string, status_code int").first().status_code == 200
    (tmp_path / "g.json").write_text('[{"url": ')
    with pytest.raises(Exception):
        state.read_fixture(spark, f"file://{tmp_path}/g.json", "url string").collect()


def test_recorded_and_fallback(spark):
    held = spark.createDataFrame([("https://a.test/x/", 500, "h"), ("https://a.test/x/", 404, "h")], "url string, status_code int, html string")
    got = {r.url: r.status_code for r in transport.recorded(spark.createDataFrame([("https://a.test/x",), ("https://a.test/x/",), ("https://b.test",)], "url string"), held).collect()}
    assert got == {"https://a.test/x": 404, "https://a.test/x/": 404, "https://b.test": 200}
    rows = [("1", "proxy_http", None, None, "refused"), ("1", "http", 200, "", None), ("2", "proxy_http", 403, "", None), ("2", "http", 200, "", None), ("3", "proxy_http", None, None, "a"), ("3", "http", None, None, "b"), ("3", "browser", None, None, "c")]
    out = transport.fallback(spark.createDataFrame(rows, "url string, transport string, status_code int, html string, error string"), transport.order_of("auto"))
    assert {r.url: (r.transport, r.fallback_used) for r in out.collect()} == {"1": ("http", True), "2": ("proxy_http", False), "3": ("browser", True)}
    with pytest.raises(ValueError):
        transport.order_of("x")


def test_fetch_is_paced_bounded_and_never_fails(spark):
    def client(url):
        if url.endswith("b"):
            raise OSError("no")
        return {"status_code": 200, "html": "x"}

    rows = transport.fetched(spark.createDataFrame([("b",), ("a",), ("a",), ("c",)], "url string"), client, interval=0.01, budget=2).collect()
    assert [(r.url, r.status_code, r.error) for r in rows] == [("a", 200, None), ("b", None, "OSError: no")]


def test_report_files_and_dated_reports(spark, tmp_path):
    workbook.save_dated({}, f"{tmp_path}/r", "2026-01-02")
    got = {(r.name, r.path.split("/")[-2]) for r in state.report_files(spark, f"file://{tmp_path}/r").collect()}
    assert {d for _, d in got} == {"2026-01-02", "latest"}
    with pytest.raises(ValueError):
        state.report_files(spark, f"file://{tmp_path}/r", "../*")


def test_resources_are_asked_for_once_by_head_then_get(spark):
    from pagewarden.operators import rules as R

    def client(method, url):
        if url.endswith("down"):
            raise OSError("no")
        if url.endswith("old") and method == "HEAD":
            return {"status_code": 405}
        return {"status_code": 200, "content_type": "application/pdf" if url.endswith("pdf") else "text/html", "content_length": 9, "body": b"%PDF-1.7" if method == "GET" else b"", "final_url": url}

    rows = [("link", "https://a.test/old"), ("link", "https://a.test/old"), ("attachment", "https://a.test/f.pdf"), ("link", "https://b.test/down"), ("link", "http://localhost/x"), ("link", "https://a.test/")]
    refs = spark.createDataFrame([("p", i, k, u, None) for i, (k, u) in enumerate(rows)], "page_url string, seq int, kind string, normalized_url string, alt string")
    answers = transport.resource_answers(refs, client, interval=0.0).persist()
    assert sorted((r.method, r.url[14:]) for r in answers.collect()) == [("GET", "/down"), ("GET", "/f.pdf"), ("GET", "/old"), ("HEAD", "/"), ("HEAD", "/down"), ("HEAD", "/f.pdf"), ("HEAD", "/old")]
    got = {r.seq: r.verdict for r in R.checked_resources(refs, answers).collect()}
    assert got == {0: T.OK, 1: T.OK, 2: T.OK, 3: T.UNCHECKABLE, 4: T.UNCHECKABLE, 5: T.OK}
    assert transport.resource_answers(refs, client, interval=0.0, budget=3).count() == 3


def test_workbook(spark, tmp_path):
    df = spark.createDataFrame([("t", "=1+1", "https://a.test/", T.OK)], "target_id string, page_title string, url string, verdict string")
    path = workbook.save({"콘텐츠 최신성": df}, f"{tmp_path}/r/latest.xlsx")
    with zipfile.ZipFile(path) as z:
        book, one, two, links, styles = (z.read(n).decode() for n in ("xl/workbook.xml", "xl/worksheets/sheet1.xml", "xl/worksheets/sheet2.xml", "xl/worksheets/_rels/sheet2.xml.rels", "xl/styles.xml"))
    assert 'Target="https://a.test/" TargetMode="External"' in links and two.count("<hyperlink ") == 1 and 'r:id="l1"' in two
    assert all(c in styles for c in ("1F4E78", "D9E1F2", "E7E6E6")) and '<c r="A1" t="inlineStr" s="1">' in two
    for n in (one, two, links, styles):
        ElementTree.fromstring(n.encode())
    assert [book.index(s) for s in workbook.SHEETS] == sorted(book.index(s) for s in workbook.SHEETS)
    assert workbook.EMPTY in one and "'=1+1" in two and 'state="frozen"' in two and "hyperlink" in two
