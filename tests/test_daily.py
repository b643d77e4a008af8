import datetime as dt

from pagewarden.functions import terms as T
from pagewarden.plans import daily
from pagewarden.sources.state import State
from pagewarden.sources.transport import RESPONSE

from .test_operators import PAGE

RULES = {"freshness": {"content_type_patterns": {"required": ["/p"], "not_required": ["about"]}}}
EXCLUSIONS = {"ignored_query_parameters": ["utm"], "excluded_paths": ["/admin"]}


def responses(spark, *rows):
    full = [("s", url, status, html, None, {}, 0.5, url, 0, error, "http") for url, status, html, error in rows]
    return spark.createDataFrame(full, "target_id string, " + RESPONSE)


def run(spark, resp, at, **old):
    targets = spark.createDataFrame([("s", "https://s.test", [])], "target_id string, base_url string, allowed_domains array<string>")
    return daily.run(resp, targets, rules=RULES, exclusions=EXCLUSIONS, at=at, **old)


def test_two_runs(spark, tmp_path):
    state = State(spark, f"file://{tmp_path}/state")
    home, gone, admin = ("https://s.test/p", 200, PAGE, None), ("https://s.test/a", 404, "<html></html>", None), ("https://s.test/admin/x", 200, PAGE, None)
    one = run(spark, responses(spark, home, gone, admin), dt.datetime(2026, 3, 1))
    pages = {r.url: r.verdict for r in one.pages.collect()}
    assert pages == {"https://s.test/p": T.ERROR, "https://s.test/a": T.ERROR, "https://s.test/admin/x": T.EXCLUDED}
    assert {r.url: r.verdict for r in one.freshness.collect()}["https://s.test/p"] == T.OK
    assert {r.lifecycle_status for r in one.lifecycle.collect()} == {T.NEW}
    assert {r.status for r in one.diff.collect()} == {T.ADDED}
    assert one.coverage.first().sources_ok == 3 and one.summary.first().total == 3
    assert one.resources.where(f"verdict = '{T.ERROR}'").count() > 0 and one.lists.count() >= 0 and one.outside.count() == 0 and one.missing.count() >= 1
    assert daily.saved(state, one, "r1") == daily.OK

    broken = run(spark, responses(spark, ("https://s.test/p", None, None, "timeout")), dt.datetime(2026, 3, 2), old=daily.loaded(state))
    assert {r.status for r in broken.diff.collect()} == {T.DELETION_UNSURE}
    assert T.RESOLVED not in {r.lifecycle_status for r in broken.lifecycle.collect()}
    assert daily.saved(state, broken, "r2") == daily.PARTIAL
    assert sorted(map(str, state.load("inventory", daily.RECORD).collect())) == sorted(map(str, state.load("inventory", daily.RECORD, back=1).collect()))

    fixed = run(spark, responses(spark, home, ("https://s.test/a", 200, PAGE, None)), dt.datetime(2026, 3, 3), old=daily.loaded(state))
    told = {(r.page_url, r.check_code): r.lifecycle_status for r in fixed.lifecycle.collect()}
    assert told["https://s.test/a", "connectivity"] == T.RESOLVED and told["https://s.test/p", "empty-id"] == T.PERSISTING
    assert {r.status for r in fixed.diff.collect()} <= {T.KEPT, T.CHANGED}


def test_two_sites_of_which_one_fails(spark, tmp_path):
    """A Korean path, an index of sitemaps, links to follow, caches, and health by target."""
    state = State(spark, f"file://{tmp_path}/state")
    index = "<sitemapindex><sitemap><loc>https://s.test/s1.xml</loc></sitemap><sitemap><loc>https://s.test/sitemap.xml</loc></sitemap></sitemapindex>"
    pages = '<urlset><url><loc>https://s.test/%ED%95%9C%EA%B8%80</loc></url><url><loc>https://s.test/only</loc></url></urlset>'
    home = '<!DOCTYPE html><html lang="ko"><head><title>홈 화면</title><meta charset="utf-8"></head><body><nav><a href="/한글">한글</a></nav><a href="#none">x</a><a href="#here">y</a><p id="here"></p><a href="/f.pdf">f</a><a href="/deep">d</a></body></html>'
    targets = spark.createDataFrame([("s", "https://s.test", []), ("u", "https://u.test", [])], "target_id string, base_url string, allowed_domains array<string>")

    def answers(second_ok: bool):
        rows = [
            ("s", "https://s.test/", 200, home, None), ("s", "https://s.test/한글", 200, home, None), ("s", "https://s.test/deep", 200, "<a href='/deeper'>z</a>", None), ("s", "https://s.test/sitemap.xml", 200, index, None), ("s", "https://s.test/s1.xml", 200, pages, None), ("s", "https://s.test/f.pdf", 200, None, None),
            ("u", "https://u.test/", 200 if second_ok else None, home if second_ok else None, None if second_ok else "ConnectTimeout token=abc"),
        ]
        full = [(t, u, c, h, b"%PDF-1" if u.endswith("pdf") else None, {"content-type": "application/pdf" if u.endswith("pdf") else "text/html"}, 0.1, u, 0, e, "http") for t, u, c, h, e in rows]
        return spark.createDataFrame(full, "target_id string, " + RESPONSE)

    go = lambda ok, day: daily.run(answers(ok), targets, rules={}, exclusions={}, at=dt.datetime(2026, 3, day), old=daily.loaded(state), crawl=True)
    one = go(True, 1)
    urls = {r.normalized_url: set(r.discovery_sources) for r in one.inventory.where("target_id = 's' and classification = 'internal'").collect()}
    korean = "https://s.test/%ED%95%9C%EA%B8%80"
    assert urls[korean] == {"main_menu", "sitemap", "internal_crawl"} and urls["https://s.test/only"] == {"sitemap"} and urls["https://s.test/deeper"] == {"internal_crawl"}
    assert {r.subject for r in one.missing.where("kind = 'page'").collect()} >= {"https://s.test/only"} and korean not in {r.subject for r in one.missing.collect()}
    anchors = {(r.original_url, r.verdict) for r in one.resources.where("kind = 'anchor'").collect()}
    assert anchors == {("#none", T.ERROR), ("#here", T.OK)}
    assert {r.status for r in one.sitemaps.where("target_id = 's'").collect()} == {T.OK} and {r.decision for r in one.screenshots.collect()} == {"capture"}
    assert daily.saved(state, one, "r1") == daily.OK
    stages = {r.stage: (r.processed, r.failed) for r in state.load("stages", "run_id string, stage string, processed bigint, failed bigint").collect()}
    assert stages["performance"][0] == 7 and stages["resources"][0] == one.resources.count()

    two = go(False, 2)
    assert {r.verdict for r in two.resources.where("kind = 'attachment' and cache_used").collect()} == {T.OK}
    assert two.issues.count() == one.issues.where("target_id = 's'").count()  # kept from the cache
    told = {(r.target_id, r.lifecycle_status) for r in two.lifecycle.collect()}
    assert ("s", T.PERSISTING) in told and not any(t == "u" and s == T.RESOLVED for t, s in told)
    assert {r.target_id: r.healthy for r in two.health.collect()} == {"s": True, "u": False}
    assert {r.status for r in two.diff.where("target_id = 'u'").collect()} == {T.DELETION_UNSURE} and {r.status for r in two.diff.where("target_id = 's'").collect()} == {T.KEPT}
    assert "[REDACTED]" in [r.reason for r in two.missing.where("kind = 'source'").collect()][0]
    assert daily.saved(state, two, "r2") == daily.PARTIAL
    assert {r.target_id for r in state.load("inventory", daily.RECORD).collect()} == {"s", "u"}

    changed = daily.run(answers(True), targets, rules={}, exclusions={"ignored_query_parameters": ["x"]}, at=dt.datetime(2026, 3, 3), old=daily.loaded(state))
    assert {r.status for r in changed.comparison.collect()} == {T.INCOMPARABLE} and changed.diff.count() == 0


def test_policy_goes_before_health_and_the_request_limit_counts(spark):
    """With a new policy nothing is compared, also if a source failed; a run that used up its requests doesn't tell what was deleted."""
    home, more = ("https://s.test/p", 200, PAGE, None), ("https://s.test/q", None, None, "timeout")
    first = run(spark, responses(spark, home), dt.datetime(2026, 3, 1))
    old = {"inventory": first.baseline.persist(), "header": first.header.persist()}
    targets = spark.createDataFrame([("s", "https://s.test", [])], "target_id string, base_url string, allowed_domains array<string>")
    other = daily.run(responses(spark, more), targets, rules=RULES, exclusions=EXCLUSIONS | {"ignored_query_parameters": ["z"]}, at=dt.datetime(2026, 3, 2), old=old)
    assert other.diff.count() == 0 and {r.status for r in other.comparison.collect()} == {T.INCOMPARABLE}
    full = daily.run(responses(spark, ("https://s.test/x", 200, "<p>x", None)), targets, rules=RULES | {"crawl": {"max_urls": 1}}, exclusions=EXCLUSIONS, at=dt.datetime(2026, 3, 2), old=old)
    assert {r.status for r in full.diff.collect()} == {T.DELETION_UNSURE} and [(r.kind, r.subject) for r in full.missing.where("kind = 'limit'").collect()] == [("limit", "s")]


def test_targets_have_selectors_of_their_own(spark):
    page = '<div class="d">2024-02-03</div><div class="e">2023-01-01</div><div class="b"><p class="r"><b>T1</b><i>2026-02-01</i></p><p class="r"><b>T2</b><i>2026-01-01</i></p></div><p class="r"><b>T3</b><i>2026-02-28</i></p>'
    kinds = "map<string,array<string>>"
    targets = spark.createDataFrame([("s", "https://s.test", [], {"published": [".none", ".d"]}, {"container": [".b"], "row": [".r"], "title": ["b"], "date": ["i"]}), ("u", "https://u.test", [], {"modified": [".d + .e"]}, {})], f"target_id string, base_url string, allowed_domains array<string>, date_selectors {kinds}, list_selectors {kinds}")
    rows = [(t, f"https://{t}.test/p", 200, page, None, {}, 0.5, "", 0, None, "http") for t in "su"]
    out = daily.run(spark.createDataFrame(rows, "target_id string, " + RESPONSE), targets, rules=RULES, exclusions=EXCLUSIONS, at=dt.datetime(2026, 3, 1))
    dates = {r.target_id: (r.published, r.modified) for r in out.freshness.collect()}
    assert dates == {"s": (dt.date(2024, 2, 3), None), "u": (None, dt.date(2023, 1, 1))}
    lists = {r.target_id: (r.valid, r.latest_title, r.latest_day) for r in out.lists.collect()}
    assert lists == {"s": (2, "T1", dt.date(2026, 2, 1)), "u": (0, None, None)}


def test_a_run_that_dies_while_it_is_saved_leaves_the_run_before(spark, tmp_path, monkeypatch):
    from pagewarden.sources import state as S

    state = State(spark, f"file://{tmp_path}/state")
    one = run(spark, responses(spark, ("https://s.test/p", 200, PAGE, None)), dt.datetime(2026, 3, 1))
    assert daily.saved(state, one, "r1") == daily.OK
    before = {n: state.versions(n) for n in ("issues", "inventory", "diff", "summary", "coverage", "runs")}
    assert all(before.values()) and state.load("diff", one.diff.schema).count() == one.diff.count()
    plain, calls = S.Commit.save, []

    def dies(self, name, df, **more):
        calls.append(name)
        if name == "header":
            raise RuntimeError("killed")
        return plain(self, name, df, **more)

    monkeypatch.setattr(S.Commit, "save", dies)
    two = run(spark, responses(spark, ("https://s.test/p", 200, "<p>new", None)), dt.datetime(2026, 3, 2), old=daily.loaded(state))
    try:
        daily.saved(state, two, "r2")
        raise AssertionError
    except RuntimeError:
        pass
    assert len(calls) > 10 and {n: state.versions(n) for n in before} == before and [r.run_id for r in state.load("runs", "run_id string, exit_code int").collect()] == ["r1"]


def test_nothing_to_do(spark):
    out = run(spark, responses(spark), dt.datetime(2026, 3, 1))
    assert out.pages.count() == 0 and out.inventory.count() == 0 and out.lifecycle.count() == 0


def test_command_line_and_report(spark, tmp_path):
    import json
    import zipfile

    from pagewarden.plans import cli

    from .test_sources import write

    write(tmp_path, targets={"s": {"name": "S", "base_url": "https://s.test"}})
    (tmp_path / "r.json").write_text(json.dumps([{"target_id": "s", "url": "https://s.test/p", "status_code": 200, "html": PAGE, "elapsed_seconds": 0.1}]))
    args = ["--config", str(tmp_path), "--responses", f"file://{tmp_path}/r.json", "--state", f"file://{tmp_path}/st", "--report", str(tmp_path / "out.xlsx"), "--at", "2026-03-01"]
    assert cli.main(args, spark) == 0
    with zipfile.ZipFile(tmp_path / "out.xlsx") as z:
        assert "https://s.test/p" in z.read("xl/worksheets/sheet5.xml").decode()
    assert cli.main(["--config", str(tmp_path / "none"), *args[2:]], spark) == 1
