import hashlib
import html
import random
import zlib

from pagewarden.llm import markup, media

from .texts import HARD, documents, saved


def test_parts_keep_order_and_captions():
    page = """<!-- x --><p>One &amp; <b>two</b></p><img src="sha256:aa" alt="A &quot;b&quot;"><figure><img src='sha256:bb'><figcaption>Cap <i>tion</i></figcaption></figure>
    <script>var t = "<p>no</p>";</script><p>three<br>four<img alt=none><video src=sha256:cc></video> five"""
    got = [(p["pos"], p["kind"], p["text"] or p["ref"], p["caption"]) for p in media.parts(page)]
    assert got == [(0, "text", "One & two", None), (1, "media", "sha256:aa", 'A "b"'), (2, "media", "sha256:bb", "Cap tion"), (3, "text", "three", None), (4, "text", "four", None), (5, "media", "sha256:cc", None), (6, "text", "five", None)]
    assert media.parts("") == [] and media.parts("<") == [{"pos": 0, "kind": "text", "text": "<", "ref": None, "caption": None}]


def test_scanner_never_loses_text():
    rng = random.Random(1)
    for _ in range(300):
        source = "".join(rng.choice(["<p>", "</p>", "<!--", "-->", "<script>", "</script>", "a", "b ", "<", ">", '<a href="x>y">', "<br/>", "'", '"', "<!doctype html>"]) for _ in range(20))
        list(markup.scan(source))


def test_resolve_joins_by_digest(spark):
    pages = spark.createDataFrame([(1, '<p>t</p><img src="sha256:%s" alt="one"><p>u</p><img src="sha256:%s" alt="two"><img src="http://x/y.png">' % ("a" * 64, "b" * 64)), (2, None), (3, "")], "page_id bigint, html string")
    store = spark.createDataFrame([("a" * 64, b"123")], "digest string, payload binary")
    seq = media.sequence(pages)
    assert {r.page_id: len(r.parts) for r in seq.collect()} == {1: 5, 2: 0, 3: 0}
    got = sorted((r.page_id, r.pos, r.caption, bytes(r.payload) if r.payload else None) for r in media.resolve(seq, store, ["page_id"]).collect())
    assert got == [(1, 1, "one", b"123"), (1, 3, "two", None), (1, 4, None, None)]  # references to elsewhere keep their place


def test_round_trip():
    for t in HARD:
        data = (t or "").encode()
        payload = media.samples(media.stored(t))
        assert payload[: len(data)] == data and not payload[len(data) :].strip(b"\0") and len(payload) % 64 == 0 and payload
        assert media.feature(payload) == media.feature(bytes(payload))


def test_query(spark, tmp_path):
    docs = documents(spark, extra=True)
    docs = docs.union(docs.where("doc_id < 6")).union(docs.selectExpr("null", "text", "lang", "source", "n_chars", *docs.columns[5:]).limit(1))
    rows = media.query(spark, saved(spark, tmp_path, documents=docs)).collect()
    assert len(rows) == len(HARD) + 7
    for r in rows:
        text = HARD[r.doc_id or 0] or ""
        data = text.encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        form = media.stored(text)
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(form), hashlib.sha256(form).hexdigest(), media.feature(payload))
        assert (r.caption, r.pos, r.n_parts) == (f"{len(data)} bytes", r.n_parts - 1, len(media.parts(f"<p>{html.escape(text, quote=False)}</p>")) + 1)
    assert media.documents_as_media(docs.where("false")).count() == 0
