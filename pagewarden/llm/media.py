"""Interleaved text and media columns.

``sequence`` parses HTML into an ordered array of structs: texts, and references to
media with their caption (the figure's caption, else the alternative text). ``resolve``
joins references by digest with a table of media, and keeps positions and captions.

``stored`` keeps a text's UTF-8 bytes as media: zero bytes are appended up to a positive
multiple of 64, and the payload is a grey image of 64 columns and 8 bits a sample (binary
PGM); ``samples`` reads the payload back from the stored bytes. Equal texts have equal
media, so a digest names the media of all copies. A table holds the stored bytes once a
digest and shard; shards (of the document id) let the many references of a much copied
payload spread over tasks. References are joined with it by digest, and all features
come from the bytes that the join returns.

Null text is empty text (64 zero bytes). Null HTML has an empty sequence. A reference
whose digest isn't in the table keeps its place with null media. Rows are treated one by
one; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.llm import markup
from pagewarden.llm.common import spread, table

COLUMNS, SHARDS = 64, 64
SCHEME = "sha256:"
_BREAKS = frozenset("address article aside blockquote body br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table td th tr ul".split())
_SPACE = re.compile(r"[ \t\n\r\f]+")
_MEDIA = frozenset(("img", "video", "audio", "source", "embed"))
PART = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])
PART_DDL = "array<struct<pos: int, kind: string, text: string, ref: string, caption: string>>"


def parts(source: str) -> list[dict]:
    """Texts and media references in page order; a caption is a property of its reference, not a text."""
    out: list[dict] = []
    held: list[str] = []
    caption: list[str] | None = None
    figure: list[int] = []  # media of the open figure

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(held))).strip(" ")
        held.clear()
        if text:
            out.append({"pos": len(out), "kind": "text", "text": text, "ref": None, "caption": None})

    for what, name, rest in markup.scan(source):
        if what == "text":
            (held if caption is None else caption).append(name)
        elif what == "raw":
            if name in ("textarea", "noscript"):
                held.append(rest)
        elif what == "open" and name in _MEDIA:
            flush()
            own = markup.attributes(rest)
            if own.get("src"):
                figure.append(len(out))
                out.append({"pos": len(out), "kind": "media", "text": None, "ref": own["src"], "caption": own.get("alt")})
        elif name == "figcaption":
            if what == "open":
                flush()
                caption = []
            elif caption is not None:
                for i in figure:
                    out[i]["caption"] = _SPACE.sub(" ", html.unescape("".join(caption))).strip(" ")
                caption = None
        elif name in _BREAKS:
            flush()
            if name == "figure":
                figure = []
                caption = None
    if caption:
        held += caption
    flush()
    return out


def sequence(pages: DataFrame, *, html_col: str = "html", out_col: str = "parts") -> DataFrame:
    """All columns of pages with out_col added, HTML taken out."""
    where = pages.columns.index(html_col)
    kept = [c for c in pages.columns if c != html_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != html_col)

    def run(batches):
        for batch in batches:
            found = pa.array([parts(h.as_py() or "") for h in batch.column(where)], pa.list_(PART))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(batch.num_columns) if i != where], found], names=[*kept, out_col])

    return spread(pages).mapInArrow(run, f"{schema}, `{out_col}` {PART_DDL}" if schema else f"`{out_col}` {PART_DDL}")


def resolve(sequences: DataFrame, media: DataFrame, keys: list[str], *, parts_col: str = "parts") -> DataFrame:
    """A row for each media reference: keys, pos, caption, number of parts, digest (null if the reference isn't one), and the columns of media (null if unknown).

    media has digest and maybe some of keys; it is joined on digest and those.
    """
    refs = sequences.select(*keys, F.size(parts_col).alias("n_parts"), F.explode(F.filter(parts_col, lambda p: p["kind"] == "media")).alias("part"))
    digest = F.when(F.col("part.ref").startswith(SCHEME), F.col("part.ref").substr(len(SCHEME) + 1, 64))
    refs = refs.select(*keys, F.col("part.pos").alias("pos"), F.col("part.caption").alias("caption"), "n_parts", digest.alias("digest"))
    return refs.join(media, ["digest", *[k for k in keys if k in media.columns]], "left")


def stored(text: str | None) -> bytes:
    data = (text or "").encode()
    rows = max(1, -(-len(data) // COLUMNS))
    return b"P5\n%d %d\n255\n" % (COLUMNS, rows) + data.ljust(rows * COLUMNS, b"\0")


def samples(media: bytes) -> bytes:
    """The samples of a binary PGM image of 8 bits."""
    m = re.match(rb"P5\s(\d+)\s(\d+)\s255\s", media)
    size = int(m[1]) * int(m[2])
    out = media[m.end() : m.end() + size]
    if len(out) != size:
        raise ValueError("the image is cut short")
    return out


def feature(payload: bytes) -> str:
    """Rows, mean and an 8 x 8 average hash of the image, in whole numbers."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, COLUMNS)
    rows = len(image)
    edges = np.arange(9) * rows // 8
    columns = image.reshape(rows, 8, 8).sum(axis=2, dtype=np.int64)
    cells = np.array([columns[a : max(b, a + 1)].sum(axis=0) * 4096 // (8 * (max(b, a + 1) - a)) for a, b in zip(np.minimum(edges[:-1], rows - 1), edges[1:], strict=True)])
    bits = (cells > cells.sum() // 64).reshape(-1)
    return f"{rows}x{COLUMNS}:{int(columns.sum()) * 1000 // (rows * COLUMNS)}:{np.packbits(bits).tobytes().hex()}"


def _wrapped(batches):
    """Each document as a page: its text, and a figure that refers to its payload by digest."""
    for batch in batches:
        sizes, pages = [], []
        for t in batch.column(2):
            text = t.as_py() or ""
            digest = hashlib.sha256(samples(stored(text))).hexdigest()
            sizes.append(len(text.encode()))
            pages.append(f'<article><p>{html.escape(text, quote=False)}</p><figure><img src="{SCHEME}{digest}" alt="payload"><figcaption>{sizes[-1]} bytes</figcaption></figure></article>')
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(pages, pa.string())], names=["doc_id", "shard", "n_bytes", "html"])


def _kept(batches):
    """What is stored for each text, under its payload's digest."""
    for batch in batches:
        media = [stored(t.as_py()) for t in batch.column(1)]
        digests = [hashlib.sha256(samples(m)).hexdigest() for m in media]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string()), pa.array(media, pa.binary())], names=["shard", "digest", "media"])


_NAMES = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
_KINDS = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())


def _read_back(batches):
    """The last column, media, as what is read from it; null media as nulls."""
    for batch in batches:
        rows = []
        for m in batch.column(batch.num_columns - 1):
            media = m.as_py()
            if media is None:
                rows.append((None,) * len(_NAMES))
                continue
            payload = samples(media)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
        columns = zip(*rows, strict=True) if rows else [()] * len(_NAMES)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(list(c), k) for c, k in zip(columns, _KINDS, strict=True)]], names=[*batch.schema.names[:-1], *_NAMES])


def documents_as_media(docs: DataFrame, *, id_col: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """(doc_id, n_bytes, pos, caption, n_parts, digest, and what is read back from the stored media) per row of docs. An empty table has no rows.

    Stored bytes are shuffled once, one copy a digest and shard; the join finds them where that left them.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.pmod(F.xxhash64(id_col), F.lit(shards)).cast("int").alias("shard"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    pages = spread(docs).mapInArrow(_wrapped, f"doc_id {kind}, shard int, n_bytes bigint, html string")
    media = spread(docs.select("shard", "text")).mapInArrow(_kept, "shard int, digest string, media binary").groupBy("digest", "shard").agg(F.first("media").alias("media"))
    found = resolve(sequence(pages), media, ["doc_id", "shard", "n_bytes"]).select("doc_id", "n_bytes", "pos", "caption", "n_parts", "digest", "media")
    read = found.mapInArrow(_read_back, f"doc_id {kind}, n_bytes bigint, pos int, caption string, n_parts int, digest string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
    return read.withColumnRenamed("doc_id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents_as_media(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption", "n_parts")
