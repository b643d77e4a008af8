"""Secret spans in whole texts: fixed patterns, and a guess-cost search over credential-context values.

Fixed patterns (base spans): assigned values, access keys and long hex strings.
Then every value that stands after a credential word and a colon, equals sign or
arrow is cut into segments of least total guess cost by dynamic programming. A
segment is a common word (also capitalised or with look-alike characters), a date or
year, a repeated character, a walk along keys or an alphabet, or brute force. Costs
are decimal logarithms of guesses and add up; values of ``threshold`` or more that
reach beyond the base spans are added whole as spans of kind ``guess``. Base spans always stay.

Null text is empty text; texts without a span have none. Rows are treated one by one: repeated rows and
null ids are rows of their own, an empty table gives no rows, other columns are not read, whatever their names.
Offsets count code points, ends are exclusive. The search is linear in the value's
length, so values are never cut.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.llm.common import small_batches, spread, table

KINDS = ("assign", "access", "hex", "guess")
THRESHOLD = 10.0
MASK = "[SECRET]"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
CONTEXT = re.compile(
    r"""(?:password|passwd|passphrase|passcode|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key|credentials?)["']?\x20*(?:=>|[:=])\x20*(?:"([^"\r\n]+)"|'([^'\r\n]+)'|([^\s"'<>,;]+))""",
    re.I | re.A,
)
#: Of which a text has one at least, lower-cased, if ASSIGN or CONTEXT match in it.
HINTS = ("passw", "passphrase", "passcode", "pwd", "secret", "token", "key", "credential")

# Words that guessers try first, most likely first.
WORDS = """password qwerty letmein welcome admin login dragon monkey master shadow sunshine princess football baseball
superman batman trustno iloveyou starwars hello freedom whatever secret summer winter spring autumn love money
access flower cheese cookie orange banana purple silver golden hunter killer soccer hockey tigger charlie jordan
michael thomas robert daniel andrew joshua matthew jennifer jessica ashley nicole amanda changeme default guest
test testing demo sample example user root system server oracle mysql postgres redis token apikey key pass
january february march april may june july august september october november december monday tuesday wednesday
thursday friday saturday sunday london paris berlin madrid apple google computer internet security private public
company office house horse correct battery staple the and for you not with this that from have true false null none""".split()
RANK = {w: i + 1 for i, w in reversed(list(enumerate(WORDS)))}
LONGEST = max(map(len, WORDS))
LOOKALIKE = str.maketrans("@4301!5$7", "aaeoiisst")
# Rows of keys.
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:0[1-9]|1[0-2])([-/._]?)(?:0[1-9]|[12]\d|3[01])\3(?:19|20)\d\d)")
YEAR = re.compile(r"(?:19|20)\d\d")
SEGMENT = math.log10(2)
DATE_COST, SEPARATED, YEAR_COST = math.log10(365 * 120), math.log10(4), math.log10(120)
REPEAT_START, REPEAT_MORE = math.log10(3), math.log10(1.2)
WALK_START, WALK_MORE = math.log10(47 * 4), math.log10(2)
UPPER, LOOKED = math.log10(2), math.log10(4)


def _neighbours() -> set[tuple[str, str]]:
    out = set()
    for y, row in enumerate(ROWS):
        for x, c in enumerate(row):
            for dy, dx in ((0, 1), (1, 0), (1, -1)):
                if y + dy < len(ROWS) and 0 <= x + dx < len(ROWS[y + dy]):
                    d = ROWS[y + dy][x + dx]
                    out |= {(c, d), (d, c)}
    for first, n in (("a", 26), ("0", 10)):
        for i in range(n - 1):
            c, d = chr(ord(first) + i), chr(ord(first) + i + 1)
            out |= {(c, d), (d, c)}
    return out


NEXT = _neighbours()
_BRUTE: dict[str, float] = {}


def brute(c: str) -> float:
    cost = _BRUTE.get(c)
    if cost is None:
        n = 10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100
        cost = math.log10(n)
        if len(_BRUTE) < 5000:
            _BRUTE[c] = cost
    return cost


def guess_cost(value: str) -> tuple[float, list[tuple[str, int, int]]]:
    """Least decimal logarithm of guesses, and the segments (kind, start, end) that have it."""
    n = len(value)
    if not n:
        return 0.0, []
    low = value.lower()
    if len(low) != n:
        low = "".join(c.lower()[0] for c in value)
    plain = low.translate(LOOKALIKE)
    inf = math.inf
    closed: list[tuple[float, str, int]] = [(0.0, "", 0)] + [(inf, "", 0)] * n  # cost, kind and start of the last segment
    force, again, walk = (inf, 0), (inf, 0), (inf, 0)  # a segment still open: cost, start
    for i in range(n):
        # Segments that begin at i; closed[i] is final by now.
        base = closed[i][0] + SEGMENT
        c = value[i]
        for size in range(3, min(LONGEST, n - i) + 1):
            for text, more in ((low, 0.0), (plain, LOOKED)):
                rank = RANK.get(text[i : i + size])
                if rank is not None:
                    cost = base + math.log10(rank + 1) + more + (UPPER if value[i : i + size] != low[i : i + size] else 0.0)
                    if cost < closed[i + size][0]:
                        closed[i + size] = (cost, "word", i)
                    break
        if c.isdigit():
            for pattern, cost in ((DATE, DATE_COST), (YEAR, YEAR_COST)):
                m = pattern.match(value, i)
                if m:
                    cost += base + (SEPARATED if not m[0].isdigit() else 0.0)
                    if cost < closed[m.end()][0]:
                        closed[m.end()] = (cost, "date", i)
        # Segments that grow by the character at i.
        force = min((base + brute(c), i), (force[0] + brute(c), force[1]))
        more = (again[0] + REPEAT_MORE, again[1]) if i and value[i - 1] == c else (inf, 0)
        if i >= 2 and value[i - 1] == c == value[i - 2]:
            more = min(more, (closed[i - 2][0] + SEGMENT + brute(c) + REPEAT_START, i - 2))
        again = more
        step = i > 0 and (low[i - 1], low[i]) in NEXT
        more = (walk[0] + WALK_MORE, walk[1]) if step else (inf, 0)
        if step and i >= 2 and (low[i - 2], low[i - 1]) in NEXT:
            more = min(more, (closed[i - 2][0] + SEGMENT + WALK_START + 2 * WALK_MORE, i - 2))
        walk = more
        closed[i + 1] = min(closed[i + 1], (force[0], "brute", force[1]), (again[0], "repeat", again[1]), (walk[0], "walk", walk[1]))
    out, i = [], n
    while i:
        _, kind, a = closed[i]
        out.append((kind, a, i))
        i = a
    return closed[n][0], out[::-1]


def find(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, str, float | None, str | None]]:
    """(start, end, kind, log10 of guesses, segments) by start, then kind as in KINDS. Costs are for values after credential words."""
    low = text.lower()
    base: list[tuple[int, int, str, float | None, str | None]] = []
    hinted = any(h in low for h in HINTS)
    if hinted:
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 8:
                cost, parts = guess_cost(m[2])
                base.append((*m.span(), "assign", cost, _written(parts)))
    if "AKIA" in text:
        base += [(*m.span(), "access", None, None) for m in ACCESS.finditer(text)]
    base += [(*m.span(), "hex", None, None) for m in HEX.finditer(text)]
    out = list(base)
    if hinted:
        taken: list[tuple[int, int]] = []  # base spans, those that meet as one
        for a, b in sorted((a, b) for a, b, *_ in base):
            if taken and a <= taken[-1][1]:
                taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
            else:
                taken.append((a, b))
        for m in CONTEXT.finditer(text):
            a, b = m.span(m.lastindex)
            at = bisect_right(taken, a, key=lambda s: s[0])
            if at and taken[at - 1][1] >= b:
                continue
            cost, parts = guess_cost(text[a:b])
            if cost >= threshold:
                out.append((a, b, "guess", cost, _written(parts)))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _written(parts: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in parts)


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("log10_guesses", pa.float64()), ("segments", pa.string())])


def scan(docs: DataFrame, *, id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(id, spans: array of kind, start, end, log10_guesses, segments) per row."""

    def run(batches):
        for batch in batches:
            found = [[dict(zip(("start", "end", "kind", "log10_guesses", "segments"), s, strict=True)) for s in find(t.as_py() or "", threshold)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(SPAN))], names=["id", "spans"])

    docs = docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    return spread(docs).mapInArrow(run, f"id {kind}, spans array<struct<kind: string, start: bigint, end: bigint, log10_guesses: double, segments: string>>").withColumnRenamed("id", id_col)


def redacted(text: str, threshold: float = THRESHOLD) -> str:
    out, at = [], 0
    for a, b, *_ in find(text, threshold):
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """The same rows and columns with MASK in place of every span (overlapping ones as one); null text stays null."""
    where = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            columns[where] = pa.array([None if t is None else redacted(t, threshold) for t in columns[where].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    rows = small_batches(docs).withColumn("text", F.col("text").cast("string"))
    return rows.mapInArrow(run, rows.schema)


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), count("guess").alias("n_guess"))
