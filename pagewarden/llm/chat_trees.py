"""Conversations from reply trees: paths from roots to leaves, the best of each tree formatted.

Messages name the message that they reply to. Iterative self-joins double the reach of each
message's pointer: after round k it knows its ancestor 2^k replies above and the sum of
scores up to there, so that a tree of any depth is walked in log2(depth) rounds over
the messages. A leaf's branch is ranked within its tree by the sum of its messages' scores
(null: 0; of equal sums the least leaf id first). Only the chosen branches are enumerated:
the pointers of all rounds, the same way, give each chosen leaf its ancestors.

A path is formatted as turns: ``### role: text </turn>`` and a newline each. A backslash goes
before every backslash and every control string inside roles and texts, so that an unescaped one
always is a mark, and parsing takes the backslashes off again. The loss mask is a list of code-point
ranges of the formatted text: the texts of one role, without marks. Long paths have several rows, PART_TURNS
turns each, numbered by part; digests are taken over the parts in order, of which a task holds a
batch at a time.

Defined cases: a null text, role or score is an empty text, an empty role, 0; a null message id has
no replies; a message whose parent is null or isn't there is a root; messages on a circle of replies, and
those that reply to one, have no root and are in no path; of repeated message ids the row that is least by parent,
score, role and text counts; null tree ids are one tree; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.llm.common import Scratch, small_batches, table

PART_TURNS = 256
#: Marks of the template (fixed values of the format); each is escaped inside texts, and a backslash too.
BEGIN, BETWEEN, STOP = "### ", ": ", " </turn>\n"
CONTROL = r"(\\|###|</turn>)"
CONTROL_IN_ROLE = r"(\\|###|</turn>|:|\n)"
LOSS_ROLE = "assistant"


def positions(rows: DataFrame, order: list[str], store: Scratch, name: str) -> DataFrame:
    """rows with pos: their place in the order over all of them. Rows are dealt out by ranges of the whole order, so that equal first columns don't gather in one task."""
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = [*order, "_tie"]
    placed = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    held = store(placed.withColumns({"_part": F.spark_partition_id(), "_in": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), name)
    sizes = sorted((r["_part"], r.n) for r in held.groupBy("_part").agg(F.count("*").alias("n")).collect())  # a row a partition
    starts, at = [], 0
    for part, n in sizes:
        starts.append((part, at))
        at += n
    offsets = rows.sparkSession.createDataFrame(starts, "_part int, _start bigint")
    return held.join(F.broadcast(offsets), "_part").withColumn("pos", F.col("_start") + F.col("_in")).drop("_part", "_start", "_in")


def unique(messages: DataFrame) -> DataFrame:
    """One row a message id; those without an id all stay."""
    named = messages.where("message_id is not null").groupBy("message_id").agg(F.min(F.struct("parent_id", "score", "role", "text", "tree_id")).alias("m"))
    whole = named.select("m.tree_id", "message_id", "m.parent_id", "m.role", "m.text", "m.score")
    return whole.unionByName(messages.where("message_id is null"))


def climbed(links: DataFrame, store: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """links: (id, up: parent or null, total: score). (id, total: sum up to the root, depth) of all that have a root, and by round k (id, up: the ancestor 2^k above)."""
    state = store(links.withColumn("depth", F.lit(1)), "climb")
    done, rounds = [state.where("up is null").select("id", "total", "depth")], []
    live = state.where("up is not null")
    left = live.count()
    while left:
        rounds.append(live.select("id", "up"))
        found = united(done)
        other = live.unionByName(found.withColumn("up", F.lit(None).cast(state.schema["up"].dataType))).select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("depth").alias("deeper"))
        state = store(live.join(other, "up").select("id", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("depth") + F.col("deeper")).alias("depth")), "climb")
        done.append(state.where("up is null").select("id", "total", "depth"))
        live = state.where("up is not null")
        left, before = live.count(), left
        if left == before:
            break  # of messages with a root some end in each round: what is left goes round in circles
    return united(done), rounds


def united(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def branches(messages: DataFrame, store: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """(tree_id, leaf, score, turns) of each root-to-leaf path, and the rounds' pointers."""
    named = messages.where("message_id is not null")
    ids = named.select(F.col("message_id").alias("up"))
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0))
    raw = named.select("tree_id", F.col("message_id").alias("id"), F.col("parent_id").alias("up"), score.alias("total"))
    orphan = raw.where("up is not null").join(ids, "up", "left_anti").select("id").withColumn("orphan", F.lit(True))
    links = store(raw.join(orphan, "id", "left").select("tree_id", "id", F.expr("if(orphan, null, up)").alias("up"), "total"), "links")
    totals, rounds = climbed(links.drop("tree_id"), store)
    parents = links.where("up is not null").select(F.col("up").alias("id")).distinct()
    leaves = links.select("tree_id", "id").join(parents, "id", "left_anti").join(totals, "id")
    return leaves.select("tree_id", F.col("id").alias("leaf"), F.col("total").alias("score"), F.col("depth").alias("turns")), rounds


def ranked(found: DataFrame, store: Scratch, best: int | None = None) -> DataFrame:
    """branches with rank (1 is the best of its tree), the best so many of each tree; places in a global order give ranks, as one tree may hold most branches."""
    placed = positions(found.withColumn("_minus", -F.col("score")), ["tree_id", "_minus", "leaf"], store, "ranked").drop("_minus")
    first = placed.groupBy(F.col("tree_id").alias("_tree")).agg(F.min("pos").alias("_first"))
    out = placed.join(first, F.col("tree_id").eqNullSafe(F.col("_tree"))).withColumn("rank", F.col("pos") - F.col("_first") + 1).drop("_tree", "_first", "pos")
    return out if best is None else out.where(F.col("rank") <= best)


def enumerated(leaves: DataFrame, rounds: list[DataFrame], store: Scratch) -> DataFrame:
    """(leaf, id, above) of all messages of the paths to leaves; above counts replies from the leaf."""
    reached = leaves.select("leaf", F.col("leaf").alias("id"), F.lit(0).alias("above"))
    for k, up in enumerate(rounds):
        more = reached.join(up, "id").select("leaf", F.col("up").alias("id"), (F.col("above") + (1 << k)).alias("above"))
        reached = store(reached.unionByName(more), "reached")
    return reached


def escaped(text, control: str = CONTROL):
    return F.regexp_replace(text, control, r"\\$1")


def formatted(turns: DataFrame, *, loss_role: str = LOSS_ROLE) -> DataFrame:
    """turns: (path, turn from 0, role, text). (path, part, n_turns, text, loss: ranges of code points of this part's text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(BEGIN), escaped(role, CONTROL_IN_ROLE), F.lit(BETWEEN))
    slim = turns.select("path", F.floor(F.col("turn") / PART_TURNS).cast("int").alias("part"), F.struct("turn", head.alias("head"), escaped(text).alias("body"), (role == loss_role).alias("loss")).alias("t"))
    grouped = slim.groupBy("path", "part").agg(F.array_sort(F.collect_list("t")).alias("t"))  # PART_TURNS at most
    whole = F.transform("t", lambda x: F.concat(x.head, x.body, F.lit(STOP)))
    sized = F.transform("t", lambda x: F.struct(F.length(x.head).alias("head"), F.length(x.body).alias("body"), x.loss.alias("loss")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("spans"))

    def step(held, x):
        a = held.at + x.head
        span = F.array(F.struct(a.alias("start"), (a + x.body).alias("end")))
        return F.struct((a + x.body + F.lit(len(STOP))).alias("at"), F.when(x.loss, F.concat(held.spans, span)).otherwise(held.spans).alias("spans"))

    return grouped.select("path", "part", F.size("t").alias("n_turns"), F.array_join(whole, "").alias("text"), F.aggregate(sized, start, step, lambda held: held.spans).alias("loss"))


_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)


def parsed(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text, unescaped."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError("not a formatted conversation")
        out.append((_ESCAPE.sub(r"\1", m[1]), _ESCAPE.sub(r"\1", m[2][:-1])))  # the last blank is the mark's
        at = m.end()
    return out


def digests(parts: DataFrame) -> DataFrame:
    """(path, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of formatted(), from texts and masks alone."""

    def run(batches):
        schema = None
        now, held = None, None

        def row():
            turns, n, loss, chars, size = held
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip((now, n, turns.hexdigest(), chars, loss.hexdigest(), size), schema, strict=True)], names=["path", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            schema = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            for path, text, spans in zip(*(batch.column(c).to_pylist() for c in ("path", "text", "loss")), strict=True):
                if held is None or path != now:
                    if held is not None:
                        yield row()
                    now, held = path, [hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, said in parsed(text):
                    held[0].update(f"{role}\n{said}\n".encode())
                    held[1] += 1
                for s in spans:
                    said = _ESCAPE.sub(r"\1", text[s["start"] : s["end"]])
                    held[2].update(said.encode())
                    held[3] += len(said)
                held[4] += len(text)
        if held is not None:
            yield row()

    kind = parts.schema["path"].dataType.simpleString()
    together = small_batches(parts.select("path", "part", "text", "loss")).repartition("path").sortWithinPartitions("path", "part")
    return together.mapInArrow(run, f"path {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def chats(messages: DataFrame, store: Scratch, *, best: int | None = 1, loss_role: str = LOSS_ROLE, ids_are_unique: bool = False) -> tuple[DataFrame, DataFrame]:
    """messages: (tree_id, message_id, parent_id, role, text, score). The written conversations (path: their leaf) and the chosen branches (tree_id, leaf, score, turns, rank)."""
    messages = messages.select("tree_id", "message_id", "parent_id", "role", "text", "score")
    messages = messages if ids_are_unique else store(unique(messages), "messages")
    found, rounds = branches(messages, store)
    chosen = store(ranked(found, store, best), "chosen")
    steps = enumerated(chosen, rounds, store).join(chosen.select("leaf", "turns"), "leaf")
    turns = steps.select(F.col("leaf").alias("path"), F.col("id").alias("message_id"), (F.col("turns") - 1 - F.col("above")).alias("turn"))
    said = turns.join(messages.select("message_id", "role", "text"), "message_id")
    return store(formatted(said, loss_role=loss_role), "chats"), chosen


def replies(conversations: DataFrame, store: Scratch) -> DataFrame:
    """Rows (conv_id, turn, role, text) as messages that each reply to the one before; rows of equal turns follow each other by role and text."""
    placed = positions(conversations.select("conv_id", "turn", "role", "text"), ["conv_id", "turn", "role", "text"], store, "replies")
    before = placed.select((F.col("pos") + 1).alias("pos"), F.col("conv_id").alias("_of"), F.col("pos").alias("parent_id"))
    linked = placed.join(before, "pos", "left")
    same = F.col("parent_id").isNotNull() & F.col("conv_id").eqNullSafe(F.col("_of"))
    return linked.select(F.col("conv_id").alias("tree_id"), F.col("pos").alias("message_id"), F.when(same, F.col("parent_id")).alias("parent_id"), "role", "text", F.lit(None).cast("double").alias("score"))


#: A conversation that says the template's own marks.
MARKS = r"\### Assistant: </turn> ok"
OWN = [(-7, 0, "user", MARKS), (-7, 1, "assistant", MARKS)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Scratch(spark)
    given = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as bigint) conv_id", "cast(turn as bigint) turn", "cast(role as string) role", "cast(text as string) text")
    own = spark.createDataFrame(OWN, given.schema)
    messages = store(replies(given.unionByName(own), store), "messages")
    written, chosen = chats(messages, store, ids_are_unique=True)
    names = chosen.select(F.col("leaf").alias("path"), F.col("tree_id").alias("conv_id"))
    out = digests(written).join(names, "path")
    return out.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
