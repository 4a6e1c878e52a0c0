"""Chat formatting: reply trees to conversations with a loss mask.

Messages form reply trees. Iterative self-joins double the reach of every message: after round r a message knows its
ancestor 2**r steps up, how many messages lie between and the sum of their scores, so a tree of depth d takes log2(d)
rounds. A branch is the path from the root to a leaf; branches are ranked by their mean score, ties to the smaller
leaf. The joins' tables, read from the longest step to the shortest, then list the messages of the chosen branches,
each once. Only ids travel in the rounds; texts join at the end.

A branch is written as one conversation, turn by turn:

    ### role:
    text</turn>

Within roles and texts ``\\`` becomes ``\\\\``, ``###`` becomes ``\\h``, ``</turn>`` becomes ``\\e`` and, in roles, a line
feed ``\\n``, so a text can hold no mark and every text can be read back. The loss mask spans the assistant's texts, in
code points of the conversation. Conversations are streamed in order; one that grows over ``part_chars`` goes on in
further rows (``part`` 0, 1, ..., the last marked), so no row and no task holds all of a huge one.

Defined results: null text and role count as empty; a message whose parent is missing is a root; messages on or below
a cycle belong to no branch; of messages with equal id in a tree only one stays; an empty table gives no rows. In
``thread`` rows of a conversation follow each other by turn (null last), ties by role, then text; repeated rows are
turns of their own; a null conversation id is an id like any other.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.llm.common import keep
from cloudloom.operators.prefix import numbered

HEAD, TAIL = "### ", "</turn>\n"
ASSISTANT = "assistant"
PART_CHARS = 2_000_000
PLANTED = "\\### Assistant: </turn> ok"
_OUT = {"\\": "\\\\", "###": "\\h", "</turn>": "\\e", "\n": "\\n"}
_BACK = {v: k for k, v in _OUT.items()}
_TEXT, _ROLE, _CODE = re.compile(r"\\|###|</turn>"), re.compile(r"\\|###|</turn>|\n"), re.compile(r"\\[\\hen]")
_TURN = re.compile(r"### ([^\n]*):\n(.*?)</turn>\n", re.DOTALL)


def escape(text: str, role: bool = False) -> str:
    return (_ROLE if role else _TEXT).sub(lambda m: _OUT[m[0]], text)


def unescape(text: str) -> str:
    return _CODE.sub(lambda m: _BACK[m[0]], text)


# -- trees ------------------------------------------------------------------
def reach(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, node, depth, score) of every message under a root, and the steps (tree, node, up) of 1, 2, 4, ... messages.

    ``messages`` has (tree, node, parent, score). ``depth`` counts the messages of the path from the root, ``score``
    is their sum. ``node`` is unique in its tree.
    """
    one = messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = one.select("tree", F.col("node").alias("parent"), F.lit(True).alias("_known"))
    linked = one.join(known, ["tree", "parent"], "left")
    state = linked.select("tree", "node", F.when(F.col("_known") & (F.col("parent") != F.col("node")), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("depth"), "score", (F.col("parent") == F.col("node")).alias("_self"))
    state = keep(state.where("NOT coalesce(_self, false)").drop("_self"), "chat-reach")
    rounds = (max(2, state.count()) - 1).bit_length() + 1
    steps, done = [], [state.where("up IS NULL")]
    going = state.where("up IS NOT NULL")
    for _ in range(rounds):
        if going.isEmpty():
            break
        steps.append(going.select("tree", "node", "up"))
        above = state.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("score").alias("score2"))
        further = going.join(above, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("score") + F.col("score2")).alias("score"))
        moved = keep(further, "chat-reach")
        done.append(moved.where("up IS NULL"))
        going = moved.where("up IS NOT NULL")
        state = done[0]
        for d in done[1:]:
            state = state.unionByName(d)
        state = state.unionByName(going)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("up"), steps


def branches(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """(tree, branch, leaf, node, pos): the messages of the ``best`` branches of each tree (None: all), pos from 1."""
    paths, steps = reach(messages)
    parents = messages.select("tree", F.col("parent").alias("node")).where("node IS NOT NULL").distinct()
    leaves = paths.join(parents, ["tree", "node"], "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc(F.col("score") / F.col("depth")), "node")
    ranked = leaves.withColumn("branch", F.row_number().over(order))
    if best is not None:
        ranked = ranked.where(F.col("branch") <= best)
    members = keep(ranked.select("tree", "branch", F.col("node").alias("leaf"), "node", F.col("depth").alias("pos")), "chat-branches")
    for r in reversed(range(len(steps))):
        up = members.join(steps[r], ["tree", "node"]).select("tree", "branch", "leaf", F.col("up").alias("node"), (F.col("pos") - (1 << r)).alias("pos"))
        members = keep(members.unionByName(up), "chat-branches")
    return members


# -- format and read back -----------------------------------------------------
FORMATTED = "tree string, branch int, part int, last boolean, text string, loss_from array<long>, loss_to array<long>"
_FORMATTED = pa.schema([("tree", pa.string()), ("branch", pa.int32()), ("part", pa.int32()), ("last", pa.bool_()), ("text", pa.string()), ("loss_from", pa.list_(pa.int64())), ("loss_to", pa.list_(pa.int64()))])


class _Writer:
    """One conversation as it grows."""

    def __init__(self, key: tuple):
        self.key, self.part, self.at = key, 0, 0
        self.held, self.size, self.spans = [], 0, []

    def turn(self, role: str, text: str) -> None:
        head, body = f"{HEAD}{escape(role, True)}:\n", escape(text)
        if role == ASSISTANT:
            self.spans.append((self.at + len(head), self.at + len(head) + len(body)))
        self.held.append(head + body + TAIL)
        self.size += len(self.held[-1])
        self.at += len(self.held[-1])

    def row(self, last: bool) -> dict:
        out = {"tree": self.key[0], "branch": self.key[1], "part": self.part, "last": last, "text": "".join(self.held), "loss_from": [s[0] for s in self.spans], "loss_to": [s[1] for s in self.spans]}
        self.part, self.held, self.size, self.spans = self.part + 1, [], 0, []
        return out


def format_branches(turns: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """Conversations of (tree, branch, pos, role, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, size = None, [], 0
        for batch in batches:
            for tree, branch, role, text in zip(*(batch.column(c).to_pylist() for c in ("tree", "branch", "role", "text"))):
                if now is None or now.key != (tree, branch):
                    if now is not None:
                        rows.append(now.row(True))
                        size += len(rows[-1]["text"])
                    now = _Writer((tree, branch))
                elif now.size >= part_chars:
                    rows.append(now.row(False))
                    size += len(rows[-1]["text"])
                if size >= part_chars:
                    yield pa.RecordBatch.from_pylist(rows, _FORMATTED)
                    rows, size = [], 0
                now.turn(role or "", text or "")
        if now is not None:
            rows.append(now.row(True))
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _FORMATTED)

    own = turns.select("tree", "branch", "pos", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return own.repartition("tree", "branch").sortWithinPartitions("tree", "branch", "pos").mapInArrow(run, FORMATTED)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


DIGEST = "tree string, branch int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGEST = pa.schema([("tree", pa.string()), ("branch", pa.int32()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


class _Reader:
    def __init__(self, key: tuple):
        self.key, self.turns, self.at, self.chars = key, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def part(self, text: str, begin: list[int], end: list[int]) -> None:
        for role, said in parse(text):
            self.turns += 1
            self.all.update(f"{role}\n{said}\n".encode())
        for a, b in zip(begin, end):
            said = unescape(text[a - self.at : b - self.at])
            self.chars += len(said)
            self.loss.update(said.encode())
        self.at += len(text)

    def row(self) -> dict:
        return dict(zip(_DIGEST.names, (*self.key, self.turns, self.all.hexdigest(), self.chars, self.loss.hexdigest(), self.at)))


def read_digests(formatted: DataFrame) -> DataFrame:
    """What stands in formatted conversations, from their marks and masks alone.

    A conversation in one row is read where it lies; only those in several rows are brought together, in order, and
    streamed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            rows = []
            for tree, branch, text, begin, end in zip(*(batch.column(c).to_pylist() for c in ("tree", "branch", "text", "loss_from", "loss_to"))):
                if now is None or now.key != (tree, branch):
                    if now is not None:
                        rows.append(now.row())
                    now = _Reader((tree, branch))
                now.part(text, begin, end)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _DIGEST)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.row()], _DIGEST)

    whole = formatted.where("part = 0 AND last")
    parts = formatted.where("NOT (part = 0 AND last)").repartition("tree", "branch").sortWithinPartitions("tree", "branch", "part")
    return whole.mapInArrow(run, DIGEST).unionByName(parts.mapInArrow(run, DIGEST))


# -- conversations by turn ----------------------------------------------------
def thread(conversations: DataFrame) -> DataFrame:
    """Messages (tree, node, parent, score, role, text): each row replies to the one before it by turn."""
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("tree"), F.coalesce(F.col("turn").cast("long"), F.lit((1 << 63) - 1)).alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")],
    )
    at = numbered(rows, ["tree"], ["turn", "role", "text"], "node")
    messages = at.select("tree", "node", F.when(F.col("node") > 0, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")
    return keep(messages, "chat-messages")


def chat(messages: DataFrame, best: int | None = 1, part_chars: int = PART_CHARS) -> DataFrame:
    """Messages (tree, node, parent, score, role, text) to formatted conversations of their best branches."""
    own = messages.dropDuplicates(["tree", "node"])
    chosen = branches(own.select("tree", "node", "parent", "score"), best)
    return format_branches(chosen.join(own.select("tree", "node", "role", "text"), ["tree", "node"]), part_chars)


def digest_table(conversations: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """The planted conversation and all others, formatted, written, and read back."""
    planted = conversations.sparkSession.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, ASSISTANT, PLANTED)], "conv_id long, turn long, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    formatted = keep(chat(thread(rows.unionByName(planted)), 1, part_chars), "chat-formatted")
    found = read_digests(formatted)
    return found.select(F.when(F.col("tree") != "null", F.col("tree").cast("long")).alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e') AS t,
             replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\e'), chr(10), '\n') AS o FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS LAST, role, text), '')) AS loss_sha256,
       CAST(sum(length(o) + length(t) + 14) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
