"""Chat formatting over reply trees.

Messages point to the message they answer.  Self-joins that double their reach sum the scores from each leaf to its
root; branches of a conversation are ranked by score, and only the chosen paths are enumerated, by the same jumps; each
becomes one formatted conversation.
The template marks turns; strings of the template inside a text are escaped with a backslash, so that reading the
output back gives the texts exactly.

Defined results: null roles and texts are empty; turns tie-break on role and text, null turns first; rows that repeat
are turns of their own; null conv_id is one conversation; an empty table gives an empty table; other columns are
ignored.  Messages whose parent is absent, or in another conversation, are roots; a null score counts as 0; messages on or below
a cycle of replies have no root and are left out.  The rounds number the logarithm of the longest conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, tidy

ROLE, BODY, END = "### ", ":\n", "\n</turn>\n"
#: What a text may not hold as it is: the escape itself, and what starts or ends a turn.
SPECIAL = re.compile(r"\\|###|</turn>")
ESCAPED = re.compile(r"\\(\\|###|</turn>)")
ROLE_ESCAPED = re.compile(r"\\(\\|###|</turn>|c)")


def escape(text: str) -> str:
    return SPECIAL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1], text)


def escape_role(role: str) -> str:
    """As ``escape``; a colon, which ends a role, becomes a backslash and c."""
    return escape(role).replace(":", "\\c")


def unescape_role(role: str) -> str:
    return ROLE_ESCAPED.sub(lambda m: ":" if m[1] == "c" else m[1], role)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of it under the loss mask (escaped texts of the assistant)."""
    parts, at, spans = [], 0, []
    for role, text in turns:
        head = ROLE + escape_role(role) + BODY
        body = escape(text)
        at += len(head)
        if role == "assistant":
            spans.append((at, at + len(body)))
        parts += head, body, END
        at += len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Read a formatted conversation back."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(ROLE, at):
            raise ValueError(f"no turn at {at}")
        body = _ends(formatted, BODY, at + len(ROLE))
        end = _ends(formatted, END, body + len(BODY))
        out.append((unescape_role(formatted[at + len(ROLE) : body]), unescape(formatted[body + len(BODY) : end])))
        at = end + len(END)
    return out


def _ends(text: str, mark: str, at: int) -> int:
    """Where ``mark`` next stands unescaped.  The marks never stand so inside an escaped text: see ``escape``."""
    found = text.find(mark, at)
    if found < 0:
        raise ValueError("a turn does not end")
    return found


def _jumps(messages: DataFrame) -> DataFrame:
    """``(node, above)`` for each message whose parent is a message of its conversation."""
    child = messages.select("node", "conv", F.col("parent").alias("above"))
    parent = messages.select(F.col("node").alias("above"), F.col("conv").alias("home"))
    return child.join(parent, "above").where(F.col("conv").eqNullSafe(F.col("home"))).select("node", "above")


def score_branches(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``(conv, leaf, score, depth)`` of each branch, and the tables ``(node, above)`` of jumps by 1, 2, 4, ... steps.

    A node carries the sum of scores of the stretch up to where it jumps next; a round doubles the stretch, so no path
    is spelled out.  A path has no more messages than its conversation: what still jumps then is on or below a cycle."""
    longest = messages.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    jumps = materialize(_jumps(messages))
    leaves = messages.join(jumps.select(F.col("above").alias("node")).distinct(), "node", "left_anti").select("node")
    scores = messages.select("node", "conv", F.coalesce("score", F.lit(0.0)).alias("score"))
    state = materialize(scores.join(jumps, "node", "left").select("conv", "node", "above", "score", F.lit(1).cast("long").alias("n")))
    steps = [jumps]
    while 1 << (len(steps) - 1) < longest and not jumps.isEmpty():
        onward = state.select(F.col("node").alias("above"), F.col("above").alias("next"), F.col("score").alias("more"), F.col("n").alias("m"))
        far = state.where("above is not null").join(onward, "above").select("conv", "node", F.col("next").alias("above"), (F.col("score") + F.col("more")).alias("score"), (F.col("n") + F.col("m")).alias("n"))
        state = materialize(state.where("above is null").unionByName(far))
        jumps = state.where("above is not null").select("node", "above")
        steps.append(jumps)
    done = state.where("above is null").join(leaves, "node", "left_semi")
    return done.select("conv", F.col("node").alias("leaf"), "score", (F.col("n") - 1).alias("depth")), steps


def choose_branches(branches: DataFrame, most: int = 1) -> DataFrame:
    """The best ``most`` leaves of each conversation by the sum of scores on their path; ties to the smaller leaf."""
    best = F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("score"), "leaf"))
    return branches.withColumn("branch", best).where(F.col("branch") <= most)


def enumerate_paths(leaves: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """``leaves(leaf)`` and the tables of jumps to ``(leaf, node, up)``: all nodes on the way from each leaf up to its
    root, ``up`` steps above the leaf.  Rounds double the reach, so a long conversation takes few."""
    paths = leaves.select("leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up"))
    for k, jumps in enumerate(steps):
        # A jump of 2**k steps from one of the first 2**k nodes leads to one of the next.
        more = paths.join(jumps, "node").select("leaf", F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        paths = materialize(paths.union(more))
    return paths


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, spans = [], []
        for turns in batch.column("turns").to_pylist():
            out, marks = render([(t["role"] or "", t["text"] or "") for t in turns])
            text.append(out)
            spans.append([x for m in marks for x in m])
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("branch"), pa.array(text, pa.string()), pa.array(spans, pa.list_(pa.int64()))], ["conv", "branch", "formatted", "loss_spans"])


def format_conversations(messages: DataFrame, branches: int = 1) -> DataFrame:
    """``messages(conv, node, parent, role, text, score)`` to ``(conv, branch, formatted, loss_spans)``.

    ``node`` is unique over the table; ``loss_spans`` lists start and end of each assistant text in code points."""
    messages = materialize(messages)
    found, steps = score_branches(messages)
    chosen = materialize(choose_branches(found, branches))
    paths = enumerate_paths(chosen, steps)
    turns = paths.join(chosen.select("leaf", "conv", "branch", "depth"), "leaf").join(messages.select("node", "role", "text"), "node")
    turn = F.struct((F.col("depth") - F.col("up")).alias("at"), "role", "text")
    whole = turns.groupBy("leaf", "branch", "conv").agg(F.sort_array(F.collect_list(turn)).alias("turns")).select("conv", "branch", "turns")
    return whole.mapInArrow(tidy(_formatted), "conv long, branch int, formatted string, loss_spans array<long>")


def linear_messages(rows: DataFrame) -> DataFrame:
    """Conversation rows (conv_id, turn, role, text) as chains: each row answers the one before it by turn.

    Nodes number the rows densely inside a conversation's own range of ids, so the order is part of the id."""
    rows = rows.selectExpr("cast(conv_id as long) conv", "cast(turn as long) turn", "coalesce(role, '') role", "coalesce(text, '') text")
    rows = materialize(rows.withColumn("node", F.monotonically_increasing_id()))
    order = Window.partitionBy("conv").orderBy("turn", "role", "text", "node")
    return rows.select("conv", "node", F.lag("node").over(order).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    for batch in batches:
        out = []
        for formatted, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist()):
            turns = parse(formatted)
            loss = "".join(unescape(formatted[i:j]) for i, j in zip(spans[::2], spans[1::2]))
            out.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(formatted)))
        cols = list(zip(*out)) or [()] * 5
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pa.RecordBatch.from_arrays([batch.column("conv"), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["conv_id", *names])


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say when they are read back."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv", "formatted", "loss_spans").mapInArrow(tidy(_digests), schema)
