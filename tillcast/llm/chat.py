"""Chat formatting of reply trees.

Messages name their parent.  Iterative self-joins build, for each message, its ancestor 1, 2,
4, ... steps up and the score of the messages between, with one row per message and join.
At the end each leaf has the score of its whole path; paths are ranked within their tree by
it, and only the chosen ones are enumerated, walking the stored steps from the longest to the
shortest.  Each chosen path is one conversation: a text with marked turns and the spans that
count for the loss.  Such a text is one value, so a path must stay below 2 GB of text.

Escaping: ``\\`` becomes ``\\\\`` and ``<|`` becomes ``<\\|``, so that a text never contains a
control string; a line break in a role becomes ``\\n``.  ``unescape`` undoes all three.

Defined results: null text or role is the empty text; a null tree id is a tree of its own; a
parent that does not exist makes the message a root; messages on or below a cycle of parents
have no path from a root and are left to ``unrooted``; a message id given twice in a tree keeps
both rows, side by side, in the order of role and text, and replies to the least of its
parents that exist; null scores count as zero; ties are
broken by the longer path, then by the lesser leaf.  Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions.staging import snapshot

START, END = "<|im_start|>", "<|im_end|>\n"
NODE = ["tree", "node"]
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")),
                     F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def as_tree(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn",
            role: str = "role", text: str = "text") -> DataFrame:
    """A table of plain turns as reply trees: each turn replies to the one before it."""
    flat = turns.select(tree_of(F.col(conversation)).alias("tree"), F.col(turn).alias("turn"),
                        F.col(role).alias("role"), F.col(text).alias("text"))
    at = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text"))
    return (flat.withColumn("node", at.cast("long"))
            .withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))
            .withColumn("score", F.lit(0.0)).drop("turn"))


def tree_of(key: Column) -> Column:
    """A tree's key that is never null."""
    return F.struct(key.isNull().alias("none"), key.alias("id"))


class ReplyPaths:
    """The root-to-leaf paths of messages (tree, node, parent, role, text, score)."""

    def __init__(self, messages: DataFrame):
        self.messages = messages = snapshot(
            messages.select("tree", "node", "parent", "role", "text", "score"), "messages")
        nodes = messages.groupBy(*NODE).agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("total"))
        size = messages.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
        step = snapshot(messages.where("parent IS NOT NULL AND parent != node")
                        .select("tree", "node", F.col("parent").alias("up"))
                        .join(nodes.select("tree", F.col("node").alias("up")), ["tree", "up"], "left_semi")
                        .groupBy(*NODE).agg(F.min("up").alias("up")), "parents")
        # Each message: score and number of the messages from it up to, but without, ``up``.
        climb = snapshot(nodes.withColumn("length", F.lit(1).cast("long"))
                         .join(step, NODE, "left"), "climb")
        self.levels, reach = [], 1
        # Messages that have reached a root are only looked up from then on.
        rooted, open_ = climb.where("up IS NULL"), climb.where("up IS NOT NULL")
        while not open_.isEmpty():
            if reach > size:
                # Only below a cycle can one climb more steps than the tree has messages.
                break
            self.levels.append(open_.select(*NODE, "up"))
            higher = rooted.unionByName(open_).select(
                "tree", F.col("node").alias("up"), F.col("up").alias("top"),
                F.col("total").alias("more"), F.col("length").alias("longer"))
            climb = snapshot(open_.join(higher, ["tree", "up"]).select(
                *NODE, (F.col("total") + F.col("more")).alias("total"),
                (F.col("length") + F.col("longer")).alias("length"), F.col("top").alias("up")), "climb")
            rooted = rooted.unionByName(climb.where("up IS NULL"))
            open_ = climb.where("up IS NOT NULL")
            reach *= 2
        self.unrooted = messages.join(open_, NODE, "left_semi")
        inner = step.select("tree", F.col("up").alias("node")).distinct()
        #: (tree, leaf, total, length): score and number of messages of each path.
        self.leaves = snapshot(
            rooted.join(inner, NODE, "left_anti")
            .select("tree", F.col("node").alias("leaf"), "total", "length"), "leaves")

    def chosen(self, branches: int | None = 1) -> DataFrame:
        """(tree, leaf, node, height above the leaf) of the best paths of each tree; of all for None.

        Leaves are ranked by the sums of their paths; only the chosen ones are walked up.
        """
        best = self.leaves
        if branches is not None:
            order = Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("length"), "leaf")
            best = (best.withColumn("place", F.row_number().over(order))
                    .where(F.col("place") <= branches))
        members = best.select("tree", "leaf", F.col("leaf").alias("node"),
                              F.lit(0).cast("long").alias("height"))
        for power in reversed(range(len(self.levels))):
            higher = members.join(self.levels[power], NODE).select(
                "tree", "leaf", F.col("up").alias("node"),
                (F.col("height") + (1 << power)).alias("height"))
            # Stored at each step: the plan would double with every power of two.
            members = snapshot(members.unionByName(higher), "paths")
        return members

    @property
    def members(self) -> DataFrame:
        """The messages of all paths."""
        return self.chosen(None)

    def format(self, branches: int | None = 1, learn: str = "assistant") -> DataFrame:
        """(tree, leaf, formatted, spans): one row per chosen path.

        ``spans`` holds start and length, in code points of ``formatted``, of the escaped
        texts of the role to learn from.
        """
        turns = self.chosen(branches).join(self.messages.select(*NODE, "role", "text"), NODE)
        role, text = escape_role(F.col("role")), escape(F.col("text"))
        turns = turns.select(
            "tree", "leaf", "height", F.coalesce("role", F.lit("")).alias("role"),
            F.concat(F.lit(START), role, F.lit("\n")).alias("head"), text.alias("body"))
        turns = turns.withColumn("turn", F.concat("head", "body", F.lit(END)))
        order = (Window.partitionBy("tree", "leaf").orderBy(F.desc("height"), "role", "body"))
        before = F.sum(F.char_length("turn")).over(order.rowsBetween(Window.unboundedPreceding, -1))
        placed = turns.select(
            "tree", "leaf", "turn", F.row_number().over(order).alias("at"),
            F.when(F.col("role") == learn, F.struct(
                (F.coalesce(before, F.lit(0)) + F.char_length("head")).alias("start"),
                F.char_length("body").cast("long").alias("length"))).alias("span"))
        rows = placed.groupBy("tree", "leaf").agg(
            F.sort_array(F.collect_list(F.struct("at", "turn", "span"))).alias("turns"))
        return rows.select(
            "tree", "leaf", F.concat_ws("", F.transform("turns", lambda t: t.turn)).alias("formatted"),
            F.filter(F.transform("turns", lambda t: t.span), lambda s: s.isNotNull()).alias("spans"))


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError("not a formatted conversation")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return turns


def digests(formatted: DataFrame) -> DataFrame:
    """Read conversations back: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars), all taken from the formatted text and its spans."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_digest(r) for r in batch.to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return formatted.select(F.col("tree.id").cast("long").alias("conv_id"), "formatted",
                            "spans").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
             "loss_sha256 string, formatted_chars long")


def _digest(row: dict) -> tuple:
    whole = row["formatted"]
    turns = read_turns(whole)
    said = "".join(f"{role}\n{text}\n" for role, text in turns)
    learnt = "".join(unescape(whole[s["start"]:s["start"] + s["length"]]) for s in row["spans"])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return row["conv_id"], len(turns), sha(said), len(learnt), sha(learnt), len(whole)
