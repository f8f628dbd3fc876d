"""Operator 8: conversations from reply trees.

Messages form trees by their parent.  Iterative self-joins with doubling steps enumerate
root-to-leaf paths: round ``k`` joins the ancestor table with itself, so that each node knows
its ancestor ``2^k`` levels up and the scores on the way there.  Going back down the steps each
leaf adds up the scores of its path, without enumerating it, and the branches of a tree are
ranked; then the path of each chosen leaf doubles with each join.  A path of ``n`` messages takes
``log2(n)`` joins, not ``n``.  Each chosen path is formatted as one conversation.

Format: every message is ``<|turn|>role``, a line end, the text and ``<|end|>``.  Control strings
inside roles and texts are escaped with a backslash, reversibly.  The loss mask is the list
of places of assistant texts in the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opinio.llm.common import Scratch, column, settle

TURN, END = "<|turn|>", "<|end|>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    """Backslashes are doubled, and one is put into each control string."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\")
    out = F.regexp_replace(out, r"<\|", r"<\\|")
    out = F.regexp_replace(out, r"<(?=/?s>)", r"<\\")
    out = F.regexp_replace(out, r"\[(?=/?INST\])", r"[\\")
    return F.regexp_replace(out, r"<(?=</?SYS>>)", r"<\\")


def unescape(text: Column) -> Column:
    """A backslash and the character after it stand for that character."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    """As a text; line ends are escaped too, since one ends the role."""
    return F.regexp_replace(escape(role), "\n", "\\\\\n")


def _key(tree: Column, node: Column) -> Column:
    """One string for a node of a tree, null ids included: ids are the tree's own."""
    part = lambda c: F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.concat(part(tree), F.lit("/"), part(node))


def _messages(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``tree, node, key, parent, role, text, score``: each node once, ``parent`` a key."""
    parent = F.when(F.col("parent").isNotNull(), _key(F.col("tree"), F.col("parent")))
    held = scratch.table(nodes.select("tree", "node", _key(F.col("tree"), F.col("node")).alias("key"), parent.alias("parent"), "role", "text",
                                      F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")))
    again = scratch.table(held.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("key"))
    if again.isEmpty():
        return held
    best = F.min(F.struct((-F.col("score")).alias("s"), "parent", "role", "text", "tree", "node", "score")).alias("row")
    one = held.join(again, "key", "left_semi").groupBy("key").agg(best)
    return scratch.table(held.join(again, "key", "left_anti").unionByName(
        one.select("row.tree", "row.node", "key", "row.parent", "row.role", "row.text", "row.score")))


def ancestors(held: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], DataFrame | None]:
    """Tables ``node, above, sum``: the ancestor 1, 2, 4, ... levels up, and the sum of the scores
    from the node on to below it; or the least node of each cycle, if parents go in circles.

    After more levels than a tree has nodes only nodes on or below a cycle still have an
    ancestor, and all of these ancestors are on one.
    """
    known = held.select(F.col("key").alias("parent"))
    step = scratch.table(held.where("parent IS NOT NULL").join(known, "parent", "left_semi").select(
        F.col("key").alias("node"), F.col("parent").alias("above"), F.col("score").alias("sum"), F.least("key", "parent").alias("low")))
    largest = held.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    steps = []
    while not step.isEmpty():
        if 1 << len(steps) > 2 * largest:
            on = step.select(F.col("above").alias("node")).distinct()
            return steps, scratch.table(step.join(on, "node", "left_semi").where("node = low").select(F.col("node").alias("key")))
        steps.append(step)
        far = step.select(F.col("node").alias("above"), F.col("above").alias("far"), F.col("sum").alias("more"), F.col("low").alias("lower"))
        step = scratch.table(step.join(far, "above").select(
            "node", F.col("far").alias("above"), (F.col("sum") + F.col("more")).alias("sum"), F.least("low", "lower").alias("low")))
    return steps, None


def rank_leaves(held: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """``tree, leaf, score, place``: the leaves of each tree from the best path on.

    The score of a path is the mean score of its messages; ties go to the longer path, then
    to the smaller leaf.  ``place`` counts from 1.  A leaf is one row all the way.
    """
    leaves = held.select("tree", F.col("key").alias("leaf"))
    if steps:
        leaves = leaves.join(steps[0].select(F.col("above").alias("leaf")).distinct(), "leaf", "left_anti")
    at = leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0.0).alias("total"), F.lit(1).cast("long").alias("n"))
    for k in range(len(steps) - 1, -1, -1):
        at = at.join(steps[k].select("node", "above", "sum"), "node", "left").select(
            "tree", "leaf", F.coalesce("above", "node").alias("node"), (F.col("total") + F.coalesce("sum", F.lit(0.0))).alias("total"),
            (F.col("n") + F.when(F.col("above").isNotNull(), F.lit(1 << k)).otherwise(0)).alias("n"))
    root = held.select(F.col("key").alias("node"), F.col("score").alias("own"))
    scored = at.join(root, "node").select("tree", "leaf", "n", ((F.col("total") + F.col("own")) / F.col("n")).alias("score"))
    order = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("score").desc(), F.col("n").desc(), "leaf"))
    return scored.select("tree", "leaf", "score", order.alias("place"))


def paths(leaves: DataFrame, steps: list[DataFrame], scratch: Scratch) -> DataFrame:
    """``leaf, node, up``: the nodes on the path of each of ``leaves`` (``leaf``), ``up`` levels above it.

    Each round is written: it reads the one before twice, so plans would double with it.
    """
    found = leaves.select("leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up"))
    for k in range(len(steps) - 1, -1, -1):
        higher = found.join(steps[k], "node").select("leaf", F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        found = scratch.table(found.union(higher))
    return found


def conversations(nodes: DataFrame, per_tree: int = 1) -> DataFrame:
    """``tree, leaf, score, formatted, loss``: the ``per_tree`` best paths of each tree.

    ``nodes`` has ``tree, node, parent, role, text, score``; a node's id is its tree's own, and a
    parent that is null or no node of the tree makes a root.  ``formatted`` is the whole
    conversation and ``loss`` the ``(start, end)`` places of assistant texts in it (code
    points, end exclusive).  Null roles and texts are empty, a null score is 0, null ids are ids
    like others.  Of rows that repeat a node the one with the highest score stays, of these
    the least by parent, role and text.  Parents that go in a circle: the least node of the
    circle (by its key) becomes a root.  An empty table gives none.  One conversation is one
    row, however long.
    """
    with Scratch(nodes.sparkSession, "chat") as scratch:
        held = _messages(nodes, scratch)
        steps, circles = ancestors(held, scratch)
        if circles is not None:
            cut = circles.withColumn("cut", F.lit(True))
            held = scratch.table(held.join(cut, "key", "left").withColumn("parent", F.when(F.col("cut").isNull(), F.col("parent"))).drop("cut"))
            steps, _ = ancestors(held, scratch)
        chosen = scratch.table(rank_leaves(held, steps).where(F.col("place") <= per_tree))
        return settle(_format(paths(chosen, steps, scratch), chosen, held))


def _format(found: DataFrame, chosen: DataFrame, nodes: DataFrame) -> DataFrame:
    names = nodes.select(F.col("key").alias("leaf"), F.col("node").alias("leaf_node"))
    said = (found.join(chosen.select("leaf", "tree", F.col("score").alias("path_score")).join(names, "leaf"), "leaf")
            .join(nodes.select(F.col("key").alias("node"), "role", "text"), "node"))
    head = F.concat(F.lit(TURN), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    piece = F.struct((-F.col("up")).alias("at"), F.concat(head, body, F.lit(END)).alias("s"),
                     F.length(head).alias("lead"), F.length(body).alias("n"),
                     F.coalesce(F.col("role") == ASSISTANT, F.lit(False)).alias("loss"))
    told = said.groupBy("tree", "leaf", "leaf_node", "path_score").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,end:int>>)").alias("spans"))
    step = lambda acc, x: F.struct(
        (acc["at"] + x["lead"] + x["n"] + len(END)).alias("at"),
        F.when(x["loss"], F.concat(acc["spans"], F.array(F.struct(
            (acc["at"] + x["lead"]).alias("start"), (acc["at"] + x["lead"] + x["n"]).alias("end")))))
        .otherwise(acc["spans"]).alias("spans"))
    return told.select("tree", F.col("leaf_node").alias("leaf"), F.col("path_score").alias("score"),
                       F.array_join(F.transform("p", lambda x: x["s"]), "").alias("formatted"),
                       F.aggregate("p", start, step, lambda acc: acc["spans"]).alias("loss"))


def parse(formatted: Column) -> Column:
    """``(role, text)`` per message, read back from a formatted conversation."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>"), lambda x: x != "")
    # The role ends at the first line end that no backslash escapes.
    role = lambda x: F.regexp_extract(x, r"(?s)^((?:[^\\\n]|\\.)*)\n", 1)
    return F.transform(pieces, lambda x: F.struct(
        unescape(role(x)).alias("role"),
        unescape(F.substring(x, F.length(role(x)) + 2, F.length(x) - F.length(role(x)) - 1 - len(END))).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def linear_trees(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """Plain conversations as trees without branches: each message replies to the one before.

    Messages are in order of turn; rows that share a turn are ordered by role and text, nulls
    first.  A null conversation id is a conversation like any other.
    """
    df = rows.select(column(rows, id_col).alias("tree"), column(rows, turn_col).alias("turn"),
                     column(rows, role_col).alias("role"), column(rows, text_col).alias("text"))
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    df = df.withColumn("seq", F.row_number().over(order))
    key = lambda n: F.concat_ws(":", F.coalesce(F.col("tree").cast("string"), F.lit("")), n.cast("string"))
    return df.select("tree", key(F.col("seq")).alias("node"),
                     F.when(F.col("seq") > 1, key(F.col("seq") - 1)).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
