"""Sampled Shapley values of words for any scoring model (M9).

A row's words are cut into consecutive groups, the players.  For some orders of the players,
drawn by hash, the row is scored with ever more of them present; a player's value is the mean
rise of the score at its entrance.  The coalitions of all rows are one DataFrame, so the model
is applied as it is to a table: a fitted pipeline, the batch hook of a user's model, or plain
expressions.  Along each order the rises add up to the score of the whole text less that of
the empty one, so the values of a row do too, exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinio.functions.arrays import explode_rows


def coalitions(df: DataFrame, ws_col: str, row_id: str, players: int, orders: int, seed: int) -> DataFrame:
    """``row, order, step, now, following, text``: the words present after each step.

    ``now`` is the player that has come in with this step (null at first) and ``following`` the
    next (null at last).  Orders come in pairs, each with its reverse, which lowers the error.
    """
    ws = F.coalesce(F.col(ws_col), F.expr("CAST(array() AS array<string>)"))
    rows = df.select(F.col(row_id).alias("row"), ws.alias("ws"))
    rows = rows.withColumn("m", F.least(F.size("ws"), F.lit(players)))
    cut = lambda j: F.floor(j * F.size("ws") / F.col("m")).cast("int")
    groups = F.when(F.col("m") > 0, F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda j: F.array_join(
        F.slice("ws", cut(j) + 1, cut(j + 1) - cut(j)), " "))).otherwise(F.expr("CAST(array() AS array<string>)"))
    rows = rows.select("row", "m", groups.alias("groups"))
    drawn = explode_rows(rows, F.sequence(F.lit(0), F.lit(orders - 1)), "order", "row", "m", "groups")
    every = F.when(F.col("m") > 0, F.sequence(F.lit(0), F.col("m") - 1)).otherwise(F.expr("CAST(array() AS array<int>)"))
    pair = F.floor(F.col("order") / 2)
    by_hash = F.transform(F.array_sort(F.transform(every, lambda j: F.struct(F.xxhash64(F.lit(seed), "row", pair, j).alias("h"), j.alias("j")))),
                          lambda s: s["j"])
    drawn = drawn.withColumn("come", F.when(F.col("order") % 2 == 1, F.reverse(by_hash)).otherwise(by_hash))
    steps = explode_rows(drawn, F.sequence(F.lit(0), F.col("m")), "step", "row", "order", "groups", "come")
    there = F.slice("come", 1, F.col("step"))
    # In the order of the text, whatever the order of entrance.
    text = F.array_join(F.transform(F.array_sort(there), lambda j: F.get("groups", j)), " ")
    return steps.select("row", "order", "step", F.get("come", F.col("step") - 1).alias("now"), F.get("come", F.col("step")).alias("following"),
                        text.alias("text"))


def shapley_values(df: DataFrame, ws_col: str, score: Callable[[DataFrame], DataFrame], row_id: str = "row_id",
                   players: int = 16, orders: int = 4, seed: int = 42) -> DataFrame:
    """``(row_id, player, value)`` and a base row (player -1): they add up to the row's score.

    ``score`` adds a column ``score`` to a frame with ``text``.  A row of up to ``players`` words
    has a player per word; longer ones have ``players`` groups of words, nearly equal in
    size.  Each row is scored ``orders * (players + 1)`` times at most, whatever its length.
    With all orders of the players the values are exact; with ``orders`` of them the error of
    a value falls with their square root.  A row without words has the base row only.
    """
    kind = df.schema[row_id].dataType
    made = score(coalitions(df, ws_col, row_id, players, orders, seed))
    share = F.col("score").cast("double") / orders
    # A score counts for the player that came in with it and against the one that comes next.
    part = lambda player, v: F.struct(player.alias("player"), v.alias("v"))
    parts = F.array(part(F.coalesce("now", F.lit(-1)), share), part(F.col("following"), -share))
    each = explode_rows(made, F.filter(parts, lambda p: p["player"].isNotNull()), "p", "row")
    return (each.groupBy(F.col("row").cast(kind).alias(row_id), F.col("p.player").alias("player"))
            .agg(F.sum("p.v").alias("value")))
