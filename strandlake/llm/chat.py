"""Chat formatting of reply trees: paths by doubling self-joins, branches ranked by score, one conversation per chosen path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.llm._common import written

# The marks of the template.
START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    """`<`, any backslashes, `|` gets one more backslash: no mark can occur in the result, and unescaped() gives the text back."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escaped_role(role: Column) -> Column:
    """A role stays on its line: `%` and line feeds are percent-encoded besides."""
    return escaped(F.replace(F.replace(F.coalesce(role, F.lit("")), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def reply_paths(messages: DataFrame, tree: str = "tree_id", node: str = "node_id", parent: str = "parent_id", score: str = "score") -> DataFrame:
    """All root-to-leaf paths: tree_id, leaf, node_id, depth (0: root), path_score, path_rank.

    Self-joins double the reach: after k of them every message knows its ancestor
    2^k above, and the paths from the leaves have 2^k messages, so a tree of depth d
    takes about log2(d) rounds. Each round is written to the shared folder; it holds
    ids and scores, never texts. path_score is the mean score (null: 0) of a path's
    messages, summed from leaf to root, so that it is the same however rows arrive; equal scores are ranked by leaf id. A parent that isn't in the tree
    makes a root. Messages without a node id, and branches that end in a cycle, have
    no root-to-leaf path and are left out. Of messages that repeat a node id the first by parent counts.
    """
    nodes = messages.select(F.col(f"`{tree}`").alias("tree_id"), F.col(f"`{node}`").alias("node_id"), F.col(f"`{parent}`").alias("parent_id"), F.coalesce(F.col(f"`{score}`").cast("double"), F.lit(0.0)).alias("score"))
    nodes = nodes.where("node_id is not null").groupBy("tree_id", "node_id").agg(F.min_by("parent_id", F.coalesce(F.col("parent_id").cast("string"), F.lit(""))).alias("parent_id"), F.max("score").alias("score"))
    known = nodes.select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"))
    nodes = nodes.join(known, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("parent_id") == F.col("n")), "left")
    nodes = written(nodes.select("tree_id", "node_id", F.col("n").alias("parent_id"), "score"), "chat-nodes")
    has_child = nodes.where("parent_id is not null").select(F.col("tree_id").alias("t"), F.col("parent_id").alias("n")).distinct()
    leaves = nodes.join(has_child, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("node_id") == F.col("n")), "left_anti")
    paths = leaves.select("tree_id", F.col("node_id").alias("leaf"), "node_id", F.lit(0).cast("long").alias("above_leaf"))
    jumps = nodes.where("parent_id is not null").select("tree_id", "node_id", F.col("parent_id").alias("ancestor"))
    largest = nodes.groupBy("tree_id").count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while reach < largest:
        jump = jumps.select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"), "ancestor")
        up = paths.join(jump, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("node_id") == F.col("n")))
        paths = written(paths.unionByName(up.select("tree_id", "leaf", F.col("ancestor").alias("node_id"), (F.col("above_leaf") + reach).alias("above_leaf"))), "chat-paths")
        far = jump.select(F.col("t"), F.col("n"), F.col("ancestor").alias("beyond"))
        jumps = written(
            jumps.join(far, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("ancestor") == F.col("n"))).select("tree_id", "node_id", F.col("beyond").alias("ancestor")), "chat-jumps"
        )
        reach *= 2
        if jumps.isEmpty():
            break
    scored = paths.join(nodes.select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"), "parent_id", "score"), F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("node_id") == F.col("n")))
    per_path = scored.groupBy("tree_id", "leaf").agg(F.array_sort(F.collect_list(F.struct("above_leaf", "score"))).alias("scores"), F.max("above_leaf").alias("length"), F.max(F.col("parent_id").isNull()).alias("rooted"))
    per_path = per_path.withColumn("path_score", F.aggregate("scores", F.lit(0.0), lambda total, x: total + x["score"]) / F.size("scores"))
    per_path = per_path.where("rooted").withColumn("path_rank", F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("path_score"), "leaf")))
    per_path = per_path.select(F.col("tree_id").alias("t"), F.col("leaf").alias("l"), "path_score", "path_rank", "length")
    return paths.join(per_path, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("l"))).select("tree_id", "leaf", "node_id", (F.col("length") - F.col("above_leaf")).alias("depth"), "path_score", "path_rank")


def format_trees(
    messages: DataFrame, tree: str = "tree_id", node: str = "node_id", parent: str = "parent_id", role: str = "role", text: str = "text", score: str = "score", best: int | None = None, learn: str = "assistant"
) -> DataFrame:
    """Format the best-ranked paths of each tree (best: how many; None: all).

    Returns tree_id, leaf, path_rank, path_score, n_turns, formatted (string) and
    loss (array of start, length: code points of formatted, start from 0, that hold
    the texts of role `learn`). Null roles and texts count as empty. A conversation is
    one row, so its messages meet in one task; texts join after the ranking, for the
    chosen paths only.
    """
    paths = reply_paths(messages, tree, node, parent, score)
    if best is not None:
        paths = paths.where(F.col("path_rank") <= best)
    said = messages.select(F.col(f"`{tree}`").alias("t"), F.col(f"`{node}`").alias("n"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    said = said.groupBy("t", "n").agg(F.min(F.struct("role", "text")).alias("said"))
    rows = paths.join(said, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("node_id") == F.col("n")))
    rows = rows.withColumn("head", F.concat(F.lit(START), escaped_role(F.col("said.role")), F.lit("\n"))).withColumn("body", escaped(F.col("said.text")))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    before = Window.partitionBy("tree_id", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0)) + F.length("head"))
    rows = rows.withColumn("span", F.when(F.col("said.role") == learn, F.struct(F.col("at").alias("start"), F.length("body").cast("long").alias("length"))))
    turns = F.array_sort(F.collect_list(F.struct("depth", "piece", "span")))
    out = rows.groupBy("tree_id", "leaf", "path_rank", "path_score").agg(turns.alias("turns"))
    return out.select(
        "tree_id", "leaf", "path_rank", "path_score",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.col("turns.piece"), "").alias("formatted"),
        F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds, unescaped."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(START) + 1))
        return F.struct(unescaped_role(F.substring_index(body, "\n", 1)).alias("role"), unescaped(F.substr(body, F.locate("\n", body) + F.lit(1))).alias("text"))

    return F.transform(pieces, turn)


def chains(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as reply trees without branches: each message answers the one before it.

    Equal turns are ordered by role and text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    at = F.row_number().over(order).cast("long")
    return conversations.select(F.col("conv_id").alias("tree_id"), at.alias("node_id"), F.when(at > 1, at - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))
