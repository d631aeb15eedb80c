"""Chat formatting of reply trees, in DataFrame operations only.

Messages form trees by parent. Self-joins on the parent pointer, doubled each
round, give every message its depth and the score of the path from its root, in
about log2(depth) rounds. The leaves of a tree are ranked by path score; from
the chosen leaf the stored pointers of the rounds lead back over all messages of
its path. The path is formatted as one conversation with a loss mask over the
assistant's texts.

Template: ``<s>`` role ``[INST]`` text ``</s>`` for each message. In roles and texts a
backslash follows every ``<``, ``[`` and backslash, so none of the marks, nor any
other string that starts like one, can come from a text; dropping those
backslashes gives the text back.

Defined results: null roles and texts are empty; a null conversation id is a
conversation; rows are ordered by turn (null first), role and text, so ties and
repeated rows all stay, in a fixed order; a message whose parent is missing is a
root; messages on a cycle belong to no path; ties of score go to the smallest
leaf; empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbridge.session import materialize

BEGIN, SAYS, END = "<s>", "[INST]", "</s>"
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def trees_from_turns(turns: DataFrame) -> DataFrame:
    """Each row of (conv_id, turn, role, text) replies to the one before it."""
    place = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    rows = turns.select("conv_id", F.row_number().over(place).cast("long").alias("node"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _tree(column: str = "conv_id") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("none"))


def best_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """conv_id, tree, leaf, branch, path_score, depth, role, text: the messages of the ``branches`` best paths of each tree.

    ``nodes``: conv_id, node, parent, role, text, score; of repeated node ids in a
    tree the first by parent, role and text counts.
    """
    held = materialize(nodes.withColumn("tree", _tree()), "chat-nodes")
    ids = held.groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.min_by("score", F.struct("parent", "role", "text")).alias("score"))
    known = ids.select("tree", F.col("node").alias("parent"), F.lit(True).alias("_known"))
    state = ids.join(known, ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("_known"), F.col("parent")).alias("up"), F.coalesce("score", F.lit(0.0)).alias("sum"), F.lit(1).cast("long").alias("depth"),
    )
    state = materialize(state, "chat-jumps")
    settled, levels, open_ = [state.where("up is null")], [], state.where("up is not null")
    above = state
    while len(levels) < 40 and not open_.isEmpty():
        levels.append(open_.select("tree", "node", "up"))
        step = above.select("tree", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("sum").alias("_sum"), F.col("depth").alias("_depth"))
        jumped = materialize(open_.join(step, ["tree", "up"]).select(
            "tree", "node", F.col("_up").alias("up"), (F.col("sum") + F.col("_sum")).alias("sum"), (F.col("depth") + F.col("_depth")).alias("depth"),
        ), "chat-jumps")
        settled.append(jumped.where("up is null"))
        open_ = jumped.where("up is not null")
        # later jumps land on rows that are settled by now, or on open ones of this round
        above = reduce(DataFrame.unionByName, [*settled, open_])
    rooted = reduce(DataFrame.unionByName, settled).select("tree", "node", "sum", "depth")
    replied = ids.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    leaves = rooted.join(replied, ["tree", "node"], "left_anti")
    ranked = leaves.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("sum"), "node"))).where(F.col("branch") <= branches)
    marked = materialize(ranked.select("tree", F.col("node").alias("leaf"), F.col("sum").alias("path_score"), "branch", "node"), "chat-path")
    for level in reversed(levels):
        over = marked.join(level, ["tree", "node"]).select("tree", "leaf", "path_score", "branch", F.col("up").alias("node"))
        marked = materialize(marked.unionByName(over), "chat-path")
    path = marked.join(rooted.select("tree", "node", "depth"), ["tree", "node"])
    texts = held.groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "conv_id")).alias("_m"))
    return path.join(texts, ["tree", "node"]).select("_m.conv_id", "tree", "leaf", "branch", "path_score", "depth", F.coalesce("_m.role", F.lit("")).alias("role"), F.coalesce("_m.text", F.lit("")).alias("text"))


def format_paths(path: DataFrame) -> DataFrame:
    """One row per path: formatted, loss_turns (mask by message) and loss_spans (code points of ``formatted``, ends exclusive)."""
    keys = ["tree", "leaf"]
    head = F.concat(F.lit(BEGIN), escape(F.col("role")), F.lit(SAYS))
    pieces = path.select(*keys, "conv_id", "branch", "path_score", "depth", (F.col("role") == LEARNED_ROLE).alias("learned"), head.alias("head"), escape(F.col("text")).alias("body"))
    earlier = Window.partitionBy(*keys).orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(END)
    placed = pieces.withColumn("start", F.coalesce(F.sum(size).over(earlier), F.lit(0)) + F.length("head"))
    one = F.struct("depth", "learned", "start", (F.col("start") + F.length("body")).alias("end"), F.concat("head", "body", F.lit(END)).alias("piece"))
    joined = placed.groupBy(*keys).agg(F.first("conv_id").alias("conv_id"), F.first("branch").alias("branch"), F.first("path_score").alias("path_score"), F.array_sort(F.collect_list(one)).alias("turns"))
    return joined.select(
        "conv_id", "leaf", "branch", "path_score",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform("turns", lambda t: t["learned"]).alias("loss_turns"),
        F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with turns: the role, text and mask of each message, from the formatted string."""
    parts = F.split("formatted", END)
    whole = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(p: Column, i: Column) -> Column:
        role = F.substring_index(p, SAYS, 1)
        text = F.substr(p, F.length(role) + 1 + len(SAYS))
        return F.struct(unescape(F.substr(role, F.lit(1 + len(BEGIN)))).alias("role"), unescape(text).alias("text"), F.get("loss_turns", i).alias("learned"))

    return formatted.withColumn("turns", F.transform(whole, turn))


def digest_conversations(turns: DataFrame) -> DataFrame:
    """Formats every conversation and reports what its formatted string says."""
    back = read_back(format_paths(best_paths(trees_from_turns(turns))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: t["text"]), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
