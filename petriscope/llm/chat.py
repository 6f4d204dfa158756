"""Reply trees to formatted conversations, in DataFrame operations only.

Root-to-leaf paths come from iterative self-joins that double their reach: a
table of jumps to the ancestor 2**k replies up joins with itself, and the paths
found so far join with it, so a thread of a thousand replies takes ten rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that chat templates give a meaning, the own ones first.
CONTROL = (
    TURN, BODY, END,
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|eot_id|>",
    "<|system|>", "<|user|>", "<|assistant|>",
)


def escaped(text: Column) -> Column:
    r"""No control string survives: ``\`` is doubled, and ``\;`` parts a control string's first character from its rest."""
    start = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit(f"{s[0]}\\;{s[1:]}")), CONTROL, start)


def unescaped(text: Column) -> Column:
    r"""The inverse of :func:`escaped`, in one pass from the left: ``\;`` goes, ``\\`` is ``\``."""
    return F.regexp_replace(text, r"\\(?:;|(\\))", "$1")


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, dist) of every root-to-leaf path of (tree, node, parent).

    ``dist`` counts replies up from the leaf.  A node whose parent is null or
    absent is a root.  Repeated (tree, node) rows are one node with the least
    parent.  Chains that run into a cycle have no root and give no path.
    """
    one = nodes.groupBy("tree", "node").agg(F.min("parent").alias("parent"))
    one = written(one, "nodes")
    known = one.select("tree", F.col("node").alias("parent"))
    jump = written(one.where("parent is not null").join(known, ["tree", "parent"]).select("tree", "node", F.col("parent").alias("up")), "jump")
    leaves = one.join(jump.select("tree", F.col("up").alias("node")).distinct(), ["tree", "node"], "left_anti")
    found = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("dist"))
    largest = one.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while not jump.isEmpty():
        if reach > largest:  # only cycles go on for longer than a tree has nodes
            lost = found.join(jump.select("tree", "node"), ["tree", "node"], "left_semi").select("tree", "leaf").distinct()
            found = found.join(lost, ["tree", "leaf"], "left_anti")
            break
        further = found.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("dist") + reach).alias("dist"))
        found = written(found.unionByName(further), "paths")
        second = jump.select("tree", F.col("node").alias("up"), F.col("up").alias("upper"))
        jump = written(jump.join(second, ["tree", "up"]).select("tree", "node", F.col("upper").alias("up")), "jump")
        reach *= 2
    return found


def format_trees(messages: DataFrame, branches: int = 1, loss_role: str = "assistant") -> DataFrame:
    """(tree, leaf, rank, score, formatted, loss) of the best ``branches`` paths of each tree.

    ``messages``: tree, node, parent (longs), role, text, score; other columns
    don't matter.  Branches rank by the sum of their scores (null: 0), longer
    ones and then smaller leaf ids first.  A turn is ``<|turn|>role<|text|>
    text<|end|>``, with control strings inside role and text escaped; null role
    or text is empty.  ``loss`` lists (start, length) in characters of the
    texts of ``loss_role``.  Trees are long or short rows alike: what a task
    holds at once is one conversation.  Rows with a null tree are one tree, rows
    with a null node are in no path; of repeated (tree, node) rows the least
    formatted turn stands.
    """
    lost = messages.where("tree is null")
    if not lost.isEmpty():
        named = format_trees(messages.where("tree is not null"), branches, loss_role)
        return named.unionByName(format_trees(lost.withColumn("tree", F.lit(0).cast("long")), branches, loss_role).withColumn("tree", F.lit(None).cast("long")))
    found = paths(messages.select("tree", "node", "parent"))
    scores = messages.groupBy("tree", "node").agg(F.min(F.coalesce(F.col("score").cast("double"), F.lit(0.0))).alias("s"))
    ranked = found.join(scores, ["tree", "node"]).groupBy("tree", "leaf").agg(F.sum("s").alias("score"), F.count("*").alias("n"))
    best = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("n"), "leaf")
    ranked = ranked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= branches)
    chosen = found.join(ranked, ["tree", "leaf"])

    role, text = escaped(F.coalesce("role", F.lit(""))), escaped(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(TURN), role, F.lit(BODY))
    turns = messages.select("tree", "node", F.concat(head, text, F.lit(END)).alias("turn"), F.length(head).alias("head"), F.length(text).alias("body"), (F.col("role") == loss_role).alias("loss"))
    turns = turns.groupBy("tree", "node").agg(F.min_by(F.struct("turn", "head", "body", "loss"), "turn").alias("t")).select("tree", "node", "t.*")
    placed = chosen.join(turns, ["tree", "node"])
    order = Window.partitionBy("tree", "leaf").orderBy(F.desc("dist")).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.coalesce(F.sum(F.length("turn")).over(order), F.lit(0)))
    packed = placed.groupBy("tree", "leaf", "rank", "score").agg(F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("o"), "turn", "start", "head", "body", "loss"))).alias("t"))
    spans = F.transform(F.filter("t", lambda x: F.coalesce(x["loss"], F.lit(False))), lambda x: F.struct((x["start"] + x["head"]).alias("start"), x["body"].cast("long").alias("length")))
    return packed.select("tree", "leaf", "rank", "score", F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("formatted"), spans.alias("loss"))


def read_back(formatted: Column, loss: Column) -> tuple[Column, Column]:
    """(array of (role, text), array of texts under the loss mask), parsed from the output alone."""
    turns = F.slice(F.split(formatted, r"<\|turn\|>"), F.lit(2), F.greatest(F.lit(0), F.size(F.split(formatted, r"<\|turn\|>")) - 1))

    def parsed(x: Column) -> Column:
        role = F.substring_index(x, BODY, 1)
        body = F.substr(x, F.length(role) + len(BODY) + 1, F.length(x) - F.length(role) - len(BODY) - len(END))
        return F.struct(unescaped(role).alias("role"), unescaped(body).alias("text"))

    return F.transform(turns, parsed), F.transform(loss, lambda s: unescaped(F.substr(formatted, s["start"] + 1, s["length"])))


def threads(conversations: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as trees of one branch.

    Rows stand in the order of turn, then role and text, nulls first; repeated
    rows are turns of their own.  Rows with a null conv_id are one conversation.
    """
    order = Window.partitionBy("tree").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("tree"), F.col("turn").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
