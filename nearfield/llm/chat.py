"""Reply trees to training conversations: root-to-leaf paths, ranked, formatted with a loss mask. DataFrame operations only.

Messages form trees (tree, node, parent). Self-joins double the distance each message looks up its tree, so their number grows with the
logarithm of the depth; each also adds the scores it passes, which gives every branch its score. The best branches of a tree
are then spelled out by the same joins, backwards, so only the messages of chosen branches are ever listed.

Template: "### <role>:\\n<text></turn>\\n" for each turn. In texts and roles \\ < # become \\b \\l \\h, in roles : and line ends \\c and \\n, so no text can hold a control string,
and reading undoes it. Loss spans are code-point positions of assistant texts.

Scale: rows of trees are joined on (tree, node), never gathered; messages that have reached their root leave the iteration; one
formatted conversation is one value. Nulls: a null text or role is empty, a null score 0, a null tree or node is left out; a parent
that is not there makes a root; messages on a cycle have no root and are left out. Repeated (tree, node) rows: one is kept, the
first by role and text. Ties between branches go to the smaller leaf. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.spark import discard, stored

# The template's control strings and the escapes, in the order of escaping.
HEAD, MIDDLE, END = "### ", ":\n", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = ((":", "\\c"), ("\n", "\\n"))
ASSISTANT = "assistant"


def _replaced(text: Column, pairs) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def escape(text: Column) -> Column:
    return _replaced(text, ESCAPES)


def unescape(text: Column) -> Column:
    return _replaced(text, [(b, a) for a, b in reversed(ESCAPES)])


def escape_role(role: Column) -> Column:
    return _replaced(role, (*ESCAPES, *ROLE_ESCAPES))


def unescape_role(role: Column) -> Column:
    return _replaced(role, [(b, a) for a, b in reversed((*ESCAPES, *ROLE_ESCAPES))])


def as_messages(conversations: DataFrame) -> DataFrame:
    """Linear conversations as trees: each turn replies to the one before it. Rows of one turn follow each other by role and text."""
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.where("conv_id IS NOT NULL").withColumn("_at", F.row_number().over(by).cast("long"))
    return rows.select(F.col("conv_id").alias("tree"), F.col("_at").alias("node"), F.when(F.col("_at") > 1, F.col("_at") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def _unique(messages: DataFrame) -> DataFrame:
    rows = messages.where("tree IS NOT NULL AND node IS NOT NULL")
    best = F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))).alias("m")
    return rows.groupBy("tree", "node").agg(best).select("tree", "node", "m.parent", "m.role", "m.text", "m.score")


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, branch, branch_score, depth, role, text): the messages of the best branches of each tree, roots at depth 0.

    A branch's score is the sum of its messages' scores."""
    nodes = stored(_unique(messages))
    links = nodes.select("tree", "node", "parent", "score")
    there = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    state = links.join(there, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("steps"))
    state = stored(state)
    active, done, jumps, span = state.where("up IS NOT NULL"), [state.where("up IS NULL")], [], 1
    most = nodes.count()
    while span <= most and active.limit(1).count():
        jumps.append(active.select("tree", "node", "up"))
        known = reduce(DataFrame.unionByName, done, active).select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("steps").alias("steps2"))
        after = active.join(known, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"), (F.col("steps") + F.col("steps2")).alias("steps"))
        after = stored(after)
        active, span = after.where("up IS NOT NULL"), 2 * span
        done.append(after.where("up IS NULL"))
    rooted = reduce(DataFrame.unionByName, done).select("tree", "node", "total", (F.col("steps") - 1).alias("depth"))
    parents = links.where("parent IS NOT NULL").select("tree", F.col("parent").alias("node")).distinct()
    leaves = rooted.join(parents, ["tree", "node"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "node"))
    chosen = leaves.withColumn("branch", rank).where(F.col("branch") <= branches).select("tree", F.col("node").alias("leaf"), "branch", F.col("total").alias("branch_score"), "node")
    members = stored(chosen)
    for jump in reversed(jumps):
        upward = members.join(jump, ["tree", "node"]).select("tree", "leaf", "branch", "branch_score", F.col("up").alias("node"))
        grown = stored(members.unionByName(upward))
        discard(members)
        members = grown
    return members.join(rooted.select("tree", "node", "depth"), ["tree", "node"]).join(nodes.select("tree", "node", "role", "text"), ["tree", "node"]).select("tree", "leaf", "branch", "branch_score", "depth", "role", "text")


def formatted(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, branch, branch_score, n_turns, formatted, loss): a conversation for each chosen path. loss: [(start, length)] of assistant texts, in code points from 0."""
    rows = paths(messages, branches)
    rows = rows.withColumn("body", escape(F.col("text"))).withColumn("head", F.concat(F.lit(HEAD), escape_role(F.col("role")), F.lit(MIDDLE)))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0)) + F.length("head"))
    span = F.when(F.col("role") == ASSISTANT, F.struct(F.col("at").cast("int").alias("start"), F.length("body").alias("length")))
    turns = rows.groupBy("tree", "leaf", "branch", "branch_score").agg(F.sort_array(F.collect_list(F.struct("depth", "piece", span.alias("span")))).alias("turns"))
    loss = F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull())
    return turns.select("tree", "leaf", "branch", "branch_score", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), loss.alias("loss"))


def read_turns(text: Column) -> Column:
    """[(role, text)] of a formatted conversation."""
    parts = F.split(text, END)
    parts = F.slice(parts, 1, F.size(parts) - 1)
    after = len(HEAD) + 1

    def turn(p):
        role = F.substring_index(F.substr(p, F.lit(after)), MIDDLE, 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substr(p, F.length(role) + after + len(MIDDLE))).alias("text"))

    return F.transform(parts, turn)


def read_loss(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(text, s["start"] + 1, s["length"]))), "")


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the formatted conversations."""
    rows = formatted(as_messages(conversations)).select(F.col("tree").alias("conv_id"), "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("learned"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
