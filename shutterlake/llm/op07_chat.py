"""Chat formatting over reply trees.

Messages form trees by (conv, node, parent). Iterative self-joins double their
reach each round: after round i every node knows its ancestor 2^i steps up and
the score of the steps between, so roots, depths and branch scores take
O(log depth) joins. Leaves are ranked within their tree by branch score, and
the same ancestor tables unroll the chosen leaves into root-to-leaf paths, one
conversation each.

Template: each turn is ``<s>[INST] role [/INST]text</s>``. In roles and texts a
backslash is doubled and each control string gets a backslash after its first
character, so no control string is left in them and reading back is exact. The
loss mask covers what stands between ``[/INST]`` and ``</s>`` of assistant turns.

Defined cases: null text and role are empty; null conv_id is a conversation of
its own; null turns come first and rows of one turn go by role and text, so
repeated rows are turns of their own; an empty table gives the added
conversation alone; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Control strings, and what may follow the first character of one.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
_ESCAPE = r"(\\|<(?=/?s>)|\[(?=/?INST\]))"
LEARNT = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)([\\<\[])\\", "$1")


def branch_paths(nodes: DataFrame, best: int = 1) -> DataFrame:
    """conv, leaf, rank, node, depth: the nodes of the ``best`` branches of each tree.

    nodes: conv, node (unique), parent (null at a root), score. Ties go to the
    larger leaf. Depth counts from 1 at the root. Parents that form a cycle, a
    message that is its own parent among them, are an error.
    """
    jumps = [materialize(nodes.filter("parent is not null").select("node", F.col("parent").alias("up"), F.col("score").cast("double").alias("gain")), "chat-jump")]
    messages = jumps[0].count()
    while jumps[-1].limit(1).count():
        if 2 ** (len(jumps) - 1) > messages:  # no path without a cycle is so long
            raise ValueError("parents form a cycle")
        near, far = jumps[-1], jumps[-1].select(F.col("node").alias("up"), F.col("up").alias("top"), F.col("gain").alias("more"))
        jumps.append(materialize(near.join(far, "up").select("node", F.col("top").alias("up"), (F.col("gain") + F.col("more")).alias("gain")), "chat-jump"))
    parents = nodes.select(F.col("parent").alias("node")).filter("node is not null").distinct()
    at = nodes.join(parents, "node", "left_anti").select("conv", F.col("node").alias("leaf"), F.col("node").alias("top"), F.lit(1).alias("depth"), F.lit(0.0).alias("total"))
    # from the longest jump down, each leaf climbs to its root once
    for i in reversed(range(len(jumps) - 1)):
        up = jumps[i].select(F.col("node").alias("top"), "up", "gain")
        at = at.join(up, "top", "left").select("conv", "leaf", F.coalesce("up", "top").alias("top"), (F.col("depth") + F.when(F.col("up").isNotNull(), 2**i).otherwise(0)).alias("depth"), (F.col("total") + F.coalesce("gain", F.lit(0.0))).alias("total"))
    at = at.join(nodes.select(F.col("node").alias("top"), F.col("score").cast("double").alias("first")), "top").withColumn("total", F.col("total") + F.col("first"))
    rank = F.row_number().over(Window.partitionBy("top").orderBy(F.desc("total"), F.desc("leaf")))
    chosen = at.withColumn("rank", rank).filter(F.col("rank") <= best)
    chosen = materialize(chosen.select("conv", "leaf", "rank", F.col("leaf").alias("node"), "depth"), "chat-leaves")
    # nodes at distances 0 .. 2^i - 1 from the leaf become those at 0 .. 2^(i+1) - 1
    for i, jump in enumerate(jumps[:-1]):
        higher = chosen.join(jump.select("node", "up"), "node").select("conv", "leaf", "rank", F.col("up").alias("node"), (F.col("depth") - 2**i).alias("depth"))
        chosen = materialize(chosen.unionByName(higher), "chat-paths")
    return chosen


def linear_nodes(messages: DataFrame) -> DataFrame:
    """conv, node, parent, score, role, text from rows conv_id, turn, role, text: each turn replies to the one before."""
    rows = messages.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = materialize(rows.withColumn("node", F.monotonically_increasing_id()), "chat-messages")
    before = F.lag("node").over(Window.partitionBy("conv").orderBy("turn", "role", "text", "node"))
    return materialize(rows.withColumns({"parent": before, "score": F.lit(0.0)}).drop("turn"), "chat-nodes")


def formatted(nodes: DataFrame, best: int = 1) -> DataFrame:
    """conv, leaf, rank, formatted, mask: one row a branch; mask holds (start, size) of the learnt parts in code points."""
    turns = branch_paths(nodes.select("conv", "node", "parent", "score"), best).join(nodes.select("node", "role", "text"), "node")
    turns = turns.withColumn("head", F.concat(F.lit("<s>[INST] "), escaped(F.col("role")), F.lit(" [/INST]"))).withColumn("body", escaped(F.col("text")))
    before = Window.partitionBy("leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("head") + F.length("body") + 4).over(before), F.lit(0)) + F.length("head")
    learnt = F.when(F.col("role") == LEARNT, F.struct(start.alias("start"), F.length("body").alias("size")))
    turns = turns.withColumn("turn", F.struct("depth", F.concat("head", "body", F.lit("</s>")).alias("all"), learnt.alias("learnt")))
    out = turns.groupBy("leaf").agg(F.first("conv").alias("conv"), F.first("rank").alias("rank"), F.sort_array(F.collect_list("turn")).alias("turns"))
    mask = F.filter(F.transform("turns", lambda t: t["learnt"]), lambda m: m.isNotNull())
    return out.select("conv", "leaf", "rank", F.array_join(F.transform("turns", lambda t: t["all"]), "").alias("formatted"), mask.alias("mask"))


def read_back(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, digests and lengths, recovered from the formatted string and its mask alone."""
    turn = r"(?s)^<s>\[INST\] (.*?) \[/INST\](.*)$"
    pieces = F.filter(F.split("formatted", "</s>"), lambda x: x != "")

    def said(x: Column) -> Column:
        parts = [unescaped(F.regexp_extract(x, turn, g)) for g in (1, 2)]
        return F.concat(parts[0], F.lit("\n"), parts[1], F.lit("\n"))

    loss = F.array_join(F.transform("mask", lambda m: unescaped(F.col("formatted").substr(m["start"].cast("int") + 1, m["size"]))), "")
    out = conversations.withColumns({"pieces": pieces, "loss": loss})
    return out.select(
        F.col("conv").alias("conv_id"),
        F.size("pieces").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("pieces", said), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def all_conversations(messages: DataFrame) -> DataFrame:
    """Every conversation of a table conv_id, turn, role, text, and conversation -1, which says control strings."""
    said = F.lit("</s>[INST] ok [/INST]")
    role = F.when(F.col("id") == 0, "user").otherwise(LEARNT)
    added = messages.sparkSession.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), said.alias("text"))
    return read_back(formatted(linear_nodes(messages.select("conv_id", "turn", "role", "text").unionByName(added))))


SQL = r"""
WITH m AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, LENGTH(role) + LENGTH(text) + LEN(REGEXP_EXTRACT_ALL(role, p)) + LEN(REGEXP_EXTRACT_ALL(text, p)) AS chars
  FROM m, (SELECT '(\\|</?s>|\[/?INST\])' AS p))
SELECT conv_id, COUNT(*)::BIGINT AS n_turns,
  SHA256(STRING_AGG(role || CHR(10) || text || CHR(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  COALESCE(SUM(LENGTH(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  SHA256(COALESCE(STRING_AGG(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  SUM(chars + LENGTH('<s>[INST]  [/INST]</s>'))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
