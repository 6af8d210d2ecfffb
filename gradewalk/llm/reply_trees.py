"""Chat formatting: trees of replies, their branches ranked by score, each chosen branch one conversation.

Self-joins by pointer doubling tell every message its depth, and the scores and characters above it, in as
many rounds as the depth has bits; chosen leaves unfold along the same pointers to root-to-leaf paths.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewalk.llm.common import cut, literal_table


@dataclass(frozen=True)
class Template:
    """A turn is ``start`` role ``says`` text ``stop``.  ``reserved`` strings mark nothing here but are escaped like the others.

    A control string in a role or text gets a backslash after its first character; one that has backslashes there
    already gets one more, so that unescaping is exact.  No control string may hold a backslash, or a
    first character of any behind its own.
    """

    start: str = "<s>"
    says: str = "[INST]"
    stop: str = "</s>"
    reserved: tuple[str, ...] = ("[/INST]",)

    @property
    def controls(self) -> tuple[str, ...]:
        return self.start, self.says, self.stop, *self.reserved

    def __post_init__(self) -> None:
        heads = {c[:1] for c in self.controls}
        if "" in heads or any(len(c) < 2 or set(c[1:]) & heads or "\\" in c for c in self.controls):
            raise ValueError("control strings need two characters and must not overlap")

    def _after_head(self, what: str) -> str:
        by_head: dict[str, list[str]] = {}
        for c in self.controls:
            by_head.setdefault(c[0], []).append(re.escape(c[1:]))
        return "|".join(rf"(?<={re.escape(h)}){what}(?=\\*(?:{'|'.join(tails)}))" for h, tails in by_head.items())

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._after_head(""), r"\\")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._after_head(r"\\"), "")


def with_positions(rows: DataFrame, tree: str, turn: str, ties: list[str], a_range: int = 1024) -> DataFrame:
    """Adds ``_pos``: a row's place, from 0, among the rows of its tree by ``turn``, then ``ties``; null turns come first.

    Turns are counted in ranges of ``a_range`` numbers, so that a long conversation is many windows; only
    the ranges' counts of a tree meet in one.
    """
    ranged = rows.withColumn("_range", F.floor(F.col(turn) / a_range))
    by_range = Window.partitionBy(tree).orderBy(F.col("_range").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(tree, "_range").count().select(F.col(tree).alias("_t"), F.col("_range").alias("_r"), F.coalesce(F.sum("count").over(by_range), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(tree, "_range").orderBy(F.col(turn).asc_nulls_first(), *ties))
    placed = ranged.withColumn("_within", within - 1).join(counts, (F.col(tree) == F.col("_t")) & F.col("_range").eqNullSafe(F.col("_r")))
    return placed.withColumn("_pos", F.col("_before") + F.col("_within")).drop("_range", "_within", "_t", "_r", "_before")


def as_chains(turns: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as trees without branches: each turn answers the one before.

    Turns of one number follow each other by role, then text; repeated rows are turns of their own.
    """
    keyed = turns.select("conv_id", "turn", "role", "text", tree_key("conv_id").alias("_tree"))
    placed = with_positions(keyed, "_tree", "turn", ["role", "text"])
    parent = F.when(F.col("_pos") > 0, F.col("_pos") - 1)
    return placed.select("conv_id", F.col("_pos").alias("message_id"), parent.alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def tree_key(column: str) -> Column:
    """A tree's id as text that joins can use; null ids are one tree."""
    return F.coalesce(F.concat(F.lit("t"), F.col(column).cast("string")), F.lit("null"))


def linked(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Sums over the way to the root for every message, and the pointer tables of each round.

    ``messages`` has tree, node, up, score and chars.  Returns (tree, node, depth, score, chars), sums that
    include the message itself, and tables (tree, node, up) of the ancestors 1, 2, 4, ... steps above, where there
    are any.  An ``up`` that the tree doesn't have makes its message a root.  Messages that answer each other in
    a circle hang on no root; they are in no sum.
    """
    known = messages.select("tree", F.col("node").alias("up"), F.lit(True).alias("_known"))
    first = cut(messages.join(known, ["tree", "up"], "left").select("tree", "node", F.when(F.col("_known"), F.col("up")).alias("up"), F.lit(1).cast("long").alias("depth"), "score", "chars"))
    settled, pending = first.where("up is null"), first.where("up is not null")
    jumps: list[DataFrame] = []
    left = pending.count()
    while left:
        jumps.append(pending.select("tree", "node", "up"))
        above = settled.union(pending).select("tree", F.col("node").alias("up"), *(F.col(c).alias(f"_{c}") for c in ("up", "depth", "score", "chars")))
        # what has met its root stays as it is; the others, fewer each round, go on
        moved = cut(pending.join(above, ["tree", "up"]).select("tree", "node", F.col("_up").alias("up"), *((F.col(c) + F.col(f"_{c}")).alias(c) for c in ("depth", "score", "chars"))))
        settled, pending = settled.union(moved.where("up is null")), moved.where("up is not null")
        before, left = left, pending.count()
        if left == before:  # only circles are left: as long as a way to a root is, every round ends some
            break
    return settled.drop("up"), jumps


def unfolded(leaves: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """Every message of the paths from the root to ``leaves`` (tree, leaf, depth), as (tree, leaf, node).

    A message stands for up to 2 ** k of its path; a round lets it stand for half of them and adds the message that
    stands for the others.  A leaf comes in at the round that its depth calls for.
    """
    of_depth = lambda low, high: leaves.where((F.col("depth") > low) & (F.col("depth") <= high)).select("tree", "leaf", F.col("leaf").alias("node"))
    rows = of_depth(2 ** len(jumps), 2**62)  # none
    for k, jump in reversed(list(enumerate(jumps))):
        rows = rows.union(of_depth(2**k, 2 ** (k + 1))).join(jump, ["tree", "node"], "left").select("tree", "leaf", F.explode(F.array_compact(F.array("node", "up"))).alias("node"))
    return rows.union(of_depth(0, 1))


def format_trees(messages: DataFrame, best: int = 1, template: Template = Template(), learned: str = "assistant") -> DataFrame:
    """The ``best`` branches of each tree as conversations: conv_id, rank, leaf_id, score, conversation and turns.

    ``messages`` has conv_id, message_id, parent_id (null for roots), role, text and score.  A branch leads from a
    root to a message without replies; branches rank by the mean of their scores (null: 0), then by depth, then by
    the leaf's least id.  ``turns`` has start and stop of each turn in the conversation, in code points, and
    loss_start and loss_stop around the text of turns whose role is ``learned`` (null in others).

    Null roles and texts are empty.  A null conv_id is a tree of its own.  Of rows that share an id in a tree the one of
    the greatest score, then role, then text stays; rows with a null message_id go.  A parent that isn't there
    makes its message a root; circles of replies have no root and give no conversation.  An empty table gives no rows.

    Only ids and sums go through the rounds; texts join once, by message, and meet in one row a conversation.
    """
    made = messages.where("message_id is not null").select(
        tree_key("conv_id").alias("tree"), "conv_id", F.col("message_id").alias("node"), F.col("parent_id").alias("up"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    made = made.withColumn("_n", F.row_number().over(Window.partitionBy("tree", "node").orderBy(F.desc("score"), F.desc("role"), F.desc("text"), F.col("up").asc_nulls_last()))).where("_n = 1")
    head = F.concat(F.lit(template.start), template.escape(F.col("role")), F.lit(template.says))
    made = made.withColumns({"head": head, "body": template.escape(F.col("text"))})
    own = F.col("role") == learned
    stored = cut(made.select(
        "tree", "conv_id", "node", "up", "score", F.concat("head", "body", F.lit(template.stop)).alias("piece"),
        F.when(own, F.length("head")).alias("loss_at"), F.when(own, F.length("body")).alias("loss_chars")))
    sums, jumps = linked(stored.select("tree", "node", "up", "score", F.length("piece").cast("long").alias("chars")))
    answered = stored.where("up is not null").select("tree", F.col("up").alias("node")).distinct()
    branches = sums.join(answered, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), (F.col("score") / F.col("depth")).alias("score"), "depth")
    ranked = branches.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("depth"), "leaf"))).where(F.col("rank") <= best)
    chosen = cut(ranked)
    paths = unfolded(chosen, jumps).join(sums.select("tree", "node", "depth", "chars"), ["tree", "node"]).join(stored.select("tree", "conv_id", "node", "piece", "loss_at", "loss_chars"), ["tree", "node"])
    begin = F.col("chars") - F.length("piece")
    turn = F.struct("depth", "piece", F.struct(begin.alias("start"), F.col("chars").alias("stop"), (begin + F.col("loss_at")).alias("loss_start"), (begin + F.col("loss_at") + F.col("loss_chars")).alias("loss_stop")).alias("turn"))
    whole = paths.groupBy("tree", "conv_id", "leaf").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return whole.join(chosen.select("tree", "leaf", "rank", "score"), ["tree", "leaf"]).select(
        "conv_id", "rank", F.col("leaf").alias("leaf_id"), "score", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("conversation"), F.transform("t", lambda x: x["turn"]).alias("turns"))


def read_back(conversation: Column, turns: Column, template: Template = Template()) -> tuple[Column, Column]:
    """From a formatted conversation: its turns as (role, text), and the unescaped texts under the loss mask."""
    pieces = F.split(conversation, rf"(?<={re.escape(template.stop)})(?=[\s\S])", -1)
    body = lambda x: x.substr(F.lit(len(template.start) + 1), F.length(x) - len(template.start) - len(template.stop))
    role = lambda x: F.substring_index(x, template.says, 1)
    said = F.transform(F.transform(pieces, body), lambda x: F.struct(
        template.unescape(role(x)).alias("role"), template.unescape(x.substr(F.length(role(x)) + len(template.says) + 1, F.length(x))).alias("text")))
    masked = F.zip_with(pieces, turns, lambda p, t: p.substr((t["loss_start"] - t["start"] + 1).cast("int"), (t["loss_stop"] - t["loss_start"]).cast("int")))
    return said, F.transform(F.filter(masked, lambda x: x.isNotNull()), template.unescape)


def chat_report(turns: DataFrame) -> DataFrame:
    """Digests of each conversation as read back from its formatted text, for ``turns`` and conversation -7, whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    extra = literal_table(turns.sparkSession, [(-7, 0, "user", said), (-7, 1, "assistant", said)], ["conv_id", "turn", "role", "text"])
    formatted = format_trees(as_chains(turns.select("conv_id", "turn", "role", "text").union(extra)))
    turns_read, learned = read_back(F.col("conversation"), F.col("turns"))
    back = formatted.select("conv_id", "conversation", turns_read.alias("said"), F.array_join(learned, "").alias("learned"))
    return back.select(
        "conv_id", F.size("said").cast("long").alias("n_turns"), F.sha2(F.array_join(F.transform("said", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("conversation").cast("long").alias("formatted_chars"))
