"""Chat formatting over reply trees.

Messages point to the message they answer. Root-to-leaf paths are enumerated by iterative self-joins that double
their reach each round: every message knows its ancestor 2^i steps above, every leaf the path of 2^i steps, so a
thread of n turns takes log2(n) rounds and no row per pair of turns. Branches of a conversation are ranked by the
mean score of their messages, and each chosen path becomes one formatted conversation with its loss mask.

Turns are marked `<s><|role|>\\n` ... `</s>\\n`. A backslash after its first character breaks any control string inside
a text or role, and backslashes are doubled, so that the original comes back by dropping each backslash once.

Defined results: a null text or role is empty; a null score counts 0; a message whose parent is null, missing or
itself starts a conversation of its own; messages on a cycle have no root and are left out; rows that repeat a key
are one message (the smallest in order); an empty table gives an empty result; other columns are ignored. A thread
given as numbered turns (thread_messages) keeps repeated turns, in order of turn, role and text, null turns first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import written

# The control strings of the template.
CONTROL = ["<s>", "</s>", "<|", "|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_BROKEN = r"(<(?=/?s>|\||</?SYS>>)|\|(?=>)|\[(?=/?INST\]))"


def escaped(text: Column) -> Column:
    doubled = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\")
    return F.regexp_replace(doubled, _BROKEN, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def thread_messages(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Numbered turns as messages: conv_id, id, parent (the turn before), role, text, score."""
    rows = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")).cast("long")
    rows = rows.withColumn("id", number)
    return rows.select("conv_id", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame) -> DataFrame:
    """conv_id, leaf, id and up (steps from the leaf) of every message on every root-to-leaf path."""
    nodes = messages.select("conv_id", "id", "parent")
    known = nodes.select(F.col("conv_id").alias("kc"), F.col("id").alias("ki"))
    step = nodes.where(F.col("parent").isNotNull() & (F.col("parent") != F.col("id")))
    step = step.join(known, F.col("conv_id").eqNullSafe(F.col("kc")) & (F.col("parent") == F.col("ki")), "left_semi").select("conv_id", "id", F.col("parent").alias("to"))
    step = written(step, "steps")
    answered = step.select(F.col("conv_id").alias("kc"), F.col("to").alias("ki")).distinct()
    reach = nodes.join(answered, F.col("conv_id").eqNullSafe(F.col("kc")) & (F.col("id") == F.col("ki")), "left_anti").select("conv_id", F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("up"))
    first = step
    largest = nodes.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 1
    for i in range(largest.bit_length() + 1):  # what is left then goes round in a cycle
        if step.isEmpty():
            break
        jump = step.select(F.col("conv_id").alias("jc"), F.col("id").alias("ji"), "to")
        further = reach.join(jump, F.col("conv_id").eqNullSafe(F.col("jc")) & (F.col("id") == F.col("ji"))).select("conv_id", "leaf", F.col("to").alias("id"), (F.col("up") + 2**i).alias("up"))
        reach = written(reach.union(further), "reach")
        again = step.join(jump.select("jc", "ji", F.col("to").alias("far")), F.col("conv_id").eqNullSafe(F.col("jc")) & (F.col("to") == F.col("ji")))
        step = written(again.where(F.col("far") != F.col("id")).select("conv_id", "id", F.col("far").alias("to")), "steps")
    roots = nodes.join(first.select(F.col("conv_id").alias("kc"), F.col("id").alias("ki")).distinct(), F.col("conv_id").eqNullSafe(F.col("kc")) & (F.col("id") == F.col("ki")), "left_anti").select(F.col("conv_id").alias("rc"), F.col("id").alias("ri"))
    rooted = reach.join(roots, F.col("conv_id").eqNullSafe(F.col("rc")) & (F.col("id") == F.col("ri")), "left_semi").select(F.col("conv_id").alias("rc"), F.col("leaf").alias("rl")).distinct()
    return reach.join(rooted, F.col("conv_id").eqNullSafe(F.col("rc")) & (F.col("leaf") == F.col("rl")), "left_semi")


def format_trees(messages: DataFrame, branches: int | None = None, trained: str = "assistant") -> DataFrame:
    """One row for each chosen path: conv_id, leaf, branch (1 is best), score, n_turns, formatted, mask.

    messages: conv_id, id, parent, role, text, score. branches: most paths of each conversation; all if None.
    mask: start and end (exclusive, in code points) of each text of the trained role within formatted.
    """
    kept = messages.groupBy("conv_id", "id").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m")).select("conv_id", "id", "m.*")
    kept = written(kept, "messages")
    of = kept.select(F.col("conv_id").alias("mc"), F.col("id").alias("mi"), "role", "text", F.coalesce("score", F.lit(0.0)).alias("score"))
    turns = paths(kept).join(of, F.col("conv_id").eqNullSafe(F.col("mc")) & (F.col("id") == F.col("mi")))
    head = F.concat(F.lit("<s><|"), escaped(F.col("role")), F.lit("|>\n"))
    body = escaped(F.col("text"))
    turns = turns.select("conv_id", "leaf", "up", "score", (F.coalesce("role", F.lit("")) == trained).alias("trained"), F.length(head).alias("head"), F.length(body).alias("body"), F.concat(head, body, F.lit("</s>\n")).alias("piece"))
    upto = Window.partitionBy("conv_id", "leaf").orderBy(F.desc("up"))
    turns = turns.withColumn("end", F.sum(F.length("piece")).over(upto))
    start = F.col("end") - F.length("piece") + F.col("head")
    turn = F.struct((-F.col("up")).alias("at"), "piece", "trained", start.alias("start"), (start + F.col("body")).alias("end"))
    joined = turns.groupBy("conv_id", "leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.round(F.avg("score"), 9).alias("score"))
    mask = F.transform(F.filter("turns", lambda t: t["trained"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    out = joined.select("conv_id", "leaf", "score", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), mask.alias("mask"))
    branch = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "leaf"))
    out = out.withColumn("branch", branch)
    return out if branches is None else out.where(F.col("branch") <= branches)


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    pieces = F.filter(F.split(formatted, "</s>\n"), lambda p: p != "")
    part = lambda p, i: unescaped(F.regexp_extract(p, r"(?s)^<s><\|(.*?)\|>\n(.*)$", i))
    return F.transform(pieces, lambda p: F.struct(part(p, 1).alias("role"), part(p, 2).alias("text")))


def masked(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(mask, lambda m: unescaped(F.substr(formatted, m["start"] + 1, m["end"] - m["start"]))), "")
