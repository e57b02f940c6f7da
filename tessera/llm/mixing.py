"""Mixing sources to target weights by temperature.

Each source's share of the tokens is raised to one exponent and normalised. The exponent is the largest in [0, 1]
(closest to the natural mixture) whose weights reach the target entropy and, unlike the shares, no weight asks for
more than `max_repeats` passes over a source; where both can't hold the repetition limit decides. It is found by
bisection in many parts at once: each round evaluates a grid of exponents in one aggregation over the sources.

The weights are realised on a token budget. Documents are dealt by hash into blocks of bounded size; each epoch of a
source takes its blocks in another permutation, whole epochs first, then blocks until the source's budget is spent,
the last of them up to a document. Only block totals are permuted and summed, so no source is ever sorted as a
whole, and documents aren't shuffled: the table of blocks, whose size has a fixed bound, goes to them.

Defined results: null or empty texts have no tokens and are in no epoch; a null source is a source of its own; rows
with equal doc_id fall into the same block, and the order among rows equal in doc_id and token count is one; a null
doc_id is a value like any other; an empty table gives an empty result; other columns are carried only if asked for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import written

#: Blocks in all, besides one for each source: bounds the table that goes to every task.
MOST_BLOCKS = 20_000
LEAST_BLOCK = 50_000
GRID, ROUNDS = 32, 5
#: More sources than this, and they meet their documents by a shuffle, each dealt to SALTS tasks.
MOST_SOURCES = 200_000
SALTS = 32  # order's low five bits; the others choose the block


def hashed(*parts: Column) -> Column:
    """60 bits of an MD5 as a long: the same in any engine."""
    joined = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts))
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def exponent(totals: DataFrame, entropy: float, max_repeats: float, budget: float) -> float:
    """The largest exponent in [0, 1] that the targets allow (see above); totals: source, tokens."""
    whole, n = totals.agg(F.sum("tokens"), F.count("*")).first()
    if not n or n == 1:
        return 1.0
    shares = totals.select((F.col("tokens") / F.lit(float(whole))).alias("p"))
    wanted = entropy * math.log(n)

    def tried(low: float, high: float) -> list:
        grid = F.explode(F.array(*(F.lit(low + (high - low) * i / GRID) for i in range(GRID + 1)))).alias("a")
        x = shares.select("p", grid).select("a", F.col("p"), F.pow("p", "a").alias("q")).groupBy("a").agg(F.sum("q").alias("z"), F.sum(F.col("q") * F.log("q")).alias("s"), F.max(F.col("q") / F.col("p")).alias("r"))
        # entropy of q/z, and passes over the source that is asked for most
        return x.select("a", (F.log("z") - F.col("s") / F.col("z")).alias("h"), (F.col("r") / F.col("z") * budget / float(whole)).alias("passes")).orderBy("a").collect()  # GRID + 1 rows

    def bisected(good) -> float:
        """The largest a for which good holds, if it holds up to some a; 0 if never."""
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            rows = tried(low, high)
            if good(rows[-1]):
                return high
            last = max((i for i, r in enumerate(rows) if good(r)), default=None)
            if last is None:
                return low
            low, high = rows[last]["a"], rows[last + 1]["a"]
        return low

    flat = bisected(lambda r: r["h"] >= wanted - 1e-9)
    rows = tried(flat, 1.0)
    if rows[0]["passes"] <= max_repeats:
        return flat
    low, high = flat, 1.0  # passes fall as the exponent rises: the least that keeps the limit
    for _ in range(ROUNDS):
        rows = tried(low, high)
        i = next((i for i, r in enumerate(rows) if r["passes"] <= max_repeats), len(rows) - 1)
        if i == 0:
            return low
        low, high = rows[i - 1]["a"], rows[i]["a"]
    return high


def mixed(docs: DataFrame, entropy: float = 0.95, max_repeats: float = 4.0, budget: float | None = None, seed: int = 1, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each document and epoch it is drawn in: doc_id, source, n_tokens, epoch, block, block_rank, weight.

    entropy: target for the weights' entropy as a share of its maximum. budget: tokens of the mixture; as many as
    there are if None. block_rank orders the blocks of one epoch of a source.
    """
    tokens = F.size(F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[ \t-\r]+"), "")).cast("long")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), tokens.alias("n_tokens"), *carry)
    base = docs.select("doc_id", "source", "n_tokens", hashed(F.lit(seed), F.col("doc_id")).alias("order")).where("n_tokens > 0")

    totals = written(base.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "sources")
    whole, n_sources = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    budget = float(whole) if budget is None else float(budget)
    alpha = exponent(totals, entropy, max_repeats, budget)
    block = max(LEAST_BLOCK, math.ceil(whole / MOST_BLOCKS))
    z = totals.agg(F.sum(F.pow(F.col("tokens") / F.lit(float(whole or 1)), F.lit(alpha)))).first()[0] or 1.0
    weight = F.pow(F.col("tokens") / F.lit(float(whole or 1)), F.lit(alpha)) / F.lit(z)
    goal = F.least(F.floor(weight * F.lit(budget)), F.floor(F.col("tokens") * F.lit(float(max_repeats)))).cast("long")
    plan = totals.select(F.col("source").alias("of"), "tokens", weight.alias("weight"), goal.alias("goal"), F.ceil(F.col("tokens") / F.lit(block)).cast("long").alias("blocks"))
    plan = plan.withColumns({"epochs": F.floor(F.col("goal") / F.col("tokens")).cast("long"), "rest": F.col("goal") % F.col("tokens")})

    small = n_sources <= MOST_SOURCES
    sent = F.broadcast if small else (lambda df: df)

    def of_source(rows: DataFrame, table: DataFrame, name: str) -> DataFrame:
        """rows with their source's row of table; a source's rows are dealt to SALTS tasks where the table isn't sent to all."""
        same = F.col("source").eqNullSafe(F.col(name))
        if small:
            return rows.join(F.broadcast(table), same)
        salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return rows.join(salted, same & (F.pmod("order", F.lit(SALTS)) == F.col("salt"))).drop("salt")

    dealt = of_source(base, plan, "of").withColumn("block", F.shiftright("order", 5) % F.col("blocks"))
    blocks = dealt.groupBy("of", "block").agg(F.sum("n_tokens").alias("held"), F.first("epochs").alias("epochs"), F.first("rest").alias("rest"), F.first("weight").alias("weight"), F.first("blocks").alias("blocks"))
    rank = lambda epoch: F.row_number().over(Window.partitionBy("of", epoch).orderBy(hashed(F.lit(seed), F.col("of"), epoch, F.col("block")), "block")).cast("long")
    # Each block once for every epoch; the last epoch is the partial one.
    turns = blocks.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs"))).alias("epoch"))
    turns = turns.withColumn("block_rank", rank(F.col("epoch")))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("of", "epoch").orderBy("block_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = turns.withColumn("room", F.when(F.col("epoch") < F.col("epochs"), F.col("held")).otherwise(F.col("rest") - before)).where("room > 0")
    turns = written(turns.select("of", "block", "epoch", "block_rank", "held", "room", "weight", "blocks"), "turns")

    # The one block of a source that is spent within: documents in hash order as far as the room goes.
    cut = turns.where("room < held").select(F.col("of").alias("o"), F.col("block").alias("b"), "room")
    inner = dealt.join(sent(cut), F.col("of").eqNullSafe(F.col("o")) & (F.col("block") == F.col("b")))
    within = inner.withColumn("sum", F.sum("n_tokens").over(Window.partitionBy("o", "b").orderBy("order")))
    edge = within.where(F.col("sum") <= F.col("room")).groupBy("o", "b").agg(F.max("order").alias("last"))

    turns = turns.join(edge, F.col("of").eqNullSafe(F.col("o")) & (F.col("block") == F.col("b")), "left")
    last = F.when(F.col("room") < F.col("held"), F.coalesce("last", F.lit(-1)))
    per_block = turns.groupBy("of", "block").agg(F.collect_list(F.struct("epoch", "block_rank", last.alias("last"))).alias("turns"), F.first("weight").alias("weight"))
    per_block = per_block.withColumnRenamed("block", "of_block")
    counts = plan.select(F.col("of").alias("of_source"), "blocks")
    ordered = of_source(docs.where("n_tokens > 0").withColumn("order", hashed(F.lit(seed), F.col("doc_id"))), counts, "of_source")
    ordered = ordered.withColumn("block", F.shiftright("order", 5) % F.col("blocks"))
    drawn = ordered.join(sent(per_block), F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("of_block")))
    drawn = drawn.select("doc_id", "source", "n_tokens", "order", "block", "weight", *carry, F.explode(F.filter("turns", lambda t: t["last"].isNull() | (F.col("order") <= t["last"]))).alias("t"))
    return drawn.select("doc_id", "source", "n_tokens", F.col("t.epoch").alias("epoch"), "block", F.col("t.block_rank").alias("block_rank"), "weight", *carry)
