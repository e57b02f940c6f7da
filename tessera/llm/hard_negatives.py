"""Hard negatives for anchors, by coordinate pruning over length buckets.

Vectors are integers. Those of one label and of like length form a bucket, which is dealt to blocks of BLOCK vectors. A
block is written once with its index: for each coordinate the list of its vectors' values there, divided by their
lengths and sorted. An anchor with a least score has, against a block, a least cosine: the score over both largest
lengths. Over 1, the block holds nothing for it. Else the angle between anchor and vector is bounded, and so is the
vector's angle to each axis: on each of the anchor's FOCUS coordinates of most weight the lists give one feasible range.
The shortest range is cut down by the others, and the vectors that all contain get their exact scores.

Both searches run twice, first over one block for each anchor, whose k-th best score raises the least score for the
rest. Positives are the best of the same label, negatives the best of other labels within a window under each positive's
score. Only block pairs that the lengths leave make vectors travel.

Defined results: rows with a null label, null id or null vector or with null or non-finite components take no part, nor
do components so large that a score could leave the range of a long; a vector meets only those of its own length in
numbers; rows that repeat an id are rows of their own, as anchors too; ties go to the smaller id; fewer positives or
negatives than asked for give all; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import written

BLOCK, ANCHORS = 4096, 1024
#: Coordinates of an anchor whose ranges are looked up.
FOCUS = 4
#: Vectors whose lengths differ by less than this factor share a bucket.
LENGTHS = 1.1
#: If the shortest range holds more than this share of a block, all its vectors are scored at once.
DENSE = 0.5
#: Tasks that the blocks of one number of dimensions are dealt to.
SALTS = 32
LOW, HIGH = -(1 << 62), 1 << 62
INDEX = "block string, label long, dim int, norm double, rows array<long>, ids array<long>, vectors array<long>, orders array<int>, sorted array<double>"
FOUND = "anchor long, wid int, row long, vec_id long, score long"
_FOUND = pa.schema([("anchor", pa.int64()), ("wid", pa.int32()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _flat(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False)


def indexed(key, table):
    """For applyInArrow by block: its vectors and sorted coordinate lists as one row; a block has BLOCK vectors by expectation."""
    x = _flat(table.column("v")).reshape(table.num_rows, -1)
    norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    unit = x / np.where(norm > 0, norm, 1)[:, None]
    order = np.argsort(unit, axis=0, kind="stable")
    lists = lambda values, kind: pa.array([values], pa.list_(kind))
    columns = [
        pa.array([key[0].as_py()]), table.column("label")[:1], pa.array([x.shape[1]], pa.int32()), pa.array([float(norm.max())]), lists(table.column("row").to_numpy(), pa.int64()),
        lists(table.column("vec_id").to_numpy(), pa.int64()), lists(x.ravel(), pa.int64()), lists(order.T.ravel().astype(np.int32), pa.int32()), lists(np.take_along_axis(unit, order, 0).T.ravel(), pa.float64()),
    ]
    return pa.table(columns, names=[c.split()[0] for c in INDEX.split(", ")])


def feasible(unit: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """On each coordinate the range in which unit vectors with at least this cosine to `unit` lie, rounding included."""
    apart, axis = np.arccos(np.clip(least, -1, 1)), np.arccos(np.clip(unit, -1, 1))
    return np.cos(np.minimum(axis + apart, np.pi)) - 1e-6, np.cos(np.maximum(axis - apart, 0)) + 1e-6


def candidates(unit: np.ndarray, least: float, orders: np.ndarray, lists: np.ndarray) -> np.ndarray | None:
    """Places of the vectors that lie in all feasible ranges; None if these hold most of the block."""
    focus = np.argsort(-np.abs(unit))[:FOCUS]
    low, high = feasible(unit[focus], least)
    spans = [(int(np.searchsorted(lists[f], a, "left")), int(np.searchsorted(lists[f], b, "right"))) for f, a, b in zip(focus, low, high, strict=True)]
    short = min(range(len(focus)), key=lambda i: spans[i][1] - spans[i][0])
    n = lists.shape[1]
    if spans[short][1] - spans[short][0] > DENSE * n:
        return None
    left = np.zeros(n, np.int8)
    for f, (a, b) in zip(focus, spans, strict=True):
        left[orders[f, a:b]] += 1
    inside = orders[focus[short], spans[short][0] : spans[short][1]]
    return inside[left[inside] == len(focus)]


def searcher(k: int, exact: type):
    """A function for a cogrouped applyInArrow: for each anchor and window the k best of a block, ties to smaller ids."""

    def search(anchors, blocks):
        if not anchors.num_rows or not blocks.num_rows:
            return _FOUND.empty_table()
        rows, ids = (blocks.column(c)[0].values.to_numpy() for c in ("rows", "ids"))
        n, most = len(rows), blocks.column("norm")[0].as_py()
        x = blocks.column("vectors")[0].values.to_numpy().reshape(n, -1).astype(exact)
        orders, lists = (blocks.column(c)[0].values.to_numpy().reshape(-1, n) for c in ("orders", "sorted"))
        q = _flat(anchors.column("v")).reshape(anchors.num_rows, -1)
        norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        unit, q = q / np.where(norm > 0, norm, 1)[:, None], q.astype(exact)
        own, windows = anchors.column("row").to_numpy(), anchors.column("windows").to_pylist()
        some, every = [], []
        for i in range(len(q)):
            least = min(w["low"] for w in windows[i])
            reach = norm[i] * most * (1 + 1e-9)
            if least > 0 and least > reach:
                continue
            near = candidates(unit[i], least / reach, orders, lists) if least > 0 and reach > 0 else None
            (every if near is None else some).append((i, near))
        out = []

        def best(i: int, places: np.ndarray, scores: np.ndarray) -> None:
            other = rows[places] != own[i]
            places, scores = places[other], scores[other]
            for w in windows[i]:
                good = np.flatnonzero((scores >= w["low"]) & (scores <= w["high"]))
                if len(good) > k:
                    good = good[scores[good] >= np.partition(scores[good], len(good) - k)[len(good) - k]]
                first = good[np.lexsort((rows[places[good]], ids[places[good]], -scores[good]))][:k]
                out.append((np.full(len(first), own[i]), np.full(len(first), w["wid"]), rows[places[first]], ids[places[first]], scores[first]))

        for i, near in some:
            best(i, near, x[near] @ q[i])
        for lo in range(0, len(every), 256):
            part = [i for i, _ in every[lo : lo + 256]]
            for i, scores in zip(part, q[part] @ x.T, strict=True):
                best(i, np.arange(n), scores)
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0)] * 5
        return pa.table([pa.array(c.astype(f.type.to_pandas_dtype()), f.type) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)

    return search


def mine_negatives(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5, percent: int = 80, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", told: dict | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A negative's score lies between percent of the positive's score and the score itself. told: gets the numbers of
    block pairs of the negatives' search and of those that the lengths leave.
    """
    clean = vectors.withColumns({"_anchor": F.coalesce(is_anchor, F.lit(False)), "_label": label.cast("long")}).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("x"), F.col("_label").alias("label"), F.col("_anchor").alias("anchor"))
    most = F.sqrt(F.lit(2.0**62) / F.greatest(F.size("x"), F.lit(1))) / scale - 1
    clean = clean.where("vec_id is not null and label is not null and x is not null").where(F.size("x") > 0)
    clean = clean.where(F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < most)))
    clean = clean.select("vec_id", "label", "anchor", F.transform("x", lambda e: F.floor(F.lit(float(scale)) * e.cast("double"))).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e))
    clean = clean.withColumns({"row": F.monotonically_increasing_id(), "dim": F.size("v"), "length": F.floor(F.log(F.greatest(norm, F.lit(1.0))) / float(np.log(LENGTHS))), "norm": norm})
    clean = written(clean, "vectors")  # from here on a row keeps its number
    largest = clean.agg(F.max(F.array_max(F.transform("v", F.abs))).alias("m"), F.max("dim").alias("d")).first()
    exact = np.float64 if (largest["m"] or 0) ** 2 * (largest["d"] or 0) < 2**53 else np.int64

    dealt = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), n).cast("string")
    counts = clean.groupBy("label", "dim", "length").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    rows = clean.join(counts, ["label", "dim", "length"]).withColumn("block", F.concat_ws(":", "label", "dim", "length", dealt(F.col("blocks"), 1)))
    index = written(rows.select("row", "vec_id", "label", "v", "block").groupBy("block").applyInArrow(indexed, INDEX), "index")
    blocks = written(index.select("block", "label", "dim", F.col("norm").alias("most")), "blocks")
    counts = clean.where("anchor").groupBy("label", "dim").agg(F.ceil(F.count("*") / ANCHORS).alias("blocks"))
    anchors = clean.where("anchor").join(counts, ["label", "dim"]).withColumn("anchors", F.concat_ws(":", "label", "dim", dealt(F.col("blocks"), 2)))
    anchors = written(anchors.select("row", "vec_id", "label", "dim", "norm", "v", "anchors"), "anchors")

    def met(asked: DataFrame, same: bool) -> DataFrame:
        """Pairs of blocks that the lengths leave: a row for each, not for each pair of vectors."""
        of = asked.groupBy("anchors", "label", "dim").agg(F.max("norm").alias("norm"), F.min(F.array_min("windows.low")).alias("least")).alias("a")
        dealt_out = of.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = blocks.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int")).alias("b")
        meet = (F.col("salt_a") == F.col("b.salt")) & (F.col("a_dim") == F.col("b.dim")) & ((F.col("a_label") == F.col("b.label")) if same else (F.col("a_label") != F.col("b.label")))
        every = dealt_out.select("anchors", F.col("label").alias("a_label"), F.col("dim").alias("a_dim"), "norm", "least", F.col("salt").alias("salt_a")).join(salted, meet)
        left = every.where((F.col("least") <= 0) | (F.col("least") <= F.col("norm") * F.col("most") * (1 + 1e-9)))
        if told is not None and not same:
            told.update(pairs=every.count(), left=left.count())
        return left.select("anchors", "block")

    def searched(asked: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
        left = asked.select("row", "v", "windows", "anchors").join(pairs, "anchors")
        right = index.drop("label", "dim").join(pairs, "block")
        right = right.select(*(F.col(c).alias(c) for c in right.columns))  # columns of its own, apart from those of left
        return left.groupBy("anchors", "block").cogroup(right.groupBy("anchors", "block")).applyInArrow(searcher(k, exact), FOUND)

    def best(asked: DataFrame, same: bool, k: int, name: str) -> DataFrame:
        """The k best of each anchor's windows: one block first, then all others with the raised least scores."""
        asked = written(asked, f"{name}_asked")
        first = written(met(asked, same).groupBy("anchors").agg(F.min_by("block", F.xxhash64("anchors", "block")).alias("block")), f"{name}_home")
        order = Window.partitionBy("anchor", "wid").orderBy(F.desc("score"), "vec_id", "row")
        ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        seeds = written(ranked(searched(asked, first, k)), f"{name}_seeds")
        raised = seeds.where(F.col("rank") == k).select(F.col("anchor").alias("row"), "wid", F.col("score").alias("floor"))
        raised = asked.select("row", F.explode("windows").alias("w")).select("row", "w.*").join(raised, ["row", "wid"], "left")
        raised = raised.groupBy("row").agg(F.collect_list(F.struct("wid", F.greatest("low", F.coalesce("floor", "low")).alias("low"), "high")).alias("windows"))
        again = written(asked.drop("windows").join(raised, "row"), f"{name}_again")
        rest = written(met(again, same).join(first, ["anchors", "block"], "left_anti"), f"{name}_rest")
        return written(ranked(seeds.drop("rank").union(searched(again, rest, k))), name)

    window = lambda wid, low, high: F.struct(wid.cast("int").alias("wid"), low.cast("long").alias("low"), high.cast("long").alias("high"))
    near = best(anchors.withColumn("windows", F.array(window(F.lit(0), F.lit(LOW), F.lit(HIGH)))), True, positives, "positives")
    # percent * score <= 100 * negative, in whole numbers; a negative score has no window.
    low = F.expr(f"div({percent} * score, 100) + if({percent} * score % 100 > 0, 1, 0)")
    windows = near.where("score >= 0").groupBy(F.col("anchor").alias("row")).agg(F.collect_list(window(F.col("rank"), low, F.col("score"))).alias("windows"))
    far = best(anchors.join(windows, "row"), False, negatives, "negatives")
    known = near.select("anchor", F.col("rank").alias("wid"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = far.join(known, ["anchor", "wid"]).join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
