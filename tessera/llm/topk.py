"""Exact top-k search by inner product with pivot-table elimination.

Vectors are integers. The pivot table is computed once and written: for every vector its distances to PIVOTS pivots, its
norm and its block. Blocks gather vectors with the same nearest pivot and hold BLOCK of them at most; query blocks do
the same with queries. By the triangle inequality the largest gap between the pivot distances of two vectors is a lower
bound of their own distance, and with both norms an upper bound of their score; the gap of two blocks' ranges bounds all
their pairs.

First every query meets one block of its own pivot, so that its k-th best score so far is known. Then pairs of blocks
whose bound is below that score for all queries are dropped before any vector travels. Within a pair the candidates are
cut into strips of like pivot distances, and each query evaluates the strips in the order of their bounds until its
k-th best score is above all that are left, so the result is exact.

Defined results: null vectors and vectors with null or non-finite components take no part, neither as query nor as
candidate, and so do vectors with a component so large that a score could leave the range of a long; a query only meets
vectors of its own length (only the commonest length has pivots, others are bounded by their norms); a null vec_id takes
no part; rows with equal vec_id are one vector (the smallest in order); a query never meets its own vec_id; fewer
candidates than k give all; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import written

BLOCK, QUERY_BLOCK = 8192, 1024
PIVOTS = 16
#: Vectors among which pivots are picked, each as far as possible from those before it.
SAMPLE = 1024
#: Candidates in a strip.
STRIP = 1024
#: Tasks that the ranges of one length's blocks are dealt to.
SALTS = 32
ROW = "vec_id long, v array<long>, dim int, far array<double>, norm double, query boolean, near int"
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
RANGE = "dim int, norm double, low array<double>, high array<double>"


def integers(vector: Column, scale: int = 64) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def pivots_of(sample: list[list[int]]) -> np.ndarray:
    """Vectors of the sample, each the farthest from those picked before."""
    x = np.array(sample, np.float64)
    picked = [0]
    far = np.linalg.norm(x - x[0], axis=1)
    while len(picked) < min(PIVOTS, len(x)) and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(x - x[picked[-1]], axis=1))
    return x[picked]


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = flat.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, len(flat) // rows if rows else 0)


def tabled(pivots: np.ndarray):
    """A function for mapInArrow: (vec_id, v, dim, query) with distances to the pivots, norm and the nearest pivot."""

    def table(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = _matrix(part.column("v"), part.num_rows).astype(np.float64)
                far = np.stack([np.linalg.norm(x - p, axis=1) for p in pivots], axis=1) if len(pivots) and dim == pivots.shape[1] else np.zeros((len(x), 0))
                near = far.argmin(axis=1) if far.shape[1] else np.full(len(x), -1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * far.shape[1], pa.int32()), pa.array(far.ravel()))
                columns = [part.column("vec_id"), part.column("v"), part.column("dim"), lists, pa.array(np.linalg.norm(x, axis=1)), part.column("query"), pa.array(near, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "dim", "far", "norm", "query", "near"])

    return table


def _ranges(key, table):
    """The range of a block's pivot distances and its largest norm; a block has at most BLOCK rows by expectation."""
    far = _matrix(table.column("far"), table.num_rows)
    low, high = (far.min(axis=0), far.max(axis=0)) if far.shape[1] else (far[:0].ravel(), far[:0].ravel())
    return pa.table({"block": [key[0].as_py()], "dim": pa.array([table.column("dim")[0].as_py()], pa.int32()), "norm": [float(max(table.column("norm").to_numpy()))], "low": pa.array([low], pa.list_(pa.float64())), "high": pa.array([high], pa.list_(pa.float64()))})


def searcher(k: int, exact: type):
    """A function for a cogrouped applyInArrow: the k best of a block for each query of a query block that reach its floor.

    exact: the number type in which all products and sums are exact.
    """

    def search(queries, block):
        if not queries.num_rows or not block.num_rows:
            return FOUND.empty_table()
        q_far, x_far = _matrix(queries.column("far"), queries.num_rows), _matrix(block.column("far"), block.num_rows)
        order = np.lexsort((x_far[:, 0], x_far.argmin(axis=1))) if x_far.shape[1] else np.arange(block.num_rows)
        ids, x, x_far = block.column("vec_id").to_numpy()[order], _matrix(block.column("v"), block.num_rows)[order].astype(exact), x_far[order]
        q_ids, q = queries.column("vec_id").to_numpy(), _matrix(queries.column("v"), queries.num_rows).astype(exact)
        q_norm, x_norm = queries.column("norm").to_numpy(), block.column("norm").to_numpy()[order]
        below = lambda x: np.nextafter(x, -np.inf) if exact is np.int64 else x  # noqa: E731  a long may not be a double
        floor = below(queries.column("floor").to_numpy(zero_copy_only=False).astype(np.float64))
        strips = [slice(a, a + STRIP) for a in range(0, len(ids), STRIP)]
        bound = np.stack([bounded(q_norm, x_norm[s].max(), q_far, q_far, x_far[s].min(axis=0), x_far[s].max(axis=0)) for s in strips], axis=1)
        by_bound = np.argsort(-bound, axis=1)
        best = [(np.empty(0, exact), np.empty(0, np.int64)) for _ in q_ids]
        for turn in range(len(strips)):
            now = by_bound[:, turn]
            for s in np.unique(now):
                of = np.flatnonzero(now == s)
                of = of[bound[of, s] >= floor[of]]
                if not len(of):
                    continue
                scores, strip_ids = q[of] @ x[strips[s]].T, ids[strips[s]]
                hit = (scores >= floor[of][:, None]) & (strip_ids != q_ids[of][:, None])
                for row in np.flatnonzero(hit.any(axis=1)):
                    i, good = of[row], hit[row]
                    found_s, found_i = np.concatenate((best[i][0], scores[row][good])), np.concatenate((best[i][1], strip_ids[good]))
                    if len(found_s) > k:
                        least = np.partition(found_s, len(found_s) - k)[len(found_s) - k]
                        found_s, found_i = found_s[found_s >= least], found_i[found_s >= least]
                        first = np.lexsort((found_i, -found_s))[:k]
                        found_s, found_i = found_s[first], found_i[first]
                    best[i] = found_s, found_i
                    if len(found_s) == k:
                        floor[i] = max(floor[i], below(float(found_s.min())))
        sizes = [len(s) for s, _ in best]
        return pa.table([pa.array(np.repeat(q_ids, sizes)), pa.array(np.concatenate([i for _, i in best])), pa.array(np.concatenate([s for s, _ in best]).astype(np.int64))], schema=FOUND)

    return search


def bounded(q_norm, x_norm, q_low, q_high, low, high):
    """An upper bound of the scores between queries and candidates whose pivot distances lie in the given ranges, rounding included."""
    bound = q_norm * x_norm
    if q_low.shape[-1] and q_low.shape[-1] == low.shape[-1]:
        gap = np.maximum(np.maximum(q_low - high, low - q_high), 0).max(axis=-1)
        bound = np.minimum(bound, (q_norm * q_norm + x_norm * x_norm - gap * gap * (1 - 1e-9)) / 2)
    return bound * (1 + np.sign(bound) * 1e-9) + 1e-3


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", told: dict | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best other vectors, ties to smaller vec_id.

    told: gets the numbers of block pairs and of those that the bounds leave.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    most = F.sqrt(F.lit(2.0**62) / F.greatest(F.size("embedding"), F.lit(1))) / scale - 1
    clean = vectors.withColumn("_query", is_query).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), "_query").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    clean = clean.where(F.forall("embedding", lambda x: F.abs(x.cast("double")) < most))
    clean = clean.select("vec_id", integers(F.col("embedding"), scale).alias("v"), F.coalesce("_query", F.lit(False)).alias("query"))
    clean = written(clean.groupBy("vec_id").agg(F.min("v").alias("v"), F.max("query").alias("query")).withColumn("dim", F.size("v")), "vectors")
    spark = clean.sparkSession

    common = clean.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    largest = clean.agg(F.max(F.aggregate("v", F.lit(0).cast("long"), lambda s, x: F.greatest(s, F.abs(x)))).alias("m"), F.max("dim").alias("d")).first()
    size = (largest["m"] or 0) ** 2 * (largest["d"] or 0)
    exact = np.float32 if size < 2**24 else np.float64 if size < 2**53 else np.int64
    sample = clean.where(F.col("dim") == (common["dim"] if common else 0)).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()  # SAMPLE rows
    pivots = pivots_of([r["v"] for r in sample]) if sample and common["dim"] else np.zeros((0, 0))
    rows = clean.mapInArrow(tabled(pivots), ROW)

    # A pivot's vectors are dealt to blocks by hash; there are PIVOTS numbers of blocks, besides those of the lengths.
    rows = written(rows, "pivot_table")
    counts = written(rows.groupBy("dim", "near").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.lit(1)).cast("long").alias("blocks"), F.greatest(F.ceil(F.count_if("query") / QUERY_BLOCK), F.lit(1)).cast("long").alias("query_blocks")), "counts")
    counts = F.broadcast(counts) if counts.count() <= 10_000 else counts
    dealt = lambda n, seed: F.concat_ws(":", "dim", "near", F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(n)).cast("string"))
    rows = rows.join(counts, ["dim", "near"]).withColumns({"block": dealt("blocks", 1), "own": F.concat_ws(":", "dim", "near", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col("query_blocks")).cast("string"))})
    rows = written(rows.select("vec_id", "v", "dim", "far", "norm", "query", "near", "block", "own", "blocks"), "blocks")
    queries = rows.where("query").select(F.col("vec_id"), "v", "far", "norm", "dim", F.col("own").alias("query_block"), F.concat_ws(":", "dim", "near", F.pmod(F.hash("own"), F.col("blocks")).cast("string")).alias("home"))
    candidates = rows.select("vec_id", "v", "far", "norm", "dim", "block")

    def searched(pairs: DataFrame, floors: DataFrame | None) -> DataFrame:
        asked = queries if floors is None else queries.join(floors, "vec_id", "left")
        floor = F.lit(float("-inf")) if floors is None else F.coalesce("floor", F.lit(float("-inf")))
        asked = asked.select("vec_id", "v", "far", "norm", floor.alias("floor"), "query_block").join(pairs, "query_block")
        held = candidates.select("vec_id", "v", "far", "norm", "block").join(pairs, "block")
        held = held.select(*(F.col(c).alias(c) for c in held.columns))  # columns of its own, apart from those of asked
        return asked.groupBy("query_block", "block").cogroup(held.groupBy("query_block", "block")).applyInArrow(searcher(k, exact), "query_id long, vec_id long, score long")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    home = queries.select("query_block", F.col("home").alias("block")).distinct()
    first = written(ranked(searched(home, None)), "first")
    floors = written(first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor")), "floors")

    # Pairs of blocks: a row for each, not for each pair of vectors.
    wide = f"block string, {RANGE}"
    of_blocks = candidates.groupBy("block").applyInArrow(_ranges, wide).alias("b")
    of_queries = queries.withColumnRenamed("query_block", "block").select("block", "dim", "far", "norm").groupBy("block").applyInArrow(_ranges, wide).alias("q")
    least = queries.join(floors, "vec_id", "left").groupBy(F.col("query_block").alias("fb")).agg(F.min(F.coalesce("floor", F.lit(float("-inf")))).alias("least"))
    gaps = F.transform(F.arrays_zip(F.col("q.low").alias("ql"), F.col("q.high").alias("qh"), F.col("b.low").alias("bl"), F.col("b.high").alias("bh")), lambda p: F.greatest(p["ql"] - p["bh"], p["bl"] - p["qh"], F.lit(0.0)))
    gap = F.coalesce(F.array_max(gaps), F.lit(0.0))
    bound = F.least(F.col("q.norm") * F.col("b.norm"), (F.col("q.norm") * F.col("q.norm") + F.col("b.norm") * F.col("b.norm") - gap * gap * (1 - 1e-9)) / 2)
    bound = bound * (1 + F.signum(bound) * 1e-9) + 1e-3
    salted = of_blocks.withColumn("bs", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int"))
    every = of_queries.withColumn("qs", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).join(salted, (F.col("q.dim") == F.col("b.dim")) & (F.col("qs") == F.col("bs"))).select(F.col("q.block").alias("query_block"), F.col("b.block").alias("block"), bound.alias("bound"))
    left = every.join(least, F.col("query_block") == F.col("fb")).where("bound >= least").select("query_block", "block").join(home, ["query_block", "block"], "left_anti")
    left = written(left, "pairs")
    if told is not None:
        told.update(pairs=every.count(), left=left.count() + home.count())
    found = first.select("query_id", "vec_id", "score").union(searched(left, floors))
    return ranked(found).select("query_id", "rank", "vec_id", "score")
