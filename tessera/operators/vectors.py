"""Nearest vectors for a table of queries, by matrix products over batches of chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of query vectors that are sent to every task; more are joined with the chunks in blocks.
MOST_BYTES = 64 << 20
BLOCK = 8192
#: Pairs that are compared at once, and so are handed on at once.
PAIRS = 1 << 19
FOUND = "query_id long, vec_id long, similarity double"
_SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("similarity", pa.float64())])


def _by_length(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors for each length; vectors of norm 0 or with nulls have no direction and are left out."""
    sizes = np.array([len(v) for v in vectors.to_pylist()] if vectors.null_count else np.diff(vectors.offsets.to_numpy()), np.int64)
    out = {}
    for n in np.unique(sizes):
        at = pa.array(np.flatnonzero(sizes == n))
        x = vectors.take(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), n)
        with np.errstate(invalid="ignore"):
            square = (x * x).sum(axis=1)
        good = np.isfinite(square) & (square > 0)
        out[int(n)] = ids.take(at).to_numpy(zero_copy_only=False)[good], x[good], square[good]
    return out


def _best(queries: dict, chunks: dict, k: int | None, floor: float | None) -> Iterator[pa.RecordBatch]:
    """Pairs at or above the floor, a batch of PAIRS at most at a time; with k those that can be among a query's k best, ties included."""
    for n, (ids, x, xx) in chunks.items():
        if n not in queries or not len(ids):
            continue
        q_ids, q, qq = queries[n]
        step = max(1, PAIRS // len(ids))
        for a in range(0, len(q_ids), step):
            s = np.round(q[a : a + step] @ x.T / np.sqrt(qq[a : a + step, None] * xx), 6) + 0.0
            keep = np.ones(s.shape, bool) if floor is None else s >= floor
            if k is not None and len(ids) > k:
                keep &= s >= np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k, None]
            i, j = np.nonzero(keep)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (q_ids[a + i], ids[j], s[i, j])], schema=_SCHEMA)


def similarities(queries: DataFrame, chunks: DataFrame, k: int | None = None, floor: float | None = None) -> DataFrame:
    """query_id, vec_id, similarity (cosine, 6 digits) of queries (query_id, query) and chunks (vec_id, embedding) of equal length.

    With k, a task hands on only what can be among a query's k best.
    """
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("query")).where("query_id is not null and query is not null")
    chunks = chunks.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    size = queries.agg(F.sum(F.size("query") * 8 + 16)).first()[0] or 0
    if size <= MOST_BYTES:
        rows = queries.collect()  # MOST_BYTES bounds it
        ids, vectors = pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))
        sent = queries.sparkSession.sparkContext.broadcast(_by_length(ids, vectors))

        def search(batches):
            for batch in batches:
                yield from _best(sent.value, _by_length(batch.column(0), batch.column(1)), k, floor)

        return chunks.mapInArrow(search, FOUND)

    def met(left, right):
        of = lambda t: _by_length(*(t.column(i).combine_chunks() for i in (0, 1)))
        return pa.Table.from_batches(_best(of(left), of(right), k, floor), schema=_SCHEMA)

    many, blocks = -(-size // MOST_BYTES), max(1, chunks.count() // BLOCK)
    left = queries.withColumns({"of": F.pmod(F.xxhash64("query_id"), F.lit(many)), "block": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))})
    right = chunks.withColumns({"of": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long"))), "block": F.pmod(F.xxhash64("vec_id"), F.lit(blocks))})
    return left.groupBy("of", "block").cogroup(right.groupBy("of", "block")).applyInArrow(met, FOUND)


def match_vectors(queries: DataFrame, chunks: DataFrame, k: int = 5, floor: float | None = None, most: int = 20) -> DataFrame:
    """query_id, rank, vec_id, similarity of each query's k nearest chunks at or above floor, k clamped to 1..most, ties to smaller vec_id."""
    k = min(max(k, 1), most)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return similarities(queries, chunks, k, floor).withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)
