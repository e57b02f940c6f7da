"""A stored index for approximate nearest neighbours that takes later vectors without being rebuilt.

Vectors are hashed by random hyperplanes into the buckets of several tables, so that near ones share a bucket in one of
them with high probability. The index is a folder with a commit log. Each commit adds a batch: its vectors with their
buckets, written once. Batches belong to generations; a generation's keys have as many bits as keep BUCKET vectors in a
bucket when it is full, and a full one is followed by one of twice its size, so buckets stay small while there are only as
many generations as the logarithm of the vectors. A search takes its queries to the vectors: a task meets the buckets of a
block of vectors, scores the candidates there exactly and hands on each query's k best only, so no pair is shuffled that
isn't among a block's best.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.registry import query, table
from tessera.sources.shared import new_path, written
from tessera.sources.sinks import unseen
from tessera.sources.versions import CommitLog

#: Vectors that a bucket is to hold, and that the first generation holds at least.
BUCKET, LEAST = 64, 4096
#: Bytes of queries that are sent to every task; more meet the vectors by a shuffle.
MOST_BYTES = 64 << 20
#: Vectors that are hashed at once, and that meet the queries at once.
HASHED, BLOCK = 2048, 8192
#: Pairs of a query and a vector that are told apart at once, and candidates that are scored at once.
PAIRS, SCORED = 1 << 20, 1 << 17
VECTORS = "vec_id long, embedding array<double>"
FOUND = "query_id long, vec_id long, similarity double"
_SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("similarity", pa.float64())])


def _planes(tables: int, bits: int, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, bits)).normal(size=(tables, bits, dim))


def _codes(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """The bucket of each vector in each table."""
    tables, bits, dim = planes.shape
    flat, out = planes.reshape(-1, dim).T, np.empty((len(x), tables), np.int64)
    for a in range(0, len(x), HASHED):
        out[a : a + HASHED] = ((x[a : a + HASHED] @ flat >= 0).reshape(-1, tables, bits).astype(np.int64) << np.arange(bits)).sum(axis=2)
    return out


def _rows(lists: pa.Array, n: int, kind: type) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), n).astype(kind, copy=False)


def _hashed(rows: DataFrame, bits: int, tables: int, dim: int, seed: int) -> DataFrame:
    """vec_id, embedding and codes, the bucket of each table."""

    def hashed(batches):
        planes = _planes(tables, bits, dim, seed)
        for batch in batches:
            codes = _codes(_rows(batch.column(1), dim, np.float64), planes)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * tables, pa.int32()), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["vec_id", "embedding", "codes"])

    return rows.select("vec_id", "embedding").mapInArrow(hashed, f"{VECTORS}, codes array<long>")


def _candidates(buckets: np.ndarray, codes: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of queries and vectors, each pair once, that share a bucket in some table or whose buckets are one bit apart."""
    flips = np.concatenate(([0], 1 << np.arange(bits)))
    order = np.argsort(codes, axis=0, kind="stable")
    held = np.take_along_axis(codes, order, axis=0)
    step = max(1, PAIRS // len(codes))
    for a in range(0, len(buckets), step):
        near = (buckets[a : a + step, :, None] ^ flips).transpose(1, 0, 2)
        met = np.zeros((near.shape[1], len(codes)), bool)
        for of, wanted in enumerate(near):
            first, last = (np.searchsorted(held[:, of], wanted.ravel(), side) for side in ("left", "right"))
            n = last - first
            at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            met[np.repeat(np.arange(len(wanted)).repeat(len(flips)), n), order[at, of]] = True
        i, j = np.nonzero(met)
        yield a + i, j


class _Best:
    """The k best vectors of each query so far, ties to smaller vec_id."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, planes: np.ndarray, k: int) -> None:
        self.ids, self.q, self.bits, self.k = ids, q, planes.shape[1], k
        self.square, self.buckets = (q * q).sum(axis=1), _codes(q, planes)
        self.found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))

    def _top(self, parts: list[tuple]) -> tuple:
        i, j, s = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((j, -s, i))
        i = i[order]
        first = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else np.empty(0, np.int64)
        top = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i)))) < self.k
        return i[top], j[order][top], s[order][top]

    def meet(self, vec_ids: np.ndarray, x: np.ndarray, codes: np.ndarray) -> None:
        square, parts = (x * x).sum(axis=1), [self.found]
        for i, j in _candidates(self.buckets, codes, self.bits) if len(x) else ():
            scores = np.empty(len(i))
            for a in range(0, len(i), SCORED):
                p, v = i[a : a + SCORED], j[a : a + SCORED]
                scores[a : a + SCORED] = np.einsum("nd,nd->n", self.q[p], x[v]) / np.sqrt(self.square[p] * square[v])
            parts.append(self._top([(i, vec_ids[j], np.round(scores, 6) + 0.0)]))
        self.found = self._top(parts)

    def batch(self) -> pa.RecordBatch:
        i, j, s = self.found
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (self.ids[i], j, s)], schema=_SCHEMA)


def _blocks(batches, dim: int, tables: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            part = batch.slice(a, BLOCK)
            yield part.column(0).to_numpy(), _rows(part.column(1), dim, np.float64), _rows(part.column(2), tables, np.int64)


def _directed(vector: str) -> Column:
    """Whether all components are numbers and some isn't 0."""
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)


class VectorIndex:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.log = spark, folder.rstrip("/"), CommitLog(spark, folder)

    @classmethod
    def create(cls, spark: SparkSession, folder: str, dim: int, tables: int = 48, seed: int = 1, least: int = LEAST) -> VectorIndex:
        """An empty index for vectors of one length; an index that is there already is an error."""
        index = cls(spark, folder)
        index.log.append(0, {"dim": dim, "tables": tables, "seed": seed, "least": least}, "none")
        return index

    def _state(self) -> tuple[dict, list[dict]]:
        first, *batches = self.log.log()
        return first, batches

    def _read(self, batches: list[dict], schema: str) -> DataFrame:
        paths = [f"{self.folder}/{b['folder']}/vectors" for b in batches]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def add(self, chunks: DataFrame) -> int:
        """Adds the chunks (vec_id, embedding) whose ids aren't in the index; how many these are.

        Chunks without an id, of another length, of norm 0 or with components that are no numbers are left out; of
        repeated ids one is added. Only the new chunks are hashed, and one commit makes them visible; of two writers one gets
        ConcurrentChange and nothing of its batch stays.
        """
        first, batches = self._state()
        dim = first["dim"]
        new = chunks.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(F.col("vec_id").isNotNull() & (F.size("embedding") == dim))
        new = new.where(_directed("embedding"))
        new = written(unseen(new, self._read(batches, "vec_id long"), ["vec_id"]).dropDuplicates(["vec_id"]), "added")
        n = new.count()
        if not n:
            return 0
        # The last generation takes the batch while it has room; else the next one, of twice its size or as the batch needs.
        last = batches[-1] if batches else None
        held = sum(b["n"] for b in batches if last and b["generation"] == last["generation"])
        if last and held + n <= last["room"]:
            generation, room = last["generation"], last["room"]
        else:
            generation, room = (last["generation"] + 1 if last else 0), max(first["least"], 2 * (last["room"] if last else 0), n)
        bits = min(62, max(1, round(math.log2(max(2, room / BUCKET)))))
        folder = f"batch-{uuid.uuid4().hex}"
        _hashed(new, bits, first["tables"], dim, first["seed"]).write.parquet(f"{self.folder}/{folder}/vectors")
        self.log.append(len(batches) + 1, {"generation": generation, "room": room, "bits": bits, "n": n}, folder)
        return n

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """query_id, vec_id, similarity, rank of each query's k best candidates (query_id, query), ties to smaller vec_id."""
        first, batches = self._state()
        if not batches:
            return self.spark.createDataFrame([], "query_id long, vec_id long, similarity double, rank long")
        dim = first["dim"]
        asked = queries.select(F.col("query_id").cast("long"), F.col("query").cast("array<double>")).where(F.col("query_id").isNotNull() & (F.size("query") == dim)).where(_directed("query"))
        size = asked.count() * 8 * (dim + first["tables"])
        sent = None
        if size <= MOST_BYTES:
            rows = asked.collect()  # MOST_BYTES bounds it
            sent = self.spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64).reshape(len(rows), dim)))
        generations = {b["generation"]: [] for b in batches}
        for b in batches:
            generations[b["generation"]].append(b)
        found = [self._found(asked, self._read(of, f"{VECTORS}, codes array<long>"), of[0]["bits"], first, k, sent, -(-size // MOST_BYTES), sum(b["n"] for b in of)) for of in generations.values()]
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
        return reduce(DataFrame.union, found).withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)

    def _found(self, asked: DataFrame, held: DataFrame, bits: int, first: dict, k: int, sent, many: int, n: int) -> DataFrame:
        """query_id, vec_id, similarity of the k best of each query in each task of a generation's vectors."""
        dim, tables, seed = first["dim"], first["tables"], first["seed"]

        if sent is not None:

            def search(batches):
                best = _Best(*sent.value, _planes(tables, bits, dim, seed), k)
                for block in _blocks(batches, dim, tables):
                    best.meet(*block)
                yield best.batch()

            return held.mapInArrow(search, FOUND)

        def met(left, right):
            q = left.select(["query_id", "query"]).combine_chunks().to_batches()
            best = _Best(q[0].column(0).to_numpy(), _rows(q[0].column(1), dim, np.float64), _planes(tables, bits, dim, seed), k) if q else None
            for block in _blocks(right.select(["vec_id", "embedding", "codes"]).to_batches(), dim, tables) if best else ():
                best.meet(*block)
            return pa.Table.from_batches([best.batch()] if best else [], schema=_SCHEMA)

        blocks = max(1, n // BLOCK)
        left = asked.withColumns({"of": F.pmod(F.xxhash64("query_id"), F.lit(many)), "block": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))})
        right = held.withColumns({"of": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long"))), "block": F.pmod(F.xxhash64("vec_id"), F.lit(blocks))})
        return left.groupBy("of", "block").cogroup(right.groupBy("of", "block")).applyInArrow(met, FOUND)


@query()
def topk_lsh_join(spark, sf):
    """An index of two thirds of the vectors takes the others in two later batches, and is searched."""
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    dim = v.agg(F.max(F.size("embedding"))).first()[0]
    index = VectorIndex.create(spark, new_path(spark, "index"), dim or 0)
    for part in ("vec_id % 3 > 0", "vec_id % 6 = 0", "vec_id % 3 = 0"):  # the last batch repeats ids of the one before
        index.add(v.where(part))
    return index.search(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")))
