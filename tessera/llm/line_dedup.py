"""Line deduplication through a sharded minimal perfect hash.

One pass counts, for each distinct line hash, the documents that hold it and the largest doc_id among them. The
hashes that reach the threshold are indexed: each shard is a minimal perfect hash (levels of collision-free bits
with ranks) over compact arrays of fingerprints, counts and last documents. A second pass over the documents
probes the arrays; lines are never joined to lines.

The arrays that every task gets hold at most `capacity` hashes, the most frequent ones, so their size has a fixed
bound. Hashes beyond it are rarer than those, so none of them is hot: each of their shards is one row, and the probes
that the arrays of every task can't answer are sorted behind it and stream past it, SALTS tasks to a shard. Where the
whole index fits, that second way has nothing to do; both ways give the same rows. A hash that too few documents hold
is in no shard, so its probe fails the fingerprint: the arrays hold what can be dropped, not every line of the corpus.

Defined results: null or empty text = one empty line; rows with a null doc_id aren't counted and never hold the
copy that stays; rows with equal doc_id count once as a document and are each returned; doc_ids are exact over all of
a long's range; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import ddl, mix, texts, written

BLANK = " \t\n\x0b\x0c\r"
SHARDS = 64
#: Most hashes in the arrays that go to every task (about 25 bytes each).
CAPACITY = 1 << 20
#: Hashes in a shard of the second way, and tasks that a shard's probes are dealt to.
SHARD_HASHES, SALTS = 8192, 8


def line_key(line: str, min_chars: int) -> tuple[int, int] | None:
    """The 128-bit hash of the line's key as two signed longs; None if the key is too short to count."""
    key = line.strip(BLANK)
    if len(key) < min_chars:
        return None
    h = xxhash.xxh3_128_intdigest(key.encode().lower())
    hi, lo = h >> 64, h & 0xFFFFFFFFFFFFFFFF
    return hi - ((hi >> 63) << 64), lo - ((lo >> 63) << 64)


class PerfectHash:
    """Minimal perfect hash of distinct uint64 keys, with a fingerprint, count and last document at each rank."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, counts: np.ndarray, last: np.ndarray):
        self.levels, base = [], 0
        left = keys = self._keys(hi, lo)
        while len(left):
            if len(self.levels) == 64:
                raise ValueError("equal keys")
            size = max(64, -(-2 * len(left) // 64) * 64)
            at = self._at(left, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view(np.uint64)
            ranks = base + np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]))
            self.levels.append((size, words, ranks))
            base += int(alone.sum())
            left = left[~alone[at]]
        rank = self._ranks(keys)
        self.fingerprints, self.counts, self.last = (np.empty(len(keys), np.int64) for _ in range(3))
        self.fingerprints[rank], self.counts[rank], self.last[rank] = lo, counts, last

    @staticmethod
    def _keys(hi, lo):
        return mix(hi.view(np.uint64) ^ mix(lo.view(np.uint64)))

    @staticmethod
    def _at(keys, level, size):
        return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(size)).astype(np.int64)

    def _ranks(self, keys: np.ndarray) -> np.ndarray:
        rank, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, words, ranks) in enumerate(self.levels):
            at = self._at(keys[open_], level, size)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            rank[open_[here]] = (ranks[at >> 6] + below)[here]
            open_ = open_[~here]
        return rank

    def probe(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents that hold it, last document) of each key; what the index doesn't hold fails the fingerprint and counts 0."""
        rank = self._ranks(self._keys(hi, lo))
        known = (rank >= 0) & (self.fingerprints[rank] == lo)
        return np.where(known, self.counts[rank], 0), self.last[rank]


def shard_of(hi: np.ndarray, shards: int = SHARDS) -> np.ndarray:
    return (hi.view(np.uint64) >> np.uint64(7)).astype(np.int64) % shards


def _shard(shards: int):
    return F.expr(f"pmod(shiftrightunsigned(hi, 7), {shards})")


def line_keys(min_chars: int):
    """A function for mapInArrow: (doc_id, text) to (hi, lo, doc_id) of each distinct line key of a row with a doc_id."""

    def emit(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                his, los, ids = [], [], []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if i is None:
                        continue
                    for key in {k for line in text.split("\n") if (k := line_key(line, min_chars))}:
                        his.append(key[0]), los.append(key[1]), ids.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (his, los, ids)], names=["hi", "lo", "doc_id"])

    return emit


def unanswered(index, min_chars: int):
    """A function for mapInArrow: (doc_id, text, row) to the probes (hi, lo, doc_id, row) that the arrays of every task can't answer."""

    def others(batches):
        shards = {k: pickle.loads(blob) for k, blob in index.value.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                his, los, of = [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    for key in {k for line in text.split("\n") if (k := line_key(line, min_chars))}:
                        his.append(key[0]), los.append(key[1]), of.append(i)
                hi, lo, of = (np.array(x, np.int64) for x in (his, los, of))
                rest, shard = np.ones(len(hi), bool), shard_of(hi)
                for s in np.unique(shard):
                    if s in shards:
                        rows = np.flatnonzero(shard == s)
                        rest[rows] = shards[s].probe(hi[rows], lo[rows])[0] == 0
                rows = pa.array(of[rest])
                yield pa.RecordBatch.from_arrays([pa.array(hi[rest]), pa.array(lo[rest]), part.column(0).take(rows), part.column(2).take(rows)], names=["hi", "lo", "doc_id", "row"])

    return others


def judged(min_docs: int):
    """A function for mapInArrow: rows in order of shard, each shard's index before its probes, to the probes whose line goes."""

    def judge(batches):
        shard = index = None
        for batch in batches:
            of, made = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else []
            for a, b in zip(starts, [*starts[1:], len(of)], strict=True):
                if of[a] != shard:
                    shard, index = of[a], None
                while a < b and made[a].is_valid:  # one for each salt that came here
                    index, a = pickle.loads(made[a].as_py()), a + 1
                if index is None or a == b:
                    continue
                part = batch.slice(a, b - a).select(["hi", "lo", "doc_id", "row"])
                n, last = index.probe(*(part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
                goes = pc.fill_null(pc.not_equal(part.column(2), pa.array(last)), True)
                yield part.filter(pc.and_(pa.array(n >= min_docs), goes))

    return judge


def renderer(index, min_chars: int, min_docs: int, routed: bool):
    """A function for mapInArrow: documents (and verdicts from routed shards) to documents without dropped lines."""

    def render(batches):
        shards = {k: pickle.loads(blob) for k, blob in index.value.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = part.column(0).to_pylist()
                lines = [text.split("\n") for text in part.column(1).to_pylist()]
                keys = [[line_key(line, min_chars) for line in doc] for doc in lines]
                flat = [(k, d, n) for d, doc in enumerate(keys) for n, k in enumerate(doc) if k]
                hi, lo = (np.array([k[x] for k, _, _ in flat], np.int64) for x in (0, 1))
                shard, dropped = shard_of(hi), [set() for _ in lines]
                for s in np.unique(shard):
                    if s in shards:
                        rows = np.flatnonzero(shard == s)
                        n, last = shards[s].probe(hi[rows], lo[rows])
                        often = n >= min_docs
                        for r, held_by in zip(rows[often], last[often], strict=True):
                            _, d, n = flat[r]
                            if ids[d] is None or ids[d] != held_by:
                                dropped[d].add(n)
                if routed:
                    for d, found in enumerate(part.column(part.num_columns - 1).to_pylist()):
                        gone = {(x["hi"], x["lo"]) for x in found or ()}
                        dropped[d].update(n for n, k in enumerate(keys[d]) if k in gone)
                kept = ["\n".join(x for n, x in enumerate(doc) if n not in gone) for doc, gone in zip(lines, dropped, strict=True)]
                extra = part.select(part.schema.names[2 : part.num_columns - routed])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.string()), pa.array([len(x) for x in lines], pa.int64()), pa.array([len(x) for x in dropped], pa.int64()), *extra.columns], names=["doc_id", "text", "n_lines", "n_dropped", *extra.schema.names])

    return render


def _built(pdf: pd.DataFrame) -> pd.DataFrame:
    made = PerfectHash(*(pdf[c].to_numpy(np.int64) for c in ("hi", "lo", "n", "last")))
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "index": [pickle.dumps(made)]})


def drop_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), capacity: int = CAPACITY) -> DataFrame:
    """doc_id, text (without the dropped lines), n_lines, n_dropped and the columns named in carry for every row of docs."""
    docs = texts(docs, id_col, text_col, carry)
    spark = docs.sparkSession
    held = docs.select("doc_id", "text").mapInArrow(line_keys(min_chars), "hi long, lo long, doc_id long")
    counted = held.groupBy("hi", "lo").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= min_docs)
    counted = written(counted, "frequent_lines")

    sizes = {r["e"]: r["count"] for r in counted.groupBy(F.floor(F.log2("n")).alias("e")).count().collect()}  # 63 rows at most
    least, room = 0, capacity
    for e in sorted(sizes, reverse=True):
        room -= sizes[e]
        if room < 0:
            least = 2 ** (e + 1)
            break
    build = lambda df, shards: df.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(_built, "shard long, index binary")
    index = {r["shard"]: bytes(r["index"]) for r in build(counted.where(F.col("n") >= least), SHARDS).collect()}  # capacity bounds it
    shared = spark.sparkContext.broadcast(index)

    if least:
        # The text's hash tells rows of a null doc_id apart: equal texts have equal verdicts.
        docs = docs.withColumn("_row", F.xxhash64("text"))
        shards = max(SHARDS, sum(sizes.values()) // SHARD_HASHES)
        probes = docs.select("doc_id", "text", "_row").mapInArrow(unanswered(shared, min_chars), "hi long, lo long, doc_id long, row long")
        probes = probes.select(_shard(shards).cast("long").alias("shard"), F.lit(None).cast("binary").alias("index"), "hi", "lo", "doc_id", "row", F.pmod(F.xxhash64("doc_id", "row", "lo"), F.lit(SALTS)).cast("int").alias("salt"))
        none = [F.lit(None).cast("long").alias(c) for c in ("hi", "lo", "doc_id", "row")]
        entries = build(counted.where(F.col("n") < least), shards).select("shard", "index", *none, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        met = entries.union(probes).repartition("shard", "salt").sortWithinPartitions("shard", F.col("index").isNull())
        verdicts = met.select("shard", "index", "hi", "lo", "doc_id", "row").mapInArrow(judged(min_docs), "hi long, lo long, doc_id long, row long")
        verdicts = verdicts.groupBy(F.col("doc_id").alias("_of"), F.col("row").alias("_of_row")).agg(F.collect_set(F.struct("hi", "lo")).alias("_gone"))
        docs = docs.join(verdicts, F.col("doc_id").eqNullSafe(F.col("_of")) & (F.col("_row") == F.col("_of_row")), "left").select("doc_id", "text", *carry, "_gone")
    return docs.mapInArrow(renderer(shared, min_chars, min_docs, bool(least)), "doc_id long, text string, n_lines long, n_dropped long" + ddl(docs, carry))
