"""A stored index of postings, and lexical search for whole tables of queries that prunes by rarity.

The index holds, for each shard of documents and each word, the documents and places where it occurs. A search reads the
postings of the queries' words only (each word once, however many queries ask for it) and meets them by shard, so no
pair of a query and a document is ever a row of a shuffle before it is among a shard's best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.sources.shared import new_path, written

#: Characters of a shard, by expectation: bounds the longest posting list and what a task holds.
SHARD_CHARS = 8 << 20
#: Folders that words are dealt to, so that a search of few words reads few of them.
BUCKETS = 16
#: Shards of a task of the build, by expectation: what it sorts, and how many shards a file of a bucket has.
TASK_SHARDS = 4
#: Bytes of the queries' words that are sent to every task; more meet the postings by a shuffle.
MOST_BYTES = 32 << 20
#: Queries of a block; each block meets each shard once.
BLOCK = 4096
FOUND = "item_id long, doc_id long, n int, looked_at long"
_FOUND = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("looked_at", pa.int64())])


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def postings(key, table):
    """For applyInArrow by shard: a row for each word of its documents (doc_id, words), with all its places in order."""
    table = table.sort_by("doc_id")
    words, ids = table.column("words").combine_chunks(), table.column("doc_id").to_numpy()
    sizes = np.diff(words.offsets.to_numpy())
    encoded = words.flatten().dictionary_encode()
    codes, doc = encoded.indices.to_numpy(), np.repeat(ids, sizes)
    at = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # Words come by document and place, unless an id is there twice.
    order = np.argsort(codes, kind="stable") if (ids[1:] > ids[:-1]).all() else np.lexsort((at, doc, codes))
    codes, doc, at = codes[order], doc[order], at[order].astype(np.int32)
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.empty(0, np.int64)
    other = np.concatenate(([True], (codes[1:] != codes[:-1]) | (doc[1:] != doc[:-1]))) if len(codes) else np.empty(0, bool)
    cuts = pa.array(np.append(first, len(codes)), pa.int32())
    df = np.add.reduceat(other.astype(np.int32), first) if len(first) else np.empty(0, np.int32)
    columns = [pa.array(np.full(len(first), key[0].as_py(), np.int32)), encoded.dictionary.take(pa.array(codes[first])), pa.array(df, pa.int32()), pa.ListArray.from_arrays(cuts, pa.array(doc)), pa.ListArray.from_arrays(cuts, pa.array(at))]
    return pa.table(columns, names=["shard", "term", "df", "docs", "at"])


def write_index(docs: DataFrame, path: str, shard_chars: int = SHARD_CHARS) -> None:
    """Writes the postings of docs (doc_id, text): shard, term, df, docs and at, by bucket of the term.

    docs holds a document for each occurrence, at its place among the document's words; df counts the shard's documents.
    Each task writes its own shards into all buckets: only texts are shuffled, and no task sorts more for more documents.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    at_once = docs.sparkSession.sparkContext.defaultParallelism
    shards = max(-(-chars // shard_chars), at_once)
    dealt = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")).repartition(max(-(-shards // TASK_SHARDS), at_once), "shard")
    dealt = dealt.sortWithinPartitions("shard")  # as texts, which are smaller than their words
    held = dealt.select("shard", "doc_id", F.coalesce(t.terms(F.col("text")), F.array().cast("array<string>")).alias("words"))
    held = held.groupBy("shard").applyInArrow(postings, "shard int, term string, df int, docs array<long>, at array<int>").withColumn("bucket", _bucket(F.col("term")))
    held.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)


def index_of(docs: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """An index of docs in a new folder."""
    path = new_path(docs.sparkSession, "postings")
    write_index(docs, path, shard_chars)
    return docs.sparkSession.read.parquet(path)


def counted(lists: list[np.ndarray], n: int, k: int | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents (0 to n - 1) with how many of the lists hold them, and how many entries were looked at.

    With k, only those are whole that can be among the k most frequent, ties included: lists go by length, and once the
    k-th best count exceeds the number of lists left no new document is taken up, and those that can't reach it any more
    are dropped before the longest lists are looked at.
    """
    lists = sorted(lists, key=len)
    counts, looked_at = np.zeros(n, np.int32), 0
    left = None
    for j, held in enumerate(lists):
        ahead = len(lists) - j
        if k is not None and n > k and j >= ahead:
            have = counts if left is None else counts[left]
            kth = np.partition(have, len(have) - k)[len(have) - k] if len(have) > k else 0
            if left is not None or kth > ahead:
                left = np.flatnonzero(counts + ahead >= kth) if left is None else left[have + ahead >= kth]
        if left is None or len(held) <= len(left):
            counts[held] += 1
            looked_at += len(held)
        else:
            at = np.minimum(np.searchsorted(held, left), len(held) - 1)
            counts[left[held[at] == left]] += 1
            looked_at += len(left)
    found = np.flatnonzero(counts) if left is None else left[counts[left] > 0]
    return found, counts[found], looked_at


def searcher(k: int | None):
    """A function for a cogrouped applyInArrow by block of queries and shard: postings and queries to the shard's best."""

    def search(postings, queries):
        if not postings.num_rows or not queries.num_rows:
            return _FOUND.empty_table()
        terms = {term: i for i, term in enumerate(postings.column("term").to_pylist())}
        docs, at = (postings.column(c).combine_chunks() for c in ("docs", "at"))
        ids = np.unique(docs.values.to_numpy())
        place = {i: np.searchsorted(ids, docs[i].values.to_numpy()) for i in terms.values()}
        holders: dict[str, np.ndarray] = {}

        def of(term: str) -> np.ndarray:
            """The documents that hold a word, or all words of a phrase side by side."""
            if term not in holders:
                words = term.split(" ")
                if not all(w in terms for w in words):
                    holders[term] = np.empty(0, np.int64)
                elif len(words) == 1:
                    holders[term] = np.unique(place[terms[term]])
                else:
                    spots = None
                    for step, i in enumerate(terms[w] for w in words):
                        now = (place[i] << 32) + at[i].values.to_numpy() - step
                        spots = now if spots is None else np.intersect1d(spots, now, assume_unique=True)
                    holders[term] = np.unique(spots >> 32)
            return holders[term]

        out = []
        for item, wanted in zip(queries.column("item_id").to_pylist(), queries.column("terms").to_pylist(), strict=True):
            lists = [x for x in map(of, dict.fromkeys(wanted)) if len(x)]
            found, n, looked_at = counted(lists, len(ids), k)
            if k is not None and len(found) > k:
                first = np.lexsort((found, -n))[:k]  # ids are in order, so places are too
                found, n = found[first], n[first]
            out.append((np.full(len(found), item), ids[found], n, np.full(len(found), looked_at)))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table([pa.array(c.astype(f.type.to_pandas_dtype()), f.type) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)

    return search


def lexical_matches(queries: DataFrame, index: DataFrame, k: int | None = None) -> DataFrame:
    """item_id, doc_id, n (terms that occur) and looked_at (the shard's entries that the query's search took up).

    With k each shard gives its k best of each query, which hold the k best of all. A term is a word or a phrase of
    several words in search form; terms of a query (item_id, terms) count once.
    """
    queries = queries.where("item_id is not null and size(terms) > 0").select(F.col("item_id").cast("long"), "terms")
    blocks = max(1, -(-queries.count() // BLOCK))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    parts = F.flatten(F.transform("terms", lambda x: F.transform(F.split(x, " "), lambda w: F.struct(w.alias("term"), F.contains(x, F.lit(" ")).alias("beside")))))
    words = queries.select("block", F.inline(parts)).groupBy("block", "term").agg(F.max("beside").alias("beside"))
    words = written(words.withColumn("bucket", _bucket(F.col("term"))), "words")
    size = words.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    buckets = [r[0] for r in words.select("bucket").distinct().collect()]  # BUCKETS at most
    held = index.where(F.col("bucket").isin(buckets)).drop("bucket", "df")
    held = held.join(F.broadcast(words.drop("bucket")) if size <= MOST_BYTES else words.drop("bucket"), "term")
    # Only phrases ask for places; of other words each document goes once.
    docs, at = F.when(F.col("beside"), F.col("docs")).otherwise(F.array_distinct("docs")), F.when(F.col("beside"), F.col("at")).otherwise(F.array().cast("array<int>"))
    held = held.select("block", "shard", "term", docs.alias("docs"), at.alias("at"))
    # A row for each shard, of which there is one for many documents.
    shards = index.select(F.col("shard").alias("of_shard")).distinct()
    asked = queries.select("item_id", "terms", F.col("block").alias("of_block")).join(F.broadcast(shards)).select("item_id", "terms", F.col("of_block").alias("block"), F.col("of_shard").alias("shard"))
    return held.groupBy("block", "shard").cogroup(asked.groupBy("block", "shard")).applyInArrow(searcher(k), FOUND)


def lexical_scores(queries: DataFrame, index: DataFrame) -> DataFrame:
    """item_id, doc_id, score of every pair that shares a term: a tenth for each distinct term of the query that occurs."""
    return lexical_matches(queries, index).select("item_id", "doc_id", F.round(F.col("n") * 0.1, 6).alias("score"))


def best_lexical(queries: DataFrame, index: DataFrame, k: int = 40) -> DataFrame:
    """item_id, doc_id, score, rank of each query's k best documents, ties to smaller doc_id."""
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("n"), "doc_id")).cast("long")
    found = lexical_matches(queries, index, k).withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select("item_id", "doc_id", F.round(F.col("n") * 0.1, 6).alias("score"), "rank")
