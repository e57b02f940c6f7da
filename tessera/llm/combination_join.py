"""Jaccard join over word n-grams by token-combination prefixes.

A document's tokens are its distinct word shingles. Two sets of sizes n >= m that are similar enough share at least
ceil(p * (n + m) / (100 + p)) tokens. In one global order, rarest tokens first, each set is cut to a prefix: if the
prefixes of two sets had nothing in common that is looked for, too few tokens could be shared behind them. What is
looked for depends on a token's class. Rare tokens are keys of their own. Frequent tokens are keys only in combinations
of two or three of one subclass, for which the prefix is extended by as many tokens as can be shared without making a
combination. Sets meet by size bins, so that each bin has its own overlap, subclasses and prefix lengths.

Before that, sets that can't link are put aside. A token that only one document holds is in no intersection, and a set
may miss (100 - p) percent of its tokens at most. So the tokens below a share of the hash range are counted over all
documents; a document with too many exclusive ones among them alone links with nothing. They travel packed, sorted by
hash in slices of many documents, and only counts come back.

Buckets are never paired in full: each is a star around its member with the fewest exclusive tokens, stars that hold
give components, and only members of different components that still share a bucket are compared. A bitmap of parities
of each set rules pairs out with certainty before they become rows: the bits in which two differ and the exclusive tokens
of both are no more than their symmetric difference. Equal sets are one set from the start. Links are confirmed on the
full sets of 64-bit token hashes.

Defined results: null text = empty text; a text without words has the empty set and links with nothing; a null doc_id
links with nothing (component_id null); rows that repeat a doc_id are documents of their own, returned each with the
class of its own text; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import mix, shingle_sets, texts, written
from tessera.llm.near_dedup import SKETCH_WORDS, components, parities

#: The share of the hash range whose tokens are counted before all others, in 1/256.
COUNTED = 77
#: Tokens of a slice, and of a range of hashes, that a task holds at a time.
SLICE, RANGE = 1 << 21, 1 << 21
#: Tokens in more documents than this count as frequent and are combined, by two and by three.
FREQUENT = ((64, 2), (4096, 3))
#: Stands for the document of a token that several of a slice hold.
SEVERAL = np.uint32(0xFFFFFFFF)
#: Bytes of set keys that are sent to every task; more are joined by a shuffle.
MOST_BYTES = 64 << 20
#: Each size bin is at most this much wider than its smallest size, in percent.
BIN = 8


def _bins() -> np.ndarray:
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, edges[-1] * (100 + BIN) // 100))
    return np.array(edges, np.int64)


EDGES = _bins()


def set_key(s: np.ndarray) -> int:
    """What equal sets have in common and different ones, but for chance, have not."""
    both = np.array([mix(s).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s + np.uint64(1))), len(s)], np.uint64)
    return int(mix(mix(mix(both[:1]) + both[1:2]) + both[2:]).view(np.int64)[0])


def _packed(values: np.ndarray) -> bytes:
    """Byte by byte, all first bytes first, so that sorted values compress."""
    return pa.compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = pa.decompress(data, n * size, codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(size, n).T.copy().view(kind).ravel()


SLICES = "doc_id long, n long, key long, slice long, at int, part int, count int, tokens binary, owners binary"
_NAMES = [x.split()[0] for x in SLICES.split(", ")]


def slicer(width: int, parts: int, least: int):
    """A function for mapInArrow: (doc_id, text) to a row for each document, and rows of packed tokens for each range of hashes.

    A slice's distinct tokens below the counted share are sorted; beside each stands the place of its document in the
    slice, or SEVERAL. So a token is sent once by each slice, however many documents hold it.
    """
    limit = np.uint64(COUNTED << 56)

    def sliced(batches):
        number, held, size, docs = TaskContext.get().partitionId() << 32, [], 0, []

        def told():
            tokens = np.concatenate(held) if held else np.empty(0, np.uint64)
            owners = np.repeat(np.arange(len(held), dtype=np.uint32), [len(x) for x in held])
            order = np.argsort(tokens)
            tokens, owners = tokens[order], owners[order]
            new = np.concatenate(([True], tokens[1:] != tokens[:-1]))[: len(tokens)]
            owners[np.concatenate((~new[1:], [False]))[: len(tokens)]] = SEVERAL
            tokens, owners = tokens[new], owners[new]
            cuts = np.searchsorted(tokens, np.array([p * (COUNTED << 56) // parts for p in range(parts + 1)], np.uint64))
            rows = [(d, n, k, number, i, None, None, None, None) for i, (d, n, k) in enumerate(docs)]
            rows += [(None, None, None, number, None, p, int(b - a), _packed(tokens[a:b]), _packed(owners[a:b])) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            return pa.RecordBatch.from_pylist([dict(zip(_NAMES, r, strict=True)) for r in rows], schema=_schema())

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, s in enumerate(shingle_sets(batch.column(1).cast(pa.binary()).to_pylist(), width)):
                docs.append((ids[i], len(s), set_key(s) if len(s) else None))
                held.append(s[: np.searchsorted(s, limit)] if ids[i] is not None and len(s) >= least else s[:0])
                size += len(held[-1]) + 16
                if size >= SLICE:
                    yield told()
                    number, held, size, docs = number + 1, [], 0, []
        if docs:
            yield told()

    return sliced


def _schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in SLICES.split(", ")])


def exclusive(table):
    """For applyInArrow by range of hashes: how many of its tokens each document alone holds, packed by slice."""
    counts = table.column("count").to_pylist()
    rows = list(zip(table.column("slice").to_pylist(), counts, table.column("tokens").to_pylist(), table.column("owners").to_pylist(), strict=True))
    tokens, owners = (np.concatenate([_unpacked(r[i], r[1], kind) for r in rows]) for i, kind in ((2, np.uint64), (3, np.uint32)))
    order = np.argsort(tokens, kind="stable")
    tokens = tokens[order]
    new = np.concatenate(([True], tokens[1:] != tokens[:-1], [True]))
    alone = np.zeros(len(tokens), bool)
    alone[order[new[:-1] & new[1:]]] = True
    alone &= owners != SEVERAL
    out, at = [], 0
    for number, n, _, _ in rows:
        who, many = np.unique(owners[at : at + n][alone[at : at + n]], return_counts=True)
        at += n
        if len(who):
            out.append({"slice": number, "count": len(who), "owners": _packed(who), "many": _packed(many.astype(np.uint32))})
    return pa.Table.from_pylist(out, schema=pa.schema([("slice", pa.int64()), ("count", pa.int32()), ("owners", pa.binary()), ("many", pa.binary())]))


def survivors(percent: int):
    """For a cogrouped applyInArrow by slice: the documents that don't hold too many exclusive tokens."""

    def kept(docs, told):
        own = np.zeros(max([x + 1 for x in docs.column("at").to_pylist()], default=0), np.int64)
        for n, owners, many in zip(*(told.column(c).to_pylist() for c in ("count", "owners", "many")), strict=True):
            own[_unpacked(owners, n, np.uint32)] += _unpacked(many, n, np.uint32)
        size, at = docs.column("n").to_numpy(), docs.column("at").to_numpy()
        good = pa.array(100 * (size - own[at]) >= percent * size) if len(size) else pa.array([], pa.bool_())
        return docs.select(["doc_id", "n", "key"]).filter(good)

    return kept


def lister(width: int):
    """A function for mapInArrow: (key, n, text) to (key, tokens), for texts whose set has that key."""

    def listed(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                sets = list(shingle_sets(part.column(1).cast(pa.binary()).to_pylist(), width))
                keep = [i for i, (key, s) in enumerate(zip(part.column(0).to_pylist(), sets, strict=True)) if len(s) and set_key(s) == key]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep, pa.int64())), pa.array([sets[i].view(np.int64) for i in keep], pa.list_(pa.int64()))], names=["key", "tokens"])

    return listed


def needed(percent: int, n, m):
    """Least number of tokens that similar sets of sizes n and m share."""
    return -(-percent * (n + m) // (100 + percent))


def combined(tokens: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-combinations of tokens of one group, each in the tokens' order."""
    order = np.argsort(group, kind="stable")
    tokens, group = tokens[order], group[order]
    found = [(np.arange(len(tokens)), mix(tokens + np.uint64(k)))]
    longest = int(np.unique(group, return_counts=True)[1].max(initial=0))
    for _ in range(k - 1):
        more = []
        for last, h in found:
            for step in range(1, longest):
                at = last[last + step < len(tokens)]
                same = group[at] == group[at + step]
                more.append((at[same] + step, mix(h[: len(at)][same] * np.uint64(0x9E3779B97F4A7C15) + tokens[at[same] + step])))
        found = more
    return np.concatenate([h for _, h in found]) if found else np.empty(0, np.uint64)


def prefix_keys(n: int, df: np.ndarray, tokens: np.ndarray, overlap: int, bin_: int, percent: int) -> np.ndarray:
    """The keys of a set of n tokens for a bin: tokens are those that others hold as well, rarest first.

    A set that shares `overlap` tokens with this one, and whose own keys for the bin are made for as many or fewer, has
    one of these keys. The other n - len(tokens) come first in the order and are in no key.
    """
    if len(tokens) < overlap:
        return np.empty(0, np.uint64)
    groups = max(1, int(EDGES[bin_ + 1]) * 75 // 1000)
    k = np.ones(len(tokens), np.int64)
    # Tokens can be shared without a combination, fewer than k of each group; in bins of tiny sets these could be all.
    if groups * sum(size - 1 for _, size in FREQUENT) < needed(percent, int(EDGES[bin_]), int(EDGES[bin_])):
        for least, size in FREQUENT:
            k[df > least] = size
    group = np.where(k > 1, k * groups + (mix(tokens) % np.uint64(groups)).astype(np.int64), 0)
    order, place = np.argsort(group, kind="stable"), np.arange(len(tokens))
    new = np.concatenate(([True], group[order][1:] != group[order][:-1]))
    rank = np.empty(len(tokens), np.int64)
    rank[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    unmet = len(tokens) - (place + 1) + np.cumsum(rank < k - 1)
    long = int(np.argmax(unmet < overlap)) + 1
    tokens, k, group = tokens[:long], k[:long], group[:long]
    seed = mix(np.full(1, bin_, np.uint64))
    return np.unique(np.concatenate([mix(combined(tokens[k == size], group[k == size], size) ^ seed) for size in np.unique(k)]))


def signer(percent: int):
    """A function for mapInArrow: (set, n, df, tokens) to (key, set, n, own, probe), a row for each key of each bin.

    The smaller set of a pair offers keys in its own bin; the larger one probes all bins its partner can be in.
    """

    def signed(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for key, n, dfs, tokens in zip(*(batch.column(c).to_pylist() for c in ("set", "n", "df", "tokens")), strict=True):
                tokens, at = np.unique(np.array(tokens, np.int64).view(np.uint64), return_index=True)
                df = np.array(dfs, np.int64)[at]
                order = np.lexsort((tokens, df))
                tokens, df = tokens[order], df[order]
                smallest = -(-percent * n // 100)
                low, high = (int(np.searchsorted(EDGES, x, "right")) - 1 for x in (smallest, n))
                asked = [(high, needed(percent, n, n), False)] + [(b, needed(percent, n, max(smallest, int(EDGES[b]))), True) for b in range(low, high + 1)]
                for b, overlap, probe in asked:
                    keys = prefix_keys(n, df, tokens, overlap, b, percent)
                    for column, value in zip(out, (keys.view(np.int64), key, n, n - len(tokens), probe), strict=True):
                        column.append(value if column is out[0] else np.full(len(keys), value))
            flat = [np.concatenate(c) if c else np.empty(0) for c in out]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(kind.to_pandas_dtype()), kind) for x, kind in zip(flat, kinds, strict=True)], names=["key", "set", "n", "own", "probe"])

    return signed


def bitmaps(batches):
    """For mapInArrow: (set, tokens) to (set, parities of the tokens' cells)."""
    for batch in batches:
        maps = [parities(mix(tokens.values.to_numpy().view(np.uint64))) for tokens in batch.column("tokens")]
        yield pa.RecordBatch.from_arrays([batch.column("set"), pa.array(maps, pa.list_(pa.int64()))], names=["set", "bits"])


def confirmer(percent: int):
    """A function for mapInArrow: (a, b, n_a, n_b, tokens_a, tokens_b) to the pairs that are similar enough."""

    def confirm(batches):
        for batch in batches:
            a, b, n_a, n_b = (batch.column(i).to_numpy() for i in range(4))
            keep = np.zeros(len(a), bool)
            for i in range(len(a)):
                one, other = (batch.column(j)[i].values.to_numpy() for j in (4, 5))
                both = len(np.intersect1d(one, other))
                keep[i] = 100 * both >= percent * (n_a[i] + n_b[i] - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return confirm


def similar_documents(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable over links) for every row of docs.

    Rows link if 100 * |intersection| >= percent * |union| of their shingle sets.
    """
    docs = texts(docs, id_col, text_col)
    words = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(8, words // 6 * COUNTED // 256 // RANGE)
    slices = written(docs.mapInArrow(slicer(width, parts, least_size(percent)), SLICES), "slices")
    rows = slices.where("at is not null").select("doc_id", "n", "key")
    packed = slices.where("part is not null").select("part", "slice", "count", "tokens", "owners")
    told = packed.groupBy("part").applyInArrow(exclusive, "slice long, count int, owners binary, many binary")
    left = slices.where(f"at is not null and n >= {least_size(percent)} and doc_id is not null").select("slice", "at", "doc_id", "n", "key")
    left = written(left.groupBy("slice").cogroup(told.groupBy("slice")).applyInArrow(survivors(percent), "doc_id long, n long, key long"), "survivors")
    sets = written(left.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")), "sets")

    few = sets.count() * 24 <= MOST_BYTES
    chosen = sets.select("rep", "key")
    full = docs.join(F.broadcast(chosen) if few else chosen, docs["doc_id"] == F.col("rep")).select("key", "text").mapInArrow(lister(width), "key long, tokens array<long>")
    full = written(full, "tokens")
    held = full.select(F.col("key").alias("set"), F.explode("tokens").alias("token"))
    shared = written(held.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    lists = held.join(shared, "token").groupBy("set").agg(F.collect_set(F.struct("df", "token")).alias("held"))
    lists = lists.join(sets.select(F.col("key").alias("set"), "n"), "set").where(F.size("held") * 100 >= F.col("n") * percent)
    lists = written(lists.select("set", "n", F.col("held.df").alias("df"), F.col("held.token").alias("tokens")), "lists")

    keys = written(lists.mapInArrow(signer(percent), "key long, set long, n int, own int, probe boolean"), "keys")
    stars = keys.groupBy("key").agg(F.min(F.struct("own", "set", "n")).alias("centre"), F.min("set").alias("low"), F.max("set").alias("high"), F.min("probe").alias("offered"))
    stars = stars.where("low < high and not offered").select("key", F.col("centre.set").alias("c"), F.col("centre.own").alias("c_own"), F.col("centre.n").alias("c_n"))
    fits = lambda n, own, m, other: F.least(F.col(n) - F.col(own), F.col(m) - F.col(other)) * (100 + percent) >= (F.col(n) + F.col(m)) * percent
    starred = keys.join(stars, "key").where((F.col("set") != F.col("c")) & fits("n", "own", "c_n", "c_own")).select(F.least("set", "c").alias("a"), F.greatest("set", "c").alias("b")).distinct()

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        of = lambda side: lists.select(F.col("set").alias(side), F.col("n").alias(f"n_{side}"), F.col("tokens").alias(f"tokens_{side}"))
        both = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "n_a", "n_b", "tokens_a", "tokens_b")
        return written(both.mapInArrow(confirmer(percent), "a long, b long"), name)

    starred = written(starred, "star_pairs")
    edges = confirmed(starred, "star_links")
    found = written(components(edges), "components")

    # What shares a bucket but no component yet; a bucket whose members are all connected gives nothing.
    labelled = keys.join(found, keys["set"] == found["id"], "left").select("key", "set", "n", "own", "probe", F.coalesce("component", "set").alias("comp"))
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    cells = [F.col("bits")[i].alias(f"bits{i}") for i in range(SKETCH_WORDS)]
    maps = lists.select("set", "tokens").mapInArrow(bitmaps, "set long, bits array<long>").select("set", *cells)
    open_ = written(labelled.join(mixed, "key").join(maps, "set"), "unsettled")
    x, y = open_.where("probe").alias("x"), open_.where("not probe").alias("y")
    differ = F.col("x.own") + F.col("y.own") + sum((F.bit_count(F.col(f"x.bits{i}").bitwiseXOR(F.col(f"y.bits{i}"))) for i in range(SKETCH_WORDS)), F.lit(0))
    possible = differ * (100 + percent) <= (F.col("x.n") + F.col("y.n")) * (100 - percent)
    across = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp")) & (F.col("x.n") >= F.col("y.n")) & fits("x.n", "x.own", "y.n", "y.own") & possible)
    across = across.select(F.least("x.set", "y.set").alias("a"), F.greatest("x.set", "y.set").alias("b")).distinct().join(starred, ["a", "b"], "left_anti")
    across = written(across, "cross_pairs")
    if not across.isEmpty():
        found = written(components(edges.union(confirmed(across, "cross_links"))), "components")

    labelled = sets.join(found, sets["key"] == found["id"], "left").select("key", "rep", F.coalesce("component", "key").alias("component"))
    smallest = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = labelled.join(smallest, "component").select(F.col("key").alias("of"), "component_id")
    # Sets that were put aside link with equal ones only.
    equal = rows.where("doc_id is not null and n > 0").groupBy(F.col("key").alias("of")).agg(F.min("doc_id").alias("equal"))
    named = equal.join(named, "of", "left").select("of", F.coalesce("component_id", "equal").alias("component_id"))
    out = rows.join(named, rows["key"] == F.col("of"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def least_size(percent: int) -> int:
    """Sets with fewer tokens can only link with equal sets: none with m missing tokens reaches the percentage."""
    return next(n for n in range(1, 102) if 100 * n >= percent * (n + 1))
