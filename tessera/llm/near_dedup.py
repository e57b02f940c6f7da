"""MinHash near-duplicate classes with odd sketches.

Each text becomes its set of distinct word shingles. MinHash samples are cut into bands; texts that share
a band are candidates. The samples are also folded into an odd sketch, a bitmap of parities: the population
count of the XOR of two sketches estimates how many samples differ, precisely where similarities are high,
and drops most false candidates for a few XORs. A second bitmap folds the whole set: its XOR count never exceeds
the symmetric difference, so it rules pairs out with certainty, sharply for all but long texts. What passes is
confirmed on the full sets.

No bucket is ever paired in full. Equal sets collapse to one representative; each bucket is a star around its
smallest member; stars that hold give components, and then only members of *different* components that still
share a bucket are compared. So every pair that shares a band either is connected already or has been compared.
Large buckets of unconnected members are variants of one text, mostly too far apart. Their members meet by the first
of their shingles instead of by bucket, so that no bucket is one task: in one order of all shingles, sets that are
similar enough have one of these in common for certain. Shingles that occur in one component alone come first, and as
they can't be shared, a member that has many of them offers none to others; they also bound each pair's intersection
before it becomes a row. Shingles that many members hold come last.

Defined results: null text = empty text; a text without words has the empty set, links with nothing and is kept;
a null doc_id links with nothing (component_id null, kept true); rows with equal doc_id are each returned;
an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import mix, shingle_sets, texts, written

ROWS = 5
#: MinHash samples of a sketch; the bands use the first of them.
SAMPLES = 256
SKETCH_BITS = 1024
SKETCH_WORDS = SKETCH_BITS // 64
#: A link at exactly the threshold shares no band with at most this probability.
MISS = 1e-7
#: Unconnected members from which those of a bucket meet by their shingles.
LARGE = 64
#: Shingles that more of these members hold come last in the order in which members meet.
HOT = 32


def bands_for(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS))


def sketch_limit(threshold: float) -> int:
    """Most bits in which two sketches of a true link may differ: far out in the tail, so links aren't lost."""
    k = max(SAMPLES, bands_for(threshold) * ROWS)
    differ = k * (1 - threshold) + 5.5 * math.sqrt(k * threshold * (1 - threshold))
    tosses = 2 * differ
    bits = SKETCH_BITS / 2 * (1 - math.exp(-2 * tosses / SKETCH_BITS))
    return math.ceil(bits + 3 * math.sqrt(bits / 2))


def parities(hashes: np.ndarray) -> np.ndarray:
    """The bitmap that holds for each cell whether an odd number of hashes fell into it, as int64 words."""
    odd = np.bincount((hashes % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def digest_of(s: np.ndarray) -> bytes:
    """What equal sets of shingles have in common."""
    return int(mix(s).sum(dtype=np.uint64)).to_bytes(8, "big") + int(np.bitwise_xor.reduce(mix(s + np.uint64(1)))).to_bytes(8, "big") + len(s).to_bytes(4, "big")


def signer(width: int, bands: int):
    """A function for mapInArrow: (doc_id, text) to set size, digest, band keys, odd sketch and the whole set's parities."""
    k = max(SAMPLES, bands * ROWS)
    rng = np.random.default_rng(20)
    mul = (rng.integers(0, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
    add = rng.integers(0, 1 << 32, k, dtype=np.uint32)[:, None]
    sample = np.arange(k, dtype=np.uint64) << np.uint64(33)
    band = np.arange(bands, dtype=np.uint64)

    def sign(batches):
        for batch in batches:
            rows = batch.column(1).cast(pa.binary()).to_pylist()
            sizes, digests, keys, sketches, wholes = [], [], [], [], []
            for s in shingle_sets(rows, width):
                sizes.append(len(s))
                if not len(s):
                    digests.append(None), keys.append(None), sketches.append(None), wholes.append(None)
                    continue
                x = (s >> np.uint64(32)).astype(np.uint32)
                low = np.full(k, 0xFFFFFFFF, np.uint32)
                for a in range(0, len(x), 1024):
                    np.minimum(low, (mul * x[a : a + 1024] + add).min(axis=1), out=low)
                digests.append(digest_of(s))
                key = band.copy()
                for r in range(ROWS):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + low[r : bands * ROWS : ROWS])
                keys.append(key.view(np.int64))
                sketches.append(parities(mix(sample + low)))
                wholes.append(parities(mix(s + np.uint64(2))))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, longs), pa.array(sketches, longs), pa.array(wholes, longs)], names=["doc_id", "n_shingles", "digest", "bands", "sketch", "whole"])

    return sign


def confirmer(width: int, percent: int):
    """A function for mapInArrow: (a, b, text_a, text_b) to the pairs whose full sets are similar enough."""

    def confirm(batches):
        for batch in batches:
            ids_a, ids_b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            text_a, text_b = (batch.column(i).cast(pa.binary()) for i in (2, 3))
            keep = []
            for lo in range(0, len(ids_a), 256):  # bounds what is held as Python objects
                part_a, part_b = text_a.slice(lo, 256).to_pylist(), text_b.slice(lo, 256).to_pylist()
                distinct = list(dict.fromkeys(part_a))
                sets = dict(zip(distinct, shingle_sets(distinct, width), strict=True))
                for i, (x, other) in enumerate(zip(part_a, shingle_sets(part_b, width), strict=True)):
                    one = sets[x]
                    both = len(np.intersect1d(one, other, assume_unique=True))
                    if 100 * both >= percent * (len(one) + len(other) - both):
                        keep.append(lo + i)
            yield pa.RecordBatch.from_arrays([pa.array([ids_a[i] for i in keep], pa.int64()), pa.array([ids_b[i] for i in keep], pa.int64())], names=["a", "b"])

    return confirm


def lister(width: int):
    """A function for mapInArrow: (rep, comp, text) to (rep, comp, digest, shingles)."""

    def shingles(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = list(shingle_sets(part.column(2).cast(pa.binary()).to_pylist(), width))
                digests = pa.array([digest_of(s) if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), digests, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["rep", "comp", "digest", "shingles"])

    return shingles


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every id of edges (a, b): the smallest id reachable, by large and small stars.

    Every step groups with partial aggregation and joins; nothing is gathered per id or on the driver.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(low.where("m < u")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = written(small.where("u > v").distinct(), "edges")
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == mark:
            break
        mark = found
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept for every row of docs.

    Rows link if 100 * |intersection| >= percent * |union| of their shingle sets.
    """
    docs = texts(docs, id_col, text_col)
    threshold = percent / 100
    limit = sketch_limit(threshold)
    signed = written(docs.mapInArrow(signer(width, bands_for(threshold)), "doc_id long, n_shingles long, digest binary, bands array<long>, sketch array<long>, whole array<long>"), "signatures")

    classes = signed.where("doc_id is not null and n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    reps = written(signed.alias("s").join(classes.alias("c"), (F.col("s.digest") == F.col("c.digest")) & (F.col("s.doc_id") == F.col("c.rep"))).select("rep", "n_shingles", "s.digest", "bands", "sketch", "whole"), "classes")
    keys = reps.select("rep", F.explode("bands").alias("key"))
    stars = keys.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a < last").drop("last")
    pairs = keys.join(stars, "key").where("rep > a").select("a", F.col("rep").alias("b")).distinct()

    measures = ["n_shingles", *(F.col(name)[i].alias(f"{name}{i}") for name in ("sketch", "whole") for i in range(SKETCH_WORDS))]
    sized = reps.select("rep", "digest", *measures).dropDuplicates(["rep", "digest"])

    def close(x: str, y: str):
        sketch, whole = (sum((F.bit_count(F.col(f"{x}.{name}{i}").bitwiseXOR(F.col(f"{y}.{name}{i}"))) for i in range(SKETCH_WORDS)), F.lit(0)) for name in ("sketch", "whole"))
        small, big = F.least(f"{x}.n_shingles", f"{y}.n_shingles"), F.greatest(f"{x}.n_shingles", f"{y}.n_shingles")
        return (small * 100 >= big * percent) & (whole * (100 + percent) <= (small + big) * (100 - percent)) & (sketch <= limit)

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        of_a, of_b = docs.alias("ta"), docs.alias("tb")
        full = pairs.join(of_b, F.col("b") == F.col("tb.doc_id")).select("a", "b", F.col("tb.text").alias("text_b"))
        full = full.join(of_a, F.col("a") == F.col("ta.doc_id")).select("a", "b", F.col("ta.text").alias("text_a"), "text_b")
        return written(full.mapInArrow(confirmer(width, percent), "a long, b long"), name)

    starred = written(pairs.alias("p").join(sized.alias("x"), F.col("p.a") == F.col("x.rep")).join(sized.alias("y"), F.col("p.b") == F.col("y.rep")).where(close("x", "y")).select("a", "b"), "star_pairs")
    edges = confirmed(starred, "star_links")
    found = written(components(edges), "components")

    # What shares a bucket but no component yet; a bucket whose members are all connected gives nothing.
    labelled = keys.join(found, keys.rep == found.id, "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    left = written(labelled.join(mixed, "key").distinct(), "unsettled")
    large = left.groupBy("key").count().where(F.col("count") > LARGE).select("key")
    few = left.join(large, "key", "left_anti").join(sized, "rep")
    across = few.alias("x").join(few.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp")) & (F.col("x.rep") < F.col("y.rep")) & close("x", "y"))
    across = across.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))

    # Members of large buckets meet by shingle instead, each with its first ones in one order of all shingles: of two sets
    # that are similar enough the larger one's first `probes` and the smaller one's first `offers` have one in common.
    members = left.join(large, "key").select("rep", "comp").distinct()
    listed = members.join(docs, F.col("rep") == F.col("doc_id")).select("rep", "comp", "text").mapInArrow(lister(width), "rep long, comp long, digest binary, shingles array<long>")
    # A doc_id can stand in many rows, of one text or of several: each of its sets is counted once.
    listed = written(listed.dropDuplicates(["rep", "digest"]).withColumn("n", F.size("shingles")), "shingles")
    # What one component alone holds can't be shared; it comes first in every set and is only counted. Then comes what at
    # most HOT members hold, rarest first, and last what more hold, in the order of its hashes: so a shingle that all
    # variants share is among the first of none that has enough others. The order is the same in every set. Only the
    # rarer shingles are joined; what is left of a set is what many hold.
    held = listed.select("rep", "comp", "digest", F.explode("shingles").alias("shingle"))
    known = held.groupBy("shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("often"))
    known = written(known.where((F.col("low") == F.col("high")) | (F.col("often") <= HOT)).select("shingle", F.when(F.col("low") != F.col("high"), F.col("often")).alias("often")), "known")
    known = held.join(known, "shingle").groupBy("rep", "digest").agg(
        F.collect_list(F.when(F.col("often").isNull(), F.col("shingle"))).alias("alone"), F.sort_array(F.collect_list(F.when(F.col("often").isNotNull(), F.struct("often", "shingle")))).alias("few"),
    )
    none = F.array().cast("array<bigint>")
    held = listed.join(known, ["rep", "digest"], "left").withColumns({"alone": F.coalesce("alone", none), "few": F.coalesce("few.shingle", none)})
    held = held.withColumn("rest", F.concat("few", F.array_except("shingles", F.concat("alone", "few"))))
    held = held.withColumns({"own": F.size("alone"), "probes": F.expr(f"n - ceil({percent} * n / 100) + 1"), "offers": F.expr(f"n - ceil({2 * percent} * n / {100 + percent}) + 1")})
    held = held.select("rep", "comp", "digest", "own", "offers", F.posexplode(F.slice("rest", F.lit(1), F.greatest(F.col("probes") - F.col("own"), F.lit(0)).cast("int"))).alias("at", "shingle"))
    held = written(held.join(sized, ["rep", "digest"]), "prefixes")  # both sides of the join below come straight from here, so large keys can be split
    # The intersection is within what either set shares with any other.
    most = F.least(F.col("x.n_shingles") - F.col("x.own"), F.col("y.n_shingles") - F.col("y.own"))
    possible = most * (100 + percent) >= (F.col("x.n_shingles") + F.col("y.n_shingles")) * percent
    offered = held.where(F.col("own") + F.col("at") < F.col("offers")).alias("y")
    met = held.alias("x").join(offered, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.comp") != F.col("y.comp")) & (F.col("x.n_shingles") >= F.col("y.n_shingles")) & possible & close("x", "y"))
    across = across.union(met.select(F.least("x.rep", "y.rep"), F.greatest("x.rep", "y.rep"))).distinct().join(starred, ["a", "b"], "left_anti")
    across = written(across, "cross_pairs")
    if not across.isEmpty():
        more = confirmed(across, "cross_links")
        if not more.isEmpty():
            found = written(components(edges.union(more)), "components")

    named = reps.select("digest", "rep").distinct().join(found, F.col("rep") == F.col("id"), "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = signed.join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
