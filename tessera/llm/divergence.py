"""Which sources of a language differ, and in which terms, from stripes that the mappers fold themselves.

A task folds whole documents into one hash table of stripes: for each language and term its document frequency and a
count for each source. A table that is full is spilled as rows and begun anew, so a task holds STRIPES of them at most.
Spilled stripes of one term meet by key, are added source by source and give one merged stripe. Terms in enough
documents of their language are kept. With the totals of the kept terms each merged stripe holds all that is needed for
its term: its share of the divergence of every two sources, which tasks add up in one matrix for each language, and its
own divergence from the language, of which tasks hand on the largest for each source.

All numbers are integers. A term's share in a group is p = 1 + floor(10^9 (count + 2) / (N + 2 V)), where N is the
group's sum over the V kept terms; two shares diverge by floor((p - q)^2 / (p + q)).

Defined results: null text, lang and source are ''; every (lang, source) that occurs is a group, with terms or without;
a language without kept terms has divergences of 0 and no terms; repeated rows are documents of their own; a source
alone in its language has no pair; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import written

#: Stripes and bytes of terms that a task holds before it spills them.
STRIPES, BYTES = 200_000, 32 << 20
#: Sources of a language that are one side of a matrix; languages of more are cut into several.
SIDE = 512
#: Matrices and numbers of one that a task holds before it hands them on.
HELD, CELLS = 16, 1 << 21
#: Bytes of the languages' totals that are sent to every task; more meet the stripes by a shuffle.
MOST_BYTES = 32 << 20

_LETTERS = bytes(b if b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_SPILLED = pa.schema([("lang", pa.string()), ("term", pa.string()), ("df", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
SPILLED = "lang string, term string, df long, sources array<string>, counts array<long>"
TOLD = "lang string, source string, part string, item string, value long"


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, lower-cased, and of characters beyond ASCII."""
    return text.translate(_LETTERS).split()


def folded(batches):
    """For mapInArrow: (text, lang, source) to spilled stripes."""
    stripes: dict[tuple[str, bytes], list] = {}
    size = 0

    def spilled():
        items = list(stripes.items())
        for lo in range(0, len(items), 10_000):
            part = items[lo : lo + 10_000]
            columns = ([k[0] for k, _ in part], [k[1].decode() for k, _ in part], [s[0] for _, s in part], [list(s[1]) for _, s in part], [list(s[1].values()) for _, s in part])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SPILLED, strict=True)], schema=_SPILLED)

    for batch in batches:
        langs, sources = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        texts = batch.column(0).cast(pa.binary())
        for i in range(batch.num_rows):
            lang, source = langs[i], sources[i]
            for term, n in Counter(terms_of(texts[i].as_py())).items():
                stripe = stripes.get((lang, term))
                if stripe is None:
                    stripe = stripes[lang, term] = [0, {}]
                    size += len(term)
                stripe[0] += 1
                stripe[1][source] = stripe[1].get(source, 0) + n
            if len(stripes) >= STRIPES or size >= BYTES:
                yield from spilled()
                stripes, size = {}, 0
    yield from spilled()


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 counts / total), exact for totals below 2^53: three digits at a time."""
    whole, rest = np.zeros(np.broadcast(counts, total).shape, np.int64), counts.astype(np.int64)
    for _ in range(3):
        rest = rest * 1000
        whole, rest = whole * 1000 + rest // total, rest % total
    return whole + 1


def diverged(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def emitter(ranks: int):
    """A function for mapInArrow: merged stripes with the totals of their language to parts of the result, to be added up or ranked."""

    def emit(batches):
        sums: dict[tuple[str, int, int], np.ndarray] = {}
        names: dict[str, list[str]] = {}

        def told(rows):
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 4 + [pa.int64()], strict=True)], names=["lang", "source", "part", "item", "value"])

        def added():
            for (lang, i, j), m in sums.items():
                of = names[lang]
                yield told([(lang, of[i + a], "pair", of[j + b], int(m[a, b])) for a in range(m.shape[0]) for b in range(m.shape[1]) if i + a != j + b])

        for batch in batches:
            langs = batch.column("lang").to_numpy(zero_copy_only=False)
            for lang in np.unique(langs):
                part = batch.filter(pa.array(langs == lang))
                of, totals = part.column("all_sources")[0].as_py(), np.array(part.column("totals")[0].as_py(), np.int64)
                place, terms = {s: i for i, s in enumerate(of)}, part.column("term").to_pylist()
                names[lang] = of
                denominators = totals + 2 * part.column("v")[0].as_py()
                owners, values = part.column("sources").to_pylist(), part.column("counts").to_pylist()
                step = max(1, CELLS // max(min(len(of), SIDE) ** 2, len(of)))
                for lo in range(0, len(terms), step):
                    counts = np.zeros((len(terms[lo : lo + step]), len(of)), np.int64)
                    for row, (who, many) in enumerate(zip(owners[lo : lo + step], values[lo : lo + step], strict=True)):
                        counts[row, [place[s] for s in who]] = many
                    p = shares(counts + 2, denominators[None, :])
                    whole = counts.sum(axis=1)
                    q = shares(whole + 2, np.full(len(whole), totals.sum() + 2 * part.column("v")[0].as_py()))[:, None]
                    for i in range(0, len(of), SIDE):
                        for j in range(0, len(of), SIDE):
                            m = diverged(p[:, i : i + SIDE, None], p[:, None, j : j + SIDE]).sum(axis=0)
                            sums[lang, i, j] = sums.get((lang, i, j), 0) + m
                            if len(sums) > HELD:
                                yield from added()
                                sums.clear()
                    own = np.where((counts > 0) & (p > q), diverged(p, q), -1)
                    by_term = sorted(range(len(counts)), key=lambda r: terms[lo + r].encode())
                    first = np.array(by_term)[np.argsort(-own[by_term], axis=0, kind="stable")[:ranks]]
                    yield told([(lang, of[s], "term", terms[lo + r], int(own[r, s])) for s in range(len(of)) for r in first[:, s] if own[r, s] >= 0])
        yield from added()

    return emit


def audit_sources(docs: DataFrame, min_docs: int = 10, ranks: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: how far a source is from each other one ('pair') and its own terms ('term')."""
    docs = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    groups = written(docs.select("lang", "source").distinct(), "groups")

    # One shuffle: stripes of a term meet, then both sums stay where the rows are.
    rows = docs.mapInArrow(folded, SPILLED).repartition("lang", "term")
    rows = rows.select("lang", "term", "df", F.posexplode(F.arrays_zip("sources", "counts")).alias("at", "of"))
    merged = rows.groupBy("lang", "term", F.col("of.sources").alias("source")).agg(F.sum("of.counts").alias("n"), F.sum(F.when(F.col("at") == 0, F.col("df")).otherwise(0)).alias("df"))
    merged = merged.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("stripe")).where(F.col("df") >= min_docs)
    kept = written(merged.select("lang", "term", F.col("stripe.source").alias("sources"), F.col("stripe.n").alias("counts")), "stripes")

    totals = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("of")).groupBy("lang", F.col("of.sources").alias("source")).agg(F.sum("of.counts").alias("total"))
    totals = groups.join(totals, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("all"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v")).join(totals, "lang").select(F.col("lang").alias("of_lang"), "v", F.col("all.source").alias("all_sources"), F.col("all.total").alias("totals"))
    langs = written(langs, "languages")
    size = langs.agg(F.sum(F.aggregate("all_sources", F.lit(64), lambda s, x: s + F.octet_length(x) + 24))).first()[0] or 0
    known = F.broadcast(langs) if size <= MOST_BYTES else langs
    told = written(kept.join(known, F.col("lang") == F.col("of_lang")).select("lang", "term", "sources", "counts", "v", "all_sources", "totals").mapInArrow(emitter(ranks), TOLD), "parts")

    others = groups.alias("a").join(groups.alias("b"), (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") != F.col("b.source")))
    others = others.select("a.lang", "a.source", F.lit("pair").alias("part"), F.col("b.source").alias("item"), F.lit(0).cast("long").alias("value"))
    pairs = told.where("part = 'pair'").union(others).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.select("lang", "source", "part", "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs).union(ranked(told.where("part = 'term'")).where(F.col("rank") <= ranks))
