"""Combination joins, stripes and hard negatives against brute force, with odd rows and every path."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import combination_join, divergence, hard_negatives

WORDS = ["".join(random.Random(i).choices("abcdefgh", k=5)) for i in range(300)]


def documents(spark, rows):
    """(doc_id, text) with further columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, t, 1, "s", 2, 0.5) for i, t in rows], "doc_id long, text string, key int, set string, n int, df double")


def variants(seed, per_base):
    rng, rows = random.Random(seed), []
    for base in range(3):
        text = random.Random(base).choices(WORDS, k=12 + 50 * base)
        for _ in range(per_base):
            w = list(text)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w[: len(w) - rng.choice([0, 0, 1, 5])])))
    return [r for r in rows if r[0] % per_base]  # no group has its original


def sets_of(rows, width):
    for _, text in rows:
        w = (text or "").lower().split()
        yield {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def linked_classes(rows, percent, width):
    sets, group = list(sets_of(rows, width)), list(range(len(rows)))
    meet = lambda a, b: rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    links = [[b for b in range(len(rows)) if b == a or meet(a, b)] for a in range(len(rows))]
    while (now := [min(group[b] for b in links[a]) for a in range(len(rows))]) != group:
        group = now
    low = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    return Counter((i, len(s), None if i is None else low[g]) for (i, _), s, g in zip(rows, sets, group, strict=True))


@pytest.mark.parametrize(("percent", "width", "frequent"), [(85, 4, ((64, 2), (4096, 3))), (80, 5, ((5, 2), (20, 3))), (60, 3, ((2, 2), (10, 3)))])
def test_combination_join_equals_brute_force(spark, monkeypatch, percent, width, frequent):
    monkeypatch.setattr(combination_join, "FREQUENT", frequent)
    rows = variants(3, 60) + [(1000, None), (1001, ""), (1002, "one two"), (1003, "one  two"), (1004, "One\x0btwo"), (2000, "a b c d e f g h"), (2001, "a b c d e f g h"), (2001, "a b c d e f g h")]
    rows += [(None, rows[0][1]), (None, None), (2**60, "x y " * 20_000)]
    found = combination_join.similar_documents(documents(spark, rows), percent, width).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == linked_classes(rows, percent, width)


def test_combination_join_keeps_rows_that_repeat_an_id_apart(spark):
    a, b = " ".join(WORDS[:30]), " ".join(WORDS[100:130])
    rows = [(5, a), (5, b), (9, b), (7, a + " more"), (7, None)]
    found = combination_join.similar_documents(documents(spark, rows), 85, 4).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == Counter([(5, 27, 5), (5, 27, 5), (9, 27, 5), (7, 28, 5), (7, 0, 7)])
    assert combination_join.similar_documents(documents(spark, rows).limit(0)).count() == 0


def test_combination_join_over_tiny_slices_and_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(combination_join, "SLICE", 50)
    monkeypatch.setattr(combination_join, "RANGE", 20)
    monkeypatch.setattr(combination_join, "MOST_BYTES", 0)
    rows = variants(4, 30) + [(500 + i, " ".join(random.Random(i).choices(WORDS, k=90))) for i in range(60)]
    found = combination_join.similar_documents(documents(spark, rows), 85, 4).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == linked_classes(rows, 85, 4)


def test_similar_sets_share_a_key_and_unlike_ones_are_bounded():
    """Pairs at exactly the needed overlap share a key, whatever the classes of their tokens."""
    rng = np.random.default_rng(5)
    for percent in (60, 85):
        for _ in range(150):
            n = int(rng.integers(combination_join.least_size(percent), 200))
            m = int(rng.integers(-(-percent * n // 100), n + 1))
            both = combination_join.needed(percent, n, m)
            if both > m:
                continue
            tokens = rng.integers(1, 1 << 62, n + m - both).astype(np.uint64)
            df = rng.choice([2, 50, 100, 5000], len(tokens), p=rng.dirichlet(np.ones(4)))
            keys = []
            for at, size, sides in ((np.r_[0:n], n, "probe"), (np.r_[n - both : n - both + m], m, "offer")):
                alone = rng.random(size) < 0.3
                alone &= ~((at >= n - both) & (at < n))  # exclusive tokens are among those not shared
                held = at[~alone]
                order = held[np.lexsort((tokens[held], df[held]))]
                bin_ = int(np.searchsorted(combination_join.EDGES, m, "right")) - 1
                overlap = combination_join.needed(percent, m, m) if sides == "offer" else combination_join.needed(percent, n, max(-(-percent * n // 100), int(combination_join.EDGES[bin_])))
                keys.append(combination_join.prefix_keys(size, df[order], tokens[order], overlap, bin_, percent))
            assert len(np.intersect1d(*keys)), (percent, n, m, both)


# --- stripes


def audited(rows, min_docs, ranks):
    terms = lambda t: [x for x in "".join(c.lower() if "A" <= c <= "Z" else c if "a" <= c <= "z" or ord(c) > 127 else " " for c in t or "").split(" ") if x]
    docs = [(lang or "", source or "", Counter(terms(text))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for d in docs if d[0] == lang for t in d[2])
        kept = [t for t in df if df[t] >= min_docs]
        count = {s: Counter() for s in {d[1] for d in docs if d[0] == lang}}
        for d in docs:
            if d[0] == lang:
                count[d[1]].update({t: n for t, n in d[2].items() if df[t] >= min_docs})
        whole = sum(count.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        apart = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: share(c) for s, c in count.items()}, share(whole)
        for s in count:
            pairs = [(-sum(apart(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in count if o != s]
            own = [(-apart(p[s][t], q[t]), t.encode(), t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(own)[:ranks])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)]
    return sorted(out)


def sourced(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, source string, term string, value int")


@pytest.mark.parametrize(("stripes", "side", "held", "most"), [(200_000, 512, 16, 1 << 20), (7, 2, 1, 0)])
def test_source_audit_equals_brute_force(spark, monkeypatch, stripes, side, held, most):
    for name, value in (("STRIPES", stripes), ("SIDE", side), ("HELD", held), ("MOST_BYTES", most), ("CELLS", 8 if side == 2 else 1 << 21)):
        monkeypatch.setattr(divergence, name, value)
    rng = random.Random(1)
    rows = [(" ".join(rng.choices(WORDS[:60], k=rng.choice([0, 3, 40]))) + rng.choice(["", " Ärger, É x1y!", "_A_", "\x00B"]), rng.choice(["en", "de", None]), rng.choice(["a", "b", "é", None, "Z"])) for _ in range(300)]
    rows += [(None, "en", "empty"), ("", None, "b"), ("solo word", "fr", "one"), ("rare", "es", "a"), ("rare too", "es", "b"), ("w " * 100_000, "en", "a")] + [rows[0]] * 3
    found = divergence.audit_sources(sourced(spark, rows), 10, 10).collect()
    assert sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in found) == audited(rows, 10, 10)
    assert divergence.audit_sources(sourced(spark, rows).limit(0)).count() == 0


def test_shares_are_exact_for_large_counts():
    counts, total = np.array([[3, 10**14, 7 * 10**14 + 1]]), np.array([[8 * 10**14 + 3]])
    assert divergence.shares(counts, total).tolist() == [[1 + 10**9 * int(c) // int(total[0, 0]) for c in counts[0]]]


# --- hard negatives


def mined(rows, anchor, k=5, percent=80):
    clean = [(i, label, [int(np.floor(256.0 * float(x))) for x in v]) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, label, v) in enumerate(clean):
        if not anchor(i):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j, b, other) for b, (j, other, w) in enumerate(clean) if b != a and len(w) == len(v))
        for s, j, _, _ in [x for x in scored if x[3] == label][:k]:
            fit = [x for x in scored if x[3] != label and percent * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(i, j, rank + 1, x[1], -s, -x[0]) for rank, x in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["spread", "clustered"])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(hard_negatives, "BLOCK", 40)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8)) * rng.choice([0.2, 1, 5], (6, 1))
    rows = [(i, (centres[i % 6] * (kind == "clustered") + rng.normal(size=8) * (0.05 if kind == "clustered" else rng.choice([0.1, 1]))).tolist(), int(rng.integers(0, 3))) for i in range(400)]
    rows += [(500, rows[0][1], rows[1][2]), (10, rows[3][1], 0), (10, rows[4][1], 1), (510, [0.0] * 8, 1), (520, [0.5, 0.5], 1), (521, [0.5, 0.25], 1), (522, [0.5, 0.25], 2)]  # ties, repeated ids, zero, other lengths
    odd = [(530, None, 1), (540, [None] * 8, 1), (550, [float("nan")] * 8, 1), (560, [float("inf")] * 8, 1), (570, [], 1), (None, rows[0][1], 1), (580, rows[0][1], None)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], "vec_id long, embedding array<double>, label int, block string, row int")
    told = {}
    found = hard_negatives.mine_negatives(frame, F.col("vec_id") % 10 == 0, F.col("label"), told=told).collect()
    assert sorted(map(tuple, found)) == mined(rows, lambda i: i % 10 == 0) and len(found) > 100
    assert kind == "spread" or told["left"] < told["pairs"]
    assert hard_negatives.mine_negatives(frame.limit(0), F.col("vec_id") % 10 == 0, F.col("label")).count() == 0


def test_feasible_ranges_hold_every_similar_vector():
    rng, pruned = np.random.default_rng(3), 0
    for dim in (2, 8, 64):
        x = rng.normal(size=(500, dim)) * np.linspace(3, 0.1, dim)
        x /= np.linalg.norm(x, axis=1)[:, None]
        order = np.argsort(x, axis=0, kind="stable")
        for least in (0.1, 0.5, 0.9, 0.99, 1.0):
            for q in x[:20]:
                near = hard_negatives.candidates(q, least, order.T, np.take_along_axis(x, order, 0).T)
                want = set(np.flatnonzero(x @ q >= least))
                assert near is None or want <= set(near.tolist())
                pruned += near is not None
    assert pruned > 50
