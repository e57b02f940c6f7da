"""Places in an order, bounded crawls and the postings index against brute force."""

import random
from collections import Counter, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import crawl, lexical, order
from tessera.operators.crawl import Policy, crawled


def test_first_rows(spark):
    rows = [(random.Random(i).randrange(50), i) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    for n in (0, 1, 49, 250, 500, 600):
        assert sorted(map(tuple, order.first_rows(df, ["a", "b"], n).collect())) == sorted(rows)[:n]


def test_nearest_rank(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(1, 21)] + [("b", 7.0)] * 3 + [("c", None), (None, 5.0)], "g string, v double")
    found = {r["g"]: (r["p50"], r["p95"]) for r in order.nearest_rank(rows, ["g"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    assert found == {"a": (10.0, 19.0), "b": (7.0, 7.0), None: (5.0, 5.0)}


def test_nearest_rank_of_one_group_of_all_rows(spark):
    values = [random.Random(i).choice([i % 3, random.Random(i).gauss(0, 1)]) for i in range(3000)]
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(8)
    shares = {"p0": 0.0, "p1": 0.01, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    found = order.nearest_rank(rows, [], "v", shares).collect()
    ordered = sorted(float(v) for v in values)
    assert [found[0][n] for n in shares] == [ordered[max(int(np.ceil(p * len(ordered))), 1) - 1] for p in shares.values()]
    assert order.nearest_rank(rows.limit(0), [], "v", shares).where("p50 is not null").count() == 0


# --- crawl


def walked(members, pages, categories, policy):
    """The walk as a queue; pages and categories considered, in order."""
    out, included, seen = [], set(), set()

    def refusal(title, space):
        if space in policy.denied:
            return "denied_namespace"
        if space not in policy.allowed:
            return "namespace_not_allowed"
        return "denied_title" if any(p.lower() in title.lower() for p in policy.title_deny) else None

    def consider(title, page, space, source, depth):
        why = "duplicate_page" if page in included else refusal(title, space)
        out.append((title, page, space, source, depth, why))
        if why is None:
            included.add(page)
        return len(included) >= policy.max_pages

    no = lambda title: any(p.lower() in title.lower() for p in policy.category_deny)
    for title, page, space, _ in sorted(pages, key=lambda r: r[3]):
        if consider(title, page, space, f"seed:{title}", 0):
            return out, True
    queue = deque((title, 0) for title, _ in sorted(categories, key=lambda r: r[1]))
    while queue:
        name, depth = queue.popleft()
        if name.lower() in seen or no(name):
            out.append((name, None, 14, name, depth, "duplicate_category" if name.lower() in seen else "denied_category"))
            continue
        seen.add(name.lower())
        for _, title, page, space, _ in sorted((m for m in members if m[0] == name), key=lambda m: m[4])[: policy.max_members]:
            if space != 14:
                if consider(title, page, space, name, depth):
                    return out, True
            elif depth >= policy.max_depth:
                out.append((title, page, 14, name, depth + 1, "depth_limit"))
            elif no(title):
                out.append((title, page, 14, name, depth + 1, "denied_category"))
            else:
                queue.append((title, depth + 1))
    return out, False


def check_walk(spark, members, pages, categories, policy):
    found = crawled(
        spark.createDataFrame(members, "category string, title string, page_id long, namespace int, ord long"), spark.createDataFrame(pages, "title string, page_id long, namespace int, ord long"),
        spark.createDataFrame(categories, "title string, ord long"), policy,
    ).collect()
    want, truncated = walked(members, pages, categories, policy)
    assert [tuple(r)[:6] for r in sorted(found, key=lambda r: (r["place"]["level"], r["place"]["key"]))] == want
    assert {r["truncated"] for r in found} <= {truncated}
    return want


@pytest.mark.parametrize("most", [1, 3, 12, 1000])
def test_crawl_equals_a_queue(spark, most):
    rng = random.Random(7)
    names = [f"{c}{i}" for i in range(9) for c in "Kk"]
    members = []
    for c in names:
        for o in rng.sample(range(40), 7):
            if rng.random() < 0.5:
                members.append((c, rng.choice(names), None, 14, o))
            else:
                page = rng.randrange(25)
                members.append((c, f"Page {page}", page, rng.choice([0, 0, 0, 1, 10]), o))
    policy = Policy(max_depth=2, max_pages=most, max_members=6, denied=frozenset({10}), title_deny=("age 7",), category_deny=("K3",))
    want = check_walk(spark, members, [("Page 1", 1, 0, 5), ("Page 2", 2, 10, 4), ("Page 1", 1, 0, 9)], [("K0", 2), ("k4", 1), ("K3", 0), ("K4", 8)], policy)
    if most == 1000:
        assert {w[5] for w in want} == {None, "duplicate_page", "denied_namespace", "namespace_not_allowed", "denied_title", "duplicate_category", "denied_category", "depth_limit"}


def test_crawl_of_depth_twenty_has_a_linear_plan(spark):
    members = [(f"C{i}", f"C{i + 1}", None, 14, 0) for i in range(25)] + [(f"C{i}", f"P{i}", i, 0, 1) for i in range(25)] + [(f"C{i}", "C0", None, 14, 2) for i in range(25)]
    want = check_walk(spark, members, [], [("C0", 0)], Policy(max_depth=20, max_pages=100))
    assert sum(w[5] is None for w in want) == 21 and sum(w[5] == "duplicate_category" for w in want) == 20 and sum(w[5] == "depth_limit" for w in want) == 2


def test_crawl_policy_and_empty_inputs(spark):
    with pytest.raises(ValueError, match="both"):
        Policy(1, 1, denied=frozenset({0}))
    with pytest.raises(ValueError, match="positive"):
        Policy(1, 0)
    assert check_walk(spark, [("A", None, None, None, None)], [], [], Policy(1, 5)) == []
    assert crawl.page_reason(Policy(0, 1)) is not None


# --- postings


WORDS = ["".join(random.Random(i).choices("abcdefgh", k=3)) for i in range(120)]


def lexical_brute(docs, queries):
    out = {}
    for i, terms in queries:
        for d, text in docs:
            padded = f" {text or ''} "
            n = sum(f" {x} " in padded for x in set(terms))
            if n:
                out[i, d] = n
    return out


@pytest.mark.parametrize(("shard_chars", "block", "most"), [(1 << 30, 4096, 1 << 20), (500, 3, 0)])
def test_lexical_search_equals_brute_force(spark, monkeypatch, shard_chars, block, most):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "MOST_BYTES", most)
    rng = random.Random(5)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    docs = [(2**40 + i, " ".join(rng.choices(WORDS, weights, k=rng.choice([0, 3, 40, 200])))) for i in range(150)] + [(1, None), (2, WORDS[0])]
    queries = []
    for i in range(12):
        text = rng.choice(docs)[1] or ""
        words = text.split()
        queries.append((i, list(dict.fromkeys(rng.choices(WORDS, weights, k=15))) + [" ".join(words[3:6])] * (len(words) > 6) + ["nowhere", f"{WORDS[0]} nowhere"]))
    queries += [(50, []), (51, ["nowhere"]), (52, [WORDS[0], WORDS[0]])]
    index = lexical.index_of(spark.createDataFrame([*docs, (None, WORDS[0])], "doc_id long, text string"), shard_chars)
    asked = spark.createDataFrame(queries, "item_id long, terms array<string>")
    want = lexical_brute(docs, queries)
    assert {(r["item_id"], r["doc_id"]): round(r["score"] * 10) for r in lexical.lexical_scores(asked, index).collect()} == want
    for k in (1, 5):
        best = {(i, rank + 1, d): n for i, _ in queries for rank, (n, d) in enumerate(sorted((-n, d) for (j, d), n in want.items() if j == i)[:k])}
        assert {(r["item_id"], r["rank"], r["doc_id"]): -round(r["score"] * 10) for r in lexical.best_lexical(asked, index, k).collect()} == best


def test_pruning_looks_at_fewer_entries():
    rng, looked, every = np.random.default_rng(1), 0, 0
    for _ in range(20):
        lists = [np.sort(rng.choice(5000, int(5000 * p), replace=False)) for p in rng.random(30) ** 2 * 0.9 + 0.001]
        full = Counter(np.concatenate(lists).tolist())
        found, n, seen = lexical.counted(lists, 5000, 40)
        kth = sorted(full.values())[-40]
        assert {d: c for d, c in zip(found.tolist(), n.tolist(), strict=True) if c >= kth} == {d: c for d, c in full.items() if c >= kth}
        looked, every = looked + seen, every + sum(map(len, lists))
    assert looked < 0.8 * every


def test_stored_index_is_built_once_and_again_when_files_change(spark, tmp_path):
    from tessera.sources.store import stored

    path, built = str(tmp_path / "docs"), []

    def index():
        docs = spark.read.parquet(path)
        return stored(docs, "test-postings", lambda to: (built.append(to), lexical.write_index(docs, to)))

    spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string").write.parquet(path)
    asked = spark.createDataFrame([(7, ["b"])], "item_id long, terms array<string>")
    assert lexical.best_lexical(asked, index()).count() == 2 and lexical.best_lexical(asked, index()).count() == 2 and len(built) == 1
    spark.createDataFrame([(3, "b")], "doc_id long, text string").write.mode("append").parquet(path)
    assert lexical.best_lexical(asked, index()).count() == 3 and len(built) == 2
    assert lexical.lexical_matches(asked, index(), 5).agg(F.sum("looked_at")).first()[0] >= 3
