"""The stored vector index and the SQL table functions."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.ann import VectorIndex
from tessera.operators.vectors import match_vectors
from tessera.plans.functions import called, register_functions
from tessera.sources.versions import ConcurrentChange

SF = "/root/testdata/sf0.1"


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")


def asked(vectors):
    return vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def test_added_vectors_are_found_and_nothing_is_rebuilt(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(300, 16))
    index = VectorIndex.create(spark, str(tmp_path / "i"), 16, tables=24, least=100)
    assert index.search(asked(frame(spark, [1], x[:1]))).count() == 0
    assert index.add(frame(spark, range(90), x[:90])) == 90
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "i").rglob("*.parquet")}
    assert index.add(frame(spark, range(60, 300), x[60:])) == 210  # 30 are there already; the batch opens a larger generation
    assert index.add(frame(spark, range(300), x)) == 0
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    again = VectorIndex(spark, str(tmp_path / "i"))
    assert [(b["generation"], b["room"], b["n"]) for b in again.log.log()[1:]] == [(0, 100, 90), (1, 210, 210)]
    found = again.search(asked(frame(spark, range(0, 300, 7), x[::7])), k=1).collect()
    assert {(r["query_id"], r["vec_id"], r["similarity"]) for r in found} == {(i, i, 1.0) for i in range(0, 300, 7)}


def test_odd_vectors_and_racing_writers(spark, tmp_path):
    index = VectorIndex.create(spark, str(tmp_path / "i"), 2)
    with pytest.raises(ConcurrentChange):
        VectorIndex.create(spark, str(tmp_path / "i"), 2)
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0]), (7, [None, 1.0])], "vec_id long, embedding array<double>")
    assert index.add(odd) == 1 and index.add(odd.limit(0)) == 0
    seen = index._state()
    other = VectorIndex(spark, str(tmp_path / "i"))
    other._state = lambda: seen
    assert index.add(frame(spark, [8], np.ones((1, 2)))) == 1
    with pytest.raises(ConcurrentChange):
        other.add(frame(spark, [9], np.ones((1, 2))))
    assert {r["vec_id"] for r in index.search(asked(odd), k=9).collect()} == {1, 8}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_recall_over_batches(spark, tmp_path):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>"))
    index = VectorIndex.create(spark, str(tmp_path / "i"), 64, least=500)
    for part in range(4):
        index.add(v.where(F.col("vec_id") % 4 == part))
    queries = asked(v.where("vec_id % 20 = 0"))
    exact = {(r["query_id"], r["vec_id"]) for r in match_vectors(queries, v, 5).collect()}
    found = {(r["query_id"], r["vec_id"]) for r in index.search(queries, 5).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_table_functions_answer_all_queries(spark):
    register_functions(spark)
    x = np.random.default_rng(1).normal(size=(60, 4))
    v = frame(spark, range(60), x)
    near = match_vectors(asked(v.where("vec_id < 9")), v, 40, most=200).select("query_id", F.col("vec_id").alias("id"), F.col("similarity").alias("score"), F.col("rank").alias("place"))
    want = {(r["query_id"], r["rank"], r["vec_id"]) for r in match_vectors(asked(v.where("vec_id < 9")), v, 5, floor=0.3).collect()}
    assert {(r["query_id"], r["place"], r["id"]) for r in called(spark, "match_chunks", near, "score DESC, id", 5, 0.3).collect()} == want
    assert called(spark, "match_chunks", near, "score DESC, id", 50).count() == 9 * 20 and called(spark, "semantic_search", near, "score DESC, id", -3).count() == 9
    both = spark.createDataFrame([(1, "semantic", 7, 0.5, 1), (1, "semantic", 8, 0.4, 2), (1, "lexical", 8, 0.1, 1), (1, "lexical", 9, 0.1, 2), (2, "lexical", 7, 0.3, 1)], "query_id long, branch string, id long, score double, place long")
    found = [tuple(r) for r in called(spark, "hybrid_search", both, "branch, place", 2).orderBy("query_id", "place").collect()]
    assert found == [(1, 8, 1, 2, round(1 / 61 + 1 / 62, 6), 1), (1, 7, None, 1, round(1 / 61, 6), 2), (2, 7, 1, None, round(1 / 61, 6), 1)]
    assert called(spark, "hybrid_search", both.limit(0), "branch, place").count() == 0


def test_pairs_are_handed_on_in_bounded_batches(monkeypatch):
    from tessera.operators import vectors

    monkeypatch.setattr(vectors, "PAIRS", 1000, raising=False)
    x = np.random.default_rng(2).normal(size=(400, 8))
    side = {8: (np.arange(400), x, (x * x).sum(axis=1))}
    batches = list(vectors._best(side, side, None, None))
    assert max(b.num_rows for b in batches) <= 1000
    found = {(i, j) for b in batches for i, j in zip(*(c.to_pylist() for c in b.columns[:2]), strict=True)}
    assert sum(b.num_rows for b in batches) == len(found) == 400 * 400


def test_a_search_shuffles_no_candidates(spark, tmp_path, monkeypatch):
    from tessera.operators import ann

    x = np.random.default_rng(3).normal(size=(600, 8))
    index = VectorIndex.create(spark, str(tmp_path / "i"), 8, tables=6, least=200)
    for a, b in ((0, 150), (150, 600)):
        index.add(frame(spark, range(a, b), x[a:b]))
    queries = asked(frame(spark, range(0, 600, 11), x[::11]))
    found = index.search(queries, 4)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {tuple(r) for r in found.collect()}
    want = set()
    codes = [(first, ann._codes(x[a:b], ann._planes(6, e["bits"], 8, 1)), ann._codes(x, ann._planes(6, e["bits"], 8, 1))) for (first, a, b), e in zip(((0, 0, 150), (150, 150, 600)), index.log.log()[1:], strict=True)]
    for q in range(0, 600, 11):
        near = [first + i for first, held, every in codes for i, c in enumerate(held) if any(bin(int(h ^ w)).count("1") < 2 for h, w in zip(c, every[q], strict=True))]
        scored = sorted((-round(float(x[q] @ x[v] / np.sqrt((x[q] @ x[q]) * (x[v] @ x[v]))), 6), v) for v in near)
        want |= {(q, v, -s, at) for at, (s, v) in enumerate(scored[:4], 1)}
    assert got == want
    monkeypatch.setattr(ann, "MOST_BYTES", 1 << 10)
    monkeypatch.setattr(ann, "BLOCK", 100)
    monkeypatch.setattr(ann, "PAIRS", 1000)
    assert {tuple(r) for r in index.search(queries, 4).collect()} == want
