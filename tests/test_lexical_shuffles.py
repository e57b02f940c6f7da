"""What the postings' build sorts in a task, and what a search sends of the postings."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.operators import lexical
from tessera.operators.retrieval import set_token_overlap


def test_a_task_of_the_build_has_a_few_shards_however_many_there_are(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("tree river tree w"), F.col("id") % 50).alias("text"))
    index = lexical.index_of(docs, 500)
    shards = index.agg(F.countDistinct("shard")).first()[0]
    assert shards > 50
    # Every file is from one task, by words in order.
    files = [pq.read_table(f.removeprefix("file://"), columns=["shard", "term"], partitioning=None) for f in index.inputFiles()]
    assert max(len(f["shard"].unique()) for f in files) <= 16 < shards
    assert all(f["term"].to_pylist() == sorted(f["term"].to_pylist()) for f in files)
    trees = index.where("term = 'tree'").agg(F.sum("df"), F.sum(F.size("docs")), F.count_distinct("shard")).first()
    assert tuple(trees) == (3000, 6000, shards)


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_places_travel_for_phrases_only(spark, monkeypatch, most):
    def told(k):
        def search(postings, queries):
            rows = [r for r in postings.to_pylist() if queries.num_rows]
            return pa.table([pa.array([{"tree": 1, "river": 2, "bank": 3}[r["term"]] for r in rows], pa.int64()), pa.array([r["shard"] for r in rows], pa.int64()), pa.array([len(r["at"]) for r in rows], pa.int32()), pa.array([len(r["docs"]) for r in rows], pa.int64())], schema=lexical._FOUND)

        return search

    monkeypatch.setattr(lexical, "searcher", told)
    monkeypatch.setattr(lexical, "MOST_BYTES", most)
    docs = spark.createDataFrame([(i, "tree tree river tree river bank river") for i in range(40)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, ["tree", "river"]), (2, ["bank", "river bank"])], "item_id long, terms array<string>")
    found = lexical.lexical_matches(asked, lexical.index_of(docs)).groupBy("item_id").agg(F.sum("n"), F.sum("looked_at")).collect()
    assert {tuple(r) for r in found} == {(1, 0, 40), (2, 120, 120), (3, 40, 40)}


def test_shares_of_words_with_repeats_and_odd_texts(spark, tmp_path):
    docs = [(1, "River bank, river BANK river"), (2, None), (3, ""), (4, "bank"), (5, "Üb river-bed tree")]
    items = [(1, "river river bank tree"), (2, "ub"), (3, "nowhere"), (4, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {(r["item_id"], r["doc_id"]): r["overlap"] for r in set_token_overlap(spark, str(tmp_path)).collect()}
    assert found == {(1, 1): round(2 / 3, 6), (1, 4): round(1 / 3, 6), (1, 5): round(1 / 3, 6), (2, 5): 1.0}
