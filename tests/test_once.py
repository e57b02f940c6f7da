"""Jobs that use a step several times make it once."""

from pyspark.sql import functions as F

from tessera.operators import retrieval
from tessera.operators.build import build_corpus
from tessera.sources.snapshot import CORPUS, verify_snapshot, write_snapshot


def test_backfill_reads_the_held_texts_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(text):
        seen.add(1)
        return text

    docs = spark.createDataFrame([(i, f"tree number {i} stands alone") for i in range(12)], "doc_id long, text string").repartition(1)
    queries = spark.createDataFrame([(1, "river bank", ["river", "bank"]), (2, "tree number 3 stands alone", ["tree"])], "item_id long, text string, terms array<string>")
    others = spark.createDataFrame([(100, "a river bank"), (101, "nothing here")], "doc_id long, text string")
    found = retrieval.backfilled(queries, docs.select("doc_id", F.udf(told)("text").alias("text")), others, floor=0.9).collect()
    assert seen.value == 12
    assert {r["item_id"] for r in found} == {1} and min(found, key=lambda r: r["rank"])["chunk"] == 100_000_000


def test_a_builds_chunks_are_judged_once(spark):
    pages = spark.createDataFrame([("v", i, f"P{i}", 1, f"text {i % 3} is here.\n== Notes ==\nnote {i}") for i in range(6)], "version string, doc_id long, title string, revision long, markup string")
    made = build_corpus(pages)
    for df in (made.chunks, made.manifests.select("version")):
        assert "first_key" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert made.chunks.count() == made.report.first()["valid"] == 9
    assert "content" in made.chunks.columns and {r["content"].split()[-1] for r in made.chunks.collect()} == {"here.", *map(str, range(6))}


def test_verifying_reads_the_lines_for_no_rule_again(spark, tmp_path):
    path = str(tmp_path / "s")
    write_snapshot({"part": spark.range(3)}, path, "src")
    issues = verify_snapshot(spark, path, "src", CORPUS)
    assert not [f for f in issues.inputFiles() if f"{path}/lines" in f]
    assert {(r["issue"], r["of"]) for r in issues.collect()} >= {("unsupported_type", "part"), ("missing_type", "corpus")}
