"""The pipeline's stages on the smallest tables."""

import os

import pytest

import corpus_pipeline
from tessera.llm._common import written

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        now = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert now and set(now) <= ids
        if name != "mixing":
            assert docs.columns == list(corpus_pipeline.COLUMNS) and len(now) == len(set(now))
        ids = set(now)


LONG = "This line is long enough to count as boilerplate in the corpus"


def odd_documents(spark):
    """Nulls, empties, copies, repeated rows, shared lines, a benchmark item and further columns whose names stages use."""
    text = lambda i: " ".join(f"w{i * 7 % 50}x{i * k % 97}" for k in range(40))
    rows = [(i, f"{text(i)}\n{LONG}", "en", f"s{i % 3}", 5) for i in range(30)]
    rows += [(100, text(1) + " " + text(2), None, None, None), (101, text(1) + " " + text(2), "en", "s1", 5), (101, text(1) + " " + text(2), "en", "s1", 5), (102, None, "en", "s1", 5), (103, "", None, None, None), (None, text(3) * 2, "en", "s2", 5), (None, None, None, None, None)]
    rows += [(200, f"{text(4)} {ITEM} {text(5)}", "en", "s0", 5), (201, "y " * 30_000, "en", "s0", 5)]
    return spark.createDataFrame([(*r, "k", 1, 0.5, True) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, key string, row int, score double, kept boolean")


ITEM = "what does the grey heron eat when the lake by the old mill is covered with ice all winter long"


@pytest.fixture(scope="module")
def odd_sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=str)


def test_stages_on_odd_rows(spark, odd_sf):
    docs = odd_documents(spark)
    stages = dict(corpus_pipeline.STAGES)
    everything = ids(docs)
    assert ids(stages["quality"](spark, docs, odd_sf)) == everything  # without labels every score is 0.5
    lines = stages["lines"](spark, docs, odd_sf)
    assert ids(lines) == everything and lines.columns == list(corpus_pipeline.COLUMNS)
    assert [r["doc_id"] for r in lines.where(lines.text.contains(LONG)).collect()] == [29]
    near = stages["near"](spark, docs, odd_sf)
    assert ids(near) == sorted((i for i in everything if i != 101), key=str)
    clean = stages["benchmark"](spark, docs, odd_sf)
    assert ids(clean) == sorted((i for i in everything if i != 200), key=str)
    mixture = stages["mixing"](spark, docs, odd_sf)
    drawn = set(ids(mixture))
    assert drawn <= set(everything) and not drawn & {102, 103} and {"epoch", "weight", "text", "lang", "n_chars"} <= set(mixture.columns)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), odd_sf).count() == 0, name
