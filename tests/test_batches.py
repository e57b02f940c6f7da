"""What a task hands on at a time is bounded by its texts' size, and nothing of it is lost."""

import pyarrow as pa
import pytest

from tessera.functions import batches
from tessera.functions.embedding import embedded, hash_embed
from tessera.operators.corpus import embedded_pending
from tessera.operators.pages import parsed, section_chunks

TEXTS = ["a b. " * 40, None, "", "c d. " * 400, *(f"e{i} f. " * 30 for i in range(40))]


def test_pieces_hold_all_rows_in_order_and_are_bounded(monkeypatch):
    monkeypatch.setattr(batches, "MOST_BYTES", 1000)
    whole = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS))), pa.array(TEXTS, pa.string())], names=["k", "t"])
    for size in (1, 3):
        cut = list(batches.pieces([whole, whole.slice(0, 0), whole], "t", size))
        assert [k for b in cut for k in b.column(0).to_pylist()] == [*range(len(TEXTS))] * 2
        assert all(b.num_rows <= size or sum(len(x or "") for x in b.column(1).to_pylist()) <= 1000 for b in cut)
        assert all(b.column(0)[0].as_py() % size == 0 for b in cut)


@pytest.fixture
def rows_out(spark, monkeypatch):
    """How many rows each batch has that a function of Arrow batches gives, called in this process."""
    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(batches, "MOST_BYTES", 1000)
    told = {}
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, f, schema, *a: told.update(f=f) or self.limit(0))
    monkeypatch.setattr(DataFrame, "mapInPandas", lambda self, f, schema, *a: pytest.fail("whole batches become Python objects"))

    def run(make, names, *columns):
        try:
            make()
        except Exception:
            assert "f" in told  # what follows the function lacks its columns here
        return [b.num_rows for b in told["f"]([pa.RecordBatch.from_arrays(list(columns), names=names)])]

    return run


def test_parsed_pages_leave_in_pieces(spark, rows_out):
    pages = spark.createDataFrame([(1, "x")], "doc_id long, markup string")
    n = rows_out(lambda: parsed(pages, ["doc_id"]), ["doc_id", "_markup"], pa.array(range(len(TEXTS))), pa.array(TEXTS, pa.string()))
    assert sum(n) == len(TEXTS) and max(n) < len(TEXTS) // 3


def test_section_chunks_leave_in_pieces(spark, rows_out):
    sections = spark.createDataFrame([], "doc_id long, title string, revision long, section long, path array<string>, content string, scope string, entity string, subjective boolean")
    n = rows_out(lambda: section_chunks(sections), ["doc_id", "section", "content"], pa.array(range(len(TEXTS))), pa.array(range(len(TEXTS))), pa.array(TEXTS, pa.string()))
    assert sum(n) >= len(TEXTS) - 2 and max(n) < len(TEXTS) // 3


def test_pending_vectors_leave_in_pieces(spark, rows_out):
    frame = spark.createDataFrame([], "k long, t string")
    columns = ["key", "text"], pa.array(range(len(TEXTS))), pa.array(TEXTS, pa.string())
    for make in (lambda: embedded_pending(frame, frame, "k", "t", size=2), lambda: embedded(frame, "k", "t")):
        n = rows_out(make, *columns)
        assert sum(n) == len(TEXTS) and max(n) < len(TEXTS) // 3


def test_pieces_change_no_result(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "k long, t string")
    want = {i: v.tolist() for i, v in enumerate(hash_embed([(x or "").replace(".", "") for x in TEXTS]))}
    assert {r["k"]: r["embedding"] for r in embedded(rows, "k", "t").collect()} == want
    assert {r["doc_id"]: [s["content"].count("a b.") for s in r["sections"]] for r in parsed(rows.select(rows.k.alias("doc_id"), rows.t.alias("markup")), ["doc_id"]).where("doc_id < 2").collect()} == {0: [40], 1: []}


def test_features_are_not_held_between_calls_and_vectors_are_those_of_each_text_alone():
    import numpy as np

    from tessera.functions import embedding

    words = [f"{a} {b} x x x" for a in "abcdefgh" for b in "stuvwxyz"]
    together = hash_embed([*words, "", None])
    assert all((v == hash_embed([w])[0]).all() for v, w in zip(together, words, strict=False)) and not np.any(together[-2:])
    assert not any(isinstance(x, dict) for n, x in vars(embedding).items() if not n.startswith("__"))
