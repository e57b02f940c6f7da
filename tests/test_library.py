"""Every query against its DuckDB SQL on the smallest tables, and golden values of the text functions."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera import library
from tessera.functions import text as t
from tessera.sources.sinks import upserted

SF = "/root/testdata/sf0.001"
TABLES = [p.removesuffix(".parquet") for p in os.listdir(SF)] if os.path.isdir(SF) else []


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(df):
    df = df[sorted(df.columns)]
    cell = lambda x: None if x is None or str(x) in ("nan", "<NA>", "NaT") else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) else str(x)
    return list(df.columns), sorted((tuple(map(cell, r)) for r in df.astype(object).itertuples(index=False)), key=str)


@pytest.mark.skipif(not TABLES, reason="no test tables")
@pytest.mark.parametrize("name", sorted(library.ORACLES))
def test_oracle(spark, duck, name):
    assert plain(library.QUERIES[name](spark, SF).toPandas()) == plain(duck.execute(library.ORACLES[name]).df())


def test_text_functions(spark):
    row = spark.createDataFrame([("Đặc  sản—“Phở”!",)], "s string").select(t.search_text(F.col("s")).alias("a"), t.token_count(F.col("s")).alias("b"), t.slug(F.lit("Ham Bat!")).alias("c")).first()
    assert row["a"] == "dac san- pho" and row["b"] == 7 and row["c"] == "ham-bat"


def test_word_windows_have_no_overlap_only_tail(spark):
    words = " ".join(map(str, range(560)))
    cut = t.windowed(spark.createDataFrame([(1, words), (2, ""), (3, None)], "k int, s string"), ["k"], "s").orderBy("i").collect()
    assert [len(r["ws"]) for r in cut] == [300, 300] and cut[1]["ws"][0] == "260" and {r["k"] for r in cut} == {1}


def test_text_parts(spark):
    text = "a b, c d. e"
    row = spark.createDataFrame([(text,)], "s string").select(
        t.token_tail(F.col("s"), 3).alias("tail"), t.token_tail(F.col("s"), 99).alias("all"), t.numbers(F.lit("-3,5% x-4 7 a8")).alias("n"), t.lexical_query(F.array(F.lit("a (b)"), F.lit("c"), F.lit("!"), F.lit("c"))).alias("q"), t.composed(F.lit("e\u0301")).alias("nfc"),
    ).first()
    assert row["tail"] == "d. e" and row["all"] == text and row["n"] == ["-3.5%", "4", "7"] and row["q"] == '"a b" OR c' and row["nfc"] == "é"


def test_upsert_replaces_by_key(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, upserted(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
