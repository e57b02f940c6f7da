"""Glossary, tables, raw objects, cases, restore and streams on small rows, with nulls, ties and repeats."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tessera.operators.terms import completions, glossary, matched, resolved, similar, table_rows
from tessera.plans.hooks import embedded, hash_embed
from tessera.sources.raw import case_issues, raw_pages, write_report
from tessera.sources.sinks import append_unseen, write_groups, write_new, write_upsert
from tessera.sources.snapshot import restored, write_snapshot
from tessera.streaming.sync import embed_pending, sync

GLOSSARY = "english_term string, translated_term string, aliases string, term_type string, notes string, verified boolean"


def test_glossary_file(spark, tmp_path):
    (tmp_path / "g.csv").write_text("english_term,translated_term,aliases,term_type,notes,verified\nHam Bat,Gậy,nick:bat;brand:bat;nick:BAT,weapon,,true\nLog,,,item,,false\n")
    rows = {(r["entity"], r["alias"]): (r["priority"], r["verified"]) for r in glossary(spark.read.csv(str(tmp_path / "g.csv"), header=True)).collect()}
    assert rows == {("Ham Bat", "Ham Bat"): (100, True), ("Ham Bat", "Gậy"): (90, True), ("Ham Bat", "bat"): (80, True), ("Log", "Log"): (100, False)}
    with pytest.raises(ValueError):
        glossary(spark.range(1))
    assert glossary(spark.createDataFrame([], GLOSSARY)).count() == 0


def test_resolve_prefers_whole_phrases(spark):
    known = glossary(spark.createDataFrame([("Ham Bat", None, None, "w", "", True), ("Bat", "", "", "w", "", False), ("a very long name of five", "", "", "w", "", False)], GLOSSARY))
    asked = spark.createDataFrame([(1, "ham bat"), (2, "a bat here"), (3, None), (4, ""), (5, "hamm bat"), (6, "a very long name of five"), (7, "bats")], "query_id long, text string")
    found = [(r["query_id"], r["entity"], r["rank"]) for r in resolved(asked, known).orderBy("query_id", "rank").collect()]
    assert found == [(1, "Ham Bat", 1), (1, "Bat", 2), (2, "Bat", 1), (5, "Bat", 1), (5, "Ham Bat", 2), (6, "a very long name of five", 1), (7, "Bat", 1)]


STRINGS = ["bat", "ham bat", "zz", "log", "catalog", "ab", "", "hamm bats", "table", "bat", "aaaa", "aa", "goal", "abcdefgh", "abdcefhg"]


@pytest.mark.parametrize("floor", [0.55, 0.78, 1.0])
def test_similar_strings_match_brute_force(spark, floor):
    one, two = [(x,) for x in [*STRINGS, None]], [(x,) for x in STRINGS[::-1]]
    found = {(r["a"], r["b"]) for r in similar(spark.createDataFrame(one, "a string"), spark.createDataFrame(two, "b string"), floor).collect()}
    assert found == {(a, b) for a in STRINGS for b in STRINGS if a and b and SequenceMatcher(None, a, b).ratio() >= floor}


def test_matches_in_three_tiers_equal_brute_force(spark):
    names, asked = ["ham bat", "bat", "log", "catalogue", "gold bar", "ab"], ["ham bat", "my bat", "cat", "golden bar", "loggy", "xx", "ab", "ham bta"]
    known = spark.createDataFrame([(x, x, x, 10, True) for x in names], "entity string, alias string, normalized string, priority int, verified boolean")
    found = {(asked[r["query_id"]], r["normalized"]): (r["tier"], r["similarity"]) for r in matched(spark.createDataFrame(list(enumerate(asked)), "query_id long, text string"), known).collect()}
    want = {}
    for q in asked:
        for n in names:
            r = SequenceMatcher(None, q, n).ratio()
            tier = 4 if q == n else 2 if min(len(q), len(n)) >= 3 and (n.startswith(q) or q.startswith(n) or f" {n} " in f" {q} ") else 1 if r >= 0.78 else 0
            if tier:
                want[q, n] = (tier, round(1.0 if tier == 4 else r, 6))
    assert found == want


def test_completions_match_brute_force(spark):
    queries, titles = ["bat", "ham bat x", "zz", "log", "ctalog", "ab"], ["ham bat", "bat", "log", "catalog", "ab"]
    found = {(r["q"], r["title"]): r["score"] for r in completions(spark.createDataFrame([(q,) for q in queries], "q string"), spark.createDataFrame([(x,) for x in titles], "title string")).collect()}
    want = {}
    for q in queries:
        for x in titles:
            r, contains = SequenceMatcher(None, q, x).ratio(), min(len(q), len(x)) >= 3 and (q in x or x in q)
            if contains or r >= 0.55:
                want[q, x] = (1000 if q == x else 500 if q in x or x in q else 0) + round(r, 6)
    assert found == want


def test_table_rows_keep_overflow(spark):
    markup = "{| class=x\n! a !! b\n|-\n| 1 || 2 || 3\n|}"
    rows = spark.createDataFrame([(markup,), ("",), (None,)], "m string").select(table_rows(F.col("m")).alias("r")).collect()
    assert rows[0]["r"] == ["Table:", "Row 1: a: 1; b: 2; 3"] and not rows[1]["r"]


def test_raw_pages_quarantine(spark):
    good = '{"metadata": {"page_id": 1}, "response": {"query": {"pages": [{"pageid": 1, "revisions": [{"slots": {"main": {"content": "x"}}}]}]}}}'
    raw = spark.createDataFrame([(good,), (good.replace('"page_id": 1', '"page_id": 2'),), ("broken",), (None,)], "value string")
    found = {r["page_id"]: (r["content"], r["issue"]) for r in raw_pages(raw, spark.createDataFrame([(1,), (2,), (3,)], "page_id long")).collect()}
    assert found == {1: ("x", None), 2: (None, "identity"), 3: (None, "missing")}


def test_case_issues(spark):
    cases = spark.createDataFrame([(1, "entity", "answer"), (1, "entity", "answer"), (2, "unanswerable", "answer"), (3, "odd", None)], "id long, category string, expected_behavior string")
    assert sorted((r["issue"], r["id"] or 0) for r in case_issues(cases).collect()) == [("behaviour", 2), ("duplicate", 1), ("too_few", 0)]


def test_reports_are_never_overwritten(spark, tmp_path):
    write_report(spark.range(1), str(tmp_path), "k", "1")
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        write_report(spark.range(1), str(tmp_path), "k", "1")


def test_restore_rejects_a_damaged_snapshot(spark, tmp_path):
    path = str(tmp_path / "s")
    write_snapshot({"a": spark.range(3)}, path)
    assert sorted(r["id"] for r in restored(spark, path, "a", "id long").collect()) == [0, 1, 2]
    spark.range(1).select(F.lit('{"record_type": "a", "data": {}}')).write.mode("append").option("compression", "gzip").text(f"{path}/lines")
    with pytest.raises(ValueError):
        restored(spark, path, "a", "id long")


def _two_files(spark, tmp_path, first, second, schema):
    for i, rows in enumerate((first, second)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_late_revisions_do_not_win(spark, tmp_path):
    stream = _two_files(spark, tmp_path, [(1, 5, "new"), (2, 1, "a")], [(1, 3, "old"), (2, 2, "b")], "k long, rev long, v string")
    for _ in range(2):  # the second run finds nothing new
        assert sorted(map(tuple, sync(stream, str(tmp_path / "t"), ["k"], "rev").collect())) == [(1, 5, "new"), (2, 2, "b")]
    spark.createDataFrame([(2, 9, "c"), (3, 1, "d")], "k long, rev long, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert sorted(map(tuple, sync(stream, str(tmp_path / "t"), ["k"], "rev").collect())) == [(1, 5, "new"), (2, 9, "c"), (3, 1, "d")]


def test_pending_rows_are_embedded_once(spark, tmp_path):
    stream = _two_files(spark, tmp_path, [(1, "a b"), (1, "a b")], [(1, "a b"), (2, None)], "k long, text string")
    run = lambda: embed_pending(stream, str(tmp_path / "t"), "k", lambda rows: embedded(rows, "k", "text"), "k long, embedding array<double>")
    found = run().collect()
    assert sorted(map(tuple, run().collect())) == sorted(map(tuple, found))  # nothing new, nothing lost
    assert sorted(r["k"] for r in found) == [1, 2] and not any(next(r["embedding"] for r in found if r["k"] == 2))


def test_hash_vectors_are_stable_units():
    a, b, none = hash_embed(["x y z", "X  y z", None])
    assert (a == b).all() and abs((a * a).sum() - 1) < 1e-6 and not none.any()


def test_sinks_replace_only_what_they_are_told(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda *rows: spark.createDataFrame(list(rows), "k long, v string")
    write_new(frame((1, "a"), (2, "b"), (3, "c")), path, ["k"])
    read = lambda: sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect())
    write_upsert(frame((2, "B"), (4, "d")), path, ["k"])
    assert read() == [(1, "a"), (2, "B"), (3, "c"), (4, "d")]
    write_groups(frame((3, "x"), (3, "y")), path, frame((1, ""), (3, "")), "k")
    assert read() == [(2, "B"), (3, "x"), (3, "y"), (4, "d")]
    told = append_unseen(frame((4, "no"), (5, "e")), path, ["k"]).first()
    assert (told["uploaded"], told["existing"]) == (1, 1) and read()[-1] == (5, "e")


def test_texts_are_resolved_and_expanded_once(spark):
    from tessera.operators.terms import expanded_wholes, resolved_wholes

    rows = [("red ring", f"{kind}{i:02d}", i % 3 > 0) for kind in ("x", "y") for i in range(40)] + [("old ring", f"x{i:02d}", True) for i in range(40)] + [("red ring", "red ring", True), ("old ring", "old ring", True)]
    known = spark.createDataFrame([(e, a, a, 10, v) for e, a, v in rows], "entity string, alias string, normalized string, priority int, verified boolean")
    asked = spark.createDataFrame([("find red ring or old ring",), ("old ring x",), ("nothing",)] * 50, "whole string")
    found = resolved_wholes(asked, known).collect()
    assert len(found) == len({(r["whole"], r["rank"]) for r in found}) and {r["entity"] for r in found} == {"red ring", "old ring"}
    got = {r["of"]: r["terms"].split("|") for r in expanded_wholes(asked, known).collect()}
    for whole, terms in got.items():
        titles = [r["entity"] for r in sorted((r for r in found if r["whole"] == whole), key=lambda r: r["rank"])]
        want = list(dict.fromkeys([whole, *titles, *(a for title in titles for a in sorted(a for e, a, v in rows if e == title and v))]))[:12]
        assert terms == want
    assert len(got) == 3
