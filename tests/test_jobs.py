"""Streams against their batch twins, snapshots, folds and approximate search."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.functions import chunks
from tessera.operators import answers, corpus, pages, retrieval, vectors
from tessera.plans import jobs
from tessera.sources.snapshot import verify_snapshot, write_snapshot
from tessera.streaming.admission import admit, admitted_batch, run_admission

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_admission_keeps_rejected_events_out():
    import pandas as pd

    rows = pd.DataFrame({"key": 1, "event_id": [1, 2, 3, 4], "at": [0.0, 1.0, 2.0, 10.5]})
    times, out = admit([], rows, 2, 10.0)
    assert out["admitted"].tolist() == [True, True, False, True] and out["retry_after"].tolist()[2] == 8.0 and times == [1.0, 10.5]


def test_batch_admission_takes_keys_one_by_one(spark):
    rows = [(k, i, float(i % 50)) for k in (1, 2, None) for i in range(100)]
    events = spark.createDataFrame(rows, "user_id long, event_id long, at double").selectExpr("user_id", "event_id", "timestamp_micros(cast(at * 1000000 as bigint)) as ts")
    want = set()
    for key in (1, 2, None):
        times = []
        for _, i, at in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            times = [x for x in times if x > at - 10]
            ok = len(times) < 3
            want.add((key, i, ok, 0.0 if ok else 10 - (at - times[0])))
            times += [at] if ok else []
    assert {tuple(r) for r in admitted_batch(events, 3, 10.0).collect()} == want


@needs_tables
def test_admission_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{SF}/events.parquet*")
    found = run_admission(stream, str(tmp_path), 3, 86400.0)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, admitted_batch(events, 3, 86400.0).collect()))


def test_late_and_repeated_events_are_judged_as_in_a_batch(spark, tmp_path):
    import random

    rng = random.Random(2)
    base = 1_700_000_000
    events = [(k, 100 * k + i, base + k * 7 + i * 37.5) for k in range(4) for i in range(40)]
    rng.shuffle(events)  # out of order by up to 25 minutes
    events += rng.sample(events, 30)
    frame = spark.createDataFrame(events, "user_id long, event_id long, at double").selectExpr("user_id", "event_id", "timestamp_micros(cast(at * 1000000 as bigint)) as ts")
    for n, rows in enumerate((frame.limit(60), frame)):  # the second file repeats the first one's events
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / f"events{n}"))
    stream = lambda: spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events*"))
    first = run_admission(stream(), str(tmp_path / "run"), 3, 300.0, late="1 hour", close=False).count()
    found = run_admission(stream(), str(tmp_path / "run"), 3, 300.0, late="1 hour")
    want = sorted(map(tuple, admitted_batch(frame, 3, 300.0).collect()))
    assert first < len(want) and sorted(map(tuple, found.collect())) == want and len(want) == 160 and {r[2] for r in want} == {True, False}


def test_snapshot_detects_tampering(spark, tmp_path):
    path = str(tmp_path / "s")
    write_snapshot({"a": spark.range(5), "b": spark.range(3)}, path)
    assert verify_snapshot(spark, path).count() == 0
    spark.range(1).select(F.lit('{"record_type": "a", "data": {"id": 9}}')).write.mode("append").option("compression", "gzip").text(f"{path}/lines")
    assert {r["issue"] for r in verify_snapshot(spark, path).collect()} == {"checksum", "count", "byte_count"}


def test_chunks_stay_under_the_limit():
    blocks = [" ".join(["w"] * n) for n in (100, 300, 200, 50, 700, 10)]
    made = chunks.chunked(blocks)
    assert all(chunks.count(c) <= 660 for c in made) and made[-1] != chunks.tail(made[-2], 60)
    assert chunks.chunked([]) == []


def test_large_blocks_split_at_sentences_unless_atomic():
    sentence = " ".join(["w"] * 199) + "."
    made = chunks.chunked([" ".join([sentence] * 7)])
    assert len(made) > 1 and all(chunks.count(c) <= 660 and c.endswith(".") for c in made)
    table = "Table:\n" + "\n".join(f"Row {i}: a: b" for i in range(300))
    assert chunks.chunked([table]) == [table] and chunks.count(table) > 600
    assert [chunks.count(c) for c in chunks.pieces(" ".join(["w"] * 1300))] == [600, 600, 100]


def test_wiki_markup():
    page = "{{Character Infobox|name=Old [[Hat|hat]]|image=x.png|health={{Value|5}}}}{{Exclusivity|Hamlet}}Lead '''text''' [[File:a.png]][[Category:Bosses]]\n==== Deep ====\n* one\n== See also ==\ngone\n=== below ===\ngone\n== Last ==\n{{Sanity|3|4}} {{Nav|x}}"
    found = pages.wikitext.parse(page)
    assert found["sections"] == [(["Overview"], "Infobox:\n- name: Old hat\n- health: 5\n\nLead text"), (["Deep"], "- one"), (["Last"], "Sanity: 3; 4")]
    assert found["categories"] == ["Bosses"] and found["hints"] == ["Hamlet"] and pages.wikitext.parse("")["sections"] == []


def test_parsed_pages_take_null_and_empty(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "x\n== A ==\ny"), (3, "x\n== A ==\ny")], "k long, markup string")
    found = sorted((r["k"], len(r["sections"])) for r in pages.parsed(rows, ["k"]).collect())
    assert found == [(1, 0), (2, 0), (3, 2), (3, 2)] and pages.parsed(rows.limit(0), ["k"]).count() == 0


VERSIONS = [(1, "active"), (2, "validating"), (3, "archived"), (4, "building")]


def _states(spark, rows=VERSIONS):
    return spark.createDataFrame([(v, status, {"note": "x", "activation": "old"}) for v, status in rows], "version long, status string, manifest map<string,string>")


def test_activation_needs_a_validating_ready_version(spark):
    ready = spark.createDataFrame([(v, v != 5, ["stale_revisions"] * (v == 5)) for v in range(1, 6)], "version long, ready boolean, findings array<string>")
    at = "2026-01-01T00:00:00+00:00"
    wanted = lambda *v: spark.createDataFrame([(x,) for x in v], "version long")
    got = {r["version"]: (r["status"], r["manifest"]) for r in corpus.activated(_states(spark), ready, wanted(2), at).collect()}
    assert {v: s for v, (s, _) in got.items()} == {1: "archived", 2: "active", 3: "archived", 4: "building"}
    assert got[2][1] == {"note": "x", "activation": '{"activated_at":"' + at + '","previous_version":1}'} and got[1][1] == {"note": "x", "activation": "old"}
    assert {r["version"]: r["status"] for r in corpus.activated(_states(spark), ready, wanted(), at).collect()} == dict(VERSIONS)
    back = {r["version"]: (r["status"], r["manifest"].get("rollback")) for r in corpus.rolled_back(_states(spark), ready, wanted(3), at).collect()}
    assert back == {1: ("archived", None), 2: ("validating", None), 3: ("active", '{"rolled_back_at":"' + at + '","replaced_version":1}'), 4: ("building", None)}
    for bad in (wanted(3), wanted(4), wanted(9), wanted(2, 3)):
        with pytest.raises(Exception, match="version"):
            corpus.activated(_states(spark), ready, bad, at).collect()
    with pytest.raises(Exception, match="not ready: stale_revisions"):
        corpus.activated(_states(spark, [*VERSIONS, (5, "validating")]), ready, wanted(5), at).collect()
    with pytest.raises(Exception, match="no version is active"):
        corpus.rolled_back(_states(spark, VERSIONS[1:]), ready, wanted(3), at).collect()
    with pytest.raises(Exception, match="more than one"):
        corpus.single_active(_states(spark, [*VERSIONS, (6, "active")])).collect()


def test_missing_manifest_keys_raise_no_finding(spark):
    versions = spark.createDataFrame([(1, "validating", {}, 1, 1), (2, "validating", {"processing_status": "failed"}, 1, 1), (3, "active", {}, 0, 0)], "version long, status string, manifest map<string,string>, chunk_count long, page_count long")
    held = spark.createDataFrame([(1, 7, True, False), (2, 7, False, True)], "version long, page_id long, embedded boolean, blank boolean")
    found = {r["version"]: r["findings"] for r in corpus.readiness(versions, held, spark.createDataFrame([(7, True)], "page_id long, is_active boolean")).collect()}
    assert found[1] == [] and found[2] == ["processing_not_passed", "missing_embeddings", "invalid_chunk_metadata"]
    assert found[3] == ["status_not_validating_or_archived", "chunk_count_mismatch", "current_page_coverage_mismatch"]


def test_a_failing_batch_marks_only_its_rows(spark):
    rows = spark.createDataFrame([(i, "" if i == 3 else f"w{i}") for i in range(8)], "doc_id long, text string").coalesce(1)
    done = spark.createDataFrame([(0,)], "doc_id long")
    found = {r["doc_id"]: (r["status"], r["embedding"] is not None) for r in corpus.embedded_pending(rows, done, "doc_id", "text", corpus.strict_embed, size=2).collect()}
    assert set(found) == set(range(1, 8)) and found[3] == ("failed", False) and sum(s == "failed" for s, _ in found.values()) == 2


def test_sync_never_lets_a_late_revision_rise(spark):
    stored = spark.createDataFrame([(1, 5), (2, 1)], "k long, rev long")
    fetched = spark.createDataFrame([(1, 5), (1, 3), (2, 4), (3, 1), (3, 1)], "k long, rev long")
    found = {(r["k"], r["rev"]): (r["is_active"], r["change"]) for r in corpus.synced(stored, fetched, ["k"], "rev").collect()}
    assert found == {(1, 5): (True, "unchanged"), (1, 3): (False, "late"), (2, 1): (False, "unchanged"), (2, 4): (True, "changed"), (3, 1): (True, "added")}


def _row(item, doc, n, title="t", section="s", tokens=100):
    return (item, doc, title, section, tokens, n)


def test_packing_skips_what_does_not_fit(spark):
    rows = [_row(1, 10, 1, "a", "x", 1700), _row(1, 11, 2, "a", "x", 200), _row(1, 12, 3, "b", "x", 100), _row(1, 13, 4, "a", "y", 50), _row(1, 14, 5, "c", "x", 50), _row(2, 20, 1), _row(2, 21, 2), _row(2, 22, 3), _row(2, 23, 4, "T2")]
    frame = spark.createDataFrame(rows, "item_id long, doc_id long, title string, section string, n_tokens long, n long")
    asked = spark.createDataFrame([(1, []), (2, ["t2"])], "item_id long, titles array<string>")
    found = {r["item_id"]: (r["used"], list(r["taken"])) for r in retrieval.packed(frame, asked).collect()}
    assert found == {1: (1800, [10, 12]), 2: (300, [23, 20, 21])}


def test_claims_are_judged_in_order(spark):
    sources = spark.createDataFrame([(1, "S1", "it weighs 12 stones", "a", True), (1, "S2", "old", "b", False)], "conv_id long, id string, content string, title string, active boolean")
    told = ["", "no sign at all here", "x [S3]", "x [S2]", "this claim is cited [S1]. this one has none at all.", "it weighs 13 stones today [S1]", "it weighs 12 stones today [S1]", "short one. [S1]"]
    found = answers.verdicts(spark.createDataFrame([(1, i, x) for i, x in enumerate(told)], "conv_id long, turn long, answer string"), sources)
    assert [r["verdict"] for r in found.orderBy("turn").collect()] == ["empty", "no_citation", "unknown_citation", "wrong_corpus", "uncited_claim", "unsupported_number", "valid", "valid"]


def test_numbered_equals_row_number(spark):
    rows = spark.createDataFrame([(None if i % 11 == 0 else f"g{i % 3 if i % 2 else 0}", i * 37 % 101, i) for i in range(300)], "g string, x long, i long")
    found = {(r["g"], r["x"], r["i"]): r["rank"] for r in answers.numbered(rows, "g", [F.desc("x"), F.col("i").asc()], ranges=7).collect()}
    want = {}
    for g in (None, "g0", "g1", "g2"):
        for n, r in enumerate(sorted((r for r in found if r[0] == g), key=lambda r: (-r[1], r[2])), 1):
            want[r] = n
    assert found == want and len(found) == 300


def test_similarities_in_blocks_equal_those_sent(spark, monkeypatch):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(60, 8))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(90, None), (91, [0.0] * 8), (92, [1.0, 2.0]), (None, [1.0] * 8)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.where("vec_id < 9 or vec_id > 80").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    one = sorted(map(tuple, vectors.match_vectors(q, v, 5).collect()))
    monkeypatch.setattr(vectors, "MOST_BYTES", 200)
    assert sorted(map(tuple, vectors.match_vectors(q, v, 5).collect())) == one
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = [(i, int(j)) for i in range(9) for j in np.lexsort((np.arange(60), -np.round(unit[i] @ unit.T, 6)))[:5]]
    assert [(a, b) for a, b, *_ in one if a < 60] == sorted(want) and [t[:2] for t in one if t[0] > 60] == [(92, 92)]


def test_ndcg_counts_each_title_once(spark):
    hits = spark.createDataFrame([(1, "a", 1, True), (1, "a", 2, True), (1, "b", 3, False)], "query_id long, title string, rank long, relevant boolean")
    expected = spark.createDataFrame([(1, 1), (2, 3), (3, 0)], "query_id long, n long")
    assert {r["query_id"]: r["ndcg"] for r in retrieval.ndcg(hits, expected).collect()} == {1: 1.0, 2: 0.0, 3: 0.0}
