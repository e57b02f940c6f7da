"""Snapshot contracts, one issue for each violated rule, and restores that are whole or leave a failed version."""

import json
import pathlib

import pytest

from tessera.plans.restore import CHUNKS, PAGES, VERSIONS, restore
from tessera.sources.snapshot import CORPUS, Contract, SnapshotError, verify_snapshot, write_snapshot
from tessera.sources.versions import TableSet


def corpus(spark, **other):
    frame = spark.createDataFrame
    tables = {
        "corpus": frame([("src", "active", "m", 2, 3, {"note": "x", "restore": "old"})], VERSIONS), "embedding_model": frame([("m", 4)], "model string, dims int"),
        "wiki_page": frame([("a", 1, 10, "A", True), ("b", 2, 20, "B", True), ("c", 2, 21, "B", True)], PAGES), "source_attribution": frame([("a", "u")], "page string, url string"),
        "entity_alias": frame([("e", "x")], "entity string, alias string"), "document_chunk": frame([("src", "k1", "a", "t"), ("src", "k2", "b", "t"), ("src", "k3", "c", "t")], CHUNKS),
    }
    return {n: df for n, df in {**tables, **other}.items() if df is not None}


def issues(spark, path, **more):
    return sorted({r["issue"] for r in verify_snapshot(spark, path, "src", CORPUS, **more).collect()})


def test_a_sound_snapshot_and_its_manifest(spark, tmp_path):
    path = str(tmp_path / "s")
    write_snapshot(corpus(spark, entity_alias=spark.createDataFrame([], "entity string, alias string")), path, "src", embeddings=True, created_at="T")
    told = json.loads(next((tmp_path / "s" / "manifest").glob("part-*.json")).read_text())
    assert told["record_counts"] == {"corpus": 1, "embedding_model": 1, "wiki_page": 3, "source_attribution": 1, "entity_alias": 0, "document_chunk": 3}
    assert (told["schema_version"], told["corpus_version"], told["includes_embeddings"], told["created_at"], len(told["sha256"])) == (1, "src", True, "T", 64)
    assert told["byte_count"] == sum(f.stat().st_size for f in (tmp_path / "s" / "lines").glob("*.gz"))
    assert issues(spark, path) == []
    with pytest.raises(Exception, match="already exists"):
        write_snapshot(corpus(spark), path, "src")


@pytest.mark.parametrize(("change", "want"), [
    ({"wiki_page": None}, ["missing_type"]), ({"entity_alias": None}, []), ({"other": "one"}, ["unsupported_type"]), ({"corpus": "twice"}, ["singleton"]), ({"version": "else"}, ["source_version"]),
    ({"schema": 2}, ["schema_version"]), ({"counts": 9}, ["count"]), ({"manifest": "gone"}, ["byte_count", "count", "manifest"]), ({"line": "x"}, ["byte_count", "checksum", "line"]), ({"bytes": 1}, ["byte_count"]),
])
def test_one_issue_for_each_rule(spark, tmp_path, change, want):
    path, kind, value = str(tmp_path / "s"), *next(iter(change.items()))
    tables = corpus(spark)
    if value is None:
        tables.pop(kind)
    if kind == "other":
        tables["other"] = spark.range(1)
    if value == "twice":
        tables["corpus"] = tables["corpus"].union(tables["corpus"])
    write_snapshot(tables, path, value if kind == "version" else "src")
    file = next((tmp_path / "s" / "manifest").glob("part-*.json"))
    told = json.loads(file.read_text())
    edits = {"schema": ("schema_version", value), "bytes": ("byte_count", value), "counts": ("record_counts", {**told["record_counts"], "wiki_page": value})}
    if kind in edits:
        told[edits[kind][0]] = edits[kind][1]
    for crc in (tmp_path / "s" / "manifest").glob(".*.crc"):
        crc.unlink()
    file.write_text("broken" if kind == "manifest" else json.dumps(told))
    if kind == "line":
        spark.createDataFrame([(value,)], "line string").coalesce(1).write.mode("append").option("compression", "gzip").text(f"{path}/lines")
    assert issues(spark, path) == want
    assert verify_snapshot(spark, path, contract=Contract()).where("issue in ('missing_type', 'unsupported_type', 'singleton', 'source_version')").count() == 0


def store(spark, folder):
    held = TableSet(spark, folder)
    held.commit(0, {"pages": spark.createDataFrame([("old", 1, 9, "A", True), ("z", 3, 1, "Z", True), ("b0", 2, 19, "B", False)], PAGES)})
    return held


def test_restore_keeps_current_revisions(spark, tmp_path):
    path, held = str(tmp_path / "s"), store(spark, str(tmp_path / "t"))
    write_snapshot(corpus(spark), path, "src")
    assert restore(spark, path, held, "src", "next", at="T") == 2
    pages = {(r["page_id"], r["revision"]): (r["is_active"], r["id"]) for r in held.read("pages", PAGES).collect()}
    assert {k: v[0] for k, v in pages.items()} == {(1, 9): True, (3, 1): True, (2, 19): False, (1, 10): False, (2, 20): False, (2, 21): True}
    assert {(r["source_key"], r["page"]) for r in held.read("chunks", CHUNKS).where("version = 'next'").collect()} == {("k1", pages[1, 10][1]), ("k2", pages[2, 20][1]), ("k3", pages[2, 21][1])}
    row = held.read("versions", VERSIONS).first()
    assert (row["version"], row["status"], row["page_count"], row["manifest"]["note"]) == ("next", "validating", 2, "x")
    assert json.loads(row["manifest"]["restore"]).items() >= {"source_version": "src", "restored_at": "T"}.items()
    write_snapshot(corpus(spark), str(tmp_path / "s2"), "src")
    restore(spark, str(tmp_path / "s2"), held, "src", "again")
    assert held.read("pages", PAGES).count() == 6 and held.read("chunks", CHUNKS).count() == 6
    for source, target in (("src", "next"), ("src", "src"), ("", "x"), ("other", "x")):
        with pytest.raises(SnapshotError):
            restore(spark, path, held, source, target)


def test_a_damaged_part_leaves_a_failed_version_and_nothing_else(spark, tmp_path):
    held = store(spark, str(tmp_path / "t"))
    before = held.state()[1]
    path = str(tmp_path / "s")
    write_snapshot(corpus(spark, document_chunk=spark.createDataFrame([("src", "k", "nowhere", "t")], CHUNKS)), path, "src")
    with pytest.raises(Exception, match="unknown page"):
        restore(spark, path, held, "src", "next")
    _, now = held.state()
    assert now["pages"] == before["pages"] and "chunks" not in now and held.read("versions", VERSIONS).first()["status"] == "failed"
    assert len(list(pathlib.Path(held.folder).glob("data-*"))) == 2
    damaged = str(tmp_path / "d")
    write_snapshot(corpus(spark), damaged, "src")
    next((tmp_path / "d" / "lines").glob("*.gz")).unlink()
    number = held.state()[0]
    with pytest.raises(SnapshotError, match="checksum"):
        restore(spark, damaged, held, "src", "third")
    assert held.state()[0] == number
