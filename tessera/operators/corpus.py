"""Corpus versions, their readiness and lifecycle, incremental and embedding jobs, and the bounded crawl."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.batches import pieces
from tessera.functions.embedding import hash_embed, vector_lists
from tessera.registry import query, table
from tessera.sources.shared import new_path
from tessera.sources.sinks import unseen
from tessera.sources.versions import VersionedTable

# What keeps a corpus version from being activated, in order.
FINDINGS = (
    "status_not_validating_or_archived",
    "processing_not_passed",
    "embedding_not_passed",
    "chunk_count_mismatch",
    "page_coverage_mismatch",
    "current_page_coverage_mismatch",
    "missing_embeddings",
    "stale_revisions",
    "invalid_chunk_metadata",
)


def readiness(versions: DataFrame, chunks: DataFrame, pages: DataFrame, current: bool = True) -> DataFrame:
    """version, ready, findings, n_pages, n_chunks, missing, stale of every version.

    versions: version, status, manifest (map), chunk_count, page_count. chunks: version, page_id, embedded, blank (some
    metadata is missing). pages: page_id, is_active. current: whether all current revisions must be covered. A key that
    a manifest lacks raises no finding.
    """
    held = chunks.join(pages, "page_id").groupBy("version").agg(
        F.count_distinct("page_id").alias("n_pages"), F.count("*").alias("n_chunks"), F.count_if(~F.col("embedded")).alias("missing"), F.count_if(~F.col("is_active")).alias("stale"), F.count_if("blank").alias("invalid"),
    )
    active = pages.agg(F.count_if("is_active").alias("active"))  # one row
    zero = F.lit(0).cast("long")
    rows = versions.join(held, "version", "left").crossJoin(F.broadcast(active)).withColumns({c: F.coalesce(c, zero) for c in ("n_pages", "n_chunks", "missing", "stale", "invalid")})
    told = lambda key: F.try_element_at("manifest", F.lit(key)) != "passed"
    need = F.lit(current)
    failed = [
        ~F.col("status").isin("validating", "archived"), told("processing_status"), told("embedding_status"), (F.col("n_chunks") == 0) | (F.col("n_chunks") != F.col("chunk_count")), F.col("n_pages") != F.col("page_count"),
        need & (F.col("n_pages") != F.col("active")), F.col("missing") > 0, need & (F.col("stale") > 0), F.col("invalid") > 0,
    ]
    rows = rows.withColumn("findings", F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in zip(FINDINGS, failed, strict=True)))))
    return rows.select("version", (F.size("findings") == 0).alias("ready"), "findings", "n_pages", "n_chunks", "missing", "stale")


def single_active(versions: DataFrame) -> DataFrame:
    """active, n_active: the active version, if any; two of them are an error."""
    row = versions.agg(F.max(F.when(F.col("status") == "active", F.col("version"))).alias("active"), F.count_if(F.col("status") == "active").alias("n_active"))
    return row.where(F.assert_true(F.col("n_active") <= 1, "more than one active version").isNull())


def _moved(versions: DataFrame, ready: DataFrame, wanted: DataFrame, required: str, needs_active: bool, stamp: Callable[[Column], Column], key: str, at: str) -> DataFrame:
    one = wanted.agg(F.count("*").alias("asked"), F.max("version").alias("target"))
    states = versions.select(F.col("version").alias("v"), F.col("status").alias("was")).join(ready.select(F.col("version").alias("rv"), "ready", "findings"), F.col("v") == F.col("rv"), "left")
    target = one.join(states, F.col("target") == F.col("v"), "left").crossJoin(single_active(versions))  # one row
    none = F.col("target").isNull()
    checks = {
        "one version at a time": F.col("asked") <= 1, "the version does not exist": none | F.col("was").isNotNull(), f"the version must be {required}": none | (F.col("was") == required),
        "the version is not ready": none | F.coalesce("ready", F.lit(False)), "no version is active": none | F.lit(not needs_active) | F.col("active").isNotNull(),
    }
    for text, holds in checks.items():
        told = F.concat(F.lit(f"{text}: "), F.array_join("findings", ",")) if text.endswith("ready") else F.lit(text)
        target = target.where(F.assert_true(holds, told).isNull())
    target = target.select("target", "active")
    rows = versions.crossJoin(F.broadcast(target))  # with one row
    rises, falls = F.coalesce(F.col("version") == F.col("target"), F.lit(False)), F.col("target").isNotNull() & (F.col("status") == "active")
    status = F.when(rises, "active").when(falls, "archived").otherwise(F.col("status"))
    stamped = F.map_from_entries(F.array(F.struct(F.lit(key), stamp(F.lit(at)))))
    manifest = F.when(rises, F.map_concat(F.map_filter("manifest", lambda k, _: k != key), stamped)).otherwise(F.col("manifest"))
    return rows.select("version", status.alias("status"), manifest.alias("manifest"), *(c for c in versions.columns if c not in ("version", "status", "manifest")))


def activated(versions: DataFrame, ready: DataFrame, wanted: DataFrame, at: str) -> DataFrame:
    """versions after the wanted one (one row, or none: nothing changes) has become active.

    It must be validating and ready, and the active one, if any, is archived with it; anything else is an error and
    leaves all as it is. The manifest gets `activation`: when, and which version it follows. ready: readiness with
    current revisions.
    """
    stamp = lambda at: F.to_json(F.struct(at.alias("activated_at"), F.col("active").alias("previous_version")))
    return _moved(versions, ready, wanted, "validating", False, stamp, "activation", at)


def rolled_back(versions: DataFrame, ready: DataFrame, wanted: DataFrame, at: str) -> DataFrame:
    """As activated, for an archived version that takes the place of the active one; `rollback` says which it replaced.

    ready: readiness without current revisions.
    """
    stamp = lambda at: F.to_json(F.struct(at.alias("rolled_back_at"), F.col("active").alias("replaced_version")))
    return _moved(versions, ready, wanted, "archived", True, stamp, "rollback", at)


def switch(store: VersionedTable, chunks: DataFrame, pages: DataFrame, version, back: bool = False, at: str | None = None) -> int:
    """Activates a version (or rolls back to it) in a stored table of versions; the number of the new table.

    Readiness is judged on the table that was read, and if another has been committed meanwhile the switch is an error
    (ConcurrentChange) that leaves that one in place. None for version changes nothing.
    """
    number, versions = store.read()
    if versions is None:
        raise ValueError("the table of versions is empty")
    if version is None:
        return number
    at = at or datetime.now(timezone.utc).isoformat()
    wanted = versions.sparkSession.range(1).select(F.lit(version).cast(versions.schema["version"].dataType).alias("version"))
    moved = (rolled_back if back else activated)(versions, readiness(versions, chunks, pages, current=not back), wanted, at)
    return store.commit(number, moved, {"action": "rollback" if back else "activation", "version": str(version), "at": at})


def _corpus(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Versions, chunks and pages: sources are versions of `documents`, whose last digit is the page; a few belong to a page that isn't current."""
    page = F.when(F.col("doc_id") % 97 == 5, 100).otherwise(F.col("doc_id") % 10)
    docs = table(spark, sf, "documents").where("source is not null").select(F.substring("source", 4, 9).cast("long").alias("version"), page.cast("long").alias("page_id"), "doc_id", (F.col("doc_id") % 211 != 3).alias("embedded"), ((F.trim(F.coalesce("text", F.lit(""))) == "") | F.col("lang").isNull()).alias("blank"))
    pages = docs.select("page_id").union(spark.range(10).select("id")).union(spark.range(100, 101).select("id")).distinct().select("page_id", (F.col("page_id") < 10).alias("is_active"))
    n = F.col("version")
    status = F.when(n == 4, "active").when(n == 13, "building").when(n % 2 == 0, "validating").otherwise("archived")
    manifest = F.map_filter(F.create_map(F.lit("processing_status"), F.when(n % 5 == 3, "failed").when(n % 5 != 4, "passed"), F.lit("embedding_status"), F.when(n % 7 == 6, "partial").otherwise("passed")), lambda _, v: v.isNotNull())
    made = docs.groupBy("version").agg((F.count("*") + F.when(F.first("version") % 6 == 5, 1).otherwise(0)).alias("chunk_count"), (F.count_distinct("page_id") + F.when(F.first("version") % 9 == 8, 1).otherwise(0)).alias("page_count"))
    return made.select("version", status.alias("status"), manifest.alias("manifest"), "chunk_count", "page_count"), docs, pages


_V = """c0 AS (SELECT substr(source, 4)::BIGINT AS version, CASE WHEN doc_id % 97 = 5 THEN 100 ELSE doc_id % 10 END AS page_id, doc_id % 211 <> 3 AS embedded, trim(coalesce(text, '')) = '' OR lang IS NULL AS blank FROM documents WHERE source IS NOT NULL),
v AS (SELECT version, CASE WHEN version = 4 THEN 'active' WHEN version = 13 THEN 'building' WHEN version % 2 = 0 THEN 'validating' ELSE 'archived' END AS status, count(*) AS n_chunks, count(DISTINCT page_id) AS n_pages, count(*) FILTER (NOT embedded) AS missing,
 count(*) FILTER (page_id = 100) AS stale, count(*) FILTER (blank) AS invalid FROM c0 GROUP BY version)"""


def _findings(current: bool) -> str:
    more = ", CASE WHEN n_pages <> 10 THEN 'current_page_coverage_mismatch' END" if current else ""
    stale = "CASE WHEN stale > 0 THEN 'stale_revisions' END, " if current else ""
    return f"""list_filter([CASE WHEN status NOT IN ('validating', 'archived') THEN 'status_not_validating_or_archived' END, CASE WHEN version % 5 = 3 THEN 'processing_not_passed' END, CASE WHEN version % 7 = 6 THEN 'embedding_not_passed' END,
 CASE WHEN version % 6 = 5 THEN 'chunk_count_mismatch' END, CASE WHEN version % 9 = 8 THEN 'page_coverage_mismatch' END{more}, CASE WHEN missing > 0 THEN 'missing_embeddings' END, {stale}CASE WHEN invalid > 0 THEN 'invalid_chunk_metadata' END], lambda x: x IS NOT NULL)"""


_READY = f"r AS (SELECT *, {_findings(True)} AS findings, {_findings(False)} AS archived_findings FROM v)"


@query(f"WITH {_V} SELECT count(*)::BIGINT AS versions, sum(n_chunks)::BIGINT AS chunks, sum(n_pages)::BIGINT AS pages, sum(missing)::BIGINT AS missing, sum(stale)::BIGINT AS stale FROM v")
def agg_readiness_counts(spark, sf):
    found = readiness(*_corpus(spark, sf))
    return found.agg(F.count("*").alias("versions"), F.sum("n_chunks").alias("chunks"), F.sum("n_pages").alias("pages"), F.sum("missing").alias("missing"), F.sum("stale").alias("stale"))


@query(f"WITH {_V}, {_READY} SELECT version, len(findings) = 0 AS ready, array_to_string(findings, ',') AS findings, array_to_string(archived_findings, ',') AS archived_findings FROM r")
def agg_readiness_findings(spark, sf):
    """With and without the need to cover current revisions."""
    corpus = _corpus(spark, sf)
    archived = readiness(*corpus, current=False).select("version", F.array_join("findings", ",").alias("archived_findings"))
    return readiness(*corpus).join(archived, "version").select("version", "ready", F.array_join("findings", ",").alias("findings"), "archived_findings")


def _switched(spark, sf, back: bool) -> DataFrame:
    versions, chunks, pages = _corpus(spark, sf)
    store = VersionedTable(spark, new_path(spark, "versions"))
    store.commit(0, versions)
    ready = readiness(versions, chunks, pages, current=not back).where("ready")
    first = versions.where(F.col("status") == ("archived" if back else "validating")).join(ready, "version").agg(F.min("version")).first()[0]
    switch(store, chunks, pages, first, back)
    _, now = store.read()
    told = F.get_json_object(F.try_element_at("manifest", F.lit("rollback" if back else "activation")), "$.replaced_version" if back else "$.previous_version")
    return now.select("version", "status", told.cast("long").alias("replaced"))


@query(f"""WITH {_V}, {_READY}, t AS (SELECT min(version) AS t FROM r WHERE status = 'validating' AND len(findings) = 0)
 SELECT version, CASE WHEN version = t THEN 'active' WHEN status = 'active' AND t IS NOT NULL THEN 'archived' ELSE status END AS status, CASE WHEN version = t THEN (SELECT max(version) FROM v WHERE status = 'active') END AS replaced FROM v, t""")
def life_activate(spark, sf):
    """The first version that may rise does, in a stored table of versions that is read back."""
    return _switched(spark, sf, back=False)


@query(f"""WITH {_V}, {_READY}, t AS (SELECT min(version) AS t FROM r WHERE status = 'archived' AND len(archived_findings) = 0)
 SELECT version, CASE WHEN version = t THEN 'active' WHEN status = 'active' AND t IS NOT NULL THEN 'archived' ELSE status END AS status, CASE WHEN version = t THEN (SELECT max(version) FROM v WHERE status = 'active') END AS replaced FROM v, t""")
def life_rollback(spark, sf):
    return _switched(spark, sf, back=True)


@query(f"WITH {_V} SELECT max(version) FILTER (status = 'active') AS active, count(*) FILTER (status = 'active')::BIGINT AS n_active FROM v")
def life_single_active(spark, sf):
    return single_active(_corpus(spark, sf)[0])


@query(f"WITH {_V} SELECT max(version) FILTER (status = 'active') AS active, count(*) FILTER (status = 'active')::BIGINT AS n_active, max(n_chunks) FILTER (status = 'active')::BIGINT AS chunks, count(*) FILTER (status = 'validating')::BIGINT AS validating, count(*) FILTER (status = 'archived')::BIGINT AS archived FROM v")
def agg_corpus_status(spark, sf):
    """One public row; two active versions are an error."""
    versions = _corpus(spark, sf)[0]
    of = lambda s: F.count_if(F.col("status") == s)
    counts = versions.agg(F.max(F.when(F.col("status") == "active", F.col("chunk_count"))).alias("chunks"), of("validating").alias("validating"), of("archived").alias("archived"))
    return single_active(versions).crossJoin(counts)  # one row each


def synced(stored: DataFrame, fetched: DataFrame, keys: list[str], revision: str) -> DataFrame:
    """The new state of a table of revisions: keys, revision, is_active, change and attributed, after fetched ones are kept.

    Stored revisions are never replaced; the highest of each key is active, all others aren't. change: added, changed
    (a newer revision than those stored), late (an older one) or unchanged for what was stored; each new revision is
    attributed once.
    """
    new = unseen(fetched.select(*keys, revision).distinct(), stored, [*keys, revision]).withColumn("new", F.lit(True))
    every = stored.select(*keys, revision).distinct().withColumn("new", F.lit(False)).union(new)
    of = Window.partitionBy(*keys)
    known = F.max(F.when(~F.col("new"), F.col(revision))).over(of)
    change = F.when(~F.col("new"), "unchanged").when(known.isNull(), "added").when(F.col(revision) > known, "changed").otherwise("late")
    return every.select(*keys, revision, (F.col(revision) == F.max(revision).over(of)).alias("is_active"), change.alias("change"), F.col("new").alias("attributed"))


@query("""WITH e AS (SELECT user_id, event_type, event_id, event_id % 3 <> 0 AS new FROM events), w AS (SELECT *, max(event_id) FILTER (NOT new) OVER (PARTITION BY user_id, event_type) AS known, max(event_id) OVER (PARTITION BY user_id, event_type) AS top FROM e)
 SELECT user_id, event_type, event_id, event_id = top AS is_active, CASE WHEN NOT new THEN 'unchanged' WHEN known IS NULL THEN 'added' WHEN event_id > known THEN 'changed' ELSE 'late' END AS change, new AS attributed FROM w""")
def job_incremental_sync(spark, sf):
    """A third of the events is stored already; all are fetched."""
    events = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    return synced(events.where("event_id % 3 = 0"), events, ["user_id", "event_type"], "event_id")


def sync_summary(state: DataFrame, fetched: DataFrame, keys: list[str], revision: str, errors: DataFrame | None = None) -> DataFrame:
    """One row on a run: status, pages_discovered, pages_fetched, pages_changed, pages_added, pages_late, pages_unchanged, objects_uploaded, objects_existing, errors.

    state: what `synced` gave. A page's revision that was stored already is unchanged; each new one is an object to
    upload. errors: pages that could not be fetched; with any the run has failed.
    """
    got = fetched.select(*keys, revision).distinct().join(state, [*keys, revision], "left")
    n = lambda what: F.count_if(F.coalesce(what, F.lit(False)))
    row = got.agg(
        F.count_distinct(*keys).alias("pages_discovered"), F.count("*").alias("pages_fetched"), n(F.col("change") == "changed").alias("pages_changed"), n(F.col("change") == "added").alias("pages_added"), n(F.col("change") == "late").alias("pages_late"),
        n(F.col("change") == "unchanged").alias("pages_unchanged"), n(F.col("attributed")).alias("objects_uploaded"), n(~F.col("attributed")).alias("objects_existing"),
    )
    row = row.crossJoin(errors.agg(F.count("*").alias("errors")) if errors is not None else row.sparkSession.range(1).select(F.lit(0).cast("long").alias("errors")))  # one row each
    return row.select(F.when(F.col("errors") > 0, "failed").otherwise("succeeded").alias("status"), *row.columns)


@query("""WITH e AS (SELECT user_id, event_type, event_id, event_id % 3 <> 0 AS new FROM events), w AS (SELECT *, max(event_id) FILTER (NOT new) OVER (PARTITION BY user_id, event_type) AS known FROM e)
 SELECT CASE WHEN (SELECT count(*) FROM events WHERE value IS NULL) > 0 THEN 'failed' ELSE 'succeeded' END AS status, (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events))::BIGINT AS pages_discovered, count(*)::BIGINT AS pages_fetched, count(*) FILTER (new AND event_id > known)::BIGINT AS pages_changed,
 count(*) FILTER (new AND known IS NULL)::BIGINT AS pages_added, count(*) FILTER (new AND event_id < known)::BIGINT AS pages_late, count(*) FILTER (NOT new)::BIGINT AS pages_unchanged, count(*) FILTER (new)::BIGINT AS objects_uploaded, count(*) FILTER (NOT new)::BIGINT AS objects_existing, (SELECT count(*) FROM events WHERE value IS NULL)::BIGINT AS errors FROM w""")
def agg_sync_summary(spark, sf):
    """The report of job_incremental_sync's run; events without a value stand for pages that could not be fetched as well."""
    events = table(spark, sf, "events")
    fetched = events.select("user_id", "event_type", "event_id")
    return sync_summary(job_incremental_sync(spark, sf), fetched, ["user_id", "event_type"], "event_id", events.where("value is null"))


def embedded_pending(rows: DataFrame, done: DataFrame, key: str, text: str, embed: Callable[[list[str]], list] = hash_embed, size: int = 16) -> DataFrame:
    """key, embedding, status, error of the rows that have no vector yet, in batches of `size`; a batch that fails marks its rows, no others."""

    def each(batches):
        for batch in pieces(batches, "text", size):
            texts, vectors, errors = batch.column("text").to_pylist(), [], []
            for at in range(0, len(texts), size):
                part = texts[at : at + size]
                try:
                    vectors += [*embed(part)]
                    errors += [None] * len(part)
                except Exception as e:  # whatever a model raises is the batch's error
                    vectors += [None] * len(part)
                    errors += [str(e)] * len(part)
            status = pa.array(["embedded" if e is None else "failed" for e in errors])
            yield pa.RecordBatch.from_arrays([batch.column("key"), vector_lists(vectors), status, pa.array(errors, pa.string())], names=["key", "embedding", "status", "error"])

    pending = unseen(rows.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), done.select(F.col(key).alias("key")), ["key"])
    return pending.mapInArrow(each, "key long, embedding array<double>, status string, error string").withColumnRenamed("key", key)


def strict_embed(texts: list[str]) -> list:
    """hash_embed that refuses texts without words."""
    if not all((x or "").strip() for x in texts):
        raise ValueError("a text has no words")
    return hash_embed(texts)


def _pending(spark, sf) -> DataFrame:
    """Documents that have no vector; some are blanked."""
    docs = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 40 == 7, "").otherwise(F.col("text")).alias("text"))
    done = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return embedded_pending(docs, done, "doc_id", "text", strict_embed, size=1)


@query("""SELECT status, coalesce(error, '') AS error, count(*)::BIGINT AS n, sum(has)::BIGINT AS vectors FROM (SELECT CASE WHEN doc_id % 40 = 7 OR trim(text) = '' THEN 'failed' ELSE 'embedded' END AS status,
 CASE WHEN doc_id % 40 = 7 OR trim(text) = '' THEN 'a text has no words' END AS error, CASE WHEN doc_id % 40 = 7 OR trim(text) = '' THEN 0 ELSE 1 END AS has FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) GROUP BY ALL""")
def job_embed_pending(spark, sf):
    found = _pending(spark, sf)
    return found.groupBy("status", F.coalesce("error", F.lit("")).alias("error")).agg(F.count("*").alias("n"), F.count("embedding").alias("vectors"))


@query("""SELECT n AS chunks, e AS embedded, n - e AS missing, CASE WHEN e = n THEN 'passed' WHEN e > 0 THEN 'partial' ELSE 'failed' END AS status FROM (SELECT count(*) AS n, count(*) FILTER (vec_id IS NOT NULL) AS e FROM documents LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) ON vec_id = doc_id)""")
def agg_embedding_status(spark, sf):
    """Chunks of documents and those that have a vector."""
    done = table(spark, sf, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("has")).distinct()
    n, has = F.count("*"), F.count("has")
    row = table(spark, sf, "documents").select("doc_id").join(done, "doc_id", "left").agg(n.alias("chunks"), has.alias("embedded"))
    missing = F.col("chunks") - F.col("embedded")
    return row.select("chunks", "embedded", missing.alias("missing"), F.when(missing == 0, "passed").when(F.col("embedded") > 0, "partial").otherwise("failed").alias("status"))
