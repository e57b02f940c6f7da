"""Snapshots of a corpus, their verification, and restoring one under a new version."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.registry import query, table
from tessera.sources.shared import new_path, written
from tessera.sources.snapshot import CORPUS, SnapshotError, manifest, records, sound, verify_snapshot, write_snapshot
from tessera.sources.versions import TableSet

# What the tables of a corpus store hold. Ids are hashes of natural keys, so that a repeated import gives the same ones.
VERSIONS = "version string, status string, model string, page_count long, chunk_count long, manifest map<string,string>"
PAGES = "id string, page_id long, revision long, title string, is_active boolean"
ALIASES = "entity string, alias string"
ATTRIBUTIONS = "page string, url string"
CHUNKS = "version string, source_key string, page string, content string"
MODELS = "model string, dims int"


def _page_key() -> Column:
    return F.sha2(F.concat_ws(":", F.col("page_id").cast("string"), F.col("revision").cast("string")), 256)


def imported_pages(stored: DataFrame, fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table of pages after an import, and old_id, id of the imported ones.

    A stored revision keeps its row. A new one is active only if its page has no current revision stored, and of several
    new ones the highest.
    """
    known = stored.select("page_id", "revision", F.col("id").alias("known"))
    of = fetched.select(F.col("id").alias("old_id"), "page_id", "revision", "title").join(known, ["page_id", "revision"], "left")
    ids = of.select("old_id", F.coalesce("known", _page_key()).alias("id"))
    new = of.where("known is null").dropDuplicates(["page_id", "revision"])
    current = stored.where("is_active").select("page_id").distinct().withColumn("has", F.lit(True))
    top = new.groupBy("page_id").agg(F.max("revision").alias("top"))
    active = F.col("has").isNull() & (F.col("revision") == F.col("top"))
    new = new.join(top, "page_id").join(current, "page_id", "left").select(_page_key().alias("id"), "page_id", "revision", "title", active.alias("is_active"))
    return stored.unionByName(new), ids


def restore(spark: SparkSession, path: str, store: TableSet, source: str, target: str, at: str | None = None) -> int:
    """Imports a snapshot of version `source` as version `target`, validating; the number of the new state.

    The snapshot is verified first; one that violates a rule is an error and changes nothing. Pages, aliases,
    attributions, chunks and the version's row become visible in one commit. If the import fails, the only trace is a
    row of the version with status failed, and the error is raised.
    """
    if not source.strip() or not target.strip() or source == target:
        raise SnapshotError("source and target must be two versions")
    sound(spark, path, source, CORPUS)
    number, tables = store.state()
    versions = store.read("versions", VERSIONS, tables)
    if not versions.where(F.col("version") == target).isEmpty():
        raise SnapshotError(f"version {target} exists")
    at = at or datetime.now(timezone.utc).isoformat()
    told = manifest(spark, path).first()  # one row
    corpus = records(spark, path, "corpus", VERSIONS)
    stamp = F.to_json(F.struct(F.lit(source).alias("source_version"), F.lit(at).alias("restored_at"), F.lit(told["sha256"]).alias("snapshot_sha256")))
    prior = F.map_filter(F.coalesce("manifest", F.create_map().cast("map<string,string>")), lambda k, _: k != "restore")
    row = corpus.select(F.lit(target).alias("version"), F.lit("validating").alias("status"), "model", "page_count", "chunk_count", F.map_concat(prior, F.create_map(F.lit("restore"), stamp)).alias("manifest"))
    try:
        # What several tables are made from is read from the lines once.
        held = lambda kind, schema: written(records(spark, path, kind, schema), kind)
        pages, ids = imported_pages(store.read("pages", PAGES, tables), held("wiki_page", PAGES))
        ids = written(ids, "ids")
        union = lambda name, schema, new, keys: new.dropDuplicates(keys).unionByName(store.read(name, schema, tables).join(new.select(*keys), keys, "left_anti"))
        aliases = union("aliases", ALIASES, held("entity_alias", ALIASES), ["entity", "alias"])
        models = union("models", MODELS, held("embedding_model", MODELS), ["model"])
        moved = lambda df: df.withColumnRenamed("page", "old_id").join(ids, "old_id", "left").withColumn("page", F.when(F.assert_true(F.col("id").isNotNull(), F.concat(F.lit("unknown page: "), "old_id")).isNull(), F.col("id")))
        attributions = union("attributions", ATTRIBUTIONS, written(moved(records(spark, path, "source_attribution", ATTRIBUTIONS)).select("page", "url"), "attributions"), ["page", "url"])
        chunks = moved(records(spark, path, "document_chunk", CHUNKS)).select(F.lit(target).alias("version"), "source_key", "page", "content")
        return store.commit(number, {"pages": pages, "aliases": aliases, "models": models, "attributions": attributions, "versions": versions.unionByName(row)}, {"chunks": chunks}, {"action": "restore", "version": target, "at": at})
    except Exception:
        failed = versions.unionByName(row.withColumn("status", F.lit("failed")))
        store.commit(number, {"versions": failed}, note={"action": "restore failed", "version": target, "at": at})
        raise


def _tables(spark, sf) -> dict[str, DataFrame]:
    """A corpus of every second order as a page and its lines as chunks."""
    orders, lines, part = (table(spark, sf, n) for n in ("orders", "lineitem", "part"))
    pages = orders.where("o_orderkey % 2 = 0").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_custkey").cast("long").alias("page_id"), F.col("o_orderkey").cast("long").alias("revision"), F.col("o_orderpriority").alias("title"), F.lit(True).alias("is_active"))
    chunks = lines.where("l_orderkey % 2 = 0").join(pages.select(F.col("revision").alias("l_orderkey")), "l_orderkey").select(F.lit("src").alias("version"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("source_key"), F.concat(F.lit("o"), "l_orderkey").alias("page"), F.col("l_returnflag").alias("content"))
    corpus = pages.agg(F.count("*").alias("page_count")).crossJoin(chunks.agg(F.count("*").alias("chunk_count")))  # one row each
    corpus = corpus.select(F.lit("src").alias("version"), F.lit("active").alias("status"), F.lit("hash").alias("model"), "page_count", "chunk_count", F.create_map(F.lit("note"), F.lit("x")).alias("manifest"))
    return {
        "corpus": corpus, "embedding_model": spark.range(1).select(F.lit("hash").alias("model"), F.lit(256).alias("dims")), "wiki_page": pages, "source_attribution": pages.select(F.col("id").alias("page"), F.col("title").alias("url")),
        "entity_alias": part.select(F.col("p_name").alias("entity"), F.col("p_brand").alias("alias")), "document_chunk": chunks,
    }


_N = """c AS (SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey % 2 = 0), p AS (SELECT count(*) AS n FROM orders WHERE o_orderkey % 2 = 0)"""


@query(f"""WITH {_N}, t AS (SELECT 'corpus' AS record_type, 1::BIGINT AS n UNION ALL SELECT 'embedding_model', 1 UNION ALL SELECT 'wiki_page', n FROM p UNION ALL SELECT 'source_attribution', n FROM p UNION ALL SELECT 'entity_alias', count(*) FROM part UNION ALL SELECT 'document_chunk', n FROM c)
 SELECT record_type, n, 1 AS schema_version, 'src' AS corpus_version, false AS includes_embeddings, 'gzip' AS compression, true AS bytes_agree FROM t""")
def sink_snapshot_jsonl(spark, sf):
    """The manifest of a snapshot, with the files' real size, after it is written and found sound."""
    path = new_path(spark, "snapshot")
    write_snapshot(_tables(spark, sf), path, "src")
    sound(spark, path, "src", CORPUS)
    size = spark.read.format("binaryFile").load(f"{path}/lines/*.gz").agg(F.sum("length").alias("size"))
    row = manifest(spark, path).crossJoin(size)  # one row each
    return row.select(F.explode("record_counts").alias("record_type", "n"), "schema_version", "corpus_version", "includes_embeddings", "compression", (F.col("byte_count") == F.col("size")).alias("bytes_agree"))


@query("SELECT issue, n::BIGINT AS n FROM (VALUES ('byte_count', 1), ('checksum', 1), ('count', 4), ('missing_type', 2), ('singleton', 1), ('source_version', 1), ('unsupported_type', 1), ('line', 1)) t(issue, n) WHERE EXISTS (SELECT * FROM orders)")
def src_snapshot_verify(spark, sf):
    """Issues of a snapshot that lacks two types, has one type too many and one singleton twice, and to which a file was added."""
    path, tables = new_path(spark, "snapshot"), _tables(spark, sf)
    tables = {n: df for n, df in tables.items() if n not in ("wiki_page", "document_chunk")}
    tables |= {"nation": table(spark, sf, "nation"), "embedding_model": tables["embedding_model"].union(tables["embedding_model"])}
    write_snapshot(tables, path, "other")
    more = [f'{{"record_type": "{n}", "data": {{}}}}' for n in ("embedding_model", "nation", "entity_alias", "source_attribution")] + ['{"record_type": "corpus", "data": 1}']
    extra = spark.range(1).coalesce(1).select(F.explode(F.array(*map(F.lit, more))))
    extra.write.mode("append").option("compression", "gzip").text(f"{path}/lines")
    return verify_snapshot(spark, path, "src", CORPUS).groupBy("issue").agg(F.count("*").alias("n"))


@query("""WITH old AS (SELECT o_custkey, o_orderkey, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AS is_active FROM orders WHERE o_orderkey % 3 = 0),
 new AS (SELECT o_custkey, o_orderkey, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AND o_custkey NOT IN (SELECT o_custkey FROM old) AS is_active FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0),
 every AS (SELECT *, true AS kept FROM old UNION ALL SELECT *, false FROM new), n AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1)
 SELECT o_custkey::BIGINT AS page_id, o_orderkey::BIGINT AS revision, is_active, kept, coalesce(n, 0)::BIGINT AS chunks, 'validating' AS status FROM every LEFT JOIN n ON l_orderkey = o_orderkey""")
def life_restore(spark, sf):
    """Pages after a restore into a store that holds every third order already, with the restored version's chunks."""
    path, store = new_path(spark, "snapshot"), TableSet(spark, new_path(spark, "store"))
    write_snapshot(_tables(spark, sf), path, "src")
    orders = table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.concat(F.lit("old"), "o_orderkey").alias("id"), F.col("o_custkey").cast("long").alias("page_id"), F.col("o_orderkey").cast("long").alias("revision"), F.col("o_orderpriority").alias("title"))
    top = orders.groupBy("page_id").agg(F.max("revision").alias("top"))
    store.commit(0, {"pages": orders.join(top, "page_id").select("id", "page_id", "revision", "title", (F.col("revision") == F.col("top")).alias("is_active"))})
    restore(spark, path, store, "src", "next")
    n = store.read("chunks", CHUNKS).where("version = 'next'").groupBy(F.col("page").alias("id")).agg(F.count("*").alias("chunks"))
    status = store.read("versions", VERSIONS).where("version = 'next'").select("status")  # one row
    rows = store.read("pages", PAGES).join(n, "id", "left").crossJoin(F.broadcast(status))
    return rows.select("page_id", "revision", "is_active", F.col("id").startswith("old").alias("kept"), F.coalesce("chunks", F.lit(0).cast("long")).alias("chunks"), "status")
