"""Hooks for models as functions over batches, SQL table functions, and jobs that write and read back."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.embedding import embedded, hash_embed
from tessera.operators.corpus import _READY, _V, _corpus, readiness
from tessera.operators.lexical import best_lexical
from tessera.operators.retrieval import _COS, LEXICAL, _index, _items, _vectors
from tessera.operators.textual import vector_sql
from tessera.operators.vectors import match_vectors
from tessera.plans.functions import called, register_functions
from tessera.registry import query, table
from tessera.sources.raw import case_issues, raw_pages, write_report
from tessera.sources.shared import new_path, written
from tessera.streaming.sync import embed_pending, sync

__all__ = ["embedded", "hash_embed"]


def quoting(prompts: list[str]) -> list[str]:
    """Stands in for a model: the whole prompt as a quotation."""
    return [f"[S1] {p or ''}" for p in prompts]


def generated(rows: DataFrame, key: str, prompt: str, generate: Callable[[list[str]], list[str]] = quoting) -> DataFrame:
    """key and answer; generate gets the prompts of an Arrow batch at a time."""

    def each(batches):
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "answer": generate(batch["prompt"].tolist())})

    found = rows.select(F.col(key).alias("key"), F.col(prompt).alias("prompt")).mapInPandas(each, "key long, answer string")
    return found.withColumnRenamed("key", key)


@query(f"SELECT doc_id, round(list_sum(list_transform(e, lambda x, i: x * i)), 4) AS told, len(e)::BIGINT AS dims FROM ({vector_sql('documents', 'doc_id')})")
def hook_embedding(spark, sf):
    """Vectors of all documents with words, told by a weighted sum of their components."""
    found = embedded(table(spark, sf, "documents"), "doc_id", "text").where(F.exists("embedding", lambda x: x != 0))
    told = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return found.select("doc_id", F.round(told, 4).alias("told"), F.size("embedding").cast("long").alias("dims"))


@query("SELECT item_id, '[S1] ' || text AS answer FROM benchmark")
def hook_generator(spark, sf):
    return generated(table(spark, sf, "benchmark"), "item_id", "text")


@query("SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'missing' WHEN page_id % 5 = 0 THEN 'identity' WHEN page_id % 7 = 0 THEN 'empty' END AS issue, CASE WHEN page_id % 11 > 0 AND page_id % 5 > 0 AND page_id % 7 > 0 THEN length(html)::BIGINT END AS n FROM pages")
def src_raw_json(spark, sf):
    """Objects are written from pages, some with another page's identity, some empty, some absent."""
    pages, path = table(spark, sf, "pages"), new_path(spark, "raw")
    content = F.when(F.col("page_id") % 7 == 0, " ").otherwise(F.col("html"))
    page = F.struct((F.col("page_id") + (F.col("page_id") % 5 == 0).cast("int")).alias("pageid"), F.array(F.struct(F.struct(F.struct(content.alias("content")).alias("main")).alias("slots"))).alias("revisions"))
    whole = F.struct(F.struct("page_id").alias("metadata"), F.struct(F.struct(F.array(page).alias("pages")).alias("query")).alias("response"))
    pages.where("page_id % 11 <> 0").select(F.to_json(whole)).write.text(path)
    return raw_pages(spark.read.text(path), pages).select("page_id", "issue", F.length("content").cast("long").alias("n"))


@query("""WITH c AS (SELECT doc_id AS id, quality, toxic FROM labels UNION ALL SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 10 = 0)
 SELECT 'duplicate' AS issue, id FROM c GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'behaviour', id FROM c WHERE toxic = 1 UNION ALL SELECT 'too_few', NULL FROM c HAVING count(*) < 150""")
def src_eval_json(spark, sf):
    """Cases are written as JSON from labels, some twice; toxic ones abstain where their category asks for an answer."""
    labels, path = table(spark, sf, "labels"), new_path(spark, "cases")
    labels = labels.union(labels.where("doc_id % 10 = 0"))
    cases = labels.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "entity").otherwise("natural").alias("category"), F.when(F.col("toxic") == 1, "abstain").otherwise("answer").alias("expected_behavior"))
    cases.write.json(path)
    return case_issues(spark.read.schema(cases.schema).json(path))


@query("SELECT o_orderstatus AS status, count(*)::BIGINT AS n FROM orders GROUP BY ALL")
def sink_report_json(spark, sf):
    report = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return spark.read.schema("status string, n long").json(write_report(report, new_path(spark, "reports"), "orders", "1"))


def _stream(spark, sf, name: str) -> DataFrame:
    rows = table(spark, sf, name)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 64).parquet(f"{sf}/{name}.parquet*")


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def stream_sync_upsert(spark, sf):
    rows = _stream(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return sync(rows, new_path(spark, "sync"), ["user_id", "event_type"], "event_id")


@query("SELECT DISTINCT doc_id, 256::BIGINT AS dims FROM documents")
def stream_embed_pending(spark, sf):
    found = embed_pending(_stream(spark, sf, "documents").select("doc_id", "text"), new_path(spark, "embedded"), "doc_id", lambda rows: embedded(rows, "doc_id", "text"), "doc_id long, embedding array<double>")
    return found.select("doc_id", F.size("embedding").cast("long").alias("dims"))


_TOP40 = f"""sem AS (SELECT q.vec_id AS query_id, c.vec_id AS id, {_COS} AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, c.vec_id) AS place FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0 QUALIFY place <= 40),
 lex AS (SELECT item_id * 100 AS query_id, doc_id AS id, score, rank AS place FROM (SELECT * FROM ({LEXICAL}) WHERE item_id < 5)),
 fused AS (SELECT coalesce(l.query_id, s.query_id) AS query_id, coalesce(l.id, s.id) AS id, similarity, round(coalesce(1.0::DOUBLE / (60 + l.place), 0) + coalesce(1.0::DOUBLE / (60 + s.place), 0), 6) AS score FROM lex l FULL OUTER JOIN sem s ON l.query_id = s.query_id AND l.id = s.id),
 hybrid AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, similarity DESC NULLS LAST, id) AS place FROM fused QUALIFY place <= 20)"""


@query(f"""WITH {_TOP40} SELECT 'match' AS f, query_id, id, similarity AS score, place FROM sem WHERE place <= 20 AND similarity >= 0.1 UNION ALL SELECT 'semantic', query_id, id, similarity, place FROM sem
 UNION ALL SELECT 'lexical', query_id, id, score, place FROM lex UNION ALL SELECT 'hybrid', query_id, id, score, place FROM hybrid""")
def udtf_match_chunks(spark, sf):
    """The four table functions, each called once from SQL for all queries; the first five items share ids with vectors."""
    register_functions(spark)
    near = match_vectors(*_vectors(spark, sf), k=40, most=200).select("query_id", F.col("vec_id").alias("id"), F.col("similarity").alias("score"), F.col("rank").alias("place"))
    words = best_lexical(_items(spark, sf).where("item_id < 5"), _index(spark, sf), 40).select((F.col("item_id") * 100).alias("query_id"), F.col("doc_id").alias("id"), "score", F.col("rank").alias("place"))
    near, words = written(near, "semantic"), written(words, "lexical")
    both = near.withColumn("branch", F.lit("semantic")).union(words.withColumn("branch", F.lit("lexical")))
    best = "score DESC, id"
    found = {
        "match": called(spark, "match_chunks", near, best, 50, 0.1), "semantic": called(spark, "semantic_search", near, best, 40), "lexical": called(spark, "lexical_search", words, best, 40),
        "hybrid": called(spark, "hybrid_search", both, "branch, place", 20),
    }
    rows = [df.select(F.lit(name).alias("f"), "query_id", "id", "score", "place") for name, df in found.items()]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


@query(f"WITH {_V}, {_READY} SELECT version, len(findings) = 0 AS ready, array_to_string(findings, ',') AS issues, n_pages, n_chunks, missing, stale FROM r WHERE version = 4 UNION ALL SELECT version, len(archived_findings) = 0, array_to_string(archived_findings, ','), n_pages, n_chunks, missing, stale FROM r WHERE version = 1")
def udtf_corpus_readiness(spark, sf):
    """corpus_readiness(wanted, current), a SQL table function: one row on whether a version could be activated."""
    corpus = _corpus(spark, sf)
    for name, current in (("tessera_ready", True), ("tessera_ready_archived", False)):
        readiness(*corpus, current=current).createOrReplaceTempView(name)
    columns = "version, ready, array_join(findings, ',') AS issues, n_pages, n_chunks, missing, stale"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION corpus_readiness(wanted BIGINT, current BOOLEAN DEFAULT true) RETURNS TABLE(version BIGINT, ready BOOLEAN, issues STRING, n_pages BIGINT, n_chunks BIGINT, missing BIGINT, stale BIGINT) RETURN
 SELECT {columns} FROM tessera_ready WHERE version = corpus_readiness.wanted AND corpus_readiness.current UNION ALL SELECT {columns} FROM tessera_ready_archived WHERE version = corpus_readiness.wanted AND NOT corpus_readiness.current""")
    return spark.sql("SELECT * FROM corpus_readiness(4L) UNION ALL SELECT * FROM corpus_readiness(1L, false)")
