"""Vector and lexical search, fusion, reranking, acceptance and packing for whole tables of queries.

On the test tables `documents` are chunks (source is the page title, lang the section) and `benchmark` items queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.functions.embedding import embedded
from tessera.operators.lexical import best_lexical, index_of, lexical_scores, write_index
from tessera.operators.order import nearest_rank
from tessera.operators.textual import _SEARCH, _TERMS, INTENTS, intent, intent_sql, vector_sql
from tessera.operators.vectors import match_vectors, similarities
from tessera.registry import query, table
from tessera.sources.shared import written
from tessera.sources.store import spread, stored

_COS = "round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])), 6)"


def _vectors(spark, sf) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf, "embeddings")
    return v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), v.select("vec_id", "embedding")


_TOP = f"""SELECT q.vec_id AS query_id, c.vec_id, {_COS} AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, c.vec_id)::BIGINT AS rank
 FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0 QUALIFY rank <= 5"""


@query(_TOP)
def topk_vector(spark, sf):
    return match_vectors(*_vectors(spark, sf)).select("query_id", "vec_id", "similarity", "rank")


@query(f"SELECT q.vec_id AS query_id, c.vec_id, {_COS} AS similarity FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0 AND {_COS} >= 0.3")
def flt_similarity_floor(spark, sf):
    return similarities(*_vectors(spark, sf), floor=0.3)


@query(f"SELECT q.vec_id AS query_id, c.vec_id, {_COS} AS similarity FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0")
def join_cross_vector(spark, sf):
    return similarities(*_vectors(spark, sf))


@query(f"SELECT q.vec_id, {_COS} + 0.0 AS cosine, least(greatest({_COS}, 0), 1)::DOUBLE AS clamped FROM embeddings q JOIN embeddings c ON c.vec_id = q.vec_id + 1")
def fn_cosine(spark, sf):
    """Cosine of each vector and the one after it, and what a score makes of it."""
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    cosine = F.round(t.cosine(F.col("embedding"), F.col("next")), 6) + F.lit(0.0)
    return v.join(after, "vec_id").select("vec_id", cosine.alias("cosine"), F.least(F.greatest(cosine, F.lit(0.0)), F.lit(1.0)).alias("clamped"))


def _index(spark, sf) -> DataFrame:
    """The stored postings of the documents."""
    docs = table(spark, sf, "documents")
    return stored(docs, "postings", lambda path: write_index(docs, path))


def _embedded(spark, sf, name: str, key: str) -> DataFrame:
    """The stored vectors of a table's texts."""
    rows = table(spark, sf, name)
    return stored(rows, f"vectors-{name}", lambda path: embedded(spread(rows.select(key, "text")), key, "text").write.parquet(path))


def _items(spark, sf) -> DataFrame:
    """item_id, text, terms (distinct words and the first three as a phrase), titles and intent of the queries."""
    items = table(spark, sf, "benchmark").select("item_id", "text", F.array_distinct(t.terms(F.col("text"))).alias("words"), t.terms(F.col("text")).alias("w"))
    phrase = F.when(F.size("w") >= 3, F.array(F.array_join(F.slice("w", 1, 3), " "))).otherwise(F.array().cast("array<string>"))
    titles = F.array(*(F.concat(F.lit("src"), ((F.col("item_id") + i) % 20).cast("string")) for i in (0, 1)))
    return items.select("item_id", "text", "words", F.concat("words", phrase).alias("terms"), titles.alias("titles"), intent(F.col("text")).alias("intent"))


_Q = f"""q AS (SELECT item_id, text, ws AS w, list_distinct(ws) AS words, ['src' || item_id % 20, 'src' || (item_id + 1) % 20] AS titles, {intent_sql('text')} AS intent FROM (SELECT *, {_TERMS.replace('@', 'text')} AS ws FROM benchmark)),
d AS (SELECT *, {_TERMS.replace('@', 'text')} AS dw, ' ' || {_SEARCH.replace('@', 'text')} || ' ' AS padded FROM documents)"""
_LEX = """lexw AS (SELECT item_id, doc_id, count(*) AS n FROM (SELECT item_id, unnest(words) AS x FROM q) JOIN (SELECT doc_id, unnest(list_distinct(dw)) AS x FROM d) USING (x) GROUP BY ALL),
lexp AS (SELECT item_id, doc_id, 1 AS n FROM q JOIN d ON len(w) >= 3 AND contains(padded, ' ' || array_to_string(w[1:3], ' ') || ' ')),
lexall AS (SELECT item_id, doc_id, round(sum(n) * 0.1, 6)::DOUBLE AS score FROM (SELECT * FROM lexw UNION ALL SELECT * FROM lexp) GROUP BY ALL)"""


@query(f"WITH {_Q}, {_LEX} SELECT * FROM lexall")
def join_postings(spark, sf):
    return lexical_scores(_items(spark, sf), _index(spark, sf))


_TOPLEX = "lex AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::BIGINT AS rank FROM lexall QUALIFY rank <= 40)"


LEXICAL = f"WITH {_Q}, {_LEX}, {_TOPLEX} SELECT * FROM lex"


@query(LEXICAL)
def topk_lexical(spark, sf):
    return best_lexical(_items(spark, sf), _index(spark, sf))


@query(f"WITH {_Q} SELECT item_id, doc_id, round(len(list_intersect(words, dw)) / len(words), 6) AS overlap FROM q, d WHERE len(list_intersect(words, dw)) > 0")
def set_token_overlap(spark, sf):
    """Share of a query's distinct words that a document has; pairs without any have no row."""
    items = _items(spark, sf).select("item_id", F.col("words").alias("terms"))
    shared = lexical_scores(items, _index(spark, sf)).join(items.select("item_id", F.size("terms").alias("n")), "item_id")
    return shared.select("item_id", "doc_id", F.round(F.round(F.col("score") * 10, 0) / F.col("n"), 6).alias("overlap"))


def hybrid(queries: DataFrame, docs: DataFrame, index: DataFrame | None = None, vectors: DataFrame | None = None, asked: DataFrame | None = None, branch: int = 40, most: int = 30, rrf_k: int = 60, scope: Column | None = None) -> DataFrame:
    """item_id, doc_id, lexical_rank, semantic_rank, similarity, score and rank of each query's candidates.

    queries: item_id, text, terms, titles, intent. docs: doc_id, text, title, section. index: postings of docs. vectors:
    vec_id, embedding of docs. asked: query_id, query of queries. What is None is made here, vectors as hashed features;
    stored ones serve all later calls. scope: a condition on docs that holds in both branches; index and vectors are of
    the documents in scope. A side that lacks a document adds nothing; titles and section intents add to the fused score;
    only ids and ranks travel until the candidates are known.
    """
    clamp = lambda n, top: min(max(n, 1), top)
    docs = docs if scope is None else docs.where(scope)
    lex = best_lexical(queries, index_of(docs) if index is None else index, clamp(branch, 200)).select("item_id", "doc_id", F.col("rank").alias("lexical_rank"))
    vectors = embedded(docs, "doc_id", "text").withColumnRenamed("doc_id", "vec_id") if vectors is None else vectors
    if asked is None:
        asked = embedded(queries.select("item_id", "text"), "item_id", "text").select(F.col("item_id").alias("query_id"), F.col("embedding").alias("query"))
    near = match_vectors(asked, vectors, clamp(branch, 200), most=200)
    sem = near.select(F.col("query_id").alias("item_id"), F.col("vec_id").alias("doc_id"), F.col("rank").alias("semantic_rank"), "similarity")
    part = lambda c: F.coalesce(1 / (max(rrf_k, 1) + F.col(c)), F.lit(0.0))
    both = lex.join(sem, ["item_id", "doc_id"], "full_outer").withColumn("rrf", part("lexical_rank") + part("semantic_rank"))
    both = both.join(docs.select("doc_id", "title", "section"), "doc_id").join(queries.select("item_id", "titles", "intent"), "item_id")
    boost = F.when(F.array_contains("titles", F.col("title")), 0.020).otherwise(0.0) + F.when(F.ilike("section", F.concat(F.lit("%"), "intent", F.lit("%"))), 0.005).otherwise(0.0)
    both = both.withColumn("score", F.round(F.col("rrf") + boost, 6))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.desc_nulls_last("similarity"), "doc_id")
    found = both.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= clamp(most, 100))
    return found.select("item_id", "doc_id", "title", "section", "lexical_rank", "semantic_rank", "similarity", "score", "rank")


def _docs(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", F.col("source").alias("title"), F.col("lang").alias("section"))


_HYB = f"""{_Q}, {_LEX}, {_TOPLEX}, iv AS ({vector_sql('benchmark', 'item_id')}), dv AS ({vector_sql('documents', 'doc_id')}),
sem AS (SELECT item_id, doc_id, round(list_dot_product(iv.e, dv.e), 6) + 0.0 AS similarity, row_number() OVER (PARTITION BY item_id ORDER BY round(list_dot_product(iv.e, dv.e), 6) DESC, doc_id)::BIGINT AS rank FROM iv, dv QUALIFY rank <= 40),
fused AS (SELECT coalesce(l.item_id, s.item_id) AS item_id, coalesce(l.doc_id, s.doc_id) AS doc_id, l.rank AS lexical_rank, s.rank AS semantic_rank, similarity,
 coalesce(1.0::DOUBLE / (60 + l.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0) AS rrf FROM lex l FULL OUTER JOIN sem s ON l.item_id = s.item_id AND l.doc_id = s.doc_id),
hyb AS (SELECT item_id, doc_id, title, section, lexical_rank, semantic_rank, similarity, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, similarity DESC NULLS LAST, doc_id)::BIGINT AS rank FROM (
 SELECT f.*, d.source AS title, d.lang AS section, round(rrf + CASE WHEN list_contains(q.titles, d.source) THEN 0.02 ELSE 0 END + CASE WHEN d.lang ILIKE '%' || q.intent || '%' THEN 0.005 ELSE 0 END, 6)::DOUBLE AS score
 FROM fused f JOIN d USING (doc_id) JOIN q USING (item_id)) QUALIFY rank <= 30)"""


@query(f"WITH {_HYB} SELECT * FROM hyb")
def job_hybrid_search(spark, sf):
    vectors = _embedded(spark, sf, "documents", "doc_id").withColumnRenamed("doc_id", "vec_id")
    asked = _embedded(spark, sf, "benchmark", "item_id").select(F.col("item_id").alias("query_id"), F.col("embedding").alias("query"))
    return hybrid(_items(spark, sf), _docs(spark, sf), _index(spark, sf), vectors, asked)


#: Words of a query that ask for advice, so subjective chunks are welcome.
ADVICE = ("guide", "recommend", "strategy", "tip")


def reranked(candidates: DataFrame, queries: DataFrame, docs: DataFrame, advice: tuple[str, ...] = ADVICE) -> DataFrame:
    """candidates with rerank_score in [0, 1], reasons and place (1 is best) by overlap, similarity, entity and section.

    Scores have six digits; halves are lifted so that every engine rounds them alike.
    queries: item_id, words, titles, intent. docs: doc_id, text, subjective.
    """
    # Only candidates' texts are split.
    rows = candidates.join(docs.select("doc_id", "text", "subjective"), "doc_id").withColumn("held", t.terms(F.col("text"))).join(queries.select("item_id", "words", "titles", F.col("intent").alias("wanted")), "item_id")
    share = lambda c: F.when(F.size("words") > 0, F.size(F.array_intersect("words", c)) / F.size("words")).otherwise(0.0)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    rows = rows.withColumns({
        "title_overlap": share(t.terms(F.col("title"))), "content_overlap": share(F.col("held")), "semantic": F.least(F.greatest(F.coalesce("similarity", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)),
        "resolved_entity": flag(F.exists("titles", lambda x: F.lower(x) == F.lower("title"))), "section_intent": flag(F.lower("section").contains(F.col("wanted"))),
        "penalty": flag(F.col("subjective") & ~F.arrays_overlap("words", F.array(*map(F.lit, advice)))),
    })
    weights = {"title_overlap": 0.20, "content_overlap": 0.15, "semantic": 0.15, "resolved_entity": 0.10, "section_intent": 0.05}
    score = 0.35 * F.least(F.col("score") / 0.04, F.lit(1.0)) - 0.08 * F.col("penalty")
    for name, weight in weights.items():
        score = score + weight * F.col(name)
    reasons = F.array_compact(F.array(F.lit("rrf"), *(F.when(F.col(name) > 0, F.lit(name)) for name in weights), F.when(F.col("penalty") > 0, F.lit("subjective_penalty"))))
    rows = rows.withColumns({"rerank_score": F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)) + 1e-9, 6), "reasons": F.array_join(reasons, ",")})
    order = Window.partitionBy("item_id").orderBy(F.desc("rerank_score"), F.desc("score"), F.desc(F.lower("title")), F.desc("doc_id"))
    return rows.withColumn("place", F.row_number().over(order).cast("long")).select(*candidates.columns, "rerank_score", "reasons", "place")


def _judged(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", (F.col("source") == "src7").alias("subjective"))
    return reranked(job_hybrid_search(spark, sf), _items(spark, sf), docs, advice=("with", "tip"))


_RR = f"""{_HYB}, terms AS (SELECT h.*, d.text, d.source = 'src7' AND NOT list_has_any(q.words, ['with', 'tip']) AS penalty, CASE WHEN len(q.words) > 0 THEN len(list_intersect(q.words, {_TERMS.replace('@', 'd.source')})) / len(q.words) ELSE 0 END AS t1,
 CASE WHEN len(q.words) > 0 THEN len(list_intersect(q.words, dw)) / len(q.words) ELSE 0 END AS t2, least(greatest(coalesce(similarity, 0), 0), 1) AS t3, list_contains(q.titles, d.source)::INT AS t4, coalesce(contains(d.lang, q.intent), false)::INT AS t5
 FROM hyb h JOIN d USING (doc_id) JOIN q USING (item_id)),
rr AS (SELECT item_id, doc_id, title, section, score, similarity, text, rerank_score, reasons, row_number() OVER (PARTITION BY item_id ORDER BY rerank_score DESC, score DESC, title DESC, doc_id DESC)::BIGINT AS place FROM (
 SELECT *, round(least(greatest(0.35::DOUBLE * least(score / 0.04::DOUBLE, 1) + 0.2::DOUBLE * t1 + 0.15::DOUBLE * t2 + 0.15::DOUBLE * t3 + 0.1::DOUBLE * t4 + 0.05::DOUBLE * t5 - 0.08::DOUBLE * penalty::INT, 0), 1) + 1e-9::DOUBLE, 6) AS rerank_score,
 array_to_string(list_filter(['rrf', CASE WHEN t1 > 0 THEN 'title_overlap' END, CASE WHEN t2 > 0 THEN 'content_overlap' END, CASE WHEN t3 > 0 THEN 'semantic' END, CASE WHEN t4 > 0 THEN 'resolved_entity' END, CASE WHEN t5 > 0 THEN 'section_intent' END,
  CASE WHEN penalty THEN 'subjective_penalty' END], lambda x: x IS NOT NULL), ',') AS reasons FROM terms))"""


@query(f"WITH {_RR} SELECT item_id, doc_id, rerank_score, reasons, place FROM rr")
def job_rerank(spark, sf):
    return _judged(spark, sf).select("item_id", "doc_id", "rerank_score", "reasons", "place")


def accepted(rows: DataFrame, body: str = "body", scope: Column | None = None, threshold: float = 0.20, most: int = 10) -> DataFrame:
    """Reranked rows in scope at or above the threshold, each body once, the first `most` of each query, numbered in `n`."""
    rows = rows.where(F.col("rerank_score") >= threshold)
    rows = rows if scope is None else rows.where(scope)
    first = rows.withColumn("_copy", F.row_number().over(Window.partitionBy("item_id", body).orderBy("place"))).where("_copy = 1").drop("_copy")
    return first.withColumn("n", F.row_number().over(Window.partitionBy("item_id").orderBy("place")).cast("long")).where(F.col("n") <= most)


def _evidence(spark, sf) -> DataFrame:
    rows = _judged(spark, sf).join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    rows = rows.withColumns({"body": F.sha2("text", 256), "n_tokens": t.token_count(F.col("text"))}).drop("text")
    return accepted(rows, scope=F.col("section") == "en")


_ACC = rf"""{_RR}, acc AS (SELECT item_id, doc_id, title, section, rerank_score, place, len(regexp_extract_all(text, '{t.TOKEN}'))::BIGINT AS n_tokens, row_number() OVER (PARTITION BY item_id ORDER BY place)::BIGINT AS n FROM (
 SELECT * FROM rr WHERE rerank_score >= 0.2 AND section = 'en' QUALIFY row_number() OVER (PARTITION BY item_id, sha256(text) ORDER BY place) = 1) QUALIFY n <= 10)"""


@query(f"WITH {_ACC} SELECT item_id, doc_id, n, rerank_score FROM acc")
def job_accept_evidence(spark, sf):
    return _evidence(spark, sf).select("item_id", "doc_id", "n", "rerank_score")


def packed(rows: DataFrame, queries: DataFrame, budget: int = 1800, most: int = 8, per_section: int = 2) -> DataFrame:
    """item_id, used, taken: a query's context of whole chunks under a token budget.

    The best chunk of each of its titles comes first, then the others in order; what doesn't fit or has `per_section` of
    its section already is skipped, not the end. rows: item_id, doc_id, title, section, n_tokens, n; few for each query.
    """
    rows = rows.join(queries.select("item_id", "titles"), "item_id")
    of_title = F.row_number().over(Window.partitionBy("item_id", F.lower("title")).orderBy("n"))
    at = F.array_position(F.transform("titles", F.lower), F.lower("title"))
    rows = rows.withColumn("prefer", F.when((of_title == 1) & (at > 0), at).otherwise(F.lit(1 << 30).cast("long")))
    listed = rows.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("prefer", "n", "doc_id", "n_tokens", F.concat_ws("\n", F.lower("title"), F.lower("section")).alias("section")))).alias("c"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<doc_id: bigint, section: string>>").alias("taken"))

    def take(s, x):
        fits = (F.size(s["taken"]) < most) & (s["used"] + x["n_tokens"] <= budget) & (F.size(F.filter(s["taken"], lambda y: y["section"] == x["section"])) < per_section)
        more = F.struct((s["used"] + x["n_tokens"]).alias("used"), F.concat(s["taken"], F.array(F.struct(x["doc_id"].alias("doc_id"), x["section"].alias("section")))).alias("taken"))
        return F.when(fits, more).otherwise(s)

    folded = listed.select("item_id", F.aggregate("c", start, take).alias("s"))
    return folded.select("item_id", F.col("s.used").alias("used"), F.col("s.taken.doc_id").alias("taken"))


_PACK = f"""{_ACC}, ordered AS (SELECT item_id, doc_id, n_tokens, title || '|' || section AS s, row_number() OVER (PARTITION BY item_id ORDER BY prefer, n) AS r FROM (
 SELECT a.*, CASE WHEN row_number() OVER (PARTITION BY a.item_id, title ORDER BY n) = 1 THEN coalesce(nullif(list_position(q.titles, title), 0), 1000) ELSE 1000 END AS prefer FROM acc a JOIN q USING (item_id))),
walk AS (SELECT item_id, 0::BIGINT AS r, 0::BIGINT AS used, []::BIGINT[] AS taken, []::VARCHAR[] AS secs FROM (SELECT DISTINCT item_id FROM ordered) UNION ALL
 SELECT w.item_id, o.r, CASE WHEN ok THEN w.used + n_tokens ELSE w.used END, CASE WHEN ok THEN list_append(w.taken, doc_id) ELSE w.taken END, CASE WHEN ok THEN list_append(w.secs, s) ELSE w.secs END
 FROM (SELECT w.*, o.doc_id, o.n_tokens, o.s, o.r AS nr, len(w.taken) < 8 AND w.used + o.n_tokens <= 1800 AND len(list_filter(w.secs, lambda y: y = o.s)) < 2 AS ok FROM walk w JOIN ordered o ON o.item_id = w.item_id AND o.r = w.r + 1) w JOIN (SELECT DISTINCT r FROM ordered) o ON o.r = w.nr),
pack AS (SELECT item_id, arg_max(used, r) AS used, arg_max(taken, r) AS taken FROM walk GROUP BY item_id)"""


@query(f"WITH RECURSIVE {_PACK} SELECT item_id, used, array_to_string(taken, ' ') AS taken FROM pack")
def job_pack_context(spark, sf):
    return packed(_evidence(spark, sf), _items(spark, sf)).select("item_id", "used", F.array_join(F.col("taken").cast("array<string>"), " ").alias("taken"))


def confidence(top: Column, n: Column) -> Column:
    """Band of a result by its best score and the number of chunks it has."""
    return F.when(F.coalesce(n, F.lit(0)) == 0, "none").when((top >= 0.55) & (n >= 2), "high").when(top >= 0.35, "medium").otherwise("low")


_BAND = "CASE WHEN coalesce(n, 0) = 0 THEN 'none' WHEN top >= 0.55 AND n >= 2 THEN 'high' WHEN top >= 0.35 THEN 'medium' ELSE 'low' END"


@query(f"""WITH RECURSIVE {_PACK} SELECT q.item_id, coalesce(n, 0)::BIGINT AS accepted, {_BAND} AS confidence, coalesce(used, 0)::BIGINT AS used, coalesce(array_to_string(taken, ' '), '') AS context
 FROM q LEFT JOIN (SELECT item_id, max(rerank_score) AS top, count(*) AS n FROM acc GROUP BY item_id) USING (item_id) LEFT JOIN pack USING (item_id)""")
def job_retrieve(spark, sf):
    """Hybrid candidates, reranked, accepted and packed, with a confidence band; queries without evidence stay."""
    items, rows = _items(spark, sf), _evidence(spark, sf)
    told = rows.groupBy("item_id").agg(F.max("rerank_score").alias("top"), F.count("*").alias("n"))
    both = items.select("item_id").join(told, "item_id", "left").join(packed(rows, items), "item_id", "left")
    return both.select("item_id", F.coalesce("n", F.lit(0).cast("long")).alias("accepted"), confidence(F.col("top"), F.col("n")).alias("confidence"), F.coalesce("used", F.lit(0).cast("long")).alias("used"), F.coalesce(F.array_join(F.col("taken").cast("array<string>"), " "), F.lit("")).alias("context"))


@query(f"SELECT query_id, {_BAND} AS confidence FROM (SELECT query_id, max(similarity) AS top, count(*) AS n FROM (SELECT q.vec_id AS query_id, {_COS} AS similarity FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id) WHERE similarity >= 0.3 GROUP BY query_id)")
def fn_confidence_band(spark, sf):
    found = similarities(*_vectors(spark, sf), floor=0.3).where("query_id <> vec_id").groupBy("query_id").agg(F.max("similarity").alias("top"), F.count("*").alias("n"))
    return found.select("query_id", confidence(F.col("top"), F.col("n")).alias("confidence"))


@query(f"WITH {_ACC} SELECT a.item_id, a.n, d.doc_id, d.lang, d.n_chars FROM acc a JOIN documents d USING (doc_id)")
def join_context_lookup(spark, sf):
    return _evidence(spark, sf).select("item_id", "n", "doc_id").join(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id").select("item_id", "n", "doc_id", "lang", "n_chars")


@query(rf"""WITH {_ACC} SELECT item_id, unnest(titles) AS entity FROM q WHERE regexp_matches(' ' || {_SEARCH.replace('@', 'text')} || ' ', ' (with|or|than) ')
 EXCEPT SELECT item_id, title FROM acc""")
def job_comparison_gap(spark, sf):
    """Entities of a comparison that no evidence page covers; queries that compare nothing have no row."""
    items = _items(spark, sf).where(t.compares(F.col("text")) & (F.size("titles") >= 2)).select("item_id", F.explode("titles").alias("entity"))
    covered = _evidence(spark, sf).select("item_id", F.col("title").alias("entity"))
    return items.distinct().join(covered, ["item_id", "entity"], "left_anti")


def _hits(spark, sf) -> DataFrame:
    labels = table(spark, sf, "embeddings").select("vec_id", "label")
    top = match_vectors(*_vectors(spark, sf), k=11).where("query_id <> vec_id")
    of = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("long")
    return top.join(labels, "vec_id").join(of, "query_id").select("query_id", "vec_id", rank.alias("rank"), (F.col("label") == F.col("wanted")).alias("relevant"), "label", "wanted").where("rank <= 10")


_HITS = f"""(SELECT query_id, vec_id, relevant, label, wanted, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM (SELECT q.vec_id AS query_id, c.vec_id, q.label = c.label AS relevant, c.label, q.label AS wanted,
 row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, c.vec_id) AS r FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0) WHERE r <= 11 AND query_id <> vec_id QUALIFY rank <= 10)"""


@query(f"SELECT query_id, vec_id, rank::BIGINT AS rank, relevant FROM {_HITS}")
def join_eval_hits(spark, sf):
    return _hits(spark, sf).select("query_id", "vec_id", "rank", "relevant")


@query(f"SELECT query_id, min(rank) FILTER (relevant)::BIGINT AS hit_rank FROM {_HITS} GROUP BY query_id")
def win_hit_rank(spark, sf):
    return _hits(spark, sf).groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("hit_rank"))


_RANKS = f"(SELECT query_id, min(rank) FILTER (relevant) AS hit_rank FROM {_HITS} GROUP BY query_id)"
_RECALLS = ", ".join(f"round(avg((coalesce(hit_rank, 99) <= {k})::INT), 6) AS recall_{k}" for k in (1, 5, 10))


def within(k: int) -> Column:
    """Share of queries with a hit among the first k."""
    return F.round(F.avg(F.coalesce(F.col("hit_rank") <= k, F.lit(False)).cast("int")), 6).alias(f"recall_{k}")


@query(f"SELECT {_RECALLS} FROM {_RANKS}")
def agg_recall_at_k(spark, sf):
    return win_hit_rank(spark, sf).agg(within(1), within(5), within(10))


@query(f"SELECT round(avg(coalesce(1.0 / hit_rank, 0)), 6)::DOUBLE AS mrr FROM {_RANKS}")
def agg_mrr(spark, sf):
    return win_hit_rank(spark, sf).agg(F.round(F.avg(F.coalesce(1 / F.col("hit_rank"), F.lit(0.0))), 6).alias("mrr"))


def ndcg(hits: DataFrame, expected: DataFrame, cutoff: int = 10) -> DataFrame:
    """query_id, ndcg: each relevant title counts at its first place; the ideal has as many hits as are expected, `cutoff` at most.

    hits: query_id, title, rank, relevant. expected: query_id, n; queries that expect nothing get 0.
    """
    first = hits.where(F.col("relevant") & (F.col("rank") <= cutoff)).groupBy("query_id", "title").agg(F.min("rank").alias("rank"))
    gain = first.groupBy("query_id").agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("gain"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(cutoff)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return expected.join(gain, "query_id", "left").select("query_id", F.when(F.col("n") > 0, F.round(F.coalesce("gain", F.lit(0.0)) / ideal, 6)).otherwise(0.0).alias("ndcg"))


def _ndcg(spark, sf) -> DataFrame:
    labels = table(spark, sf, "embeddings").select("vec_id", "label")
    counts = labels.groupBy("label").agg((F.count("*") - 1).alias("n"))
    expected = labels.where("vec_id % 100 = 0").join(counts, "label").select(F.col("vec_id").alias("query_id"), "n")
    return ndcg(_hits(spark, sf).withColumnRenamed("vec_id", "title"), expected)


_NDCG = f"""(SELECT e.query_id, CASE WHEN n > 0 THEN round(coalesce(gain, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) x(i) WHERE i <= n), 6) ELSE 0 END AS ndcg
 FROM (SELECT q.vec_id AS query_id, (SELECT count(*) FROM embeddings c WHERE c.label = q.label AND c.vec_id <> q.vec_id) AS n FROM embeddings q WHERE q.vec_id % 100 = 0) e
 LEFT JOIN (SELECT query_id, sum(1 / log2(rank + 1)) AS gain FROM {_HITS} WHERE relevant GROUP BY query_id) g USING (query_id))"""


@query(f"SELECT * FROM {_NDCG}")
def agg_ndcg(spark, sf):
    return _ndcg(spark, sf)


@query(f"SELECT round(avg(ok::INT), 6)::DOUBLE AS scope_accuracy FROM (SELECT query_id, bool_and(relevant) AS ok FROM {_HITS} GROUP BY query_id)")
def agg_scope_accuracy(spark, sf):
    return _hits(spark, sf).groupBy("query_id").agg(F.bool_and("relevant").alias("ok")).agg(F.round(F.avg(F.col("ok").cast("int")), 6).alias("scope_accuracy"))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def agg_nearest_rank_pct(spark, sf):
    return nearest_rank(table(spark, sf, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


def _latency(spark, sf) -> DataFrame:
    """Latencies of the request log; views stand in for retrievals."""
    return nearest_rank(table(spark, sf, "events").where("event_type = 'view'"), [], "value", {"p50": 0.5, "p95": 0.95})


_LATENCY = "(SELECT quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events WHERE event_type = 'view' AND value IS NOT NULL)"
_SCOPE = f"(SELECT round(avg(ok::INT), 6)::DOUBLE AS scope_accuracy FROM (SELECT query_id, bool_and(relevant) AS ok FROM {_HITS} GROUP BY query_id))"


def gate() -> Column:
    return ((F.col("recall_5") >= 0.90) & (F.col("recall_10") >= 0.85) & (F.col("scope_accuracy") >= 0.98) & (F.col("p95") <= 1500)).alias("passed")


_GATE = "recall_5 >= 0.9 AND recall_10 >= 0.85 AND scope_accuracy >= 0.98 AND p95 <= 1500 AS passed"


@query(f"SELECT recall_5, recall_10, scope_accuracy, p95, {_GATE} FROM (SELECT {_RECALLS} FROM {_RANKS}), {_SCOPE}, {_LATENCY}")
def agg_release_gate(spark, sf):
    row = agg_recall_at_k(spark, sf).crossJoin(agg_scope_accuracy(spark, sf)).crossJoin(_latency(spark, sf))  # one row each
    return row.select("recall_5", "recall_10", "scope_accuracy", "p95", gate())


@query(f"""SELECT {_RECALLS}, round(avg(coalesce(1.0 / hit_rank, 0)), 6)::DOUBLE AS mrr, round(avg(ndcg), 6) AS ndcg_10, any_value(scope_accuracy) AS scope_accuracy, any_value(p50) AS p50, any_value(p95) AS p95,
 avg((coalesce(hit_rank, 99) <= 5)::INT) >= 0.9 AND avg((coalesce(hit_rank, 99) <= 10)::INT) >= 0.85 AND any_value(scope_accuracy) >= 0.98 AND any_value(p95) <= 1500 AS passed FROM {_RANKS} JOIN {_NDCG} USING (query_id), {_SCOPE}, {_LATENCY}""")
def job_evaluate_retrieval(spark, sf):
    at = F.col("hit_rank")
    judged = win_hit_rank(spark, sf).join(_ndcg(spark, sf), "query_id")
    row = judged.agg(within(1), within(5), within(10), F.round(F.avg(F.coalesce(1 / at, F.lit(0.0))), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg_10"))
    return row.crossJoin(agg_scope_accuracy(spark, sf)).crossJoin(_latency(spark, sf)).select("*", gate())  # one row each


@query(f"""SELECT e5, n10, violations, e5 >= 0.9 AND n10 >= 0.85 AND violations = 0 AS passed FROM (SELECT round(avg((coalesce(hit_rank, 99) <= 5)::INT) FILTER (query_id % 200 = 0), 6) AS e5,
 round(avg((coalesce(hit_rank, 99) <= 10)::INT) FILTER (query_id % 200 <> 0), 6) AS n10 FROM {_RANKS}), (SELECT count(*) FILTER (label = 9 AND wanted <> 9)::BIGINT AS violations FROM {_HITS})""")
def agg_milestone_gate(spark, sf):
    """Targets come as a row of data: entity queries are judged at 5, natural ones at 10, and no hit may be out of scope (label 9)."""
    targets = spark.createDataFrame([(0.9, 0.85)], "entity_target double, natural_target double")
    entity = F.col("query_id") % 200 == 0
    share = lambda k, of: F.round(F.avg(F.when(of, F.coalesce(F.col("hit_rank") <= k, F.lit(False)).cast("int"))), 6)
    got = win_hit_rank(spark, sf).agg(share(5, entity).alias("e5"), share(10, ~entity).alias("n10"))
    out = _hits(spark, sf).agg(F.count_if((F.col("label") == 9) & (F.col("wanted") != 9)).alias("violations"))
    passed = (F.col("e5") >= F.col("entity_target")) & (F.col("n10") >= F.col("natural_target")) & (F.col("violations") == 0)
    return got.crossJoin(F.broadcast(targets)).crossJoin(out).select("e5", "n10", "violations", passed.alias("passed"))


@query(f"SELECT q.vec_id AS query_id, c.vec_id, round(1 - {_COS}, 6) AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, c.vec_id)::BIGINT AS rank FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0 QUALIFY rank <= 20")
def win_rank_semantic(spark, sf):
    return match_vectors(*_vectors(spark, sf), k=20).select("query_id", "vec_id", F.round(1 - F.col("similarity"), 6).alias("distance"), "rank")


def backfilled(queries: DataFrame, held: DataFrame, others: DataFrame, floor: float, pages: int = 3, k: int = 3) -> DataFrame:
    """item_id, chunk, similarity, rank of the queries that the index answers with nothing at the floor.

    Their words are looked up in the pages that aren't in the index yet; the `pages` best of each query are cut into
    chunks, embedded and searched together with the index. held, others: doc_id, text.
    """
    cut = lambda df: df.select((F.col("doc_id") * 1_000_000 + F.col("i")).alias("chunk"), F.array_join("ws", " ").alias("text"))
    chunks = lambda df: cut(t.windowed(df, ["doc_id"], "text"))
    # What later steps read several times is made once.
    index = written(embedded(chunks(held), "chunk", "text").withColumnRenamed("chunk", "vec_id"), "held")
    asked = written(embedded(queries, "item_id", "text").select(F.col("item_id").alias("query_id"), F.col("embedding").alias("query")), "asked")
    answered = written(similarities(asked, index, floor=floor).select("query_id").distinct(), "answered")
    open_ = queries.join(answered.withColumnRenamed("query_id", "item_id"), "item_id", "left_anti")
    fetched = written(best_lexical(open_, index_of(others), pages).select("doc_id").distinct(), "fetched")
    more = embedded(chunks(others.join(fetched, "doc_id", "left_semi")), "chunk", "text").withColumnRenamed("chunk", "vec_id")
    again = asked.join(answered, "query_id", "left_anti")
    return match_vectors(again, index.union(more), k).select(F.col("query_id").alias("item_id"), F.col("vec_id").alias("chunk"), "similarity", "rank")


_CUT = rf"""cut AS (SELECT doc_id, doc_id * 1000000 + a // 260 AS chunk, array_to_string(ws[a+1:a+300], ' ') AS text FROM (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 40, 1), 260)) AS a FROM
 (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS ws FROM documents) WHERE len(ws) > 0))"""


@query(f"""WITH {_Q}, {_LEX}, {_CUT}, iv AS ({vector_sql('benchmark', 'item_id')}), cv AS ({vector_sql('cut', 'chunk')}), old AS (SELECT * FROM cv WHERE (chunk // 1000000) % 3 = 0),
 answered AS (SELECT DISTINCT item_id FROM iv, old WHERE round(list_dot_product(iv.e, old.e), 6) >= 0.45),
 fetched AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM lexall WHERE doc_id % 3 <> 0 AND item_id NOT IN (SELECT item_id FROM answered)) WHERE r <= 3),
 now AS (SELECT * FROM old UNION ALL SELECT * FROM cv WHERE (chunk // 1000000) % 3 <> 0 AND chunk // 1000000 IN (SELECT doc_id FROM fetched))
 SELECT item_id, chunk, round(list_dot_product(iv.e, now.e), 6) + 0.0 AS similarity, row_number() OVER (PARTITION BY item_id ORDER BY round(list_dot_product(iv.e, now.e), 6) DESC, chunk)::BIGINT AS rank
 FROM iv, now WHERE item_id NOT IN (SELECT item_id FROM answered) QUALIFY rank <= 3""")
def job_backfill_missing(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return backfilled(_items(spark, sf), docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 <> 0"), floor=0.45)
