"""Filters, projections, joins, aggregations, windows and set operations of the corpus engine, on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.registry import query, table
from tessera.sources.shared import new_path
from tessera.sources.sinks import append_unseen, write_groups, write_new, write_upsert


@query("SELECT page_id, url, length(html)::BIGINT AS n_chars FROM pages WHERE url IS NOT NULL AND html IS NOT NULL")
def src_table_scan(spark, sf):
    return table(spark, sf, "pages").where("url is not null and html is not null").select("page_id", "url", F.length("html").cast("long").alias("n_chars"))


@query("SELECT d.doc_id, d.n_chars FROM documents d WHERE d.lang = 'en'")
def flt_scope_active(spark, sf):
    active = spark.createDataFrame([("en", "active"), ("de", "archived")], "scope string, status string").where("status = 'active'")
    docs = table(spark, sf, "documents")
    return docs.join(F.broadcast(active), docs.lang == active.scope).select("doc_id", "n_chars")


@query("SELECT doc_id FROM documents WHERE source = 'src3'")
def flt_optional_param(spark, sf):
    def scoped(df, **given):
        for name, value in given.items():
            df = df if value is None else df.where(F.col(name) == value)
        return df

    return scoped(table(spark, sf, "documents"), source="src3", lang=None).select("doc_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IS NOT NULL AND o_custkey <> 1 AND o_totalprice IS NOT NULL")
def flt_in_null_sets(spark, sf):
    return table(spark, sf, "orders").where(F.col("o_orderstatus").isin("F", "O") & F.col("o_orderpriority").isNotNull() & (F.col("o_custkey") != 1) & F.col("o_totalprice").isNotNull()).select("o_orderkey")


@query("SELECT o_orderkey, least(greatest(o_orderkey, 1), 200)::BIGINT AS n200, least(greatest(o_custkey, 1), 20)::BIGINT AS n20 FROM orders")
def prj_clamp(spark, sf):
    clamp = lambda c, top: F.least(F.greatest(F.col(c), F.lit(1)), F.lit(top)).cast("long")
    return table(spark, sf, "orders").select("o_orderkey", clamp("o_orderkey", 200).alias("n200"), clamp("o_custkey", 20).alias("n20"))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN coalesce(lang,'')='' THEN 'lang' END, CASE WHEN coalesce(source,'')='' OR source='src0' THEN 'source' END,
 CASE WHEN coalesce(n_chars,0)<500 THEN 'n_chars' END], lambda x: x IS NOT NULL), ',') AS missing FROM documents""")
def prj_required_fields(spark, sf):
    docs = table(spark, sf, "documents").withColumns({"source": F.when(F.col("source") != "src0", F.col("source")), "n_chars": F.when(F.col("n_chars") >= 500, F.col("n_chars"))})
    empty = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0"), F.lit(c)) for c in ("lang", "source", "n_chars")]
    return docs.select("doc_id", F.array_join(F.array_compact(F.array(*empty)), ",").alias("missing"))


@query("""SELECT page_id, 'https' AS failed FROM pages WHERE NOT regexp_matches(url, '^https://') UNION ALL
 SELECT page_id, 'blank' FROM pages WHERE trim(html) = '' UNION ALL SELECT page_id, 'range' FROM pages WHERE page_id % 10 NOT BETWEEN 0 AND 7""")
def prj_check_constraints(spark, sf):
    checks = {"https": F.col("url").rlike("^https://"), "blank": F.trim("html") != "", "range": (F.col("page_id") % 10).between(0, 7)}
    failed = F.array_compact(F.array(*(F.when(~ok, F.lit(name)) for name, ok in checks.items())))
    return table(spark, sf, "pages").select("page_id", F.explode(failed).alias("failed"))


@query("SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'")
def join_active_broadcast(spark, sf):
    active = table(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_orderstatus")
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return items.join(active, items.l_orderkey == active.o_orderkey).select("l_orderkey", "l_linenumber", "o_orderstatus")


@query("SELECT l_orderkey, l_linenumber, p_name, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 45")
def join_chunk_page(spark, sf):
    parts = table(spark, sf, "part").where("p_size > 45").select("p_partkey", "p_name", "p_brand")
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return items.join(parts, items.l_partkey == parts.p_partkey).select("l_orderkey", "l_linenumber", "p_name", "p_brand")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def join_semi_evidence(spark, sf):
    customers, orders = table(spark, sf, "customer"), table(spark, sf, "orders").where("o_orderstatus = 'F'")
    return customers.join(orders, customers.c_custkey == orders.o_custkey, "left_semi").select("c_custkey", "c_name")


@query("SELECT doc_id, quality FROM labels WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = labels.doc_id AND d.lang = 'en')")
def join_unknown_reference(spark, sf):
    known = table(spark, sf, "documents").where("lang = 'en'").select("doc_id")
    return table(spark, sf, "labels").join(known, "doc_id", "left_anti").select("doc_id", "quality")


_FUSED = """
WITH lexical AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS lexical_rank FROM documents QUALIFY lexical_rank <= 40),
semantic AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY round(embedding[1]::DOUBLE, 6) DESC, doc_id DESC) AS semantic_rank FROM documents JOIN embeddings ON vec_id = doc_id QUALIFY semantic_rank <= 40)
SELECT coalesce(l.lang, s.lang) AS lang, coalesce(l.doc_id, s.doc_id) AS doc_id, lexical_rank::BIGINT AS lexical_rank, semantic_rank::BIGINT AS semantic_rank,
 round(coalesce(1.0 / (60 + lexical_rank), 0) + coalesce(1.0 / (60 + semantic_rank), 0), 6) AS rrf
FROM lexical l FULL OUTER JOIN semantic s ON l.lang = s.lang AND l.doc_id = s.doc_id"""


@query(_FUSED)
def join_full_outer_fusion(spark, sf):
    """Two rankings within each language: by length, and by the vectors' first component."""
    docs = table(spark, sf, "documents").select("lang", "doc_id", "n_chars")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))
    top = lambda df, name, *by: df.withColumn(name, F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).where(F.col(name) <= 40).select("lang", "doc_id", name)
    fused = top(docs, "lexical_rank", F.desc("n_chars"), "doc_id").join(top(docs.join(vectors, "doc_id"), "semantic_rank", F.desc("first"), F.desc("doc_id")), ["lang", "doc_id"], "full_outer")
    part = lambda c: F.coalesce(F.lit(1.0) / (60 + F.col(c)), F.lit(0.0))
    return fused.withColumn("rrf", F.round(part("lexical_rank") + part("semantic_rank"), 6))


@query(f"SELECT f.doc_id, f.rrf, d.source, d.n_chars FROM ({_FUSED}) f JOIN documents d ON d.doc_id = f.doc_id")
def join_rehydrate(spark, sf):
    return join_full_outer_fusion(spark, sf).select("doc_id", "rrf").join(table(spark, sf, "documents").select("doc_id", "source", "n_chars"), "doc_id")


@query("SELECT o_custkey, max(o_orderkey) AS revision FROM orders GROUP BY o_custkey")
def agg_max_revision(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("revision"))


@query("SELECT user_id, max(event_id) FILTER (event_type = 'purchase') AS latest FROM events GROUP BY user_id")
def agg_latest_success(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))).alias("latest"))


@query("""SELECT round(coalesce(count(*) FILTER (quality = 0 AND toxic = 1) / nullif(count(*) FILTER (quality = 0), 0), 0), 6) AS precision_,
 round(coalesce(count(*) FILTER (quality = 0 AND toxic = 1) / nullif(count(*) FILTER (toxic = 1), 0), 0), 6) AS recall_ FROM labels""")
def agg_abstention_pr(spark, sf):
    hit, said, right = (F.count_if(F.expr(e)) for e in ("quality = 0 and toxic = 1", "quality = 0", "toxic = 1"))
    ratio = lambda of: F.round(F.coalesce(F.try_divide(hit.cast("double"), of), F.lit(0.0)), 6)
    return table(spark, sf, "labels").agg(ratio(said).alias("precision_"), ratio(right).alias("recall_"))


@query("""SELECT doc_id, first_doc, CASE WHEN doc_id = first_doc THEN 'accepted' ELSE 'duplicate_content' END AS code
 FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_doc FROM documents)""")
def win_dedupe_body(spark, sf):
    # the first of each body by aggregation and join: a body that many documents share isn't one window
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("body"))
    first = docs.groupBy("body").agg(F.min("doc_id").alias("first_doc"))
    return docs.join(first, "body").select("doc_id", "first_doc", F.when(F.col("doc_id") == F.col("first_doc"), "accepted").otherwise("duplicate_content").alias("code"))


@query("SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1")
def win_distinct_entity(spark, sf):
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return table(spark, sf, "part").withColumn("r", rank).where("r = 1").select("p_brand", "p_partkey", "p_retailprice")


@query("SELECT event_id, user_id, event_id = max(event_id) OVER (PARTITION BY user_id, event_type) AS is_active FROM events")
def win_current_revision(spark, sf):
    latest = F.max("event_id").over(Window.partitionBy("user_id", "event_type"))
    return table(spark, sf, "events").select("event_id", "user_id", (F.col("event_id") == latest).alias("is_active"))


@query("""SELECT c_custkey, o_orderkey, 'S' || row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS source_id FROM customer JOIN orders ON c_custkey = o_custkey""")
def win_evidence_ids(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey"), F.col("c_custkey") == F.col("o_custkey"))
    number = F.row_number().over(Window.partitionBy("c_custkey").orderBy("o_orderkey"))
    return rows.select("c_custkey", "o_orderkey", F.concat(F.lit("S"), number).alias("source_id"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3")
def limit_members_per_group(spark, sf):
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", rank.alias("r")).where("r <= 3").drop("r")


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 100000")
def set_except_pages(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").subtract(table(spark, sf, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey")))


@query("""SELECT 'nation' AS record_type, n_nationkey::BIGINT AS id, n_name AS name FROM nation UNION ALL SELECT 'region', r_regionkey::BIGINT, r_name FROM region
 UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier""")
def set_union_tagged(spark, sf):
    parts = [("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name"), ("supplier", "s_suppkey", "s_name")]
    frames = [table(spark, sf, t).select(F.lit(t).alias("record_type"), F.col(k).cast("long").alias("id"), F.col(n).alias("name")) for t, k, n in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_anti_unseen(spark, sf):
    customers, orders = table(spark, sf, "customer"), table(spark, sf, "orders").where("o_totalprice > 300000")
    return customers.join(orders, customers.c_custkey == orders.o_custkey, "left_anti").select("c_custkey")


def short_categories(rows: DataFrame, category: str, minimums: DataFrame) -> DataFrame:
    """category, n, least, enough of every category that rows or minimums (category, least) have; none is absent, what has no minimum needs nothing."""
    counts = rows.groupBy(F.col(category).alias("category")).agg(F.count("*").alias("n"))
    both = minimums.join(counts, "category", "full_outer")
    n, least = (F.coalesce(c, F.lit(0).cast("long")) for c in ("n", "least"))
    return both.select("category", n.alias("n"), least.alias("least"), (n >= least).alias("enough"))


@query("""WITH m AS (SELECT p_type AS category, 40 + 10 * length(p_type) AS least FROM part WHERE p_type <> 'SMALL' GROUP BY p_type UNION ALL SELECT 'ABSENT', 5), c AS (SELECT p_type AS category, count(*) AS n FROM part GROUP BY p_type)
 SELECT category, coalesce(n, 0)::BIGINT AS n, coalesce(least, 0)::BIGINT AS least, coalesce(n, 0) >= coalesce(least, 0) AS enough FROM m FULL OUTER JOIN c USING (category)""")
def agg_category_minimums(spark, sf):
    """Minimums by category, of which one has no rows."""
    part = table(spark, sf, "part")
    minimums = part.where("p_type <> 'SMALL'").select(F.col("p_type").alias("category"), (F.length("p_type") * 10 + 40).cast("long").alias("least")).distinct()
    minimums = minimums.union(spark.sql("SELECT 'ABSENT', 5L"))
    return short_categories(part, "p_type", minimums)


@query("""WITH old AS (SELECT *, 0 AS src FROM orders WHERE o_orderkey % 3 <> 0), new AS (SELECT * REPLACE (o_totalprice + 1 AS o_totalprice), 1 AS src FROM orders WHERE o_orderkey % 2 = 0)
 SELECT o_orderkey, round(o_totalprice, 2) AS price FROM (SELECT * FROM old UNION ALL SELECT * FROM new) QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY src DESC) = 1""")
def sink_upsert_key(spark, sf):
    """A table is written, other rows are put into it by key, and it is read back."""
    path, orders = new_path(spark, "orders"), table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    write_new(orders.where("o_orderkey % 3 <> 0"), path, ["o_orderkey"])
    write_upsert(orders.where("o_orderkey % 2 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1), path, ["o_orderkey"])
    return spark.read.parquet(path).select("o_orderkey", F.round("o_totalprice", 2).alias("price"))


@query("""SELECT doc_id, source, 1::BIGINT AS version FROM documents WHERE source NOT IN ('src1', 'src2') UNION ALL SELECT doc_id, source, 2 FROM documents WHERE source IN ('src1', 'src2') AND n_chars > 500""")
def sink_replace_group(spark, sf):
    """A table is written, the rows of two sources are replaced in it, and it is read back."""
    path, docs = new_path(spark, "documents"), table(spark, sf, "documents").where("source is not null").select("doc_id", "source", "n_chars")
    write_new(docs.withColumn("version", F.lit(1).cast("long")), path, ["source"])
    of = docs.where("source in ('src1', 'src2')")
    write_groups(of.where("n_chars > 500").withColumn("version", F.lit(2).cast("long")), path, of.select("source"), "source")
    return spark.read.parquet(path).select("doc_id", "source", "version")


@query("""SELECT count(*) FILTER (doc_id % 4 <> 0 AND n_chars > 1000)::BIGINT AS uploaded, count(*) FILTER (doc_id % 4 = 0 AND n_chars > 1000)::BIGINT AS existing, count(*) FILTER (doc_id % 4 = 0 OR n_chars > 1000)::BIGINT AS stored FROM documents""")
def sink_insert_new(spark, sf):
    """A table is written, rows are appended where their key is absent, and it is counted."""
    path, docs = new_path(spark, "documents"), table(spark, sf, "documents").select("doc_id", "n_chars")
    write_new(docs.where("doc_id % 4 = 0"), path, ["doc_id"])
    told = append_unseen(docs.where("n_chars > 1000"), path, ["doc_id"])
    return told.crossJoin(spark.read.parquet(path).agg(F.count("*").alias("stored")))  # one row each
