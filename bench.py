"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is timed once after a small one has warmed the session up. stored_tables is the time to build what searches
find stored later: postings of the documents, vectors of documents and queries. single_query is the slowest of ten vector
searches of one query each, single_hybrid the slowest of ten hybrid searches of one query each.
"""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera import library
from tessera.operators import retrieval

NAMES = ["topk_vector", "job_hybrid_search", "job_chunk_words", "job_hash_embed", "win_dedupe_body", "agg_readiness_counts", "topk_lexical"]


def timed(df) -> float:
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return round(time.time() - began, 3)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="spark-")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.checkpoint.dir": folder}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    timed(library.QUERIES["fn_query_forms"](spark, sf_dir))
    began = time.time()
    index, vectors = retrieval._index(spark, sf_dir), retrieval._embedded(spark, sf_dir, "documents", "doc_id").withColumnRenamed("doc_id", "vec_id")
    told = retrieval._embedded(spark, sf_dir, "benchmark", "item_id").select(F.col("item_id").alias("query_id"), F.col("embedding").alias("query"))
    times["stored_tables"] = round(time.time() - began, 3)
    for name in NAMES:
        began = time.time()
        library.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)

    queries, chunks = retrieval._vectors(spark, sf_dir)
    asked = spark.createDataFrame(queries.limit(1).collect(), queries.schema)
    times["single_query"] = sorted(timed(retrieval.match_vectors(asked, chunks)) for _ in range(10))[9]
    items, docs = retrieval._items(spark, sf_dir), retrieval._docs(spark, sf_dir)
    one = spark.createDataFrame(items.limit(1).collect(), items.schema)
    about = spark.createDataFrame(told.join(one, told["query_id"] == one["item_id"]).select("query_id", "query").collect(), "query_id long, query array<double>")

    def single() -> float:
        began = time.time()
        retrieval.hybrid(one, docs, index, vectors, about).write.format("noop").mode("overwrite").save()
        return round(time.time() - began, 3)

    times["single_hybrid"] = max(single() for _ in range(10))
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times[n] for n in ["stored_tables", *NAMES]), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir).removeprefix("sf")}))


if __name__ == "__main__":
    main()
