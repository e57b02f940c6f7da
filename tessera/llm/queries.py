"""The operators over their whole tables, with production parameters, as the driver's contract wants them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, combination_join, decontaminate, divergence, hard_negatives, html_text, licenses, line_dedup, mixing, near_dedup, quality, secrets, topk
from tessera.llm._common import read


def op1_slot_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_benchmark(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read(spark, sf_dir, "documents"))


def op3_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_versions(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op4_odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), percent=85)


def op5_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_repeated_lines(read(spark, sf_dir, "documents"), min_chars=40, min_docs=5)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{told}'), (-7L, 1L, 'assistant', '{told}') AS t(conv_id, turn, role, text)")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    found = chat.format_trees(chat.thread_messages(rows)).withColumns({"turns": chat.read_back(F.col("formatted")), "loss": chat.masked(F.col("formatted"), F.col("mask"))})
    told_all = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told_all, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents")).drop("spans")


def op11_combination_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combination_join.similar_documents(read(spark, sf_dir, "documents"), percent=85, width=4)


def op12_source_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(read(spark, sf_dir, "documents"), min_docs=10, ranks=10)


def op13_lemp_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_negatives(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


QUERIES = {f.__name__: f for f in (op1_slot_templates, op2_temperature_mixing, op3_blob_ledger, op4_odd_sketch_dedup, op5_wrapper_text, op6_line_dedup, op7_reply_trees, op8_pivot_topk, op9_quality_cnn, op10_license_diagonals, op11_combination_join, op12_source_stripes, op13_lemp_negatives)}
