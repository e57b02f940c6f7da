"""Streams that keep a table current: revisions by key, and embeddings of what has none yet.

The table is cut into buckets by key. A micro-batch rewrites only the buckets that it has keys of, each under the number
of the batch; a bucket's newest folder is its state. A batch that is repeated writes the same folders from the same
older ones, so it changes nothing, and a restart finds all it needs in the folders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.sinks import BUCKETS, unseen


def newest(rows: DataFrame, keys: list[str], revision: str) -> DataFrame:
    """The row of the highest revision for each key."""
    rest = [c for c in rows.columns if c not in (*keys, revision)]
    best = rows.groupBy(*keys).agg(F.max(F.struct(revision, *rest)).alias("best"))
    return best.select(*keys, *(F.col("best")[c].alias(c) for c in (revision, *rest)))


def state(spark, path: str, schema: str, below: int | None = None) -> DataFrame:
    """The rows of each bucket's newest folder (of a batch below `below`), without further columns; empty if there is none."""
    rows = spark.read.schema(f"{schema}, batch long, bucket int").option("basePath", path).parquet(f"{path}/batch=*") if _any(spark, path) else spark.createDataFrame([], f"{schema}, batch long, bucket int")
    if below is not None:
        rows = rows.where(F.col("batch") < below)
    last = rows.groupBy(F.col("bucket").alias("_bucket")).agg(F.max("batch").alias("_batch"))
    return rows.join(F.broadcast(last), (F.col("bucket") == F.col("_bucket")) & (F.col("batch") == F.col("_batch"))).drop("_bucket", "_batch", "batch")  # BUCKETS rows


def _any(spark, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*")
    told = found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found)
    return bool(told and len(told))


def run_versions(stream: DataFrame, path: str, keys: list[str], schema: str, step: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS) -> DataFrame:
    """Folds a stream into a table of the given schema under path/table and returns it.

    step(batch, old) gives the new rows of the buckets that a batch touches from their old ones.
    """
    spark, table = stream.sparkSession, f"{path}/table"
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")

    def write(batch: DataFrame, n: int) -> None:
        own = batch.sparkSession
        touched = batch.select(bucket).distinct()
        old = state(own, table, schema, n).join(F.broadcast(touched), "bucket", "left_semi").drop("bucket")
        now = step(batch, old).withColumn("bucket", bucket)
        now.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{table}/batch={n}")

    run = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return state(spark, table, schema).drop("bucket")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def sync(stream: DataFrame, path: str, keys: list[str], revision: str) -> DataFrame:
    """The newest revision for each key; a late older one never replaces it."""
    return run_versions(stream, path, keys, _ddl(stream), lambda batch, old: newest(old.unionByName(batch), keys, revision).select(*stream.columns))


def embed_pending(stream: DataFrame, path: str, key: str, embed: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """Embeddings (of the given schema) of all rows, each key once; a resumed run embeds only what has none. Of rows that repeat a key in a batch one is embedded."""

    def step(batch: DataFrame, old: DataFrame) -> DataFrame:
        return old.unionByName(embed(unseen(batch.dropDuplicates([key]), old, [key])))

    return run_versions(stream, path, [key], schema, step)
