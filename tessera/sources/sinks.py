"""Keyed writes: the new state of a table as a DataFrame, and writers that replace only the folders of touched buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unseen(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose key isn't stored yet."""
    return new.join(stored.select(*keys), keys, "left_anti")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new put in place of equal keys; new has one row for each key."""
    return unseen(old, new, keys).unionByName(new)


def replaced_groups(old: DataFrame, new: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """old without the groups, and new's rows instead."""
    return old.join(groups, key, "left_anti").unionByName(new.select(*old.columns))


#: Folders of a bucketed table.
BUCKETS = 64


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")


def write_new(rows: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """A table in folders by bucket of its key; an existing one is an error."""
    rows.withColumn("bucket", _bucket(keys, buckets)).repartition("bucket").write.partitionBy("bucket").mode("errorifexists").parquet(path)


def _replaced(table: DataFrame, path: str, touched: DataFrame) -> None:
    """The touched buckets' folders are replaced, all others stay as they are. A copy is written first, as table may read them."""
    spark, copy = table.sparkSession, f"{path}_next"
    table.write.mode("overwrite").parquet(copy)
    now = spark.read.schema(table.schema).parquet(copy)
    now.repartition("bucket").write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    for row in touched.join(now.select("bucket").distinct(), "bucket", "left_anti").collect():  # buckets that are empty now
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={row['bucket']}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_upsert(rows: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """Rows replace those of equal keys; rows has one for each key."""
    rows = rows.withColumn("bucket", _bucket(keys, buckets))
    touched = rows.select("bucket").distinct()
    old = rows.sparkSession.read.parquet(path).join(touched, "bucket", "left_semi").select(*rows.columns)
    _replaced(upserted(old, rows, keys), path, touched)


def write_groups(rows: DataFrame, path: str, groups: DataFrame, key: str, buckets: int = BUCKETS) -> None:
    """The rows of the groups are replaced by rows, in a table that is bucketed by the group's key."""
    rows, groups = rows.withColumn("bucket", _bucket([key], buckets)), groups.select(key).distinct()
    touched = groups.select(_bucket([key], buckets)).distinct()
    old = rows.sparkSession.read.parquet(path).join(touched, "bucket", "left_semi").select(*rows.columns)
    _replaced(replaced_groups(old, rows, groups, key), path, touched)


def append_unseen(rows: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Appends rows whose key isn't stored; one row: uploaded, existing."""
    rows = rows.withColumn("bucket", _bucket(keys, buckets))
    stored = rows.sparkSession.read.parquet(path)
    told = rows.join(stored.select(*keys).distinct().withColumn("_old", F.lit(True)), keys, "left").agg(F.count_if(F.col("_old").isNull()).alias("uploaded"), F.count_if("_old").alias("existing")).collect()
    unseen(rows, stored, keys).write.partitionBy("bucket").mode("append").parquet(path)
    return rows.sparkSession.createDataFrame(told, "uploaded long, existing long")
