"""Derived tables that are built once and found again: under spark.checkpoint.dir, by the files they come from."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.shared import new_path, shared_dir


def signature(source: DataFrame) -> str:
    """What changes when a file of the source does: its paths, lengths and times."""
    spark = source.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    seen = hashlib.sha256()
    for name in sorted(source.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        seen.update(f"{name}\t{status.getLen()}\t{status.getModificationTime()}\n".encode())
    return seen.hexdigest()[:32]


def publish(spark: SparkSession, made: str, path: str) -> bool:
    """Moves a finished folder to its place by one rename; False, and nothing moved, if something is there already."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(made), jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    fs.mkdirs(target.getParent())
    # A rename onto an existing folder would move into it, so the target is looked for first and the outcome checked.
    return not fs.exists(target) and bool(fs.rename(source, target)) and not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{source.getName()}"))


def exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as run at once, if its files give fewer: for small tables with much work in each row."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def stored(source: DataFrame, name: str, build: Callable[[str], None]) -> DataFrame:
    """The table `name` derived from source: build(path) writes it where none exists yet for the same files."""
    spark = source.sparkSession
    path = f"{shared_dir(spark)}/tessera-store/{name}-{signature(source)}"
    if not exists(spark, f"{path}/_SUCCESS"):
        made = new_path(spark, name)
        build(made)
        publish(spark, made, path)
    return spark.read.parquet(path)
