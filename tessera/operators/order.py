"""Places in an order over whole tables, without a task that holds a whole table or group.

Rows are dealt to tasks by ranges of the order. Only one count for each task (and group) meets elsewhere; which task holds
a place follows from running sums of these, and the place itself is looked for inside that task's rows alone.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import written


def first_rows(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """The first n rows of df in order; equal rows are taken in any order."""
    held = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    counts = sorted(held.groupBy(F.shiftright("_at", 33).alias("part")).count().collect())  # a row for each task
    before = [0, *accumulate(c for _, c in counts)]
    for (part, count), ahead in zip(counts, before, strict=False):
        if ahead + count >= n:
            return held.where(F.col("_at") < (part << 33) + (n - ahead)).drop("_at")
    return held.drop("_at")


def nearest_rank(rows: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """group and a column for each share: the value at place ceil(share * n) in order, nulls left out.

    Equal values are counted first. Ranges of (group, value) are tasks, so a group of all rows is spread over many.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_n"))
    held = written(counts.repartitionByRange(*group, value).withColumn("_part", F.spark_partition_id()), "ordered")
    sums = held.groupBy(*group, "_part").agg(F.sum("_n").alias("_sum"))  # as many rows as there are tasks and groups
    of = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    upto = F.coalesce(F.sum("_sum").over(of.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumns({"_before": upto, "_all": F.sum("_sum").over(of)})
    asked = F.array(*(F.struct(F.lit(name).alias("name"), F.greatest(F.ceil(F.lit(p) * F.col("_all")), F.lit(1)).cast("long").alias("place")) for name, p in shares.items()))
    sums = sums.withColumn("_asked", F.filter(asked, lambda a: (a["place"] > F.col("_before")) & (a["place"] <= F.col("_before") + F.col("_sum")))).where(F.size("_asked") > 0)
    keys = [*group, "_part"]
    sums = sums.select(*(F.col(k).alias(f"_of{i}") for i, k in enumerate(keys)), "_before", "_asked")
    inside = held.join(sums, [F.col(k).eqNullSafe(F.col(f"_of{i}")) for i, k in enumerate(keys)])
    running = F.sum("_n").over(Window.partitionBy(*keys).orderBy(value)) + F.col("_before")
    found = inside.withColumn("_upto", running).select(*group, value, "_upto", F.explode("_asked").alias("_a")).where(F.col("_upto") >= F.col("_a.place"))
    return found.groupBy(*group).agg(*(F.min(F.when(F.col("_a.name") == name, F.col(value))).alias(name) for name in shares))
