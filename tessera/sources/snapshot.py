"""Snapshots: tables as one folder of tagged JSON lines, with a manifest that says what they must hold."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import written

SCHEMA_VERSION = 1
MANIFEST = "schema_version int, corpus_version string, created_at string, compression string, sha256 string, byte_count long, includes_embeddings boolean, record_counts map<string,long>"
#: The record types of a corpus snapshot.
CORPUS_TYPES = frozenset({"corpus", "embedding_model", "wiki_page", "source_attribution", "entity_alias", "document_chunk"})


class SnapshotError(ValueError):
    """A snapshot that can't be restored; says which rules it violates."""


@dataclass(frozen=True)
class Contract:
    """Record types a snapshot may hold, must hold, and must hold exactly once; no allowed types mean any."""

    allowed: frozenset[str] = field(default_factory=frozenset)
    required: frozenset[str] = field(default_factory=frozenset)
    singletons: frozenset[str] = field(default_factory=frozenset)


CORPUS = Contract(CORPUS_TYPES, CORPUS_TYPES - {"entity_alias"}, frozenset({"corpus", "embedding_model"}))


def tagged(tables: dict[str, DataFrame]) -> DataFrame:
    """One column, line: {"record_type": ..., "data": {...}} for each row."""
    lines = [df.select(F.to_json(F.struct(F.lit(name).alias("record_type"), F.struct(*df.columns).alias("data"))).alias("line")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, lines)


def _sums(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{path}/lines/*.gz").select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def _type() -> Column:
    """The record type of a line; one that begins as `tagged` writes it isn't parsed."""
    first = F.regexp_extract("value", r'^\{"record_type":"([^"\\]+)"', 1)
    return F.when(first != "", first).otherwise(F.get_json_object("value", "$.record_type"))


def _types(spark: SparkSession, path: str) -> DataFrame:
    """The lines of each record type; null for lines that are no record."""
    line = spark.read.text(f"{path}/lines").select(F.json_tuple("value", "record_type", "data").alias("record_type", "data"))
    return line.groupBy(F.when(F.col("data").startswith("{"), F.col("record_type")).alias("record_type")).agg(F.count("*").alias("n"))


def write_snapshot(tables: dict[str, DataFrame], path: str, version: str = "1", embeddings: bool = False, created_at: str | None = None) -> None:
    """Writes lines, a checksum for each of their files, and a manifest. Never overwrites: an existing snapshot is an error."""
    spark = next(iter(tables.values())).sparkSession
    tagged(tables).write.mode("errorifexists").option("compression", "gzip").text(f"{path}/lines")
    _sums(spark, path).write.mode("errorifexists").json(f"{path}/sums")
    sums = spark.read.schema("file string, sha256 string, bytes long").json(f"{path}/sums")
    whole = sums.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ""), 256).alias("sha256"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("byte_count"))  # a row for each file
    held = _types(spark, path).agg(F.map_from_entries(F.collect_list(F.struct("record_type", "n"))).alias("held"))  # a row for each type
    none = F.map_from_arrays(F.array(*map(F.lit, tables)), F.array(*(F.lit(0).cast("long") for _ in tables)))
    counts = F.map_zip_with(none, "held", lambda _, zero, n: F.coalesce(n, zero))
    created = F.lit(created_at) if created_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    row = whole.crossJoin(held).select(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(version).alias("corpus_version"), created.alias("created_at"), F.lit("gzip").alias("compression"), "sha256", "byte_count", F.lit(embeddings).alias("includes_embeddings"), counts.alias("record_counts"))
    row.coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")


def verify_snapshot(spark: SparkSession, path: str, version: str | None = None, contract: Contract = Contract()) -> DataFrame:
    """issue, of: one row for each rule that is violated; none for a sound snapshot.

    Of the manifest: manifest (not exactly one readable), schema_version, source_version (another than the one asked
    for). Of the files: checksum, byte_count. Of the records: line (no record), unsupported_type, missing_type,
    singleton, count.
    """
    told = manifest(spark, path)
    one = told.agg(F.count("schema_version").alias("n"), *(F.first(c, ignorenulls=True).alias(c) for c in told.columns))  # one row
    rules = {"manifest": F.col("n") != 1, "schema_version": (F.col("n") == 1) & (F.col("schema_version") != SCHEMA_VERSION)}
    if version is not None:
        rules["source_version"] = (F.col("n") == 1) & ~F.col("corpus_version").eqNullSafe(F.lit(version))
    issues = one.select(F.explode(F.array_compact(F.array(*(F.when(bad, F.struct(F.lit(name).alias("issue"), F.lit("manifest").alias("of"))) for name, bad in rules.items())))).alias("i")).select("i.*")

    sums = spark.read.schema("file string, sha256 string, bytes long").json(f"{path}/sums").select("file", F.col("sha256").alias("expected"))
    # The lines are read once for each, whatever number of rules asks.
    found = written(_sums(spark, path), "sums")
    files = found.join(sums, "file", "full_outer").where(~F.col("sha256").eqNullSafe(F.col("expected"))).select(F.lit("checksum").alias("issue"), F.col("file").alias("of"))
    size = found.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).crossJoin(one.select("byte_count"))  # one row each
    issues = issues.union(files).union(size.where(~F.col("bytes").eqNullSafe(F.col("byte_count"))).select(F.lit("byte_count"), F.lit("lines")))

    types = written(_types(spark, path), "types")
    expected = one.select(F.explode(F.coalesce("record_counts", F.create_map().cast("map<string,bigint>"))).alias("record_type", "expected"))
    both = types.where("record_type is not null").join(expected, "record_type", "full_outer").withColumns({"n": F.coalesce("n", F.lit(0).cast("long")), "allowed": F.lit(not contract.allowed) | F.col("record_type").isin(*contract.allowed, "")})
    known = both.select("record_type", "n")
    of = lambda names: spark.createDataFrame([(x,) for x in sorted(names)], "name string").join(known, F.col("name") == F.col("record_type"), "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    records = [
        types.where("record_type is null").select(F.lit("line"), F.lit("lines")), both.where(~F.col("allowed") & (F.col("n") > 0)).select(F.lit("unsupported_type"), "record_type"),
        of(contract.required).where("n = 0").select(F.lit("missing_type"), "name"), of(contract.singletons).where("n > 1").select(F.lit("singleton"), "name"),
        both.where(~F.col("n").eqNullSafe(F.col("expected"))).select(F.lit("count"), "record_type"),
    ]
    return reduce(DataFrame.union, [issues, *records])


def sound(spark: SparkSession, path: str, version: str | None = None, contract: Contract = Contract()) -> None:
    """Raises SnapshotError with the violated rules of a snapshot that isn't sound."""
    issues = verify_snapshot(spark, path, version, contract).groupBy("issue").agg(F.min("of").alias("of")).orderBy("issue").collect()  # as many rows as there are rules
    if issues:
        raise SnapshotError(f"snapshot {path} is damaged: " + ", ".join(f"{r['issue']} ({r['of']})" for r in issues))


def records(spark: SparkSession, path: str, record_type: str, schema: str) -> DataFrame:
    """The records of a type, as rows of a schema; what was verified before."""
    lines = spark.read.text(f"{path}/lines").where(_type() == record_type)
    return lines.select(F.from_json("value", f"data struct<{schema}>").alias("line")).select("line.data.*")


def restored(spark: SparkSession, path: str, record_type: str, schema: str) -> DataFrame:
    """A table of a snapshot, after it is verified; a damaged snapshot is an error."""
    sound(spark, path)
    return records(spark, path, record_type, schema)
