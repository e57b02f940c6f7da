"""Secret scan over an incremental blob ledger.

Every version of every path is content-addressed. The ledger records which (blob, rule version) pairs have been
scanned and what was found; only pairs it doesn't hold are scanned, each once however many paths and versions share
the blob, and the findings are joined back to all of them. A second run over the same history scans nothing; a new
rule version scans every blob once more.

Texts travel only to meet the list of unseen blobs; equal contents are one blob, so large groups of copies cost one
scan, and rows that repeat a path and its blob are merged before they travel. Blobs without findings stay in the
ledger but take no part in the last join.

Defined results: a null text is the empty blob; a null path is a path like any other; repeated rows are each
returned, their blob is scanned once; an empty table gives an empty result and leaves the ledger as it is; other columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import new_path, texts, written

# The kinds in the order that ties in a list of spans take.
KINDS = ["assign", "access", "hex", "private_key", "jwt", "credential_url", "service_token"]
RULE_VERSION = "2"
SCHEMA = "blob string, rules string, n_assign long, n_access long, n_hex long, base string, spans string"

_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")  # whole runs, as a run is maximal from its first digit on
#: Rules of the ledger's own.
_OTHERS = [
    ("private_key", re.compile(rb"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")),
    ("jwt", re.compile(rb"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("credential_url", re.compile(rb"://[^\s:/@]{1,64}:[^\s:/@]{3,128}@[A-Za-z0-9.-]+")),
    ("service_token", re.compile(rb"(?:ghp_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|glpat-[A-Za-z0-9_-]{20})")),
]


def spans_of(data: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind number) in code points, sorted."""
    found = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(data.lower()) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(data) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(data)]
    for k, (_, rule) in enumerate(_OTHERS):
        found += [(m.start(), m.end(), 3 + k) for m in rule.finditer(data)]
    if found and not data.isascii():
        bounds = sorted({x for s, e, _ in found for x in (s, e)})
        at, chars, code = 0, 0, {}
        for b in bounds:
            chars += len(data[at:b].decode())
            at, code[b] = b, chars
        found = [(code[s], code[e], k) for s, e, k in found]
    return sorted(found, key=lambda x: (x[0], x[2], x[1]))


#: Bytes of unseen pairs that are sent to every task; more meet the texts by a shuffle.
MOST_BYTES = 8 << 20


def scanner(rules: str):
    def scan(batches):
        for batch in batches:
            out = {k: [] for k in ("blob", "rules", "n_assign", "n_access", "n_hex", "base", "spans")}
            data = batch.column(1).cast(pa.binary())
            for i, blob in enumerate(batch.column(0).to_pylist()):
                found = spans_of(data[i].as_py())
                text = [f"{KINDS[k]}:{s}:{e}" for s, e, k in found]
                row = [blob, rules, *(sum(k == x for _, _, k in found) for x in range(3)), ",".join(t for t, f in zip(text, found, strict=True) if f[2] < 3), ",".join(text)]
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.int64() if k[:2] == "n_" else pa.string()) for k in out]))

    return scan


def scan_versions(versions: DataFrame, ledger_path: str | None = None, rules: str = RULE_VERSION, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (the path), blob, n_assign, n_access, n_hex, base and spans for every row of versions.

    ledger_path: a Parquet folder that all executors share; it grows by the pairs this call scans. A new, empty
    ledger if None.
    """
    # A path as text is never null, so that paths and blobs partition one shuffle alike.
    path = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("path")
    versions = texts(versions, path_col, text_col)
    spark = versions.sparkSession
    addressed = versions.select("doc_id", path, F.sha2("text", 256).alias("blob"))
    ledger_path = ledger_path or new_path(spark, "ledger")
    spark.createDataFrame([], SCHEMA).write.mode("append").parquet(ledger_path)
    ledger = spark.read.schema(SCHEMA).parquet(ledger_path)

    unseen = addressed.groupBy("blob").agg(F.min("path").alias("path"))
    unseen = written(unseen.join(ledger.where(F.col("rules") == rules).select("blob"), "blob", "left_anti"), "unseen")
    # One path's text stands for the blob; rows that repeat both are one row before they are scanned.
    # Few unseen pairs are sent to every task, so that no text of a known blob travels.
    each = versions.select(path, F.sha2("text", 256).alias("blob"), "text")
    few = (unseen.agg(F.sum(F.octet_length("path") + 96)).first()[0] or 0) <= MOST_BYTES
    each = each.join(F.broadcast(unseen), ["path", "blob"], "left_semi") if few else each
    each = each.groupBy("path", "blob").agg(F.first("text").alias("text"))
    each = each if few else each.join(unseen, ["path", "blob"])
    scanned = each.select("blob", "text").mapInArrow(scanner(rules), SCHEMA)
    scanned.write.mode("append").parquet(ledger_path)

    found = spark.read.schema(SCHEMA).parquet(ledger_path).where((F.col("rules") == rules) & (F.col("spans") != ""))
    found = found.groupBy("blob").agg(*(F.max(c).alias(c) for c in ("n_assign", "n_access", "n_hex", "base", "spans")))  # a retried append may repeat a pair
    zero, none = F.lit(0).cast("long"), F.lit("")
    return addressed.join(found, "blob", "left").select("doc_id", "blob", *(F.coalesce(c, zero).alias(c) for c in ("n_assign", "n_access", "n_hex")), *(F.coalesce(c, none).alias(c) for c in ("base", "spans")))
