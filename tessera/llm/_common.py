"""What the operators of this subpackage share: tables, durable intermediates, byte kernels."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Only the columns an operator needs, so further columns can't clash; a null text is empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *carry)


def ddl(df: DataFrame, columns: tuple[str, ...]) -> str:
    """The columns as the tail of a schema string."""
    return "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, one machine may take a new folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    folder = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    _made.append(folder)
    return f"{folder}/{name}"


def discard(spark: SparkSession) -> None:
    """Removes the intermediate tables that operators of this process wrote; results that still read them must be written first."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: A slice of texts goes through numpy at once; longer texts go alone.
SLICE_BYTES = 1 << 20
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES * 2), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def slices(rows: list[bytes]):
    """Index ranges of rows of about SLICE_BYTES each."""
    a, size = 0, 0
    for i, row in enumerate(rows):
        if size and size + len(row) > SLICE_BYTES:
            yield a, i
            a, size = i, 0
        size += len(row) + 1
    if a < len(rows):
        yield a, len(rows)


def word_hashes(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of no space, A-Z lower-cased) of all rows, and len(rows)+1 bounds."""
    joined = b"\n".join(rows).lower()
    buf = np.frombuffer(joined + b"\n", np.uint8)
    gap = SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    n = len(buf)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _power(_P, n), out=sums[1:])
    h = mix((sums[end] - sums[start]) * _power(_PINV, n)[start] + (end - start).astype(np.uint64))
    offsets = np.concatenate(([0], np.cumsum([len(r) + 1 for r in rows])))
    return h, np.searchsorted(start, offsets)


def shingle_sets(rows: list[bytes], width: int = 5):
    """For each row the sorted distinct hashes of its shingles; fewer words than width are one shingle."""
    mul = np.uint64(0xD6E8FEB86659FD93)
    for a, b in slices(rows):
        h, bound = word_hashes(rows[a:b])
        m = len(h) - width + 1
        if m > 0:
            s = np.zeros(m, np.uint64)
            for k in range(width):
                s = s * mul + h[k : k + m]
            s = mix(s)
        for i in range(b - a):
            lo, hi = bound[i], bound[i + 1]
            if hi - lo >= width:
                yield np.unique(s[lo : hi - width + 1])
            elif hi > lo:
                one = np.full(1, hi - lo, np.uint64)
                for w in h[lo:hi]:
                    one = one * mul + w
                yield mix(one)
            else:
                yield np.empty(0, np.uint64)
