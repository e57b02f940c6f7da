"""Sliding-window admission: at most `limit` accepted events of a key in any `window` seconds.

Rejected events leave no trace, so a count over a window isn't enough: accepted times are kept per key, in order. The
batch form and the stream form share one fold, whose state is at most `limit` times a key. Neither gathers a key: in a
batch rows stream past the fold in order of key and time, in a stream they wait for the watermark in buckets of time. The
stream holds keys by shards: one state entry has the rows of many keys and, where they are few, of several buckets.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "key long, event_id long, admitted boolean, retry_after double"
_COLUMNS = ["key", "event_id", "admitted", "retry_after"]
_KINDS = (np.int64, np.int64, np.int32, np.float64)
#: Buckets of a window, in which events wait for the watermark together.
BUCKETS = 24
#: Shards of keys; a stream keeps the number it began with.
SHARDS = 256
#: Rows of an entry at least before it ends, at the next bucket, and rows of a shard that are gathered before they become entries.
ENTRY, GATHERED = 1 << 13, 1 << 18


def verdict(times: list[float], at: float, limit: int, window: float) -> tuple[bool, float]:
    """Whether an event is accepted, and the seconds to wait if not; times (accepted ones, in order) are kept up to date."""
    while times and times[0] <= at - window:
        times.pop(0)  # `limit` times at most
    if len(times) < limit:
        times.append(at)
        return True, 0.0
    return False, round(window - (at - times[0]), 6)


def admit(times: list[float], rows: pd.DataFrame, limit: int, window: float) -> tuple[list[float], pd.DataFrame]:
    """The accepted times afterwards, and a verdict for each row (key, event_id, at) in order of time."""
    times = list(times)
    out = [(key, event_id, *verdict(times, at, limit, window)) for key, event_id, at in rows.sort_values(["at", "event_id"])[["key", "event_id", "at"]].itertuples(index=False)]
    return times, pd.DataFrame(out, columns=_COLUMNS)


def _shaped(events: DataFrame) -> DataFrame:
    closing = F.col("closing") if "closing" in events.columns else F.lit(False)
    return events.select(F.col("user_id").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), closing.alias("closing"))


def admitted_batch(events: DataFrame, limit: int, window: float) -> DataFrame:
    """A partition's keys one after the other, each in order of time; an Arrow batch at a time is in memory.

    A null key is a key; repeated events of a key count once.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, times = None, []
        for batch in batches:
            new = (batch["key"].ne(batch["key"].shift()) & ~(batch["key"].isna() & batch["key"].shift().isna())).cumsum()
            for _, part in batch.groupby(new, sort=False):
                key = part["key"].iloc[0]
                key = None if pd.isna(key) else key
                if last != (key,):
                    last, times = (key,), []
                times, out = admit(times, part, limit, window)
                yield out

    rows = _shaped(events).select("key", "event_id", "at").dropDuplicates(["key", "event_id"]).repartition("key").sortWithinPartitions("key", "at", "event_id")
    return rows.mapInPandas(fold, SCHEMA)


class Admission(StatefulProcessor):
    """The fold of the keys of one shard as a stateful processor.

    Events wait in buckets of time until the watermark has passed their bucket, so that events which come late, but not
    too late, take their place in time. An entry holds whole buckets, or what came of them, under the first one's number.
    A shard has one timer: for its earliest bucket, or, if nothing waits, for the time when its accepted events can reject
    nothing any more and are forgotten. What is due is judged in order.
    """

    def __init__(self, limit: int, window: float) -> None:
        self.limit, self.window = limit, window
        self.size = max(1000, int(window * 1000) // BUCKETS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "first long", "keys array<bigint>, ids array<bigint>, nulls array<int>, ats array<double>")
        self.times = handle.getValueState("times", "keys array<bigint>, nulls array<int>, times array<array<double>>")
        self.timer = handle.getValueState("timer", "at long")

    def _wake(self, at: int | None) -> None:
        if self.timer.exists():
            if at == (before := self.timer.get()[0]):
                return
            self.handle.deleteTimer(before)
            self.timer.clear()
        if at is not None:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def _read(self, first: int) -> list[np.ndarray]:
        return [np.array(c, kind) for c, kind in zip(self.waiting.getValue((first,)), _KINDS, strict=True)]

    def _wait(self, rows: list[np.ndarray]) -> int:
        """Puts rows (key, event_id, nulls, at) into entries of whole buckets; the earliest bucket of these."""
        earliest = None
        while len(rows[0]):
            bucket = self._bucket(rows)
            first = int(bucket.min())
            earliest = first if earliest is None else earliest
            if self.waiting.containsKey((first,)):
                rows = [np.concatenate(c) for c in zip(self._read(first), rows, strict=True)]
                bucket = self._bucket(rows)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = [c[order] for c in rows], bucket[order]
            end = int(np.searchsorted(bucket, bucket[min(ENTRY, len(bucket)) - 1], side="right"))
            self.waiting.updateValue((first,), tuple(c[:end].tolist() for c in rows))
            rows = [c[end:] for c in rows]
        return earliest

    def _bucket(self, rows: list[np.ndarray]) -> np.ndarray:
        return (rows[3] * 1000 // self.size).astype(np.int64)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts, n, first = [], 0, []
        for batch in rows:
            batch = batch[~batch["closing"]]
            if len(batch):
                parts.append([batch[c].to_numpy() for c in ("key", "event_id", "nulls", "at")])
                n += len(batch)
            if n >= GATHERED:
                first.append(self._wait([np.concatenate(c) for c in zip(*parts, strict=True)]))
                parts, n = [], 0
        if parts:
            first.append(self._wait([np.concatenate(c) for c in zip(*parts, strict=True)]))
        if first:
            self._wake((min(b for (b,) in list(self.waiting.keys())) + 1) * self.size)
        yield pd.DataFrame(columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        end = now // self.size  # buckets below are due
        self.timer.clear()  # a timer that has fired is gone
        entries = sorted(b for (b,) in list(self.waiting.keys()))
        due = [b for b in entries if b < end]
        accepted = defaultdict(list)
        if self.times.exists():
            accepted |= {(k, none): list(ts) for k, none, ts in zip(*self.times.get(), strict=True)}
        yield pd.DataFrame(columns=_COLUMNS)
        rows = [np.empty(0, kind) for kind in _KINDS]
        for first, following in zip(due, [*due[1:], end], strict=False):  # nothing may be due but what is to be forgotten
            rows = [np.concatenate(c) for c in zip(rows, self._read(first), strict=True)]
            self.waiting.removeKey((first,))
            ready = self._bucket(rows) < following  # no later entry holds one of these buckets
            keys, ids, nulls, ats = (c[ready] for c in rows)
            rows = [c[~ready] for c in rows]
            if not len(keys):
                continue
            order = np.lexsort((ids, nulls & 1, ats))
            keys, ids, nulls, ats = keys[order], ids[order], nulls[order], ats[order]
            found = [verdict(accepted[k, none], at, self.limit, self.window) for k, none, at in zip(keys.tolist(), (nulls >> 1).tolist(), ats.tolist(), strict=True)]
            admitted, retry = zip(*found, strict=True)
            whole = lambda x, none: pd.Series(x, dtype="Int64").mask(pd.Series(none.astype(bool)))
            yield pd.DataFrame({"key": whole(keys, nulls >> 1), "event_id": whole(ids, nulls & 1), "admitted": admitted, "retry_after": retry})
        left = [b for b in entries if b >= end]
        if len(rows[0]):
            left = [self._wait(rows), *left]
        # What comes or waits is later than the end of the last bucket judged.
        judged = end * self.size / 1000
        accepted = {k: ts for k, ts in accepted.items() if ts and ts[-1] > judged - self.window}
        if accepted:
            self.times.update(([k for k, _ in accepted], [none for _, none in accepted], list(accepted.values())))
            forget = int((max(ts[-1] for ts in accepted.values()) + self.window) * 1000) + self.size + 1
            self._wake((min(left) + 1) * self.size if left else max(forget, now + 1))
        else:
            self.times.clear()
            if left:
                self._wake((min(left) + 1) * self.size)

    def close(self) -> None:
        pass


def admitted_stream(events: DataFrame, limit: int, window: float, late: str = "1 day") -> DataFrame:
    """events: a streaming DataFrame; the verdict on an event comes when the watermark (`late` behind the newest event) has passed it.

    An event that is repeated within the watermark's delay counts once, and one that comes after its time is dropped.
    """
    rows = _shaped(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(["key", "event_id", "closing"])
    # pandas has no null among whole numbers: bit 1 of nulls tells a null key, bit 0 a null id.
    nulls = F.col("key").isNull().cast("int") * 2 + F.col("event_id").isNull().cast("int")
    rows = rows.select(F.pmod(F.xxhash64("key"), F.lit(SHARDS)).alias("shard"), F.coalesce("key", F.lit(0)).alias("key"), F.coalesce("event_id", F.lit(0)).alias("event_id"), nulls.alias("nulls"), "at", "closing", "ts")
    return rows.groupBy("shard").transformWithStateInPandas(Admission(limit, window), SCHEMA, "append", "eventTime")


def run_admission(events: DataFrame, path: str, limit: int, window: float, late: str = "1 day", close: bool = True) -> DataFrame:
    """The verdicts on all events that a stream has, written under path; run again, it goes on from where it was.

    close: a last row far ahead is sent after all events, so that what still waits for its watermark is judged; the stream
    takes no more events then.
    """
    spark = events.sparkSession
    closing = f"{path}/closing"
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields if f.name in ("user_id", "event_id", "ts"))
    if not _is_there(spark, closing):
        spark.createDataFrame([], kinds).write.parquet(closing)
    both = events.select("user_id", "event_id", "ts").withColumn("closing", F.lit(False)).unionByName(spark.readStream.schema(kinds).parquet(f"{closing}*").withColumn("closing", F.lit(True)))
    store, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

    def run() -> None:
        before = spark.conf.get(store)
        spark.conf.set(store, provider)  # a query keeps what it started with
        try:
            query = admitted_stream(both, limit, window, late).writeStream.format("parquet").option("path", f"{path}/verdicts").option("checkpointLocation", f"{path}/progress").outputMode("append").trigger(availableNow=True).start()
        finally:
            spark.conf.set(store, before)
        query.awaitTermination()

    run()
    if close:
        spark.sql("SELECT timestamp '2200-01-01' AS ts").select(F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("long").alias("event_id"), F.col("ts").cast(events.schema["ts"].dataType).alias("ts")).select("user_id", "event_id", "ts").write.mode("append").parquet(closing)
        run()
    return spark.read.schema(SCHEMA).parquet(f"{path}/verdicts")


def _is_there(spark, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)
