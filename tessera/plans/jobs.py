"""Jobs whose folds need ordered state, and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.registry import query, table
from tessera.sources.shared import new_path
from tessera.streaming.admission import run_admission

#: Accepted events of a key in any WINDOW seconds.
LIMIT, WINDOW = 3, 86400.0


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS key, event_id, epoch_us(ts) / 1e6 AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
walk AS (SELECT key, event_id, tm, r, [tm] AS times, true AS admitted, 0.0::DOUBLE AS retry_after FROM e WHERE r = 1 UNION ALL
 SELECT e.key, e.event_id, e.tm, e.r, CASE WHEN len(live) < {LIMIT} THEN list_append(live, e.tm) ELSE live END, len(live) < {LIMIT}, CASE WHEN len(live) < {LIMIT} THEN 0.0 ELSE round({WINDOW} - (e.tm - live[1]), 6) END
 FROM (SELECT w.key, w.r, e2.r AS nr, list_filter(w.times, lambda x: x > e2.tm - {WINDOW}) AS live FROM walk w JOIN e e2 ON e2.key = w.key AND e2.r = w.r + 1) w JOIN e ON e.key = w.key AND e.r = w.nr)
SELECT key, event_id, admitted, retry_after FROM walk""")
def stream_admission(spark, sf):
    """The stream over the whole events table, run until nothing is left; it tells what the batch form does."""
    events = table(spark, sf, "events")
    rows = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parquet*")
    return run_admission(rows, new_path(spark, "admission"), limit=LIMIT, window=WINDOW)


@query("SELECT page_id, sha256(html) AS content_hash, length(html)::BIGINT AS n FROM pages")
def src_page_flatten(spark, sf):
    """Pages as nested API objects and back: the first revision of each page, hashed."""
    page = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("page_id").alias("pageid"), F.array(F.struct(F.col("html").alias("content"))).alias("revisions"))).alias("pages")).alias("query")))
    schema = "query struct<pages: array<struct<pageid: long, revisions: array<struct<content: string>>>>>"
    raw = table(spark, sf, "pages").select(F.from_json(page, schema).alias("r")).select(F.explode("r.query.pages").alias("p")).where(F.size("p.revisions") > 0)
    content = F.element_at("p.revisions", 1)["content"]
    return raw.select(F.col("p.pageid").alias("page_id"), F.sha2(content, 256).alias("content_hash"), F.length(content).cast("long").alias("n"))
