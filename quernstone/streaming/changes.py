"""Incremental work: change logs folded in batch and as Structured Streaming, with the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.dialect import Dialect, Registry
from ..views import VIEWS, run_sql
from . import queue
from .folders import shared_folder

R = Registry()

R.plain(
    str_health="SELECT tenant_id, status, count(*) AS n FROM v_sync_events GROUP BY tenant_id, status",
)


@R.add("str_cursors")
def _(d: Dialect) -> str:
    """The cursor of the last processed event that has one. DuckDB takes it from the given events by a window, Spark by an aggregate."""
    if d.spark:
        return """
SELECT source, tenant_id, silo_id, max_by(cursor_value, struct(enqueued_at, event_id)) AS cursor_value FROM v_sync_events
WHERE status = 'processed' AND cursor_value IS NOT NULL GROUP BY source, tenant_id, silo_id"""
    return """
SELECT 'folder' AS source, concat('t', CAST(user_id % 3 AS VARCHAR)) AS tenant_id, concat('s', CAST(user_id % 2 AS VARCHAR)) AS silo_id, CAST(event_id AS VARCHAR) AS cursor_value
FROM events WHERE event_id % 10 >= 3 AND event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id % 3, user_id % 2 ORDER BY ts DESC, event_id DESC) = 1"""


def fold_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log folded in one job: the last write, delete and permission change of each object."""
    events = queue.lanes(run_sql(spark, sf_dir, "SELECT * FROM v_sync_events"))
    return queue.living(queue.last_changes(events))


def fold_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream over the log in three parts, which come out of order, and a replay of one of them."""
    folder = shared_folder(spark)
    for part in (1, 0, 2, 1):
        chosen = run_sql(spark, sf_dir, f"SELECT event_id, kind, text, can_read, {', '.join(queue.SCOPE)} FROM v_sync_events WHERE event_id % 3 = {part}")
        chosen.write.mode("append").parquet(f"{folder}/in")
        queue.fold_changes(queue.files(spark, f"{folder}/in", queue.EVENT), folder)
    return queue.folded(spark, folder)


def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is delivered once, then some again, in a later batch; which deliveries were new."""
    folder, shape = shared_folder(spark), "event_id long, object_id string, occurred_at timestamp, delivery int"
    for delivery, chosen in enumerate(("true", "event_id % 20 = 0")):
        sql = f"SELECT event_id, concat('u', CAST(user_id AS STRING)) AS object_id, CAST(ts AS TIMESTAMP) AS occurred_at, {delivery} AS delivery FROM events WHERE {chosen}"
        run_sql(spark, sf_dir, sql).write.mode("append").parquet(f"{folder}/in")
        queue.ingest(queue.files(spark, f"{folder}/in", shape), folder)
    return queue.delivered(spark, folder, shape).select("event_id", "delivery", "is_new")


def retry_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed events are tried until they succeed, which they do after so many failures as their number's rest by 8, or are dead; the clock
    goes on by the longest wait between two passes."""
    folder, shape, now = shared_folder(spark), "event_id long, tenant_id string", [0]
    items = run_sql(spark, sf_dir, "SELECT event_id, concat('t', CAST(user_id % 3 AS STRING)) AS tenant_id FROM events WHERE event_id % 10 = 0")
    queue.enqueue(items, folder)
    for _ in range(queue.MAX_ATTEMPTS):
        queue.attempt(spark, folder, shape, F.col("attempts") >= F.col("event_id") % 8, lambda: now[0])
        now[0] += queue.LONGEST_WAIT_S
    return queue.status(spark, folder, shape)


#: What becomes of an object, from the given events: DuckDB orders each object's changes and takes the last of each kind.
FOLDED = """
SELECT concat('u', CAST(user_id AS VARCHAR)) AS object_id, w IS NOT NULL AND (d IS NULL OR w > d) AS present,
       CASE WHEN w IS NOT NULL AND (d IS NULL OR w > d) THEN concat('text_', substring(sha256(t), 1, 16)) END AS content_id, CASE WHEN p IS NOT NULL AND (d IS NULL OR p > d) THEN c END AS can_read
FROM (SELECT user_id, max(event_id) FILTER (wrote) AS w, arg_max(props, event_id) FILTER (wrote) AS t, max(event_id) FILTER (event_type = 'error' OR event_type NOT IN ('signup', 'view', 'click', 'purchase')) AS d,
             max(event_id) FILTER (allowed) AS p, arg_max(value > 10, event_id) FILTER (allowed) AS c
      FROM (SELECT *, event_type IN ('signup', 'view', 'click') AND event_id % 29 <> 0 AND coalesce(props, '') <> '' AS wrote, event_type = 'purchase' AND event_id % 17 <> 0 AND value IS NOT NULL AS allowed FROM events) e GROUP BY user_id) f"""
DELIVERED = "SELECT event_id, 0 AS delivery, true AS is_new FROM events UNION ALL SELECT event_id, 1, false FROM events WHERE event_id % 20 = 0"
RETRIED = """
SELECT event_id, CAST(least(event_id % 8 + 1, 5) AS INTEGER) AS attempts, CAST([0, 2, 6, 14, 30][least(event_id % 8, 4) + 1] AS BIGINT) AS waited_s, CASE WHEN event_id % 8 >= 5 THEN 'failed' ELSE 'processed' END AS status
FROM events WHERE event_id % 10 = 0"""
R.plain(str_apply_changes=FOLDED, str_live_changes=FOLDED, str_idempotent_ingest=DELIVERED, str_retry_dead_letter=RETRIED)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a file stream, mapped like v_sync_events and without its replays."""
    path = f"{sf_dir}/events.parquet"
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").parquet(path + "*")
    source.createOrReplaceTempView("events_stream")
    text = VIEWS["v_sync_events"].replace("(SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 20 = 0)", "(SELECT * FROM events_stream)")
    return spark.sql(text)


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that is there; in complete mode the last batch is the whole result."""
    spark = stream.sparkSession
    folder = shared_folder(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/out")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def stream_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue counts, kept up to date by a stream."""
    return drained(event_stream(spark, sf_dir).groupBy("tenant_id", "status").agg(F.count("*").alias("n")), "complete")


GAP_S = 1800


def sessions(events: DataFrame, gap_s: int = GAP_S, delay: str = "1 hour") -> DataFrame:
    """Closed sessions of a stream of object_id and `at`: a gap over gap_s parts them, one of just that length does not."""
    counted = events.withWatermark("at", delay).groupBy("object_id", F.session_window("at", f"{gap_s} seconds")).agg(F.count("*").alias("records"))
    return counted.select("object_id", F.unix_micros("session_window.start").alias("first_us"), "records")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions per user of an event-time stream, each sent once, when the watermark has passed its end; their state goes then. At the
    end of the given events one more, far later and of nobody, closes those that are still open."""
    folder, shape = shared_folder(spark), "object_id string, at timestamp"
    last = run_sql(spark, sf_dir, "SELECT max(CAST(ts AS TIMESTAMP)) AS at FROM events")
    events = event_stream(spark, sf_dir).select("object_id", F.col("enqueued_at").cast("timestamp").alias("at"))
    last.where("false").select(F.lit("").alias("object_id"), "at").write.parquet(f"{folder}/closing")
    closing = queue.files(spark, f"{folder}/closing", shape)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    for _ in range(2):
        queue.drain(sessions(events.unionByName(closing)), folder, keep)
        last.select(F.lit("nobody").alias("object_id"), (F.col("at") + F.expr("INTERVAL 1 DAY")).alias("at")).write.mode("append").parquet(f"{folder}/closing")
    return spark.read.schema("object_id string, first_us long, records long").parquet(f"{folder}/out").where("object_id <> 'nobody'").select("object_id", "first_us", "records")


STREAMS = {
    "str_live_health": stream_health, "str_sessionize": stream_sessions, "str_apply_changes": fold_batch, "str_live_changes": fold_stream,
    "str_idempotent_ingest": ingest_stream, "str_retry_dead_letter": retry_stream,
}


@R.add("str_live_health")
def _(d: Dialect) -> str:
    return "SELECT concat('t', CAST(user_id % 3 AS STRING)) AS tenant_id, CASE WHEN event_id % 10 = 0 THEN 'failed' WHEN event_id % 10 < 3 THEN 'queued' ELSE 'processed' END AS status, count(*) AS n FROM events GROUP BY 1, 2"


@R.add("str_sessionize")
def _(d: Dialect) -> str:
    """A record belongs to the session before it if it comes at most half an hour later."""
    t = d.micros("ts")
    return f"""
SELECT concat('u', CAST(user_id AS STRING)) AS object_id, min(t) AS first_us, count(*) AS records FROM
(SELECT user_id, t, sum(opens) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM
(SELECT user_id, event_id, {t} AS t, CASE WHEN {t} - lag({t}) OVER (PARTITION BY user_id ORDER BY {t}, event_id) <= 1800000000 THEN 0 ELSE 1 END AS opens FROM events) a) b GROUP BY user_id, s"""


def sync_folder(listing: DataFrame, cursor: DataFrame | None) -> DataFrame:
    """path, kind of what a folder's listing (path, h) changes against the listing that the cursor keeps; without one all is new."""
    if cursor is None:
        return listing.select("path", F.lit("create").alias("kind"))
    old = cursor.select(F.col("path").alias("was"), F.col("h").alias("old"))
    kind = F.when(F.col("was").isNull(), "create").when(F.col("path").isNull(), "delete").otherwise("update")
    met = listing.join(old, F.col("path") == F.col("was"), "full").where(F.col("was").isNull() | F.col("path").isNull() | ~F.col("h").eqNullSafe(F.col("old")))
    return met.select(F.coalesce("path", "was").alias("path"), kind.alias("kind"))


#: The same folder at three times: some files come, some go, some change.
LISTINGS = (
    "SELECT doc_id AS path, CASE WHEN doc_id % 6 = 0 THEN 'old' ELSE lang END AS h FROM documents WHERE doc_id % 10 <> 1",
    "SELECT doc_id AS path, lang AS h FROM documents WHERE doc_id % 10 <> 2",
    "SELECT doc_id AS path, lang AS h FROM documents WHERE doc_id % 10 <> 2",
)


def folder_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a scheduled job; each keeps its listing as the next one's cursor."""
    folder, cursor = shared_folder(spark), None
    for run, sql in enumerate(LISTINGS):
        kept = f"{folder}/cursor-{run}"
        run_sql(spark, sf_dir, sql).write.parquet(kept)
        listing = spark.read.parquet(kept)
        sync_folder(listing, cursor).withColumn("run", F.lit(run)).write.mode("append").parquet(f"{folder}/changes")
        cursor = listing
    return spark.read.schema("path long, kind string, run int").parquet(f"{folder}/changes")


DENIED_OBJECTS = "SELECT DISTINCT s.object_id FROM v_object_sources s JOIN v_permissions p ON p.scoped_id = s.scoped_id WHERE p.can_read = false"
DENIED_LATER = "SELECT concat('d', CAST(doc_id AS STRING)) AS object_id FROM labels WHERE quality = 0"


def live_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object is delivered twice; between the deliveries more are denied. Each batch meets the permissions as they are then."""
    folder = shared_folder(spark)
    schema = "object_id string, delivery int"

    def deliver(batch: DataFrame, number: int) -> None:
        denied = spark.read.schema("object_id string").parquet(f"{folder}/denied").distinct()
        batch.join(denied, "object_id", "left_anti").write.mode("append").parquet(f"{folder}/out")

    for delivery, sql in enumerate((DENIED_OBJECTS, DENIED_LATER)):
        run_sql(spark, sf_dir, sql).write.mode("append").parquet(f"{folder}/denied")
        run_sql(spark, sf_dir, f"SELECT object_id, {delivery} AS delivery FROM v_objects").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        stream.writeStream.foreachBatch(deliver).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out")


STREAMS |= {"str_folder_changes": folder_changes, "str_live_permissions": live_permissions}

R.plain(
    str_folder_changes=f"""
SELECT path, 'create' AS kind, 0 AS run FROM ({LISTINGS[0]}) f
UNION ALL SELECT coalesce(n.path, p.path), CASE WHEN p.path IS NULL THEN 'create' WHEN n.path IS NULL THEN 'delete' ELSE 'update' END, 1
FROM ({LISTINGS[0]}) p FULL OUTER JOIN ({LISTINGS[1]}) n ON p.path = n.path WHERE p.path IS NULL OR n.path IS NULL OR p.h <> n.h""",
    str_live_permissions=f"""
SELECT o.object_id, 0 AS delivery FROM v_objects o ANTI JOIN ({DENIED_OBJECTS}) d ON d.object_id = o.object_id
UNION ALL SELECT o.object_id, 1 FROM v_objects o ANTI JOIN ({DENIED_OBJECTS} UNION ALL {DENIED_LATER}) d ON d.object_id = o.object_id""",
    # Turns as feedback: the first of a request in its tenant and silo counts; one without an identity or with an accepted candidate is refused.
    str_feedback_ingest="""
SELECT message_id, CASE WHEN request_id IS NULL THEN 'missing_identity' WHEN accepted THEN 'already_accepted' WHEN n > 1 THEN 'duplicate' ELSE '' END AS rejected FROM
(SELECT message_id, request_id, accepted, row_number() OVER (PARTITION BY request_id, tenant_id, silo_id, accepted ORDER BY ord) AS n FROM
(SELECT message_id, tenant_id, silo_id, ord, CASE WHEN role <> 'system' THEN concat(role, CAST(conv_id % 1000000 AS STRING)) END AS request_id, msg_index % 5 = 4 AS accepted FROM v_messages) f) t""",
)
