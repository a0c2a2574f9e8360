"""Health of queues and of what is made from them, for every tenant at once: metrics, reasons to warn, and what to do about each.

Tables of the functions below:

- tenants: tenant_id, now, strict (whether objects without a permission count), wants_package, wants_snapshot; each tenant once
- events: tenant_id, status, attempts, enqueued_at, next_retry_at, processed_at
- files: tenant_id, what ('package' or 'snapshot'), body, written_at; the JSON headers, at most one of a kind for a tenant
- tracked: tenant_id, path; the paths of its snapshot
- objects: tenant_id, object_id; sources: tenant_id, object_id, scoped_id; permissions: tenant_id, scoped_id, can_read, recorded_from_event

Everything is counted before tenants come together, so that one with most of the rows is a row like any other by then."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.dialect import Dialect, Registry
from ..streaming.queue import MAX_ATTEMPTS
from ..views import run_sql

R = Registry()

# Limits in seconds and events, the names of the reasons in their order, and the version of snapshots.
OLD_S, LAG_S, WAITING, VERSION = 600, 300, 5, 1
REASONS = {
    "failed_events": ("failed > 0", "List the failed events, mend what stopped them and reset them."),
    "package_missing": ("wants_package AND NOT package_exists", "Give a folder that the jobs can write and publish once."),
    "package_unreadable": ("wants_package AND package_exists AND NOT package_readable", "Publish anew; the header is no JSON object."),
    "snapshot_missing": ("wants_snapshot AND NOT snapshot_exists", "Scan the folder once, which writes the first snapshot."),
    "snapshot_unreadable": ("wants_snapshot AND snapshot_exists AND NOT snapshot_readable", "Remove the snapshot and scan the folder anew."),
    "snapshot_version_unexpected": ("wants_snapshot AND snapshot_readable AND NOT version_known", "Remove the snapshot and scan the folder anew; sequence numbers go on from the queue's."),
    "queue_age_high": (f"oldest_queued_s > {OLD_S}", "See that the jobs run; the oldest event waits too long."),
    "package_lag_high": (f"package_lag_s > {LAG_S}", "See why publishing fails; events were processed long after the package was written."),
    "waiting_retry_high": (f"waiting > {WAITING}", "Many events wait for another attempt; look at their errors."),
    "no_ready_events": ("queued > 0 AND ready = 0", "All queued events wait; mend their cause or reset them."),
    "objects_without_explicit_permission": ("strict AND package_readable AND unpermitted > 0", "Record a permission for each object before the strict mode is used."),
    "object_count_mismatch": ("wants_package AND package_readable AND stated_objects <> objects", "Publish anew; the header does not count what is there."),
    "orphaned_permission_entries": ("package_readable AND orphans > 0", "Remove entries whose objects are gone."),
    "permissions_missing_event_provenance": ("package_readable AND unrecorded > 0", "Record the event of each permission."),
    "snapshot_package_count_mismatch": ("wants_snapshot AND snapshot_readable AND package_readable AND tracked <> objects", "See that scan and package are of the same folder."),
}

COUNTS = ["queued", "processed", "failed", "stuck", "ready", "waiting"]


def queue_metrics(events: DataFrame, now: Column, keys: list[str]) -> DataFrame:
    """keys, counts by status, of the queued those tried as often as they may be (stuck), those that are due and those that wait, how long the oldest is queued, and
    when the last one was processed. now is one value for the rows of a key."""
    queued, due = F.col("status") == "queued", F.coalesce(F.col("next_retry_at") <= now, F.lit(True))
    micros = lambda at: F.unix_micros(F.col(at).cast("timestamp"))
    return events.groupBy(*keys).agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("queued", "processed", "failed")],
        F.count_if(queued & (F.col("attempts") >= MAX_ATTEMPTS)).alias("stuck"), F.count_if(queued & due).alias("ready"), F.count_if(queued & ~due).alias("waiting"),
        ((F.max(F.unix_micros(now.cast("timestamp"))) - F.min(F.when(queued, micros("enqueued_at")))) / 1_000_000).alias("oldest_queued_s"),
        F.max(F.when(F.col("status") == "processed", micros("processed_at"))).alias("last_processed_us"),
    )


def package_metrics(objects: DataFrame, sources: DataFrame, permissions: DataFrame) -> DataFrame:
    """tenant_id, objects, unpermitted (objects with sources of which none has an entry), entries, denies, orphans (entries of no object), unrecorded (entries without an event)."""
    t = F.col("tenant_id")
    n_objects = objects.groupBy(t).agg(F.count("*").alias("objects"))
    entry = permissions.select(F.col("tenant_id").alias("t_"), F.col("scoped_id").alias("s_")).distinct().withColumn("there", F.lit(1))
    met = sources.join(entry.hint("merge"), (t == F.col("t_")) & (F.col("scoped_id") == F.col("s_")), "left")
    unpermitted = met.groupBy(t, "object_id").agg(F.max("there").alias("there")).where("there IS NULL").groupBy(t).agg(F.count("*").alias("unpermitted"))
    living = sources.select(F.col("tenant_id").alias("t_"), F.col("scoped_id").alias("s_")).distinct().withColumn("lives", F.lit(1))
    entries = permissions.join(living.hint("merge"), (t == F.col("t_")) & (F.col("scoped_id") == F.col("s_")), "left").groupBy(t).agg(
        F.count("*").alias("entries"), F.count_if(~F.col("can_read")).alias("denies"), F.count_if(F.col("lives").isNull()).alias("orphans"),
        F.count_if(F.coalesce("recorded_from_event", F.lit("")) == "").alias("unrecorded"),
    )
    return n_objects.join(unpermitted.hint("merge"), "tenant_id", "full").join(entries.hint("merge"), "tenant_id", "full")


def file_metrics(files: DataFrame) -> DataFrame:
    """tenant_id, and of package and snapshot whether they are there and readable, that is JSON objects, with what their headers say."""
    v = files.withColumn("v", F.expr("try_parse_json(body)")).withColumn("readable", F.expr("coalesce(schema_of_variant(v) LIKE 'OBJECT%', false)"))
    of = lambda what, x: F.max(F.when(F.col("what") == what, x))
    number = "schema_of_variant(try_variant_get(v, '$.version', 'variant')) <> 'STRING' AND try_variant_get(v, '$.version', 'double')"
    return v.groupBy("tenant_id").agg(
        of("package", F.lit(True)).alias("package_exists"), of("package", F.col("readable")).alias("package_readable"), of("package", F.expr("try_variant_get(v, '$.metadata.object_count', 'bigint')")).alias("stated_objects"),
        of("package", F.unix_micros(F.col("written_at").cast("timestamp"))).alias("package_us"),
        of("snapshot", F.lit(True)).alias("snapshot_exists"), of("snapshot", F.col("readable")).alias("snapshot_readable"), of("snapshot", F.expr(f"coalesce({number} = {VERSION}, false)")).alias("version_known"),
        of("snapshot", F.expr("try_variant_get(v, '$.seq', 'bigint')")).alias("seq"),
    )


def report(tenants: DataFrame, events: DataFrame, files: DataFrame, tracked: DataFrame, objects: DataFrame, sources: DataFrame, permissions: DataFrame) -> DataFrame:
    """A row for each tenant: status OK or WARNING, its reasons and hints in the order of the rules, and the metrics. A tenant without any rows elsewhere is
    fine, unless it wants files that are not there."""
    clock = tenants.select(F.col("tenant_id").alias("c_"), "now").hint("merge")
    queue = queue_metrics(events.join(clock, F.col("tenant_id") == F.col("c_")), F.col("now"), ["tenant_id"])
    paths = tracked.groupBy("tenant_id").agg(F.count("*").alias("tracked"))
    t = tenants
    for other in (queue, file_metrics(files), paths, package_metrics(objects, sources, permissions)):
        t = t.join(other.hint("merge"), "tenant_id", "left")
    whole = [*COUNTS, "tracked", "objects", "unpermitted", "entries", "denies", "orphans", "unrecorded"]
    t = t.na.fill(0, whole).na.fill(False, ["package_exists", "package_readable", "snapshot_exists", "snapshot_readable", "version_known"])
    t = t.withColumn("package_lag_s", F.when(F.col("package_us").isNotNull(), (F.col("last_processed_us") - F.col("package_us")) / 1_000_000))
    said = lambda k: F.array_compact(F.array(*[F.when(F.expr(rule), F.lit((name, hint)[k])) for name, (rule, hint) in REASONS.items()]))
    t = t.withColumn("reasons", said(0)).withColumn("hints", said(1))
    status = F.when(F.size("reasons") > 0, "WARNING").otherwise("OK")
    return t.select("tenant_id", status.alias("status"), "reasons", "hints", *whole, "oldest_queued_s", "package_lag_s", "package_exists", "package_readable", "stated_objects", "snapshot_exists", "snapshot_readable", "seq")


# The queries: eight tenants over the given tables, each with another fault, the first with none.

_OF = "concat('h', CAST({0} AS STRING))"
_ID = "CAST(regexp_replace(scoped_id, '^folder.(d|gone)', '') AS BIGINT)"
_LAST = "(SELECT max(ts) AS latest FROM events)"
FIXTURE = {
    "tenants": f"SELECT {_OF.format('k')} AS tenant_id, latest + INTERVAL '60' SECOND AS now, k <> 0 AS strict, k <> 6 AS wants_package, true AS wants_snapshot FROM (SELECT DISTINCT doc_id % 8 AS k FROM documents) d CROSS JOIN {_LAST} l",
    "events": f"""SELECT {_OF.format('user_id % 8')} AS tenant_id, status, attempts, ts AS enqueued_at, CASE WHEN status = 'queued' AND (attempts > 0 OR user_id % 8 = 3) THEN ts + INTERVAL '86400' SECOND * CASE WHEN user_id % 8 = 3 THEN 100000 ELSE user_id % 8 END END AS next_retry_at,
CASE WHEN status = 'processed' THEN ts + INTERVAL '1' SECOND END AS processed_at FROM (SELECT user_id, ts, event_id % 7 AS attempts, CASE WHEN user_id % 8 = 0 OR event_id % 10 > 2 THEN 'processed' WHEN event_id % 10 = 0 THEN 'failed' ELSE 'queued' END AS status FROM events) e""",
    "files": f"""SELECT {_OF.format('k')} AS tenant_id, 'package' AS what, CASE WHEN k = 2 THEN '{{"metadata": ' WHEN k = 3 THEN '{{"metadata": {{"object_count": 1}}}}' WHEN k = 4 THEN '{{}}' ELSE concat('{{"metadata": {{"object_count": ', CAST(n AS STRING), '}}}}') END AS body,
latest - INTERVAL '100' SECOND * k AS written_at FROM (SELECT doc_id % 8 AS k, count(*) AS n FROM documents GROUP BY doc_id % 8) d CROSS JOIN {_LAST} l WHERE k <> 1
UNION ALL SELECT {_OF.format('k')}, 'snapshot', CASE k WHEN 4 THEN '[1]' WHEN 5 THEN '{{"version": 2, "seq": 9}}' WHEN 6 THEN '{{"seq": 4}}' WHEN 3 THEN '{{"version": "1", "seq": 4}}' ELSE '{{"version": 1, "seq": 3}}' END, latest FROM (SELECT DISTINCT doc_id % 8 AS k FROM documents) d CROSS JOIN {_LAST} l WHERE k <> 2""",
    "tracked": f"SELECT {_OF.format('doc_id % 8')} AS tenant_id, CAST(doc_id AS STRING) AS path FROM documents WHERE doc_id % 16 <> 7",
    "objects": f"SELECT {_OF.format('ord % 8')} AS tenant_id, object_id FROM v_objects",
    "sources": f"SELECT {_OF.format('doc_id % 8')} AS tenant_id, concat('d', CAST(doc_id AS STRING)) AS object_id, concat('folder|d', CAST(doc_id AS STRING)) AS scoped_id FROM documents WHERE doc_id % 7 <> 0",
    "permissions": f"SELECT {_OF.format(f'{_ID} % 8')} AS tenant_id, scoped_id, can_read, CASE WHEN {_ID} % 8 = 0 THEN 'e' ELSE recorded_from_event END AS recorded_from_event FROM v_permissions WHERE {_ID} % 8 <> 0 OR (scoped_id LIKE '%d%|d%' AND {_ID} % 7 <> 0)",
}


def health_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report(**{name: run_sql(spark, sf_dir, sql) for name, sql in FIXTURE.items()})
    shown = ["oldest_queued_s", "package_lag_s", *COUNTS, "tracked", "objects", "unpermitted", "entries", "denies", "orphans", "unrecorded", "stated_objects", "seq"]
    return found.select("tenant_id", "status", F.array_join("reasons", ",").alias("reasons"), F.size("hints").alias("n_hints"), *shown)


def queue_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue of each source and silo; attempts wait a minute each, the clock stands an hour after the last event."""
    wait = "CASE WHEN attempts > 0 THEN e.enqueued_at + INTERVAL '60' SECOND * attempts END AS next_retry_at, e.enqueued_at AS processed_at"
    events = run_sql(spark, sf_dir, f"SELECT source, silo_id, status, attempts, e.enqueued_at, {wait}, l.latest + INTERVAL '3600' SECOND AS now FROM v_sync_events e CROSS JOIN {_LAST} l")
    return queue_metrics(events, F.col("now"), ["source", "silo_id"]).withColumn("failed_or_stuck", F.col("failed") + F.col("stuck"))


QUERIES = {"agg_health_reasons": health_reasons, "agg_queue_health": queue_health}


@R.add("agg_queue_health")
def _(d: Dialect) -> str:
    """From the events by row filters, not by the view's status."""
    n = lambda name, rule: f"count(*) FILTER ({rule}) AS {name}"
    wait, queued = "(attempts > 0 AND ts + to_seconds(60 * attempts) > now)", "r IN (1, 2)"
    return f"""
SELECT 'folder' AS source, silo_id, {n('queued', queued)}, {n('processed', 'r > 2')}, {n('failed', 'r = 0')}, {n('stuck', queued + ' AND attempts >= 5')}, {n('ready', queued + ' AND NOT ' + wait)}, {n('waiting', queued + ' AND ' + wait)},
       (epoch_us(max(now)) - epoch_us(min(ts) FILTER ({queued}))) / 1000000 AS oldest_queued_s, epoch_us(max(ts) FILTER (r > 2)) AS last_processed_us, count(*) FILTER (r = 0 OR ({queued} AND attempts >= 5)) AS failed_or_stuck
FROM (SELECT concat('s', user_id % 2) AS silo_id, ts, event_id % 6 AS attempts, event_id % 10 AS r, (SELECT max(ts) FROM events) + to_seconds(3600) AS now FROM events CROSS JOIN (SELECT unnest([0, 1]) AS again) a WHERE again = 0 OR event_id % 20 = 0) e GROUP BY silo_id"""


@R.add("agg_health_reasons")
def _(d: Dialect) -> str:
    """A row a tenant by subqueries over the given tables; of the reasons, those of files follow from the tenant's number."""
    f = FIXTURE
    q = lambda what, where: f"(SELECT {what} FROM ({f['events']}) e WHERE e.tenant_id = t.tenant_id AND {where})"
    n = lambda table, where="true": f"(SELECT count(*) FROM ({f[table]}) x WHERE x.tenant_id = t.tenant_id AND {where})"
    entry, source = f"SELECT (tenant_id, scoped_id) FROM ({f['permissions']}) p", f"SELECT (tenant_id, scoped_id) FROM ({f['sources']}) s"
    counts = {
        "queued": q("count(*)", "status = 'queued'"), "processed": q("count(*)", "status = 'processed'"), "failed": q("count(*)", "status = 'failed'"), "stuck": q("count(*)", "status = 'queued' AND attempts >= 5"),
        "ready": q("count(*)", "status = 'queued' AND (next_retry_at IS NULL OR next_retry_at <= t.now)"), "waiting": q("count(*)", "status = 'queued' AND next_retry_at > t.now"),
        "tracked": n("tracked"), "objects": n("objects"), "unpermitted": n("sources", f"(x.tenant_id, x.scoped_id) NOT IN ({entry})"), "entries": n("permissions"), "denies": n("permissions", "can_read = false"),
        "orphans": n("permissions", f"(x.tenant_id, x.scoped_id) NOT IN ({source})"), "unrecorded": n("permissions", "recorded_from_event IS NULL"),
        "oldest_queued_s": f"(epoch_us(t.now) - {q('epoch_us(min(enqueued_at))', "status = 'queued'")}) / 1000000",
        "package_lag_s": f"CASE WHEN k <> 1 THEN ({q('epoch_us(max(processed_at))', "status = 'processed'")} - epoch_us(t.now) + (60 + 100 * k) * 1000000) / 1000000 END",
    }
    rules = [
        ("failed_events", "failed > 0"), ("package_missing", "k = 1"), ("package_unreadable", "k = 2"), ("snapshot_missing", "k = 2"), ("snapshot_unreadable", "k = 4"), ("snapshot_version_unexpected", "k IN (3, 5, 6)"),
        ("queue_age_high", "oldest_queued_s > 600"), ("package_lag_high", "package_lag_s > 300"), ("waiting_retry_high", "waiting > 5"), ("no_ready_events", "queued > 0 AND ready = 0"),
        ("objects_without_explicit_permission", "k NOT IN (0, 1, 2) AND unpermitted > 0"), ("object_count_mismatch", "k = 3 AND objects <> 1"), ("orphaned_permission_entries", "k NOT IN (1, 2) AND orphans > 0"),
        ("permissions_missing_event_provenance", "k NOT IN (1, 2) AND unrecorded > 0"), ("snapshot_package_count_mismatch", "k = 7 AND tracked <> objects"),
    ]
    reasons = f"concat_ws(',', {', '.join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in rules)})"
    n_hints = " + ".join(f"CASE WHEN {rule} THEN 1 ELSE 0 END" for _, rule in rules)
    stated = "CASE WHEN k IN (1, 2, 4) THEN NULL WHEN k = 3 THEN 1 ELSE objects END"
    seq = "CASE k WHEN 2 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN 9 WHEN 6 THEN 4 WHEN 3 THEN 4 ELSE 3 END"
    return f"""
SELECT tenant_id, CASE WHEN reasons = '' THEN 'OK' ELSE 'WARNING' END AS status, reasons, CAST(n_hints AS INTEGER) AS n_hints, {', '.join(counts)}, CAST(stated AS BIGINT) AS stated_objects, CAST(seq AS BIGINT) AS seq
FROM (SELECT *, {reasons} AS reasons, {n_hints} AS n_hints, {stated} AS stated, {seq} AS seq FROM (SELECT t.tenant_id, t.k, {', '.join(f'{x} AS {name}' for name, x in counts.items())}
FROM (SELECT *, CAST(tenant_id[2:] AS BIGINT) AS k FROM ({f['tenants']}) t0) t) m) r"""
