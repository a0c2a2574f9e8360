"""Places and sequence numbers in few large groups, given by ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.dialect import Dialect, Registry
from ..plans.numbering import numbered
from ..streaming.changes import LISTINGS, sync_folder
from ..views import run_sql

R = Registry()

#: The last number that earlier runs have given.
STORED_SEQ = 100


def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "SELECT conv_id, created, ord, source_platform FROM v_conversations")
    got = numbered(rows, ["source_platform"], [F.coalesce("created", F.lit("")).desc(), F.col("ord")])
    return got.select("conv_id", "created", (F.col("number") + 1).cast("int").alias("place"))


def by_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "SELECT conv_id, coalesce(title, CAST(conv_id AS STRING)) AS shown, ord, tenant_id FROM v_conversations")
    return numbered(rows, ["tenant_id"], [F.col("shown"), F.col("ord")]).select("conv_id", (F.col("number") + 1).cast("int").alias("place"))


def sequenced(changes: DataFrame, stored: int) -> DataFrame:
    """path, h, kind of a folder's changes with seq and event_id: creates and updates by path, then deletes, on from the stored number. The id of a
    change holds its content's digest, that of a delete its path's."""
    rows = changes.withColumn("gone", (F.col("kind") == "delete").cast("int"))
    got = numbered(rows, [], [F.col("gone"), F.col("path")]).withColumn("seq", F.col("number") + stored + 1)
    part = lambda x: F.substring(F.sha2(x, 256), 1, 12)
    path = F.col("path").cast("string")
    name = F.when(F.col("gone") == 1, F.concat(F.lit("del-"), part(path))).otherwise(F.concat(part(F.col("h")), F.lit("-"), path))
    return got.select("path", "kind", "seq", F.concat(F.lit("lf-"), F.col("seq").cast("string"), F.lit("-"), name).alias("event_id"))


def event_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, now = (run_sql(spark, sf_dir, sql) for sql in LISTINGS[:2])
    changes = sync_folder(now, before).join(now.select(F.col("path").alias("at"), "h").hint("merge"), F.col("path") == F.col("at"), "left").drop("at")
    return sequenced(changes, STORED_SEQ)


QUERIES = {"sort_newest_first": newest_first, "sort_index": by_title, "win_event_seq": event_seq}

R.plain(
    sort_newest_first="SELECT conv_id, created, row_number() OVER (PARTITION BY source_platform ORDER BY coalesce(created, '') DESC, ord) AS place FROM v_conversations",
    sort_index="SELECT conv_id, row_number() OVER (PARTITION BY tenant_id ORDER BY coalesce(title, CAST(conv_id AS STRING)), ord) AS place FROM v_conversations",
)


@R.add("win_event_seq")
def _(d: Dialect) -> str:
    return f"""
SELECT path, kind, seq, concat('lf-', CAST(seq AS VARCHAR), '-', CASE WHEN kind = 'delete' THEN concat('del-', substring(sha256(CAST(path AS VARCHAR)), 1, 12)) ELSE concat(substring(sha256(h), 1, 12), '-', CAST(path AS VARCHAR)) END) AS event_id
FROM (SELECT path, kind, h, {STORED_SEQ} + row_number() OVER (ORDER BY kind = 'delete', path) AS seq FROM
(SELECT coalesce(n.path, p.path) AS path, n.h AS h, CASE WHEN p.path IS NULL THEN 'create' WHEN n.path IS NULL THEN 'delete' ELSE 'update' END AS kind FROM ({LISTINGS[0]}) p FULL JOIN ({LISTINGS[1]}) n ON n.path = p.path
 WHERE p.path IS NULL OR n.path IS NULL OR p.h IS DISTINCT FROM n.h) c) s"""
