"""The change log as streams: ingest that takes each event once, a keyed fold to the living objects, retries and dead letters.

Every job survives a repeated batch: what a batch writes lies in a folder of its number and replaces what an earlier try left there."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What identifies an object in the change log.
SCOPE = ["source", "tenant_id", "silo_id", "object_id"]
EVENT = "event_id long, kind string, text string, can_read boolean, " + ", ".join(f"{c} string" for c in SCOPE)

WRITTEN, DELETED, PERMITTED = "written", "deleted", "permitted"
LANES = "lane string, event_id long, text string, can_read boolean, " + ", ".join(f"{c} string" for c in SCOPE)
STATE = "written long, text string, deleted long, permitted long, can_read boolean"


def files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).parquet(path)


def drain(query: DataFrame, folder: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Runs a stream over all that is there and not done yet; folder keeps its checkpoint."""
    query.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """RocksDB, so that the states of all objects need not fit the memory of the executors; what is set now goes into a new stream's checkpoint."""
    name, found = "spark.sql.streaming.stateStore.providerClass", None
    found = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, found) if found else spark.conf.unset(name)


# Fold of the change log ------------------------------------------------------------------------------------------------


def lanes(events: DataFrame) -> DataFrame:
    """What bears on an object: its writes with a text, its deletes, and its permission changes with a value. Others are no changes."""
    lane = (
        F.when(F.col("kind").isin("create", "update") & (F.col("text") != ""), WRITTEN)
        .when(F.col("kind") == "delete", DELETED)
        .when((F.col("kind") == "permission_change") & F.col("can_read").isNotNull(), PERMITTED)
    )
    return events.where(F.col("object_id").isNotNull()).select(lane.alias("lane"), "event_id", "text", "can_read", *SCOPE).where("lane IS NOT NULL")


def _latest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The last event of each lane of each object, a batch at a time: the plain form of what last_changes does in a task before rows are dealt."""
    for rows in batches:
        yield rows.sort_values("event_id").drop_duplicates(["lane", *SCOPE], keep="last")


def last_changes(changed: DataFrame) -> DataFrame:
    """The last write, delete and permission change of each object, of lanes. Each is a maximum over event numbers, so replays change nothing and
    batches may come split or out of order; a permission may come before its object, and a delete takes both. As an aggregate it is the
    state of a stream too, without Python for each object."""
    on = lambda lane, what: F.when(F.col("lane") == lane, F.col(what))
    at = lambda lane: F.max(on(lane, "event_id")).alias(lane)
    of = lambda lane, what: F.max_by(on(lane, what), on(lane, "event_id")).alias(what)
    return changed.groupBy(*SCOPE).agg(at(WRITTEN), of(WRITTEN, "text"), at(DELETED), at(PERMITTED), of(PERMITTED, "can_read"))


def fold_changes(events: DataFrame, folder: str) -> None:
    """Folds a stream of events (EVENT) into versions of objects, a folder for each batch."""
    changed = last_changes(lanes(events))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/versions/batch={number}")

    with keyed_state(events.sparkSession):
        drain(changed, folder, keep, "update")


def folded(spark: SparkSession, folder: str) -> DataFrame:
    """Every object's last version."""
    versions = spark.read.schema(", ".join(f"{c} string" for c in SCOPE) + f", {STATE}, batch long").parquet(f"{folder}/versions")
    last = versions.groupBy(*SCOPE).agg(F.max_by(F.struct("written", "text", "deleted", "permitted", "can_read"), "batch").alias("v"))
    return living(last.select(*SCOPE, "v.*"))


def living(state: DataFrame) -> DataFrame:
    """object_id, present, content_id (of the text, as far as present), can_read (as far as a permission is in force) of folded objects."""
    present = F.col("written").isNotNull() & (F.col("deleted").isNull() | (F.col("written") > F.col("deleted")))
    permitted = F.col("permitted").isNotNull() & (F.col("deleted").isNull() | (F.col("permitted") > F.col("deleted")))
    content = F.concat(F.lit("text_"), F.substring(F.sha2("text", 256), 1, 16))
    return state.select("object_id", present.alias("present"), F.when(present, content).alias("content_id"), F.when(permitted, F.col("can_read")).alias("can_read"))


# Ingest ----------------------------------------------------------------------------------------------------------------


def ingest(deliveries: DataFrame, folder: str, at_col: str = "occurred_at") -> None:
    """Takes each event of a stream once, however often and however late it is delivered: every delivery is kept, with `is_new`.

    A replay has the time of its event, so of what came before only the days of a batch's own events are read. The log is the state:
    nothing is evicted and nothing late is lost."""
    spark = deliveries.sparkSession
    shape = ", ".join(f"`{c}` {kind}" for c, kind in deliveries.dtypes)

    def take(batch: DataFrame, number: int) -> None:
        landed = f"{folder}/landed/batch={number}"
        batch.withColumn("place", F.monotonically_increasing_id()).withColumn("day", F.coalesce(F.to_date(at_col), F.to_date(F.lit("1970-01-01")))).write.mode("overwrite").parquet(landed)
        rows = spark.read.schema(f"{shape}, place long, day date").parquet(landed)
        first = rows.groupBy("event_id").agg(F.min("place").alias("place"))
        days = [r["day"] for r in rows.select("day").distinct().collect()]  # days of one batch
        if number and days:
            seen = accepted(spark, folder, shape).where(F.col("day").isin(days) & (F.col("batch") < number))
            first = first.join(seen.select("event_id").hint("merge"), "event_id", "left_anti")
        # By event and place, so that an event delivered very often is no hot key.
        first = first.withColumn("is_new", F.lit(True)).hint("merge")
        told = rows.join(first, ["event_id", "place"], "left").withColumn("is_new", F.coalesce("is_new", F.lit(False)))
        told.drop("place").write.mode("overwrite").partitionBy("day").parquet(f"{folder}/log/batch={number}")

    drain(deliveries, folder, take)


def delivered(spark: SparkSession, folder: str, shape: str) -> DataFrame:
    return spark.read.schema(f"{shape}, is_new boolean, batch long, day date").option("basePath", f"{folder}/log").parquet(f"{folder}/log")


def accepted(spark: SparkSession, folder: str, shape: str) -> DataFrame:
    return delivered(spark, folder, shape).where("is_new")


def ingest_within(deliveries: DataFrame, delay: str, at_col: str = "occurred_at") -> DataFrame:
    """The bounded form of ingest, for streams in which nothing new is later than delay: the state of an event goes when the watermark passes
    it, and what is later is left out. Streams without that promise take ingest."""
    return deliveries.withWatermark(at_col, delay).dropDuplicatesWithinWatermark(["event_id"])


# Retries ---------------------------------------------------------------------------------------------------------------

MAX_ATTEMPTS, LONGEST_WAIT_S = 5, 300


def enqueue(items: DataFrame, folder: str, generation: int = 0) -> None:
    """Adds work: items have an event_id and whatever the process needs."""
    work = items.select("*", F.lit(0).alias("attempts"), F.lit(0).cast("long").alias("due_s"), F.lit(0).cast("long").alias("waited_s"), F.lit(generation).alias("generation"))
    name = uuid.uuid4().hex
    work.write.parquet(f"{folder}/queue/new-{name}")
    work.where("false").select("event_id", "generation").write.parquet(f"{folder}/resets/none-{name}")


def attempt(spark: SparkSession, folder: str, shape: str, succeeds: Column, clock: Callable[[], int], max_attempts: int = MAX_ATTEMPTS) -> None:
    """One pass over the queue. What is due is processed; what fails waits 2^attempts seconds, 300 at most, and goes to the dead
    letters after max_attempts. What is not due yet goes back as it is. succeeds may use the columns of items and `attempts`."""
    full = f"{shape}, attempts int, due_s long, waited_s long, generation int"

    def step(batch: DataFrame, number: int) -> None:
        now = int(clock())
        tried = f"{folder}/tried/batch={number}"
        batch.select("*", (F.col("due_s") <= now).alias("due"), F.coalesce(succeeds, F.lit(False)).alias("ok")).write.mode("overwrite").parquet(tried)
        rows = spark.read.schema(f"{full}, due boolean, ok boolean").parquet(tried)
        wait = F.least(F.pow(F.lit(2.0), F.col("attempts").cast("double")), F.lit(float(LONGEST_WAIT_S))).cast("long")
        done = rows.where("due").withColumn("attempts", F.col("attempts") + 1).drop("due")
        done.where("ok").drop("ok").write.mode("overwrite").parquet(f"{folder}/processed/batch={number}")
        failed = done.where("NOT ok").drop("ok")
        failed.where(F.col("attempts") >= max_attempts).write.mode("overwrite").parquet(f"{folder}/dead/batch={number}")
        again = failed.where(F.col("attempts") < max_attempts).withColumn("due_s", now + wait).withColumn("waited_s", F.col("waited_s") + wait)
        # Last, and in one folder: a repeated batch replaces what its first try put back, before any later batch could have read it.
        rest = again.unionByName(rows.where("NOT due").drop("due", "ok"))
        if not rest.isEmpty():
            rest.write.mode("overwrite").parquet(f"{folder}/queue/from-{number}")

    drain(files(spark, f"{folder}/queue/*", full), folder, step)


def outcome(spark: SparkSession, folder: str, shape: str, name: str) -> DataFrame:
    return spark.read.schema(f"{shape}, attempts int, due_s long, waited_s long, generation int, batch long").parquet(f"{folder}/{name}").drop("batch")


def dead_letters(spark: SparkSession, folder: str, shape: str) -> DataFrame:
    """Items that failed for good and were not put back since."""
    dead = outcome(spark, folder, shape, "dead")
    back = spark.read.schema("event_id long, generation int").parquet(f"{folder}/resets/*")
    return dead.join(back.hint("merge"), ["event_id", "generation"], "left_anti")


def reset(spark: SparkSession, folder: str, shape: str, ids: DataFrame) -> None:
    """Puts dead letters back into the queue with no attempt counted, as a next generation of the same events."""
    chosen = dead_letters(spark, folder, shape).join(ids.select("event_id").distinct().hint("merge"), "event_id", "left_semi")
    name = uuid.uuid4().hex
    chosen.select("event_id", "generation").write.parquet(f"{folder}/resets/{name}")
    columns = [c.strip().split()[0].strip("`") for c in shape.split(",")]
    work = spark.read.schema("event_id long, generation int").parquet(f"{folder}/resets/{name}")
    items = outcome(spark, folder, shape, "dead").join(work.hint("merge"), ["event_id", "generation"]).select(*columns, F.lit(0).alias("attempts"), F.lit(0).cast("long").alias("due_s"), F.lit(0).cast("long").alias("waited_s"), (F.col("generation") + 1).alias("generation"))
    items.write.parquet(f"{folder}/queue/reset-{name}")


def status(spark: SparkSession, folder: str, shape: str) -> DataFrame:
    """event_id, attempts, waited_s, status of all that is processed or dead."""
    done = outcome(spark, folder, shape, "processed").withColumn("status", F.lit("processed"))
    return done.unionByName(dead_letters(spark, folder, shape).withColumn("status", F.lit("failed"))).select("event_id", "attempts", "waited_s", "status")
