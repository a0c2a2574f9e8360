"""The change log as streams: replays, split and late batches, restarts, dead letters, and sessions at the boundary."""

import itertools
import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quernstone.streaming import changes, queue

SCOPED = ("folder", "t1", "s1")


def fold(events):
    """One event after the other, as the contract of the change log has it."""
    objects, permissions = {}, {}
    for event_id, kind, text, can_read, *scope in sorted(events, key=lambda e: e[0]):
        key = tuple(scope)
        if key[-1] is None:
            continue
        if kind in ("create", "update") and text:
            objects[key] = text
        elif kind == "delete":
            objects.pop(key, None), permissions.pop(key, None)
        elif kind == "permission_change" and can_read is not None:
            permissions[key] = can_read
    return objects, permissions


@pytest.fixture
def folder(tmp_path):
    return f"{tmp_path}/{uuid.uuid4().hex}"


def some_events(n=400):
    r = random.Random(9)
    kinds = ["create", "update", "delete", "permission_change", "other"]
    out = [(1, "permission_change", None, False, *SCOPED, "before"), (2, "create", "text", None, *SCOPED, "before"), (3, "update", "new", None, *SCOPED, "before"), (4, "create", "x", None, *SCOPED, None)]
    for i in range(5, n):
        scope = (r.choice(["folder", "mail"]), f"t{r.randint(0, 1)}", "s1", f"o{min(r.randint(0, 30), r.randint(0, 30))}")
        out.append((i, r.choice(kinds), r.choice(["", None, f"text {i}", f"text {i}"]), r.choice([None, True, False]), *scope))
    return out


def test_fold_over_replays_splits_and_disorder(spark, folder):
    events = some_events()
    objects, permissions = fold(events)
    batches = [events[250:], events[:100], events[90:260], events[:30]]

    def run(some):
        if some:
            spark.createDataFrame(some, queue.EVENT).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        queue.fold_changes(queue.files(spark, f"{folder}/in", queue.EVENT), folder)

    for some in batches:
        run(some)
    key = lambda r: (r.source, r.tenant_id, r.silo_id, r.object_id)
    # Through all versions, since the result names objects without their scope.
    versions = spark.read.parquet(f"{folder}/versions")
    last = {key(r): r for r in sorted(versions.collect(), key=lambda r: r.batch)}
    assert {k: r.text for k, r in last.items() if r.written and (r.deleted is None or r.written > r.deleted)} == objects
    assert {k: r.can_read for k, r in last.items() if r.permitted and (r.deleted is None or r.permitted > r.deleted)} == permissions
    assert last[(*SCOPED, "before")].can_read is False
    before = sorted(map(tuple, queue.folded(spark, folder).collect()), key=repr)
    assert len(before) == len(last)
    run([])  # a restart without news
    run(events)  # a replay of everything
    assert sorted(map(tuple, queue.folded(spark, folder).collect()), key=repr) == before


def test_fold_sends_few_rows_for_a_hot_object(spark):
    hot = spark.range(50_000).select(F.col("id").alias("event_id"), F.lit("update").alias("kind"), F.lit("x").alias("text"), F.lit(None).cast("boolean").alias("can_read"), *[F.lit("a").alias(c) for c in queue.SCOPE])
    assert queue.lanes(hot).mapInPandas(queue._latest, queue.LANES).count() <= 50


def test_fold_runs_no_python_for_an_object(spark, folder, monkeypatch):
    spark.createDataFrame(some_events(), queue.EVENT).write.parquet(f"{folder}/in")
    folds = []
    monkeypatch.setattr(queue, "drain", lambda query, *_: folds.append(query))
    queue.fold_changes(queue.files(spark, f"{folder}/in", queue.EVENT), folder)
    plan = folds[0]._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "Pandas" not in plan and "TransformWithState" not in plan
    # A hot object leaves a task as one row.
    hot = spark.range(0, 50_000, 1, 3).select(F.col("id").alias("event_id"), F.lit("update").alias("kind"), F.col("id").cast("string").alias("text"), F.lit(None).cast("boolean").alias("can_read"), *[F.lit("a").alias(c) for c in queue.SCOPE])
    one = queue.last_changes(queue.lanes(hot))
    assert [(r.written, r.text, r.deleted, r.permitted, r.can_read) for r in one.collect()] == [(49_999, "49999", None, None, None)]
    assert "partial_max_by" in one._jdf.queryExecution().executedPlan().toString()


def test_ingest_inside_and_outside_a_watermark(spark, folder):
    shape = "event_id long, occurred_at timestamp, note string"
    t0 = datetime(2024, 1, 1)
    event = lambda i, note="": (i, t0 + timedelta(hours=i), note)
    batches = [
        [event(i) for i in range(50)] + [event(3, "twice in a batch")] * 40,
        [event(49, "inside"), event(1, "long past"), event(200), (500, None, "no time")],
        [event(60, "new and late"), event(200, "again"), (500, None, "again")],
    ]
    for some in batches:
        spark.createDataFrame(some, shape).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        queue.ingest(queue.files(spark, f"{folder}/in", shape), folder)
    queue.ingest(queue.files(spark, f"{folder}/in", shape), folder)
    got = queue.delivered(spark, folder, shape).collect()
    assert len(got) == sum(map(len, batches))
    new = [(r.batch, r.event_id) for r in got if r.is_new]
    assert sorted(new) == [(0, i) for i in range(50)] + [(1, 200), (1, 500), (2, 60)]


def test_bounded_ingest_evicts(spark, folder):
    shape, t0 = "event_id long, occurred_at timestamp", datetime(2024, 1, 1)
    seen = []
    for some in ([(1, t0), (1, t0), (2, t0 + timedelta(hours=3))], [(2, t0 + timedelta(hours=3)), (3, t0 + timedelta(hours=9))], [(1, t0), (3, t0 + timedelta(hours=9))]):
        spark.createDataFrame(some, shape).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        once = queue.ingest_within(queue.files(spark, f"{folder}/in", shape), "2 hours")
        queue.drain(once, folder, lambda batch, number: seen.extend(r.event_id for r in batch.collect()))
    assert sorted(seen) == [1, 2, 3]


SHAPE = "event_id long, need int"


def run_queue(spark, folder, clock):
    queue.attempt(spark, folder, SHAPE, F.col("attempts") >= F.col("need"), lambda: clock[0])


def test_retries_and_dead_letters(spark, folder):
    items = [(i, i % 7) for i in range(70)]
    queue.enqueue(spark.createDataFrame(items, SHAPE), folder)
    clock = [0]
    run_queue(spark, folder, clock)
    assert queue.status(spark, folder, SHAPE).count() == 10
    run_queue(spark, folder, clock)  # nothing is due yet
    assert queue.status(spark, folder, SHAPE).count() == 10
    for t in (2, 6, 14, 30, 31, 400):
        clock[0] = t
        run_queue(spark, folder, clock)
    got = {r.event_id: (r.attempts, r.waited_s, r.status) for r in queue.status(spark, folder, SHAPE).collect()}
    wait = list(itertools.accumulate([0, 2, 4, 8, 16]))
    assert got == {i: (k + 1, wait[k], "processed") if k < 5 else (5, 30, "failed") for i, k in items}
    assert queue.status(spark, folder, SHAPE).count() == 70
    dead = [r.event_id for r in queue.dead_letters(spark, folder, SHAPE).collect()]
    assert len(dead) == len(set(dead)) == 20
    queue.reset(spark, folder, SHAPE, spark.createDataFrame([(5,), (6,), (1,)], "event_id long"))
    assert queue.dead_letters(spark, folder, SHAPE).count() == 18
    for t in (500, 600, 700, 800, 900):
        clock[0] = t
        run_queue(spark, folder, clock)
    assert sorted(r.event_id for r in queue.dead_letters(spark, folder, SHAPE).collect()) == sorted(dead)


def test_a_repeated_batch_adds_nothing(spark, folder, monkeypatch):
    """The first try of a batch dies after all its writes and is run again from the checkpoint."""
    queue.enqueue(spark.createDataFrame([(1, 0), (2, 9), (3, 1)], SHAPE), folder)
    dies = [True]
    real = queue.drain

    def dying(stream, where, each, mode="append"):
        def step(batch, number):
            each(batch, number)
            if dies[0]:
                dies[0] = False
                raise RuntimeError("lost")

        real(stream, where, step, mode)

    monkeypatch.setattr(queue, "drain", dying)
    with pytest.raises(Exception, match="lost"):
        run_queue(spark, folder, [0])
    for t in (0, 10, 20, 40, 80, 160):
        run_queue(spark, folder, [t])
    assert sorted((r.event_id, r.attempts, r.status) for r in queue.status(spark, folder, SHAPE).collect()) == [(1, 1, "processed"), (2, 5, "failed"), (3, 2, "processed")]


def test_sessions_at_the_boundary(spark, folder):
    """A gap of just the window joins two records, a longer one parts them; closed sessions are sent once."""
    t0, shape, sent = datetime(2024, 1, 1), "object_id string, at timestamp", []
    minutes = {"a": [0, 30, 60], "b": [0, 30.1, 60], "c": [0, 31, 61, 100]}
    rows = [(k, t0 + timedelta(minutes=m)) for k, ms in minutes.items() for m in ms]
    for some in (rows, [("late", t0 + timedelta(days=1))], [("later", t0 + timedelta(days=2))]):
        spark.createDataFrame(some, shape).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        closed = changes.sessions(queue.files(spark, f"{folder}/in", shape))
        queue.drain(closed, folder, lambda batch, number: sent.extend((r.object_id, r.records) for r in batch.collect()))
    assert sorted(sent) == [("a", 3), ("b", 1), ("b", 2), ("c", 1), ("c", 1), ("c", 2), ("late", 1)]
