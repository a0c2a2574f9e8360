"""Health: each rule by a tenant of its own, and queue metrics against a plain count."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from quernstone.operators import health as H

NOW = dt.datetime(2026, 1, 1, 12)
SHAPES = {
    "tenants": "tenant_id string, now timestamp, strict boolean, wants_package boolean, wants_snapshot boolean",
    "events": "tenant_id string, status string, attempts long, enqueued_at timestamp, next_retry_at timestamp, processed_at timestamp",
    "files": "tenant_id string, what string, body string, written_at timestamp",
    "tracked": "tenant_id string, path string",
    "objects": "tenant_id string, object_id string",
    "sources": "tenant_id string, object_id string, scoped_id string",
    "permissions": "tenant_id string, scoped_id string, can_read boolean, recorded_from_event string",
}


def before(s):
    return NOW - dt.timedelta(seconds=s)


def reports(spark, **rows):
    return {r.tenant_id: r for r in H.report(**{name: spark.createDataFrame(rows.get(name, []), shape) for name, shape in SHAPES.items()}).collect()}


def reasons(spark, **rows):
    found = reports(spark, **rows)
    assert all((r.status == "WARNING") == bool(r.reasons) and len(r.hints) == len(r.reasons) for r in found.values())
    return {t: r.reasons for t, r in found.items()}


def test_headers(spark):
    bodies = {"good": '{"version": 1}', "real": '{"version": 1.0}', "text": '{"version": "1"}', "two": '{"version": 2}', "none": "{}", "null": '{"version": null}', "list": "[1]", "broken": "{", "empty": "", "nothing": None}
    tenants = [(t, NOW, False, True, True) for t in [*bodies, "absent"]] + [("asks nothing", NOW, False, False, False)]
    files = [(t, "snapshot", b, NOW) for t, b in bodies.items()] + [(t, "package", "{}", NOW) for t in bodies]
    got = reasons(spark, tenants=tenants, files=files)
    odd, broken = ["snapshot_version_unexpected"], ["snapshot_unreadable"]
    assert got == {"good": [], "real": [], "text": odd, "two": odd, "none": odd, "null": odd, "list": broken, "broken": broken, "empty": broken, "nothing": broken, "absent": ["package_missing", "snapshot_missing"], "asks nothing": []}


def test_packages(spark):
    tenants = [(t, NOW, t != "lax", True, False) for t in ("ok", "lax", "wrong count", "bad", "orphan", "unrecorded", "bare")]
    body = {"bad": "nope", "wrong count": '{"metadata": {"object_count": 7}}', "ok": '{"metadata": {"object_count": 2}}'}
    files = [(t, "package", body.get(t, "{}"), NOW) for t, *_ in tenants]
    objects = [(t, o) for t, *_ in tenants for o in ("a", "b")]
    # a has two sources, of which one entry is enough; b has none.
    sources = [(t, "a", s) for t, *_ in tenants for s in ("s1", "s2", "s2")]
    permissions = [(t, "s1", True, "e") for t in ("ok", "wrong count", "orphan", "unrecorded")] + [("orphan", "gone", False, "e"), ("unrecorded", "s2", None, ""), ("bad", "gone", None, None)]
    got = reasons(spark, tenants=tenants, files=files, objects=objects, sources=sources, permissions=permissions)
    assert got == {
        "ok": [], "lax": [], "wrong count": ["object_count_mismatch"], "bad": ["package_unreadable"], "orphan": ["orphaned_permission_entries"],
        "unrecorded": ["permissions_missing_event_provenance"], "bare": ["objects_without_explicit_permission"],
    }


def test_snapshot_against_package(spark):
    tenants = [(t, NOW, False, True, True) for t in ("same", "more")]
    files = [(t, w, '{"version": 1}', NOW) for t in ("same", "more") for w in ("package", "snapshot")]
    got = reasons(spark, tenants=tenants, files=files, objects=[("same", "a"), ("more", "a")], tracked=[("same", "p"), ("more", "p"), ("more", "q")])
    assert got == {"same": [], "more": ["snapshot_package_count_mismatch"]}


def test_queues(spark):
    tenants = [(t, NOW, False, t == "lag", False) for t in ("young", "old", "six wait", "failed", "lag")]
    later = NOW + dt.timedelta(seconds=1)
    events = [("young", "queued", 0, before(600), None, None), ("old", "queued", 0, before(601), NOW, None), ("failed", "failed", 5, before(1), None, None), ("lag", "processed", 0, before(9), None, before(99))]
    events += [("six wait", "queued", 1, before(5), later, None)] * 6
    got = reasons(spark, tenants=tenants, events=events, files=[("lag", "package", "{}", before(400))])
    assert got == {"young": [], "old": ["queue_age_high"], "six wait": ["waiting_retry_high", "no_ready_events"], "failed": ["failed_events"], "lag": ["package_lag_high"]}


def test_queue_metrics_by_plain_count(spark):
    r = random.Random(3)
    events = [(r.choice("ab"), r.choice(["queued", "processed", "failed", None]), r.choice([None, 0, 4, 5, 9]), before(r.randint(0, 50)), r.choice([None, before(1), NOW, NOW + dt.timedelta(seconds=1)]), r.choice([None, before(7), before(3)])) for _ in range(300)]
    rows = {x.tenant_id: x for x in H.queue_metrics(spark.createDataFrame(events, SHAPES["events"]), F.lit(NOW), ["tenant_id"]).collect()}
    for t in "ab":
        mine = [e for e in events if e[0] == t]
        queued = [e for e in mine if e[1] == "queued"]
        due = [e for e in queued if e[4] is None or e[4] <= NOW]
        x = rows[t]
        assert (x.queued, x.processed, x.failed) == tuple(sum(e[1] == s for e in mine) for s in ("queued", "processed", "failed"))
        assert (x.stuck, x.ready, x.waiting) == (sum((e[2] or 0) >= 5 for e in queued), len(due), len(queued) - len(due))
        assert x.oldest_queued_s == (NOW - min(e[3] for e in queued)).total_seconds()
        last = max(e[5] for e in mine if e[1] == "processed" and e[5])
        assert x.last_processed_us == last.timestamp() * 1_000_000


def test_nothing(spark):
    assert reports(spark) == {}
    (r,) = reports(spark, tenants=[("t", NOW, True, False, False)]).values()
    assert (r.status, r.objects, r.queued, r.oldest_queued_s, r.package_lag_s) == ("OK", 0, 0, None, None)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_every_reason_occurs_in_the_query(spark):
    rows = {r.tenant_id: r for r in H.health_reasons(spark, "/root/testdata/sf0.001").collect()}
    assert {x for r in rows.values() for x in r.reasons.split(",") if x} == set(H.REASONS)
    assert rows["h0"].status == "OK"
