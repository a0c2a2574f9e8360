"""Answers and how to go on, against a plain version over random tables."""

import random

import pytest

from quernstone.operators import answers as A

ENVELOPES = "envelope_id string, query_id long, revision int, evidence_set_ref string"
PARAMETERS = "envelope_id string, dimension_id string, status string, value string, assumption string, source string"
SPANS = "query_id long, span_id long, dimension_id string, value string, choices array<string>"
DIMENSIONS = "dimension_id string, version string, sensitivity string, can_be_assumed boolean"
RULES = "dimension_id string, preferred string, rationale string"
PATHS = "envelope_id string, dimension_id string"

REGISTRY = [("place", "9", "high", False), ("place", "10", "low", True), ("time", "1", "high", True), ("money", "1", "high", None), ("mood", "1", "medium", False)]
RULED = [("time", "b", "later leads"), ("mood", "zz", "never seen")]


def tables(seed: int):
    r = random.Random(seed)
    envelopes = [(f"e{i}", i // 2, r.randint(1, 3), r.choice([None, f"s{i}"])) for i in range(60)]
    parameters, paths = [], []
    for e, *_ in envelopes:
        for d in r.sample(["place", "time", "money", "mood", "unknown"], r.choice([0, 1, 2, 5])):
            parameters.append((e, d, r.choice(["resolved", "missing", "partially_resolved", "present", "unsupported"]), r.choice([None, "a", "b", "c"]), r.choice([None, None, "b"]), r.choice([None, "", "user"])))
            if r.random() < 0.5:
                paths.append((e, d))
    spans = []
    for q in range(28):
        for s in range(r.randint(0, 5)):
            if r.random() < 0.2:
                spans.append((q, s, None, None, None))
            for d in r.sample(["place", "time", "money", "other"], r.randint(0, 3)):
                kind = r.random()
                spans.append((q, s, d, r.choice("ab") if kind < 0.6 else None, r.sample("abc", 2) if 0.6 <= kind < 0.85 else None))
    return envelopes, parameters, spans, paths + paths[:3]


def plain(envelopes, parameters, spans):
    """A dictionary for each envelope, and the evidence as a set."""
    dims = {}
    for d, version, sensitivity, assumable in REGISTRY:
        if d not in dims or version > dims[d][0]:
            dims[d] = (version, sensitivity, assumable)
    rules = {d: (v, why) for d, v, why in RULED}
    records, refs = {}, set()
    for e, q, revision, _ in envelopes:
        params = {d: dict(status=s, value=v, assumption=a, source=src) for x, d, s, v, a, src in parameters if x == e}
        mine = [x for x in spans if x[0] == q]
        seen = {}
        for _, _, d, v, _ in mine:
            if d and v:
                seen.setdefault(d, set()).add(v)
        unlike = sorted(d for d, vs in seen.items() if len(vs) > 1 and (d in params or not params))
        ruled = [d for d in unlike if d in rules and rules[d][0] in seen[d]]
        for d in ruled:
            params[d] = dict(status="resolved", value=rules[d][0], assumption=None, source="domain_rule")
        open_ = [d for d in unlike if d not in ruled]
        high = [d for d in sorted(params) if d in dims and dims[d][1] == "high" and params[d]["status"] in A.OPEN]
        lost = [d for d in high if params[d]["status"] == "missing" and not dims[d][2]]
        counts = dict.fromkeys(A.CLASSES, 0)
        for s in {x[1] for x in mine}:
            classes = set()
            for d, p in params.items():
                if p["value"] is not None:
                    own = [(v, c) for _, y, z, v, c in mine if y == s and z == d and (v or c)]
                    classes.add("background" if not own else "supporting" if any(v == p["value"] for v, _ in own) else "partial" if any(c and p["value"] in c for _, c in own) else "conflicting")
            for c in classes:
                counts[c] += 1
                refs.add((e, s, c))
        assumed = [(d, params[d]["assumption"], params[d]["source"] or "assumption") for d in sorted(params) if params[d]["assumption"]]
        delivered = bool(counts["supporting"] or counts["partial"] or assumed or any(p["status"] == "resolved" for p in params.values()))
        reason = "insufficient_evidence" if not delivered else "unresolved_high_sensitivity" if high else "conflicts_retained" if open_ else None
        content = [f"Under assumption {d}={a}" for d, a, _ in assumed] + [A.SUPPORTED] * bool(counts["supporting"]) + [A.PARTLY] * bool(counts["partial"]) + [f"Domain rule applied to {d}" for d in ruled]
        notes = []
        for say, names in (("Unresolved high-sensitivity dimensions: ", high), ("Unavailable (cannot be assumed): ", lost), ("Conflicts retained: ", open_)):
            if names:
                notes.append(say + ", ".join(names))
        if counts["partial"]:
            notes.append(A.PARTIAL_NOTE)
        if ruled:
            notes.append("Domain rules applied: " + "; ".join(f"{d}: {rules[d][1]}" for d in ruled))
        statuses = ["assumption"] * len(assumed) + [A.CLAIMS[c][1] for c in A.CLAIMS if counts[c]] + ["conflicted"] * bool(open_) + ["supported"] * len(ruled)
        line = ["; ".join(content) or A.NOTHING] + (["Qualifications: " + "; ".join(notes)] if notes else [])
        line.append(f"Delivered={delivered}, ContextuallyComplete={not high and not open_}" + (f", Reason={reason}" if reason else ""))
        line += [say + ", ".join(names) for say, names in (("Unresolved: ", high), ("Unavailable: ", lost), ("Conflicts: ", open_)) if names]
        records[f"ans-{e}-r{revision + bool(ruled)}"] = (assumed, high, lost, open_, counts, statuses, notes, delivered, reason, " | ".join(line))
    return records, refs


def frames(spark, envelopes, parameters, spans):
    made = (("envelopes", envelopes, ENVELOPES), ("parameters", parameters, PARAMETERS), ("spans", spans, SPANS), ("dimensions", REGISTRY, DIMENSIONS), ("rules", RULED, RULES))
    return {name: spark.createDataFrame(rows, schema) for name, rows, schema in made}


@pytest.mark.parametrize("seed", [1, 2])
def test_answers(spark, seed):
    envelopes, parameters, spans, _ = tables(seed)
    t = frames(spark, envelopes, parameters, spans)
    want, refs = plain(envelopes, parameters, spans)
    got = {}
    for r in A.answers(**t).collect():
        counts = {c: r[c] for c in A.CLASSES}
        got[r.answer_id] = ([tuple(a) for a in r.assumptions], r.unresolved, r.unavailable, r.conflicts, counts, [c.support_status for c in r.claims], r.qualifications, r.delivered, r.reason, r.disclosure)
    assert got == want
    state = A.states(t["envelopes"], t["parameters"], t["spans"], t["dimensions"], t["rules"])
    rows = [tuple(r) for r in A.evidence(state, t["spans"]).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == refs


@pytest.mark.parametrize("seed", [3, 4])
def test_affordances(spark, seed):
    envelopes, parameters, spans, paths = tables(seed)
    t = frames(spark, envelopes, parameters, spans)
    query = {e: (q, ref) for e, q, _, ref in envelopes}
    want = set()
    for e, d, status, value, *_ in parameters:
        if status == "resolved":
            continue
        seen = {v for q, _, z, v, _ in spans if q == query[e][0] and z == d and v}
        for v in seen:
            want.add((f"aff-{e}-{d}-{v if len(seen) > 1 else 'reuse'}", v, "available", query[e][1]))
        if not seen and (e, d) in paths:
            want.add((f"aff-{e}-{d}-retrieve", value or "candidate", "retrievable", None))
    rows = [(r.affordance_id, r.target_value, r.availability, r.evidence_set_ref) for r in A.affordances(t["envelopes"], t["parameters"], t["spans"], spark.createDataFrame(paths, PATHS)).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_nothing_there(spark):
    """No parameters, spans, dimensions or rules: every envelope still has its record; without envelopes there is none."""
    t = {name: df.limit(0) if name != "envelopes" else df for name, df in frames(spark, [("e1", 1, 1, None)], [("e", "d", "s", None, None, None)], [(9, 9, None, None, None)]).items()}
    (r,) = A.answers(**t).collect()
    assert (r.content, r.delivered, r.complete, r.reason, r.claims) == (A.NOTHING, False, True, "insufficient_evidence", [])
    assert A.answers(**(t | {"envelopes": t["envelopes"].limit(0)})).count() == 0


def test_repeated_rows_change_nothing(spark):
    envelopes, parameters, spans, _ = tables(5)
    once, twice = frames(spark, envelopes, parameters, spans), frames(spark, envelopes, parameters * 2, spans * 2)
    assert sorted(map(repr, A.answers(**once).collect())) == sorted(map(repr, A.answers(**twice).collect()))


def test_open_high_by_the_latest_version(spark):
    rows = [("e", "place", "missing", None, None, None), ("e", "time", "missing", None, None, None), ("e", "money", "missing", None, None, None), ("f", "money", "partially_resolved", "a", None, None), ("f", "time", "resolved", "a", None, None)]
    found = A.open_high(spark.createDataFrame(rows, PARAMETERS), spark.createDataFrame(REGISTRY, DIMENSIONS)).collect()
    assert {tuple(r) for r in found} == {("e", "place", "missing", True), ("e", "time", "missing", False), ("e", "money", "missing", True), ("f", "money", "partially_resolved", False)}
