"""Weighted search of many requests against plain containment, word by word."""

import random

from quernstone.functions import weighted as W


def plain(requests, rows):
    out = {}
    for item, text in requests:
        term = (text or "").lower().strip()
        words = term.split()
        for kind, key, field, value in rows:
            if not term or not value:
                continue
            hits, (whole, each) = sum(w in value for w in words), W.WEIGHTS.get((kind, field), (0, 0))
            if hits:
                s, h = out.get((item, kind, key), (0, 0))
                out[item, kind, key] = s + whole * (term in value) + each * hits, h + hits
    score = lambda kind, s: W.ENTITY if kind == "entity" else W.WORDS_ONLY if kind == "attachment" and not s else s
    return {(*k, score(k[1], s)) for k, (s, h) in out.items() if score(k[1], s)}


def test_against_containment(spark, monkeypatch):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcé1-") for _ in range(r.choice([1, 2, 3, 4, 6])))
    say = lambda n: " ".join(word() for _ in range(r.randint(0, n)))
    fields = [*W.WEIGHTS, ("entity", "value")]
    rows = [(kind, f"{kind}{i}", field, say(30)) for i in range(40) for kind, field in fields]
    rows += [("knowledge", "big", "content", ("abc " * 5000) + "needle")] + [("entity", "null", "value", None), ("entity", "empty", "value", "")]
    requests = [(i, say(4)) for i in range(60)] + [(90, "ABC  Needle"), (91, "abc needle"), (92, "a a a"), (93, None), (94, " \t"), (95, "absentword a"), (96, rows[0][3])]
    for sent in (10**6, 0):
        monkeypatch.setattr(W, "SENT_WORDS", sent)
        got = W.search(spark.createDataFrame(requests, "item_id long, text string"), spark.createDataFrame(rows, "type string, id string, field string, text string"))
        found = [tuple(x) for x in got.collect()]
        assert len(found) == len(set(found)) and set(found) == plain(requests, rows)
    top = W.best(got, 3).collect()
    assert max(x.place for x in top) == 3 and all(x.score >= 1 for x in top)
    assert W.search(spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame(rows, "type string, id string, field string, text string")).count() == 0


def test_texts_do_not_travel(spark):
    """Texts of random letters cannot shrink: what is shuffled and written for few requests must be less than they are."""
    r = random.Random(3)
    text = lambda: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(2000))
    rows = spark.createDataFrame([("knowledge", f"d{i}", "content", text()) for i in range(40)], "type string, id string, field string, text string").repartition(4)
    requests = spark.createDataFrame([(i, r.choice("abcdefgh") + " abc zz") for i in range(20)], "item_id long, text string")
    for how in (W.search, W.search_ids):
        found = how(requests, rows)
        assert found.count() == 800
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "explode" not in plan.lower() and "Join" not in plan and "collect_list(packed" in plan
    assert {(x.item_id, x.id) for x in found.collect()} == {(x.item_id, x.id) for x in W.search(requests, rows).collect()}


def test_repeated_items_and_null_ids(spark):
    rows = spark.createDataFrame([("knowledge", "d", "title", "one two"), ("conversation", "d", "title", "two"), ("entity", None, "value", "two")], "type string, id string, field string, text string")
    requests = spark.createDataFrame([(1, "one"), (1, "two"), (None, "two\u3000ONE")], "item_id long, text string")
    assert {tuple(x) for x in W.search(requests, rows).collect()} == {(1, "knowledge", "d", 26), (1, "conversation", "d", 10), (1, "entity", None, 4), (None, "knowledge", "d", 6), (None, "conversation", "d", 2), (None, "entity", None, 4)}
    assert sorted(map(repr, W.search_ids(requests, rows).collect())) == sorted(f"Row(item_id={i}, id={x!r})" for i in (1, None) for x in ("d", None))
