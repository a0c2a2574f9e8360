"""Searches over small tables against scores of every pair."""

import math
import random
from decimal import ROUND_HALF_UP, Decimal

from quernstone.plans import catalog

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder, **given):
    for name, (data, schema) in given.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def level(text):
    v = sum(map(ord, text)) % 100 / 100
    return [v + 0.01 * i for i in range(128)]


def hybrid_score(asked, body):
    a, b, terms, words = level(asked), level(body), set(asked.lower().split()), body.lower().split()
    cosine = sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    score = 0.6 * cosine + 0.4 * sum(w in terms for w in words) / len(words)
    return float(Decimal(repr(round(score, 12))).quantize(Decimal("0.0001"), ROUND_HALF_UP))


def test_hybrid_scores_every_chunk_in_scope(spark, tmp_path):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    # One shared word among many scores less than a close level without any; the last requests share none.
    docs = [(i, " ".join([word() for _ in range(r.randint(15, 40))] + ["zebra"] * (i % 4 == 0)), "en", "s", 0) for i in range(180)]
    asked = [(i, ("zebra " if i < 6 else "") + "".join(r.choice("uvwxyz") for _ in range(9))) for i in range(12)]
    sf = tables(spark, tmp_path, documents=(docs, DOCUMENTS), benchmark=(asked, "item_id long, text string"))
    want = set()
    for item, q in asked:
        scope = [(hybrid_score(q, t), -i) for i, t, *_ in docs if i % 3 == item % 3 and i % 2 == item % 2]
        want |= {(item, f"d{-i}", s) for s, i in sorted(scope, reverse=True)[:5]}
    got = catalog.queries()["qry_hybrid_search"](spark, sf).collect()
    assert {(x.item_id, x.object_id, x.score) for x in got} == want
    top = catalog.queries()["top_hybrid"](spark, sf).collect()
    assert {(x.item_id, x.place) for x in top} == {(item, k) for item, _ in asked for k in (1, 2, 3)}


def test_signals_after_200_characters(spark, tmp_path):
    tail = " at https://late.org/x by late@late.org on 1999-12-31 in late.py, we will see Kubernetes [Source 9]"
    docs = [(1, "word " * 60 + tail, "en", "s", 0), (2, None, "en", "s", 0), (4, "short", "en", "s", 0)]
    talks = [(1, 0, "user", "word " * 60 + tail), (3, 1, "user", "short")]
    sf = tables(spark, tmp_path, documents=(docs, DOCUMENTS), conversations=(talks, "conv_id long, turn int, role string, text string"))
    rows = lambda key: catalog.queries()[key](spark, sf).collect()
    got = {(x.message_id, x.type, x.value) for x in rows("fn_regex_entities")}
    late = {("m1_0", "URL", "https://late.org"), ("m1_0", "Email Address", "late@late.org"), ("m1_0", "Date", "1999-12-31"), ("m1_0", "File Name", "late.py")}
    assert late <= got
    assert {x.days for x in rows("fn_temporal_signals") if x.message_id == "m1_0"} == {"1999-12-31"}
    assert {("email", "late@late.org"), ("url", "https://late.org/x")} <= {(x.type, x.value) for x in rows("fn_regex_v2") if x.doc_id == 1}
    assert "Kubernetes" in {x.term for x in rows("join_gazetteer") if x.doc_id == 1}
    assert "9" in {x.n for x in rows("fn_citation_indexes") if x.doc_id == 1}
    assert [x.decision for x in rows("fn_candidates") if x.doc_id == 1] == [True]


def test_cosine_asks_with_every_50th_vector(spark, tmp_path):
    r = random.Random(5)
    data = [(i, [r.random() for _ in range(8)]) for i in range(1050)]
    sf = tables(spark, tmp_path, embeddings=(data, "vec_id long, embedding array<double>"))
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)), 6)
    want = set()
    for i, v in data[::50]:
        best = sorted((-cos(v, w), j) for j, w in data if j != i)[:5]
        want |= {(i, j, k + 1) for k, (_, j) in enumerate(best)}
    assert {tuple(x) for x in catalog.queries()["qry_cosine"](spark, sf).collect()} == want


def test_line_ends_and_blank_lines_do_not_tell_texts_apart(spark, tmp_path):
    texts = ["A  b\n\nc", "a b\r\n\r\nc", "a b\r\rC ", "a b\n\n\n\n\nc", "a b\nc"]
    talks = [(i, 0, "user", t) for i, t in enumerate(texts, 1)]
    docs = [(i, t, "en", "s", 0) for i, t in enumerate(texts, 1)]
    sf = tables(spark, tmp_path, conversations=(talks, "conv_id long, turn int, role string, text string"), documents=(docs, DOCUMENTS))
    rows = lambda key: catalog.queries()[key](spark, sf).collect()
    assert sorted((x.canonical, x.alias, x.n) for x in rows("agg_fingerprint_groups")) == [(1, 1, 4), (1, 2, 4), (1, 3, 4), (1, 4, 4), (5, 5, 1)]
    assert {x.conv_id: x.canonical for x in rows("win_canonical")} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}
    assert len({x.normalized for x in rows("fn_normalize_text")}) == 2


def test_messages_are_not_joined_into_one(spark, tmp_path):
    """Two messages a and b are another conversation than one message whose text looks like both."""
    talks = [(1, 0, "user", "a"), (1, 1, "user", "b"), (2, 0, "user", "a|user:b"), (3, 0, " User", "a"), (3, 1, "user", "b")]
    sf = tables(spark, tmp_path, conversations=(talks, "conv_id long, turn int, role string, text string"))
    assert {x.conv_id: x.canonical for x in catalog.queries()["win_canonical"](spark, sf).collect()} == {1: 1, 2: 2, 3: 1}


def test_caps_and_totals(spark, tmp_path):
    talks = [(1, i, "user", f"we will see {i}") for i in range(60)] + [(i, 0, "user", f"the talk {i}") for i in range(2, 50)]
    docs = [(i, "text", "en", "s", 0) for i in range(1200)]
    sf = tables(spark, tmp_path, conversations=(talks, "conv_id long, turn int, role string, text string"), documents=(docs, DOCUMENTS))
    rows = lambda key: catalog.queries()[key](spark, sf).collect()
    assert {x.message_id for x in rows("win_candidate_cap") if x.conv_id == 1} == {f"m1_{i}" for i in range(50)}
    first = rows("win_first_wins")
    assert len(first) == len({x.object_id for x in first}) == 1200 and "again" not in {x.source_platform for x in first}
    for key in ("page_slice", "flt_list_title"):
        plan = catalog.queries()[key](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "Window [" not in plan
    assert [(x.conv_id, x.total) for x in rows("page_slice")] == [(i, 53) for i in range(21, 41)]
    assert {x.total for x in rows("flt_list_title")} == {len(rows("flt_list_title"))}
