"""op2 and op3: held-out accuracy on planted classes, brute-force votes, awkward rows."""

import random

import numpy as np
from helpers import frame, rows

from quernstone.llm import quality_knn, toxicity


def corpus(n=400, seed=5):
    r = random.Random(seed)
    vocab = ["".join(r.choice("aeiounrst") for _ in range(r.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.randint(20, 200))]
        good, toxic = i % 4 != 0, i % 5 == 0
        if toxic:
            for _ in range(r.randint(1, 5)):
                w[r.randrange(len(w))] = r.choice(["idiot", "scum", "zolbran", "zolbrix", "zolbaro"])
        if not good:
            w = [x + r.choice(["###", "$$$"]) for x in w] if i % 8 else [x.upper() + "!!" for x in w]
        docs.append((i, " ".join(w), None, None, None, None, None, None))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


def test_quality(spark):
    docs, labels = corpus()
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").where("doc_id % 3 <> 1")
    got = {r.doc_id: r.score for r in quality_knn.knn_scores(frame(spark, docs + [(9999, None, *[None] * 6)]), known).collect()}
    right = [(got[i] >= 0.5) == q for i, q, _ in labels if i % 3 == 1]
    assert len(got) == len(docs) + 1 and np.mean(right) > 0.97 and 0 <= got[9999] <= 1


def test_vote_is_exact():
    r = np.random.default_rng(2)
    q, known, y = (quality_knn.unit(r.standard_normal(s)) for s in ((20, 6), (300, 6), (300, 1)))
    y = (y[:, 0] > 0).astype(float)
    want = []
    for v in q:
        near = np.argsort(-(known @ v))[: quality_knn.NEIGHBOURS]
        w = np.maximum(known[near] @ v, 0) ** quality_knn.POWER
        want.append((w @ y[near] + 5e-4) / (w.sum() + 1e-3))
    assert np.allclose(quality_knn.vote(q, known, y, 0.5), want)


def test_toxicity(spark):
    docs, labels = corpus(600)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").where("doc_id % 4 <> 2")
    got = {r.doc_id: r.score for r in toxicity.toxic_scores(frame(spark, docs), known).collect()}
    test = [(got[i] >= 0.3, t) for i, _, t in labels if i % 4 == 2]
    assert np.mean([p for p, t in test if t]) > 0.9 and np.mean([p for p, t in test if not t]) < 0.02


def test_label_model_reads_correlations():
    r = np.random.default_rng(3)
    y = r.random(20_000) < 0.15
    cast = lambda acc: np.where(y, np.where(r.random(len(y)) < acc, 2, 1), np.where(r.random(len(y)) < 0.01, 2, 1))
    a, b, c = cast(0.7), cast(0.6), cast(0.5)
    v, n = np.unique(np.stack([a, b, c, np.where(r.random(len(y)) < 0.95, c, 1)], axis=1), axis=0, return_counts=True)
    model = toxicity.LabelModel(v, n.astype(float))
    assert abs(model.prior - 0.15) < 0.04 and {3: 2, 2: 3}.get(3) == model.parent[3] or model.parent[2] == 3
    assert model(np.array([[2, 2, 2, 2]]))[0] > 0.9 > 0.1 > model(np.array([[1, 1, 1, 1]]))[0]


def test_awkward_rows(spark):
    docs = frame(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(0, 1, 1), (0, 0, 0), (None, 1, 1), (1, None, None), (2, 0, 0), (3, 1, 0), (777, 1, 1)], "doc_id long, quality int, toxic int")
    for score in (quality_knn.knn_scores, toxicity.toxic_scores):
        for labels in (none, odd):
            got = score(docs, labels).collect()
            assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows()) and all(0 <= r.score <= 1 for r in got)
        assert score(frame(spark, []), odd).collect() == []
