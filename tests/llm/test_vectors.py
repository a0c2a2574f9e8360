"""Whitening and clustering against plain numpy and Python, with every awkward row."""

import hashlib
import os
import random

import duckdb
import numpy as np
import pytest

from quernstone.llm import centroids, queries, whitening

SHAPE = "vec_id long, embedding array<float>, label int, x string, number long, z string, cluster int, n string, at string, id string"


def vectors(seed=3, n=150, size=64, equal=60):
    r = random.Random(seed)
    good = [[r.gauss(0, 0.3) + (i % 3) * 0.2 for _ in range(size)] for i in range(n)]
    good += [good[0]] * equal + [[0.0] * size, [-x for x in good[1]]]
    bad = [None, [], [None] * size, [float("nan")] * size, [float("inf")] + [0.0] * (size - 1), [0.5] * (size - 1), [0.5] * (size + 1), [3e38] * size]
    rows = [(i, v, 1, "x", 5, "z", 2, "n", "a", "i") for i, v in enumerate(good + bad)]
    return rows + [rows[0], rows[1], (None, good[2], None, None, None, None, None, None, None, None), (7, good[3], None, None, None, None, None, None, None, None)]


def usable(rows, size, unit, bound):
    out = []
    for row in rows:
        v = row[1]
        if v is None or len(v) != size or any(c is None or not np.isfinite(c) for c in v):
            continue
        x = [int(np.floor(unit * float(np.float32(c)))) for c in v]
        if max(map(abs, x)) < bound:
            out.append((row[0], x))
    return out


@pytest.mark.parametrize("size", [64, 5])
def test_whitening(spark, size):
    data = vectors(size=size)
    got = whitening.whitened(spark.createDataFrame(data, SHAPE)).collect()
    rows = [(i, [c + 1_000_000 for c in x]) for i, x in usable(data, size, 64, 2**40)]
    fit = np.array(sorted(set(tuple(x) for _, x in rows)), dtype=np.int64)
    n, s, top = len(fit), fit.sum(0), min(16, size)
    centred = fit - s / n
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    values, vecs = values[::-1][:top], vecs[:, ::-1][:, :top]
    assert len(got) == len(rows) * top and {r["n"] for r in got} == {n}
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9
    want = {}
    for i, x in rows:
        z = (np.array(x) - s / n) @ vecs / np.sqrt(values)
        want.setdefault(i, []).append((sum((n * a - int(b)) ** 2 for a, b in zip(x, s, strict=True)), z))
    signs = {}
    for r in got:
        c = r["component"] - 1
        assert r["explained"] == pytest.approx(values[c] / np.trace(centred.T @ centred / n), rel=1e-9)
        fits = [z[c] for d, z in want[r["vec_id"]] if d == r["deviation"] and abs(z[c]) == pytest.approx(abs(r["whitened"]), abs=1e-8)]
        assert fits
        if abs(fits[0]) > 1e-3:
            signs.setdefault(c, set()).add(bool(fits[0] * r["whitened"] > 0))
    assert all(len(v) == 1 for v in signs.values())


def test_whitening_without_variance(spark):
    one = spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], "vec_id long, embedding array<double>")
    got = whitening.whitened(one).collect()
    assert len(got) == 4 and all((r["whitened"], r["explained"], r["deviation"], r["n"], r["identity_error"]) == (0.0, 0.0, 0, 1, 0.0) for r in got)
    assert whitening.whitened(one.where("vec_id > 5")).count() == 0
    half = spark.createDataFrame([(str(i), [float(i), 2.0]) for i in range(5)], "name string, v array<double>")
    got = whitening.whitened(half, "name", "v").collect()
    assert sorted({r["whitened"] for r in got if r["component"] == 2}) == [0.0] and len(got) == 10


def test_whitening_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 16)
    got = whitening.whitened(spark.createDataFrame(vectors(n=200), SHAPE).repartition(5))
    assert got.first()["identity_error"] < 1e-9 and got.count() == 16 * len(usable(vectors(n=200), 64, 64, 2**40))


def plain_clusters(rows, k, rounds):
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), x) for i, x in rows if i is not None)[:k]
    cents = [x for _, x in first]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = [[] for _ in cents]
        for _, x in rows:
            groups[near(x)[1]].append(x)
        cents = [[sum(c) // len(g) for c in zip(*g, strict=True)] if g else old for g, old in zip(groups, cents, strict=True)]
    found = [(i, *near(x)) for i, x in rows]
    total = sum(d for _, d, _ in found)
    return sorted(((i, c, d, sum(e for _, e, b in found if b == c), total, hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, d, c in found), key=repr)


COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize(("k", "rounds"), [(8, 10), (3, 1), (400, 2)])
def test_clusters(spark, k, rounds):
    data = vectors()
    got = centroids.with_inertia(*centroids.clustered(spark.createDataFrame(data, SHAPE).repartition(3), k=k, rounds=rounds)).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == plain_clusters(usable(data, 64, 1024, 2**27), k, rounds)


def test_tournament_ties():
    r = random.Random(5)
    cents = [[r.randint(-2, 2) for _ in range(4)] for _ in range(9)]
    planes = centroids.Bisectors(cents)
    x = np.array([[r.randint(-3, 3) for _ in range(4)] for _ in range(3000)])
    d = ((x[:, None, :] - np.array(cents)[None]) ** 2).sum(2)
    assert (planes.winners(x) == d.argmin(1)).all()
    assert (planes.distances(x, planes.winners(x)) == d.min(1)).all()


def test_extreme_components(spark):
    edge = (2.0**27 - 1) / 1024
    data = [(i, [edge if (i >> b) & 1 else -edge for b in range(6)] * 10 + [0.0] * 4) for i in range(40)]
    got = centroids.with_inertia(*centroids.clustered(spark.createDataFrame(data, "vec_id long, embedding array<double>"), rounds=0)).select("vec_id", "cluster", "distance")
    rows = [(i, [int(np.floor(1024 * c)) for c in v]) for i, v in data]
    assert sorted(map(tuple, got.collect())) == sorted((r[0], r[1], r[2]) for r in plain_clusters(rows, 8, 0))


def test_no_vectors(spark):
    none = spark.createDataFrame([(1, None), (2, [0.5])], "vec_id long, embedding array<float>")
    assert centroids.with_inertia(*centroids.clustered(none)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_clusters_against_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    found = con.execute(queries.ORACLES["op12_centroid_clustering"])
    order = [[c[0] for c in found.description].index(c) for c in COLUMNS]
    got = queries.op12_centroid_clustering(spark, "/root/testdata/sf0.001").select(COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted(tuple(r[i] for i in order) for r in found.fetchall())
