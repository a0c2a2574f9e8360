"""op4 against all pairs in plain Python."""

import random

from helpers import frame, lowered, rows, words
from pyspark.sql import functions as F

from quernstone.llm import minhash


def sets_of(text):
    w = words(lowered(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(data):
    ids = sorted({r[0] for r in data if r[0] is not None})
    sets = {r[0]: sets_of(r[1]) for r in data}
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def near_copies(seed, n, rates):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(900)]
    base = [r.choice(vocab) for _ in range(150)]
    out = []
    for i in range(n):
        w = [r.choice(vocab) if r.random() < r.choice(rates) else x for x in base]
        out.append((1000 * seed + i, " ".join(w), None, None, None, None, None, None))
    return out


def check(spark, data, exact=True):
    want = brute(data)
    got = [r for r in minhash.near_duplicates(frame(spark, data)).collect()]
    assert len(got) == len(data)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_awkward_rows(spark):
    check(spark, rows())


def test_diffuse_group(spark):
    check(spark, near_copies(1, 120, (0.0, 0.01, 0.02, 0.03, 0.05)) + near_copies(2, 3, (0.5,)))


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 20)
    monkeypatch.setattr(minhash, "LONG", 1000)
    check(spark, near_copies(3, 90, (0.01, 0.02, 0.04)))


def test_no_rows(spark):
    assert minhash.near_duplicates(frame(spark, [])).collect() == []


def test_rows_of_one_id(spark):
    """Each row by its own text: (1, A) and (2, near A) are linked, so are (1, B) and (3, near B); (2, C) stands alone."""
    r = random.Random(4)
    prose = lambda: [f"w{r.randint(0, 9999)}" for _ in range(80)]
    a, b, c = prose(), prose(), prose()
    near = lambda w: " ".join([*w[:-1], "end"])
    data = [(1, " ".join(a)), (2, near(a)), (1, " ".join(b)), (3, near(b)), (2, " ".join(c)), (1, " ".join(a)), (1, "  ".join(a)), (None, " ".join(a)), (None, " ".join(a)), (4, None), (4, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("text_key", F.lit("k")).withColumn("alone", F.lit(5)).withColumn("lost_id", F.lit(7))
    got = {(x.doc_id, x.n_shingles, x.component_id) for x in minhash.near_duplicates(docs).collect()}
    assert got == {(1, 76, 1), (2, 76, 1), (3, 76, 1), (2, 76, 2), (None, 76, None), (4, 0, 4)}
    kept = minhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and all((x.text_key, x.alone, x.lost_id) == ("k", 5, 7) for x in kept.collect())
    left = sorted(((x.doc_id, x.text) for x in kept.collect()), key=repr)
    ones = [t for i, t in left if i == 1]
    assert len(ones) == 2 and " ".join(b) in ones and ones.count(" ".join(a)) + ones.count("  ".join(a)) == 1
    assert [x for x in left if x[0] != 1] == sorted([(2, " ".join(c)), (None, " ".join(a)), (None, " ".join(a)), (4, None), (4, None)], key=repr)


def test_text_ids(spark):
    data = [("b", "one two three four five six"), ("a", "One two three four five six"), ("c", "seven"), (None, "seven"), ("", "")]
    got = {(x.name, x.component_id, x.kept) for x in minhash.near_duplicates(spark.createDataFrame(data, "name string, text string"), "name").collect()}
    assert got == {("b", "a", False), ("a", "a", True), ("c", "c", True), (None, None, True), ("", "", True)}


def test_blocks_and_homes(spark, monkeypatch):
    """Several blocks to a list, and lists long enough to settle with full sets."""
    monkeypatch.setattr(minhash, "BLOCK", 20)
    monkeypatch.setattr(minhash, "LONG", 6)
    check(spark, near_copies(6, 90, (0.01, 0.02, 0.04)))


def test_drop(spark):
    docs = frame(spark)
    got = minhash.drop_near_copies(docs)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == {i for i, (n, c) in brute(rows()).items() if i == c} | {None}
