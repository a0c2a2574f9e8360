"""op9 against all windows of 50 words."""

import random
from collections import defaultdict

from helpers import frame, rows, words

from quernstone.llm import suffixes


def brute(data):
    where = defaultdict(set)
    texts = {r[0]: words(r[1]) for r in data if r[0] is not None}
    for i, w in texts.items():
        for k in range(len(w) - 49):
            where[tuple(w[k : k + 50])].add(i)
    out = set()
    for i, w in texts.items():
        covered = [False] * len(w)
        starts = [k for k in range(len(w) - 49) if len(where[tuple(w[k : k + 50])]) > 1]
        for k in starts:
            covered[k : k + 50] = [True] * 50
        k = 0
        while k < len(w):
            if covered[k]:
                e = k
                while e < len(w) and covered[e]:
                    e += 1
                out.add((i, k, e - k))
                k = e
            k += 1
    return out


def planted(seed, n, passages):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7)))
    shared = [[word() for _ in range(k)] for k in passages]
    out = []
    for i in range(n):
        w = [word() for _ in range(r.randint(0, 150))]
        for p in r.sample(shared, r.randint(0, 2)):
            at = r.randint(0, len(w))
            cut = r.choice([0, 0, 0, 5, 15])
            w[at:at] = p[cut:]
        out.append((i, " ".join(w), None, None, None, None, None, None))
    return out


def covered(spans):
    return {(d, k) for d, s, n in spans for k in range(s, s + n)}


def test_passages(spark):
    data = planted(4, 150, (50, 52, 60, 65, 80, 200, 49))
    got = {(r.doc_id, r.start, r.n_words) for r in suffixes.repeated_passages(frame(spark, data)).collect()}
    # Adjoining passages may be told apart or not; the words covered are the same.
    assert covered(got) == covered(brute(data))


def test_awkward_rows(spark):
    got = {(r.doc_id, r.start, r.n_words) for r in suffixes.repeated_passages(frame(spark)).collect()}
    assert covered(got) == covered(brute(rows()))
    assert suffixes.repeated_passages(frame(spark, [])).collect() == []


def test_near_copies_edited_at_different_places(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7)))
    base, data = [word() for _ in range(300)], []
    for i in range(400):
        text = " ".join(word() if r.random() < 1 / 20 else w for w in base)
        data.append((i, text, None, None, None, None, None, None))
    got = {(x.doc_id, x.start, x.n_words) for x in suffixes.repeated_passages(frame(spark, data)).collect()}
    assert covered(got) == covered(brute(data))


def test_repeats_within_crowds_that_share_49_words_with_one_side(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7)))
    data, number = [], iter(range(10_000))
    add = lambda w: data.append((next(number), " ".join(w), None, None, None, None, None, None))
    some = lambda n: [word() for _ in range(n)]
    for _ in range(60):
        passage = some(50)
        for _ in range(2):
            add(some(r.randint(5, 40)) + passage + some(r.randint(5, 40)))
        for _ in range(12):  # these lack the first or the last word
            part = passage[1:] if r.random() < 0.5 else passage[:-1]
            add(some(r.randint(5, 40)) + part + some(r.randint(5, 40)))
    got = {(x.doc_id, x.start, x.n_words) for x in suffixes.repeated_passages(frame(spark, data)).collect()}
    want = brute(data)
    assert covered(got) == covered(want) and len({d for d, _, _ in want}) >= 120
