"""The stages of the corpus pipeline, one after the other, over awkward rows."""

from collections import Counter, defaultdict

import corpus_pipeline as pipeline
import pytest
from helpers import SCHEMA, frame, lowered, rows, words
from pyspark.sql import functions as F
from test_classifiers import corpus

from quernstone.llm import queries, toxicity

KEY = lambda r: tuple(r)[:4]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with toxic ones among them: one without id, one with the id of a clean one; and their labels."""
    docs, labels = corpus(300)
    toxic = docs[0][1]
    odd = [(10_000 + (r[0] or 0) if r[0] is not None else None, *r[1:]) for r in rows()]
    data = docs + odd + [(None, toxic + " once more", *[None] * 6), (docs[7][0], toxic + " again", *[None] * 6)]
    path = str(tmp_path_factory.mktemp("tables"))
    frame(spark, data).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def held(spark, folder):
    """Rows before the first stage and after each one but the last."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs.collect()]
    for _, stage in pipeline.STAGES[:-1]:
        docs = pipeline.written(stage(spark, docs, folder))
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        out.append(docs.collect())
    return out


def test_toxicity_judges_each_row(spark, folder, held):
    known = queries.learned_from(spark.read.parquet(f"{folder}/labels.parquet"))
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("row", F.monotonically_increasing_id())
    texts = {r.row: r for r in docs.collect()}
    scores = {r.row: r.score for r in toxicity._scored(docs, ["row"], "score", known, "toxic", "doc_id", "text", toxicity.PER_LABEL).collect()}
    assert Counter(map(KEY, held[1])) == Counter(KEY(texts[i]) for i, s in scores.items() if s < queries.TOXIC)
    gone = Counter(map(KEY, held[0])) - Counter(map(KEY, held[1]))
    assert any(r[0] is None and r[1].endswith("once more") for r in gone) and any(r[0] == 7 for r in gone)
    assert any(r.doc_id == 7 for r in held[1]) and any(r.text is None for r in held[1])


def test_exact_copies(held):
    groups = defaultdict(list)
    for r in held[1]:
        groups[lowered(r.text)].append(r)
    assert Counter(lowered(r.text) for r in held[2]) == Counter(groups.keys())
    for r in held[2]:
        ids = [x.doc_id for x in groups[lowered(r.text)] if x.doc_id is not None]
        assert r.doc_id == (max(ids) if ids else None)


def test_near_copies(held):
    def shingles(text):
        w = words(lowered(text))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {r.doc_id: shingles(r.text) for r in held[2] if r.doc_id is not None}
    head = {i: i for i in sets}

    def root(i):
        return i if head[i] == i else root(head[i])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                head[y] = x
    want = [KEY(r) for r in held[2] if r.doc_id is None or root(r.doc_id) == r.doc_id]
    assert Counter(map(KEY, held[3])) == Counter(want)


def test_mix(held):
    before, after = Counter(map(KEY, held[3])), Counter(map(KEY, held[4]))
    assert set(after) <= set(before) and all(after[k] <= 3 * before[k] for k in after)
    assert all(words(k[1]) for k in after)
    total = sum(len(words(k[1])) * n for k, n in before.items())
    assert abs(sum(len(words(k[1])) * n for k, n in after.items()) - total) < 0.2 * total


def test_pack_and_run(spark, folder, held):
    got = pipeline.run(spark, folder).collect()
    pieces, sequences = Counter(r.doc_id for r in got if r.piece == 0), defaultdict(list)
    assert pieces == Counter(r.doc_id for r in held[4])
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False)) and s[-1][0] + s[-1][1] <= 2048


def test_empty_tables(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_columns_of_every_name_and_rows_of_one_id(spark):
    """Stages keep given columns whose names they might use themselves, and judge each row by its own text."""
    odd = ["_id", "_times", "_copy", "_own_sha", "_row", "_own_shaid", "_own_shakept", "key", "range", "size", "alone", "lost_id", "text_key"]
    prose = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    data = [(1, prose(1), "s"), (2, prose(1) + " tail", "s"), (2, prose(2), "s"), (None, prose(3), "s"), (None, prose(4), "s"), (2, prose(5), "s"), (5, prose(1), "s")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    for k, name in enumerate(odd):
        docs = docs.withColumn(name, F.lit(k))
    for _, stage in pipeline.STAGES[1:-1]:
        before, docs = docs, pipeline.written(stage(spark, docs, ""))
        assert docs.columns == before.columns
        assert docs.select(*odd).distinct().collect() == [tuple(range(len(odd)))]
    # Document 1 goes as an exact copy of 5, that as a near copy of a row of id 2, whose other rows stay.
    got = Counter(r.text for r in docs.collect())
    assert got == Counter([prose(1) + " tail", *map(prose, (2, 3, 4, 5))])
