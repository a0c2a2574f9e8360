"""Quality by nearest-neighbour voting in a latent-semantic space.

A text is counted in hashed dimensions, one family for words and one for their shapes (runs of capitals, small letters, digits
and marks; words that repeat their predecessor), weighted by inverse document frequency over all documents. Subspace iteration
over a bounded sample of labelled rows gives the latent space. The sample's vectors are broadcast; every document is
compared with all of them, exactly and in blocks, and the nearest vote with weights by similarity.

Defined results: a null text counts as empty; a text without words is near nothing and gets the sample's share of label 1;
equal rows get equal scores; without any labels all scores are 0.5; no rows give no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

SHAPES, WORDS = 1024, 3072
DIMENSIONS = SHAPES + WORDS
#: Share of the word family in a vector; at most so many labelled rows of each label are taken.
WORD_WEIGHT, PER_LABEL = 0.4, 2048
LATENT, PASSES = 48, 5
NEIGHBOURS, POWER, BLOCK = 31, 4, 1024
CACHED_WORDS = 200_000
_RUNS = re.compile(r"(.)\1+", re.S)
_OWN = {i: ("A" if chr(i).isupper() else "a" if chr(i).isalpha() else "0" if chr(i).isdigit() else chr(i)) for i in range(0x250)}


class Features(dict):
    """Hashed dimensions of the shape and of the letters of a word, in the upper and the lower 16 bits; remembered within a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        shape = _RUNS.sub(r"\1", word.translate(_OWN))
        letters = "".join(filter(str.isalpha, word)).lower()
        self[word] = got = 2 + xxhash.xxh32_intdigest(shape) % (SHAPES - 2) << 16 | SHAPES + xxhash.xxh32_intdigest(letters or word) % WORDS
        return got


_features = Features()


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions that a text has, and how often. Dimension 0 is for words that repeat the one before."""
    found = text.split()
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pairs = np.fromiter(map(_features.__getitem__, found), dtype=np.int64, count=len(found))
    all_ = np.bincount(pairs >> 16, minlength=DIMENSIONS) + np.bincount(pairs & 0xFFFF, minlength=DIMENSIONS)
    all_[0] = sum(map(str.__eq__, found[1:], found))
    at = np.flatnonzero(all_)
    return at, all_[at]


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    for row, t in zip(out, texts, strict=True):
        at, n = counts(t)
        row[at] = np.log1p(n) * idf[at]
    for part, weight in ((out[:, :SHAPES], 1 - WORD_WEIGHT), (out[:, SHAPES:], WORD_WEIGHT)):
        part *= weight / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
    return out


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Over all documents: one row per task and dimension is summed up. At most DIMENSIONS + 1 rows come to the driver."""

    def run(batches):
        seen = np.zeros(DIMENSIONS + 1, dtype=np.int64)
        for b in batches:
            for t in b.column(0):
                seen[counts(t.as_py())[0]] += 1
            seen[DIMENSIONS] += b.num_rows
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["d", "n"])

    got = np.zeros(DIMENSIONS + 1)
    for r in texts.mapInArrow(run, "d long, n long").groupBy("d").agg(F.sum("n").alias("n")).collect():
        got[r.d] = r.n
    return got[:DIMENSIONS], int(got[DIMENSIONS])


def latent_space(x: np.ndarray, rank: int = LATENT, passes: int = PASSES) -> np.ndarray:
    """Leading right singular vectors by subspace iteration from a fixed start."""
    q = np.random.default_rng(1).standard_normal((x.shape[1], min(rank, *x.shape))).astype(np.float32)
    for _ in range(passes):
        q = np.linalg.qr(x.T @ (x @ q))[0].astype(np.float32)
    return q


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def vote(q: np.ndarray, known: np.ndarray, labels: np.ndarray, prior: float) -> np.ndarray:
    """Weighted label of the nearest known vectors for each row of q."""
    k = min(NEIGHBOURS, len(known))
    cosine = q @ known.T
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k] if k < len(known) else np.tile(np.arange(k), (len(q), 1))
    w = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** POWER
    return (((w * labels[near]).sum(axis=1) + 1e-3 * prior) / (w.sum(axis=1) + 1e-3)).clip(0, 1)


def bounded_sample(labels: DataFrame, label_col: str, per_label: int, id_col: str = "doc_id") -> DataFrame:
    """At most per_label ids of each label 0 and 1, those of the smallest hashes. An id with both labels counts as 1."""
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    take = lambda y: one.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(per_label)
    return take(0).unionByName(take(1))


def knn_scores(docs: DataFrame, train_labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_label: int = PER_LABEL) -> DataFrame:
    """One row per row of docs: id, score. train_labels: id and label, only rows that may be learned from."""
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    df, n = document_frequencies(texts.select("text"))
    idf = (np.log((n + 1) / (df + 1)) + 0.1).astype(np.float32)
    sample = F.broadcast(bounded_sample(train_labels, label_col, per_label, id_col))  # at most 2 * per_label rows

    def sampled(batches):
        for b in batches:
            x = [counts(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.int64()), b.column("label"), pa.array([a for a, _ in x], pa.list_(pa.int32())), pa.array([c for _, c in x], pa.list_(pa.int32()))], names=["id", "label", "at", "n"])

    got = texts.join(sample, "id").select("id", "label", "text").mapInArrow(sampled, "id long, label int, at array<int>, n array<int>").toArrow().sort_by("id")
    x = np.zeros((got.num_rows, DIMENSIONS), dtype=np.float32)
    for row, at, c in zip(x, got.column("at"), got.column("n"), strict=True):
        at = at.values.to_numpy()
        row[at] = np.log1p(c.values.to_numpy()) * idf[at]
    for part, weight in ((x[:, :SHAPES], 1 - WORD_WEIGHT), (x[:, SHAPES:], WORD_WEIGHT)):
        part *= weight / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
    if not len(x):
        return texts.select(F.col("id").alias(id_col), F.lit(0.5).alias("score"))
    space = latent_space(x)
    y = got.column("label").to_numpy().astype(np.float64)
    model = docs.sparkSession.sparkContext.broadcast((idf, space, unit(x @ space), y, float(y.mean())))

    def score(batches):
        idf, space, known, labels, prior = model.value
        for b in batches:
            out = []
            for at in range(0, b.num_rows, BLOCK):
                some = b.column(1).slice(at, BLOCK).to_pylist()
                out.append(vote(unit(vectors(some, idf) @ space), known, labels, prior))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out) if out else np.empty(0))], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return texts.mapInArrow(score, f"`{id_col}` {kind}, score double")
