"""Toxicity under weak supervision.

Voters are a lexicon of common insults, lexicons of words and patterns of word beginnings that a bounded sample of labelled
rows shows to be far more usual in toxic texts, dealt over several voters. A generative label model over the vote patterns of
all documents estimates each voter's accuracy and, in a tree of dependences, how voters correlate. Its posterior labels,
not the given ones, train a linear classifier on hashed words and word beginnings, which scores every whole text.

Defined results: a null text counts as empty; an empty text gets the intercept's score; equal rows get equal scores; without
labels only the fixed lexicon votes; no rows give no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import text_or_empty
from .quality_knn import bounded_sample

INSULTS = (
    "idiot idiots moron morons stupid dumb fool fools trash garbage scum loser losers pathetic worthless disgusting clown clowns "
    "imbecile cretin dimwit jerk bastard filth vermin coward liar creep freak scumbag"
).split()
WORD_GROUPS, START_GROUPS, START = 4, 2, 4
PER_LABEL, LEAST_DOCS, LEAST_ODDS, LEXICON = 2000, 8, 3.5, 4000
DIMENSIONS, FEATURES, SURE = 1 << 18, 400, 4.0
ROUNDS, STEPS, PENALTY = 15, 12, 0.3
#: Share of the clean texts that counts as seen with a clean vote under each vote of a voter's parent.
CLEAN = 0.005
CACHED_WORDS = 200_000
_LETTERS = re.compile(r"[^\W\d_]+")


def terms(part: str) -> list[str]:
    """Lower-case words of a stretch between blanks, and their beginnings, marked with a star."""
    out = []
    for w in _LETTERS.findall(part.lower()):
        out.append(w)
        if len(w) > START:
            out.append(w[:START] + "*")
    return out


def group(term: str) -> int:
    h = xxhash.xxh32_intdigest(term)
    return 1 + WORD_GROUPS + h % START_GROUPS if term.endswith("*") else 1 + h % WORD_GROUPS


class Votes:
    """Votes of all voters on a text: 2 toxic, 1 clean, 0 abstain. A beginning votes from its second word on."""

    def __init__(self, learned: list[str]):
        self.of = {t: {group(t)} for t in learned}
        for t in INSULTS:
            self.of.setdefault(t, set()).add(0)
        self.known: dict[str, tuple] = {}

    def hits(self, part: str) -> tuple:
        if (got := self.known.get(part)) is None:
            if len(self.known) >= CACHED_WORDS:
                self.known.clear()
            self.known[part] = got = tuple(v for t in terms(part) for v in self.of.get(t, ()))
        return got

    def __call__(self, text: str) -> tuple[int, ...]:
        parts = set(text.split())
        n = [0] * (1 + WORD_GROUPS + START_GROUPS)
        for p in parts:
            for v in self.hits(p):
                n[v] += 1
        clean = 1 if len(parts) >= 5 else 0
        return tuple(2 if c >= (2 if v > WORD_GROUPS else 1) else 0 if c else clean for v, c in enumerate(n))


def learn_lexicon(sample: DataFrame) -> list[str]:
    """Terms of label, text rows that are far more usual with label 1; at most LEXICON come to the driver."""

    def run(batches):
        for b in batches:
            found = [sorted({t for p in set(x.as_py().split()) for t in terms(p)}) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string()))], names=["label", "terms"])

    n = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return []
    seen = sample.select("label", "text").mapInArrow(run, "label int, terms array<string>").select("label", F.explode("terms").alias("term"))
    per = seen.groupBy("term").agg(F.sum("label").alias("ones"), F.count("*").alias("n"))
    odds = F.log((F.col("ones") + 0.5) / n[1]) - F.log((F.col("n") - F.col("ones") + 1.0) / n[0])
    best = per.where(F.col("ones") >= LEAST_DOCS).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    return [r.term for r in best.orderBy(F.desc("odds"), "term").limit(LEXICON).collect()]


class LabelModel:
    """P(toxic | votes) from counted vote patterns: each vote depends on the label and on one other voter's vote, the
    dependences being the maximum spanning tree of the voters' mutual information given the label."""

    def __init__(self, patterns: np.ndarray, n: np.ndarray):
        self.prior, self.parent, self.cpt = 0.1, None, None
        p = np.where((patterns == 2).any(axis=1), 0.97, 0.02)
        for _ in range(ROUNDS if len(patterns) else 0):
            self._fit(patterns, n, p)
            p = self(patterns)

    def _fit(self, v: np.ndarray, n: np.ndarray, p: np.ndarray) -> None:
        voters = v.shape[1]
        weight = np.stack([n * (1 - p), n * p])
        self.prior = float(np.clip(weight[1].sum() / max(n.sum(), 1), 0.001, 0.9))
        joint = np.full((2, voters, voters, 3, 3), 0.05)
        for y in range(2):
            for i in range(voters):
                for j in range(voters):
                    np.add.at(joint[y, i, j], (v[:, i], v[:, j]), weight[y])
        share = joint / joint.sum(axis=(3, 4), keepdims=True)
        one, two = share.sum(axis=4, keepdims=True), share.sum(axis=3, keepdims=True)
        info = (share * np.log(share / (one * two))).sum(axis=(3, 4))
        info = info[0] * (1 - self.prior) + info[1] * self.prior
        self.parent, inside = [-1] * voters, {0}
        while len(inside) < voters:
            i, j = max(((i, j) for i in inside for j in range(voters) if j not in inside), key=lambda e: info[e])
            self.parent[j] = i
            inside.add(j)
        # A voter is better than chance: whatever another one says, on a clean text it mostly votes clean.
        lean = np.array([[[0.5, 1 + CLEAN * weight[0].sum(), 0.02]], [[0.5, 1.0, 0.5]]])
        self.cpt = []
        for j, i in enumerate(self.parent):
            table = joint[:, j, j].diagonal(axis1=1, axis2=2)[:, None, :] if i < 0 else joint[:, i, j]
            table = table + lean
            self.cpt.append(table / table.sum(axis=2, keepdims=True))

    def __call__(self, v: np.ndarray) -> np.ndarray:
        if self.cpt is None:
            return np.full(len(v), self.prior)
        log = np.log([[1 - self.prior], [self.prior]]) + np.zeros((2, len(v)))
        for j, i in enumerate(self.parent):
            log += np.log(self.cpt[j][:, 0 if i < 0 else v[:, i], v[:, j]])
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))


def train_linear(rows: list[np.ndarray], p: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Features, weights and intercept: logistic regression on the hashed features whose association with a high p is sure."""
    n, ones = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    for at, y in zip(rows, p, strict=True):
        n[at] += 1
        ones[at] += y
    mean = float(np.clip(p.mean(), 0.01, 0.99)) if len(p) else 0.1
    z = (ones - n * mean) / np.sqrt(np.maximum(n, 1) * mean * (1 - mean))
    chosen = np.flatnonzero((z >= SURE) & (n >= 5))
    chosen = np.sort(chosen[np.argsort(-z[chosen], kind="stable")[:FEATURES]])
    x = np.zeros((len(rows), len(chosen) + 1))
    for row, at in zip(x, rows, strict=True):
        row[:-1] = np.isin(chosen, at)
    x[:, -1] = 1
    w = np.zeros(x.shape[1])
    w[-1] = np.log(mean / (1 - mean))
    ridge = np.append(np.full(len(chosen), PENALTY), 1e-6)
    loss = lambda w: (np.logaddexp(0, x @ w) - p * (x @ w)).sum() + (ridge * w * w).sum() / 2
    for _ in range(STEPS if len(x) else 0):  # Newton steps, halved until they help
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step, now = np.linalg.solve((x * (q * (1 - q) + 1e-6)[:, None]).T @ x + np.diag(ridge), x.T @ (q - p) + ridge * w), loss(w)
        size = next((2.0**-k for k in range(12) if loss(w - 2.0**-k * step) < now), 0.0)
        w = w - size * step
        if not size:
            break
    return chosen, w[:-1], float(w[-1])


class Linear:
    def __init__(self, chosen: np.ndarray, weights: np.ndarray, intercept: float):
        self.weight, self.intercept, self.known = dict(zip(chosen.tolist(), weights.tolist(), strict=True)), intercept, {}

    def active(self, part: str) -> tuple:
        if (got := self.known.get(part)) is None:
            if len(self.known) >= CACHED_WORDS:
                self.known.clear()
            self.known[part] = got = tuple(d for d in map(dimension, terms(part)) if d in self.weight)
        return got

    def __call__(self, text: str) -> float:
        found = {d for p in set(text.split()) for d in self.active(p)}
        return float(1 / (1 + np.exp(-np.clip(self.intercept + sum(self.weight[d] for d in sorted(found)), -30, 30))))


def dimension(term: str) -> int:
    return xxhash.xxh32_intdigest(term) % DIMENSIONS


def toxic_scores(docs: DataFrame, train_labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_label: int = PER_LABEL) -> DataFrame:
    """One row per row of docs: id, score. train_labels: integer id and label, only rows that may be learned from."""
    return _scored(docs, [id_col], "score", train_labels, label_col, id_col, text_col, per_label)


def drop_toxic(docs: DataFrame, train_labels: DataFrame, threshold: float, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_label: int = PER_LABEL) -> DataFrame:
    """Rows of docs whose own text scores under the threshold, with all their columns. The score goes with the row, so rows
    without an id, or of one id with unlike texts, are judged each by its text; null texts count as empty; no rows give none."""
    name = "score"
    while name in docs.columns:
        name += "_"
    return _scored(docs, docs.columns, name, train_labels, label_col, id_col, text_col, per_label).where(F.col(name) < threshold).drop(name)


def _scored(docs: DataFrame, carried: list[str], score_col: str, train_labels: DataFrame, label_col: str, id_col: str, text_col: str, per_label: int) -> DataFrame:
    """The carried columns of every row and its score."""
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    ids = F.broadcast(bounded_sample(train_labels, label_col, per_label, id_col))  # at most 2 * per_label rows
    sample = texts.join(ids, "id").select("id", "label", "text")
    learned = learn_lexicon(sample.select("label", "text"))
    voters = 1 + WORD_GROUPS + START_GROUPS

    def patterns(batches):
        votes, seen = Votes(learned), {}
        for b in batches:
            for t in b.column(0):
                v = votes(t.as_py())
                seen[v] = seen.get(v, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(["".join(map(str, v)) for v in seen], pa.string()), pa.array(seen.values(), pa.int64())], names=["votes", "n"])

    # At most 3 to the number of voters rows, however many documents.
    counted = texts.select("text").mapInArrow(patterns, "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").collect()
    v = np.array([list(map(int, r.votes)) for r in counted], dtype=np.int64).reshape(-1, voters)
    model = LabelModel(v, np.array([r.n for r in counted], dtype=np.float64))

    def hashed(batches):
        votes = Votes(learned)
        for b in batches:
            found = [b_.as_py() for b_ in b.column(1)]
            at = [sorted({dimension(t) for p in set(x.split()) for t in terms(p)}) for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([list(votes(x)) for x in found], pa.list_(pa.int8())), pa.array(at, pa.list_(pa.int32()))], names=["id", "votes", "at"])

    got = sample.select("id", "text").mapInArrow(hashed, "id long, votes array<byte>, at array<int>").toArrow().sort_by("id")
    cast = np.array(got.column("votes").to_pylist(), dtype=np.int64).reshape(-1, voters)
    linear = train_linear([x.values.to_numpy() for x in got.column("at")], model(cast))
    shared = docs.sparkSession.sparkContext.broadcast(linear)
    columns = carried if text_col in carried else [*carried, text_col]
    at, trained = columns.index(text_col), got.num_rows > 0

    def score(batches):
        judge = Linear(*shared.value) if trained else None
        votes = None if trained else Votes(learned)  # nothing to train on: the label model's posterior itself
        for b in batches:
            found = [t.as_py() or "" for t in b.column(at)]
            scores = [judge(t) for t in found] if trained else model(np.array([votes(t) for t in found], dtype=np.int64).reshape(-1, voters))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carried)], pa.array(scores, pa.float64())], names=[*carried, score_col])

    shape = StructType([*(docs.schema[c] for c in carried), StructField(score_col, DoubleType())])
    return docs.select(*columns).mapInArrow(score, shape)
