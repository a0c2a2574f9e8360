"""Quality rules under weak supervision.

Rules vote good or junk on each document, or abstain. Expectation-maximisation over the counts of vote patterns (there are
at most 3 to the number of rules, however many documents) estimates how often each rule is right on good and on junk
documents and how many are good; the posterior probability then decides, not a demand that all rules be met.

Defined results: a null text has no words; a text without words gets no votes and the prior as its quality, and fails
the base rule on length; equal rows get equal results; no rows give no rows. Repeated three-word windows are told by
64-bit hashes of their words.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, text_or_empty, words, written

SYMBOLS = "#*$%&|<>"
#: name: (measure, junk if, good if), SQL over the columns of features(); neither: the rule abstains.
RULES = {
    "symbols": ("n_symbols >= 0.1 * n_words", "n_symbols <= 0.02 * n_words"),
    "repeats": ("n_repeat_words > 0.3 * n_words", "n_repeat_words <= 0.1 * n_words"),
    "lines": ("n_dup_lines > 0.3 * n_lines", "n_lines >= 2 and n_dup_lines = 0"),
    "capitals": ("n_upper > 0.5 * word_chars", "n_upper < 0.2 * word_chars"),
    "word_length": ("word_chars < 2.5 * n_words or word_chars > 12 * n_words", "word_chars between 3.5 * n_words and 9 * n_words"),
    "lone_marks": ("n_lone_marks > 0.15 * n_words", "n_lone_marks <= 0.02 * n_words"),
    "variety": ("n_distinct < 0.2 * n_words", "n_distinct > 0.35 * n_words"),
    "sentences": ("n_words >= 50 and n_ends = 0", "n_ends between 0.01 * n_words and 0.3 * n_words"),
    "marked_words": ("n_marked > 0.3 * n_words", "n_marked <= 0.1 * n_words"),
}
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"
ROUNDS, TOLERANCE = 25, 1e-4
#: A rule sees one kind of junk: where it does, it is nearly always right; on other junk it votes good. These are its first
#: accuracies on good and on junk, and the bounds that keep it better than chance.
START, ON_GOOD, ON_JUNK = (0.99, 0.3), (0.6, 0.999), (0.05, 0.99)
#: Both together are at least this, so that a good vote never counts against a document, nor a junk vote for it.
BOTH = 1.02


def _repeat_words(w: Column) -> Column:
    """How many words stand in three-word windows that occur twice or more. Only texts with a repeated window are sorted."""
    n = F.size(w)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def count(h: Column) -> Column:
        keyed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def covered(s: Column) -> Column:
            again = F.transform(s, lambda x, j: F.when((F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]), x["i"]))
            at = F.filter(again, lambda i: i.isNotNull())
            return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(keyed, covered))

    return F.when(n < 4, 0).otherwise(let(hashes, count)).cast("long")


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of each whole text, in one pass."""
    t = text_or_empty(text_col)

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).alias("n_distinct"),
            F.size(F.filter(w, lambda x: x.rlike(r"[.!?]$"))).alias("n_ends"),
            F.size(F.filter(w, lambda x: ~x.rlike(r"[\p{L}\p{N}]"))).alias("n_lone_marks"),
            F.size(F.filter(w, lambda x: x.rlike(r"[\p{L}\p{N}](!{2,}|[^\p{L}\p{N}\s.,;:!?]{2,})$"))).alias("n_marked"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, " \t\n\x0b\f\r", "") != "")
    bare = F.translate(t, " \t\n\x0b\f\r", "")
    found = docs.select(
        F.col(id_col),
        let(bare, lambda b: F.struct(F.length(b).cast("long").alias("word_chars"), (F.length(b) - F.length(F.translate(b, SYMBOLS, ""))).cast("long").alias("n_symbols"), (F.length(b) - F.length(F.regexp_replace(b, r"\p{Lu}", ""))).alias("n_upper"))).alias("c"),
        let(words(text_col), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
    )
    return found.select(id_col, "w.*", "c.*", "l.*")


def votes() -> list[Column]:
    return [F.when(F.col("n_words") == 0, -1).otherwise(F.expr(f"case when {junk} then 0 when {good} then 1 else -1 end")).cast("byte").alias(f"vote_{name}") for name, (junk, good) in RULES.items()]


def _posterior(model: dict, names: list[str]) -> Column:
    logit = F.lit(log(model["prior"] / (1 - model["prior"])))
    for v in names:
        good, junk = model[v]
        logit = logit + F.when(F.col(v) == 1, log(good / (1 - junk))).when(F.col(v) == 0, log((1 - good) / junk)).otherwise(0.0)
    return 1 / (1 + F.exp(-logit))


def label_model(voted: DataFrame, names: list[str]) -> dict:
    """Accuracies of each rule on good and on junk documents, and the prior, from columns of votes 1, 0 and -1."""
    patterns = written(voted.groupBy(*names).agg(F.count("*").alias("n")))
    model: dict = {"prior": 0.8} | dict.fromkeys(names, START)
    for _ in range(ROUNDS):
        p, n = F.col("p"), F.col("n")
        sums = [F.sum(n * p).alias("good"), F.sum(n).alias("all")]
        for v in names:
            sums += [F.sum(F.when(F.col(v) == 1, n * p).otherwise(0.0)).alias(f"{v}_g"), F.sum(F.when(F.col(v) >= 0, n * p).otherwise(0.0)).alias(f"{v}_ga")]
            sums += [F.sum(F.when(F.col(v) == 0, n * (1 - p)).otherwise(0.0)).alias(f"{v}_j"), F.sum(F.when(F.col(v) >= 0, n * (1 - p)).otherwise(0.0)).alias(f"{v}_ja")]
        got = patterns.withColumn("p", _posterior(model, names)).agg(*sums).first()
        if not got["all"]:
            return model
        rate = lambda a, b, bounds: min(bounds[1], max(bounds[0], (a + 1) / (b + 2)))
        new = {"prior": min(0.99, max(0.01, (got["good"] + 1) / (got["all"] + 2)))} | {v: (rate(got[f"{v}_g"], got[f"{v}_ga"], ON_GOOD), rate(got[f"{v}_j"], got[f"{v}_ja"], ON_JUNK)) for v in names}
        new |= {v: (new[v][0], max(new[v][1], BOTH - new[v][0])) for v in names}
        moved = max(abs(new["prior"] - model["prior"]), *(abs(a - b) for v in names for a, b in zip(new[v], model[v], strict=True)))
        model = new
        if moved < TOLERANCE:
            break
    return model


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row per row of docs: id, the counts, the votes, quality (posterior), base_failed, kept."""
    names = [f"vote_{x}" for x in RULES]
    voted = written(features(docs, id_col, text_col).select("*", *votes()))
    model = label_model(voted, names)
    out = voted.withColumn("quality", _posterior(model, names)).withColumn("base_failed", F.expr(BASE_FAILED))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
