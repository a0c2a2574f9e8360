"""Mixing sources to target weights.

Every document gets a hash-random key. Within each source the keys are dealt into ranges; sums of sizes per range and
prefix sums over these few ranges give each range its start, and a running sum within the range does the rest, so
that a hot source is spread over as many tasks as there are ranges. A source's documents are taken in the order
of the keys, in whole epochs and then up to the exact word of its budget.

Defined results: a null text has size 0; a null source is a source of its own, the last in order; a null id is hashed
as its own value; equal rows get equal keys and are taken one after the other; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, word_count, written

WEIGHTS, MAX_EPOCHS, SEED = (5, 2, 1), 3, "mix-1"


def random_key(id_col, seed: str = SEED, row_col: str | None = None):
    """Of the id; of the number of the row, if there is one, where the id is null, so that such rows do not share one key."""
    instead = F.concat(F.lit("null-"), F.col(row_col).cast("string")) if row_col else F.lit("null")
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), instead)))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes: source, source_size, a row for each source. Adds `target`: the total shared by weight, at most max_epochs
    times a source's size, what is over shared again. Sources sorted by cap over weight fill up in that order, so
    the level at which the others stand follows from prefix sums over the table of sources, a summary with one row each."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    s = sizes.withColumn("rank", F.row_number().over(order) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("rank") % len(weights) + 1))
    s = s.withColumn("cap", F.col("source_size") * float(max_epochs)).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.partitionBy(F.lit(0)).orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", left / weight_left).withColumn("capped", F.col("level") > F.col("ratio"))
    level = F.coalesce(F.max(F.expr("if(capped, null, level)")).over(every), F.lit(0.0))
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, row_col: str | None = None) -> DataFrame:
    """One row per row of docs: id (and row_col, a number of the row, if given), source, size, source_size, target, epochs (whole ones),
    taken (words, repeats counted)."""
    ids = [id_col, row_col] if row_col else [id_col]
    rows = written(docs.select(*ids, F.col(source_col).alias("source"), word_count(text_col).alias("size"), random_key(id_col, seed, row_col).alias("key")))
    # Three hex digits of the key: 4096 ranges of it for each source.
    rows = rows.withColumn("range", F.substring("key", 1, 3))
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    whole = Window.partitionBy("source")
    earlier = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = written(ranges.withColumn("start", F.coalesce(F.sum("range_size").over(earlier), F.lit(0))).drop("range_size"))
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goal = goal.withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 1e-6))
    starts = ranges.join(goal.hint("shuffle_hash"), ranges["source"].eqNullSafe(goal["source"])).select(ranges["source"].alias("s"), F.col("range").alias("r"), "start", "source_size", "target", "epochs", "rest")
    joined = rows.join(starts.hint("shuffle_hash"), rows["source"].eqNullSafe(starts["s"]) & (rows["range"] == starts["r"]))
    within = Window.partitionBy("source", "range").orderBy("key", "size", *ids[1:]).rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - at))
    return joined.withColumn("taken", (F.col("epochs") * F.col("size") + part).cast("long")).select(*ids, "source", "size", "source_size", "target", F.col("epochs").cast("int").alias("epochs"), "taken")


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs as the mix has them: a row for each time that a document is taken, with all its columns and whole text. The
    document at the cut of a source's budget is there once more if at least half its words are within; empty ones never.
    Each row is counted for itself, also among rows of one id or none; docs are written once, with numbers for their rows."""
    row = free_name([*docs.columns, "source", "size", "key", "range"], "_row")
    times, copy = free_name([*docs.columns, row], "_times"), free_name([*docs.columns, row], "_copy")
    held = written(docs.withColumn(row, F.monotonically_increasing_id()))
    taken = mix_sources(held, id_col, source_col, text_col, row_col=row).where("size > 0")
    taken = taken.select(row, F.round(F.col("taken") / F.col("size")).cast("int").alias(times)).where(F.col(times) > 0)
    joined = held.join(taken.hint("shuffle_hash"), row)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
