"""Exact de-duplication by deterministic block naming.

A text, with A-Z lower-cased, is cut into blocks of a fixed number of characters. Distinct blocks are sorted
and get integer names; then adjacent names are paired, distinct pairs are sorted and named, and so on until
each text has a single name. Two texts have the same name at the same depth exactly when they are equal.

Blocks travel once, to be compared with their equals; afterwards only their 128-bit fingerprints do. Names rest on
these only after the comparison has shown that no two different blocks share one; otherwise another seed is tried.

Defined results: a null text counts as empty; equal rows are copies like any others, and one of them stays; of equal
texts the row with the largest id stays, and a null id is smaller than any other. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, let, written

#: Names are given within so many ranges of the sort key, so that no task sorts all of them.
NAME_RANGES = 4096


def _named(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys with an integer `name`: their rank within a range of hashes, interleaved with the range's number."""
    part = F.pmod(F.xxhash64(*keys), F.lit(NAME_RANGES))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*keys)).cast("long")
    return distinct.withColumn("part", part).withColumn("name", rank * NAME_RANGES + F.col("part")).drop("part")


def _blocks(text, block_chars: int):
    found = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    return F.when(text == "", F.array(F.lit(""))).otherwise(found)


def _prints(block, seed: int, bits: int):
    one = F.shiftrightunsigned(F.xxhash64(F.lit(seed), block), 64 - bits)
    two = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1_000_003), block), 64 - bits)
    return one, two


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 4096, bits: int = 64) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256 (of the normalised text), name and depth.

    bits: of each of the two fingerprints of a block; tests lower it to force collisions."""
    seed = 0
    while True:
        blocks = docs.select(F.explode(_blocks(ascii_lower(text_col), block_chars)).alias("block"))
        one, two = _prints(F.col("block"), seed, bits)
        distinct = blocks.select(one.alias("p1"), two.alias("p2"), "block").distinct()
        counted = written(distinct.groupBy("p1", "p2").agg(F.count("*").alias("n")))
        if counted.where("n > 1").isEmpty():
            break
        seed, bits = seed + 1, min(64, bits + 1)
    names = _named(counted.select("p1", "p2"), ["p1", "p2"])

    def facts(t):
        prints = F.transform(_blocks(t, block_chars), lambda b: F.struct(_prints(b, seed, bits)[0].alias("p1"), _prints(b, seed, bits)[1].alias("p2")))
        return F.struct(F.sha2(t, 256).alias("sha"), prints.alias("prints"))

    rows = docs.select(F.col(id_col).alias("id"), let(ascii_lower(text_col), facts).alias("f"))
    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), "id", "f.sha", "f.prints"))
    depth = F.ceil(F.log2(F.size("prints").cast("double"))).cast("int")
    level = rows.select("row", depth.alias("depth"), F.posexplode("prints").alias("pos", "p"))
    level = level.select("row", "depth", "pos", "p.p1", "p.p2").join(names.hint("merge"), ["p1", "p2"]).select("row", "depth", "pos", "name")
    level = written(level)
    deepest = rows.agg(F.max(depth)).first()[0] or 0
    done = level.where("depth = 0").select("row", "depth", "name")
    for k in range(1, deepest + 1):
        pairs = level.where(F.col("depth") >= k).groupBy("row", "depth", F.expr("pos div 2").cast("int").alias("half"))
        pairs = written(pairs.agg(F.max(F.expr("if(pos % 2 = 0, name, null)")).alias("l"), F.coalesce(F.max(F.expr("if(pos % 2 = 1, name, null)")), F.lit(0)).alias("r")))
        names = _named(pairs.select("l", "r").distinct(), ["l", "r"])
        level = written(pairs.join(names.hint("merge"), ["l", "r"]).select("row", "depth", F.col("half").alias("pos"), "name"))
        done = done.unionByName(level.where(F.col("depth") == k).select("row", "depth", "name"))
    named = rows.select("row", "id", "sha").join(done.hint("merge"), "row")
    named = written(named)
    # Written, so that the planner may split the join where a text has very many copies.
    groups = written(named.groupBy("depth", "name").agg(F.max(F.struct("id", "row")).alias("keep"), F.count("*").alias("group_size")))
    return named.join(groups.hint("merge"), ["depth", "name"]).select(
        F.col("id").alias(id_col), F.col("keep.id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), F.col("sha").alias("text_sha256"), "name", "depth"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, the one that exact_dedup keeps; all columns stay."""
    key, sha = free_name([*docs.columns, "_sha"], "_own_sha"), F.sha2(ascii_lower(text_col), 256)
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.col(id_col).alias(f"{key}id"), F.col("text_sha256").alias(f"{key}kept"))
    own = docs.withColumn(key, sha)
    held = own.join(kept.hint("shuffle_hash"), own[id_col].eqNullSafe(kept[f"{key}id"]) & (own[key] == kept[f"{key}kept"]), "left_semi")
    return held.dropDuplicates([id_col, key]).drop(key)
