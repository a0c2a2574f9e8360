"""Sharding by a keyed permutation of row numbers.

Rows are sorted and numbered globally from 0; a balanced Feistel network over the next even number of bits, with cycle
walking for values outside the rows' range, permutes the numbers. The permuted number gives shard and slot, so that
any row's place, and the row at any place, can be computed without a table. Counts differ by one at most.

Defined results: rows are ordered by id (null first), then size and checksum; rows equal in all three may be told apart
by nothing and share places among them; null and empty texts have size 1; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

ROUNDS, KEY = 6, 20_240_117


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _half_bits(n: int) -> int:
    return max(1, (max(2, n) - 1).bit_length() + 1 >> 1)


def _pass(x: np.ndarray, half: int, key: int, back: bool) -> np.ndarray:
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> h, x & mask
    for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if back:
            left, right = right ^ (_mix(left, key + k) & mask), left
        else:
            left, right = right, left ^ (_mix(right, key + k) & mask)
    return left << h | right


def permute(numbers, n: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """The permutation of 0..n-1, or its inverse, for an array of numbers."""
    x, half = np.asarray(numbers, dtype=np.uint64).copy(), _half_bits(n)
    open_ = np.ones(len(x), dtype=bool)
    while open_.any():  # fewer than four steps each are to be expected
        x[open_] = _pass(x[open_], half, key, back)
        open_ = x >= n
    return x.astype(np.int64)


def numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with `number`, 0.. in the order of by. Tasks sort ranges; a start for each range comes from a table with one row per task."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(tasks, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed)
    part = F.shiftright("_at", 33)
    starts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    starts = starts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    joined = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")  # at most a row for each shuffle partition
    return joined.withColumn("number", F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_start")


def shuffled_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", key: int = KEY) -> DataFrame:
    """One row per row of docs: id, size, text_crc32, number, place (its permuted number), shard, slot."""
    t = text_or_empty(text_col)
    rows = written(docs.select(F.col(id_col), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32")))
    n = rows.count()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("place", pa.array(permute(b.column("number").to_numpy(), n, key)))

    out = numbered(rows, [id_col, "size", "text_crc32"])
    shape = ", ".join(f"`{c}` {kind}" for c, kind in out.dtypes)
    out = out.mapInArrow(place, f"{shape}, place long")
    return out.withColumn("shard", (F.col("place") % shards).cast("int")).withColumn("slot", F.expr(f"place div {shards}"))


def row_number_at(shard: int, slot: int, shards: int, n: int, key: int = KEY) -> int:
    """The number of the row that has this place."""
    return int(permute([slot * shards + shard], n, key, back=True)[0])
