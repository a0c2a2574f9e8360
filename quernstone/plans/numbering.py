"""Row numbers within groups, given by ranges, so that no group is sorted in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.folders import shared_folder


#: Rows that a task of spread() holds on average.
TASK_ROWS = 1_000_000


def spread(rows: DataFrame, n_rows: int, *keys: str) -> DataFrame:
    """rows dealt by keys to as many tasks as n_rows need; Spark joins none of them, so that what a task holds does not grow with the input."""
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // TASK_ROWS))
    return rows.repartition(tasks, *keys)


#: So many starts of groups in ranges go to every task.
FEW = 10_000


def numbered(rows: DataFrame, groups: list[str], order: list, name: str = "number") -> DataFrame:
    """rows with their number from 0 within each group, in an order. Tasks hold ranges of groups and order, sorted, and are written with each row's
    place; a start for each group of each range, from a table with a row for each of these, turns places into numbers. So rows are dealt once,
    unless there are so many starts that rows must meet them. Rows equal in group and order share places among them. order holds names or sort
    expressions. Spark makes rows twice, first to find the ranges; what is dear to make is best written before."""
    spark, held, kept = rows.sparkSession, shared_folder(rows.sparkSession), shared_folder(rows.sparkSession)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*map(F.col, groups), *order]
    dealt = rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    # The lower 33 bits count the rows of a task.
    dealt = dealt.withColumn("range_", F.spark_partition_id()).withColumn("place_", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    dealt.write.parquet(held)
    placed = spark.read.schema(dealt.schema).parquet(held)
    starts = placed.groupBy("range_", *groups).agg(F.count("*").alias("n_"), F.min("place_").alias("first_"))
    earlier = Window.partitionBy(*groups).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n_").over(earlier), F.lit(0)) - F.col("first_")
    starts = starts.select(F.col("range_").alias("r_"), *[F.col(g).alias(f"{g}_") for g in groups], before.alias("start_"))
    starts.write.parquet(kept)
    starts = spark.read.schema(starts.schema).parquet(kept)
    starts = starts.hint("broadcast" if starts.count() <= FEW else "merge")
    match = placed["range_"] == starts["r_"]
    for g in groups:
        match = match & placed[g].eqNullSafe(starts[f"{g}_"])
    return placed.join(starts, match).select(*rows.columns, (F.col("start_") + F.col("place_")).alias(name))
