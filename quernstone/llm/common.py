"""Helpers shared by the training-data operators: white space rules, written tables, row counts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space is these six characters only; every other code point belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: str | Column = "text") -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(text_or_empty(text), SPACE), lambda w: w != "")


def word_count(text: str | Column = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def ascii_lower(text: str | Column = "text") -> Column:
    """Lower-cases A-Z and nothing else. Pure ASCII texts, whose byte and character counts agree, take the cheaper function."""
    t = text_or_empty(text)
    return F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also where body uses it inside another lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def free_name(columns: list[str], name: str) -> str:
    """name, with as many underscores behind as make it unlike all columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Only a local master may fall back to a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quernstone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame) -> DataFrame:
    """Writes df once under the shared folder and reads it back: lineage ends there, and its size is known to the planner."""
    path = f"{shared_dir(df.sparkSession)}/quernstone-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
