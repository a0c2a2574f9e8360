"""Published tables: projections written by tenant and silo in numbered batches, visible together once the manifest is there."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..llm.common import written
from ..operators.dictionaries import entities
from ..operators.relational import fingerprints
from ..plans.dialect import DUCK, SPARK, Dialect, Registry
from ..plans.numbering import numbered
from ..streaming.folders import shared_folder
from ..views import run_sql

R = Registry()

BATCH = 500
OWNER = "concat('t', CAST({0} % 3 AS STRING)) AS tenant_id, concat('s', CAST({0} % 2 AS STRING)) AS silo_id"


def projections(d: Dialect) -> dict[str, str]:
    """The tables; each has tenant_id, silo_id, id."""
    return {
        "platforms": "SELECT tenant_id, silo_id, coalesce(nullif(source_platform, ''), 'Unmapped') AS id, count(*) AS conversations, min(created) AS first_created, max(created) AS last_created FROM v_conversations GROUP BY tenant_id, silo_id, coalesce(nullif(source_platform, ''), 'Unmapped')",
        "conversations": f"SELECT tenant_id, silo_id, CAST(conv_id AS {d.text}) AS id, title, source, created FROM v_conversations",
        "messages": "SELECT tenant_id, silo_id, message_id AS id, role, content FROM v_messages",
        "objects": "SELECT tenant_id, silo_id, object_id AS id, title, content, source_platform, source_file FROM v_objects",
        "entities": f"SELECT {OWNER.format('conv_id')}, concat(message_id, ':', type, ':', value) AS id, type, value FROM ({entities(d)}) e",
        "attachments": f"SELECT {OWNER.format('conv_id')}, attachment_id AS id, file_name, media_type FROM v_attachments",
        "fingerprints": f"SELECT {OWNER.format('conv_id')}, CAST(conv_id AS {d.text}) AS id, fingerprint FROM ({fingerprints(d)}) f",
    }


def publish(spark: SparkSession, tables: dict[str, DataFrame], folder: str, batch: int = BATCH) -> None:
    """Writes every table with the number of its batch within tenant and silo; the manifest, with the rows of each, comes last."""
    counts = None
    for name, rows in tables.items():
        placed = numbered(rows, ["tenant_id", "silo_id"], [F.col("id")], "place_in_silo")
        placed = placed.withColumn("batch", F.floor(F.col("place_in_silo") / batch)).drop("place_in_silo")
        placed.write.partitionBy("tenant_id", "silo_id").parquet(f"{folder}/{name}")
        written = spark.read.schema(placed.schema).parquet(f"{folder}/{name}")
        one = written.agg(F.count("*").alias("n_rows"), F.count_distinct("tenant_id", "silo_id", "batch").alias("n_batches"))
        one = one.select(F.lit(name).alias("name"), F.lit(placed.schema.json()).alias("schema"), "n_rows", "n_batches")
        counts = one if counts is None else counts.unionByName(one)
    counts.write.json(f"{folder}/manifest")


def published(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a folder's manifest; without one nothing is published, whatever lies there."""
    manifest = spark.read.schema("name string, schema string, n_rows long, n_batches long").json(f"{folder}/manifest")
    return {r["name"]: spark.read.schema(StructType.fromJson(json.loads(r["schema"]))).parquet(f"{folder}/{r['name']}") for r in manifest.collect()}  # a row a table


def published_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back: rows, first and last id of each batch of each table."""
    folder = shared_folder(spark)
    tables = {name: run_sql(spark, sf_dir, sql) for name, sql in projections(Dialect(SPARK)).items()}
    # Texts are searched once; numbers need the rows twice.
    tables["entities"] = written(tables["entities"])
    publish(spark, tables, folder)
    out = None
    for name, rows in published(spark, folder).items():
        one = rows.groupBy("tenant_id", "silo_id", "batch").agg(F.count("*").alias("n_rows"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).withColumn("name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {"sink_published_tables": published_tables}


@R.add("sink_published_tables")
def _(d: Dialect) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS name, tenant_id, silo_id, batch, count(*) AS n_rows, min(id) AS first_id, max(id) AS last_id FROM (SELECT *, CAST((row_number() OVER (PARTITION BY tenant_id, silo_id ORDER BY id) - 1) // {BATCH} AS BIGINT) AS batch FROM ({sql}) p) b GROUP BY tenant_id, silo_id, batch"
        for name, sql in projections(Dialect(DUCK)).items()
    )
