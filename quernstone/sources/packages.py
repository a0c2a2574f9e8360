"""Packages and exports: written under the folder that the cluster shares, and read back with a given schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.relational import DENIED
from ..plans.dialect import Dialect, Registry
from ..streaming.changes import shared_folder
from ..views import run_sql, view

R = Registry()


def package_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects as nested JSON and back: how many there are, and how many rows differ either way."""
    objects = view(spark, sf_dir, "v_objects").withColumn("provenance", F.struct("source_platform", "source_file", "tenant_id", "silo_id")).drop("source_platform", "source_file", "tenant_id", "silo_id")
    path = shared_folder(spark)
    objects.write.option("ignoreNullFields", "false").json(path)
    back = spark.read.schema(objects.schema).json(path)
    lost = objects.exceptAll(back).withColumn("side", F.lit(1)).unionByName(back.exceptAll(objects).withColumn("side", F.lit(2)))
    return back.agg(F.count("*").alias("objects")).crossJoin(lost.agg(F.count("*").alias("differences")))  # one row by one row


def export_objects(objects: DataFrame, tenant: str, silo: str) -> DataFrame:
    """Stores the last row of each object with its JSON. One row of another tenant or silo refuses the whole export."""
    if not objects.where(~(F.col("tenant_id").eqNullSafe(tenant) & F.col("silo_id").eqNullSafe(silo))).isEmpty():
        raise ValueError(f"objects of another tenant or silo than {tenant}/{silo}")
    last = objects.withColumn("n", F.row_number().over(Window.partitionBy("object_id").orderBy(F.desc("ord")))).where("n = 1").drop("n")
    path = shared_folder(objects.sparkSession)
    last.select("object_id", "tenant_id", "silo_id", "source_platform", "title", F.to_json(F.struct("*")).alias("raw_json")).write.parquet(path)
    return objects.sparkSession.read.parquet(path)


def object_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objects of t1/s0 that are not denied, stored and read back."""
    mine = run_sql(spark, sf_dir, f"SELECT * FROM v_objects o WHERE tenant_id = 't1' AND silo_id = 's0' AND NOT {DENIED}")
    return export_objects(mine, "t1", "s0").select("object_id", "source_platform", F.get_json_object("raw_json", "$.title").alias("title"))


QUERIES = {"pkg_roundtrip": package_roundtrip, "sink_object_store": object_store}

R.plain(
    pkg_roundtrip="SELECT count(*) AS objects, CAST(0 AS BIGINT) AS differences FROM v_objects",
    sink_object_store=f"SELECT object_id, source_platform, title FROM v_objects o WHERE tenant_id = 't1' AND silo_id = 's0' AND NOT {DENIED}",
)
