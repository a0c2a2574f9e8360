"""Envelopes as an append-only table of revisions: each is made from the latest one, keeps what it does not change, and names its parent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.dialect import Dialect, Registry
from ..streaming.folders import shared_folder
from ..views import run_sql

R = Registry()

SHAPE = "envelope_id long, revision int, parent_revision int, kind string, lineage array<string>, parameters map<string, struct<value: string, status: string>>"


def first_revisions(envelopes: DataFrame) -> DataFrame:
    """envelope_id, parameters as revision 1."""
    return envelopes.select("envelope_id", F.lit(1).alias("revision"), F.lit(None).cast("int").alias("parent_revision"), F.lit("created").alias("kind"), F.array(F.lit("created")).alias("lineage"), "parameters")


def latest(revisions: DataFrame) -> DataFrame:
    """The last revision of each envelope."""
    rest = [c for c in revisions.columns if c != "envelope_id"]
    return revisions.groupBy("envelope_id").agg(F.max_by(F.struct(*rest), "revision").alias("r")).select("envelope_id", "r.*")


def revise(current: DataFrame, updates: DataFrame, kind: str) -> DataFrame:
    """The next revision of each envelope that updates (envelope_id, changes: a map of parameters) name: parameters are the parent's, with
    the changed ones in their place. An envelope without changes or unknown has no new revision; of two updates of one envelope one is an error
    of the caller's, so updates must hold each envelope once."""
    u = updates.select(F.col("envelope_id").alias("id"), "changes")
    met = current.join(u.hint("merge"), F.col("envelope_id") == F.col("id")).where(F.size("changes") > 0)
    merged = F.map_zip_with("parameters", "changes", lambda k, old, new: F.coalesce(new, old))
    return met.select("envelope_id", (F.col("revision") + 1).alias("revision"), F.col("revision").alias("parent_revision"), F.lit(kind).alias("kind"), F.concat("lineage", F.array(F.lit(kind))).alias("lineage"), merged.alias("parameters"))


#: Three rounds of updates over orders as envelopes: kind, which envelopes, parameter and new value with its status.
ROUNDS = (
    ("assumption", "o_orderstatus = 'O'", (("returnflag", "N", "assumed"),)),
    ("retrieval", "o_orderkey % 2 = 0", (("linestatus", "F", "resolved"), ("priority", "high", "resolved"))),
    ("correction", "o_orderkey % 3 = 0", (("returnflag", "A", "resolved"),)),
)


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends the rounds one after the other, each to what is stored, and reads the table back."""
    folder = f"{shared_folder(spark)}/revisions"
    one = "named_struct('value', CASE WHEN o_orderstatus = 'F' THEN 'R' END, 'status', CASE o_orderstatus WHEN 'F' THEN 'resolved' ELSE 'missing' END)"
    base = run_sql(spark, sf_dir, f"SELECT o_orderkey AS envelope_id, map('returnflag', {one}, 'linestatus', named_struct('value', o_orderstatus, 'status', 'resolved')) AS parameters FROM orders")
    first_revisions(base).write.parquet(f"{folder}/round=0")
    for n, (kind, chosen, changes) in enumerate(ROUNDS, 1):
        stored = spark.read.schema(SHAPE).parquet(f"{folder}/round=*")
        made = "map(" + ", ".join(f"'{k}', named_struct('value', '{v}', 'status', '{s}')" for k, v, s in changes) + ")"
        updates = run_sql(spark, sf_dir, f"SELECT o_orderkey AS envelope_id, {made} AS changes FROM orders WHERE {chosen}")
        revise(latest(stored), updates, kind).write.parquet(f"{folder}/round={n}")
    return spark.read.schema(SHAPE).parquet(f"{folder}/round=*")


def shown(found: DataFrame) -> DataFrame:
    """With lineage and parameters as texts."""
    entries = F.sort_array(F.transform(F.map_entries("parameters"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"]["value"], F.lit("?")), F.lit(":"), e["value"]["status"])))
    return found.select("envelope_id", "revision", "parent_revision", "kind", F.array_join("lineage", ">").alias("lineage"), F.array_join(entries, "|").alias("parameters"))


QUERIES = {"ctx_revisions": lambda spark, sf_dir: shown(revisions(spark, sf_dir)), "win_envelope_latest": lambda spark, sf_dir: shown(latest(revisions(spark, sf_dir)))}


@R.add("ctx_revisions")
def _(d: Dialect) -> str:
    """The check: what each envelope went through, from the orders alone."""
    took = [f"({chosen})" for _, chosen, _ in ROUNDS]
    count = lambda n: " + ".join(["1", *(f"CASE WHEN {t} THEN 1 ELSE 0 END" for t in took[:n])])
    line = lambda n: "concat('created', " + ", ".join([*(f"CASE WHEN {t} THEN '>{ROUNDS[i][0]}' ELSE '' END" for i, t in enumerate(took[:n])), "''"]) + ")"

    def value(name: str, n: int, base: str | None) -> str:
        cases = [f"WHEN {took[i]} THEN '{name}={v}:{s}'" for i in reversed(range(n)) for k, v, s in ROUNDS[i][2] if k == name]
        rest = base or "NULL"
        return f"CASE {' '.join(cases)} ELSE {rest} END" if cases else rest

    parts = []
    for n in range(len(ROUNDS) + 1):
        flag = value("returnflag", n, "CASE WHEN o_orderstatus = 'F' THEN 'returnflag=R:resolved' ELSE 'returnflag=?:missing' END")
        parameters = f"concat_ws('|', {value('linestatus', n, "concat('linestatus=', o_orderstatus, ':resolved')")}, {value('priority', n, None)}, {flag})"
        parent = f"CAST({count(n)} - 1 AS INTEGER)" if n else "CAST(NULL AS INTEGER)"
        parts.append(f"SELECT o_orderkey AS envelope_id, CAST({count(n)} AS INTEGER) AS revision, {parent} AS parent_revision, '{ROUNDS[n - 1][0] if n else 'created'}' AS kind, {line(n)} AS lineage, {parameters} AS parameters FROM orders" + (f" WHERE {took[n - 1]}" if n else ""))
    return " UNION ALL ".join(parts)


@R.add("win_envelope_latest")
def _(d: Dialect) -> str:
    return f"SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY envelope_id ORDER BY revision DESC) AS n FROM ({R['ctx_revisions'](d)}) r) t WHERE n = 1"
