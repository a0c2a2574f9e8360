"""Reports, Markdown documents and workspaces: folders of files, written by key and read back by partition discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dictionaries import R as DICTIONARIES
from ..operators.relational import R as RELATIONAL
from ..plans.dialect import DUCK, SPARK, Dialect, Registry
from ..streaming.changes import shared_folder
from ..views import run_sql, view

R = Registry()

#: Report, its query, and the field that names a row's subject.
REPORTS = {"inventory": ("agg_inventory", "conv_id"), "index": ("agg_inverted_index", "token"), "entities": ("set_entity_union", "doc_id")}


def _report(d: Dialect, key: str) -> str:
    return (RELATIONAL if key in RELATIONAL else DICTIONARIES)[key](d)


def sink_json_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of JSON lines for each report; what each holds when read back."""
    path = shared_folder(spark)
    for name, (key, _) in REPORTS.items():
        run_sql(spark, sf_dir, _report(Dialect(SPARK), key)).write.json(f"{path}/report={name}")
    subject = F.coalesce(*[F.when(F.col("report") == name, F.get_json_object("value", f"$.{field}")) for name, (_, field) in REPORTS.items()])
    return spark.read.text(path).groupBy("report").agg(F.count("*").alias("n_rows"), F.count_distinct(subject).alias("n_subjects"))


def markdown_sections(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """topic, section of one Markdown document per topic: newest conversation first, its heading, then its messages in order. Messages
    without text have no section. The rows are sorted over all tasks by topic and place, so no task holds a whole topic."""
    c = conversations.select("conv_id", "created", F.coalesce(F.expr("nullif(source_platform, '')"), F.lit("Unknown")).alias("topic"), F.coalesce("title", F.lit("Untitled")).alias("title"), "source")
    heads = c.select("topic", "created", "conv_id", F.lit(-1).cast("long").alias("at"), F.concat(F.lit("## "), "title", F.lit("\n\n*Source: "), "source", F.lit(" | Date: "), "created", F.lit("*\n")).alias("section"))
    said = messages.where("trim(content) <> ''").select("conv_id", F.col("msg_index").cast("long").alias("at"), F.concat(F.lit("### "), F.initcap("role"), F.lit("\n\n"), "content", F.lit("\n")).alias("section"))
    rows = heads.unionByName(c.select("topic", "created", "conv_id").join(said, "conv_id").select("topic", "created", "conv_id", "at", "section"))
    return rows.orderBy("topic", F.desc("created"), "conv_id", "at").select("topic", "section")


def sink_markdown_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of all topics, written in order and read back line by line."""
    path = shared_folder(spark)
    markdown_sections(view(spark, sf_dir, "v_messages"), view(spark, sf_dir, "v_conversations")).write.partitionBy("topic").text(path)
    lines = spark.read.option("lineSep", "\n").text(path)
    count = lambda p: F.count_if(F.col("value").rlike(p))
    return lines.groupBy("topic").agg(count("^## ").alias("conversations"), count("^### ").alias("messages"), F.sum(F.length("value")).alias("chars"))


def read_workspace(spark: SparkSession, path: str) -> DataFrame:
    """Conversations of all platforms that have a manifest."""
    known = spark.read.schema("platform string").json(f"{path}/manifest").distinct()
    found = spark.read.schema("conv_id long, title string, attachments array<string>, platform string").json(f"{path}/platforms")
    return found.join(known.hint("shuffle_hash"), "platform", "left_semi")


def src_workspace_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workspace written from the conversations, in which one platform has no manifest, and what each other one holds."""
    path = shared_folder(spark)
    files = view(spark, sf_dir, "v_attachments").groupBy("conv_id").agg(F.collect_list("file_name").alias("attachments"))
    rows = view(spark, sf_dir, "v_conversations").join(files, "conv_id", "left").select("conv_id", "title", "attachments", F.coalesce(F.expr("nullif(source_platform, '')"), F.lit("Unknown")).alias("platform"))
    rows.write.partitionBy("platform").json(f"{path}/platforms")
    rows.where("platform <> 'Unknown'").select("platform").distinct().write.json(f"{path}/manifest")
    return read_workspace(spark, path).groupBy("platform").agg(F.count("*").alias("conversations"), F.sum(F.coalesce(F.array_size("attachments"), F.lit(0)).cast("long")).alias("attachments"))


QUERIES = {f.__name__: f for f in (sink_json_reports, sink_markdown_docs, src_workspace_read)}


@R.add("sink_json_reports")
def _(d: Dialect) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS report, count(*) AS n_rows, count(DISTINCT CAST({field} AS {d.text})) AS n_subjects FROM ({_report(Dialect(DUCK) if not d.spark else d, key)}) r_{name}" for name, (key, field) in REPORTS.items())


R.plain(
    sink_markdown_docs="""
SELECT topic, count(*) AS conversations, CAST(sum(n) AS BIGINT) AS messages, CAST(sum(head + body) AS BIGINT) AS chars FROM
(SELECT coalesce(nullif(c.source_platform, ''), 'Unknown') AS topic, coalesce(m.n, 0) AS n, coalesce(m.chars, 0) AS body, length(replace(coalesce(c.title, 'Untitled'), chr(10), '')) + length(c.source) + length(c.created) + 22 AS head
 FROM v_conversations c LEFT JOIN (SELECT conv_id, count(*) AS n, sum(length(replace(content, chr(10), '')) + length(role) + 4) AS chars FROM v_messages WHERE trim(content) <> '' GROUP BY conv_id) m ON m.conv_id = c.conv_id) t GROUP BY topic""",
    src_workspace_read="""
SELECT c.source_platform AS platform, count(*) AS conversations, CAST(sum(coalesce(a.n, 0)) AS BIGINT) AS attachments FROM v_conversations c
LEFT JOIN (SELECT conv_id, count(*) AS n FROM v_attachments GROUP BY conv_id) a ON a.conv_id = c.conv_id WHERE c.source_platform <> '' GROUP BY c.source_platform""",
)
