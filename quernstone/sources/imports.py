"""Exports of chats and activities: JSON of unlike shapes, written as text from the given tables and imported again.

Values whose type varies are kept as VARIANT, so a list or an object around the conversations and parts that are no texts need no second read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.dialect import Dialect, Registry
from ..streaming.changes import shared_folder
from ..views import view

R = Registry()

#: Fixed values of the formats.
HEADER, ACTIVITY_V1, ACTIVITY_OTHER = "Gemini Apps", "gemini-myactivity-v1", "gemini-myactivity-unknown"
UNTITLED_V2 = "Untitled Conversation"

ACTIVITY = "array<struct<header: string, title: string, safeHtmlItem: variant>>"


def stored(lines: DataFrame) -> DataFrame:
    """A column of texts, written one to a line and read back."""
    path = shared_folder(lines.sparkSession)
    lines.write.text(path)
    return lines.sparkSession.read.text(path)


def objects_v2(exports: DataFrame) -> DataFrame:
    """One row per conversation of generic exports, with the places of the messages that hold text, and what is attached.

    The root is a list, an object with a list, or one conversation. The id is the first of three that is not empty; without any it
    is named by its own digest, so reruns agree. A conversation without messages and content goes."""
    root = exports.select(F.expr("try_parse_json(value)").alias("v")).where("v IS NOT NULL")
    items = root.select(F.explode(F.expr("coalesce(try_variant_get(v, '$', 'array<variant>'), try_variant_get(v, '$.conversations', 'array<variant>'), array(v))")).alias("c"))
    got = items.where("schema_of_variant(c) LIKE 'OBJECT%'").selectExpr(
        "coalesce(nullif(try_variant_get(c, '$.conversation_id', 'string'), ''), nullif(try_variant_get(c, '$.id', 'string'), ''), nullif(try_variant_get(c, '$.uuid', 'string'), ''), substring(sha2(to_json(c), 256), 1, 12)) AS object_id",
        f"coalesce(nullif(try_variant_get(c, '$.title', 'string'), ''), '{UNTITLED_V2}') AS title",
        "filter(coalesce(try_variant_get(c, '$.messages', 'array<variant>'), array()), m -> schema_of_variant(m) LIKE 'OBJECT%') AS messages",
        "coalesce(try_variant_get(c, '$.content', 'string'), '') AS own",
        "coalesce(try_variant_get(c, '$.attachments', 'array<variant>'), array()) AS attached",
    ).where("size(messages) > 0 OR own <> ''")
    said = got.selectExpr(
        "object_id", "title", "own",
        """filter(transform(messages, (m, i) -> named_struct('i', i, 'role', coalesce(nullif(try_variant_get(m, '$.role', 'string'), ''), 'unknown'), 'text',
            coalesce(array_join(try_variant_get(m, '$.content', 'array<string>'), ' '), try_variant_get(m, '$.content', 'string'), ''))), x -> trim(x.text) <> '') AS said""",
        "transform(attached, a -> coalesce(try_variant_get(a, '$.file_path', 'string'), try_variant_get(a, '$', 'string'))) AS attachments",
    )
    return said.selectExpr(
        "object_id", "title", "transform(said, x -> concat(object_id, '_span_', x.i)) AS spans",
        "CASE WHEN size(said) > 0 THEN array_join(transform(said, x -> concat(x.role, ': ', x.text)), '\\n\\n') ELSE own END AS content", "attachments",
    )


def src_json_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations under three names for their ids and in three kinds of roots; the second message of each is blank, every seventh has none at all."""
    said = F.expr("struct(msg_index, role, CASE WHEN msg_index = 1 THEN '  ' ELSE content END AS content)")
    grouped = view(spark, sf_dir, "v_messages").groupBy("conv_id").agg(F.sort_array(F.collect_list(said)).alias("m"))
    o = grouped.selectExpr("conv_id", """to_json(named_struct(CASE_ID, concat('c', conv_id), 'messages', CASE WHEN conv_id % 7 <> 0 THEN transform(m, x -> named_struct('role', x.role, 'content', x.content)) END,
        'attachments', array(CAST(concat('f', conv_id) AS VARIANT), to_variant_object(named_struct('file_path', 'g')))))""".replace("CASE_ID", "'id'") + " AS o")
    lines = o.selectExpr("""CASE conv_id % 3 WHEN 0 THEN concat('[', o, ']') WHEN 1 THEN concat('{"conversations":[', replace(o, '{"id":', '{"conversation_id":"","uuid":'), ']}') ELSE replace(o, '{"id":', '{"conversation_id":') END AS value""")
    return objects_v2(stored(lines)).select("object_id", "title", F.array_join("spans", ",").alias("spans"), F.sha2("content", 256).alias("content"), F.array_join("attachments", ",").alias("attachments"))


def activity_records(exports: DataFrame) -> DataFrame:
    """name, error, version, records of activity exports: a file that breaks a rule is refused with the rule's name and gives no records."""
    read = exports.selectExpr("name", "try_parse_json(value) AS v", "value").select("name", "v", F.from_json("value", ACTIVITY).alias("all"))
    kept = read.select("name", "v", "all", F.filter("all", lambda r: r["header"] == HEADER).alias("mine"))
    error = F.expr("""CASE WHEN v IS NULL THEN 'malformed_json' WHEN schema_of_variant(v) NOT LIKE 'ARRAY%' THEN 'unsupported_schema' WHEN size(all) = 0 THEN 'empty_file'
        WHEN size(mine) = 0 THEN 'no_gemini_conversations' ELSE '' END""")
    judged = kept.select("name", error.alias("error"), "mine")
    version = F.expr(f"CASE WHEN error = '' THEN CASE WHEN mine[0].safeHtmlItem IS NOT NULL THEN '{ACTIVITY_V1}' ELSE '{ACTIVITY_OTHER}' END END")
    return judged.select("name", "error", version.alias("version"), F.expr("CASE WHEN error = '' THEN mine ELSE array() END").alias("records"))


def src_activity_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export for each user, four of nine broken in different ways."""
    item = F.expr(f"""struct(ord, CASE WHEN user_id % 9 = 3 THEN 'Other' ELSE header END AS header, title, CASE WHEN user_id % 2 = 0 THEN array(named_struct('html', '<p>x</p>')) END AS safeHtmlItem)""")
    files = view(spark, sf_dir, "v_activity").groupBy("user_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(item)), lambda r: F.struct(r["header"].alias("header"), r["title"].alias("title"), r["safeHtmlItem"].alias("safeHtmlItem")))).alias("j"))
    lines = files.selectExpr("concat(user_id, ' ', CASE user_id % 9 WHEN 0 THEN substring(j, 1, length(j) - 1) WHEN 1 THEN concat('{\"records\":', j, '}') WHEN 2 THEN '[]' ELSE j END) AS value")
    read = stored(lines).selectExpr("substring_index(value, ' ', 1) AS name", "substring(value, instr(value, ' ') + 1) AS value")
    return activity_records(read).select("name", "error", "version", F.size("records").alias("n_records"), F.sha2(F.array_join(F.transform("records", lambda r: r["title"]), "|"), 256).alias("titles"))


QUERIES = {f.__name__: f for f in (src_json_v2, src_activity_json)}


@R.add("src_json_v2")
def _(d: Dialect) -> str:
    spans, body = d.joined(f"concat('c', CAST(conv_id AS {d.text}), '_span_', CAST(place AS {d.text}))", "place", ","), d.joined("concat(role, ': ', content)", "place", "@@")
    body = f"replace({body}, '@@', concat(chr(10), chr(10)))"
    named = f"concat('c', CAST(conv_id AS {d.text}))"
    return f"""
SELECT {named} AS object_id, '{UNTITLED_V2}' AS title, {spans} AS spans, {d.sha(body)} AS content, concat('f', CAST(conv_id AS {d.text}), ',g') AS attachments
FROM (SELECT conv_id, role, msg_index, content, row_number() OVER (PARTITION BY conv_id ORDER BY msg_index) - 1 AS place FROM v_messages) t
WHERE conv_id % 7 <> 0 AND msg_index <> 1 AND trim(content) <> '' GROUP BY conv_id"""


@R.add("src_activity_json")
def _(d: Dialect) -> str:
    titles = d.joined("CASE WHEN header = 'Gemini Apps' THEN title END", "ord")
    code = "CASE user_id % 9 WHEN 0 THEN 'malformed_json' WHEN 1 THEN 'unsupported_schema' WHEN 2 THEN 'empty_file' WHEN 3 THEN 'no_gemini_conversations' ELSE CASE WHEN n = 0 THEN 'no_gemini_conversations' ELSE '' END END"
    return f"""
SELECT name, error, CASE WHEN error <> '' THEN NULL WHEN user_id % 2 = 0 THEN '{ACTIVITY_V1}' ELSE '{ACTIVITY_OTHER}' END AS version, CAST(CASE WHEN error = '' THEN n ELSE 0 END AS INT) AS n_records,
       {d.sha("CASE WHEN error = '' THEN titles ELSE '' END")} AS titles
FROM (SELECT *, {code} AS error FROM (SELECT user_id, CAST(user_id AS {d.text}) AS name, sum(CASE WHEN header = '{HEADER}' THEN 1 ELSE 0 END) AS n, {titles} AS titles FROM v_activity GROUP BY user_id) a) b"""
