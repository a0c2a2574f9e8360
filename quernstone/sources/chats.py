"""Chat exports of unlike shapes: roots that are a list, an object around a list or one conversation; messages in trees or lists; contents that
are texts, lists or neither. Everything whose type varies is read as VARIANT."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.dialect import Dialect, Registry
from ..views import run_sql
from .imports import stored

R = Registry()

# Fixed values of the formats.
UNTITLED, UNTITLED_FLAT, UNKNOWN = "Untitled", "Untitled Grok Conversation", "unknown"


def _text(v: str, path: str) -> str:
    return f"try_variant_get({v}, '{path}', 'string')"


def _list(v: str, path: str) -> str:
    return f"try_variant_get({v}, '{path}', 'array<variant>')"


def _filled(*texts: str) -> str:
    """The first that is neither null nor empty."""
    return f"coalesce({', '.join(f"nullif({t}, '')" for t in texts)})"


#: SQL over a message x and its place i. In a tree only texts count among the parts of a content.
PARTS = f"coalesce(array_join(transform(filter({_list('x', '$.content.parts')}, p -> schema_of_variant(p) = 'STRING'), p -> {_text('p', '$')}), ' '), '')"
CONTENT = f"""coalesce(CASE WHEN is_variant_null(try_variant_get(x, '$.content', 'variant')) THEN '' WHEN {_list('x', '$.content')} IS NOT NULL THEN array_join(transform(filter({_list('x', '$.content')}, p -> NOT is_variant_null(p)), p -> coalesce({_text('p', '$')}, to_json(p))), ' ')
 ELSE coalesce({_text('x', '$.content')}, to_json(try_variant_get(x, '$.content', 'variant'))) END, '')"""


def _objects(exports: DataFrame, roots: str) -> DataFrame:
    """c: each conversation of each export; what is no JSON or no object goes."""
    root = exports.select(F.expr("try_parse_json(value)").alias("v")).where("v IS NOT NULL AND NOT is_variant_null(v)")
    return root.select(F.explode(F.expr(roots)).alias("c")).where("schema_of_variant(c) LIKE 'OBJECT%'")


def _rows(messages: DataFrame) -> DataFrame:
    return messages.select("conv_id", "title", "created", "updated", F.posexplode("messages").alias("place", "m")).select("conv_id", "title", "created", "updated", "place", "m.role", "m.content", "m.said_at")


def tree_messages(exports: DataFrame) -> DataFrame:
    """conv_id, title, created, updated, place, role, content, said_at of exports with trees of nodes, or, where a conversation has none, with a list of
    messages. Nodes are ordered by their time, none counting as 0, and by their keys; listed messages stay in their order. An id is
    taken from `id` where `conversation_id` is missing."""
    found = _objects(exports, f"coalesce({_list('v', '$')}, array(v))")
    nodes = "map_entries(try_variant_get(c, '$.mapping', 'map<string,variant>'))"
    of_tree = f"transform(filter(transform({nodes}, e -> try_variant_get(e.value, '$.message', 'variant')), x -> x IS NOT NULL AND schema_of_variant(x) LIKE 'OBJECT%' AND schema_of_variant(x) <> 'OBJECT<>'), (x, i) -> named_struct('o', coalesce(try_variant_get(x, '$.create_time', 'double'), 0D), 'i', i, 'role', coalesce({_text('x', '$.author.role')}, '{UNKNOWN}'), 'content', {PARTS}, 'said_at', try_variant_get(x, '$.create_time', 'double')))"
    of_list = f"transform(filter({_list('c', '$.messages')}, x -> schema_of_variant(x) LIKE 'OBJECT%'), (x, i) -> named_struct('o', 0D, 'i', i, 'role', coalesce({_text('x', '$.role')}, '{UNKNOWN}'), 'content', coalesce({_text('x', '$.content')}, ''), 'said_at', try_variant_get(x, '$.timestamp', 'double')))"
    return _rows(found.selectExpr(
        f"coalesce({_text('c', '$.conversation_id')}, {_text('c', '$.id')}, '{UNKNOWN}') AS conv_id", f"coalesce({_text('c', '$.title')}, '{UNTITLED}') AS title", f"{_text('c', '$.create_time')} AS created", f"{_text('c', '$.update_time')} AS updated",
        f"array_sort(CASE WHEN try_variant_get(c, '$.mapping', 'variant') IS NOT NULL THEN {of_tree} ELSE {of_list} END) AS messages",
    ))


def flat_messages(exports: DataFrame) -> DataFrame:
    """The same of exports without trees: ids, titles and times are the first of two that are not empty; a content that is a list is joined by
    blanks, without nulls; one that is missing is empty."""
    found = _objects(exports, f"coalesce({_list('v', '$')}, {_list('v', '$.conversations')}, array(v))")
    at = "coalesce(nullif(try_variant_get(x, '$.timestamp', 'double'), 0D), try_variant_get(x, '$.create_time', 'double'))"
    messages = f"transform(filter({_list('c', '$.messages')}, x -> schema_of_variant(x) LIKE 'OBJECT%'), (x, i) -> named_struct('i', i, 'role', coalesce({_text('x', '$.role')}, '{UNKNOWN}'), 'content', {CONTENT}, 'said_at', {at}))"
    return _rows(found.selectExpr(
        f"coalesce({_filled(_text('c', '$.id'), _text('c', '$.conversation_id'))}, '{UNKNOWN}') AS conv_id", f"coalesce({_filled(_text('c', '$.title'))}, '{UNTITLED_FLAT}') AS title",
        f"{_filled(_text('c', '$.created_at'), _text('c', '$.create_time'))} AS created", f"{_filled(_text('c', '$.updated_at'), _text('c', '$.update_time'))} AS updated", f"{messages} AS messages",
    ))


# The given conversations as exports --------------------------------------------------------------------------------------

MESSAGES = "SELECT conv_id, msg_index, role, coalesce(content, '') AS content, CASE WHEN msg_index % 4 = 3 THEN NULL ELSE CAST(msg_index AS DOUBLE) END AS said_at FROM v_messages"


def _json(d: str) -> str:
    """A text as a JSON string."""
    return f"substring(to_json(struct({d} AS s)), 6, length(to_json(struct({d} AS s))) - 6)"


def _exports(spark: SparkSession, sf_dir: str, message: str, around: str) -> DataFrame:
    lines = run_sql(spark, sf_dir, f"SELECT conv_id, array_join(transform(sort_array(collect_list(struct(msg_index, {message} AS j))), e -> e.j), ',') AS m FROM ({MESSAGES}) x GROUP BY conv_id")
    return stored(lines.select(F.expr(around).alias("value")))


def tree_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = f"""CASE conv_id % 4 WHEN 2 THEN concat('{{"role":', {_json('role')}, ',"content":', {_json('content')}, ',"timestamp":', coalesce(CAST(said_at AS STRING), 'null'), '}}')
 ELSE concat('"n', lpad(CAST(msg_index AS STRING), 6, '0'), '":{{"message":{{"author":{{"role":', {_json('role')}, '}},"create_time":', coalesce(CAST(said_at AS STRING), 'null'), ',"content":{{"parts":[', {_json('content')}, ',7,null,"end"]}}}}}},"x', CAST(msg_index AS STRING), '":{{"message":null}},"y', CAST(msg_index AS STRING), '":3') END"""
    around = """CASE conv_id % 4 WHEN 0 THEN concat('[{"conversation_id":"', conv_id, '","create_time":1.5,"mapping":{', m, '}}]') WHEN 1 THEN concat('{"conversation_id":"', conv_id, '","title":"T","mapping":{', m, '}}')
 WHEN 2 THEN concat('{"id":', conv_id, ',"messages":[', m, ']}') ELSE concat('[5,{"id":"', conv_id, '","title":null,"update_time":"u","mapping":{', m, '}},"no conversation"]') END"""
    return tree_messages(_exports(spark, sf_dir, node, around)).withColumn("content", F.sha2("content", 256))


def flat_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = f"CASE conv_id % 4 WHEN 2 THEN concat('[', {_json('content')}, ',null,7,\"end\"]') WHEN 3 THEN CASE WHEN msg_index % 3 = 0 THEN '12' WHEN msg_index % 3 = 1 THEN 'null' ELSE {_json('content')} END ELSE {_json('content')} END"
    message = f"concat('{{\"role\":', {_json('role')}, ',\"content\":', {content}, CASE WHEN said_at IS NULL THEN ',\"create_time\":9.5' ELSE concat(',\"timestamp\":', CAST(said_at AS STRING)) END, '}}', CASE WHEN msg_index % 5 = 0 THEN ',4' ELSE '' END)"
    around = """CASE conv_id % 4 WHEN 0 THEN concat('[{"id":"', conv_id, '","messages":[', m, ']}]') WHEN 1 THEN concat('{"conversations":[{"id":"","conversation_id":"', conv_id, '","title":"T","created_at":"","create_time":"c","messages":[', m, ']},7]}')
 WHEN 2 THEN concat('{"id":"', conv_id, '","title":"","updated_at":"u","messages":[', m, ']}') ELSE concat('[5,{"id":', conv_id, ',"messages":[', m, ']}]') END"""
    return flat_messages(_exports(spark, sf_dir, message, around)).withColumn("content", F.sha2("content", 256))


QUERIES = {"src_json_tree": tree_query, "src_json_flat": flat_query}


@R.add("src_json_tree")
def _(d: Dialect) -> str:
    """The check: listed messages as they stand, those of trees by time, none as 0."""
    return f"""
SELECT CAST(conv_id AS VARCHAR) AS conv_id, CASE WHEN conv_id % 4 = 1 THEN 'T' ELSE '{UNTITLED}' END AS title, CASE WHEN conv_id % 4 = 0 THEN '1.5' END AS created, CASE WHEN conv_id % 4 = 3 THEN 'u' END AS updated,
       CAST(row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN conv_id % 4 = 2 THEN 0 ELSE coalesce(said_at, 0) END, msg_index) - 1 AS INTEGER) AS place, role, sha256(CASE WHEN conv_id % 4 = 2 THEN content ELSE concat(content, ' end') END) AS content, said_at
FROM ({MESSAGES}) m"""


@R.add("src_json_flat")
def _(d: Dialect) -> str:
    return f"""
SELECT CAST(conv_id AS VARCHAR) AS conv_id, CASE WHEN conv_id % 4 = 1 THEN 'T' ELSE '{UNTITLED_FLAT}' END AS title, CASE WHEN conv_id % 4 = 1 THEN 'c' END AS created, CASE WHEN conv_id % 4 = 2 THEN 'u' END AS updated,
       CAST(row_number() OVER (PARTITION BY conv_id ORDER BY msg_index) - 1 AS INTEGER) AS place, role, sha256(CASE conv_id % 4 WHEN 2 THEN concat(content, ' 7 end') WHEN 3 THEN CASE msg_index % 3 WHEN 0 THEN '12' WHEN 1 THEN '' ELSE content END ELSE content END) AS content,
       CASE WHEN said_at IS NULL THEN 9.5 WHEN said_at = 0 THEN NULL ELSE said_at END AS said_at
FROM ({MESSAGES}) m"""
