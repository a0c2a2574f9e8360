"""Derived views over the given tables; the text is valid in Spark SQL and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "v_messages": """
SELECT conv_id, turn AS msg_index, concat('m', CAST(conv_id AS STRING), '_', CAST(turn AS STRING)) AS message_id,
       role, text AS content, conv_id * 1000 + turn AS ord,
       CASE conv_id % 5 WHEN 0 THEN 'ChatGPT' WHEN 1 THEN 'Gemini' WHEN 2 THEN 'Grok' WHEN 3 THEN 'Claude' ELSE '' END AS source_platform,
       concat('t', CAST(conv_id % 3 AS STRING)) AS tenant_id, concat('s', CAST(conv_id % 2 AS STRING)) AS silo_id
FROM conversations
UNION ALL
SELECT conv_id + 1000000, turn, concat('m', CAST(conv_id + 1000000 AS STRING), '_', CAST(turn AS STRING)),
       role, concat('  ', text, '   '), (conv_id + 1000000) * 1000 + turn, 'Copilot',
       concat('t', CAST(conv_id % 3 AS STRING)), concat('s', CAST(conv_id % 2 AS STRING))
FROM conversations WHERE conv_id % 10 = 0
""",
    "v_conversations": """
SELECT conv_id, min(ord) AS ord, max(source_platform) AS source_platform, max(tenant_id) AS tenant_id, max(silo_id) AS silo_id,
       concat('export-', lower(max(source_platform)), '.json') AS source,
       substring(min(CASE WHEN role = 'user' THEN content END), 1, 40) AS title,
       concat('2024-01-', lpad(CAST(1 + conv_id % 28 AS STRING), 2, '0')) AS created
FROM v_messages GROUP BY conv_id
""",
    "v_objects": """
SELECT concat('d', CAST(doc_id AS STRING)) AS object_id, doc_id AS ord, substring(text, 1, 60) AS title, text AS content,
       CASE WHEN doc_id % 9 = 0 THEN NULL ELSE source END AS source_platform,
       CASE WHEN doc_id % 15 = 0 THEN NULL ELSE concat(lang, '.json') END AS source_file,
       concat('t', CAST(doc_id % 3 AS STRING)) AS tenant_id, concat('s', CAST(doc_id % 2 AS STRING)) AS silo_id,
       CAST(floor(doc_id / 10) AS BIGINT) AS conversation_id
FROM documents
""",
    "v_object_sources": """
SELECT concat('d', CAST(doc_id AS STRING)) AS object_id, concat('folder|d', CAST(doc_id AS STRING)) AS scoped_id
FROM documents WHERE doc_id % 7 <> 0
UNION ALL
SELECT concat('d', CAST(doc_id AS STRING)), concat('folder|d', CAST(doc_id + 1 AS STRING))
FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 5 = 0
""",
    "v_permissions": """
SELECT concat('folder|d', CAST(doc_id AS STRING)) AS scoped_id,
       CASE WHEN toxic = 1 THEN false WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 8 = 0 THEN false ELSE true END AS can_read,
       CASE WHEN doc_id % 13 = 0 THEN NULL ELSE concat('e', CAST(doc_id AS STRING)) END AS recorded_from_event
FROM labels
UNION ALL
SELECT concat('folder|gone', CAST(doc_id AS STRING)), false, NULL FROM labels WHERE doc_id % 20 = 0
""",
    "v_sync_events": """
SELECT event_id, 'folder' AS source, concat('u', CAST(user_id AS STRING)) AS object_id,
       CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'update' WHEN 'click' THEN 'update'
                       WHEN 'purchase' THEN 'permission_change' ELSE 'delete' END AS kind,
       CASE WHEN event_id % 29 = 0 THEN '' ELSE props END AS text,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE value > 10 END AS can_read,
       CASE WHEN event_type = 'error' THEN NULL ELSE CAST(event_id AS STRING) END AS cursor_value,
       concat('t', CAST(user_id % 3 AS STRING)) AS tenant_id, concat('s', CAST(user_id % 2 AS STRING)) AS silo_id,
       CASE WHEN event_id % 10 = 0 THEN 'failed' WHEN event_id % 10 < 3 THEN 'queued' ELSE 'processed' END AS status,
       event_id % 6 AS attempts, ts AS enqueued_at
FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 20 = 0) e
""",
    "v_activity": """
SELECT user_id, ts, event_id AS ord, CASE WHEN event_id % 10 = 0 THEN 'Other' ELSE 'Gemini Apps' END AS header,
       CASE WHEN event_id % 12 = 0 THEN 'Prompted  ' WHEN event_id % 5 = 0 THEN event_type
            ELSE concat('Prompted ', event_type, ' ', CAST(event_id AS STRING)) END AS title
FROM events
""",
    "v_signal_text": """
SELECT doc_id, concat(coalesce(text, ''), ' see https://ex', CAST(doc_id % 9 AS STRING), '.org/p on 2024-0', CAST(1 + doc_id % 9 AS STRING),
       '-1', CAST(doc_id % 10 AS STRING), ' file run_', CAST(doc_id % 21 AS STRING), '.py mail u', CAST(doc_id % 33 AS STRING), '@mail.example.com ',
       CASE doc_id % 9 WHEN 6 THEN 'Ruby on Rails, Next.js; by ada lovelace and Tim Berners-Lee' WHEN 7 THEN 'C#7 Ruby  on Rails C# REST-GraphQL FastAPI2 NoSQL [Source 99999999999999999999] [SOURCE  007]' WHEN 8 THEN 'GIT Kafka/iPhone macOS Elon Musk_ Bill Gates' WHEN 0 THEN 'we will use Python with Docker, Python?' WHEN 1 THEN 'need to learn React and react now' WHEN 2 THEN 'Google has Go. Good'
                       WHEN 3 THEN 'the oracle compiler docker docker [Source 1] [Source 3]' WHEN 4 THEN 'C++ C++x [source 2] [Source 2]' ELSE 'todo Élan pythonique' END) AS content
FROM documents
""",
    "v_citations": """
SELECT doc_id, k, CASE k WHEN 1 THEN '1' WHEN 2 THEN CASE doc_id % 4 WHEN 0 THEN 'two' WHEN 1 THEN NULL ELSE ' 02' END WHEN 3 THEN CASE WHEN doc_id % 3 = 0 THEN '3.0' ELSE '+7' END
  ELSE CASE WHEN doc_id % 2 = 0 THEN '99999999999999999999' ELSE '' END END AS source_index FROM documents CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) n
""",
    "v_chat": """
SELECT conv_id, msg_index, message_id, role, ord, tenant_id, silo_id, concat(content, CASE (conv_id * 3 + msg_index) % 14 WHEN 0 THEN ' python Docker, docker and Python? see https://ex.org/a%20b?x=<y>, www.site.net/z' WHEN 1 THEN ' next.js React_x react C++ C++11 on 2024-02-03 2024-02-04 or 03/04/2024x'
  WHEN 2 THEN ' about the Oracle Compiler and run.PY.txt, a-b.c.json util.hpp' WHEN 3 THEN ' made with the Oracle' WHEN 4 THEN ' Grace Hopper met Linus  Torvalds at IBM' WHEN 5 THEN ' mail a.b@c.example.org on 12-31-2023' WHEN 6 THEN ' kubernetes Kubernetes Élan élan pythonique aws'
  WHEN 7 THEN concat(' Ruby on Rails next.js! file_', CAST(conv_id AS STRING), '.yml') WHEN 8 THEN ' Tim Berners-Lee, Elon Musk. Meta metal' WHEN 9 THEN ' stripe stripe stripe vercel keyword keyword theme theme' ELSE '' END) AS content
FROM (SELECT conv_id, msg_index, message_id, role, ord, tenant_id, silo_id, CASE WHEN (conv_id * 3 + msg_index) % 14 = 4 THEN concat('compiler ', content) WHEN (conv_id * 3 + msg_index) % 14 = 13 THEN '' ELSE content END AS content FROM v_messages) m
""",
    "v_attachments": """
SELECT concat('a', CAST(page_id AS STRING)) AS attachment_id, CAST(floor(page_id / 3) AS BIGINT) AS conv_id, page_id AS ord, url,
       concat('f', CAST(page_id % 40 AS STRING), CASE page_id % 6 WHEN 0 THEN '.png' WHEN 1 THEN '.PDF' WHEN 2 THEN '.mp3' WHEN 3 THEN '.csv' WHEN 4 THEN '.exe' ELSE '' END) AS file_name,
       CASE WHEN page_id % 11 = 0 THEN 'image' ELSE 'unknown' END AS media_type
FROM pages
""",
    "v_constraints": """
SELECT l_orderkey AS query_id, l_linenumber AS span_no, 'returnflag' AS dimension_id,
       CASE WHEN l_linenumber = 6 THEN NULL ELSE l_returnflag END AS value_text, l_linenumber = 5 AS is_list
FROM lineitem
UNION ALL
SELECT l_orderkey, l_linenumber, 'linestatus', l_linestatus, false FROM lineitem WHERE l_linenumber <> 4
""",
    "v_envelopes": """
SELECT o_orderkey AS envelope_id, 1 + o_orderkey % 3 AS revision, 'returnflag' AS dimension_id,
       CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'P' THEN 'partially_resolved' ELSE 'missing' END AS status,
       CASE WHEN o_orderstatus = 'F' THEN 'A' END AS value_text
FROM orders
""",
    "v_answer_envelopes": """
SELECT concat('e', CAST(o_orderkey AS STRING)) AS envelope_id, o_orderkey AS query_id, CAST(1 + o_orderkey % 3 AS INTEGER) AS revision,
       CASE WHEN o_orderkey % 4 <> 0 THEN concat('snap-', CAST(o_orderkey AS STRING)) END AS evidence_set_ref FROM orders
UNION ALL SELECT concat('again', CAST(o_orderkey AS STRING)), o_orderkey, 1, NULL FROM orders WHERE o_orderkey % 6 = 0
""",
    "v_answer_parameters": """
SELECT concat('e', CAST(o_orderkey AS STRING)) AS envelope_id, 'returnflag' AS dimension_id,
       CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'P' THEN 'partially_resolved' ELSE 'missing' END AS status, CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'P' THEN 'R' END AS value,
       CASE WHEN o_orderkey % 5 = 0 THEN 'N' END AS assumption, CASE o_orderkey % 10 WHEN 0 THEN 'user' WHEN 5 THEN NULL ELSE 'evidence' END AS source
FROM orders WHERE o_orderkey % 11 <> 0
UNION ALL
SELECT concat('e', CAST(o_orderkey AS STRING)), 'linestatus', CASE o_orderkey % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'missing' WHEN 2 THEN 'partially_resolved' ELSE 'present' END,
       CASE o_orderkey % 4 WHEN 0 THEN 'O' WHEN 1 THEN NULL ELSE 'F' END, CASE WHEN o_orderkey % 9 = 0 THEN 'O' END, 'evidence'
FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0
UNION ALL
SELECT concat('e', CAST(o_orderkey AS STRING)), CASE WHEN o_orderpriority LIKE '1%' THEN 'priority' ELSE 'unregistered' END, CASE WHEN o_orderkey % 3 = 0 THEN 'unsupported' ELSE 'missing' END,
       CASE WHEN o_orderkey % 8 = 1 THEN 'high' END, NULL, NULL
FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderpriority < '3'
""",
    "v_dimensions": """
SELECT 'returnflag' AS dimension_id, '1' AS version, 'low' AS sensitivity, false AS can_be_assumed UNION ALL SELECT 'returnflag', '2', 'high', true
UNION ALL SELECT 'linestatus', '10', 'low', true UNION ALL SELECT 'linestatus', '9', 'high', false UNION ALL SELECT 'priority', '1', 'high', NULL
""",
    "v_domain_rules": """
SELECT 'returnflag' AS dimension_id, 'A' AS preferred, 'accepted returns lead' AS rationale UNION ALL SELECT 'priority', 'high', 'urgent leads'
""",
    "v_paths": """
SELECT concat('e', CAST(o_orderkey AS STRING)) AS envelope_id, 'priority' AS dimension_id FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT concat('e', CAST(o_orderkey AS STRING)), 'returnflag' FROM orders WHERE o_orderkey % 3 <> 0
UNION ALL SELECT concat('e', CAST(o_orderkey AS STRING)), 'unregistered' FROM orders WHERE o_orderkey % 5 <> 0
""",
}


def needed(sql: str) -> list[str]:
    """The views that a text uses, directly or through others, in the order in which they must be defined."""
    out: list[str] = []

    def add(text: str) -> None:
        for name in VIEWS:
            if name not in out and re.search(rf"\b{name}\b", text):
                add(VIEWS[name])
                out.append(name)

    add(sql)
    return out


def with_views(sql: str) -> str:
    """sql with the views it uses as common table expressions before it."""
    parts = ", ".join(f"{name} AS ({VIEWS[name]})" for name in needed(sql))
    if not parts:
        return sql
    body = sql.strip()
    return f"WITH {parts}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {parts} {body}"


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of sql over the tables of a folder."""
    text = with_views(sql)
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run_sql(spark, sf_dir, f"SELECT * FROM {name}")
