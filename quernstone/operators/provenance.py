"""Lineage of objects: gaps are filled from the object's own fields, its conversation, messages and attachments, and told apart from what is whole."""

from __future__ import annotations

from ..plans.dialect import Dialect, Registry

R = Registry()

REQUIRED = ("source_platform", "source_file", "conversation_id")

#: Objects with their lineage under several keys, some empty: p_ is the provenance record, f_ the object's own field.
GIVEN = """
SELECT object_id, ord, nullif(source_platform, '') AS f_platform, CASE WHEN ord % 4 = 0 THEN nullif(source_platform, '') WHEN ord % 4 = 1 THEN '' END AS p_platform, source_file AS f_file, CASE WHEN ord % 5 < 2 THEN source_file END AS p_file,
       CASE WHEN ord % 6 = 0 THEN CAST(conversation_id AS STRING) WHEN ord % 6 = 1 THEN '' END AS p_conversation_id, CASE WHEN ord % 6 = 1 THEN CAST(conversation_id AS STRING) END AS p_conversation_camel, CASE WHEN ord % 6 = 2 THEN CAST(conversation_id AS STRING) END AS p_conversation,
       CASE WHEN ord % 6 = 3 THEN CAST(conversation_id AS STRING) WHEN ord % 6 = 0 AND ord % 4 = 2 THEN 'old' END AS f_conversation, CASE WHEN ord % 6 = 4 THEN CAST(conversation_id AS STRING) ELSE object_id END AS own_id,
       CASE WHEN ord % 3 = 0 THEN '2023-12-31' END AS p_imported, CASE WHEN ord % 7 = 0 THEN '1.0' END AS p_schema, CASE WHEN ord % 8 = 0 THEN 1 ELSE 0 END AS p_messages, CASE WHEN ord % 9 = 0 THEN 1 ELSE 0 END AS p_attachments, CASE WHEN ord % 2 = 0 THEN 'note' END AS p_type
FROM v_objects"""
CONVERSATIONS = "SELECT CAST(conv_id AS STRING) AS cid, nullif(source_platform, '') AS c_platform, source AS c_file, CASE WHEN conv_id % 3 <> 0 THEN created END AS c_imported, CASE WHEN conv_id % 4 <> 0 THEN '2.0' END AS c_schema FROM v_conversations"


def repaired(d: Dialect) -> str:
    """object_id, the eight fields, status and missing. A conversation is named by one of three keys of the record, else by the object's field,
    else by the object's own id where a conversation has it; all keys are tried in one pass."""
    merge = lambda *names: f"/*+ MERGE({', '.join(names)}) */ " if d.spark else ""
    named = f"SELECT *, coalesce(nullif(p_conversation_id, ''), nullif(p_conversation_camel, ''), nullif(p_conversation, ''), nullif(f_conversation, '')) AS told FROM ({GIVEN}) g"
    found = f"SELECT {merge('k')}n.*, coalesce(n.told, k.cid) AS conv FROM ({named}) n LEFT JOIN (SELECT CAST(conv_id AS STRING) AS cid FROM v_conversations) k ON n.told IS NULL AND k.cid = n.own_id"
    messages = "SELECT CAST(conv_id AS STRING) AS mid, count(*) AS n_messages, min(message_id) AS first_message FROM v_messages GROUP BY CAST(conv_id AS STRING)"
    attachments = "SELECT CAST(conv_id AS STRING) AS aid, count(*) AS n_attachments FROM v_attachments GROUP BY CAST(conv_id AS STRING)"
    filled = f"""
SELECT {merge('c', 'm', 'a')}o.*, coalesce(nullif(o.p_platform, ''), o.f_platform, c.c_platform) AS source_platform, coalesce(nullif(o.p_file, ''), nullif(o.f_file, ''), c.c_file) AS source_file, o.conv AS conversation_id,
       coalesce(o.p_imported, c.c_imported) AS imported_at, coalesce(o.p_schema, c.c_schema) AS schema_version, CASE WHEN o.p_messages = 1 THEN 1 ELSE coalesce(m.n_messages, 0) END AS n_messages,
       CASE WHEN o.p_attachments = 1 THEN 1 ELSE coalesce(a.n_attachments, 0) END AS n_attachments, coalesce(o.p_type, 'knowledge_object') AS object_type
FROM ({found}) o LEFT JOIN ({CONVERSATIONS}) c ON c.cid = o.conv LEFT JOIN ({messages}) m ON m.mid = o.conv LEFT JOIN ({attachments}) a ON a.aid = o.conv"""
    lost = f"concat_ws(',', {', '.join(f"CASE WHEN {k} IS NULL THEN '{k}' END" for k in REQUIRED)})"
    same = " AND ".join((
        "source_platform IS NOT DISTINCT FROM nullif(p_platform, '')", "source_platform IS NOT DISTINCT FROM f_platform", "source_file IS NOT DISTINCT FROM nullif(p_file, '')", "source_file IS NOT DISTINCT FROM nullif(f_file, '')",
        "conversation_id IS NOT DISTINCT FROM nullif(p_conversation_id, '')", "conversation_id IS NOT DISTINCT FROM f_conversation", "imported_at IS NOT DISTINCT FROM p_imported", "schema_version IS NOT DISTINCT FROM p_schema",
        "n_messages = p_messages", "n_attachments = p_attachments", "p_type IS NOT NULL",
    ))
    return f"SELECT object_id, source_platform, source_file, conversation_id, imported_at, schema_version, n_messages, n_attachments, object_type, CASE WHEN {lost} <> '' THEN 'failed' WHEN {same} THEN 'ok' ELSE 'repaired' END AS status, {lost} AS missing FROM ({filled}) f"


@R.add("join_provenance_repair")
def _(d: Dialect) -> str:
    return repaired(d)


@R.add("agg_provenance_report")
def _(d: Dialect) -> str:
    """Objects by status and missing keys; the whole in the row without a status."""
    return f"SELECT status, missing, count(*) AS n FROM ({repaired(d)}) r GROUP BY GROUPING SETS ((status, missing), ())"
