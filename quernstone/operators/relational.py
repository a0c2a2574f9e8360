"""Filters, joins, aggregates, windows, rankings and set operations over the knowledge tables."""

from __future__ import annotations

from ..plans.dialect import Dialect, Registry

R = Registry()

DENIED = "EXISTS (SELECT 1 FROM v_object_sources s JOIN v_permissions p ON p.scoped_id = s.scoped_id WHERE s.object_id = o.object_id AND p.can_read = false)"
KNOWN = "EXISTS (SELECT 1 FROM v_object_sources s JOIN v_permissions p ON p.scoped_id = s.scoped_id WHERE s.object_id = o.object_id)"
SOURCED = "EXISTS (SELECT 1 FROM v_object_sources s WHERE s.object_id = o.object_id)"
# Names of platforms as sources spell them, and as they are shown.
PLATFORMS = ("gemini", "chatgpt", "openai", "claude", "anthropic", "grok", "perplexity", "copilot")
NAMES = {"gemini": "Gemini", "chatgpt": "ChatGPT", "openai": "ChatGPT", "claude": "Claude", "anthropic": "Claude", "grok": "Grok", "perplexity": "Perplexity", "copilot": "Copilot"}
BARE = "replace(replace(replace(replace(content, ' ', ''), chr(9), ''), chr(10), ''), chr(13), '')"
SESSION_GAP_S = 1800
#: As in fn_candidates.
CANDIDATES = {"question": "[?][ ]*$", "decision": "(we will|decided|agreed)", "action": "(todo|need to|must|should)", "claim": "( is | are | was )"}


def platform(x: str, default: str) -> str:
    return "CASE " + " ".join(f"WHEN lower({x}) LIKE '%{p}%' THEN '{NAMES[p]}'" for p in PLATFORMS) + f" ELSE '{default}' END"


R.plain(
    flt_permissions_pilot=f"SELECT o.object_id, o.source_platform FROM v_objects o WHERE NOT {DENIED}",
    flt_permissions_strict=f"SELECT o.object_id, o.source_platform FROM v_objects o WHERE NOT {DENIED} AND ({KNOWN} OR NOT {SOURCED})",
    flt_tenant_silo="SELECT object_id, tenant_id, silo_id FROM v_objects WHERE tenant_id = 't1' AND silo_id = 's0'",
    flt_blank_messages=f"SELECT message_id, role, content FROM v_messages WHERE length({BARE}) > 0",
    prj_platform_from_source=f"SELECT conv_id, source, {platform('source', 'Unknown')} AS platform, {platform('source', 'Unmapped')} AS mapped FROM v_conversations",
    flt_browse_objects="SELECT object_id, title FROM v_objects WHERE (lower(title) LIKE '%the%' OR lower(content) LIKE '%the%' OR CAST(conversation_id AS STRING) LIKE '%the%') AND source_platform = 'src1'",
    flt_browse_attachments="SELECT attachment_id, file_name FROM v_attachments WHERE lower(file_name) LIKE '%f1%' OR lower(media_type) LIKE '%f1%'",
    flt_list_title="SELECT c.conv_id, c.title, t.total FROM v_conversations c CROSS JOIN (SELECT count(*) AS total FROM v_conversations WHERE lower(coalesce(title, '')) LIKE '%th%') t WHERE lower(coalesce(c.title, '')) LIKE '%th%'",
    prj_lineage_complete="SELECT object_id, coalesce(source_platform, '') <> '' AND coalesce(source_file, '') <> '' AND conversation_id IS NOT NULL AS complete FROM v_objects",
    chk_required_provenance="""
SELECT 'missing' AS violation, object_id AS subject FROM v_objects WHERE source_platform IS NULL OR source_file IS NULL OR tenant_id IS NULL OR silo_id IS NULL
UNION ALL SELECT 'duplicate', object_id FROM v_objects GROUP BY object_id HAVING count(*) > 1
UNION ALL SELECT 'mixed', CAST(n AS STRING) FROM (SELECT count(DISTINCT concat(tenant_id, '/', silo_id)) AS n FROM v_objects) t WHERE n > 1""",
    join_orphan_permissions="SELECT p.scoped_id FROM v_permissions p ANTI JOIN (SELECT DISTINCT scoped_id FROM v_object_sources) s ON s.scoped_id = p.scoped_id",
    join_unpermissioned=f"SELECT o.object_id FROM v_objects o WHERE {SOURCED} AND NOT {KNOWN}",
    join_attachments_per_conv="SELECT c.conv_id, count(a.attachment_id) AS n_attachments, min(a.file_name) AS first_name FROM v_conversations c LEFT JOIN v_attachments a ON a.conv_id = c.conv_id GROUP BY c.conv_id",
    join_semi_platform="SELECT a.attachment_id, a.file_name FROM v_attachments a SEMI JOIN (SELECT conv_id FROM v_conversations WHERE source_platform = 'Grok') c ON c.conv_id = a.conv_id",
    join_snapshot_diff="""
SELECT coalesce(n.path, p.path) AS path, CASE WHEN p.path IS NULL THEN 'create' WHEN n.path IS NULL THEN 'delete' ELSE 'update' END AS kind
FROM (SELECT doc_id AS path, CASE WHEN doc_id % 6 = 0 THEN 'old' ELSE lang END AS h FROM documents WHERE doc_id % 10 <> 1) p
FULL OUTER JOIN (SELECT doc_id AS path, lang AS h FROM documents WHERE doc_id % 10 <> 2) n ON p.path = n.path
WHERE p.path IS NULL OR n.path IS NULL OR p.h <> n.h""",
    join_constraint_target="""
SELECT c.query_id, c.span_no, c.dimension_id, c.value_text, e.status, e.value_text AS target
FROM v_constraints c JOIN v_envelopes e ON e.envelope_id = c.query_id AND e.dimension_id = c.dimension_id""",
    join_dim_latest="""
SELECT n.n_nationkey AS dimension_id, r.r_name AS package, v.version FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey
JOIN (SELECT c_nationkey, max(c_mktsegment) AS version FROM customer GROUP BY c_nationkey) v ON v.c_nationkey = n.n_nationkey""",
    join_ko_upsert="""
SELECT c.conv_id, coalesce(o.title, c.title) AS title, o.object_id IS NULL AS created
FROM v_conversations c LEFT JOIN (SELECT conversation_id, min(object_id) AS object_id, min(title) AS title FROM v_objects WHERE conversation_id % 3 <> 0 GROUP BY conversation_id) o ON o.conversation_id = c.conv_id""",
    agg_inventory_totals="SELECT count(DISTINCT conv_id) AS conversations, count(*) AS messages FROM v_messages",
    agg_platform_summary="""
SELECT c.source_platform, count(*) AS conversations, CAST(sum(m.n) AS BIGINT) AS messages, CAST(sum(coalesce(a.n, 0)) AS BIGINT) AS attachments, min(c.created) AS first_created, max(c.created) AS last_created
FROM v_conversations c JOIN (SELECT conv_id, count(*) AS n FROM v_messages GROUP BY conv_id) m ON m.conv_id = c.conv_id
LEFT JOIN (SELECT conv_id, count(*) AS n FROM v_attachments GROUP BY conv_id) a ON a.conv_id = c.conv_id GROUP BY c.source_platform""",
    agg_provenance_ledger="SELECT tenant_id, silo_id, count(*) AS objects, CAST(sum(CASE WHEN source_platform IS NULL OR source_file IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS incomplete FROM v_objects GROUP BY tenant_id, silo_id",
    agg_permission_stats="""
SELECT count(*) AS entries, CAST(sum(CASE WHEN can_read = false THEN 1 ELSE 0 END) AS BIGINT) AS denies, CAST(sum(CASE WHEN recorded_from_event IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS with_event,
       CAST(sum(CASE WHEN recorded_from_event IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS without_event FROM v_permissions""",
    agg_conflicts="SELECT query_id, dimension_id, count(DISTINCT value_text) AS n_values FROM v_constraints WHERE NOT is_list AND value_text IS NOT NULL GROUP BY query_id, dimension_id HAVING count(DISTINCT value_text) > 1",
    agg_dashboard=f"""
SELECT (SELECT count(*) FROM v_conversations) AS conversations, (SELECT count(*) FROM v_messages) AS messages, (SELECT count(*) FROM v_attachments) AS attachments,
       (SELECT count(*) FROM v_objects o WHERE NOT {DENIED}) AS objects""",
    win_message_order="SELECT message_id, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(nullif(msg_index, 3), 0), ord) AS place FROM v_messages",
    win_evidence_ids=f"SELECT message_id, concat('ev_', CAST(row_number() OVER (PARTITION BY conv_id ORDER BY ord) AS STRING)) AS evidence_id FROM v_messages WHERE length({BARE}) > 0",
    win_first_wins="SELECT object_id, source_platform FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY again, ord) AS n FROM (SELECT object_id, ord, source_platform, 0 AS again FROM v_objects UNION ALL SELECT object_id, ord, 'again', 1 FROM v_objects WHERE ord % 3 = 0) u) t WHERE n = 1",
    win_last_wins="SELECT object_id, kind, event_id FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY event_id DESC) AS n FROM v_sync_events WHERE kind IN ('create', 'update')) t WHERE n = 1",
    win_attachment_dedup="SELECT attachment_id FROM (SELECT attachment_id, row_number() OVER (PARTITION BY conv_id, file_name ORDER BY ord) AS n FROM v_attachments) t WHERE n = 1",
    top_conversations="SELECT conv_id, CAST(sum(length(content)) AS BIGINT) AS chars FROM v_messages GROUP BY conv_id ORDER BY chars DESC, conv_id LIMIT 10",
    page_slice="SELECT p.conv_id, p.title, t.total FROM (SELECT conv_id, title FROM v_conversations ORDER BY ord LIMIT 20 OFFSET 20) p CROSS JOIN (SELECT count(*) AS total FROM v_conversations) t",
    top_ready_event="SELECT object_id, event_id FROM (SELECT object_id, event_id, row_number() OVER (PARTITION BY object_id ORDER BY enqueued_at, event_id) AS n FROM v_sync_events WHERE status = 'queued' AND attempts < 5) t WHERE n = 1",
    set_edges_union="""
SELECT 'sourced_from' AS type, object_id AS a, CAST(conversation_id AS STRING) AS b, 'conversation' AS b_kind FROM v_objects
UNION ALL SELECT 'sourced_from', concat('c', CAST(conv_id AS STRING)), message_id, 'message' FROM v_messages
UNION ALL SELECT 'attached_to', attachment_id, CAST(conv_id AS STRING), 'attachment' FROM v_attachments""",
    set_except_assigned="SELECT conv_id FROM v_conversations EXCEPT SELECT conv_id FROM v_attachments",
    set_event_union="SELECT event_id, kind FROM v_sync_events WHERE kind IN ('create', 'update') UNION ALL SELECT event_id, kind FROM v_sync_events WHERE kind = 'delete'",
    ctx_classify="""
SELECT c.query_id, c.span_no, c.dimension_id,
       CASE WHEN c.value_text IS NULL THEN 'unconstrained' WHEN c.value_text = e.value_text AND NOT c.is_list THEN 'fully' WHEN c.value_text = e.value_text THEN 'partially' ELSE 'incompatible' END AS class
FROM v_constraints c JOIN v_envelopes e ON e.envelope_id = c.query_id AND e.dimension_id = c.dimension_id WHERE e.value_text IS NOT NULL""",
    ctx_conflicts="""
SELECT c.query_id, c.dimension_id, count(DISTINCT c.value_text) AS n_values FROM v_constraints c JOIN v_envelopes e ON e.envelope_id = c.query_id AND e.dimension_id = c.dimension_id
WHERE NOT c.is_list AND c.value_text IS NOT NULL GROUP BY c.query_id, c.dimension_id HAVING count(DISTINCT c.value_text) > 1""",
)


@R.add("win_candidate_cap")
def _(d: Dialect) -> str:
    """At most 50 candidates of a kind in a conversation, whose messages are its spans."""
    found = " UNION ALL ".join(f"SELECT conv_id, ord, message_id, '{k}' AS kind FROM v_messages WHERE {d.has('lower(content)', p)}" for k, p in CANDIDATES.items())
    return f"SELECT conv_id, kind, message_id FROM (SELECT conv_id, kind, message_id, row_number() OVER (PARTITION BY conv_id, kind ORDER BY ord) AS n FROM ({found}) c) t WHERE n <= 50"


@R.add("flt_permissions_legacy")
def _(d: Dialect) -> str:
    return f"""
SELECT c.conv_id FROM v_conversations c WHERE NOT EXISTS
(SELECT 1 FROM v_permissions p WHERE p.can_read = false AND {d.replaced('p.scoped_id', '^folder[|]d', '')} = CAST(c.conv_id AS {d.text}))"""


@R.add("prj_strip_prompt_prefix")
def _(d: Dialect) -> str:
    body = d.strip(f"regexp_replace(title, {d.pattern('^Prompted ')}, '')")
    return f"SELECT ord, prompt FROM (SELECT ord, {body} AS prompt FROM v_activity) t WHERE prompt <> ''"


@R.add("agg_inventory")
def _(d: Dialect) -> str:
    first = "min_by(CASE WHEN role = 'user' THEN substring(content, 1, 200) END, CASE WHEN role = 'user' THEN msg_index END)" if d.spark else "arg_min(CASE WHEN role = 'user' THEN substring(content, 1, 200) END, CASE WHEN role = 'user' THEN msg_index END)"
    return f"SELECT conv_id, count(*) AS messages, CAST(sum(length(content)) AS BIGINT) AS chars, CAST(floor(sum(length(content)) / 4) AS BIGINT) AS tokens, {first} AS first_user FROM v_messages GROUP BY conv_id"


def fingerprints(d: Dialect) -> str:
    said = f"concat(lower({d.strip('role')}), chr(58), {d.normalized('content')})"
    return f"SELECT conv_id, min(ord) AS ord, {d.sha(d.joined(said, 'ord', chr(10)))} AS fingerprint FROM v_messages WHERE length({BARE}) > 0 GROUP BY conv_id"


@R.add("fn_content_fingerprint")
def _(d: Dialect) -> str:
    return fingerprints(d)


@R.add("agg_fingerprint_groups")
def _(d: Dialect) -> str:
    """A row for each conversation of a group of equal content, with the group's first and its size, so that no group is one value."""
    if d.spark:
        groups = f"SELECT fingerprint, min_by(conv_id, ord) AS canonical, count(*) AS n FROM ({fingerprints(d)}) g0 GROUP BY fingerprint"
        return f"SELECT /*+ MERGE(g) */ f.fingerprint, g.canonical, f.conv_id AS alias, g.n FROM ({fingerprints(d)}) f JOIN ({groups}) g ON g.fingerprint = f.fingerprint"
    return f"SELECT fingerprint, first_value(conv_id) OVER (PARTITION BY fingerprint ORDER BY ord) AS canonical, conv_id AS alias, count(*) OVER (PARTITION BY fingerprint) AS n FROM ({fingerprints(d)}) f"


@R.add("win_canonical")
def _(d: Dialect) -> str:
    return f"SELECT conv_id, first_value(conv_id) OVER (PARTITION BY fingerprint ORDER BY ord) AS canonical, CASE WHEN row_number() OVER (PARTITION BY fingerprint ORDER BY ord) = 1 THEN 'canonical' ELSE 'duplicate_same_content' END AS identity FROM ({fingerprints(d)}) f"


@R.add("agg_content_bundle")
def _(d: Dialect) -> str:
    return f"SELECT conv_id, {d.sha(d.joined('content', 'ord', '##'))} AS bundle FROM v_messages GROUP BY conv_id"


def sessions(d: Dialect) -> str:
    t = d.micros("ts")
    return f"""SELECT user_id, ts, ord, title, header, sum(opens) OVER (PARTITION BY user_id ORDER BY t, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session
FROM (SELECT *, {t} AS t, CASE WHEN {t} - lag({t}) OVER (PARTITION BY user_id ORDER BY {t}, ord) <= {SESSION_GAP_S * 1_000_000} THEN 0 ELSE 1 END AS opens FROM v_activity) s"""


@R.add("win_sessionize")
def _(d: Dialect) -> str:
    return f"SELECT user_id, ord, CAST(session AS BIGINT) AS session FROM ({sessions(d)}) x"


@R.add("win_session_summary")
def _(d: Dialect) -> str:
    pick = "min_by" if d.spark else "arg_min"
    return f"SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS records, {pick}(title, ord) AS title, CAST(sum(CASE WHEN header <> 'Other' THEN 1 ELSE 0 END) AS BIGINT) AS messages FROM ({sessions(d)}) x GROUP BY user_id, session HAVING sum(CASE WHEN header <> 'Other' THEN 1 ELSE 0 END) > 0"


@R.add("join_attachment_route")
def _(d: Dialect) -> str:
    ext = f"lower({d.first('file_name', '[.][A-Za-z0-9]+$')})"
    return f"""
SELECT attachment_id, ext, CASE WHEN ext = '.png' THEN 'image' WHEN ext = '.pdf' THEN 'pdf' WHEN ext = '.mp3' THEN 'audio' WHEN ext = '.csv' THEN 'table' WHEN media_type = 'image' THEN 'image' ELSE 'unsupported' END AS processor
FROM (SELECT attachment_id, media_type, {ext} AS ext FROM v_attachments) a"""


@R.add("agg_import_manifest")
def _(d: Dialect) -> str:
    return f"SELECT header, count(*) AS records, count(DISTINCT user_id) AS conversations, CAST(sum(CASE WHEN {d.strip(f'regexp_replace(title, {d.pattern("^Prompted ")}, {chr(39) * 2})')} = '' THEN 1 ELSE 0 END) AS BIGINT) AS warnings FROM v_activity GROUP BY header"


@R.add("agg_root_manifest")
def _(d: Dialect) -> str:
    """Platforms and the whole, without the conversations that a permission denies."""
    seen = f"SELECT source_platform FROM v_conversations WHERE conv_id IN ({R['flt_permissions_legacy'](d)})"
    if d.spark:
        return f"SELECT source_platform, count(*) AS conversations, CAST(grouping(source_platform) AS INT) AS is_total FROM ({seen}) v GROUP BY ROLLUP (source_platform)"
    return f"SELECT source_platform, count(*) AS conversations, 0 AS is_total FROM ({seen}) v GROUP BY source_platform UNION ALL SELECT NULL, count(*), 1 FROM ({seen}) v"
