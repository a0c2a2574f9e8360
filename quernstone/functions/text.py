"""Scalar functions over texts, names, identities and JSON."""

from __future__ import annotations

from ..plans.dialect import Dialect, Registry

R = Registry()

#: Words that begin a title shaped like a conversation.
SHAPES = ("how", "what", "why", "when", "where", "who", "can", "could", "would", "should", "is", "are", "do", "does", "did", "hey", "okay", "ok")

R.plain(
    fn_scoped_id="SELECT event_id, concat(source, '|', tenant_id, '|', silo_id, '|', object_id) AS scoped_id FROM v_sync_events",
    fn_snippet="SELECT doc_id, length(CASE WHEN length(text) > 1500 THEN concat(substring(text, 1, 1500), '... [truncated]') ELSE text END) AS body_chars, substring(text, 1, 180) AS snippet FROM documents",
    fn_backoff="SELECT event_id, attempts, CASE WHEN attempts >= 5 THEN 'failed' ELSE 'queued' END AS status, CAST(least(power(2, attempts), 300) AS BIGINT) AS delay_s FROM v_sync_events",
    fn_search_text="SELECT object_id, length(concat(coalesce(title, ''), ' ', coalesce(content, ''))) AS chars FROM v_objects",
    fn_attachment_tasks="SELECT attachment_id, coalesce(nullif(file_name, ''), 'unnamed') AS name, coalesce(nullif(url, ''), file_name) AS url FROM v_attachments",
)


@R.add("fn_normalize_text")
def _(d: Dialect) -> str:
    return f"SELECT doc_id, {d.sha(d.normalized('text'))} AS normalized FROM documents"


@R.add("fn_words")
def _(d: Dialect) -> str:
    return f"SELECT message_id, {d.size}({d.words('content')}) AS n_words FROM v_messages"


@R.add("fn_token_set")
def _(d: Dialect) -> str:
    return f"SELECT object_id, {d.size}({d.tokens('content')}) AS n_tokens FROM v_objects"


@R.add("fn_candidates")
def _(d: Dialect) -> str:
    x = "lower(content)"
    return f"""
SELECT doc_id, {d.has('content', '[?][ ]*$')} AS question, {d.has(x, '(we will|decided|agreed)')} AS decision, {d.has(x, '(todo|need to|must|should)')} AS action, {d.has(x, '( is | are | was )')} AS claim FROM v_signal_text"""


def judged(d: Dialect) -> str:
    """Objects with what speaks against keeping them: a title shaped like a conversation, hardly any text, no source that stands for them."""
    if d.spark:
        starts = " OR ".join(f"t LIKE '{p} %'" for p in SHAPES)
        words = f"size({d.matches('t', r'[^\x09-\x0D\x20]+')})"
        shaped = f"t = '' OR t LIKE '%?' OR {starts} OR {words} > 12"
        title, body = f"lower({d.strip("coalesce(title, '')")})", f"length({d.strip("coalesce(content, '')")})"
        sourced = "SELECT /*+ MERGE(s) */ o.*, s.object_id IS NULL AS missing_evidence FROM v_objects o LEFT JOIN (SELECT DISTINCT object_id FROM v_object_sources) s ON s.object_id = o.object_id"
    else:
        blanks = "' ' || " + " || ".join(f"chr({c})" for c in (9, 10, 11, 12, 13, 28, 29, 30, 31))
        shaped = f"t = '' OR t[-1] = '?' OR list_contains([{', '.join(f"'{p}'" for p in SHAPES)}], CASE WHEN contains(t, ' ') THEN split_part(t, ' ', 1) ELSE '' END) OR len(list_filter(regexp_split_to_array(t, '[\\t-\\r ]+'), lambda w: w <> '')) > 12"
        title, body = f"lower(trim(coalesce(title, ''), {blanks}))", f"length(trim(coalesce(content, ''), {blanks}))"
        sourced = "SELECT o.*, o.object_id NOT IN (SELECT object_id FROM v_object_sources) AS missing_evidence FROM v_objects o"
    return f"SELECT object_id, tenant_id, {shaped} AS shaped, n < 80 AS thin, missing_evidence FROM (SELECT object_id, tenant_id, missing_evidence, {title} AS t, {body} AS n FROM ({sourced}) o1) o2"


@R.add("fn_conversation_shaped")
def _(d: Dialect) -> str:
    return f"SELECT object_id, shaped FROM ({judged(d)}) j"


@R.add("fn_quality_flags")
def _(d: Dialect) -> str:
    return f"SELECT object_id, shaped, thin, missing_evidence, NOT shaped AND NOT thin AND NOT missing_evidence AS reusable_candidate FROM ({judged(d)}) j"


@R.add("agg_quality_report")
def _(d: Dialect) -> str:
    """A row for each flagged object, and one without an id for each tenant, with all and flagged objects."""
    flags = "SELECT object_id, tenant_id, shaped, thin, missing_evidence, CAST(NULL AS BIGINT) AS total, CAST(NULL AS BIGINT) AS flagged"
    return f"{flags} FROM ({judged(d)}) j WHERE shaped OR thin UNION ALL SELECT NULL, tenant_id, NULL, NULL, NULL, count(*), CAST(sum(CASE WHEN shaped OR thin THEN 1 ELSE 0 END) AS BIGINT) FROM ({judged(d)}) k GROUP BY tenant_id"


@R.add("fn_sanitize_name")
def _(d: Dialect) -> str:
    clean = d.replaced(d.replaced("lower(p_name)", "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return f"SELECT p_partkey, coalesce(nullif({clean}, ''), 'topic') AS name FROM part"


@R.add("fn_render_markdown")
def _(d: Dialect) -> str:
    line = "concat('- **', role, '** ', content)"
    return f"SELECT conv_id, {d.sha(d.joined(line, 'ord', chr(10)))} AS document FROM v_messages GROUP BY conv_id"


@R.add("src_detect_platform")
def _(d: Dialect) -> str:
    name = f"lower({d.first('url', '([^/]+)$', 1)})"
    return f"""
SELECT page_id, CASE WHEN name LIKE '%myactivity%' THEN 'gemini' WHEN name LIKE '%grok%' THEN 'grok' WHEN name LIKE 'conversations-%' THEN 'chatgpt'
WHEN substring(html, 1, 8192) LIKE '%Gemini Apps%' THEN 'gemini' WHEN substring(html, 1, 2000) LIKE '%conversation_id%' THEN 'chatgpt' WHEN substring(html, 1, 2000) LIKE '%conversations%' THEN 'grok' ELSE 'unknown' END AS platform
FROM (SELECT page_id, html, {name} AS name FROM pages) p"""
