"""Context for answers: numbered source blocks of the best hits, and the best chunks by hybrid score."""

from __future__ import annotations

from ..plans.dialect import Dialect, Registry
from .search import hybrid, overlaps

R = Registry()
SOURCES, BODY = 6, 1500
#: Fixed value: the answer where nothing is known.
REFUSAL = "I do not have sufficient evidence in the compiled knowledge to answer this question."


@R.add("qry_grounded_context")
def _(d: Dialect) -> str:
    """The first hits of each request as source blocks. A hit without a body is left out, and its number stays free."""
    hits = f"SELECT item_id, object_id, place FROM (SELECT item_id, object_id, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, ord) AS place FROM ({overlaps(d)}) s) t WHERE place <= {SOURCES}"
    body = f"CASE WHEN length(o.content) > {BODY} THEN concat(substring(o.content, 1, {BODY}), '... [truncated]') ELSE o.content END"
    block = f"""concat('[Source ', CAST(h.place AS {d.text}), ': "', coalesce(nullif(o.title, ''), o.object_id), '" (', coalesce(o.source_platform, 'Unknown'), ') - ID: ', o.object_id, ']', chr(10), {body})"""
    blocks = f"SELECT h.item_id, h.place, {block} AS block FROM ({hits}) h JOIN v_objects o ON o.object_id = h.object_id WHERE coalesce(o.content, '') <> ''"
    each = f"SELECT item_id, count(*) AS n_sources, max(place) AS last_source, {d.sha(d.joined('block', 'place', '---'))} AS context FROM ({blocks}) k GROUP BY item_id"
    return f"SELECT b.item_id, coalesce(c.n_sources, 0) AS n_sources, c.last_source, coalesce(c.context, '{REFUSAL}') AS context FROM benchmark b LEFT JOIN ({each}) c ON c.item_id = b.item_id"


@R.add("top_hybrid")
def _(d: Dialect) -> str:
    return f"SELECT item_id, object_id, k, place FROM (SELECT item_id, object_id, k, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, ord, k) AS place FROM ({hybrid(d)}) s) t WHERE place <= 3"
