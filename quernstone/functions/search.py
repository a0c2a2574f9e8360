"""Retrieval and ranking: token overlap, lexical, vector, hybrid and weighted scores.

Requests meet objects over shared tokens, an equi-join, never as all pairs; in overlap scores, objects that share no token score 0 anyway."""

from __future__ import annotations

from ..operators.relational import DENIED
from ..plans.dialect import Dialect, Registry

R = Registry()
TOP = 5
#: Vectors whose id EVERY divides are queries.
EVERY = 50


def request_tokens(d: Dialect) -> str:
    return f"SELECT item_id, tenant_id, silo_id, {d.each}(tokens) AS token, {d.size}(tokens) AS n FROM (SELECT item_id, concat('t', CAST(item_id % 3 AS STRING)) AS tenant_id, concat('s', CAST(item_id % 2 AS STRING)) AS silo_id, {d.tokens('text')} AS tokens FROM benchmark) b"


def object_tokens(d: Dialect) -> str:
    return f"SELECT object_id, ord, tenant_id, silo_id, {d.each}({d.tokens('content')}) AS token FROM v_objects o WHERE NOT {DENIED}"


def overlaps(d: Dialect) -> str:
    return f"""
SELECT r.item_id, o.object_id, o.ord, count(*) AS shared, max(r.n) AS asked FROM ({request_tokens(d)}) r
JOIN ({object_tokens(d)}) o ON o.token = r.token AND o.tenant_id = r.tenant_id AND o.silo_id = r.silo_id GROUP BY r.item_id, o.object_id, o.ord"""


@R.add("qry_overlap_retrieval")
def _(d: Dialect) -> str:
    return f"SELECT item_id, object_id, shared, place FROM (SELECT item_id, object_id, shared, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, ord) AS place FROM ({overlaps(d)}) s WHERE 10 * shared >= asked) t WHERE place <= {TOP}"


@R.add("top_retrieval")
def _(d: Dialect) -> str:
    return f"SELECT item_id, object_id, place FROM (SELECT item_id, object_id, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, ord) AS place FROM ({overlaps(d)}) s) t WHERE place <= {TOP}"


@R.add("qry_governed_context")
def _(d: Dialect) -> str:
    return f"SELECT t.item_id, t.object_id, v.source_platform IS NOT NULL AND v.source_file IS NOT NULL AS provenance_complete FROM (SELECT item_id, object_id, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, ord) AS place FROM ({overlaps(d)}) s) t JOIN v_objects v ON v.object_id = t.object_id WHERE place <= {TOP}"


@R.add("set_intersect_tokens")
def _(d: Dialect) -> str:
    return f"SELECT item_id, object_id, shared FROM ({overlaps(d)}) s WHERE 2 * shared >= asked"


@R.add("qry_cosine")
def _(d: Dialect) -> str:
    """The check of nearest(): every vector whose id is divisible by 50 against all."""
    cosine = "list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])))"
    return f"SELECT query_id, vec_id, place FROM (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({cosine}, 6) DESC, e.vec_id) AS place FROM embeddings e JOIN (SELECT * FROM embeddings WHERE vec_id % {EVERY} = 0) q ON q.vec_id <> e.vec_id) t WHERE place <= {TOP}"


def code_points(d: Dialect, x: str) -> str:
    if d.spark:
        return f"aggregate(split({x}, ''), CAST(0 AS BIGINT), (s, c) -> s + ascii(c))"
    return f"coalesce(list_sum(list_transform(string_split({x}, ''), lambda c: unicode(c)))::BIGINT, 0)"


@R.add("qry_lexical_score")
def _(d: Dialect) -> str:
    terms = d.matches("lower(text)", "[^ ]+")
    return f"""
SELECT q.item_id, o.doc_id, CAST(sum(o.n) AS BIGINT) AS hits FROM (SELECT DISTINCT item_id, {d.each}({terms}) AS term FROM benchmark) q
JOIN (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, {d.each}({terms}) AS term FROM documents) t GROUP BY doc_id, term) o ON o.term = q.term GROUP BY q.item_id, o.doc_id"""


def chunks(d: Dialect, size: int = 500, overlap: int = 100) -> str:
    """Word chunks with overlap: as many starts, a step apart, as the text needs to reach its last word."""
    step = size - overlap
    words = d.matches("content", r"[^\x09-\x0D\x20]+")
    last = f"CAST(greatest(0, ceil((n - {size}) / CAST({step} AS DOUBLE))) AS INT)"
    numbers = f"sequence(0, {last})" if d.spark else f"generate_series(0, {last})"
    piece = f"array_join(slice(w, CAST(k * {step} + 1 AS INT), {size}), ' ')" if d.spark else f"array_to_string(list_slice(w, k * {step} + 1, k * {step} + {size}), ' ')"
    return f"SELECT object_id, ord, tenant_id, silo_id, source_platform, CAST(k AS INT) AS k, {piece} AS body FROM (SELECT *, {d.each}({numbers}) AS k FROM (SELECT *, {d.size}(w) AS n FROM (SELECT object_id, ord, tenant_id, silo_id, source_platform, {words} AS w FROM v_objects) a) b WHERE n > 0) c"


@R.add("fn_word_chunks")
def _(d: Dialect) -> str:
    return f"SELECT concat(object_id, '_chunk_', CAST(k AS STRING)) AS chunk_id, {d.sha('body')} AS body FROM ({chunks(d)}) c"


def hybrid(d: Dialect) -> str:
    """0.6 cosine + 0.4 lexical share. With all 128 components an arithmetic sequence from v, the cosine has a closed form:
    sums of v, of squares and of products of 0.01 i over i < 128. Not every chunk is scored, but none of the first TOP of a request is
    left out: a chunk that shares no term comes after TOP others of its scope that have as high a cosine or stand before it."""
    dot = lambda a, b: f"(128 * {a} * {b} + 81.28 * ({a} + {b}) + 69.088)"
    level = lambda x: f"(({code_points(d, x)}) % 100) / 100.0"
    terms = lambda x: d.matches(f"lower({x})", r"[^\x09-\x0D\x20]+")
    q = f"SELECT item_id, concat('t', CAST(item_id % 3 AS STRING)) AS tenant_id, concat('s', CAST(item_id % 2 AS STRING)) AS silo_id, CAST({level('text')} AS DOUBLE) AS v, {d.distinct}({terms('text')}) AS terms FROM benchmark"
    c = f"SELECT *, CAST({level('body')} AS DOUBLE) AS v, {terms('body')} AS words FROM ({chunks(d)}) c0"
    hits = f"SELECT c.object_id, c.k, q.item_id, count(*) AS hits FROM (SELECT object_id, k, tenant_id, silo_id, {d.each}(words) AS term FROM ({c}) c1) c JOIN (SELECT item_id, tenant_id, silo_id, {d.each}(terms) AS term FROM ({q}) q1) q ON q.term = c.term AND q.tenant_id = c.tenant_id AND q.silo_id = c.silo_id GROUP BY c.object_id, c.k, q.item_id"
    cosine = f"{dot('q.v', 'c.v')} / (sqrt({dot('q.v', 'q.v')}) * sqrt({dot('c.v', 'c.v')}))"
    shown = f"q.item_id, c.object_id, c.ord, c.k, round(0.6 * CAST({cosine} AS DOUBLE) + 0.4 * coalesce(h.hits, 0) / {d.size}(c.words), 4) AS score, CASE WHEN c.source_platform IS NOT NULL THEN 0.95 ELSE 0.7 END AS confidence"
    if not d.spark:
        # The check scores every chunk in scope.
        return f"SELECT {shown} FROM ({c}) c JOIN ({q}) q ON q.tenant_id = c.tenant_id AND q.silo_id = c.silo_id LEFT JOIN ({hits}) h ON h.object_id = c.object_id AND h.k = c.k AND h.item_id = q.item_id"
    # Chunks without a shared term: in each scope, the first of each level, and of these the best for each level asked for.
    leveled = f"SELECT object_id, ord, k, tenant_id, silo_id, CAST({level('body')} AS DOUBLE) AS v FROM ({chunks(d)}) c2"
    early = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, silo_id, v ORDER BY ord, k) AS early FROM ({leveled}) c3) c4 WHERE early <= {TOP}"
    near = f"SELECT * FROM (SELECT q.tenant_id, q.silo_id, q.v, c.object_id, c.k, row_number() OVER (PARTITION BY q.tenant_id, q.silo_id, q.v ORDER BY round(0.6 * CAST({cosine} AS DOUBLE), 4) DESC, c.ord, c.k) AS near FROM ({early}) c JOIN (SELECT DISTINCT tenant_id, silo_id, v FROM ({q}) q2) q ON q.tenant_id = c.tenant_id AND q.silo_id = c.silo_id) c5 WHERE near <= {TOP}"
    found = f"SELECT object_id, k, item_id, max(hits) AS hits FROM ({hits} UNION ALL SELECT n.object_id, n.k, q.item_id, 0 FROM ({near}) n JOIN ({q}) q ON q.tenant_id = n.tenant_id AND q.silo_id = n.silo_id AND q.v = n.v) u GROUP BY object_id, k, item_id"
    return f"SELECT {shown} FROM ({found}) h JOIN ({c}) c ON c.object_id = h.object_id AND c.k = h.k JOIN ({q}) q ON q.item_id = h.item_id"


@R.add("qry_hybrid_search")
def _(d: Dialect) -> str:
    return f"SELECT item_id, object_id, k, CAST(score AS DOUBLE) AS score, CAST(confidence AS DOUBLE) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, ord, k) AS place FROM ({hybrid(d)}) s) t WHERE place <= {TOP}"
