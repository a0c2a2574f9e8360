"""Evidence: which spans, terms and rules bear on a query, and what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.dialect import Dialect, Registry
from ..plans.numbering import spread
from ..views import view
from .relational import R as RELATIONAL

R = Registry()

R.plain(
    ctx_retrieve="""
SELECT e.envelope_id, e.revision + 1 AS revision, e.dimension_id, CASE WHEN f.query_id IS NULL THEN 'A' ELSE f.value_text END AS evidence_value, r.n_refs
FROM v_envelopes e JOIN (SELECT query_id, count(DISTINCT span_no) AS n_refs FROM v_constraints GROUP BY query_id) r ON r.query_id = e.envelope_id
LEFT JOIN (SELECT query_id, dimension_id, value_text FROM (SELECT *, row_number() OVER (PARTITION BY query_id, dimension_id ORDER BY span_no) AS n FROM v_constraints) t WHERE n = 1) f
ON f.query_id = e.envelope_id AND f.dimension_id = e.dimension_id WHERE e.status <> 'resolved'""",
    ctx_dim_registry="""
SELECT 'duplicate' AS violation, concat(CAST(c_nationkey AS STRING), '@', c_mktsegment) AS subject, count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment HAVING count(*) > 1
UNION ALL SELECT 'redefined', s.s_name, 1 FROM supplier s SEMI JOIN (SELECT DISTINCT c_nationkey FROM customer) d ON d.c_nationkey = s.s_nationkey""",
    fn_attachment_extract="""
SELECT attachment_id, CASE WHEN name LIKE '-  %' THEN trim(substring(name, 4)) ELSE name END AS name, url FROM
(SELECT attachment_id, url, CASE WHEN media_type = 'image' THEN 'Attached 2 files.' WHEN file_name LIKE '%.csv' THEN concat('-  ', file_name, ' ') WHEN file_name LIKE '%.exe' THEN '' ELSE file_name END AS name FROM v_attachments) s
WHERE name <> '' AND name NOT LIKE 'Attached %'
UNION ALL SELECT attachment_id, file_name, NULL FROM v_attachments WHERE file_name LIKE '%.png'""",
)


@R.add("ctx_spans")
def _(d: Dialect) -> str:
    """A span has its object's own constraints, or else those that the package gives for the object."""
    own = f"SELECT query_id, {d.joined_set("concat(dimension_id, ':', value_text)")} AS own FROM v_constraints WHERE value_text = 'F' AND NOT is_list GROUP BY query_id"
    return f"""
SELECT concat(CAST(l.l_orderkey AS {d.text}), '_', CAST(l.l_linenumber AS {d.text})) AS span_id, l.l_orderkey AS object_id, coalesce(nullif(c.own, ''), concat('status:', o.o_orderstatus), '') AS constraints
FROM lineitem l LEFT JOIN ({own}) c ON c.query_id = l.l_orderkey LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey"""


@R.add("ctx_domain_rules")
def _(d: Dialect) -> str:
    """A conflict is resolved only by a preferred value that was observed; all values are kept."""
    rules = "SELECT 'returnflag' AS dimension_id, 'A' AS preferred, 'accepted returns lead' AS rationale UNION ALL SELECT 'linestatus', 'O', 'open lines lead'"
    return f"""
SELECT c.query_id, c.dimension_id, r.preferred AS resolved_value, r.rationale, {d.joined_set('c.value_text')} AS preserved_values
FROM v_constraints c JOIN ({rules}) r ON r.dimension_id = c.dimension_id WHERE NOT c.is_list AND c.value_text IS NOT NULL
GROUP BY c.query_id, c.dimension_id, r.preferred, r.rationale HAVING min(c.value_text) <> max(c.value_text) AND max(CASE WHEN c.value_text = r.preferred THEN 1 ELSE 0 END) = 1"""


@R.add("ctx_completion")
def _(d: Dialect) -> str:
    """Delivered and complete are independent of each other; the reason names the first thing that lacks."""
    return f"""
SELECT envelope_id, delivered, open_high = 0 AND conflicts = 0 AS complete,
       CASE WHEN NOT delivered THEN 'insufficient_evidence' WHEN open_high > 0 THEN 'unresolved_high_sensitivity' WHEN conflicts > 0 THEN 'conflicts_retained' END AS reason
FROM (SELECT e.envelope_id, e.status = 'resolved' OR coalesce(k.material, 0) > 0 AS delivered, coalesce(x.conflicts, 0) AS conflicts,
             CASE WHEN e.status IN ('missing', 'partially_resolved') AND o.o_orderpriority LIKE '1%' THEN 1 ELSE 0 END AS open_high
      FROM v_envelopes e JOIN orders o ON o.o_orderkey = e.envelope_id
      LEFT JOIN (SELECT query_id, count(*) AS material FROM ({RELATIONAL['ctx_classify'](d)}) s WHERE class IN ('fully', 'partially') GROUP BY query_id) k ON k.query_id = e.envelope_id
      LEFT JOIN (SELECT query_id, count(*) AS conflicts FROM ({RELATIONAL['ctx_conflicts'](d)}) s GROUP BY query_id) x ON x.query_id = e.envelope_id) t"""


@R.add("join_evidence_integrity")
def _(d: Dialect) -> str:
    """Items that cite a source their object does not have, or none at all."""
    refs = d.matches("content", r"\[[Ss]ource ([0-9]+)\]", 1)
    return f"""
SELECT r.doc_id, concat('unknown evidence ', r.ref) AS error FROM (SELECT DISTINCT doc_id, {d.each}({refs}) AS ref FROM v_signal_text) r
ANTI JOIN (SELECT object_id, CAST(row_number() OVER (PARTITION BY object_id ORDER BY scoped_id) AS {d.text}) AS n FROM v_object_sources) k ON k.object_id = concat('d', CAST(r.doc_id AS {d.text})) AND k.n = r.ref
UNION ALL SELECT doc_id, 'missing evidence' FROM v_signal_text WHERE {d.size}({refs}) = 0"""


@R.add("src_detect_platform_v2")
def _(d: Dialect) -> str:
    """By the file's name first, then by the client that the document names."""
    client = "get_json_object(body, '$.client')" if d.spark else "json_extract_string(body, '$.client')"
    return f"""
SELECT event_id, CASE WHEN name LIKE '%grok%' THEN 'grok' WHEN name LIKE '%chatgpt%' OR name LIKE '%conversations-%' THEN 'chatgpt' WHEN {client} = 'grok' THEN 'grok' ELSE 'json' END AS platform
FROM (SELECT event_id, lower(concat(CASE event_type WHEN 'signup' THEN 'Grok-' WHEN 'view' THEN 'conversations-' WHEN 'click' THEN 'my-ChatGPT-' ELSE 'export-' END, CAST(event_id AS {d.text}), '.json')) AS name,
      CASE event_type WHEN 'error' THEN '{{"client": "grok"}}' ELSE props END AS body FROM events) e"""


@R.add("ctx_snapshots")
def _(d: Dialect) -> str:
    """A snapshot for each retrieval, never overwritten: a name that is taken gets the next number, and each one names the one before it."""
    named = f"concat('snap-', CAST(envelope_id AS {d.text}), '-', CAST(revision + 1 AS {d.text}))"
    once = "SELECT envelope_id, revision, evidence_value, n_refs FROM (" + R["ctx_retrieve"](d) + ") x"
    return f"""
SELECT envelope_id, CASE WHEN taken = 0 THEN preferred ELSE concat(preferred, '-', CAST(taken AS {d.text})) END AS snapshot_id, n_refs,
       CASE WHEN taken = 1 THEN preferred WHEN taken > 1 THEN concat(preferred, '-', CAST(taken - 1 AS {d.text})) END AS parent_snapshot_id
FROM (SELECT envelope_id, n_refs, {named} AS preferred, row_number() OVER (PARTITION BY envelope_id, revision ORDER BY again) - 1 AS taken
      FROM (SELECT *, 0 AS again FROM ({once}) a UNION ALL SELECT *, 1 FROM ({once}) b WHERE envelope_id % 4 = 0) u) t"""


# The same with what a task holds bounded ---------------------------------------------------------------------------------


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(view(spark, sf_dir, "v_constraints").where("NOT is_list AND value_text IS NOT NULL"), _lines(spark, sf_dir).count(), "query_id", "dimension_id")
    return rows.groupBy("query_id", "dimension_id").agg(F.count_distinct("value_text").alias("n_values")).where("n_values > 1")


def _observed(envelopes: DataFrame, constraints: DataFrame, n: int) -> DataFrame:
    """Constraints beside the envelope and dimension that they bear on; `own` is the envelope's value. Dealt by id alone: Spark knows that
    envelopes have one dimension, takes it out of the join and would deal anew what it also was a key of."""
    e = spread(envelopes.select("envelope_id", F.col("dimension_id").alias("own_dimension"), F.col("value_text").alias("own")), n, "envelope_id")
    c = spread(constraints, n, "query_id")
    return c.join(e.hint("merge"), (c.query_id == e.envelope_id) & (c.dimension_id == e.own_dimension))


def envelope_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_constraints").where("NOT is_list AND value_text IS NOT NULL")
    found = _observed(view(spark, sf_dir, "v_envelopes"), rows, _lines(spark, sf_dir).count())
    return found.groupBy("query_id", "dimension_id").agg(F.count_distinct("value_text").alias("n_values")).where("n_values > 1")


def completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, envelopes = _lines(spark, sf_dir).count(), view(spark, sf_dir, "v_envelopes")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("envelope_id"), "o_orderpriority")
    found = _observed(envelopes, view(spark, sf_dir, "v_constraints"), n).groupBy("query_id", "dimension_id")
    found = found.agg(F.count_if(F.col("value_text") == F.col("own")).alias("material"), F.count_distinct(F.when(~F.col("is_list"), F.col("value_text"))).alias("values"))
    found = spread(found, n, "query_id").groupBy("query_id").agg(F.sum("material").alias("material"), F.count_if(F.col("values") > 1).alias("conflicts"))
    rows = spread(envelopes, n, "envelope_id").join(spread(orders, n, "envelope_id").hint("merge"), "envelope_id")
    rows = rows.join(found.withColumnRenamed("query_id", "envelope_id").hint("merge"), "envelope_id", "left")
    delivered = (F.col("status") == "resolved") | (F.coalesce("material", F.lit(0)) > 0)
    high = F.col("status").isin("missing", "partially_resolved") & F.col("o_orderpriority").startswith("1")
    rows = rows.select("envelope_id", delivered.alias("delivered"), F.coalesce(high, F.lit(False)).alias("high"), F.coalesce("conflicts", F.lit(0)).alias("conflicts"))
    reason = F.when(~F.col("delivered"), "insufficient_evidence").when(F.col("high"), "unresolved_high_sensitivity").when(F.col("conflicts") > 0, "conflicts_retained")
    return rows.select("envelope_id", "delivered", (~F.col("high") & (F.col("conflicts") == 0)).alias("complete"), reason.alias("reason"))


def retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first constraint of a dimension is that of the smallest span number, and of rows with the same number the one that is stored first:
    by file, then by its row there. The SQL leaves this open; DuckDB, too, keeps rows in the order in which they are stored."""
    lines = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    n = lines.count()
    each = F.struct(F.lit("returnflag").alias("dimension_id"), F.when(F.col("l_linenumber") != 6, F.col("l_returnflag")).alias("value_text"))
    other = F.when(F.col("l_linenumber") != 4, F.struct(F.lit("linestatus").alias("dimension_id"), F.col("l_linestatus").alias("value_text")))
    rows = spread(lines, n, "l_orderkey").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("span_no"), "file", "row", F.explode(F.filter(F.array(each, other), lambda x: x.isNotNull())).alias("c"))
    firsts = rows.groupBy("query_id", "c.dimension_id").agg(F.min(F.struct(F.col("span_no").isNull(), "span_no", "file", "row", "c.value_text")).alias("first"), F.collect_set("span_no").alias("spans"))
    found = firsts.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("dimension_id", "first.value_text"))).alias("values"), F.size(F.array_distinct(F.flatten(F.collect_list("spans")))).cast("long").alias("n_refs"))
    e = spread(view(spark, sf_dir, "v_envelopes").where("status <> 'resolved'"), n, "envelope_id")
    value = F.when(~F.map_contains_key("values", F.col("dimension_id")), "A").otherwise(F.try_element_at("values", F.col("dimension_id")))
    return e.join(found.hint("merge"), e.envelope_id == found.query_id).select("envelope_id", (F.col("revision") + 1).alias("revision"), "dimension_id", value.alias("evidence_value"), "n_refs")


QUERIES = {"agg_conflicts": conflicts, "ctx_conflicts": envelope_conflicts, "ctx_completion": completion, "ctx_retrieve": retrieve}
