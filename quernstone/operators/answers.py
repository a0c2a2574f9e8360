"""Answers over evidence: which spans fit an envelope's parameters, what stays open or in conflict, what an answer may claim, and how to go on.

Tables of the functions below:

- envelopes: envelope_id, query_id, revision, evidence_set_ref; each envelope once
- parameters: envelope_id, dimension_id, status, value, assumption, source; of rows repeated for a dimension the greatest counts
- spans: query_id, span_id, dimension_id, value, choices (array); a row for each constraint of a span; several for one dimension
  count together. A row with neither value nor choices constrains nothing, one without a dimension stands for a span without constraints
- dimensions: dimension_id, version, sensitivity, can_be_assumed; the greatest version, as text, counts
- paths: envelope_id, dimension_id; where more evidence can be retrieved
- rules: dimension_id, preferred, rationale; each dimension once

Arrays hold an entry for a dimension of an envelope or span at most. What grows with the evidence, spans and observed values, comes as
rows, and only counts of it are in a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import sent
from ..plans.dialect import Dialect, Registry
from ..views import run_sql, view

R = Registry()

# Statuses, classes of evidence, effects and the sentences of an answer.
OPEN = ("missing", "partially_resolved")
CLASSES = ("supporting", "partial", "background", "conflicting")
NOTHING = "No material evidence or assumptions for a useful answer."
SUPPORTED, PARTLY = "Supported findings available.", "Partial findings available with qualification."
CLAIMS = {
    "supporting": ("Primary findings supported by compatible evidence", "supported"),
    "partial": ("Partial support from partially-compatible evidence (qualification required)", "partial"),
    "background": ("Background context from unconstrained evidence (not used to establish dimensions)", "background"),
}
PARTIAL_NOTE = "Partial compatibility disclosed; not full substantiation."
ESTIMATE = "estimate: may resolve or refine dimension"


def latest_dimensions(dimensions: DataFrame) -> DataFrame:
    """The greatest version of each dimension."""
    return dimensions.groupBy("dimension_id").agg(F.max_by(F.struct("version", "sensitivity", "can_be_assumed"), "version").alias("d")).select("dimension_id", "d.*")


def observed(spans: DataFrame) -> DataFrame:
    """query_id, dimension_id, value: each single value that a query's spans give, once."""
    return spans.where("value IS NOT NULL AND dimension_id IS NOT NULL").select("query_id", "dimension_id", "value").repartition("query_id").distinct()


def settled(values: DataFrame, rules: DataFrame) -> DataFrame:
    """query_id, dimension_id, low, high (unlike where values conflict), and of a rule whose preferred value was observed that value and its rationale."""
    r = sent(rules.select(F.col("dimension_id").alias("ruled"), "preferred", "rationale"))
    met = values.join(r, F.col("dimension_id") == F.col("ruled"), "left")
    fits = F.col("value") == F.col("preferred")
    return met.groupBy("query_id", "dimension_id").agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.max(F.when(fits, F.col("preferred"))).alias("preferred"), F.max(F.when(fits, F.col("rationale"))).alias("rationale")
    )


def known(parameters: DataFrame, dimensions: DataFrame) -> DataFrame:
    """Parameters, each dimension of an envelope once, with what the registry says of it (nulls where it is not registered)."""
    fields = ["status", "value", "assumption", "source"]
    one = parameters.repartition("envelope_id").groupBy("envelope_id", "dimension_id").agg(F.max(F.struct(*fields)).alias("p")).select("envelope_id", "dimension_id", "p.*")
    d = sent(latest_dimensions(dimensions).select(F.col("dimension_id").alias("registered"), "sensitivity", "can_be_assumed"))
    return one.join(d, F.col("dimension_id") == F.col("registered"), "left").drop("registered")


def open_high(parameters: DataFrame, dimensions: DataFrame) -> DataFrame:
    """Parameters of high sensitivity that are open; unavailable where nothing is there and nothing may be assumed."""
    found = known(parameters, dimensions).where((F.col("sensitivity") == "high") & F.col("status").isin(*OPEN))
    return found.select("envelope_id", "dimension_id", "status", _unavailable(F.col("status"), F.col("can_be_assumed")).alias("unavailable"))


def _unavailable(status: Column, assumable: Column) -> Column:
    return (status == "missing") & ~F.coalesce(assumable, F.lit(False))


def affordances(envelopes: DataFrame, parameters: DataFrame, spans: DataFrame, paths: DataFrame) -> DataFrame:
    """How to go on with each parameter that is not resolved: a row for each observed value if there are several, one if there is one;
    else, if a path is there, one to retrieve the parameter's value. A parameter without any of these has no row."""
    fields = ["status", "value"]
    asked = parameters.groupBy("envelope_id", "dimension_id").agg(F.max(F.struct(*fields, "assumption", "source")).alias("p")).where("p.status <> 'resolved'").select("envelope_id", "dimension_id", F.col("p.value").alias("own"))
    led = paths.select(F.col("envelope_id").alias("e_"), F.col("dimension_id").alias("d_")).distinct().withColumn("led", F.lit(True))
    asked = asked.join(led.hint("merge"), (F.col("envelope_id") == F.col("e_")) & (F.col("dimension_id") == F.col("d_")), "left").drop("e_", "d_")
    of = envelopes.select(F.col("envelope_id").alias("source_envelope_id"), "query_id", F.col("revision").alias("source_revision"), "evidence_set_ref")
    asked = asked.join(of.hint("merge"), F.col("envelope_id") == F.col("source_envelope_id")).drop("envelope_id")
    seen = observed(spans)
    ends = seen.groupBy("query_id", "dimension_id").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    key = ["query_id", "dimension_id"]
    met = asked.join(ends.hint("merge"), key, "left").join(seen.hint("merge"), key, "left").where("value IS NOT NULL OR led")
    reused = F.col("value").isNotNull()
    last = F.when(F.col("low") < F.col("high"), F.col("value")).when(reused, F.lit("reuse")).otherwise(F.lit("retrieve"))
    return met.select(
        F.concat_ws("-", F.lit("aff"), "source_envelope_id", "dimension_id", last).alias("affordance_id"), "dimension_id", F.coalesce("value", "own", F.lit("candidate")).alias("target_value"),
        F.when(reused, F.lit("available")).otherwise(F.lit("retrievable")).alias("availability"), F.lit("add_evidence").alias("effect"), "source_envelope_id", "source_revision",
        F.when(reused, F.col("evidence_set_ref")).alias("evidence_set_ref"), F.lit(ESTIMATE).alias("projected_change"), F.when(~reused, F.lit("defined_path")).alias("cost"),
    )


def states(envelopes: DataFrame, parameters: DataFrame, spans: DataFrame, dimensions: DataFrame, rules: DataFrame) -> DataFrame:
    """Envelopes with their parameters after the rules. A conflict that a rule settles makes a new revision, in which the parameter is resolved
    and its assumption gone; conflicts are of the parameters' dimensions, or of all where an envelope has no parameters."""
    p = known(parameters, dimensions)
    fields = ["dimension_id", "status", "value", "assumption", "source", "sensitivity", "can_be_assumed"]
    held = p.groupBy("envelope_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("given"))
    found = settled(observed(spans), rules).where("low < high").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("dimension_id", "preferred", "rationale"))).alias("unlike"))
    e = envelopes.select("envelope_id", "query_id", "revision").join(held.hint("merge"), "envelope_id", "left").join(found.hint("merge"), "query_id", "left")
    e = e.withColumn("given", F.coalesce("given", F.expr("array()").cast(held.schema["given"].dataType))).withColumn("unlike", F.coalesce("unlike", F.expr("array()").cast(found.schema["unlike"].dataType)))
    e = e.withColumn("unlike", F.expr("filter(unlike, u -> size(given) = 0 OR exists(given, g -> g.dimension_id = u.dimension_id))"))
    e = e.withColumn("ruled", F.expr("filter(unlike, u -> u.preferred IS NOT NULL)")).withColumn("conflicts", F.expr("transform(filter(unlike, u -> u.preferred IS NULL), u -> u.dimension_id)"))
    kept = "filter(given, g -> NOT exists(ruled, u -> u.dimension_id = g.dimension_id))"
    made = "transform(ruled, u -> named_struct('dimension_id', u.dimension_id, 'status', 'resolved', 'value', u.preferred, 'assumption', CAST(NULL AS STRING), 'source', 'domain_rule', 'sensitivity', CAST(NULL AS STRING), 'can_be_assumed', CAST(NULL AS BOOLEAN)))"
    e = e.withColumn("parameters", F.expr(f"array_sort(concat({kept}, {made}))"))
    return e.select("envelope_id", "query_id", (F.col("revision") + F.when(F.size("ruled") > 0, 1).otherwise(0)).alias("revision"), "parameters", "conflicts", "ruled")


def evidence(state: DataFrame, spans: DataFrame) -> DataFrame:
    """envelope_id, span_id, class: each class that a span has in any parameter with a value. It supports a parameter by giving its value,
    does so in part by a choice that holds it, is background where it says nothing of the dimension, and conflicts else."""
    says = F.col("dimension_id").isNotNull() & (F.col("value").isNotNull() | F.col("choices").isNotNull())
    # Dealt once, by query: neither a span's rows nor the join with envelopes need more.
    packed = spans.repartition("query_id").groupBy("query_id", "span_id").agg(F.collect_set(F.when(says, F.struct("dimension_id", "value", "choices"))).alias("constraints"))
    aims = state.select("envelope_id", "query_id", F.expr("filter(parameters, p -> p.value IS NOT NULL)").alias("aims")).where("size(aims) > 0")
    judged = """array_distinct(transform(transform(aims, p -> named_struct('want', p.value, 'own', filter(constraints, c -> c.dimension_id = p.dimension_id))), x -> CASE WHEN size(x.own) = 0 THEN 'background'
        WHEN exists(x.own, o -> coalesce(o.value = x.want, false)) THEN 'supporting' WHEN exists(x.own, o -> coalesce(array_contains(o.choices, x.want), false)) THEN 'partial' ELSE 'conflicting' END))"""
    return packed.join(aims.hint("merge"), "query_id").select("envelope_id", "span_id", F.explode(F.expr(judged)).alias("class"))


def answers(envelopes: DataFrame, parameters: DataFrame, spans: DataFrame, dimensions: DataFrame, rules: DataFrame) -> DataFrame:
    """A record for each envelope: content, qualifications, claims with the number of spans behind them, assumptions, what is open,
    unavailable or in conflict, whether an answer is delivered and complete, and one line that discloses it all."""
    state = states(envelopes, parameters, spans, dimensions, rules)
    counted = [F.sum(F.when(F.col("class") == c, 1).otherwise(0)).alias(c) for c in CLASSES]
    counts = evidence(state, spans).groupBy("envelope_id").agg(*counted)
    s = state.join(counts.hint("merge"), "envelope_id", "left").na.fill(0, list(CLASSES))
    s = s.withColumn("assumed", F.expr("filter(parameters, p -> p.assumption IS NOT NULL)"))
    s = s.withColumn("high", F.expr(f"filter(parameters, p -> p.sensitivity = 'high' AND p.status IN {OPEN})"))
    s = s.withColumn("unresolved", F.expr("transform(high, p -> p.dimension_id)"))
    s = s.withColumn("unavailable", F.expr("transform(filter(high, p -> p.status = 'missing' AND NOT coalesce(p.can_be_assumed, false)), p -> p.dimension_id)"))
    s = s.withColumn("delivered", F.expr("supporting > 0 OR partial > 0 OR size(assumed) > 0 OR exists(parameters, p -> p.status = 'resolved')"))
    s = s.withColumn("complete", F.expr("size(unresolved) = 0 AND size(conflicts) = 0"))
    reason = F.when(~F.col("delivered"), F.lit("insufficient_evidence")).when(F.size("unresolved") > 0, F.lit("unresolved_high_sensitivity")).when(F.size("conflicts") > 0, F.lit("conflicts_retained"))
    s = s.withColumn("reason", reason)

    def claim(text: str, status: str, n: str) -> str:
        return f"named_struct('text', {text}, 'support_status', '{status}', 'n_refs', CAST({n} AS BIGINT))"

    found = [f"CASE WHEN {c} > 0 THEN array({claim(f"'{text}'", status, c)}) ELSE array() END" for c, (text, status) in CLAIMS.items()]
    kept = "concat('Conflicts retained and disclosed for dimensions: ', array_join(conflicts, ', '), ' (neither value treated as established)')"
    settled_by = "concat('Resolved ', u.dimension_id, '=', u.preferred, ' via domain rule: ', u.rationale)"
    claims = ", ".join([
        f"transform(assumed, a -> {claim("concat('Assuming ', a.dimension_id, '=', a.assumption, ' (assumption)')", 'assumption', '0')})", *found,
        f"CASE WHEN size(conflicts) > 0 THEN array({claim(kept, 'conflicted', 'conflicting')}) ELSE array() END",
        f"transform(ruled, u -> {claim(settled_by, 'supported', '0')})",
    ])
    content = f"""concat(transform(assumed, a -> concat('Under assumption ', a.dimension_id, '=', a.assumption)), CASE WHEN supporting > 0 THEN array('{SUPPORTED}') ELSE array() END,
        CASE WHEN partial > 0 THEN array('{PARTLY}') ELSE array() END, transform(ruled, u -> concat('Domain rule applied to ', u.dimension_id)))"""

    def noted(say: str, names: str) -> str:
        return f"CASE WHEN size({names}) > 0 THEN concat('{say}', array_join({names}, ', ')) END"

    applied = "CASE WHEN size(ruled) > 0 THEN concat('Domain rules applied: ', array_join(transform(ruled, u -> concat(u.dimension_id, ': ', u.rationale)), '; ')) END"
    notes = f"""array_compact(array({noted('Unresolved high-sensitivity dimensions: ', 'unresolved')}, {noted('Unavailable (cannot be assumed): ', 'unavailable')}, {noted('Conflicts retained: ', 'conflicts')},
        CASE WHEN partial > 0 THEN '{PARTIAL_NOTE}' END, {applied}))"""
    s = s.withColumn("content", F.coalesce(F.expr(f"nullif(array_join({content}, '; '), '')"), F.lit(NOTHING))).withColumn("qualifications", F.expr(notes)).withColumn("claims", F.expr(f"concat({claims})"))
    status = "concat('Delivered=', initcap(CAST(delivered AS STRING)), ', ContextuallyComplete=', initcap(CAST(complete AS STRING)), coalesce(concat(', Reason=', reason), ''))"
    line = f"""concat_ws(' | ', content, CASE WHEN size(qualifications) > 0 THEN concat('Qualifications: ', array_join(qualifications, '; ')) END, {status},
        {noted('Unresolved: ', 'unresolved')}, {noted('Unavailable: ', 'unavailable')}, {noted('Conflicts: ', 'conflicts')})"""
    return s.select(
        F.concat(F.lit("ans-"), "envelope_id", F.lit("-r"), F.col("revision").cast("string")).alias("answer_id"), "envelope_id", "query_id", "revision", "content", "qualifications", "claims",
        F.expr("transform(assumed, a -> named_struct('dimension_id', a.dimension_id, 'assumption', a.assumption, 'source', coalesce(nullif(a.source, ''), 'assumption')))").alias("assumptions"),
        "unresolved", "unavailable", "conflicts", "ruled", *CLASSES, "delivered", "complete", "reason", F.expr(line).alias("disclosure"),
    )


def retained(state: DataFrame, spans: DataFrame) -> DataFrame:
    """envelope_id, dimension_id, value: all values behind a conflict, those of conflicts that a rule settled too."""
    unlike = state.select("envelope_id", "query_id", F.explode(F.expr("concat(conflicts, transform(ruled, u -> u.dimension_id))")).alias("dimension_id"))
    return observed(spans).join(unlike.hint("merge"), ["query_id", "dimension_id"]).select("envelope_id", "dimension_id", "value")


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    spans = run_sql(spark, sf_dir, "SELECT query_id, span_no AS span_id, dimension_id, CASE WHEN NOT is_list THEN value_text END AS value, CASE WHEN is_list THEN array(value_text, 'X') END AS choices FROM v_constraints")
    return {"envelopes": view(spark, sf_dir, "v_answer_envelopes"), "parameters": view(spark, sf_dir, "v_answer_parameters"), "spans": spans, "dimensions": view(spark, sf_dir, "v_dimensions"), "rules": view(spark, sf_dir, "v_domain_rules")}


def _state(t: dict[str, DataFrame]) -> DataFrame:
    return states(t["envelopes"], t["parameters"], t["spans"], t["dimensions"], t["rules"])


def answer_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    assumed = F.expr("array_join(transform(assumptions, a -> concat(a.dimension_id, '=', a.assumption, ' by ', a.source)), ', ')").alias("assumptions")
    listed = [F.array_join(c, ", ").alias(c) for c in ("unresolved", "unavailable", "conflicts")]
    return answers(**_tables(spark, sf_dir)).select("answer_id", "query_id", "revision", assumed, *listed, *CLASSES, "delivered", "complete", "reason", "disclosure")


def answer_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(**_tables(spark, sf_dir)).select("answer_id", F.posexplode("claims").alias("place", "c")).select("answer_id", "place", "c.*")


def answer_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans behind each answer, and the values that a conflict retains."""
    t = _tables(spark, sf_dir)
    state = _state(t)
    found = evidence(state, t["spans"]).select("envelope_id", "class", F.col("span_id").cast("string").alias("ref"))
    return found.unionByName(retained(state, t["spans"]).select("envelope_id", F.concat(F.lit("value of "), "dimension_id").alias("class"), F.col("value").alias("ref")))


def expansions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir)
    return affordances(t["envelopes"], t["parameters"], t["spans"], view(spark, sf_dir, "v_paths"))


def open_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return open_high(view(spark, sf_dir, "v_answer_parameters"), view(spark, sf_dir, "v_dimensions"))


QUERIES = {"ctx_answer_record": answer_record, "ctx_answer_claims": answer_claims, "ctx_answer_evidence": answer_evidence, "ctx_affordances": expansions, "ctx_open_high": open_dimensions}

# The checks, from the rules alone, a step to a table.

_LATEST = "SELECT dimension_id, sensitivity, can_be_assumed FROM v_dimensions a WHERE NOT EXISTS (SELECT 1 FROM v_dimensions b WHERE b.dimension_id = a.dimension_id AND b.version > a.version)"
_STEPS = f"""WITH known_dims AS ({_LATEST}),
seen AS (SELECT DISTINCT query_id, dimension_id, value_text AS v FROM v_constraints WHERE NOT is_list AND value_text IS NOT NULL),
bare AS (SELECT envelope_id FROM v_answer_envelopes EXCEPT SELECT envelope_id FROM v_answer_parameters),
unlike AS (SELECT e.envelope_id, s.dimension_id, max(CASE WHEN s.v = r.preferred THEN r.preferred END) AS won, max(r.rationale) AS why
  FROM v_answer_envelopes e JOIN seen s ON s.query_id = e.query_id LEFT JOIN v_domain_rules r ON r.dimension_id = s.dimension_id
  WHERE (e.envelope_id, s.dimension_id) IN (SELECT (envelope_id, dimension_id) FROM v_answer_parameters) OR e.envelope_id IN (SELECT envelope_id FROM bare)
  GROUP BY e.envelope_id, s.dimension_id HAVING count(*) > 1),
params AS (SELECT p.*, k.sensitivity, k.can_be_assumed FROM v_answer_parameters p LEFT JOIN known_dims k ON k.dimension_id = p.dimension_id
  WHERE (p.envelope_id, p.dimension_id) NOT IN (SELECT (envelope_id, dimension_id) FROM unlike WHERE won IS NOT NULL)
  UNION ALL SELECT envelope_id, dimension_id, 'resolved', won, NULL, 'domain_rule', NULL, NULL FROM unlike WHERE won IS NOT NULL),
found AS (SELECT DISTINCT envelope_id, span_no, CASE WHEN same THEN 'supporting' WHEN held THEN 'partial' WHEN said THEN 'conflicting' ELSE 'background' END AS class FROM
  (SELECT e.envelope_id, s.span_no, p.dimension_id, coalesce(bool_or(c.value_text = p.value AND NOT c.is_list), false) AS same, coalesce(bool_or(c.is_list AND p.value IN (c.value_text, 'X')), false) AS held, count(c.value_text) > 0 AS said
  FROM v_answer_envelopes e JOIN params p ON p.envelope_id = e.envelope_id AND p.value IS NOT NULL JOIN (SELECT DISTINCT query_id, span_no FROM v_constraints) s ON s.query_id = e.query_id
  LEFT JOIN v_constraints c ON c.query_id = s.query_id AND c.span_no = s.span_no AND c.dimension_id = p.dimension_id GROUP BY e.envelope_id, s.span_no, p.dimension_id) x)"""


def _listed(x: str, rows: str, sep: str = ", ") -> str:
    return f"(SELECT string_agg({x}, '{sep}' ORDER BY dimension_id) FROM {rows} AND t.envelope_id = e.envelope_id)"


def _records() -> str:
    """A row for each envelope with everything that is said of it as texts, null where there is nothing to say."""
    n = ", ".join(f"coalesce(n.{c}, 0) AS {c}" for c in CLASSES)
    high = f"params t WHERE sensitivity = 'high' AND status IN {OPEN}"
    return f"""{_STEPS},
tallies AS (SELECT envelope_id, {', '.join(f"count(CASE WHEN class = '{c}' THEN 1 END) AS {c}" for c in CLASSES)} FROM found GROUP BY envelope_id),
facts AS (SELECT e.envelope_id, e.query_id, {n}, e.revision + CASE WHEN EXISTS (SELECT 1 FROM unlike t WHERE won IS NOT NULL AND t.envelope_id = e.envelope_id) THEN 1 ELSE 0 END AS revision,
  {_listed("concat(dimension_id, '=', assumption, ' by ', coalesce(source, 'assumption'))", 'params t WHERE assumption IS NOT NULL')} AS assumptions,
  {_listed("concat('Under assumption ', dimension_id, '=', assumption)", 'params t WHERE assumption IS NOT NULL', '; ')} AS assuming,
  {_listed('dimension_id', high)} AS unresolved, {_listed('dimension_id', high + " AND status = 'missing' AND can_be_assumed IS DISTINCT FROM true")} AS unavailable,
  {_listed('dimension_id', 'unlike t WHERE won IS NULL')} AS conflicts,
  {_listed("concat('Domain rule applied to ', dimension_id)", 'unlike t WHERE won IS NOT NULL', '; ')} AS ruled, {_listed("concat(dimension_id, ': ', why)", 'unlike t WHERE won IS NOT NULL', '; ')} AS whys,
  EXISTS (SELECT 1 FROM params t WHERE (status = 'resolved' OR assumption IS NOT NULL) AND t.envelope_id = e.envelope_id) AS given
  FROM v_answer_envelopes e LEFT JOIN tallies n ON n.envelope_id = e.envelope_id),
judged AS (SELECT *, supporting + partial > 0 OR given AS delivered, unresolved IS NULL AND conflicts IS NULL AS complete, concat('ans-', envelope_id, '-r', revision) AS answer_id FROM facts)"""


@R.add("ctx_answer_record")
def _(d: Dialect) -> str:
    reason = "CASE WHEN NOT delivered THEN 'insufficient_evidence' WHEN unresolved IS NOT NULL THEN 'unresolved_high_sensitivity' WHEN conflicts IS NOT NULL THEN 'conflicts_retained' END"
    content = f"coalesce(nullif(concat_ws('; ', assuming, CASE WHEN supporting > 0 THEN '{SUPPORTED}' END, CASE WHEN partial > 0 THEN '{PARTLY}' END, ruled), ''), '{NOTHING}')"
    notes = f"concat_ws('; ', 'Unresolved high-sensitivity dimensions: ' || unresolved, 'Unavailable (cannot be assumed): ' || unavailable, 'Conflicts retained: ' || conflicts, CASE WHEN partial > 0 THEN '{PARTIAL_NOTE}' END, 'Domain rules applied: ' || whys)"
    yes = lambda x: f"CASE WHEN {x} THEN 'True' ELSE 'False' END"
    status = f"concat('Delivered=', {yes('delivered')}, ', ContextuallyComplete=', {yes('complete')}, ', Reason=' || {reason})"
    line = f"concat_ws(' | ', {content}, 'Qualifications: ' || nullif({notes}, ''), {status}, 'Unresolved: ' || unresolved, 'Unavailable: ' || unavailable, 'Conflicts: ' || conflicts)"
    texts = ", ".join(f"coalesce({c}, '') AS {c}" for c in ("assumptions", "unresolved", "unavailable", "conflicts"))
    return f"{_records()} SELECT answer_id, query_id, revision, {texts}, {', '.join(CLASSES)}, delivered, complete, {reason} AS reason, {line} AS disclosure FROM judged"


@R.add("ctx_answer_claims")
def _(d: Dialect) -> str:
    """Claims in the order of their kinds, then of dimensions."""
    kinds = [f"SELECT j.answer_id, 1 AS kind, t.dimension_id, concat('Assuming ', t.dimension_id, '=', t.assumption, ' (assumption)') AS text, 'assumption' AS support_status, 0 AS n_refs FROM judged j JOIN params t ON t.envelope_id = j.envelope_id AND t.assumption IS NOT NULL"]
    kinds += [f"SELECT answer_id, {k}, '', '{text}', '{status}', {c} FROM judged WHERE {c} > 0" for k, (c, (text, status)) in enumerate(CLAIMS.items(), 2)]
    kinds += ["SELECT answer_id, 5, '', concat('Conflicts retained and disclosed for dimensions: ', conflicts, ' (neither value treated as established)'), 'conflicted', conflicting FROM judged WHERE conflicts IS NOT NULL"]
    kinds += ["SELECT j.answer_id, 6, t.dimension_id, concat('Resolved ', t.dimension_id, '=', t.won, ' via domain rule: ', t.why), 'supported', 0 FROM judged j JOIN unlike t ON t.envelope_id = j.envelope_id AND t.won IS NOT NULL"]
    return f"{_records()} SELECT answer_id, CAST(row_number() OVER (PARTITION BY answer_id ORDER BY kind, dimension_id) - 1 AS INTEGER) AS place, text, support_status, CAST(n_refs AS BIGINT) AS n_refs FROM ({' UNION ALL '.join(kinds)}) c"


@R.add("ctx_answer_evidence")
def _(d: Dialect) -> str:
    return f"""{_STEPS} SELECT envelope_id, class, CAST(span_no AS VARCHAR) AS ref FROM found
UNION ALL SELECT u.envelope_id, concat('value of ', u.dimension_id), s.v FROM unlike u JOIN v_answer_envelopes e ON e.envelope_id = u.envelope_id JOIN seen s ON s.query_id = e.query_id AND s.dimension_id = u.dimension_id"""


@R.add("ctx_affordances")
def _(d: Dialect) -> str:
    shown = f"dimension_id, target, availability, 'add_evidence' AS effect, envelope_id AS source_envelope_id, revision AS source_revision, CASE WHEN availability = 'available' THEN evidence_set_ref END AS evidence_set_ref, '{ESTIMATE}' AS projected_change, CASE WHEN availability = 'retrievable' THEN 'defined_path' END AS cost"
    return f"""WITH asked AS (SELECT e.*, p.dimension_id, p.value FROM v_answer_envelopes e JOIN v_answer_parameters p ON p.envelope_id = e.envelope_id WHERE p.status <> 'resolved'),
seen AS (SELECT DISTINCT query_id, dimension_id, value_text AS v FROM v_constraints WHERE NOT is_list AND value_text IS NOT NULL),
several AS (SELECT a.*, s.v AS target, count(*) OVER (PARTITION BY a.envelope_id, a.dimension_id) AS k FROM asked a JOIN seen s ON s.query_id = a.query_id AND s.dimension_id = a.dimension_id),
ways AS (SELECT *, 'available' AS availability, CASE WHEN k > 1 THEN target ELSE 'reuse' END AS last FROM several
  UNION ALL SELECT a.*, coalesce(a.value, 'candidate'), 0, 'retrievable', 'retrieve' FROM asked a JOIN v_paths w ON w.envelope_id = a.envelope_id AND w.dimension_id = a.dimension_id
  WHERE (a.query_id, a.dimension_id) NOT IN (SELECT (query_id, dimension_id) FROM seen))
SELECT concat('aff-', envelope_id, '-', dimension_id, '-', last) AS affordance_id, {shown.replace('target,', 'target AS target_value,')} FROM ways"""


@R.add("ctx_open_high")
def _(d: Dialect) -> str:
    return f"""SELECT p.envelope_id, p.dimension_id, p.status, p.status = 'missing' AND k.can_be_assumed IS DISTINCT FROM true AS unavailable
FROM v_answer_parameters p JOIN ({_LATEST}) k ON k.dimension_id = p.dimension_id WHERE k.sensitivity = 'high' AND p.status IN {OPEN}"""
