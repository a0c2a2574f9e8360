"""Structures in texts: CSV, JSON, citations, digests as identities, times and character vectors; all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.dialect import Dialect, Registry
from ..views import run_sql

R = Registry()

#: A field with what ends it. Quoted: its inside, and what stands between the closing quote and the end; a quote that never closes takes
#: the rest of the text. Unquoted: all up to the end. Groups: inside, rest, plain, end.
FIELD = r'(?:"((?:[^"]++|"")*+)(?:"([^,\r\n]*+)|\z)|((?!")[^,\r\n]*+))(,|\r\n|\n|\r|\z)'


def csv_structure(text: Column) -> Column:
    """headers, row_count (rows below the header), column_count of a CSV text. Commas, line ends and doubled quotes count as text within
    quotes; an empty line is a row without columns; null and empty texts have no header and no rows."""
    t = F.coalesce(text, F.lit(""))
    cut = F.struct(F.regexp_extract_all(t, F.lit(FIELD), F.lit(0)).alias("fields"), F.regexp_extract_all(t, F.lit(FIELD), F.lit(4)).alias("ends"))
    # Cut once, however often what follows names the parts.
    return _let(cut, lambda c: _csv_parts(c["fields"], c["ends"]))


def _csv_parts(fields: Column, ends: Column) -> Column:
    n, at = F.size(fields), lambda a, k: F.get(a, F.size(a) - k)
    # One more match, an empty one, stands at the end of the text, unless a comma ends it; behind a last line it is no row.
    rest = (at(fields, 1) != "") | ((n > 1) & at(ends, 2).isin(",", ""))
    lines = F.filter(ends, lambda e: ~e.isin(",", ""))
    first = F.array_position(F.transform(ends, lambda e: ~e.isin(",", "")), F.lit(True)).cast("int")
    width = F.when(first > 0, first).otherwise(n - F.when((n > 1) & (at(ends, 2) == ""), 1).otherwise(0))
    header = F.array_join(F.slice(fields, 1, width), "")
    inside, behind, plain = (F.regexp_extract_all(header, F.lit(FIELD), F.lit(g)) for g in (1, 2, 3))
    named = F.transform(inside, lambda x, i: F.concat(F.replace(x, F.lit('""'), F.lit('"')), F.get(behind, i), F.get(plain, i)))
    headers = F.when(F.get(fields, F.lit(0)).isin("", "\n", "\r", "\r\n") & ~((n > 1) & (F.get(ends, F.lit(0)) == ",")), F.array().cast("array<string>")).otherwise(F.slice(named, 1, width))
    rows = F.greatest(F.size(lines) + F.when(rest, 1).otherwise(0) - 1, F.lit(0))
    return F.struct(headers.alias("headers"), rows.alias("row_count"), F.size(headers).alias("column_count"))


#: How deep lists within lists are read.
DEPTH = 3


def json_text(v: str, depth: int = DEPTH) -> str:
    """SQL for the text of a VARIANT: strings as they are, lists joined by blanks without nulls, the strings of an object's `parts`, other
    objects as JSON, numbers and truth values as they are written; nothing for null."""
    inner = json_text(f"x{depth}", depth - 1) if depth else f"coalesce(try_variant_get(x{depth}, '$', 'string'), to_json(x{depth}))"
    kind = f"schema_of_variant({v})"
    parts = f"try_variant_get({v}, '$.parts', 'array<variant>')"
    return f"""CASE WHEN {v} IS NULL OR is_variant_null({v}) THEN '' WHEN {kind} = 'STRING' THEN try_variant_get({v}, '$', 'string')
WHEN {kind} LIKE 'ARRAY%' THEN array_join(transform(filter(try_variant_get({v}, '$', 'array<variant>'), x{depth} -> x{depth} IS NOT NULL AND NOT is_variant_null(x{depth})), x{depth} -> {inner}), ' ')
WHEN {parts} IS NOT NULL THEN array_join(transform(filter({parts}, p{depth} -> schema_of_variant(p{depth}) = 'STRING'), p{depth} -> try_variant_get(p{depth}, '$', 'string')), ' ')
WHEN {kind} = 'BOOLEAN' THEN initcap(to_json({v})) ELSE to_json({v}) END"""


def character_vector(text: Column, size: int = 128) -> Column:
    """A unit vector of a text: its first component is the sum of its code points modulo 100, in hundredths, each next one a hundredth more."""
    letters = F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")
    level = F.aggregate(letters, F.lit(0).cast("long"), lambda s, c: s + F.ascii(c)) % 100 / 100.0
    raw = _let(level, lambda v: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: v + i * 0.01))
    norm = lambda r: F.sqrt(F.aggregate(r, F.lit(0.0), lambda s, x: s + x * x))
    return _let(raw, lambda r: _let(norm(r), lambda n: F.transform(r, lambda x: x / n)))


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _csv_text() -> str:
    """Documents as CSV: a header with a comma and doubled quotes, a row over two lines, and the text's own lines without quotes; or these alone."""
    own = "replace(replace(coalesce(text, ''), '\"', ''''), chr(13), ' ')"
    return f"SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN {own} ELSE concat('\"id, no\",\"say \"\"x\"\"\",plain', chr(10), '\"two', chr(10), 'lines\",\"\"', chr(10), {own}) END AS text FROM documents"


@R.add("fn_csv_structure")
def _(d: Dialect) -> str:
    """The check, from the lines that the texts are made of."""
    lines = f"SELECT doc_id, doc_id % 7 = 0 AS bare, replace(replace(coalesce(text, ''), '\"', ''''), chr(13), ' ') AS t FROM documents"
    rows = "CASE WHEN t = '' THEN 0 ELSE len(string_split(t, chr(10))) - CASE WHEN t LIKE '%' || chr(10) THEN 1 ELSE 0 END END"
    return f"""
SELECT doc_id, CASE WHEN bare THEN array_to_string(h, '|') ELSE 'id, no|say "x"|plain' END AS headers, CAST(CASE WHEN bare THEN greatest(n - 1, 0) ELSE n + 1 END AS INTEGER) AS row_count, CAST(CASE WHEN bare THEN len(h) ELSE 3 END AS INTEGER) AS column_count
FROM (SELECT doc_id, bare, {rows} AS n, CASE WHEN string_split(t, chr(10))[1] = '' THEN [] ELSE string_split(string_split(t, chr(10))[1], ',') END AS h FROM ({lines}) a) b"""


def csv_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = run_sql(spark, sf_dir, _csv_text()).select("doc_id", csv_structure(F.col("text")).alias("s"))
    return found.select("doc_id", F.array_join("s.headers", "|").alias("headers"), "s.row_count", "s.column_count")


def vector_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in millionths, as a text."""
    found = run_sql(spark, sf_dir, "SELECT doc_id, text FROM documents").select("doc_id", character_vector(F.col("text")).alias("v"))
    return found.select("doc_id", F.array_join(F.transform("v", lambda x: F.round(x * 1000000).cast("long").cast("string")), ",").alias("vector"))


QUERIES = {"fn_csv_structure": csv_query, "qry_char_embedding": vector_query}


@R.add("qry_char_embedding")
def _(d: Dialect) -> str:
    """The check: the norm by its closed form, with sums of i and of i squared below 128."""
    level = "coalesce(list_sum(list_transform(string_split(text, ''), lambda c: unicode(c)))::BIGINT, 0) % 100 / 100.0::DOUBLE"
    return f"""
SELECT doc_id, array_to_string(list_transform(range(128), lambda i: CAST(round((v + i * 0.01::DOUBLE) / sqrt(128 * v * v + 2 * v * 81.28::DOUBLE + 69.088::DOUBLE) * 1000000) AS BIGINT)), ',') AS vector
FROM (SELECT doc_id, {level} AS v FROM (SELECT doc_id, nullif(coalesce(text, ''), '') AS text FROM documents) t0) t"""


@R.add("fn_flatten_json_text")
def _(d: Dialect) -> str:
    """Values of every type: text, number, truth value, null, lists in lists, an object with parts, another object, and what is no JSON."""
    value = """CASE event_id % 8 WHEN 0 THEN concat('"', event_type, '"') WHEN 1 THEN CAST(event_id AS STRING) WHEN 2 THEN 'true' WHEN 3 THEN 'null' WHEN 4 THEN concat('["a", null, ["', event_type, '", [2, []]], true]')
WHEN 5 THEN concat('{"parts": ["x", 1, "', event_type, '"], "k": 2}') WHEN 6 THEN concat('{"k":"', event_type, '"}') ELSE '{broken' END"""
    if d.spark:
        return f"SELECT event_id, {json_text('v')} AS flat FROM (SELECT event_id, try_parse_json({value}) AS v FROM events) e"
    return """
SELECT event_id, CASE event_id % 8 WHEN 0 THEN event_type WHEN 1 THEN CAST(event_id AS VARCHAR) WHEN 2 THEN 'True' WHEN 3 THEN '' WHEN 4 THEN concat('a ', event_type, ' 2  True')
WHEN 5 THEN concat('x ', event_type) WHEN 6 THEN concat('{"k":"', event_type, '"}') ELSE '' END AS flat FROM events"""


@R.add("fn_parse_iso_ts")
def _(d: Dialect) -> str:
    """ISO times with Z, offsets, fractions or neither; what is no time is the beginning of 1970."""
    day = "concat('2024-01-0', CAST(1 + user_id % 9 AS STRING), "
    text = f"CASE ord % 7 WHEN 0 THEN 'broken' WHEN 1 THEN {day}'T10:00:00Z') WHEN 2 THEN {day}'T10:00:00+02:00') WHEN 3 THEN {day}'T10:00:00.250Z') WHEN 4 THEN {day}' 10:00:00') WHEN 5 THEN '' ELSE {day}'T23:59:59-05:30') END"
    if d.spark:
        return f"SELECT ord, unix_millis(coalesce(try_to_timestamp(x), TIMESTAMP '1970-01-01 00:00:00')) AS epoch_ms FROM (SELECT ord, {text} AS x FROM v_activity) t"
    base = "epoch_ms(make_timestamp(2024, 1, CAST(1 + user_id % 9 AS BIGINT), 10, 0, 0.0))"
    return f"SELECT ord, CASE ord % 7 WHEN 0 THEN 0 WHEN 5 THEN 0 WHEN 2 THEN {base} - 7200000 WHEN 3 THEN {base} + 250 WHEN 6 THEN {base} + 50399000 + 19800000 ELSE {base} END AS epoch_ms FROM v_activity"


@R.add("fn_hash_ids")
def _(d: Dialect) -> str:
    """Identities as digests: of an attachment's lineage and processor version, and of its content's name, place and type."""
    message = "CASE WHEN ord % 3 = 0 THEN NULL ELSE concat('m', CAST(ord AS STRING)) END"
    return f"SELECT attachment_id, {d.sha(f"concat(CAST(conv_id AS STRING), ':', coalesce(nullif({message}, ''), 'none'), ':', attachment_id, ':1.0.0')")} AS knowledge_id, {d.sha("concat(file_name, ':', url, ':', media_type)")} AS fingerprint FROM v_attachments"


@R.add("join_attachment_cache")
def _(d: Dialect) -> str:
    """What was extracted before by the same processor in the same version is reused; all else is work."""
    ending = f"lower({d.first('file_name', '[.]([a-zA-Z0-9]+)$', 1)})"
    keyed = f"SELECT attachment_id, ord, concat(file_name, ':', url, ':', media_type) AS f, CASE {ending} WHEN 'png' THEN 'image' WHEN 'pdf' THEN 'pdf' WHEN 'csv' THEN 'text' ELSE 'none' END AS p FROM v_attachments"
    key = lambda version: d.sha(f"concat({d.sha('f')}, ':', p, ':', {version})")
    cache = f"SELECT DISTINCT {key("CASE WHEN ord % 8 = 0 THEN '0.9' ELSE '1.0' END")} AS cached FROM ({keyed}) k WHERE ord % 4 = 0 AND p <> 'none'"
    hint = "/*+ MERGE(c) */ " if d.spark else ""
    return f"SELECT {hint}a.attachment_id, a.cache_key, c.cached IS NOT NULL AS hit FROM (SELECT attachment_id, {key("'1.0'")} AS cache_key FROM ({keyed}) k) a LEFT JOIN ({cache}) c ON c.cached = a.cache_key"


INDEX = r"\[[Ss][Oo][Uu][Rr][Cc][Ee][ \x09-\x0D]+([0-9]+)\]"


def plain_number(d: Dialect, x: str) -> str:
    """A whole number as digits without zeros before it, whatever its length; null for anything else."""
    digits = d.first(x, r"^[ \x09-\x0D]*[+]?0*([0-9]+)[ \x09-\x0D]*$", 1)
    return f"nullif({digits}, '')"


@R.add("fn_citation_indexes")
def _(d: Dialect) -> str:
    found = f"SELECT doc_id, {d.each}({d.matches('content', INDEX, 1)}) AS n FROM v_signal_text"
    if d.spark:
        return f"SELECT DISTINCT doc_id, {plain_number(d, 'n')} AS n FROM ({found}) c"
    return f"SELECT DISTINCT doc_id, coalesce(nullif(ltrim(n, '0'), ''), '0') AS n FROM ({found}) c"


@R.add("join_citation_verify")
def _(d: Dialect) -> str:
    """A citation is verified if the answer names its number; one without a whole number never is."""
    if d.spark:
        named = f"SELECT DISTINCT doc_id, {plain_number(d, 'n')} AS n FROM (SELECT doc_id, explode({d.matches('content', INDEX, 1)}) AS n FROM v_signal_text) a"
        return f"SELECT /*+ MERGE(s) */ c.doc_id, c.k, s.n IS NOT NULL AS verified FROM v_citations c LEFT JOIN ({named}) s ON s.doc_id = c.doc_id AND s.n = {plain_number(d, 'c.source_index')}"
    number = "CAST(try_cast(trim(c.source_index) AS HUGEINT) AS HUGEINT)"
    whole = "regexp_full_match(trim(c.source_index), '[+-]?[0-9]+')"
    return f"SELECT c.doc_id, c.k, coalesce({whole} AND list_contains(list_transform({d.matches('t.content', INDEX, 1)}, lambda n: CAST(n AS HUGEINT)), {number}), false) AS verified FROM v_citations c JOIN v_signal_text t ON t.doc_id = c.doc_id"
