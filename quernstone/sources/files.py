"""Folders of text files and of JSON lines: what is read, what is left out and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.dialect import Dialect, Registry
from ..streaming.folders import shared_folder
from ..views import run_sql

R = Registry()

#: White space of a blank line, and the longest title.
BLANK, TITLE = r"\p{Z}\x09-\x0D\x1C-\x1F\x85", 120
ENDINGS = "*.{txt,md,TXT,MD,Txt,Md}"


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, rf"^[{BLANK}]+|[{BLANK}]+$", "")


def title_of(text: Column, name: Column) -> Column:
    """The first line with more than blanks and #, without these, at most 120 characters; the file's name where there is none."""
    lines = F.split(text, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]")
    clean = F.transform(lines, lambda line: stripped(F.regexp_replace(stripped(line), "^#+", "")))
    return F.coalesce(F.substring(F.get(F.filter(clean, lambda line: line != ""), F.lit(0)), 1, TITLE), name)


def scan_folder(spark: SparkSession, path: str, endings: str = ENDINGS) -> DataFrame:
    """path (below the folder), hash (sha256), modified_at, n_bytes, object_id, title, text of every text file at any depth, and
    `rejected`: 'not_utf8' or 'blank' for files that are left out, null for all others. A file is read as a whole;
    Spark lists no file without any byte, so these are left out like blank ones, but without a row."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", endings).load(path)
    root = path.rstrip("/").split("://")[-1].removeprefix("file:") + "/"
    below = F.substring_index("path", root, -1)
    rows = found.select(below.alias("path"), F.sha2("content", 256).alias("hash"), F.col("modificationTime").alias("modified_at"), F.col("length").alias("n_bytes"), F.expr("try_validate_utf8(CAST(content AS STRING))").alias("text"))
    rejected = F.when(F.col("text").isNull(), "not_utf8").when(stripped(F.col("text")) == "", "blank")
    rows = rows.withColumn("rejected", rejected)
    taken = F.col("rejected").isNull()
    return rows.select(
        "path", "hash", "modified_at", "n_bytes", F.when(taken, F.concat(F.lit("text_"), F.substring("hash", 1, 16))).alias("object_id"),
        F.when(taken, title_of(F.col("text"), F.element_at(F.split("path", "/"), -1))).alias("title"), "text", "rejected",
    )


def accepted(scan: DataFrame) -> DataFrame:
    return scan.where("rejected IS NULL").drop("rejected")


def load_permissive(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records of JSON lines files by a schema, rejects (file, record), and a manifest: a row for each file with what was found, loaded and
    rejected. A broken line, or one whose values do not fit the schema, is a reject and stops nothing. A file is told by its folder.
    What was parsed is written once, as all three read it."""
    corrupt, columns = "_broken", [c.strip().split()[0] for c in schema.split(",")]
    rows = spark.read.schema(f"{schema}, {corrupt} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt).json(path)
    rows = rows.select("*", F.element_at(F.split("_metadata.file_path", "/"), -2).alias("file"))
    kept = shared_folder(spark)
    rows.write.parquet(kept)
    rows = spark.read.schema(f"{schema}, {corrupt} string, file string").parquet(kept)
    bad = F.col(corrupt).isNotNull()
    loaded = rows.where(~bad).select("file", *columns)
    rejects = rows.where(bad).select("file", F.col(corrupt).alias("record"))
    manifest = rows.groupBy("file").agg(F.count("*").alias("found"), F.count_if(~bad).alias("loaded"), F.count_if(bad).alias("rejected"))
    return loaded, rejects, manifest


# The given tables as files -----------------------------------------------------------------------------------------------

#: Documents in files of ten, in folders by number; some files are blank, some broken.
FILED = """
SELECT CAST(floor(doc_id / 10) AS BIGINT) AS file, doc_id, CASE WHEN floor(doc_id / 10) % 11 = 3 THEN ' ' WHEN doc_id % 10 = 0 AND floor(doc_id / 10) % 3 = 0 THEN concat(chr(10), '## ', coalesce(text, '')) ELSE coalesce(text, '') END AS line FROM documents"""


def filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all files, whole files to a task, in the order in which the writer takes them: else it would sort them anew, by part and
    file alone, which loses the order of lines where a task spills."""
    rows = run_sql(spark, sf_dir, FILED).withColumn("line", F.when((F.col("file") % 7 == 5) & (F.col("doc_id") % 10 == 4), F.concat(F.expr("CAST(X'FF' AS STRING)"), "line")).otherwise(F.col("line")))
    return rows.repartition("file").withColumn("part", F.col("file") % 5).sortWithinPartitions("part", "file", "doc_id").select("part", "file", "line")


def folder_of_documents(spark: SparkSession, sf_dir: str) -> str:
    """Writes documents as text files folder/part/file/part-*.txt; each seventh file has a byte that is no UTF-8."""
    path = shared_folder(spark)
    filed(spark, sf_dir).write.partitionBy("part", "file").text(path)
    return path


def folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_folder(spark, folder_of_documents(spark, sf_dir))
    name = F.regexp_extract("path", r"^(part=\d+/file=\d+)/part-[^/]+\.txt$", 1)
    return found.select(name.alias("path"), "hash", "n_bytes", "object_id", "title", "rejected")


#: Events as JSON lines: some lines are cut, some hold a word where a number belongs, some are no object.
LINES = """
SELECT event_id % 8 AS file, event_id, CASE WHEN event_id % 23 = 0 THEN concat('{"event_id": ', CAST(event_id AS STRING), ', "kind": "') WHEN event_id % 29 = 0 THEN concat('{"event_id": "no number ', CAST(event_id AS STRING), '"}')
WHEN event_id % 31 = 0 THEN concat('word ', CAST(event_id AS STRING)) ELSE concat('{"event_id": ', CAST(event_id AS STRING), ', "kind": "', event_type, '", "other": [1, 2]}') END AS line FROM events"""
RECORD = "event_id long, kind string"


def permissive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loaded records, rejects and the manifest as rows of one table."""
    path = shared_folder(spark)
    run_sql(spark, sf_dir, LINES).withColumn("name", F.concat(F.lit("f"), "file")).select("name", "line").write.partitionBy("name").text(path)
    loaded, rejects, manifest = load_permissive(spark, path, RECORD)
    none = lambda kind: F.lit(None).cast(kind)
    return (
        loaded.select("file", F.lit("loaded").alias("what"), "event_id", F.col("kind").alias("value"), none("long").alias("n"))
        .unionByName(rejects.select("file", F.lit("rejected").alias("what"), none("long").alias("event_id"), F.col("record").alias("value"), none("long").alias("n")))
        .unionByName(manifest.select("file", F.lit("manifest").alias("what"), none("long").alias("event_id"), F.concat_ws("/", "found", "rejected").alias("value"), F.col("loaded").alias("n")))
    )


QUERIES = {"src_folder_scan": folder_scan, "src_permissive_load": permissive}


def _title_sql(text: str) -> str:
    """The title in DuckDB, by trimming lines."""
    blanks = " || ".join(["' '", *(f"chr({c})" for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))])
    line = f"list_filter(list_transform(regexp_split_to_array({text}, '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85]'), lambda l: trim(ltrim(trim(l, {blanks}), '#'), {blanks})), lambda l: l <> '')"
    return f"substring(coalesce({line}[1], ''), 1, {TITLE})"


@R.add("src_folder_scan")
def _(d: Dialect) -> str:
    """The check, from the documents themselves: broken files are told by their numbers, their hashes by their bytes."""
    texts = f"SELECT file, string_agg(line, chr(10) ORDER BY doc_id) || chr(10) AS text, string_agg(line, chr(10) ORDER BY doc_id) FILTER (doc_id % 10 < 4) || chr(10) AS before, max(doc_id) AS last, string_agg(line, chr(10) ORDER BY doc_id) FILTER (doc_id % 10 >= 4) || chr(10) AS after FROM ({FILED}) f GROUP BY file"
    return f"""
SELECT path, hash, n_bytes, CASE WHEN rejected IS NULL THEN concat('text_', substring(hash, 1, 16)) END AS object_id, CASE WHEN rejected IS NULL THEN {_title_sql('text')} END AS title, rejected FROM
(SELECT concat('part=', CAST(file % 5 AS VARCHAR), '/file=', CAST(file AS VARCHAR)) AS path, text, CASE WHEN broken THEN 'not_utf8' WHEN regexp_full_match(text, '[{BLANK}]*') THEN 'blank' END AS rejected,
        CASE WHEN broken THEN sha256(encode(before) || '\\xFF'::BLOB || encode(after)) ELSE sha256(text) END AS hash, strlen(text) + CASE WHEN broken THEN 1 ELSE 0 END AS n_bytes
 FROM (SELECT *, file % 7 = 5 AND last % 10 >= 4 AS broken FROM ({texts}) a) b) c"""


@R.add("src_permissive_load")
def _(d: Dialect) -> str:
    bad = "event_id % 23 = 0 OR event_id % 29 = 0 OR event_id % 31 = 0"
    of = f"SELECT concat('f', CAST(file AS VARCHAR)) AS file, event_id, line, {bad} AS bad FROM ({LINES}) l"
    return f"""
SELECT concat('name=', o.file) AS file, 'loaded' AS what, o.event_id, e.event_type AS value, NULL::BIGINT AS n FROM ({of}) o JOIN events e ON e.event_id = o.event_id WHERE NOT bad
UNION ALL SELECT concat('name=', file), 'rejected', NULL, line, NULL FROM ({of}) o WHERE bad
UNION ALL SELECT concat('name=', file), 'manifest', NULL, concat(CAST(count(*) AS VARCHAR), '/', CAST(count(*) FILTER (bad) AS VARCHAR)), count(*) FILTER (NOT bad) FROM ({of}) o GROUP BY file"""


@R.add("src_text_doc")
def _(d: Dialect) -> str:
    """A document of a text file: its id, its title, or why it is refused. File names come from the documents' numbers."""
    name = "concat('notes_', CAST(doc_id AS STRING), CASE doc_id % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.TXT' WHEN 2 THEN '.pdf' WHEN 3 THEN '' ELSE '.txt' END)"
    text = "CASE WHEN doc_id % 17 = 0 THEN ' ' WHEN doc_id % 19 = 0 THEN concat(chr(10), ' ## ', coalesce(text, '')) WHEN doc_id % 20 = 4 THEN '# ## #' ELSE coalesce(text, '') END"
    if d.spark:
        rejected = f"CASE WHEN NOT lower(name) RLIKE '[.](txt|md)$' THEN concat('extension ', coalesce(nullif(lower(regexp_extract(name, '[.][^.]*$', 0)), ''), 'none')) WHEN regexp_replace(t, r'[{BLANK}]+', '') = '' THEN 'empty' END"
        line = f"filter(transform(split(t, r'\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85]'), x -> regexp_replace(regexp_replace(x, r'^[{BLANK}]+#*[{BLANK}]*|^#+[{BLANK}]*', ''), r'[{BLANK}]+$', '')), x -> x <> '')"
        title = f"substring(coalesce(get({line}, 0), name), 1, {TITLE})"
    else:
        rejected = f"CASE WHEN NOT (lower(name) LIKE '%.txt' OR lower(name) LIKE '%.md') THEN concat('extension ', CASE WHEN contains(name, '.') THEN lower(name[strpos(name, '.'):]) ELSE 'none' END) WHEN regexp_full_match(t, '[{BLANK}]*') THEN 'empty' END"
        title = f"coalesce(nullif({_title_sql('t')}, ''), name)"
    return f"""
SELECT doc_id, rejected, CASE WHEN rejected IS NULL THEN concat('text_', substring({d.sha('t')}, 1, 16)) END AS object_id, CASE WHEN rejected IS NULL THEN {title} END AS title
FROM (SELECT *, {rejected} AS rejected FROM (SELECT doc_id, {name} AS name, {text} AS t FROM documents) a) b"""


@R.add("fn_title_from_text")
def _(d: Dialect) -> str:
    return f"SELECT doc_id, title FROM ({R['src_text_doc'](d)}) t WHERE rejected IS NULL"
