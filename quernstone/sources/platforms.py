"""Packages of conversations: one of all, one for each platform, or both, each with documents, an index, an archive and a manifest.

A package is a set of tables in folders by kind and package, so that a reader takes one package without the others. What grows with the
conversations comes as rows: a document is its parts in order, an index its lines. The manifest is written last; without it there is no package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dictionaries import entities
from ..operators.relational import platform
from ..plans.dialect import DUCK, SPARK, Dialect, Registry
from ..plans.numbering import numbered
from ..streaming.folders import shared_folder
from ..views import run_sql, view

R = Registry()

# Modes, names and headings of packages.
UNIFIED, SEPARATE, BOTH = "Unified", "Separate by Source", "Both"
UNIFIED_TITLE, PLATFORM_TITLE = "Unified Knowledge Base", " Knowledge Package"
INDEXES = ("\n## Index of Conversations\n", "\n## Index of Extracted Entities\n", "\n## Index of Attachment Knowledge\n")

UNIT = ["kind", "package"]
COUNTS = ["conversations", "messages", "entities", "attachments"]
SCHEMAS = {
    "documents": "conv_id long, section int, at long, text string, kind string, package string",
    "archive": "id string, file_name string, title string, source string, created string, message_count long, source_platform string, kind string, package string",
    "index": "place long, line string, kind string, package string",
    "manifest": "kind string, package string, platform_name string, conversations long, messages long, entities long, attachments long, first_imported string, last_imported string, export_mode string, exported_at timestamp",
}


def export_mode(mode: str | None) -> str:
    """A mode by its words: unified alone, anything of sources or separate, and both for all else and nothing."""
    said = (mode or BOTH).strip().lower()
    if "unified" in said and "source" not in said and "both" not in said:
        return UNIFIED
    return SEPARATE if "separate" in said or "source" in said else BOTH


def safe_name(name: Column) -> Column:
    """A name for a folder or file: runs of other characters than ASCII letters, digits, _ and - become one _, none at either end."""
    clean = F.regexp_replace(F.regexp_replace(name, r"[^a-zA-Z0-9_\-]+", "_"), "^_+|_+$", "")
    return F.when(clean != "", clean).otherwise("Platform")


def _tally(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy(F.col("conv_id").alias(f"of_{name}")).agg(F.count("*").alias(name)).hint("merge")


def exported(conversations: DataFrame, messages: DataFrame, entities: DataFrame, attachments: DataFrame, permissions: DataFrame, mode: str | None, strict: bool = False) -> DataFrame:
    """Conversations with their platform, whether they may be shown, their counts, and the packages they go to.

    The platform is the given one, or else told by the source. A conversation that any entry denies (can_read false) is not shown; where strict, neither
    is one without an entry. Platforms whose safe names are equal share a package."""
    granted = permissions.groupBy(F.col("conv_id").alias("of_entry")).agg(F.max(F.expr("can_read IS NOT DISTINCT FROM false")).alias("denied")).hint("merge")
    c = conversations.join(granted, F.col("conv_id") == F.col("of_entry"), "left")
    shown = ~F.coalesce("denied", F.lit(strict))
    for name, rows in (("messages", messages), ("entities", entities), ("attachments", attachments)):
        c = c.join(_tally(rows, name), F.col("conv_id") == F.col(f"of_{name}"), "left")
    named = F.coalesce(F.expr("nullif(source_platform, '')"), F.expr(platform("coalesce(source, '')", "Unknown")))
    c = c.withColumn("platform", named)
    mode = export_mode(mode)
    units = [F.struct(F.lit("unified").alias("kind"), F.lit("unified").alias("package"))] if mode != SEPARATE else []
    units += [F.struct(F.lit("platform").alias("kind"), safe_name(F.col("platform")).alias("package"))] if mode != UNIFIED else []
    return c.select("conv_id", F.coalesce(F.col("title"), F.col("conv_id").cast("string")).alias("title"), "source", "created", "platform", shown.alias("shown"), *[F.coalesce(n, F.lit(0)).alias(n) for n in COUNTS[1:]], F.array(*units).alias("units"))


def manifest(held: DataFrame, mode: str | None) -> DataFrame:
    """A row for each package, with what it shows, none if all is denied; then the root's rows: a platform each, of those that show anything, and one over all."""
    seen = lambda x: F.when(F.col("shown"), x)
    sums = [F.count(seen(F.lit(1))).alias("conversations"), *[F.coalesce(F.sum(seen(F.col(n))), F.lit(0)).alias(n) for n in COUNTS[1:]], F.min(seen(F.col("created"))).alias("first_imported"), F.max(seen(F.col("created"))).alias("last_imported")]
    mode = export_mode(mode)
    of = lambda rows, kind, package, name: rows.select(kind.alias("kind"), package.alias("package"), name.alias("platform_name"), *COUNTS, "first_imported", "last_imported")
    whole = held.agg(*sums)
    by_platform = held.groupBy("platform").agg(*sums).where("conversations > 0")
    parts = [of(by_platform, F.lit("root"), F.lit(""), F.col("platform")), of(whole, F.lit("root"), F.lit(""), F.lit(None).cast("string"))]
    if mode != SEPARATE:
        parts.append(of(whole, F.lit("unified"), F.lit("unified"), F.lit(UNIFIED)))
    if mode != UNIFIED:
        units = held.withColumn("package", safe_name(F.col("platform"))).groupBy("package").agg(F.min("platform").alias("name"), *sums)
        parts.append(of(units, F.lit("platform"), F.col("package"), F.col("name")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("export_mode", F.lit(mode)).withColumn("exported_at", F.current_timestamp())


def documents(shown: DataFrame, messages: DataFrame, entities: DataFrame) -> DataFrame:
    """conv_id, section, at, text, kind, package: the Markdown of each conversation in parts, in the order of section, at and text."""
    part = lambda rows, section, at, text: rows.select("conv_id", "units", F.lit(section).alias("section"), at.cast("long").alias("at"), text.alias("text"))
    first = F.lit(0)
    head = F.concat(F.lit("# "), "title", F.lit("\n\n**ID:** `"), F.col("conv_id").cast("string"), F.lit("` | **Source:** `"), F.coalesce("source", F.lit("")), F.lit("`\n\n"))
    of = shown.select(F.col("conv_id").alias("of_conv"), "units").hint("merge")
    named = entities.join(of, F.col("conv_id") == F.col("of_conv"))
    said = messages.join(of, F.col("conv_id") == F.col("of_conv"))
    role = F.coalesce("role", F.lit("user"))
    role = F.concat(F.upper(F.substring(role, 1, 1)), F.lower(F.expr("substring(coalesce(role, 'user'), 2)")))
    parts = [
        part(shown, 0, first, head),
        part(shown.where("entities > 0"), 1, first, F.lit("## Entities\n\n")),
        part(named, 2, first, F.concat(F.lit("- **"), "value", F.lit("** ("), "type", F.lit(")\n"))),
        part(shown, 3, first, F.when(F.col("entities") > 0, "\n## Messages\n\n").otherwise("## Messages\n\n")),
        part(said, 4, F.col("msg_index"), F.concat(F.lit("### "), role, F.lit("\n\n"), F.coalesce("content", F.lit("")), F.lit("\n\n"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("conv_id", "section", "at", "text", F.explode("units").alias("u")).select("conv_id", "section", "at", "text", "u.*")


def index_lines(shown: DataFrame, entities: DataFrame, attachments: DataFrame, units: DataFrame) -> DataFrame:
    """place, line, kind, package: title, counts, then conversations by title, entities by value and attachments by file name."""
    of = shown.select(F.col("conv_id").alias("of_conv"), "units").hint("merge")
    met = lambda rows: rows.join(of, F.col("conv_id") == F.col("of_conv"))
    line = lambda rows, section, by, text: rows.select(F.explode("units").alias("u"), F.lit(section).alias("section"), by.alias("by"), text.alias("line"), "conv_id").select("u.*", "section", "by", "line", "conv_id")
    title = F.when(F.col("kind") == "unified", UNIFIED_TITLE).otherwise(F.concat("platform_name", F.lit(PLATFORM_TITLE)))
    counts = F.concat(F.lit("**Conversations:** "), F.col("conversations").cast("string"), F.lit(" | **Entities:** "), F.col("entities").cast("string"), F.lit(" | **Attachments:** "), F.col("attachments").cast("string"), F.lit("\n"))
    head = lambda section, text, there: F.struct(F.lit(section).alias("section"), text.alias("line"), there.alias("there"))
    always, headings = F.lit(True), [F.lit(x) for x in INDEXES]
    heads = [head(0, F.concat(F.lit("# "), title, F.lit("\n")), always), head(1, counts, always), head(2, headings[0], always), head(4, headings[1], F.col("entities") > 0), head(6, headings[2], F.col("attachments") > 0)]
    own = units.select(*UNIT, F.explode(F.array(*heads)).alias("x"))
    rows = own.where("x.there").select(*UNIT, "x.section", F.lit("").alias("by"), "x.line", F.lit(None).cast("long").alias("conv_id"))
    rows = rows.unionByName(line(shown, 3, F.col("title"), F.concat(F.lit("- **"), "title", F.lit("** (`"), F.col("conv_id").cast("string"), F.lit("`) - "), F.col("messages").cast("string"), F.lit(" messages"))))
    rows = rows.unionByName(line(met(entities), 5, F.col("value"), F.concat(F.lit("- `"), "value", F.lit("` ("), "type", F.lit(")"))))
    rows = rows.unionByName(line(met(attachments), 7, F.coalesce("file_name", F.lit("attachment")), F.concat(F.lit("- `"), F.coalesce("file_name", F.lit("attachment")), F.lit("` ("), F.coalesce("media_type", F.lit("unknown")), F.lit(") - Summary: "), F.coalesce("summary", F.lit("")))))
    # The conversation parts equal lines of many conversations into ranges.
    return numbered(rows, UNIT, [F.col("section"), F.col("by"), F.col("line"), F.col("conv_id")], "place").select("place", "line", *UNIT)


def export_packages(conversations: DataFrame, messages: DataFrame, entities: DataFrame, attachments: DataFrame, permissions: DataFrame, folder: str, mode: str | None = BOTH, strict: bool = False) -> None:
    """Writes the packages of a mode to a new folder. Conversations: conv_id (each once), title, source, created, source_platform; messages: conv_id,
    msg_index, role, content; entities: conv_id, type, value; attachments: conv_id, file_name, media_type, summary; permissions: conv_id, can_read.
    Rows of conversations that are not there, or not shown, go into no package."""
    spark = conversations.sparkSession
    entities = entities.select("conv_id", "type", "value")
    entities.write.parquet(f"{folder}/_entities")  # read three times
    entities = spark.read.schema(entities.schema).parquet(f"{folder}/_entities")
    rows = exported(conversations, messages, entities, attachments, permissions, mode, strict)
    rows.write.parquet(f"{folder}/_exported")
    held = spark.read.schema(rows.schema).parquet(f"{folder}/_exported")
    shown = held.where("shown")
    packages = manifest(held, mode)
    parts = documents(shown, messages, entities)
    parts.repartitionByRange(*UNIT, "conv_id", "section", "at").sortWithinPartitions(*UNIT, "conv_id", "section", "at", "text").write.partitionBy(*UNIT).parquet(f"{folder}/documents")
    kept = shown.select(F.col("conv_id").cast("string").alias("id"), "title", "source", "created", F.col("messages").alias("message_count"), F.col("platform").alias("source_platform"), F.explode("units").alias("u"))
    kept.select("id", F.concat(safe_name(F.col("id")), F.lit(".json")).alias("file_name"), "title", "source", "created", "message_count", "source_platform", "u.*").write.partitionBy(*UNIT).json(f"{folder}/archive")
    index_lines(shown, entities, attachments, packages.where("kind <> 'root'")).write.partitionBy(*UNIT).parquet(f"{folder}/index")
    packages.write.json(f"{folder}/manifest")


def read_packages(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """documents, archive, index and manifest of an export; an error where its manifest is not there. A package that shows nothing has its index and manifest."""
    tables = {"manifest": spark.read.schema(SCHEMAS["manifest"]).json(f"{folder}/manifest")}
    for name in ("documents", "archive", "index"):
        read = spark.read.schema(SCHEMAS[name])
        tables[name] = read.json(f"{folder}/{name}") if name == "archive" else read.parquet(f"{folder}/{name}")
    return tables


# The queries: the given conversations in both modes, without those that an entry denies.

_GRANTED = "SELECT CAST(substring(scoped_id, 9) AS BIGINT) AS conv_id, can_read FROM v_permissions WHERE scoped_id LIKE 'folder|d%'"


def _read_back(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    folder = shared_folder(spark)
    found = run_sql(spark, sf_dir, f"SELECT conv_id, type, value FROM ({entities(Dialect(SPARK))}) e")
    files = run_sql(spark, sf_dir, "SELECT conv_id, file_name, media_type, url AS summary FROM v_attachments")
    export_packages(view(spark, sf_dir, "v_conversations"), view(spark, sf_dir, "v_messages"), found, files, run_sql(spark, sf_dir, _GRANTED), folder, BOTH)
    return read_packages(spark, folder)


def sink_platform_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_back(spark, sf_dir)["manifest"].drop("exported_at")


def sink_package_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_back(spark, sf_dir)["documents"].select(*UNIT, "conv_id", "section", "at", F.sha2("text", 256).alias("text_sha"))


def sink_package_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_back(spark, sf_dir)["archive"]


def sink_package_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_back(spark, sf_dir)["index"]


QUERIES = {f.__name__: f for f in (sink_platform_packages, sink_package_documents, sink_package_archive, sink_package_index)}


def _steps() -> str:
    """The checks' steps: what is shown with its counts, and the packages by their names; the fixture's platforms are safe names already."""
    return f"""WITH found AS (SELECT conv_id, type, value FROM ({entities(Dialect(DUCK))}) e), n_found AS (SELECT conv_id, count(*) AS n FROM found GROUP BY conv_id),
n_said AS (SELECT conv_id, count(*) AS n FROM v_messages GROUP BY conv_id), n_files AS (SELECT conv_id, count(*) AS n FROM v_attachments GROUP BY conv_id),
seen AS (SELECT c.conv_id, coalesce(c.title, CAST(c.conv_id AS VARCHAR)) AS title, c.source, c.created, CASE WHEN c.source_platform <> '' THEN c.source_platform ELSE 'Unknown' END AS platform,
  coalesce(s.n, 0) AS messages, coalesce(f.n, 0) AS entities, coalesce(a.n, 0) AS attachments, c.conv_id NOT IN (SELECT conv_id FROM ({_GRANTED}) g WHERE can_read = false) AS shown
  FROM v_conversations c LEFT JOIN n_said s ON s.conv_id = c.conv_id LEFT JOIN n_found f ON f.conv_id = c.conv_id LEFT JOIN n_files a ON a.conv_id = c.conv_id),
copies AS (SELECT *, 'unified' AS kind, 'unified' AS package FROM seen UNION ALL SELECT *, 'platform', platform FROM seen),
sums AS (SELECT kind, package, CAST(count(*) FILTER (shown) AS BIGINT) AS conversations, CAST(coalesce(sum(messages) FILTER (shown), 0) AS BIGINT) AS messages, CAST(coalesce(sum(entities) FILTER (shown), 0) AS BIGINT) AS entities,
  CAST(coalesce(sum(attachments) FILTER (shown), 0) AS BIGINT) AS attachments, min(created) FILTER (shown) AS first_imported, max(created) FILTER (shown) AS last_imported FROM copies GROUP BY kind, package)"""


@R.add("sink_platform_packages")
def _(d: Dialect) -> str:
    rest = f"{', '.join(COUNTS)}, first_imported, last_imported, '{BOTH}' AS export_mode FROM sums"
    return f"""{_steps()} SELECT kind, package, CASE WHEN kind = 'unified' THEN 'Unified' ELSE package END AS platform_name, {rest}
UNION ALL SELECT 'root', '', package, {rest} WHERE kind = 'platform' AND conversations > 0 UNION ALL SELECT 'root', '', NULL, {rest} WHERE kind = 'unified'"""


@R.add("sink_package_documents")
def _(d: Dialect) -> str:
    gap = "concat(chr(10), chr(10))"
    return f"""{_steps()}, parts AS (SELECT conv_id, 0 AS section, 0 AS at, concat('# ', title, {gap}, '**ID:** `', conv_id, '` | **Source:** `', source, '`', {gap}) AS text FROM seen
UNION ALL SELECT conv_id, 1, 0, concat('## Entities', {gap}) FROM n_found UNION ALL SELECT conv_id, 2, 0, concat('- **', value, '** (', type, ')', chr(10)) FROM found
UNION ALL SELECT conv_id, 3, 0, concat(CASE WHEN conv_id IN (SELECT conv_id FROM n_found) THEN chr(10) ELSE '' END, '## Messages', {gap}) FROM seen
UNION ALL SELECT conv_id, 4, msg_index, concat('### ', upper(role[1]), lower(role[2:]), {gap}, coalesce(content, ''), {gap}) FROM v_messages)
SELECT c.kind, c.package, p.conv_id, CAST(p.section AS INTEGER) AS section, CAST(p.at AS BIGINT) AS at, sha256(p.text) AS text_sha FROM parts p JOIN copies c ON c.conv_id = p.conv_id WHERE c.shown"""


@R.add("sink_package_archive")
def _(d: Dialect) -> str:
    return f"{_steps()} SELECT kind, package, CAST(conv_id AS VARCHAR) AS id, concat(conv_id, '.json') AS file_name, title, source, created, messages AS message_count, platform AS source_platform FROM copies WHERE shown"


@R.add("sink_package_index")
def _(d: Dialect) -> str:
    heads = [(0, "concat('# ', CASE WHEN kind = 'unified' THEN 'Unified Knowledge Base' ELSE concat(package, ' Knowledge Package') END, chr(10))", "true")]
    heads += [(1, "concat('**Conversations:** ', conversations, ' | **Entities:** ', entities, ' | **Attachments:** ', attachments, chr(10))", "true")]
    heads += [(2 * k + 2, f"concat(chr(10), '{t.strip()}', chr(10))", rule) for k, (t, rule) in enumerate(zip(INDEXES, ("true", "entities > 0", "attachments > 0")))]
    own = " UNION ALL ".join(f"SELECT kind, package, {k} AS section, '' AS name, {text} AS line FROM sums WHERE {rule}" for k, text, rule in heads)
    return f"""{_steps()}, lines AS ({own}
UNION ALL SELECT kind, package, 3, title, concat('- **', title, '** (`', conv_id, '`) - ', messages, ' messages') FROM copies WHERE shown
UNION ALL SELECT c.kind, c.package, 5, f.value, concat('- `', f.value, '` (', f.type, ')') FROM copies c JOIN found f ON f.conv_id = c.conv_id WHERE c.shown
UNION ALL SELECT c.kind, c.package, 7, a.file_name, concat('- `', a.file_name, '` (', a.media_type, ') - Summary: ', coalesce(a.url, '')) FROM copies c JOIN v_attachments a ON a.conv_id = c.conv_id WHERE c.shown)
SELECT kind, package, row_number() OVER (PARTITION BY kind, package ORDER BY section, name, line) - 1 AS place, line FROM lines"""
