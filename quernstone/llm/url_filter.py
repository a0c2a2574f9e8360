"""URL filters: rules on host and path, and logistic regression on hashed character n-grams for the rest.

The regression is trained on a small labelled table of URLs, whose words are those that block lists name. Hosts and paths are
read as characters once; their n-grams of three to five, digits folded, are hashed into a fixed number of dimensions.

Defined results: a null URL, or one without "://", has empty host and path, fits no rule and is judged like any other
by the regression, which has only its intercept then; equal rows get equal results; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, let, text_or_empty

DIMENSIONS, GRAMS, PENALTY = 4096, (3, 4, 5), 0.01
#: Words that block lists name, and the names made of each; the pages' own names are not among them.
BLOCKED_WORDS = "spam pill pills casino bets betting adult xxx porn ads adserver tracker track poker jackpot lottery malware phish replica viagra payday loans prizes escort torrent warez".split()
BLOCKED_FORMS = ("{}-online", "best-{}", "my{}", "{}shop", "{}-club")
#: Ordinary names, among them some that hold a blocked word by chance; hosts are made of them by turns.
ALLOWED_NAMES = (
    "riverside gardening thunder history mathematics physics library theatre northern weather thread recipes ethics station hearth another nation school breath stone "
    "meadow shadow alphabet window pillow freedom trackside farming cheaper winter between trading masterclass mountain edition theory intention others thinker "
    "the-garden old-town city-news long-walk open-data green-house health heating method rather athens hands handle tension station-wagon reading ocean harbour sand island "
    "kitchen painting sailing cinema museum forest village planet orchestra science teacher student journal review archive atlas bridge market street garden letters poetry"
).split()
ALLOWED_FORMS = ("{}", "{}-online", "best-{}", "my{}", "{}shop", "{}-club")
BEFORE, BEHIND = ("", "www.", "m.", "blog."), (".test-a.com", ".test-b.net", ".test-c.org")
PATHS = ("/en/12", "/de/7.html", "/fr/403/", "/es/88", "/", "")


def hosts(words: list[str], forms: tuple[str, ...]) -> list[str]:
    """Each word in each form, under every beginning and domain, so that these decide nothing."""
    return [before + form.format(word) + behind for word in words for form in forms for before in BEFORE for behind in BEHIND]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """url, blocked: every host with one of the paths, by turns; blocked and allowed words stand in the same forms, so that the words decide."""
    sides = [F.struct(F.split(F.lit(" ".join(h)), " ").alias("hosts"), F.lit(y).alias("blocked")) for y, h in ((1.0, hosts(BLOCKED_WORDS, BLOCKED_FORMS)), (0.0, hosts(ALLOWED_NAMES, ALLOWED_FORMS)))]
    rows = spark.range(1).select(F.inline(F.array(*sides))).select(F.explode("hosts").alias("host"), "blocked")
    # Beginnings and domains make twelve hosts of a name; a hash deals the paths so that each name meets them all.
    path = F.get(F.array(*map(F.lit, PATHS)), F.pmod(F.crc32(F.col("host").cast("binary")), F.lit(len(PATHS))).cast("int"))
    return rows.select("host", "blocked", path.alias("path")).select(F.concat(F.lit("https://"), "host", "path").alias("url"), "blocked")


def parts(url: str | Column = "url") -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path."""
    u = text_or_empty(url)
    rest = F.when(F.instr(u, "://") > 0, F.regexp_extract(u, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, like net/fr/: its host or a subdomain, and a path that starts like its own."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + rest)
        out = F.when(fits, rule) if out is None else out.when(fits, rule)
    return out if out is not None else F.lit(None).cast("string")


def _grams(text: Column, mark: str) -> Column:
    chars = F.split(F.regexp_replace(F.concat(F.lit("^"), text, F.lit("$")), r"[0-9]+", "0"), "")
    of = lambda c, n: F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.concat(F.lit(mark), *[F.get(c, i + k) for k in range(n)]))).otherwise(F.array().cast("array<string>"))
    return let(chars, lambda c: F.concat(*[of(c, n) for n in GRAMS]))


def with_grams(df: DataFrame) -> DataFrame:
    """host, path to grams; an empty host and path have none."""
    none = (F.col("host") == "") & (F.col("path") == "")
    grams = F.concat(_grams(F.col("host"), "h"), _grams(F.col("path"), "p"))
    return df.withColumn("grams", F.when(none, F.array().cast("array<string>")).otherwise(grams))


def train(spark: SparkSession, labelled: DataFrame | None = None):
    from pyspark.ml import Pipeline  # only where needed: these modules are large
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF

    labelled = labelled_urls(spark) if labelled is None else labelled
    host, path = parts("url")
    rows = with_grams(labelled.select(host.alias("host"), path.alias("path"), "blocked"))
    tf = HashingTF(numFeatures=DIMENSIONS, binary=True, inputCol="grams", outputCol="features")
    return Pipeline(stages=[tf, LogisticRegression(labelCol="blocked", regParam=PENALTY, maxIter=60)]).fit(rows)


def judge_urls(pages: DataFrame, rules: dict[str, str], model=None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: id, host, path, rule, blocked_probability (the regression's), verdict (allow or block)."""
    from pyspark.ml.functions import vector_to_array

    model = train(pages.sparkSession) if model is None else model
    host, path = parts(url_col)
    rows = with_grams(pages.select(F.col(id_col), host.alias("host"), path.alias("path")))
    scored = model.transform(rows).withColumn("blocked_probability", F.get(vector_to_array("probability"), F.lit(1)))
    scored = scored.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    verdict = F.when(F.col("blocked_probability") >= 0.5, "block").otherwise("allow")
    for rule, v in rules.items():
        verdict = F.when(F.col("rule") == rule, v).otherwise(verdict)
    return scored.select(id_col, "host", "path", "rule", "blocked_probability", verdict.alias("verdict"))
