"""Ranking of objects and chunks for many requests: shared tokens, lexical hits, hybrid and vector scores.

Objects and chunks are cut into tokens once. Requests' tokens are sent to every task if they are few enough, else shuffled; either way
an object's tokens meet them where its row is, are added up there, and the best of each task go on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.dialect import SPARK, Dialect
from ..plans.numbering import numbered
from ..streaming.folders import shared_folder
from ..views import run_sql
from .search import EVERY, TOP, chunks, code_points

#: Rows of requests' tokens that are sent to every task, some 100 bytes each; more are shuffled.
SENT_ROWS = 200_000
QUERIES_A_BLOCK, VECTORS_A_BLOCK = 500, 2000
#: Weights of the hybrid score, and the vectors' step and length.
VECTOR_WEIGHT, LEXICAL_WEIGHT = 0.6, 0.4
SCOPE = ["tenant_id", "silo_id"]


def written(df: DataFrame) -> DataFrame:
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent(rows: DataFrame) -> DataFrame:
    """rows, written, to be joined: broadcast if they are at most SENT_ROWS, else merged."""
    held = written(rows)
    return F.broadcast(held) if held.count() <= SENT_ROWS else held.hint("merge")


def ranked(found: DataFrame, order: list, k: int, by: str = "item_id") -> DataFrame:
    """The first k of each request with their place; Spark keeps the first k of each task before it brings a request's rows together."""
    return found.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= k)


def _requests(spark: SparkSession, sf_dir: str, tokens: str) -> DataFrame:
    """item_id, tenant_id, silo_id, token, n (distinct tokens of the request)."""
    rows = run_sql(spark, sf_dir, f"SELECT item_id, concat('t', CAST(item_id % 3 AS STRING)) AS tenant_id, concat('s', CAST(item_id % 2 AS STRING)) AS silo_id, {tokens} AS tokens FROM benchmark")
    return rows.select("item_id", *SCOPE, F.explode("tokens").alias("token"), F.size("tokens").alias("n"))


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, object_id, ord, shared, asked: distinct tokens that a request shares with an object of its scope that is not denied."""
    d = Dialect(SPARK)
    asked = sent(_requests(spark, sf_dir, d.tokens("text")))
    denied = sent(run_sql(spark, sf_dir, "SELECT DISTINCT s.object_id FROM v_object_sources s JOIN v_permissions p ON p.scoped_id = s.scoped_id WHERE p.can_read = false"))
    objects = run_sql(spark, sf_dir, f"SELECT object_id, ord, tenant_id, silo_id, {d.tokens('content')} AS tokens FROM v_objects").join(denied, "object_id", "left_anti")
    # The outer form, since the plain one has the planner cut texts again to see whether there is any token.
    met = objects.select("object_id", "ord", *SCOPE, F.explode_outer("tokens").alias("token")).join(asked, ["token", *SCOPE])
    return met.groupBy("item_id", "object_id", "ord").agg(F.count("*").alias("shared"), F.max("n").alias("asked"))


def _by_shared() -> list:
    return [F.desc("shared"), F.col("ord")]


def overlap_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(overlaps(spark, sf_dir).where("10 * shared >= asked"), _by_shared(), TOP).select("item_id", "object_id", "shared", "place")


def retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(overlaps(spark, sf_dir), _by_shared(), TOP).select("item_id", "object_id", "place")


def governed(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = ranked(overlaps(spark, sf_dir), _by_shared(), TOP).select("item_id", "object_id")
    whole = run_sql(spark, sf_dir, "SELECT object_id, source_platform IS NOT NULL AND source_file IS NOT NULL AS provenance_complete FROM v_objects")
    return best.join(whole.hint("shuffle_hash"), "object_id").select("item_id", "object_id", "provenance_complete")


def intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(spark, sf_dir).where("2 * shared >= asked").select("item_id", "object_id", "shared")


def lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a request's distinct terms stand in a document."""
    d = Dialect(SPARK)
    terms = d.matches("lower(text)", "[^ ]+")
    asked = sent(run_sql(spark, sf_dir, f"SELECT item_id, explode(array_distinct({terms})) AS term FROM benchmark"))
    words = run_sql(spark, sf_dir, f"SELECT doc_id, explode_outer({terms}) AS term FROM documents")
    return words.join(asked, "term").groupBy("item_id", "doc_id").agg(F.count("*").alias("hits"))


def _cosine(a, b):
    """Of two character vectors by their first components: sums over 128 components, each a hundredth more than the one before."""
    dot = lambda x, y: 128 * x * y + F.lit(81.28) * (x + y) + F.lit(69.088)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, object_id, ord, k, score, confidence of chunks in a request's scope. Not every chunk is scored, but none of the first TOP of a
    request is left out: one without a shared term comes after TOP others that have as high a cosine or stand before it."""
    d = Dialect(SPARK)
    terms, level = lambda x: d.matches(f"lower({x})", r"[^\x09-\x0D\x20]+"), lambda x: f"CAST((({code_points(d, x)}) % 100) / 100.0 AS DOUBLE)"
    held = run_sql(spark, sf_dir, f"SELECT object_id, ord, k, tenant_id, silo_id, source_platform IS NOT NULL AS sourced, {level('body')} AS v, {terms('body')} AS words FROM ({chunks(d)}) c")
    held = written(held.withColumn("chunk", F.monotonically_increasing_id()))
    bare = held.select("chunk", "object_id", "ord", "k", *SCOPE, "sourced", "v", F.size("words").alias("n_words"))
    items = written(run_sql(spark, sf_dir, f"SELECT item_id, concat('t', CAST(item_id % 3 AS STRING)) AS tenant_id, concat('s', CAST(item_id % 2 AS STRING)) AS silo_id, {level('text')} AS asked FROM benchmark"))
    asked = sent(_requests(spark, sf_dir, f"array_distinct({terms('text')})").drop("n"))
    # A chunk's words meet the requests' terms and are added up by request where the chunk is; only these sums are shuffled.
    hits = held.select("chunk", *SCOPE, F.explode("words").alias("token")).join(asked, ["token", *SCOPE]).groupBy("chunk", "item_id").agg(F.count("*").alias("hits"))
    # Chunks without a shared term: in each scope, the first of each level.
    early = ranked(bare.withColumn("level", F.concat_ws("/", *SCOPE, "v")), [F.col("ord"), F.col("k")], TOP, "level").drop("level", "place")
    near = early.join(items.hint("shuffle_hash"), SCOPE).withColumn("cosine", F.round(VECTOR_WEIGHT * _cosine(F.col("asked"), F.col("v")), 4))
    near = ranked(near, [F.desc("cosine"), F.col("ord"), F.col("k")], TOP).select("chunk", "item_id", F.lit(0).cast("long").alias("hits"))
    found = hits.unionByName(near).groupBy("chunk", "item_id").agg(F.max("hits").alias("hits"))
    facts = found.join(bare.hint("shuffle_hash"), "chunk").join(sent(items.select("item_id", "asked")), "item_id")
    score = F.round(VECTOR_WEIGHT * _cosine(F.col("asked"), F.col("v")) + LEXICAL_WEIGHT * F.col("hits") / F.col("n_words"), 4)
    return facts.select("item_id", "object_id", "ord", "k", score.alias("score"), F.when(F.col("sourced"), 0.95).otherwise(0.7).alias("confidence"))


def _by_score() -> list:
    return [F.desc("score"), F.col("ord"), F.col("k")]


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(hybrid(spark, sf_dir), _by_score(), TOP).select("item_id", "object_id", "k", "score", "confidence")


def hybrid_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(hybrid(spark, sf_dir), _by_score(), 3).select("item_id", "object_id", "k", "place")


def _matrix(ids: pa.Array, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
    return ids.to_numpy(zero_copy_only=False), x, np.sqrt((x * x).sum(axis=1))


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each pair of a block of queries and a block of vectors, the first TOP of each query."""
    for batch in batches:
        for row in range(batch.num_rows):
            q_ids, v_ids = (batch.column(c)[row].values for c in (0, 2))
            ids, queries, lengths = _matrix(q_ids, batch.column(1)[row].values)
            other, x, norms = _matrix(v_ids, batch.column(3)[row].values)
            scores = np.round(x @ queries.T / (norms[:, None] * lengths), 6)
            scores[other[:, None] == ids] = -np.inf
            least = np.partition(scores, -min(TOP, len(x)), axis=0)[-min(TOP, len(x))]
            at, q = np.nonzero((scores >= least) & (scores > -np.inf))
            order = np.lexsort((other[at], -scores[at, q], q))
            at, q = at[order], q[order]
            keep = np.arange(len(q)) - np.searchsorted(q, q) < TOP
            at, q = at[keep], q[keep]
            yield pa.RecordBatch.from_arrays([pa.array(ids[q], pa.int64()), pa.array(other[at], pa.int64()), pa.array(scores[at, q])], names=["query_id", "vec_id", "score"])


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by EVERY is a query against all. Queries and vectors are numbered and lie in blocks of bounded size, a
    row each; each block of vectors meets each block of queries in one job, the queries' blocks dealt out under as many salts as there are tasks."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def blocks(rows: DataFrame, size: int) -> DataFrame:
        placed = numbered(rows, [], [F.col("vec_id")], "at_").withColumn("block", F.floor(F.col("at_") / size))
        return placed.groupBy("block").agg(F.collect_list(F.struct("vec_id", "embedding")).alias("rows")).select("block", F.col("rows.vec_id").alias("ids"), F.col("rows.embedding").alias("vectors"))

    asked = written(blocks(vectors.where(f"vec_id % {EVERY} = 0"), QUERIES_A_BLOCK))
    n = asked.count()
    if not n:
        return vectors.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(1).alias("place")).where("false")
    held = written(blocks(vectors, VECTORS_A_BLOCK))
    met = held.select(F.pmod("block", F.lit(tasks)).alias("salt"), F.col("ids").alias("v_ids"), F.col("vectors").alias("v_vectors"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("block"))
    salted = asked.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tasks - 1).cast("long"))))
    pairs = met.join(salted.hint("merge"), ["block", "salt"]).select("ids", "vectors", "v_ids", "v_vectors")
    found = pairs.mapInArrow(_best, "query_id long, vec_id long, score double")
    return ranked(found, [F.desc("score"), F.col("vec_id")], TOP, "query_id").select("query_id", "vec_id", "place")


QUERIES = {
    "qry_overlap_retrieval": overlap_retrieval, "top_retrieval": retrieval, "qry_governed_context": governed, "set_intersect_tokens": intersections, "qry_lexical_score": lexical,
    "qry_hybrid_search": hybrid_search, "top_hybrid": hybrid_top, "qry_cosine": nearest,
}
