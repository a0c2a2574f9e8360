"""The training-data queries with production parameters, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, centroids, exact, minhash, mixing, packing, quality_knn, quality_rules, sharding, suffixes, toxicity, url_filter, whitening
from .common import table

URL_RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def word_tokenizer_path() -> str:
    return importlib.import_module("public_tokenizers").path("word_bpe_49k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_rules.judge(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def remainder(n: int):
    """Of the checksum of the document's id, by which labels are held out."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(remainder(3) != 1).select("doc_id", "quality")
    got = quality_knn.knn_scores(table(spark, sf_dir, "documents"), labels)
    return got.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


TOXIC = 0.3


def learned_from(labels: DataFrame) -> DataFrame:
    """Labels of toxicity that are not held out."""
    return labels.where(remainder(4) != 2).select("doc_id", "toxic")


def scored_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return toxicity.toxic_scores(docs, learned_from(labels))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scored_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharding.shuffled_shards(table(spark, sf_dir, "documents"), 8)
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    pieces = packing.token_pieces(docs, word_tokenizer_path())
    digests = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack_pieces(digests).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_inertia(*centroids.clustered(table(spark, sf_dir, "embeddings")))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    public = importlib.import_module("public_tokenizers")
    path = public.path("byte_bpe_multi_50k.tiktoken")
    tokens = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), path, public.PATTERN), path)
    return tokens.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_quality_classifier, op3_toxicity, op4_minhash, op5_mixing, op6_url_filter, op7_exact_dedup, op8_sharding, op9_suffix_array, op10_packing, op11_whitening, op12_centroid_clustering, op13_byte_bpe)}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op7_exact_dedup": f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {_LOWERED} AS t FROM documents) WINDOW w AS (PARTITION BY t)""",
    "op5_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][rank % 3 + 1]::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM w WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN level > cap / weight THEN cap ELSE coalesce(max(CASE WHEN level > cap / weight THEN NULL ELSE level END) OVER (), 0) * weight END AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
j AS (SELECT d.*, source_size, target, epochs, floor(target - epochs * source_size + 1e-6) - coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, round(target, 3) AS target, (epochs * size + greatest(0, least(size, room)))::BIGINT AS taken FROM j""",
}


def _clustering_sql(k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """Assignments and moves as alternating tables, a row for each vector or centroid and component."""
    parts = [
        f"e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding AS v FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)",
        f"x AS MATERIALIZED (SELECT r, unnest(range({size})) AS i, CAST(floor({scale} * CAST(unnest(v) AS DOUBLE)) AS BIGINT) AS x FROM e)",
        f"f AS (SELECT r, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), list_transform(v, lambda c: floor({scale} * CAST(c AS DOUBLE)))) - 1 AS k FROM e WHERE vec_id IS NOT NULL QUALIFY k < {k})",
        "c0 AS MATERIALIZED (SELECT k, i, x AS c FROM f JOIN x USING (r))",
    ]
    for n in range(rounds + 1):
        near = f"SELECT r, k, sum((x - c) * (x - c))::BIGINT AS d FROM x JOIN c{n} USING (i) GROUP BY r, k"
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, k, d FROM ({near}) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)")
        if n < rounds:
            mean = f"SELECT k, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM x JOIN a{n} USING (r) GROUP BY k, i"
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT k, i, coalesce(((s - ((s % n) + n) % n) // n)::BIGINT, c) AS c FROM c{n} LEFT JOIN ({mean}) USING (k, i))")
    parts.append(f"t AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)")
    return f"""WITH {', '.join(parts)}
SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN e USING (r) JOIN t USING (k)"""


ORACLES["op12_centroid_clustering"] = _clustering_sql()
