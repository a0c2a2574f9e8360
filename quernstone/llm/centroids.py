"""Clustering around centroids, each vector assigned by a tournament of bisectors.

Vectors are scaled to integers, so that everything is exact. For each pair of centroids a < b the driver sets up the integer
normal b - a and the threshold |b|^2 - |a|^2 of the plane between them; the sign of 2 x (b - a) - threshold tells which of both
is nearer. k - 1 such tests eliminate all losers, zero favours the smaller number, and only the winner's distance is computed. Tasks add
up their vectors by cluster before anything is shuffled; k sums reach the driver, which takes their floors.

Defined results: vectors of another length, null ones and those with a null or non-finite component are left out, as are those with a
scaled component of 2^27 and more, whose distances would not fit a long; equal rows are clustered like any others; rows
without id have no hash to begin a centroid and are assigned like others; rows of equal id begin as many centroids, in
the order of their components; with fewer vectors than k there are fewer centroids; an inertia beyond 64 bits is null; no rows give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SIZE, SCALE, K, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: With components below it, sums of 64 squared differences and the sign tests stay within 64 bits.
LARGEST = 1 << 27


class Bisectors:
    """Normals and thresholds of all pairs of centroids."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = np.array(centroids, dtype=np.int64)
        squares = (self.centroids**2).sum(1)
        self.normals = self.centroids[None, :, :] - self.centroids[:, None, :]
        self.thresholds = squares[None, :] - squares[:, None]

    def winners(self, x: np.ndarray) -> np.ndarray:
        best = np.zeros(len(x), dtype=np.int64)
        for rival in range(1, len(self.centroids)):
            sign = 2 * np.einsum("ij,ij->i", x, self.normals[best, rival]) - self.thresholds[best, rival]
            best[sign > 0] = rival
        return best

    def distances(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        return ((x - self.centroids[cluster]) ** 2).sum(1)


def scaled(vectors: DataFrame, id_col: str, vector_col: str, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """id and `x`, the integer components of every vector that can be clustered."""
    v = F.col(vector_col)
    bound = F.lit(float(LARGEST))
    fine = F.forall(v, lambda c: F.coalesce((c.cast("double") * scale >= -bound) & (c.cast("double") * scale < bound), F.lit(False)))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return vectors.where((F.size(v) == size) & fine).select(F.col(id_col), x.alias("x"))


def _matrix(column: pa.ListArray, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(len(column), size)


def first_centroids(rows: DataFrame, id_col: str, k: int, seed: int) -> list[list[int]]:
    """The k vectors of smallest hash of seed and id; k rows reach the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    first = rows.select(key.alias("key"), "x").where("key IS NOT NULL").orderBy("key", "x").limit(k)
    return [list(r["x"]) for r in first.collect()]


def moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: each the floor of its vectors' mean, those without vectors as they are."""
    planes, size = Bisectors(centroids), len(centroids[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Components are below 2^27, so a task may add up 2^36 vectors.
        total, count = np.zeros((len(centroids), size), dtype=np.int64), np.zeros(len(centroids), dtype=np.int64)
        for b in batches:
            x = _matrix(b.column(0), size)
            cluster = planes.winners(x)
            for c in np.unique(cluster):
                mine = cluster == c
                total[c] += x[mine].sum(0)
                count[c] += mine.sum()
        numbers = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(count[numbers]), pa.array(total[numbers].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = rows.select("x").mapInArrow(sums, "cluster int, n long, total array<long>")
    by_place = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)]
    new = [list(c) for c in centroids]
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *by_place).collect():  # k rows at most
        new[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(size)]
    return new


def assigned(rows: DataFrame, centroids: list[list[int]], id_col: str) -> DataFrame:
    """rows with cluster and distance (squared)."""
    planes, size = Bisectors(centroids), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), size)
            cluster = planes.winners(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster, pa.int32()), pa.array(planes.distances(x, cluster))], names=[id_col, "cluster", "distance"])

    return rows.select(id_col, "x").mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, cluster int, distance long")


def clustered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """A row for each clustered vector (id, cluster, distance), written, and the final centroids."""
    rows = written(scaled(vectors, id_col, vector_col, size, scale))
    centroids = first_centroids(rows, id_col, k, seed)
    if not centroids:
        return rows.select(id_col, F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("false"), []
    for _ in range(rounds):
        new = moved(rows, centroids)
        if new == centroids:
            break  # nothing changes any more, in this round or in later ones
        centroids = new
    return written(assigned(rows, centroids, id_col)), centroids


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def with_inertia(found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """found with cluster_inertia, inertia and centroid_sha256."""
    spark = found.sparkSession
    by_cluster = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"))
    sums = {r["cluster"]: int(r["d"]) for r in by_cluster.collect()}  # k rows at most
    fits = lambda d: d if d < 1 << 63 else None
    facts = spark.createDataFrame([(c, fits(d), fits(sum(sums.values())), digest(centroids[c])) for c, d in sorted(sums.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster")  # a row for each of k clusters
