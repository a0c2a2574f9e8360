"""Whitening of embeddings with distributed block matrices.

Vectors are scaled to integers, so that counts, sums and deviations are exact. Every row gets a number; of equal vectors, that with the
smallest number stands for all in the fit list. Centred vectors, indexed by these numbers, become a block matrix; its transpose
times itself is the scatter of the fit list, whose eigenvectors are found on the driver (its size is that of one vector,
squared). The block matrix of all rows times the whitening matrix gives every row's components.

Defined results: null vectors and those with a null or non-finite component are left out, as are those with a scaled component of
2^40 and more, and vectors of another length than most (the shorter of two lengths as frequent). Equal rows and rows without id are
whitened like any others. A component without variance has whitened 0 and explained 0 and is left out of the identity error;
vectors of fewer than the wanted components have as many as they are long. A deviation beyond 64 bits is null. No rows give no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
BLOCK_ROWS = 1024
LARGEST = float(1 << 40)
#: Eigenvalues under this share of the trace are no variance but rounding.
ROUNDING = 1e-12


@dataclass
class Fit:
    """What the driver knows of the fit list: its number of vectors, exact sums, falling eigenvalues, eigenvectors as columns, trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def means(self) -> list[float]:
        return [s / self.n for s in self.sums]

    def matrix(self, components: int) -> np.ndarray:
        """The whitening matrix: eigenvectors over the roots of their eigenvalues; zero where there is no variance."""
        e = self.values[:components]
        return self.vectors[:, :components] * np.where(e > 0, 1 / np.sqrt(np.where(e > 0, e, 1)), 0.0)


def scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """number, id and `x`, the integer components of each vector that can be whitened; written."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double") * scale) < LARGEST, F.lit(False)))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long") + shift)
    rows = written(vectors.where((F.size(v) > 0) & fine).select(F.monotonically_increasing_id().alias("at"), F.col(id_col).alias("id"), x.alias("x")))
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return rows.select(F.col("at").alias("number"), "id", "x")
    # A start for each task of the first job, a row each, turns places into numbers without gaps.
    part = F.shiftright("at", 33)
    starts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    starts = starts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    numbered = rows.withColumn("part", part).join(F.broadcast(starts), "part")  # at most a row for each input split
    numbered = numbered.select((F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("number"), "id", "x")
    return written(numbered.where(F.size("x") == sizes["d"]))


def _blocks(rows: DataFrame, values, size: int) -> BlockMatrix:
    """The block matrix whose rows are the arrays `values`, at the places `number`."""
    at = rows.select("number", array_to_vector(values).alias("v"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(at, "v"), 0, size).toBlockMatrix(BLOCK_ROWS, size)


def _tasks(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _scatter(blocks: BlockMatrix, tasks: int) -> np.ndarray:
    """The transpose times the matrix itself. Products of blocks are spread over so many tasks."""
    # The Python method does not pass the number of parts of the inner dimension on; without it one task adds up all products.
    parts = max(1, min(blocks.numRowBlocks, tasks))
    both = blocks.transpose()._java_matrix_wrapper.call("multiply", blocks._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(both, blocks.colsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()


def _minus(values, means: list[float]):
    return F.zip_with(values, F.array(*[F.lit(m) for m in means]), lambda v, m: v.cast("double") - m)


def fitted(rows: DataFrame) -> tuple[Fit | None, DataFrame]:
    """The fit over distinct vectors of rows, and the numbers of those that stand for them."""
    chosen = written(rows.groupBy("x").agg(F.min("number").alias("number")))
    size = rows.select(F.size("x")).first()
    if size is None:
        return None, chosen
    sums = chosen.agg(F.count("*").alias("n"), *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(size[0])]).first()
    n, s = sums["n"], [sums[f"s{i}"] for i in range(size[0])]
    cov = _scatter(_blocks(chosen, _minus("x", [a / n for a in s]), size[0]), _tasks(rows)) / n
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    trace = float(np.trace(cov))
    values = np.where(values > ROUNDING * trace, values, 0.0)
    return Fit(n, s, values[::-1], vectors[:, ::-1], trace), chosen.select("number")


def projected(rows: DataFrame, fit: Fit, components: int = COMPONENTS) -> DataFrame:
    """number and `z`, the whitened components of every row; written."""
    w = fit.matrix(components)
    local = DenseMatrix(w.shape[0], w.shape[1], w.flatten(order="F").tolist())
    spark = rows.sparkSession
    matrix = BlockMatrix(spark.sparkContext.parallelize([((0, 0), local)], 1), w.shape[0], w.shape[1])
    found = _blocks(rows, _minus("x", fit.means), w.shape[0]).multiply(matrix).toIndexedRowMatrix()
    # Places without a row are zero rows of the matrix; the join by number leaves them out.
    return written(spark.createDataFrame(found.rows.map(lambda r: (r.index, r.vector.toArray().tolist())), "number long, z array<double>"))


def identity_error(z: DataFrame, chosen: DataFrame, fit: Fit, components: int = COMPONENTS) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    size = min(components, len(fit.sums))
    mine = written(z.join(chosen.hint("merge"), "number", "left_semi"))
    means = list(mine.agg(*[F.avg(F.col("z")[i]).alias(f"m{i}") for i in range(size)]).first())
    cov = _scatter(_blocks(mine, _minus("z", means), size), _tasks(z)) / fit.n
    kept = fit.values[:size] > 0
    return float(np.abs(cov - np.eye(size))[np.ix_(kept, kept)].max()) if kept.any() else 0.0


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """One row per remaining row of vectors and component: id, component (from 1), n, deviation, whitened, explained, identity_error."""
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = scaled(vectors, id_col, vector_col, scale, shift)
    fit, chosen = fitted(rows)
    if fit is None:
        shape = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], shape)
    z = projected(rows, fit, components)
    error = identity_error(z, chosen, fit, components)
    explained = [float(e / fit.trace) if fit.trace > 0 else 0.0 for e in fit.values[:components]]
    off = F.zip_with("x", F.array(*[F.lit(s) for s in fit.sums]), lambda x, s: fit.n * x - s)
    square = F.aggregate(off, F.lit(0).cast("decimal(38,0)"), lambda a, d: (a + d.cast("decimal(19,0)") * d.cast("decimal(19,0)")).cast("decimal(38,0)"))
    exact = rows.select("number", F.col("id").alias(id_col), square.try_cast("long").alias("deviation"))
    out = exact.join(z.hint("merge"), "number").select(id_col, "deviation", F.posexplode("z").alias("at", "whitened"))
    return out.select(
        id_col, (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened",
        F.array(*[F.lit(e) for e in explained])[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"),
    )
