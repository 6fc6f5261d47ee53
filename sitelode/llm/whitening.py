"""Whitening of vectors by distributed block matrices: scatter, local eigenvectors, projection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, floor

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window, functions as F

from sitelode.session import materialize

SCALE = 256
COMPONENTS = 4
#: Bytes of a block of centred rows, blocks of one matrix, and blocks that one task should hold.
BLOCK_BYTES, STRIP_BLOCKS, TASK_BLOCKS = 2 << 20, 1024, 16
#: An eigenvalue below this share of the largest one is rounding, not a direction.
LEAST_SHARE = 1e-12


@dataclass(frozen=True)
class Whitening:
    """A fit over `n` vectors: sums per dimension, eigenvectors as columns with their eigenvalues, and the covariance's trace."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def mean(self) -> list[float]:
        return [s / self.n for s in self.sums]

    @property
    def matrix(self) -> np.ndarray:
        return self.axes / np.sqrt(self.values)


def usable(vector: Column) -> Column:
    """Whether a vector has entries, and only finite ones."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & (F.size(vector) > 0), F.lit(False))


def integral(vector: Column, scale: int = SCALE) -> Column:
    """Entries as whole numbers: floor(scale * entry); one beyond a long is the nearest long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * float(scale)).cast("bigint"))


def fit_list(vectors: DataFrame) -> DataFrame:
    """(dims, index, digest, x): each distinct x once, numbered gapless from 0 within its length.

    Copies are folded before the shuffle. Numbers come from places inside written parts, shifted by the counts of earlier
    parts, a table of at most parts x lengths rows.
    """
    distinct = vectors.groupBy("digest", "x").agg(F.lit(1).alias("_one")).select("digest", "x", F.size("x").alias("dims"))
    numbered = materialize(
        distinct.sortWithinPartitions("dims").withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "fit-rows"
    )
    runs = numbered.groupBy("dims", "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy("dims").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = runs.select("dims", "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    joined = numbered.join(shifts, ["dims", "_part"])
    return materialize(joined.select("dims", (F.col("_row") + F.col("_shift")).alias("index"), "digest", "x"), "fit-list")


def strips(rows: DataFrame, dims: int, n: int, mean: list[float]) -> Iterator[tuple[int, BlockMatrix]]:
    """The centred rows of a fit list as block matrices of at most STRIP_BLOCKS blocks, with the number of row blocks.

    A matrix's blocks are dealt to about blocks / sqrt(partitions) of a task, as one block column allows no other grid;
    so the rows of a strip come in enough partitions that a task holds TASK_BLOCKS of them, whatever n is.
    """
    height = max(1, BLOCK_BYTES // (8 * dims))
    centre = F.array(*[F.lit(m) for m in mean])
    for low in range(0, n, height * STRIP_BLOCKS):
        high = min(n, low + height * STRIP_BLOCKS)
        blocks = ceil((high - low) / height)
        centred = F.zip_with("x", centre, lambda x, m: x.cast("double") - m)
        strip = rows.filter((F.col("index") >= low) & (F.col("index") < high)).select(
            (F.col("index") - low).alias("index"), array_to_vector(centred).alias("vector")
        )
        parts = ceil((blocks / TASK_BLOCKS) ** 2)
        strip = strip.repartition(parts, "index") if parts > strip.rdd.getNumPartitions() else strip
        matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(strip, "vector"), high - low, dims)
        yield blocks, matrix.toBlockMatrix(height, dims)


def scatter(rows: DataFrame, dims: int, n: int, mean: list[float]) -> np.ndarray:
    """Sum of the outer products of the centred rows, dims x dims, from transposed block matrix times block matrix.

    The product is cut along the rows into groups of TASK_BLOCKS blocks, whose products are added up; uncut, all blocks
    would meet in one task, as the result is one block.
    """
    total = np.zeros((dims, dims))
    for blocks, matrix in strips(rows, dims, n, mean):
        wrapper = matrix.transpose()._java_matrix_wrapper  # multiply() of the Python class lacks the number of cuts
        product = wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, ceil(blocks / TASK_BLOCKS))
        total += BlockMatrix(product, dims, dims).toLocalMatrix().toArray()
    return total


def fit(rows: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening | None:
    """Principal directions of the covariance (divisor n) over (index, x) rows of one length; None without variance.

    Sums per dimension are exact whole numbers, added up before the shuffle; `dims` of them, and dims x dims products,
    reach the driver. Of each direction the entry of largest size is positive.
    """
    n = rows.count()
    entries = rows.select(F.posexplode("x").alias("dim", "value")).groupBy("dim")
    sums = tuple(int(r.total) for r in entries.agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("total")).orderBy("dim").collect())
    draft = Whitening(n, sums, np.empty((dims, 0)), np.empty(0), 0.0)
    covariance = scatter(rows, dims, n, draft.mean) / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    real = values > LEAST_SHARE * max(values[0], 0)
    if not real.any():
        return None
    axes = axes[:, real]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return Whitening(n, sums, axes, values[real], float(np.trace(covariance)))


def project(rows: DataFrame, dims: int, model: Whitening) -> DataFrame:
    """(index, whitened): centred rows times the whitening matrix, by block matrix multiplication."""
    sc = rows.sparkSession.sparkContext
    axes = model.matrix
    parts, low = None, 0
    local = DenseMatrix(dims, axes.shape[1], axes.ravel(order="F").tolist())
    whitener = BlockMatrix(sc.parallelize([((0, 0), local)], 1), dims, axes.shape[1])
    for _, matrix in strips(rows, dims, model.n, model.mean):
        product = matrix.multiply(whitener)
        found = callMLlibFunc("getIndexedRows", product.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
        strip = found.select((F.col("index") + low).alias("index"), vector_to_array("vector").alias("whitened"))
        parts = strip if parts is None else parts.unionByName(strip)
        low += matrix.numRows()
    return materialize(parts, "whitened")


def identity_error(projected: DataFrame, n: int, components: int) -> float:
    """Largest entry, by size, of the covariance of the whitened fit list minus the identity."""
    w = [F.get("whitened", F.lit(i)) for i in range(components)]
    means = [F.sum(x).alias(f"m{i}") for i, x in enumerate(w)]
    products = [F.sum(w[i] * w[j]).alias(f"p{i}_{j}") for i in range(components) for j in range(i, components)]
    row = projected.agg(*means, *products).first()
    return max(
        abs(row[f"p{i}_{j}"] / n - row[f"m{i}"] / n * row[f"m{j}"] / n - (i == j)) for i in range(components) for j in range(i, components)
    )


def deviation(model: Whitening) -> Column:
    """Sum over the dimensions of (n * x - sum)^2 in whole numbers; null where that is beyond a long."""
    sums = F.expr("array(" + ",".join(f"CAST({s}BD AS decimal(38,0))" for s in model.sums) + ")")
    gaps = F.zip_with("x", sums, lambda x, s: F.try_subtract(F.try_multiply(x.cast("decimal(19,0)"), F.lit(model.n).cast("decimal(19,0)")), s))
    square = lambda g: F.try_multiply(g.cast("decimal(38,0)"), g.cast("decimal(38,0)"))
    total = F.aggregate(gaps, F.lit(0).cast("decimal(38,0)"), lambda acc, g: F.try_add(acc, square(g)).cast("decimal(38,0)"))
    return total.try_cast("bigint")


def whiten(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Whitened coordinates: (key, component, n, deviation, whitened, explained, identity_error), one row per vector and component.

    Entries become whole numbers x (`integral`); the fit list is every distinct x once, n of them with sums S per dimension.
    Components are the first eigenvectors of its covariance, from 1 by falling eigenvalue e; `whitened` is
    (x - S/n) projected on one, by sqrt(e); `explained` is e by the trace; `deviation` is the exact sum of (n x - S)^2.
    Vectors that are null, empty or hold a null or non-finite entry are left out. Vectors of another length are a fit of
    their own. Directions without variance give no rows, so a single distinct vector gives none. Rows of equal
    vectors share one projected row; a null key is kept. No usable vectors give no rows. Other columns are not read.
    """
    spark = df.sparkSession
    listed = df.filter(usable(F.col(vector))).select(F.col(key).alias("_key"), integral(F.col(vector), scale).alias("x"))
    vectors = materialize(listed.withColumn("digest", F.unhex(F.sha2(F.array_join(F.transform("x", lambda v: v.cast("string")), ","), 256))), "vectors")
    fitted = fit_list(vectors.select("digest", "x"))
    parts = []
    for dims in sorted(r.dims for r in fitted.select("dims").distinct().collect()):
        rows = fitted.filter(F.col("dims") == dims).select("index", "digest", "x")
        model = fit(rows, dims, components)
        if model is None:
            continue
        projected = project(rows, dims, model)
        error = identity_error(projected, model.n, len(model.values))
        shares = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
        parts.append(
            rows.join(projected, "index").select(
                "digest", F.lit(model.n).cast("bigint").alias("n"), deviation(model).alias("deviation"), "whitened",
                shares.alias("shares"), F.lit(error).alias("identity_error"),
            )
        )
    schema = "digest binary, n bigint, deviation bigint, whitened array<double>, shares array<double>, identity_error double"
    known = spark.createDataFrame([], schema)
    for part in parts:
        known = known.unionByName(part)
    known = materialize(known, "whitened-fit")
    joined = vectors.select("_key", "digest").join(known, "digest")
    return joined.select("_key", "n", "deviation", "shares", "identity_error", F.posexplode("whitened").alias("_place", "whitened")).select(
        F.col("_key").alias(key), (F.col("_place") + 1).cast("int").alias("component"), "n", "deviation", "whitened",
        F.get("shares", F.col("_place")).alias("explained"), "identity_error",
    )
