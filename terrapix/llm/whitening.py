"""Whitening of embeddings on their leading principal components, by the distributed block matrices of Spark MLlib."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import materialise

ROWS_PER_BLOCK = 1024
BLOCK_COLUMNS = 512
MOST_BLOCKS = 1 << 16
"""The driver gets the coordinates of all blocks, so blocks of very large tables have more rows instead."""
BLOCKS_PER_TASK = 8
TASK_ENTRIES = 1 << 22
SCALE, OFFSET = 64, 1_000_000


@dataclass
class Whitening:
    """Of vectors of one length: their number, the sums of each dimension, the eigenvalues of the covariance (falling),
    its trace, and the unit eigenvectors as columns. ``rank`` eigenvalues are above rounding."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    rank: int


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``index``: 0, 1, ... over all rows, the same at every reading.

    Stored rows know their partition and their place in it; the sizes of the partitions, one small row each, shift them.
    """
    at = F.monotonically_increasing_id()  # the partition, then 33 bits of the place in it
    placed = materialise(rows.withColumn("at_", at), "vectors").withColumn("part_", F.shiftright("at_", 33))
    counts = placed.groupBy("part_").agg(F.count(F.lit(1)).alias("k_"))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("part_", F.coalesce(F.sum("k_").over(before), F.lit(0)).alias("shift_"))
    index = F.col("at_").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("shift_")
    return placed.join(materialise(shifts, "shifts"), "part_").withColumn("index", index).drop("part_", "at_", "shift_")


def _rows_per_block(n: int) -> int:
    return max(ROWS_PER_BLOCK, -(-n // MOST_BLOCKS))


def block_matrix(rows: DataFrame, n: int, dims: int, parts: int) -> BlockMatrix:
    """``rows`` (index below ``n``, vector as an array of doubles) as a distributed matrix in blocks; an index without a
    row is a row of zeros. ``parts`` are the partitions that ``rows`` are read in, and tasks hold ``TASK_ENTRIES``."""
    dense = rows.select(F.col("index").cast("long").alias("index"), array_to_vector("vector").alias("vector"))
    if (wanted := -(-n * dims // TASK_ENTRIES)) > parts:
        dense = dense.repartition(wanted)
    indexed = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(dense, "vector"), n, dims)
    return indexed.toBlockMatrix(_rows_per_block(n), min(dims, BLOCK_COLUMNS))


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """Transpose times matrix. The common dimension, the rows, is split over tasks of ``BLOCKS_PER_TASK`` row blocks,
    each of which sums its own products, so that only small matrices meet."""
    splits = max(1, -(-matrix.numRowBlocks // BLOCKS_PER_TASK))
    turned = matrix.transpose()._java_matrix_wrapper
    product = turned.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def _centred(x: str, sums: list[int], n: int):
    """x - S / n from the exact whole number n * x - S."""
    fixed = F.array(*[F.lit(s) for s in sums])
    return F.zip_with(F.col(x), fixed, lambda a, s: (a * n - s).cast("double") / n)


def centred_blocks(rows: DataFrame, n: int, sums: list[int], size: int, parts: int = 1) -> BlockMatrix:
    """Blocks of the centred ``rows`` (index below ``size``, x), ``n`` vectors of one length with the given sums."""
    return block_matrix(rows.select("index", _centred("x", sums, n).alias("vector")), size, len(sums), parts)


def fit_whitening(blocks: BlockMatrix, n: int, sums: list[int]) -> Whitening:
    """The components of all rows, from their centred blocks: scatter, then local eigenvectors."""
    covariance = scatter(blocks) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    least = max(values[0], 0.0) * len(sums) * np.finfo(float).eps
    return Whitening(n, sums, values, vectors, float(np.trace(covariance)), int((values > least).sum()))


def project(spark: SparkSession, blocks: BlockMatrix, model: Whitening, components: int) -> DataFrame:
    """(index, whitened): centred blocks times the whitening matrix of the first components. Blocks are whole, so an
    index without a row may come with zeros."""
    whitener = model.vectors[:, :components] / np.sqrt(model.values[:components])
    step = blocks.colsPerBlock
    cut = [whitener[k : k + step] for k in range(0, len(whitener), step)]
    parts = [((k, 0), DenseMatrix(len(x), components, x.flatten("F").tolist())) for k, x in enumerate(cut)]
    right = BlockMatrix(spark.sparkContext.parallelize(parts, 1), step, components, len(whitener), components)
    found = blocks.multiply(right).toIndexedRowMatrix()
    table = callMLlibFunc("getIndexedRows", found._java_matrix_wrapper._java_model)
    return table.select("index", vector_to_array("vector").alias("whitened"))


def whiten_embeddings(df: DataFrame, components: int = 32, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Whitened coordinates: one row per vector and component, up to ``components``.

    Entries c become whole numbers x = floor(64 c) + 1,000,000 (as Spark's long; n * x must stay below 2**63). All
    vectors are fitted: the covariance (divisor n) is that of rows centred before they are multiplied, its unit
    eigenvectors are the components, numbered from 1 by falling eigenvalue e. Returns the id, component, n, deviation
    (decimal: sum over dimensions of (n x - S)**2, exact), whitened (x - S / n on the component, over sqrt(e)),
    explained (e over the trace) and identity_error (greatest absolute entry of the whitened rows' covariance minus the
    identity).

    Vectors that are null or hold a null or non-finite entry are left out, as are empty ones, which have no component.
    Vectors of each other length are fitted and whitened by themselves. Components whose eigenvalue is zero but for
    rounding (fewer vectors than dimensions, constant dimensions) have null whitened values and stay out of the
    identity error; if all do, identity_error is null, and explained is null where the trace is 0. Repeated rows and
    null ids count like others; an empty table gives an empty one.
    """
    spark = df.sparkSession
    good = F.col(vec_col).isNotNull() & ~F.exists(vec_col, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    x = F.transform(vec_col, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + OFFSET)
    rows = df.where(good & (F.size(vec_col) > 0)).select(F.col(id_col).alias("key_"), x.alias("x"), F.size(vec_col).alias("dims"))
    rows = _numbered(rows)
    size, parts = rows.count(), rows.rdd.getNumPartitions()
    totals: dict[int, tuple[int, list[int]]] = {}
    flat = rows.select("dims", F.posexplode("x").alias("at", "c")).groupBy("dims", "at").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("s"))
    for r in sorted(flat.collect()):  # one row per length and dimension
        totals.setdefault(r.dims, (r.n, []))[1].append(r.s)
    found = None
    for dims, (n, sums) in totals.items():
        one = _whiten(rows.where(F.col("dims") == dims), n, sums, min(components, dims), size, parts)
        found = one if found is None else found.unionByName(one)
    if found is None:
        kind = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        found = rows.select("key_").join(spark.createDataFrame([], kind), F.lit(False))
    return found.withColumnRenamed("key_", id_col)


def _whiten(rows: DataFrame, n: int, sums: list[int], components: int, size: int, parts: int) -> DataFrame:
    blocks = centred_blocks(rows, n, sums, size, parts)
    model = fit_whitening(blocks, n, sums)
    used, error = min(components, model.rank), None
    fixed = F.array(*[F.lit(s) for s in sums])
    squares = F.zip_with("x", fixed, lambda a, s: (a * n - s).cast("decimal(19,0)"))
    total = F.aggregate(squares, F.lit(0).cast("decimal(38,0)"), lambda acc, d: (acc + d * d).cast("decimal(38,0)"))
    out = rows.select("key_", "index", total.alias("deviation"))
    if used:
        out = materialise(out.join(project(rows.sparkSession, blocks, model, used), "index"), "whitened")
        means = out.select(F.posexplode("whitened").alias("at", "w")).groupBy("at").agg(F.avg("w").alias("m")).orderBy("at").collect()
        centre = F.array(*[F.lit(r.m) for r in means])
        centred = out.select("index", F.zip_with("whitened", centre, lambda a, m: a - m).alias("vector"))
        error = float(np.abs(scatter(block_matrix(centred, size, used, parts)) / n - np.eye(used)).max())
    else:
        out = out.withColumn("whitened", F.array().cast("array<double>"))
    share = F.array(*[F.lit(max(float(v), 0.0) / model.trace if model.trace else None).cast("double") for v in model.values[:components]])
    row = lambda k: F.struct(k.alias("component"), F.get("whitened", k - 1).alias("whitened"), F.get(share, k - 1).alias("explained"))
    out = out.withColumn("c_", F.explode(F.transform(F.sequence(F.lit(1), F.lit(components)), row)))
    return out.select(
        "key_",
        F.col("c_.component").cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "c_.whitened",
        "c_.explained",
        F.lit(error).cast("double").alias("identity_error"),
    )
