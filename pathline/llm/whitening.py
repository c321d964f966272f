"""Embedding whitening with distributed block matrices.

1. Vectors become whole numbers, and rows are numbered without gaps. Their count and sums are
   exact, so every row is centred exactly: n x - S in whole numbers, then one division.
2. Centred rows are gathered by number into blocks of a megabyte; blocks are a written table
   and the entries of a BlockMatrix. The transpose times the matrix is the scatter: blocks
   are dealt to shares of the middle dimension, and only sums of d x d leave a share.
3. Its eigenvectors come from one local decomposition of d x d numbers, whatever the number of rows.
4. The block matrix times the whitening matrix projects all rows; they are written, and their
   own covariance, found the same way, is compared with the identity.

MLlib deals the product of a tall matrix to about the square root of its partitions, and
numbers rows with 32 bits. So step 4 takes the blocks in matrices of bounded size, whose
products are united; step 2 has a partition for each share and needs no such cut.

Only the d sums, the d x d scatter and the row counts of the scan's tasks come to the driver.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.mllib.linalg import DenseMatrix, Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathline.llm.batches import settle

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Numbers of a block, 8 bytes each; blocks of a matrix that is projected.
BLOCK, MATRIX = 1 << 17, 4096
#: Eigenvalues below this share of the largest are rounding.
_ROUNDING = 1e-12


def whole_numbers(embeddings: DataFrame) -> DataFrame:
    """vec_id, x (floor(64 c) + 1000000 of each entry), for rows whose vector is there, as are all its entries, and finite.

    All vectors of a matrix have one length: the one that most of them have (of equals the larger); others are left out.
    """
    c = F.col("embedding").cast("array<double>")
    sound = F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), c.alias("c")).filter(F.col("c").isNotNull()).filter(sound)
    sizes = rows.groupBy(F.size("c").alias("d")).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "d")).alias("m")).first()
    d = sizes.m.d if sizes.m else 0
    return rows.filter(F.size("c") == d).select("vec_id", F.transform("c", lambda v: F.floor(v * SCALE).cast("long") + SHIFT).alias("x"))


def numbered(rows: DataFrame) -> DataFrame:
    """rows (read from files) with `index` from 0 on without gaps: the place in the task after all rows of the tasks before."""
    task = F.spark_partition_id()
    sizes = {r.task: r.n for r in rows.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for k in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(k, 0)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("index", F.lit(before or [0])[task] + place)


def sums(rows: DataFrame, column: str) -> list:
    """The sum of each place of an array column, exact for whole numbers."""
    each = rows.select(F.posexplode(column).alias("k", "v")).groupBy("k").agg(F.sum("v").alias("s"))
    return [r.s for r in each.orderBy("k").collect()]


def blocks(rows: DataFrame, column: str, d: int, size: int) -> DataFrame:
    """block, keys (array of the other columns, in order of rows), numbers (row by row): so many rows as one; rows have an
    `index` without gaps and an array column of d doubles. A block is all that a group holds."""
    rest = [c for c in rows.columns if c != column]
    row = F.struct(F.col("index"), F.struct(*rest).alias("key"), F.col(column).alias("row"))
    groups = rows.groupBy(F.floor(F.col("index") / size).cast("int").alias("block")).agg(F.sort_array(F.collect_list(row)).alias("r"))
    return groups.select("block", F.col("r.key").alias("keys"), F.flatten("r.row").alias("numbers"))


def matrix_of(table: DataFrame, d: int, size: int, first: int = 0) -> BlockMatrix:
    """The BlockMatrix of a table of blocks, counted from block `first`."""
    entry = lambda r: ((r.block - first, 0), DenseMatrix(len(r.numbers) // d, d, r.numbers, isTransposed=True))
    return BlockMatrix(table.select("block", "numbers").rdd.map(entry), size, d)


def scatter(matrix: BlockMatrix, shares: int) -> np.ndarray:
    """The transpose times the matrix, whose middle dimension is dealt to so many shares."""
    other = matrix._java_matrix_wrapper
    product = matrix.transpose()._java_matrix_wrapper.call("multiply", other._java_model, shares)
    d = matrix.colsPerBlock
    return BlockMatrix(product, d, d).toLocalMatrix().toArray()


def projected(table: DataFrame, w: np.ndarray, size: int, n_blocks: int, most: int = MATRIX) -> DataFrame:
    """index and y (array) of each row of a table of blocks: its product with w (d x k)."""
    d, k = w.shape
    spark, parts = table.sparkSession, []
    right = BlockMatrix(spark.sparkContext.parallelize([((0, 0), Matrices.dense(d, k, w.ravel(order="F")))], 1), d, k)
    for first in range(0, n_blocks, most):
        some = table.filter((F.col("block") >= first) & (F.col("block") < first + most)) if n_blocks > most else table
        rows = matrix_of(some, d, size, first).multiply(right).toIndexedRowMatrix().rows
        vectors = rows.map(lambda r: (r.index, r.vector)).toDF(["index", "vector"])
        parts.append(vectors.select((F.col("index") + first * size).alias("index"), vector_to_array("vector").alias("y")))
    return reduce(DataFrame.union, parts)


def whitener(s: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(d x k whitening matrix, share of the variance of each component) of a scatter matrix of n rows, by falling eigenvalue.

    A component without variance (beyond rounding) cannot be scaled to one and is left out.
    """
    values, vectors = np.linalg.eigh((s + s.T) / (2 * n))
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > max(0.0, _ROUNDING * float(values.max(initial=0.0)))]
    return vectors[:, order] / np.sqrt(values[order]), values[order] / np.trace(s / n)


def whiten(embeddings: DataFrame, components: int = COMPONENTS, block: int = BLOCK, matrix: int = MATRIX) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for each sound row and component.

    Rows are dropped if their vector is null or holds a null, NaN or infinite entry (see `whole_numbers` for vectors of
    other lengths). Repeated rows and vec_ids, and a null vec_id, are rows like any other. Where vectors vary in fewer
    directions than asked for, there are only so many components; without any variance, or without rows, no row is
    returned. Entries whose square sums do not fit a long end the query with an overflow error.
    """
    spark = embeddings.sparkSession
    none = spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    rows = settle(whole_numbers(embeddings), "vectors")
    n = rows.count()
    s = sums(rows, "x") if n else []
    d = len(s)
    if not d:
        return none
    size = max(1, block // d)
    off = F.zip_with("x", F.lit(s), lambda x, t: x * F.lit(n).cast("long") - t)
    squares = F.aggregate("off", F.lit(0).cast("long"), lambda a, v: a + v * v)
    centred = numbered(rows).select("vec_id", "index", off.alias("off")).select("vec_id", "index", squares.alias("deviation"), F.transform("off", lambda v: v.cast("double") / n).alias("row"))
    table = settle(blocks(centred, "row", d, size), "blocks")
    shares = max(1, table.rdd.getNumPartitions())
    w, explained = whitener(scatter(matrix_of(table, d, size), shares), n, components)
    k = w.shape[1]
    if not k:
        return none
    white = settle(projected(table, w, size, -(-n // size), matrix), "whitened")
    mean = F.lit([v / n for v in sums(white, "y")])
    level = white.select("index", F.zip_with("y", mean, lambda y, m: y - m).alias("y"))
    checked = settle(blocks(level, "y", k, size), "checked")
    error = float(np.abs(scatter(matrix_of(checked, k, size), shares) / n - np.eye(k)).max())
    keys = table.select(F.explode("keys").alias("key")).select("key.*")
    each = keys.join(white, "index").select("vec_id", "deviation", F.posexplode("y").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.lit(explained.tolist())[F.col("at")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    """`whiten` of embeddings, 32 components; rows with a null vector, or a null or non-finite entry in it, are dropped."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
