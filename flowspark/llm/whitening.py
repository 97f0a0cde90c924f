"""Embedding whitening with Spark MLlib's BlockMatrix.

Every entry c of a vector becomes the whole number floor(grid * c) + shift, so sums and
deviations are exact. Rows are numbered within the task that stored them; part and number give
a row's index in a distributed matrix, cut into dense blocks. The steps:

1. Sums per dimension, partial in each task, whole numbers throughout.
2. Centred rows (n * x - S) / n as an IndexedRowMatrix, then a BlockMatrix A; the scatter is A' * A, with
   the middle dimension split so that blocks are multiplied where they lie and only d x d
   products meet. Rows are taken in slabs of at most BLOCKS blocks, since MLlib plans a product
   block by block on the driver; the scatter is the sum over slabs.
3. `eigh` of the d x d covariance on the driver.
4. A * W per slab, W the leading eigenvectors over the roots of their eigenvalues.

The driver holds d x d numbers and the plan of one slab, whatever the number of rows.

Defined cases: a vector that is null, empty or holds null, NaN, infinite entries or entries too large for a
64-bit whole number on the grid is left out; so is one shorter than the longest (its missing entries count as null);
null and repeated ids and repeated rows stay; a component without variance (eigenvalue at most
1e-12 of the largest) is 0 for all rows and no part of the identity error; no rows left give an empty table; other columns
are not looked at. `deviation` is null beyond 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import save

GRID, SHIFT = 1024, 100_000
COMPONENTS = 8
BLOCKS = 8192                 # row blocks of one product, planned by the driver
BLOCK_ENTRIES = 1 << 20       # of a dense block: 8 MB
LEAST_VARIANCE = 1e-12        # of the largest, else a component has none
_LOW = (1 << 32) - 1
RESULT = "vec_id {id}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def on_grid(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(part, place, vec_id, x) of all usable vectors, stored: part and place name a row for good."""
    entries = F.col(vector)
    large = float(1 << 62) / GRID
    unusable = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) >= large))
    rows = table.where(entries.isNotNull() & (F.size(entries) > 0) & ~unusable)
    number = F.monotonically_increasing_id()
    return save(rows.select(
        F.spark_partition_id().alias("part"), number.bitwiseAND((1 << 33) - 1).alias("place"), F.col(vec_id).alias("vec_id"),
        F.transform(entries, lambda c: F.floor(c.cast("double") * GRID).cast("long") + SHIFT).alias("x")), "grid")


def _table(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def dimension_sums(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of each dimension; the halves of a number are summed apart, so nothing overflows."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            x = _table(batch, width)
            n, low, high = n + len(x), low + (x & _LOW).sum(0), high + (x >> 32).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(np.full(width, n)), pa.array(low), pa.array(high)],
                                             names=["dim", "n", "low", "high"])
    parts = rows.select("x").mapInArrow(add, "dim long, n long, low long, high long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    found = parts.groupBy("dim").agg(F.sum("n").alias("n"), wide("low"), wide("high")).collect()     # a row per dimension
    sums = {r["dim"]: (int(r["high"]) << 32) + int(r["low"]) for r in found}
    return (found[0]["n"] if found else 0), [sums[i] for i in range(width)] if found else []


def centred(rows: DataFrame, n: int, sums: list[int], part_rows: int, first_part: int = 0) -> DataFrame:
    """(index, part, place, vec_id, deviation, vector): the rows less their mean."""
    width, safe = len(sums), max(map(abs, sums)) < 1 << 61
    id_type = rows.schema["vec_id"].dataType

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.array(sums, dtype=np.int64 if safe else object)
        for batch in batches:
            x = _table(batch, width)
            if not len(x):
                continue
            size = max(abs(int(x.min())), abs(int(x.max())))
            exact = safe and size * n < 1 << 61
            d = (x if exact else x.astype(object)) * n - total
            if exact and int(np.abs(d).max()) ** 2 * width < 1 << 62:
                deviation = pa.array((d * d).sum(1)).cast(pa.decimal128(38, 0))
            else:
                whole = [sum(int(v) ** 2 for v in row) for row in d]
                deviation = pa.array([Decimal(v) if v < 10 ** 38 else None for v in whole], pa.decimal128(38, 0))
            mean_free = (d / n).astype(np.float64)
            vectors = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * width, pa.array(mean_free.ravel()))
            part, place = (batch.column(batch.schema.get_field_index(c)) for c in ("part", "place"))
            index = (part.to_numpy().astype(np.int64) - first_part) * part_rows + place.to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(index), part, place, batch.column(batch.schema.get_field_index("vec_id")), deviation, vectors],
                names=["index", "part", "place", "vec_id", "deviation", "vector"])
    return rows.mapInArrow(move, f"index long, part int, place long, vec_id {id_type.simpleString()}, deviation decimal(38,0), vector array<double>")


def _blocks(rows: DataFrame, n: int, sums: list[int], parts: range, part_rows: int, block_rows: int) -> BlockMatrix:
    """The centred rows of some parts as a matrix; places without a row are rows of zeros or blocks left out."""
    mine = rows.where(F.col("part").between(parts.start, parts.stop - 1))
    vectors = centred(mine, n, sums, part_rows, parts.start).select("index", array_to_vector("vector").alias("vector"))
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), len(parts) * part_rows, len(sums))
    return matrix.toBlockMatrix(block_rows, len(sums))


def _scatter(a: BlockMatrix, splits: int) -> np.ndarray:
    turned = a.transpose()
    product = turned._java_matrix_wrapper._java_model.multiply(a._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, turned.rowsPerBlock, a.colsPerBlock).toLocalMatrix().toArray()


def whiten(table: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row per usable vector and component: its whitened value, the share of variance, and the measured error of the whole."""
    spark = table.sparkSession
    rows = on_grid(table, vec_id, vector)
    width, last_part, most = rows.agg(F.max(F.size("x")), F.max("part"), F.max("place")).first()
    empty = spark.createDataFrame([], RESULT.format(id=rows.schema["vec_id"].dataType.simpleString()))
    if width is None:
        return empty
    rows = rows.where(F.size("x") == width)
    n, sums = dimension_sums(rows, width)
    part_blocks = -(-(most + 1) * width // BLOCK_ENTRIES)
    block_rows = -(-(most + 1) // part_blocks)
    part_rows, step = part_blocks * block_rows, max(1, BLOCKS // part_blocks)
    slabs = [range(at, min(at + step, last_part + 1)) for at in range(0, last_part + 1, step)]

    def blocks(parts: range) -> BlockMatrix:
        return _blocks(rows, n, sums, parts, part_rows, block_rows)

    covariance = reduce(np.add, (_scatter(blocks(parts), len(parts) * part_blocks) for parts in slabs)) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors, trace = values[order], vectors[:, order], float(np.trace(covariance))
    used = values > LEAST_VARIANCE * max(float(values[0]), 0.0)
    weights = np.where(used, vectors / np.sqrt(np.where(used, values, 1.0)), 0.0)
    w = DenseMatrix(width, len(order), weights.ravel(order="F").tolist())

    def project(parts: range) -> DataFrame:
        right = BlockMatrix(spark.sparkContext.parallelize([((0, 0), w)], 1), width, len(order), width, len(order))
        product = blocks(parts).multiply(right).toIndexedRowMatrix()
        found = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
        mine = rows.where(F.col("part").between(parts.start, parts.stop - 1))
        known = centred(mine, n, sums, part_rows, parts.start).select("index", "vec_id", "deviation")
        return save(known.join(found.select("index", vector_to_array("vector").alias("whitened")), "index"), "whitened")

    projected = reduce(DataFrame.unionByName, [project(parts) for parts in slabs])
    pairs = [(i, j) for i in range(len(order)) for j in range(i, len(order)) if used[i] and used[j]]
    found = projected.agg(F.lit(0.0), *[F.covar_pop(F.get("whitened", F.lit(i)), F.get("whitened", F.lit(j))) for i, j in pairs]).first()
    error = max([0.0, *(abs(v - (i == j)) for v, (i, j) in zip(found[1:], pairs, strict=True))])
    explained = F.array(*[F.lit(float(v) / trace if trace > 0 else 0.0) for v in values])
    return projected.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(float(error)).alias("identity_error"))
