"""Whitening of embeddings with distributed block matrices.

Vectors become whole numbers, each distinct one counts once in the fit. Centred rows are numbered and dealt into
blocks; the transposed matrix times the matrix is the scatter, whose eigenvectors are found on the driver (its
size is the square of the number of components). A second product projects all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table
from tidemark.llm.neighbours import matrix_of

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Entries of this size and more count as non-finite: their whole numbers have no exact sums.
LARGEST = float(2**40)
#: Components of less than this share of the variance have no direction of their own.
LEAST_SHARE = 1e-11
#: Numbers in one block, rows of one block at most, blocks of the middle dimension that meet in one task.
BLOCK_CELLS, BLOCK_ROWS, BLOCK_COLUMNS, MIDDLE_BLOCKS = 2**18, 4_096, 1_024, 16
RESULT = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_numbers(vector: Column) -> Column:
    """floor(64 c) + 1000000 of each entry; null where the vector is null or an entry is null or not finite."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)
    wide = vector.cast("array<double>")
    return F.when(vector.isNotNull() & F.coalesce(F.forall(wide, finite), F.lit(False)), F.transform(wide, lambda c: F.floor(c * SCALE).cast("long") + OFFSET))


def numbered(frame: DataFrame, label: str) -> DataFrame:
    """The frame, stored, with `index` from 0 without gaps, whatever its keys: rows of earlier tasks, then place in the task.

    One row for each task that wrote is summed up and broadcast: two numbers a task.
    """
    place = F.col("_place")
    held = stored(frame.withColumn("_place", F.monotonically_increasing_id()), label).withColumn("_task", F.shiftright(place, 33))
    tasks = held.groupBy("_task").agg(F.count("*").alias("_rows"))
    before = tasks.select("_task", (F.sum("_rows").over(Window.orderBy("_task")) - F.col("_rows")).alias("_before"))
    return held.join(F.broadcast(before), "_task").withColumn("index", F.col("_before") + place.bitwiseAND(F.lit(2**33 - 1))).drop("_task", "_place", "_before")


def sums_of(fit: DataFrame) -> tuple[int, list[int]]:
    """Rows and exact sums of each dimension; one row of sums a task and dimension moves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = None, 0
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                total, rows = x.sum(axis=0) if total is None else total + x.sum(axis=0), rows + batch.num_rows
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(np.full(len(total), rows), pa.int64()), pa.array(total, pa.int64())], ["dimension", "rows", "total"])

    found = fit.select("x").mapInArrow(run, "dimension int, rows long, total long").groupBy("dimension").agg(F.sum("rows").alias("rows"), F.sum("total").alias("total")).orderBy("dimension").collect()
    return (found[0]["rows"] if found else 0), [r["total"] for r in found]


def centred(x: Column, n: int, sums: list[int]) -> Column:
    """x - S/n as doubles: the whole part is taken off exactly first."""
    whole = F.array(*[F.lit(s // n).cast("long") for s in sums])
    rest = F.array(*[F.lit((s % n) / n) for s in sums])
    return F.zip_with(F.zip_with(x, whole, lambda a, b: a - b), rest, lambda a, b: a.cast("double") - b)


def deviation(x: Column, n: int, sums: list[int]) -> Column:
    """Sum over dimensions of (n x - S) squared, exactly; null where it does not fit a long."""
    whole = F.array(*[F.lit(s // n).cast("long") for s in sums])
    rest = F.array(*[F.lit(s % n).cast("long") for s in sums])
    apart = F.zip_with(F.zip_with(x, whole, lambda a, b: a - b), rest, lambda a, b: F.try_subtract(F.try_multiply(a, F.lit(n).cast("long")), b))
    return F.aggregate(apart, F.lit(0).cast("long"), lambda total, d: F.try_add(total, F.try_multiply(d, d)))


def blocks_of(frame: DataFrame, rows: int, columns: int) -> BlockMatrix:
    """A block matrix of the columns index and centred."""
    vectors = MLUtils.convertVectorColumnsFromML(frame.select("index", array_to_vector("centred").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, rows, columns).toBlockMatrix(block_rows(columns), min(columns, BLOCK_COLUMNS))


def block_rows(columns: int) -> int:
    return max(64, min(BLOCK_ROWS, BLOCK_CELLS // columns))


def squared(matrix: BlockMatrix) -> np.ndarray:
    """The transposed matrix times the matrix, its long middle dimension dealt over many tasks, on the driver."""
    pieces = max(1, ceil(matrix.numRowBlocks / MIDDLE_BLOCKS))
    product = matrix.transpose()._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, pieces)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def projected(matrix: BlockMatrix, directions: np.ndarray, spark: SparkSession) -> BlockMatrix:
    """The matrix times a small one, which is dealt in blocks that fit its columns."""
    step = matrix.colsPerBlock
    parts = [((i, 0), DenseMatrix(len(d), d.shape[1], d.ravel(order="F").tolist())) for i, d in enumerate(directions[s : s + step] for s in range(0, len(directions), step))]
    return matrix.multiply(BlockMatrix(spark.sparkContext.parallelize(parts, 1), step, directions.shape[1], len(directions), directions.shape[1]))


def rows_of_matrix(matrix: BlockMatrix) -> DataFrame:
    """index, values."""
    rows = callMLlibFunc("getIndexedRows", matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.select(F.col("index"), vector_to_array("vector").alias("values"))


def directions_of(scatter: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whitening directions (columns), share of variance of each component, which components have a direction.

    Eigenvectors by falling eigenvalue; the largest entry of each is positive, so that reruns agree.
    """
    values, vectors = np.linalg.eigh((scatter + scatter.T) / (2 * n))
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None, :], 0) < 0, -1.0, 1.0)
    trace = float(np.trace(scatter)) / n
    explained = np.maximum(values, 0.0) / trace if trace > 0 else np.zeros(len(values))
    live = explained > LEAST_SHARE
    return vectors[:, live] / np.sqrt(values[live]), explained, live


def whitened_rows(rows: DataFrame, most: int, name: str) -> DataFrame:
    """One number of components: rows has vec_id and x of that length."""
    spark, kind = rows.sparkSession, rows.schema["vec_id"].dataType.simpleString()
    fit = numbered(rows.select("x").distinct(), f"fit-{name}")
    n, sums = sums_of(fit)
    if not n or not sums:
        return spark.createDataFrame([], RESULT.format(kind))
    width = len(sums)
    blocks = blocks_of(fit.withColumn("centred", centred(F.col("x"), n, sums)), n, width)
    directions, explained, live = directions_of(squared(blocks), n, most)
    shown = stored(numbered(rows, f"rows-{name}").withColumn("deviation", deviation(F.col("x"), n, sums)).withColumn("centred", centred(F.col("x"), n, sums)).drop("x"), f"centred-{name}")
    error, values = 0.0, None
    if directions.shape[1]:
        error = float(np.abs(squared(projected(blocks, directions, spark)) / n - np.eye(directions.shape[1])).max())
        values = rows_of_matrix(projected(blocks_of(shown, shown.count(), width), directions, spark))
    order = np.cumsum(live) - 1
    number = lambda i: F.get("values", F.lit(int(order[i]))) if live[i] else F.lit(None).cast("double")
    parts = F.array(*[F.struct(F.lit(i + 1).alias("component"), number(i).alias("whitened"), F.lit(float(explained[i])).alias("explained")) for i in range(len(explained))])
    met = shown.drop("centred") if values is None else shown.drop("centred").join(values, "index")
    return met.select("vec_id", "deviation", F.explode(parts).alias("part")).select("vec_id", "part.component", F.lit(n).cast("long").alias("n"), "deviation", "part.whitened", "part.explained", F.lit(error).alias("identity_error"))


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for every row and component.

    Rows whose vector is null or has a null, non-finite or absurdly large (2^40) entry are dropped; so are empty
    vectors, which have no component. Vectors of different lengths are whitened each with those of their own
    length, n included. Repeated rows, shared and null ids stay rows of their own; equal vectors count once in
    the fit. Fewer dimensions than components give one row a dimension. A component without variance (one
    distinct vector, a dependent dimension) has a null `whitened` and is left out of identity_error; without any
    variance `explained` is 0. A deviation that does not fit a long is null. An empty table gives an empty result.
    """
    x = whole_numbers(F.col(vector_column))
    clean = stored(vectors.select(F.col(id_column).alias("vec_id"), x.alias("x")).filter("size(x) > 0"), "whole-numbers")
    lengths = [r["length"] for r in clean.groupBy(F.size("x").alias("length")).count().orderBy("length").collect()]
    spark, kind = clean.sparkSession, clean.schema["vec_id"].dataType.simpleString()
    out = None
    for length in lengths:
        part = whitened_rows(clean.filter(F.size("x") == length), components, str(length))
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], RESULT.format(kind)) if out is None else out


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, their 16 leading components."""
    return whiten(table(spark, sf_dir, "embeddings"))


SQL: dict[str, str] = {}
QUERIES = {"op11_whitening": op11_whitening}
