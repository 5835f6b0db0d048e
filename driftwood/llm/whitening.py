"""Whitening of embeddings with MLlib's BlockMatrix.

Each different vector once, centred, is a row of a tall matrix in blocks of
rows.  Its transpose times itself is the scatter; the driver decomposes that (a
square of the vectors' length, whatever their number), and the tall matrix
times the whitening matrix projects the rows.  Both products are BlockMatrix
multiplications whose middle dimension, the rows, is split over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.mllib.linalg import DenseMatrix, Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

SCALE = 256
COMPONENTS = 4
#: Rows and columns of a block.
BLOCK_ROWS, BLOCK_COLUMNS = 1024, 1024
#: Components whose variance is under this share of the whole, times the length, are rounding and have no direction.
FLAT = 1e-13
_WIDE = 1 << 62


def usable(embedding: Column, scale: int) -> Column:
    """Whether a vector takes part: some components, all finite, and each a long when scaled."""
    return F.coalesce(F.forall(embedding, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) * scale < 2.0**62), F.lit(False))), F.lit(False)) & (F.size(embedding) > 0)


def _coded(scale: int):
    """vec_id, dim, the whole numbers floor(scale * x), as small as they can be written, and their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, held, digests = [], [], []
            for v in batch.column("embedding"):
                x = np.floor(v.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale).astype(np.int64)
                dims.append(len(x))
                held.append(_written(x))
                digests.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(dims, pa.int32()), pa.array(held, pa.binary()), pa.array(digests, pa.binary())], names=["vec_id", "dim", "x", "digest"])

    return run


def _written(x: np.ndarray) -> bytes:
    top = np.abs(x).max()
    return x.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64).tobytes()


def _read(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, f"i{len(data) // dim}").astype(np.int64)


def _wide(x: np.ndarray, times: int) -> np.ndarray:
    """``x`` as 64-bit integers, or as Python's if a sum of ``times`` of them might leave 64 bits."""
    return x if x.size == 0 or int(np.abs(x).max()) * times < _WIDE else x.astype(object)


def _packed(dim: int, block_rows: int):
    """Blocks of up to ``block_rows`` vectors of one task: their digests and numbers, and the exact sum of each dimension."""

    def block(digests: list, rows: list) -> pa.RecordBatch:
        x = np.stack(rows)
        sums = [str(s) for s in _wide(x, len(x)).sum(axis=0).tolist()]
        return pa.RecordBatch.from_arrays([pa.array([digests], pa.list_(pa.binary())), pa.array([_written(x.ravel())], pa.binary()), pa.array([sums], pa.list_(pa.string()))], names=["digests", "x", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests: list = []
        rows: list = []
        for batch in batches:
            for digest, x in zip(batch.column("digest").to_pylist(), batch.column("x").to_pylist()):
                digests.append(digest)
                rows.append(_read(x, dim))
                if len(rows) == block_rows:
                    yield block(digests, rows)
                    digests, rows = [], []
        if rows:
            yield block(digests, rows)

    return run


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly."""
    top = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums)))
    return x * n - np.array(sums, np.int64) if 2 * top < _WIDE else x.astype(object) * n - np.array(sums, object)


def _centred(row, dim: int, n: int, sums: list[int], block_rows: int, block_columns: int) -> list:
    """The block's vectors less the mean, cut into blocks of columns; rows of zeros fill it up and add nothing."""
    x = _read(row["x"], dim * len(row["digests"])).reshape(-1, dim)
    full = np.zeros((block_rows, dim))
    full[: len(x)] = (_deviations(x, n, sums) / n).astype(np.float64)
    parts = [full[:, at : at + block_columns] for at in range(0, dim, block_columns)]
    return [((row["block"], k), DenseMatrix(block_rows, part.shape[1], part.ravel(order="F"))) for k, part in enumerate(parts)]


def _product(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """left * right with the dimension between them split over tasks, which the Python method leaves at one."""
    java = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, left.rowsPerBlock, right.colsPerBlock)


def _directions(scatter: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Variance, share of all variance and unit direction of each component, the largest first; none for what is flat."""
    covariance = (scatter + scatter.T) / (2 * n)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    whole = float(np.trace(covariance))
    some = values > FLAT * len(covariance) * whole
    # either sign is right; the largest entry is made positive, so that reruns agree
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values[some], values[some] / (whole or 1.0), (vectors * signs)[:, some]


def _by_vector(columns: int, dim: int, n: int, sums: list[int]):
    """digest, deviation and whitened of each vector of a block and its projection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = len(row["digests"])
                d = _deviations(_read(row["x"], dim * own).reshape(own, dim), n, sums)
                far = (_wide(d, 1) if int(np.abs(d).max(initial=0)) ** 2 * dim < _WIDE else d.astype(object)) ** 2
                # an exact sum that is no long is null
                deviation = [v if v < 1 << 63 else None for v in map(int, far.sum(axis=1).tolist())]
                projected = np.frombuffer(row["projected"]).reshape(-1, columns)[:own]
                yield pa.RecordBatch.from_arrays([pa.array(row["digests"], pa.binary()), pa.array(deviation, pa.int64()), pa.array(projected.tolist(), pa.list_(pa.float64()))], names=["digest", "deviation", "whitened"])

    return run


def _identity_error(whitened: DataFrame, components: int, n: int) -> float:
    """Largest entry of the whitened rows' covariance less the identity; sums of each pair of components only reach the driver."""
    y = [F.col("whitened")[k] for k in range(components)]
    one = whitened.agg(*[F.sum(v).alias(f"s{k}") for k, v in enumerate(y)], *[F.sum(y[a] * y[b]).alias(f"p{a}_{b}") for a in range(components) for b in range(a + 1)]).first()
    mean = [one[f"s{k}"] / n for k in range(components)]
    return max(abs(one[f"p{a}_{b}"] / n - mean[a] * mean[b] - (a == b)) for a in range(components) for b in range(a + 1))


_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whitened(spark: SparkSession, rows: DataFrame, dim: int, components: int, block_rows: int, block_columns: int) -> DataFrame:
    """Rows (vec_id, x, digest) of one length."""
    # of equal vectors the digest's least id is read; ids alone meet before vectors move
    once = rows.groupBy("digest").agg(F.min("row").alias("row"))
    fit = rows.select("row", "digest", "x").join(once.select("row"), "row")
    packed = stored(fit.select("digest", "x").mapInArrow(_packed(dim, block_rows), "digests array<binary>, x binary, sums array<string>").withColumn("at", F.monotonically_increasing_id()), "blocks")
    # blocks get gapless numbers from their tasks' counts
    task, nth = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    starts, blocks = [], 0
    for r in packed.groupBy(task.alias("task")).agg(F.count("*").alias("m")).orderBy("task").collect():
        starts.append((r["task"], blocks))
        blocks += r["m"]
    numbers = spark.createDataFrame(starts, "task long, start long")
    numbered = packed.withColumn("task", task).join(F.broadcast(numbers), "task").withColumn("block", (F.col("start") + nth).cast("long"))
    n = packed.agg(F.sum(F.size("digests"))).first()[0]
    totals = packed.select(F.posexplode("sums").alias("k", "s")).groupBy("k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    sums = [int(r["s"]) for r in sorted(totals)]

    tall = BlockMatrix(numbered.select("block", "digests", "x").rdd.flatMap(partial(_centred, dim=dim, n=n, sums=sums, block_rows=block_rows, block_columns=block_columns)), block_rows, min(dim, block_columns), blocks * block_rows, dim)
    splits = max(1, min(blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    scatter = _product(tall.transpose(), tall, splits).toLocalMatrix().toArray()
    values, shares, directions = _directions(scatter, n, components)
    if not len(values):
        return spark.createDataFrame([], _SCHEMA)
    turn = directions / np.sqrt(values)
    step = min(dim, block_columns)
    parts = [((k, 0), Matrices.dense(len(turn[at : at + step]), len(values), turn[at : at + step].ravel(order="F"))) for k, at in enumerate(range(0, dim, step))]
    turning = BlockMatrix(spark.sparkContext.parallelize(parts, 1), step, len(values), dim, len(values))
    projected = _product(tall, turning, 1).blocks.map(lambda b: (b[0][0], bytearray(b[1].toArray().tobytes())))
    projected = spark.createDataFrame(projected, "block long, projected binary")

    by_vector = numbered.select("block", "digests", "x").join(projected, "block").select("digests", "x", "projected")
    by_vector = stored(by_vector.mapInArrow(_by_vector(len(values), dim, n, sums), "digest binary, deviation long, whitened array<double>"), "whitened")
    error = _identity_error(by_vector, len(values), n)
    # equal vectors meet their one result; adaptive execution splits a crowded digest
    every = rows.select("vec_id", "digest").join(by_vector, "digest").select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    explained = F.element_at(F.array(*map(F.lit, shares.tolist())), F.col("k") + 1)
    return every.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def whitened(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, block_rows: int = BLOCK_ROWS, block_columns: int = BLOCK_COLUMNS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error per row of ``vectors`` (vec_id, embedding) and component.

    Vectors are whole numbers floor(scale * x).  Each different one counts once
    in mean and covariance; rows that repeat, or share or lack a vec_id, each
    get the result of their vector.  Vectors that are null, empty, hold null or
    non-finite components, or numbers of 2 ** 62 or more, take no part.
    Vectors of each length are whitened by themselves.  A component without
    variance has no direction and no rows (so none come of one vector only, or
    of equal ones); components of tied variance span their space in some way.
    ``deviation`` is null where it is no 64-bit number.  No vectors, no rows.
    """
    spark = vectors.sparkSession
    some = vectors.filter(usable(F.col("embedding"), scale)).select("vec_id", "embedding")
    coded = some.mapInArrow(_coded(scale), f"vec_id {dict(vectors.dtypes)['vec_id']}, dim int, x binary, digest binary")
    rows = stored(coded.withColumn("row", F.monotonically_increasing_id()), "coded")
    result = spark.createDataFrame([], _SCHEMA)
    # vectors' lengths are few
    for (dim,) in rows.select("dim").distinct().orderBy("dim").collect():
        result = result.unionAll(_whitened(spark, rows.filter(F.col("dim") == dim), dim, components, block_rows, block_columns))
    return result
