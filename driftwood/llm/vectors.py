"""Exact top-k by inner product over a vector-approximation file.

Every dimension is cut into equal cells over its range; the file has one byte
for each component, and from a vector's cells every score has a lower and an
upper bound.  Queries meet the cells, never the exact vectors, block by block:

1. a part of the blocks gives each query a score that k vectors surely reach;
2. a scan of all blocks keeps the vectors whose upper bound reaches it, or
   k sure scores of their own block if those are higher;
3. exact vectors are read in order of falling upper bound: first the best few
   of each query, then only those whose bound reaches the kth exact score.

Both bounds are sums of whole numbers kept apart from their float estimates by
a margin, so no vector is lost, whatever the cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, stored

K = 10
#: Components are floor(SCALE * x).
SCALE = 1024
#: Cells of a dimension: 2 ** BITS, one byte each.
BITS = 8
#: Vectors and queries that one task of the scan holds.
VECTOR_BLOCK = 16384
QUERY_BLOCK = 8192
#: One block in so many gives the first sure scores.
FIRST_BLOCKS = 8
#: Exact vectors read for each query before the kth exact score is known.
FIRST_READ = 2
#: Queries whose bounds a task computes at once.
_CHUNK = 128


def quantised(embedding: Column | str, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null for vectors that are null, empty or hold a null or non-finite component.

    So it is for vectors so long that their scores, which are 64-bit numbers, might not exist.
    """
    embedding = F.col(embedding) if isinstance(embedding, str) else embedding
    finite = F.forall(embedding, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x))
    squares = F.aggregate(embedding, F.lit(0.0), lambda s, x: s + (F.abs(x.cast("double")) * scale + 1) * (F.abs(x.cast("double")) * scale + 1))
    return F.when(embedding.isNotNull() & finite & (F.size(embedding) > 0) & (squares < 9.0e18), F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _cells(low: dict[int, np.ndarray], width: dict[int, np.ndarray]):
    """row, vec_id, dim and one byte for each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for v in batch.column("v").to_pylist():
                cells.append(((np.array(v, np.int64) - low[len(v)]) // width[len(v)]).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), batch.column("dim"), pa.array(cells, pa.binary())], names=["row", "vec_id", "dim", "cells"])

    return run


def _bounds(queries: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[query, vector] middle of each score's range, and [query] its half width with a margin for rounding."""
    half = (width - 1) / 2.0
    middle = (queries * width) @ cells.T + (queries @ (low + half))[:, None]
    slack = np.abs(queries) @ half + 1e-9 * (np.abs(queries) @ (np.abs(low) + width * 256.0)) + 1e-6
    return middle, slack


def _blocks_of(side: pa.Table, name: str, dim: int, kind: type) -> np.ndarray:
    data = b"".join(side.column(name).to_pylist())
    return np.frombuffer(data, kind).reshape(-1, dim)


def _sure(k: int, low: dict, width: dict):
    """query_id and the k best lower bounds that one block gives it."""

    def run(key: tuple, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        ids, sure = [], []
        if vectors.num_rows and queries.num_rows:
            dim = vectors.column("dim")[0].as_py()
            cells, own = _blocks_of(vectors, "cells", dim, np.uint8).astype(np.float64), vectors.column("vec_id").to_numpy()
            asked, asking = _blocks_of(queries, "q", dim, np.int64), queries.column("query_id").to_numpy()
            for at in range(0, len(asking), _CHUNK):
                part = asked[at : at + _CHUNK].astype(np.float64)
                middle, slack = _bounds(part, cells, low[dim], width[dim])
                middle[asking[at : at + _CHUNK, None] == own[None, :]] = -np.inf
                top = min(k, len(own))
                best = np.partition(middle, len(own) - top, axis=1)[:, len(own) - top :] - slack[:, None]
                ids += asking[at : at + _CHUNK].tolist()
                sure += [[x for x in row if x > -np.inf] for row in best.tolist()]
        return pa.table({"query_id": pa.array(ids, pa.int64()), "sure": pa.array(sure, pa.list_(pa.float64()))})

    return run


def _reaching(k: int, low: dict, width: dict):
    """query_id, row, vec_id and upper bound of the block's vectors that may be among a query's best."""

    def run(key: tuple, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if vectors.num_rows and queries.num_rows:
            dim = vectors.column("dim")[0].as_py()
            cells, own, rows = _blocks_of(vectors, "cells", dim, np.uint8).astype(np.float64), vectors.column("vec_id").to_numpy(), vectors.column("row").to_numpy()
            asked, asking, sure = _blocks_of(queries, "q", dim, np.int64), queries.column("query_id").to_numpy(), queries.column("sure").to_numpy()
            for at in range(0, len(asking), _CHUNK):
                part = asked[at : at + _CHUNK].astype(np.float64)
                middle, slack = _bounds(part, cells, low[dim], width[dim])
                middle[asking[at : at + _CHUNK, None] == own[None, :]] = -np.inf
                limit = sure[at : at + _CHUNK] - slack
                if len(own) >= k:
                    limit = np.maximum(limit, np.partition(middle, len(own) - k, axis=1)[:, len(own) - k] - 2 * slack)
                i, j = np.nonzero((middle >= limit[:, None]) & (middle > -np.inf))
                for column, values in zip(out, (asking[at + i], rows[j], own[j], middle[i, j] + slack[i])):
                    column.append(values)
        joined = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "row", "vec_id", "upper"), joined, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))})

    return run


def _met(cells: DataFrame, queries: DataFrame, search, schema: str) -> DataFrame:
    """Blocks of cells against blocks of queries: a task holds one of each, and a side is sent once for each block of the other."""
    keys = ("dim", "block", "asking")
    # both sides carry the number of the other's blocks
    left = cells.select("*", F.explode(F.sequence(F.lit(0), F.col("askings") - 1)).alias("asking"))
    right = queries.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, schema)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, bits: int = BITS, vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of ``vectors`` (vec_id, embedding) for each row where ``is_query``.

    Vectors that are null, empty or hold null or non-finite components, and
    rows without vec_id, take no part, nor do vectors too long for 64-bit
    scores.  Only vectors of the query's length are its candidates, and
    no row with its vec_id is.  A vec_id asks once: with the least of its
    vectors, if it stands on several rows.  A candidate row counts each time.
    Ties go to the smaller vec_id.  No vectors, no rows.

    The driver learns the range of each dimension: two numbers for each
    component of each length of vector.
    """
    exact = numbered(vectors.select("vec_id", is_query.alias("asks"), quantised("embedding", scale).alias("v")).filter("v is not null and vec_id is not null").withColumn("dim", F.size("v")), "row", "vectors")
    ranges = exact.select("dim", F.posexplode("v").alias("at", "x")).groupBy("dim", "at").agg(F.min("x").alias("low"), F.max("x").alias("high")).collect()
    low: dict[int, np.ndarray] = {}
    width: dict[int, np.ndarray] = {}
    for r in ranges:
        for side in (low, width):
            side.setdefault(r["dim"], np.zeros(r["dim"], np.int64))
        low[r["dim"]][r["at"]] = r["low"]
        width[r["dim"]][r["at"]] = (r["high"] - r["low"]) // (1 << bits) + 1
    counts = exact.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("asks").alias("m"))
    counts = counts.select("dim", F.ceil(F.col("n") / vector_block).cast("int").alias("blocks"), F.greatest(F.lit(1), F.ceil(F.col("m") / query_block).cast("int")).alias("askings"))

    # of rows with one vector only the first few ids can be among anyone's best: k of an id, and k besides an asking id's own
    of_id, of_vector = Window.partitionBy("v", "vec_id").orderBy("row"), Window.partitionBy("v").orderBy("vec_id", "row")
    kept = exact.select("row", "vec_id", "dim", "v").withColumn("nth", F.row_number().over(of_id)).filter(F.col("nth") <= k)
    kept = kept.withColumn("nth", F.row_number().over(of_vector)).filter(F.col("nth") <= 2 * k).drop("nth")
    in_block = lambda column, count, seed: F.pmod(F.xxhash64(column, F.lit(seed)), F.col(count)).cast("int")
    cells = stored(kept.mapInArrow(_cells(low, width), "row long, vec_id long, dim int, cells binary"), "cells")
    cells = cells.join(counts, "dim").withColumn("block", in_block("row", "blocks", 1))
    words = F.udf(lambda v: np.array(v, np.int64).tobytes(), "binary", useArrow=True)
    asking = exact.filter("asks").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    asking = stored(asking.join(counts, "dim").select("query_id", "dim", "blocks", "askings", words("v").alias("q")).withColumn("asking", in_block("query_id", "askings", 2)), "queries")

    # 1: the kth best lower bound over some blocks is reached by k vectors, whatever the others hold
    first = cells.filter(F.col("block") % FIRST_BLOCKS == 0).select("row", "vec_id", "dim", "cells", "block", "askings")
    some = asking.withColumn("blocks", F.ceil(F.col("blocks") / FIRST_BLOCKS).cast("int"))
    sure = _met(first.withColumn("block", (F.col("block") / FIRST_BLOCKS).cast("int")), some, _sure(k, low, width), "query_id long, sure array<double>")
    sure = sure.select("query_id", F.explode("sure").alias("s")).groupBy("query_id").agg(F.sort_array(F.collect_list("s"), asc=False).alias("s"))
    asking = asking.join(sure, "query_id", "left").withColumn("sure", F.coalesce(F.get("s", F.lit(k - 1)), F.lit(float("-inf")))).drop("s")
    # 2: what reaches it
    reaching = stored(_met(cells.select("row", "vec_id", "dim", "cells", "block", "askings"), asking, _reaching(k, low, width), "query_id long, row long, vec_id long, upper double"), "reaching")

    # 3: exact vectors in order of their bounds
    questions = exact.filter("asks").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q"))
    product = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)
    scored = lambda found: found.join(exact.select("row", "v"), "row").join(questions, "query_id").select("query_id", "row", "vec_id", product.alias("score"))
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("upper"), "row")
    read = stored(scored(reaching.withColumn("nth", F.row_number().over(by_bound)).filter(F.col("nth") <= FIRST_READ * k)), "read")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "row")
    kth = read.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") == k).select("query_id", F.col("score").alias("kth"))
    rest = reaching.join(kth, "query_id", "left").filter("kth is null or upper >= kth").select("query_id", "row", "vec_id")
    rest = rest.join(read.select("query_id", "row"), ["query_id", "row"], "left_anti")
    every = read.unionAll(scored(rest))
    return every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
