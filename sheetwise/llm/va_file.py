"""Exact inner-product top-k with a vector-approximation file.

*Integers.*  A component x becomes floor(scale * x), x as a double; scores are integer
inner products.  Equal integer vectors are one class (a vector with a third of all rows
as copies is one class with the few smallest ids that can ever be ranked).

*Approximation file.*  Classes lie in blocks of bounded size.  A block has a uniform grid
(smallest value and cell width per dimension) and one byte per component: the cell.  Per
query the grid bounds every score of the block from below and above.

*Scan.*  Query classes come in blocks as well; every pair of a query block and an
approximation block is one bounded unit of work.  A task has a part of the approximation
file, block by block, and a bounded number of query blocks: a product of partitions, in
which nothing is copied for the shuffle or broadcast.  A unit keeps the classes whose upper
bound reaches the k-th best lower bound in the block.  As many blocks as the square root of
their number are scanned first; the k-th best lower bound in them is a floor for all others, so
that a query keeps that many times k classes and not k of each block.  The k-th best lower
bound over all blocks then cuts again.

*Exact reads.*  In the order of the bounds: first the exact vectors of the k+1 best upper
bounds, whose k-th exact score is a new threshold; then every class whose upper bound
still reaches it.  What is left cannot be among the k best, so the result is exact.

Defined cases: vectors that are null or hold null or non-finite components take no
part; vectors are compared with vectors of their own length only; ties go to the smaller
id, null ids last; rows repeated with id and vector are candidates and queries as often as
they occur (a query never meets its own row); fewer candidates than k: all; no rows: no
result.  Scores beyond the range of a long are clipped to it after ranking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.llm.common import parallelism, save, tidy

CELLS = 256
BLOCK = 4096
QUERY_BLOCK = 256
# Query blocks that a task of the scan holds at once.
HELD = 64
# Up to so many approximation blocks are scanned without a floor.
FEW = 8
_LONG = np.iinfo(np.int64)


def integer_vectors(rows: DataFrame, scale: int, id_col: str, vector: str) -> DataFrame:
    """Rows ``(id, vec)`` of the vectors that take part; ``vec`` is the components as
    little-endian 64-bit integers.  Components beyond a long are clipped to it."""
    x = F.col(vector)
    good = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))

    @F.pandas_udf("binary")
    @tidy
    def pack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda v: _floor(np.asarray(v, np.float64) * scale).astype("<i8").tobytes())

    return rows.filter(good).select(F.col(id_col).cast("long").alias("id"), pack(x.cast("array<double>")).alias("vec"))


def _floor(v: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(v), -2.0**63, 2.0**63 - 1024)


def _matrix(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), "<i8").reshape(len(packed), -1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in exact integers: as doubles where every sum stays below 2^53, else as Python integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)))
    most = float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max()) * a.shape[1]
    if most < 2**53:
        return a.astype(np.float64) @ b.T.astype(np.float64)
    return a.astype(object) @ b.T.astype(object)


def _blocks(classes: DataFrame, size: int, with_cells: bool) -> DataFrame:
    """Classes ``(cid, vec, floor)`` packed into blocks ``(dim, block, cids, data, low, width, floors)``:
    cells of the block's grid, or the exact integers without a grid."""
    schema = "dim int, block long, cids binary, data binary, low binary, width binary, floors binary"

    @tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, vecs, floors = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
            dims = np.array([len(v) // 8 for v in vecs])
            out = []
            for dim in np.unique(dims):
                of_dim = np.flatnonzero(dims == dim)
                for at in range(0, len(of_dim), size):
                    part = of_dim[at:at + size]
                    m = _matrix([vecs[i] for i in part])
                    low = width = b""
                    data = m.astype("<i8").tobytes()
                    if with_cells:
                        grid = _grid(m)
                        low, width, data = grid[0].astype("<i8").tobytes(), grid[1].astype("<i8").tobytes(), grid[2].tobytes()
                    out.append((int(dim), int(cids[part[0]]), cids[part].astype("<i8").tobytes(), data, low, width,
                                floors[part].astype("<f8").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), *[pa.binary()] * 5))],
                    ["dim", "block", "cids", "data", "low", "width", "floors"])

    return classes.select("cid", "vec", F.coalesce("floor", F.lit(float("-inf"))).alias("floor")).mapInArrow(pack, schema)


def _grid(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per dimension the smallest value and the cell width; per component its cell."""
    low = m.min(axis=0)
    span = m.max(axis=0).astype(object) - low.astype(object)
    width = np.array([int(s) // CELLS + 1 for s in span], np.int64)
    cell = ((m.astype(object) - low) // width if m.size and max(span, default=0) >= 2**62 else (m - low) // width)
    return low, width, cell.astype(np.uint8)


def _pairs(file: DataFrame, queries: DataFrame) -> DataFrame:
    """Every block of the approximation file beside every block of queries of the same dimension.
    The hint keeps Spark from broadcasting either side, however small it takes it for."""
    n = parallelism(file.sparkSession)
    return (file.repartition(max(1, min(n, file.count())))
            .join(queries.select("dim", F.col("cids").alias("qcids"), F.col("data").alias("queries"), F.col("floors").alias("qfloors"))
                  .repartition(max(1, -(-queries.count() // HELD))).hint("shuffle_replicate_nl"), "dim")
            .select("dim", "qcids", "queries", "qfloors", "cids", "data", "low", "width"))


def _scan(pairs: DataFrame, k: int) -> DataFrame:
    """Bounds ``(qid, cid, lower, upper)`` of the classes of each pair of blocks that neither the
    block alone nor the query's floor can rule out."""

    @tidy
    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dim, qcids, queries, qfloors, cids, data, low, width = (batch.column(i)[r].as_py() for i in range(8))
                q, c = np.frombuffer(qcids, "<i8"), np.frombuffer(cids, "<i8")
                qs = np.frombuffer(queries, "<i8").reshape(len(q), dim)
                w = np.frombuffer(width, "<i8")
                cells = np.frombuffer(data, np.uint8).reshape(len(c), dim)
                small = cells.astype(np.int64) * w + np.frombuffer(low, "<i8")  # the lower edges
                base = _products(qs, small)
                big = qs.astype(object) if base.dtype == object else qs
                rise = (np.where(big > 0, big, 0) * (w - 1)).sum(axis=1)
                fall = (np.where(big < 0, big, 0) * (w - 1)).sum(axis=1)
                # upper - lower is the same for all classes, so one threshold serves both
                at = len(c) - min(k, len(c))
                best = np.partition(base, at, axis=1)[:, at] if base.size else np.zeros(len(q))
                i, j = np.nonzero(base + (rise - fall)[:, None] >= best[:, None])
                lower = (base[i, j] + fall[i]).astype(np.float64)
                upper = (base[i, j] + rise[i]).astype(np.float64)
                if base.dtype == object:  # rounding to doubles must not cut a bound
                    lower, upper = np.nextafter(lower, -np.inf), np.nextafter(upper, np.inf)
                may = upper >= np.frombuffer(qfloors, "<f8")[i]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q[i[may]]), pa.array(c[j[may]]), pa.array(lower[may]), pa.array(upper[may])], ["qid", "cid", "lower", "upper"])

    return pairs.mapInArrow(bounds, "qid long, cid long, lower double, upper double")


def _floors(seen: DataFrame, k: int) -> DataFrame:
    """Per query the k-th best lower bound seen, ``(qid, floor)``; null where fewer are seen."""
    by_lower = Window.partitionBy("qid").orderBy(F.desc("lower"), "cid")
    return save(seen.withColumn("r", F.row_number().over(by_lower)).filter(F.col("r") <= k)
                .groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("lower").alias("floor"))
                .select("qid", F.when(F.col("n") == k, F.col("floor")).alias("floor")))


def _score(a: Column, b: Column) -> Column:
    """Exact inner product of two packed vectors, as text of an integer (any size)."""

    @F.pandas_udf("string")
    def product(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([str(sum(i * j for i, j in zip(np.frombuffer(u, "<i8").tolist(), np.frombuffer(v, "<i8").tolist())))
                          for u, v in zip(x, y)], dtype=object)

    return product(a, b)


def top_k(rows: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id",
          vector: str = "embedding") -> DataFrame:
    """Per query row its ``k`` best rows ``(query_id, rank, vec_id, score)``.  ``is_query`` is
    a condition on ``id``, the id as a long."""
    spark = rows.sparkSession
    n = parallelism(spark)
    points = save(integer_vectors(rows, scale, id_col, vector).groupBy("vec", "id").agg(F.count(F.lit(1)).alias("copies"))
                  .withColumn("is_query", F.coalesce(is_query, F.lit(False))))
    # the written table fixes the class numbers
    classes = save(points.groupBy("vec").agg(F.min("id").alias("least"), F.max("is_query").alias("is_query"))
                   .withColumn("cid", F.monotonically_increasing_id()))
    of_class = points.join(classes.select("vec", "cid"), "vec").select("cid", "id", "copies", "is_query")
    members = save(of_class)

    n_classes, n_asking = classes.agg(F.count(F.lit(1)), F.count_if("is_query")).first()
    unbounded = classes.withColumn("floor", F.lit(None).cast("double"))
    file = save(_blocks(unbounded.repartition(max(1, min(n, n_classes // BLOCK)), "cid"), BLOCK, True))

    def in_blocks(asking: DataFrame) -> DataFrame:
        return save(_blocks(asking.repartition(max(1, min(n, n_asking // QUERY_BLOCK)), "cid"), QUERY_BLOCK, False))

    # one more than k: the query's own row is among the candidates until the end
    queries = in_blocks(unbounded.filter("is_query"))
    n_blocks = file.count()
    if n_blocks > FEW:
        some = file.filter(F.pmod(F.xxhash64("block"), F.lit(n_blocks)) < n_blocks ** 0.5)
        at_first = _floors(save(_scan(_pairs(some, queries), k + 1)), k + 1)
        queries = in_blocks(classes.filter("is_query").join(at_first.withColumnRenamed("qid", "cid"), "cid", "left"))
    seen = save(_scan(_pairs(file, queries), k + 1))
    floor = _floors(seen, k + 1)
    left = save(seen.join(floor, "qid").filter("floor is null or upper >= floor").select("qid", "cid", "upper"))

    exact = classes.select("cid", F.col("vec").alias("cvec"), "least")
    asked = classes.filter("is_query").select(F.col("cid").alias("qid"), F.col("vec").alias("qvec"))

    def read(some: DataFrame) -> DataFrame:
        return (some.join(exact, "cid").join(asked, "qid")
                .select("qid", "cid", "least", _score(F.col("qvec"), F.col("cvec")).cast("decimal(38,0)").alias("score")))

    by_upper = Window.partitionBy("qid").orderBy(F.desc("upper"), "cid")
    first_ids = save(left.withColumn("r", F.row_number().over(by_upper)).filter(F.col("r") <= k + 1).drop("r"))
    first = save(read(first_ids.select("qid", "cid")))
    certain = save(first.groupBy("qid").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n"))
                   .select("qid", F.when(F.col("n") > k, F.col("kth")).alias("kth")))
    rest = (left.join(certain, "qid").filter(F.col("kth").isNull() | (F.col("upper") >= F.col("kth").cast("double")))
            .select("qid", "cid").join(first_ids.select("qid", "cid"), ["qid", "cid"], "left_anti"))
    scored = first.unionByName(read(rest))

    # k+1 classes by (score, smallest id) hold the k+1 best rows, each class its k+1 smallest ids
    by_score = Window.partitionBy("qid").orderBy(F.desc("score"), F.col("least").asc_nulls_last(), "cid")
    best = save(scored.withColumn("r", F.row_number().over(by_score)).filter(F.col("r") <= k + 1).drop("r", "least"))
    by_id = Window.partitionBy("cid").orderBy(F.col("id").asc_nulls_last())
    smallest = (members.withColumn("r", F.row_number().over(by_id)).filter(F.col("r") <= k + 1)
                .select("cid", F.col("id").alias("vec_id"), F.col("copies").alias("of")))
    ranked = best.join(smallest, "cid")
    asking = members.filter("is_query").select(F.col("cid").alias("qid"), F.col("id").alias("query_id"), F.col("copies").alias("times"))
    own = (F.col("cid") == F.col("qid")) & F.col("vec_id").eqNullSafe(F.col("query_id"))
    got = (asking.join(ranked, "qid")
           .withColumn("of", F.least(F.col("of") - F.when(own, 1).otherwise(0), F.lit(k))).filter("of > 0")
           .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("of").cast("int")))))
    order = Window.partitionBy("query_id", "qid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "cid", "copy")
    return (got.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
            .select("query_id", "rank", "vec_id",
                    F.greatest(F.least("score", F.lit(_LONG.max).cast("decimal(38,0)")), F.lit(_LONG.min).cast("decimal(38,0)"))
                    .cast("long").alias("score")))
