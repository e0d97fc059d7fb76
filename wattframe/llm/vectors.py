"""What the searches over a table of vectors share: matrices from list columns, cells of rows and queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A cell is a task's work: blocks of this many bytes of rows and of queries, every pair of which is scored.  Reading
#: 8 MB then pays for some 10**8 products, so computing outweighs the copies of blocks that are sent, at any size.
BLOCK_BYTES = 4 << 20


def numbered(df: DataFrame, id_col: str, vec_col: str, **more: Column) -> DataFrame:
    """``row`` (a number of its own), ``id`` and ``vec`` of every row; other columns, of any name, stay out."""
    return df.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
        F.col(vec_col).cast("array<double>").alias("vec"), *(c.alias(k) for k, c in more.items()),
    )


def matrices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The vectors of a list column by their length: length, places in the column, matrix.

    Left out are null and empty lists, and those with a component that is null or not finite.
    """
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)  # null becomes NaN
    ends = np.cumsum(lengths)
    for length in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == length)
        matrix = values[(ends[at] - length)[:, None] + np.arange(length)]
        whole = np.isfinite(matrix).all(axis=1)
        if whole.any():
            yield int(length), at[whole], matrix[whole]


def packed(matrix: np.ndarray) -> pa.Array:
    """Rows of a matrix as byte strings."""
    width = matrix.shape[1] * matrix.itemsize
    data = np.ascontiguousarray(matrix)
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def unpacked(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The matrix whose rows were packed."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def by_id(table: pa.Table) -> pa.Table:
    """Rows by id, null last: the order in which equal scores count."""
    return table.sort_by([("id", "ascending"), ("row", "ascending")])


def in_cells(
    rows: DataFrame, queries: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str, block_bytes: int,
) -> DataFrame:
    """``work(rows, queries)`` on every cell: a block of rows and one of queries with vectors of one length (``dim``).

    Blocks go by ``row``, so equal rows, ids and labels spread; both sides have ``row``, ``dim`` and ``vec`` (packed).
    Per length two counts reach the driver.  Smaller tables get smaller blocks, down to 1/4 of ``block_bytes``, for more
    tasks; the results don't depend on blocks.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = [{r.dim: r.n for r in side.groupBy("dim").agg(F.count("*").alias("n")).collect()} for side in (rows, queries)]
    dims = sorted(counted[0].keys() & counted[1].keys())
    if not dims:
        return spark.createDataFrame([], schema)

    def blocks(n: int, dim: int, least: int) -> int:
        size = 8 * n * dim
        return max(ceil(size / block_bytes), min(least, ceil(4 * size / block_bytes)), 1)

    shape = {d: (blocks(counted[0][d], d, tasks), blocks(counted[1][d], d, 1)) for d in dims}
    of = [F.create_map(*(F.lit(x) for d in dims for x in (d, shape[d][side])))[F.col("dim")] for side in (0, 1)]
    parts = min(sum(a * b for a, b in shape.values()), 16 * tasks)
    known = F.col("dim").isin(dims)

    def dealt(side: DataFrame, own: str, other: str, k: int) -> DataFrame:
        named = side.where(known).select(*(F.col(c).alias(c) for c in side.columns))  # both may come from one frame
        return named.select(
            "*", F.pmod(F.xxhash64("row"), of[k].cast("long")).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), of[1 - k] - 1)).alias(other),
        ).repartition(parts, "dim", "row_block", "query_block")

    empty = spark.createDataFrame([], schema).toArrow().schema

    def both(own: pa.Table, asked: pa.Table) -> pa.Table:
        return work(own, asked) if own.num_rows and asked.num_rows else empty.empty_table()

    left, right = dealt(rows, "row_block", "query_block", 0), dealt(queries, "query_block", "row_block", 1)
    cell = ("dim", "row_block", "query_block")
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(both, schema)
