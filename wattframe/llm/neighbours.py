"""Approximate nearest neighbours by randomly rotated one-bit codes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.staging import stored
from .vectors import BLOCK_BYTES, by_id, in_cells, matrices, numbered, packed, unpacked

#: Half width of the bound on an estimate, in standard deviations of its error.  At 3 one vector in 700 that belongs
#: to the nearest by a hair is not looked at; the further it is above the last of them, the rarer.
BOUND = 3.0

_UNIT = float(1 << 30)
_QUERIES_AT_ONCE = 128
_INDEX = "row long, id long, query boolean, dim int, vec binary, code binary, norm double, scale double, error double, shift double"
_FOUND = "query_row long, query_id long, id long, score double"


def nearest(
    df: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
    bound: float = BOUND, seed: int = 1, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``k`` rows of greatest inner product with each row that ``queries`` holds for: ``query_id, rank, id, score``.

    A vector, made a unit vector and taken relative to the mean of all of them, is turned by a random rotation and
    kept as one bit a component, with four numbers: its norm, its product with the mean, and two that turn the product
    of bits and query into an estimate without bias and into the error to expect of it (Gao and Long, 2024).
    Per query and block of rows, the exact products of the best 4k estimates give a threshold; every row whose estimate
    plus bound reaches it is then scored exactly, in double precision.  No row is left out of the index, nothing
    is sampled, and the number of rows scored again isn't capped.

    Every row but the query's own is a candidate, also one with the same id or vector.  Ties go to the smaller id, null
    last.  Vectors that are null, empty, all zero, or hold a null or a component that is not finite take no part.
    Vectors of different length don't meet.  A null id is no query, but can be found.  Fewer candidates than ``k``: all.
    No valid vector: no rows.  Other columns of ``df`` don't matter.  Products must not overflow.
    """
    asked = F.coalesce(queries, F.lit(False)) & F.col(id_col).isNotNull()
    rows = numbered(df, id_col, vec_col, query=asked)
    centres = _centres(rows)
    index = stored(rows.mapInArrow(_encoder(centres, seed), _INDEX), "one-bit-codes")
    found = in_cells(
        index.drop("query"), index.where("query").select("row", "id", "dim", "vec"),
        _searcher(centres, seed, k, bound), _FOUND, block_bytes,
    )
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")


def unit(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors of the rows that are not all zero, their norms, and which rows they are."""
    largest = np.abs(matrix).max(axis=1)
    some = np.flatnonzero(largest > 0)
    scaled = matrix[some] / largest[some, None]
    norms = np.sqrt(np.einsum("ij,ij->i", scaled, scaled))
    return scaled / norms[:, None], norms * largest[some], some


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random rotation, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _centres(rows: DataFrame) -> dict[int, np.ndarray]:
    """Mean of the unit vectors of each length.

    Tasks add up fixed-point numbers, so the sums don't depend on the order of rows; one number per component of
    each length reaches the driver.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, matrix in matrices(batch["vec"]):
                units = unit(matrix)[0]
                own = np.append(np.floor(units * _UNIT).astype(np.int64).sum(axis=0), len(units))
                total[dim] = total.get(dim, 0) + own
        for dim, own in total.items():
            yield pa.RecordBatch.from_pydict(
                {"dim": np.full(dim + 1, dim, np.int32), "place": np.arange(dim + 1, dtype=np.int32), "part": own}
            )

    parts = rows.select("vec").mapInArrow(sums, "dim int, place int, part long")
    added = parts.groupBy("dim", "place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()
    totals: dict[int, np.ndarray] = {}
    for r in added:
        totals.setdefault(r.dim, np.zeros(r.dim + 1))[r.place] = float(r.total)
    return {dim: t[:-1] / t[-1] / _UNIT for dim, t in totals.items() if t[-1]}


def _encoder(centres: dict[int, np.ndarray], seed: int) -> Callable:
    """Batches of rows to batches of the index."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, at, matrix in matrices(batch["vec"]):
                units, norms, some = unit(matrix)
                if not len(some):
                    continue
                if dim not in turns:
                    turns[dim] = rotation(dim, seed)
                code, scale, error = one_bit(units - centres[dim], turns[dim])
                own = batch.take(pa.array(at[some]))
                numbers = (norms, scale, error, units @ centres[dim])
                yield pa.RecordBatch.from_arrays(
                    [
                        own["row"], own["id"], own["query"], pa.array(np.full(len(some), dim, np.int32)),
                        packed(matrix[some]), packed(code), *map(pa.array, numbers),
                    ],
                    names=["row", "id", "query", "dim", "vec", "code", "norm", "scale", "error", "shift"],
                )

    return encode


def one_bit(rest: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs of the turned rows, and the factors of the estimate and of its error.

    With signs ``s`` of a row and a turned query ``y``, ``scale * (s @ y)`` estimates the product of the two before
    the turn, with a standard deviation of about ``error`` times the length of ``y``.
    """
    dim = rest.shape[1]
    turned = rest @ turn
    length = np.sqrt(np.einsum("ij,ij->i", rest, rest))
    reach = np.abs(turned).sum(axis=1) / np.sqrt(dim)  # length times the cosine between a row and its signs
    some = reach > 0
    scale, cosine = np.zeros(len(rest)), np.ones(len(rest))
    scale[some] = length[some] ** 2 / (reach[some] * np.sqrt(dim))
    cosine[some] = np.minimum(reach[some] / length[some], 1.0)
    error = length * np.sqrt(1 - cosine**2) / cosine / np.sqrt(max(dim - 1, 1))
    return np.packbits(turned > 0, axis=1), scale, error


def _searcher(centres: dict[int, np.ndarray], seed: int, k: int, bound: float) -> Callable:
    """The best ``k`` of a block of rows for each query of a block."""

    def search(rows: pa.Table, queries: pa.Table) -> pa.Table:
        rows = by_id(rows)
        dim = rows["dim"][0].as_py()
        centre, turn = centres[dim], rotation(dim, seed)
        vectors, own = unpacked(rows["vec"], np.float64), rows["row"].to_numpy()
        bits = np.unpackbits(unpacked(rows["code"], np.uint8), axis=1, count=dim)
        signs = bits.astype(np.float32).T * 2 - 1
        norm, scale, error, shift = (rows[c].to_numpy() for c in ("norm", "scale", "error", "shift"))
        asked, me = unpacked(queries["vec"], np.float64), queries["row"].to_numpy()
        units, sizes, _ = unit(asked)
        turned = (units - centre) @ turn
        lengths = np.sqrt(np.einsum("ij,ij->i", turned, turned))
        offset = units @ centre - centre @ centre
        asked_by, places, scores = [], [], []
        for begin in range(0, len(asked), _QUERIES_AT_ONCE):
            part = slice(begin, begin + _QUERIES_AT_ONCE)
            # estimates and upper bounds of the products with the unit queries; the last term is for single precision
            guess = (turned[part].astype(np.float32) @ signs) * (norm * scale).astype(np.float32)
            guess += (norm * shift).astype(np.float32) + np.outer(offset[part], norm).astype(np.float32)
            guess[me[part, None] == own] = -np.inf
            most = guess + np.outer(bound * lengths[part], norm * error).astype(np.float32) + (1e-5 * norm).astype(np.float32)
            for i, query in enumerate(asked[part], begin):
                likely = _greatest(guess[i - begin], 4 * k)
                exact = np.einsum("ij,j->i", vectors[likely], query)
                if len(likely) > k:
                    least = np.partition(exact, len(exact) - k)[len(exact) - k]
                    likely = np.union1d(likely, np.flatnonzero(most[i - begin] >= least / sizes[i]))
                    exact = np.einsum("ij,j->i", vectors[likely], query)
                order = np.lexsort((likely, -exact))[:k]
                asked_by.append(np.full(len(order), i))
                places.append(likely[order])
                scores.append(exact[order])
        asked_by, places, scores = map(np.concatenate, (asked_by, places, scores))
        ask = queries.select(["row", "id"]).take(pa.array(asked_by))
        return pa.table({
            "query_row": ask["row"], "query_id": ask["id"], "id": rows["id"].take(pa.array(places)), "score": pa.array(scores),
        })

    return search


def _greatest(values: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` greatest values, in order of place; -inf never counts."""
    if len(values) > n:
        places = np.sort(np.argpartition(-values, n)[:n])
        return places[values[places] > -np.inf]
    return np.flatnonzero(values > -np.inf)
