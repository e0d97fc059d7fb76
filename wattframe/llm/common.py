"""What several operators of this package share: words as arrays, blocks of rows, components."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.staging import dropped, stored

# ---- words ---------------------------------------------------------------------------


class Words(NamedTuple):
    """The words (runs of bytes other than ASCII white space) of some texts.

    ``data`` holds all texts with a line feed before and after each; word ``i`` is
    ``data[starts[i]:ends[i]]``; text ``t`` owns words ``first[t]`` to ``first[t + 1]``.
    """

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split_words(column, lower: bool = False) -> Words:
    """Words of a string column (Arrow array, or list of bytes); a null has none."""
    texts = column if isinstance(column, list) else column.cast(pa.binary()).to_pylist()
    texts = [t or b"" for t in texts]
    joined = b"\n" + b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined.lower() if lower else joined, np.uint8)
    inside = (data != 32) & ((data < 9) | (data > 13))
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    text_starts = np.cumsum([1] + [len(t) + 1 for t in texts])
    return Words(data, starts, ends, np.searchsorted(starts, text_starts))


def word_ids(words: Words) -> tuple[np.ndarray, pa.Array]:
    """A number for each word, and the distinct words by number."""
    lengths = words.ends - words.starts
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    body = words.data[(words.data != 32) & ((words.data < 9) | (words.data > 13))]
    column = pa.Array.from_buffers(
        pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(body)]
    ).dictionary_encode()
    return column.indices.to_numpy(), column.dictionary


def strong_hashes(values) -> np.ndarray:
    """Two independent 64-bit hashes of each byte string, as rows."""
    digests = b"".join(xxhash.xxh3_128_digest(v) for v in values)
    return np.frombuffer(digests, np.uint64).reshape(-1, 2)


def _powers(base: int, n: int) -> np.ndarray:
    row = np.full(n, base, np.uint64)
    row[:1] = 1
    return np.multiply.accumulate(row)


def rolling_hashes(values: np.ndarray, length: int, base: int) -> np.ndarray:
    """Rabin-Karp hash, modulo 2**64, of every run of ``length`` values; ``base`` is odd.

    The values must be well mixed themselves; the hash is then as good as a random one but for a few bits.
    """
    n = len(values)
    if n < length:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _powers(base, n), out=sums[1:])
    return (sums[length:] - sums[:-length]) * _powers(pow(base, -1, 2**64), n)[: n - length + 1]


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in a run of ``length`` that begins at one of ``starts`` (distinct)."""
    change = np.zeros(n + 1, np.int32)
    change[starts] += 1
    change[starts + length] -= 1
    return np.cumsum(change[:n]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edges[0::2], edges[1::2]


def lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """An Arrow list column: ``counts[i]`` of the values go to row ``i``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


# ---- rows and blocks -----------------------------------------------------------------


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that an operator reads, as ``id`` and ``text``; others, of any name, stay out."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def in_blocks(rows: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """Number the rows (``row``) and deal them into blocks of about ``block_bytes`` of text (``block``).

    Returns the frame and the bytes of text in it.

    A row's block depends on its place in the input alone, so rows that are equal in every column,
    one id or one text in many rows, do not meet in one block.  One number reaches the driver.
    """
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    blocks = int(size // block_bytes) + 1
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).withColumn(
        "block", F.pmod(F.xxhash64("row"), F.lit(blocks))
    )
    return dealt, size


# ---- connected components ------------------------------------------------------------


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``a``, ``b``); the component is its least node.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each is an aggregation that
    combines before its shuffle and one join, so a node with any number of links is never gathered.
    A round is stored before the next one, and the one before it goes.
    """
    links = edges.select("a", "b").where("a <> b")
    links = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", free=True)
    for _ in range(max_rounds):
        large = _star(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), True)
        small = stored(_star(large, False).distinct(), "links", free=True)
        same = small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if same == links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first():
            dropped(small)
            break
        dropped(links)
        links = small
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links ``a`` - ``b`` (both ways for the large star, else from ``a`` > ``b``) moved to the least neighbour."""
    least = links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = links.join(least, "a")
    if large:
        return moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return (
        moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .union(least.select("a", F.col("m").alias("b")))
    )
