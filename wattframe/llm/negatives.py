"""Hard negatives: rows of another label that score a little below an anchor's own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.staging import stored
from .vectors import BLOCK_BYTES, by_id, in_cells, matrices, numbered, packed, unpacked

_ANCHORS_AT_ONCE = 128
_ROWS = "row long, id long, label long, anchor boolean, dim int, vec binary"
_FOUND = "anchor_row long, anchor_id long, slot int, id long, score long"


def hard_negatives(
    df: DataFrame, anchors: Column, label: Column, id_col: str = "vec_id", vec_col: str = "embedding",
    positives: int = 5, negatives: int = 5, least_percent: int = 80, scale: int = 256, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The first ``negatives`` rows of another label in the window below each positive of each row that ``anchors`` holds for.

    ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.  A score is the integer product of the
    vectors' components, each ``floor(scale * x)``; greater scores come first, ties by smaller id, null last.  An anchor's
    positives are its first ``positives`` other rows of its label.  The window of a positive of score p holds the scores
    from ``least_percent`` of p to p.

    The positives' scores are the upper limits of the windows and cut the scores below them into disjoint slots.  Every
    block of rows keeps its best ``negatives`` of each slot, which are combined by slot; a window starts at the top of
    one slot and reaches down over the next ones, so the best of all windows come from one walk down the slots, cut at
    their lower limits.  An anchor brings at most ``positives * negatives`` rows together, whatever the table.

    Rows with a null label, with a null or empty vector, or with a component that is null or not finite take no part.
    Vectors of different length don't meet.  A row with a null id is no anchor, but can be a positive or negative.  Every
    row counts for itself, also one with the same id and vector as another.  An anchor without positives, or a window
    without negatives, gives no row.  Other columns of ``df`` don't matter.  Products beyond a long are an OverflowError.
    """
    asked = F.coalesce(anchors, F.lit(False)) & F.col(id_col).isNotNull()
    known = numbered(df, id_col, vec_col, label=label.cast("long"), anchor=asked).where("label IS NOT NULL")
    rows = stored(known.mapInArrow(_encoder(scale), _ROWS), "integer-vectors")
    own = rows.where("anchor").select("row", "id", "label", "dim", "vec")
    rows = rows.drop("anchor")

    same = in_cells(rows, own, _scorer(positives, True), _FOUND, block_bytes)
    first = _best(same, ["anchor_row"], positives).groupBy("anchor_row").agg(F.collect_list(F.struct("score", "id")).alias("found"))
    limits = stored(first.select(F.col("anchor_row").alias("row"), _in_order("found").alias("positives")), "positives")
    slots = F.array_distinct(F.col("positives.score"))
    cut = own.join(limits, "row").withColumn("limits", slots)
    other = in_cells(rows, cut.drop("positives"), _scorer(negatives, False, positives), _FOUND, block_bytes)
    below = _best(other, ["anchor_row", "slot"], negatives).groupBy("anchor_row", "anchor_id").agg(
        F.collect_list(F.struct("score", "id")).alias("found")
    )
    walked = below.join(limits.withColumnRenamed("row", "anchor_row"), "anchor_row").withColumn("found", _in_order("found"))
    window = F.transform(
        "positives",
        lambda p: F.struct(
            p["id"].alias("positive_id"), p["score"].alias("positive_score"),
            F.slice(F.filter("found", lambda n: _within(n["score"], p["score"], least_percent)), 1, negatives).alias("window"),
        ),
    )
    each = walked.select("anchor_id", F.inline(window)).select("*", F.posexplode("window").alias("place", "negative")).select(
        "anchor_id", "positive_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("negative.id").alias("negative_id"),
        "positive_score", F.col("negative.score").alias("negative_score"),
    )
    return each


def _within(score: Column, limit: Column, least_percent: int) -> Column:
    wide = "decimal(25,0)"
    return (score <= limit) & (score.cast(wide) * 100 >= limit.cast(wide) * least_percent)


def _best(found: DataFrame, group: list[str], k: int) -> DataFrame:
    """The first ``k`` of each group; every task cuts its groups to ``k`` rows before the shuffle."""
    order = Window.partitionBy(*group).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def _in_order(column: str) -> Column:
    """Structs of score and id by score from the greatest, then by id, null last."""
    def before(a: Column, b: Column) -> Column:
        smaller = (a["id"] < b["id"]) | (a["id"].isNotNull() & b["id"].isNull())
        return (
            F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1)
            .when(F.coalesce(smaller, F.lit(False)), -1).when(a["id"].eqNullSafe(b["id"]), 0).otherwise(1)
        )

    return F.array_sort(F.col(column), before)


def _encoder(scale: int) -> Callable:
    """Batches of rows to batches of integer vectors."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, matrix in matrices(batch["vec"]):
                whole = np.floor(scale * matrix)
                if np.abs(whole).max() >= 2.0**63:
                    raise OverflowError("a component does not fit a long")
                own = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [*(own[c] for c in ("row", "id", "label", "anchor")), pa.array(np.full(len(at), dim, np.int32)), packed(whole.astype(np.int64))],
                    names=["row", "id", "label", "anchor", "dim", "vec"],
                )

    return encode


def integer_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All products of the rows of two integer matrices, as long."""
    most = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * left.shape[1]
    if most < 2.0**53:  # then sums of doubles are exact
        return (left.astype(np.float64) @ right.T.astype(np.float64)).astype(np.int64)
    if most < 2.0**62:
        return left @ right.T
    exact = left.astype(object) @ right.T.astype(object)
    if exact.size and max(abs(exact.max()), abs(exact.min())) >= 2**63:
        raise OverflowError("a product does not fit a long")
    return exact.astype(np.int64)


def _first(scores: np.ndarray, mask: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` greatest of each row where ``mask`` holds, best first, ties to the smaller column."""
    n = scores.shape[1]
    if n > k:
        masked = np.where(mask, scores, np.iinfo(np.int64).min)
        mask = mask & (scores >= np.partition(masked, n - k, axis=1)[:, n - k, None])
    r, c = np.nonzero(mask)
    order = np.lexsort((c, -scores[r, c], r))
    r, c = r[order], c[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    return r[place < k], c[place < k]


def _scorer(k: int, same: bool, positives: int = 0) -> Callable:
    """The first ``k`` rows of a block for each anchor: other rows of its label, or rows of other labels in each slot."""

    def score(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        rows = by_id(rows)
        vectors, labels, own = unpacked(rows["vec"], np.int64), rows["label"].to_numpy(), rows["row"].to_numpy()
        asked, asked_label, me = unpacked(anchors["vec"], np.int64), anchors["label"].to_numpy(), anchors["row"].to_numpy()
        limits = None if same else anchors["limits"].to_pylist()
        parts: list[tuple] = []
        for begin in range(0, len(asked), _ANCHORS_AT_ONCE):
            part = slice(begin, begin + _ANCHORS_AT_ONCE)
            products = integer_products(asked[part], vectors)
            alike = asked_label[part, None] == labels
            if same:
                parts.append((0, begin, *_first(products, alike & (me[part, None] != own), k), products))
                continue
            counts = np.array([len(x) for x in limits[part]])
            upper = np.array([x + [0] * (positives - len(x)) for x in limits[part]], np.int64)
            for slot in range(counts.max()):
                last = (slot + 1 >= counts)[:, None]
                lower = upper[:, min(slot + 1, positives - 1), None]
                inside = ~alike & (slot < counts)[:, None] & (products <= upper[:, slot, None]) & (last | (products > lower))
                parts.append((slot, begin, *_first(products, inside, k), products))
        anchor = np.concatenate([r + begin for _, begin, r, _, _ in parts])
        place = np.concatenate([c for _, _, _, c, _ in parts])
        slots = np.concatenate([np.full(len(r), slot, np.int32) for slot, _, r, _, _ in parts])
        scores = np.concatenate([p[r, c] for _, _, r, c, p in parts])
        ask = anchors.select(["row", "id"]).take(pa.array(anchor))
        return pa.table({
            "anchor_row": ask["row"], "anchor_id": ask["id"], "slot": pa.array(slots),
            "id": rows["id"].take(pa.array(place)), "score": pa.array(scores),
        })

    return score
