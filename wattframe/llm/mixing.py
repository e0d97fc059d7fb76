"""Mixing of sources to target weights by Pfair scheduling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Hexadecimal digits that number the ranges of the shuffled order within a source; each range is laid out by itself.
RANGE_DIGITS = 3
#: Targets are a setting; a cycle of more slots is refused, so that it can be sent to every task.
MAX_CYCLE = 100_000


def pfair_slots(targets: DataFrame) -> DataFrame:
    """``source, weight, total, block, slot`` for one cycle of H slots, H the sum of the integer weights (``source, weight``).

    Block k of a source with share w = weight / H is released at slot floor(k / w) and due by ceil((k + 1) / w).
    Each slot goes to the released block that is due first (of equal ones, to the heavier source, then to the
    lesser name): earliest deadline first keeps every source less than one block off its share at every
    slot.  The cycle depends on the weights alone, never on the rows; it is made in one row, in H * sources steps.
    """
    rows = targets.where("weight > 0").groupBy("source").agg(F.sum("weight").cast("long").alias("weight"))
    one = rows.agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("rank"), "source", "weight"))).alias("sources"))
    one = one.withColumn("total", F.aggregate("sources", F.lit(0).cast("long"), lambda n, s: n + s["weight"]))

    def due(entry: Column, weight: Column) -> Column:
        return F.ceil((entry + 1) * F.col("total") / weight).cast("long")

    def step(state: Column, slot: Column) -> Column:
        done, order = state["done"], state["order"]
        waiting = F.transform(
            F.col("sources"),
            lambda s, i: F.when(
                F.floor(F.get(done, i) * F.col("total") / s["weight"]) <= slot,
                F.struct(due(F.get(done, i), s["weight"]).alias("due"), i.alias("i")),
            ),
        )
        chosen = F.array_min(F.filter(waiting, lambda w: w.isNotNull()))["i"]
        return F.struct(
            F.transform(done, lambda k, i: k + (i == chosen).cast("long")).alias("done"),
            F.concat(order, F.array(F.struct(
                chosen.cast("int").alias("i"), F.get(done, chosen).alias("block"), slot.cast("long").alias("slot")
            ))).alias("order"),
        )

    start = F.struct(
        F.transform("sources", lambda s: F.lit(0).cast("long")).alias("done"),
        F.array().cast("array<struct<i: int, block: bigint, slot: bigint>>").alias("order"),
    )
    cycle = one.where("total > 0").select("sources", "total", F.explode(
        F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("total") - 1), start, step)["order"]
    ).alias("o"))
    return cycle.select(
        F.get("sources", F.col("o.i"))["source"].alias("source"),
        F.get("sources", F.col("o.i"))["weight"].alias("weight"), "total", "o.block", "o.slot",
    )


def mixed(
    docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    block_chars: int = 1 << 16, seed: int = 42, keep: tuple[str, ...] = (),
) -> DataFrame:
    """``id, source, block, slot, place`` and ``kept``, a struct of the ``keep`` columns, for every row: its place in the mixture.

    The rows of a source are shuffled by hash and cut into blocks of about ``block_chars`` characters (a row belongs
    to the block in which it begins).  Block k takes the slot that the Pfair cycle gives it, so that reading in
    the order of ``slot, place`` meets every source at its target weight, less than one block off, until a
    source ends; what is left of the others follows in the same proportions.  No row is dropped or repeated.

    Where a row begins comes from sums at two levels: the sums of a fixed number of ranges of the hash by source,
    and within a range a running sum.  So a source with any number of rows is spread over all tasks.

    A null source is a source of its own, named ''.  Sources without a target or with weight 0 have no
    slots; their rows come last, with a null slot, in the order of source, block, place.  A null or empty text counts
    one character, so that a block has a bounded number of rows.  Rows of equal id follow each other.
    """
    slots = targets.where("weight > 0").agg(F.sum("weight")).first()[0] or 0
    if slots > MAX_CYCLE:
        raise ValueError(f"the target weights add up to {slots}; at most {MAX_CYCLE} slots make a cycle")
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.greatest(F.coalesce(F.length(F.col(text_col)), F.lit(0)), F.lit(1)).cast("long").alias("size"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))).alias("h"),
        F.xxhash64(F.col(text_col)).alias("tx"), *([F.struct(*keep).alias("kept")] if keep else []),
    ).withColumn("part", F.substring("h", 1, RANGE_DIGITS))
    sums = rows.groupBy("source", "part").agg(F.sum("size").alias("total"))
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("begin", F.coalesce(F.sum("total").over(before), F.lit(0))).drop("total")
    within = W.partitionBy("source", "part").orderBy("h", "id", "tx").rowsBetween(W.unboundedPreceding, -1)
    inner = F.coalesce(F.sum("size").over(within), F.lit(0))
    laid = rows.withColumn("inner", inner).join(sums, ["source", "part"]).withColumn("place", F.expr("begin + inner"))
    laid = laid.withColumn("block", F.expr(f"place div {int(block_chars)}"))

    cycle = pfair_slots(targets)
    weights = cycle.select("source", "weight", "total").distinct()
    laid = laid.join(F.broadcast(weights), "source", "left").withColumn("k", F.pmod("block", "weight"))
    first = cycle.select("source", F.col("block").alias("k"), F.col("slot").alias("first"))
    return laid.join(F.broadcast(first), ["source", "k"], "left").select(
        "id", "source", "block", F.expr("block div weight * total + first").alias("slot"), "place",
        *(["kept"] if keep else []),
    )
