"""Current state of an append-only table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def latest_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: str = "ingested_at",
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Newest row per key; ``tiebreak`` columns (greatest first) settle equal ``order``.

    Filtering a ``row_number`` to 1 makes Spark cut every key to one row per map
    task before the shuffle, so a key with a third of all rows stays cheap.  Text
    keys come last in the sort, where they are compared the least.
    """
    text_last = sorted(keys, key=lambda k: isinstance(df.schema[k].dataType, StringType))
    newest_first = [F.col(c).desc_nulls_last() for c in (order, *tiebreak)]
    window = Window.partitionBy(*text_last).orderBy(*newest_first)
    return df.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")
