"""What a batch changes in a table, as DataFrame algebra.  ``store`` does the writing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .latest import latest_per_key


def new_observations(
    incoming: DataFrame,
    history: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    compare: str = "any",
    order: str = "ingested_at",
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Incoming rows whose (key, value) tuple is not stored yet; NULL equals NULL.

    ``compare="any"`` looks at every stored revision.  ``compare="latest"`` only
    looks at the current one, so a value that returns to an earlier state is
    recorded again.  Other columns (ingest time, source) never count.

    An anti join needs the history as it is: equal tuples in it change nothing.
    Of several revisions of one key and ingest time the greatest counts as the
    latest, by ``tiebreak`` or else by the values.
    """
    columns = [*keys, *values]
    if compare == "any":
        stored = history.select(*columns)
    elif compare == "latest":
        stored = latest_per_key(history, keys, order, tiebreak or values).select(*columns)
    else:
        raise ValueError(f"compare must be 'any' or 'latest', not {compare!r}")
    same = reduce(and_, [F.col(f"i.{c}").eqNullSafe(F.col(f"s.{c}")) for c in columns])
    return incoming.alias("i").join(stored.alias("s"), same, "left_anti")


def merged_rows(
    target: DataFrame, source: DataFrame, keys: Sequence[str], written: DataFrame | None = None
) -> DataFrame:
    """Table contents after an upsert: source rows replace target rows of equal key.

    NULL keys never match, so such rows are kept and added.  ``written`` is ``source`` with what a writer adds to it,
    as an observation.
    """
    untouched = target.join(source.select(*keys), list(keys), "left_anti")
    return untouched.unionByName(source if written is None else written)


def in_range(market_id: str, start_id: int, end_id: int) -> Column:
    return (F.col("market_id") == market_id) & F.col("date_id").between(start_id, end_id)


def replaced_range(
    target: DataFrame, incoming: DataFrame, market_id: str, start_id: int, end_id: int
) -> DataFrame:
    """Table contents after one market's date range is replaced, emptied days included."""
    inside = F.coalesce(in_range(market_id, start_id, end_id), F.lit(False))
    return target.filter(~inside).unionByName(incoming)
