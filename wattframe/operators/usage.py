"""Request-log analytics."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fill import forward_fill
from .staging import stored

_MICROS = 1_000_000


def usage_summary(events: DataFrame, api_keys: DataFrame, since: datetime | None = None) -> DataFrame:
    """Requests, errors, mean latency and last use per key, busiest first.

    Aggregates before the join, so the key table meets one row per key id.
    """
    if since is not None:
        events = events.filter(F.col("occurred_at") >= F.lit(since))
    per_key = events.groupBy("key_id").agg(
        F.count("*").alias("requests"),
        F.sum((F.col("status_code") >= 400).cast("long")).alias("errors"),
        F.round(F.avg("duration_ms"), 1).alias("avg_ms"),
        F.max("occurred_at").alias("last_seen"),
    )
    names = api_keys.select(F.col("id").alias("key_id"), "display", "name")
    return (
        per_key.join(names, "key_id", "left")
        .select(
            F.coalesce("display", F.lit("<unauthenticated>")).alias("key_display"),
            F.coalesce("name", F.lit("-")).alias("name"),
            "requests", "errors", "avg_ms", "last_seen",
        )
        .orderBy(F.col("requests").desc(), "key_display")
    )


def requests_since(events: DataFrame, since: datetime) -> DataFrame:
    """Number of requests per key at or after an instant."""
    return (
        events.filter(F.col("occurred_at") >= F.lit(since))
        .groupBy("key_id")
        .agg(F.count("*").alias("n"))
    )


def trailing_requests(
    events: DataFrame, seconds: int = 60, chunk_seconds: int = 600, weight: str | None = None
) -> DataFrame:
    """Add ``recent``: the key's requests in the ``seconds`` up to and including each one.

    A request exactly ``seconds`` old no longer counts.  Each key is cut into time
    chunks; requests close to the end of a chunk are repeated in the next one as
    context, so every chunk is counted on its own and a busy key is spread out.
    ``weight`` names a column with the number of requests a row stands for.
    """
    span, window = _in_chunks(seconds, chunk_seconds)
    recent = _in_span(F.count("*") if weight is None else F.sum(weight), span, window)
    if weight is not None:  # NULL where the span has no weight at all
        recent = F.when(_in_span(F.count(weight), span, window) > 0, recent)
    return _chunked(events, span, chunk_seconds, after=False).withColumn("recent", recent).filter("_own").drop("_us", "_chunk", "_own")


def _in_chunks(seconds: int, chunk_seconds: int) -> tuple[int, Window]:
    """The span in microseconds, and the window over a key's chunk."""
    if chunk_seconds < seconds:
        raise ValueError("chunk_seconds must be at least as long as the counted span")
    return seconds * _MICROS, Window.partitionBy("key_id", "_chunk").orderBy("_us")


def _in_span(total: Column, span: int, window: Window) -> Column:
    """A count or sum over the span up to and including each row, as the difference of two that only grow.

    A frame that slides is added up anew at every row, which is the square of the rows in a span.
    """
    upto = total.over(window.rangeBetween(Window.unboundedPreceding, 0))
    expired = F.when(F.col("_us").isNotNull(), total.over(window.rangeBetween(Window.unboundedPreceding, -span)))
    return upto - F.coalesce(expired, F.lit(0))


def _chunked(events: DataFrame, span: int, chunk_seconds: int, after: bool) -> DataFrame:
    """Rows with their chunk of time, and those near its end (its beginning: ``after``) again in the next (previous) one."""
    size = chunk_seconds * _MICROS
    micros = F.unix_micros(F.col("occurred_at").cast("timestamp"))
    own = F.floor(F.col("_us") / F.lit(size)).cast("long")

    def cell(chunk: Column, owned: bool) -> Column:
        return F.struct(chunk.alias("_chunk"), F.lit(owned).alias("_own"))

    cells = [cell(own, True), F.when(F.col("_us") > (own + 1) * size - span, cell(own + 1, False))]
    if after:
        cells.append(F.when(F.col("_us") < own * size + span, cell(own - 1, False)))
    return events.withColumn("_us", micros).select("*", F.inline(F.array_compact(F.array(*cells))))


def over_limit(events: DataFrame, api_keys: DataFrame, seconds: int = 60) -> DataFrame:
    """Keys whose busiest span exceeds their per-minute limit.

    Requests of one instant are counted first, so a burst is a single row.
    """
    instants = events.groupBy("key_id", "occurred_at").agg(F.count("*").alias("n"))
    busiest = trailing_requests(instants, seconds, 10 * seconds, weight="n")
    peaks = busiest.groupBy("key_id").agg(F.max("recent").alias("peak"))
    limits = api_keys.select(F.col("id").alias("key_id"), "rate_limit_per_min")
    return peaks.join(limits, "key_id").filter(F.col("peak") > F.col("rate_limit_per_min"))


# ---- admission: the limit as it is enforced, where a refused request does not count -----


def admission(
    events: DataFrame,
    limits: DataFrame,
    order: Sequence[str],
    seconds: int = 60,
    chunk_seconds: int | None = None,
) -> DataFrame:
    """Add to every request ``allowed``, ``limit``, ``remaining`` and ``retry_after``, as a limiter would have answered.

    ``limits`` has ``key_id`` and ``limit``, once per key: a request is allowed if fewer than ``limit`` allowed ones lie
    in the ``seconds`` before it (one exactly that old no longer counts); a refused one is not counted.  ``remaining`` is
    what is left after it, ``retry_after`` whole seconds until the oldest counted one expires, at least 1, and 0 if it is allowed.
    Requests of one key and instant are taken in the order of the columns ``order``.  Keys without a limit, and
    unauthenticated requests, are allowed, with NULL as ``remaining``; under a limit below 1 all are refused, with
    NULL as ``retry_after``.

    Whether a request is allowed depends on those before it, so this is a fold; but only where it must be.  A request
    with at most ``limit`` requests in its span, refused ones included, is allowed whatever happened before.  Therefore
    requests with no excess in the span before them are answered from the trailing count, which is cut into chunks
    of time.  What is left, requests around an excess, forms runs separated by quiet spans or by requests whose
    answers are known.  Runs are independent of each other; a run passes through a task as a stream of
    instants in order, of which the limiter's queue (at most ``limit`` instants) is kept, and goes back as one answer an instant.
    So a busy key is spread over its runs.  Only a key that exceeds its limit without a pause stays one run; its
    instants, four numbers each, are then read by one task, and never gathered.  The marked instants are stored, which
    runs a job when the frame is built.
    """
    chunk = chunk_seconds or 10 * seconds
    named = limits.select("key_id", F.col("limit").cast("long").alias("limit"))
    instants = events.where("key_id IS NOT NULL AND occurred_at IS NOT NULL").groupBy("key_id", "occurred_at").agg(F.count("*").alias("_n"))
    counted = trailing_requests(instants.join(named, "key_id"), seconds, chunk, weight="_n")

    span, window = _in_chunks(seconds, chunk)
    over, us = F.col("recent") > F.col("limit"), F.col("_us")
    back = Window.partitionBy("key_id", "_chunk").orderBy(us.desc())
    # the last excess up to each instant and the first one from it on, by frames that only grow
    last = F.max(F.when(over, us)).over(window.rangeBetween(Window.unboundedPreceding, 0))
    next_ = F.min(F.when(over, us)).over(back.rangeBetween(Window.unboundedPreceding, 0))
    within = lambda found: F.when(over.isNotNull(), F.coalesce(found, F.lit(False)))
    marked = stored(
        _chunked(counted, span, chunk, after=True)
        .withColumn("_late", within(last > us - span))
        .withColumn("_early", within(next_ < us + span))
        .filter("_own").drop("_chunk", "_own"),
        "admission",
    )
    busy = marked.filter("_late OR _early")
    first = _in_span(F.count("*"), span, window) == 1
    starts = (
        _chunked(busy.drop("_us"), span, chunk, after=False)
        .withColumn("_run", F.when(first, F.col("_us")))
        .filter("_own").drop("_chunk", "_own")
    )
    runs = forward_fill(starts, ["key_id"], "occurred_at", ["_run"], chunk="day")
    schema = "key_id {0}, occurred_at {1}, limit long, _before long, _taken long, _oldest long".format(
        events.schema["key_id"].dataType.simpleString(), events.schema["occurred_at"].dataType.simpleString()
    )
    folded = (
        runs.select("key_id", "occurred_at", "_us", "_n", "limit", "_run", "_late")
        .repartition("key_id", "_run").sortWithinPartitions("key_id", "_run", "_us")
        .mapInArrow(_limiter(span), "_late boolean, " + schema)
        .filter("_late").drop("_late")
    )
    # Without an excess in the span before, all requests of the span were allowed.
    settled = marked.filter("NOT _late").select(
        "key_id", "occurred_at", "limit", (F.col("recent") - F.col("_n")).alias("_before"),
        F.col("_n").alias("_taken"), F.lit(None).cast("long").alias("_oldest"),
    )
    answers = settled.unionByName(folded)

    place = F.row_number().over(Window.partitionBy("key_id", "occurred_at").orderBy(*order))
    allowed = F.col("limit").isNull() | (F.col("_place") <= F.col("_taken"))
    wait = F.col("_oldest") + span - F.unix_micros(F.col("occurred_at").cast("timestamp"))
    return (
        events.withColumn("_place", place)
        .join(answers, ["key_id", "occurred_at"], "left")
        .withColumn("allowed", allowed)
        .withColumn("remaining", F.when(F.col("allowed"), F.col("limit") - F.col("_before") - F.col("_place")).when(~F.col("allowed"), 0))
        .withColumn("retry_after", F.when(F.col("allowed"), 0).otherwise(F.greatest(F.lit(1), F.floor(wait / _MICROS) + 1)))
        .select(
            *[F.col(c) for c in events.columns], "allowed", "limit", "remaining",
            F.when(F.col("limit").isNull() | F.col("allowed"), F.lit(0)).when(F.col("limit") > 0, F.col("retry_after"))
            .cast("long").alias("retry_after"),
        )
    )


def _limiter(span: int) -> Callable:
    """Instants in order, run by run, to the allowed requests before them, at them, and the oldest that counts."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, queue, held = None, deque(), 0
        for batch in batches:
            before, taken, oldest = [], [], []
            rows = zip(*(batch[c].to_pylist() for c in ("key_id", "_run", "_us", "_n", "limit")))
            for key, start, now, n, limit in rows:
                if run != (key, start):
                    run, held = (key, start), 0
                    queue.clear()
                while queue and queue[0][0] <= now - span:
                    held -= queue.popleft()[1]
                before.append(held)
                taken.append(min(n, max(limit - held, 0)))
                if taken[-1]:
                    queue.append((now, taken[-1]))
                    held += taken[-1]
                oldest.append(queue[0][0] if queue else None)
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in ("_late", "key_id", "occurred_at", "limit")), *(pa.array(c, pa.int64()) for c in (before, taken, oldest))],
                names=["_late", "key_id", "occurred_at", "limit", "_before", "_taken", "_oldest"],
            )

    return fold
