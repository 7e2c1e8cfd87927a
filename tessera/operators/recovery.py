"""Recovery from loss and reordering: what a receiver with a reorder buffer releases, when, and what it asks for.

Sequences of a stream count from ``first``. A sequence is missed as soon as a later one arrives; it is asked for then
(Nack). If it is not there ``wait_ms`` after that, it is given up (RequestKeyframe), and what arrives of it later is late.
Packets are released in order, each once all before it are there or given up. Of a sequence that arrives several times the
first counts. All of it follows from arrival times, so the batch form is windows and the streaming form
(``streaming.recovery``) gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by_runs(rows: DataFrame, span: int) -> tuple[DataFrame, Window, Window, Window]:
    """rows with __run, and windows over a run: up to each row, after it, in order."""
    inside = Window.partitionBy("stream_id", "__run").orderBy("sequence")
    own = rows.withColumn("__run", F.expr(f"sequence div {span}"))
    return own, inside.rowsBetween(Window.unboundedPreceding, Window.currentRow), inside.rowsBetween(1, Window.unboundedFollowing), inside


def _of_runs(rows: DataFrame, **made: tuple[Column, Column, bool]) -> DataFrame:
    """(stream_id, __run, ...): for each name the second aggregate of the first over the runs before (True) or after."""
    per_run = rows.groupBy("stream_id", "__run").agg(*[a.alias(f"__{n}") for n, (a, _, _) in made.items()])
    order = Window.partitionBy("stream_id").orderBy("__run")
    over = {True: order.rowsBetween(Window.unboundedPreceding, -1), False: order.rowsBetween(1, Window.unboundedFollowing)}
    return per_run.select("stream_id", "__run", *[b.over(over[before]).alias(n) for n, (_, b, before) in made.items()])


def recover(arrivals: DataFrame, wait_ms: int, first: int = 1, span: int = 4096) -> DataFrame:
    """stream_id, sequence, copies, arrival_ms, status (released or late), missed_ms (when it was asked for, or null), lost_before, release_ms (null if late).

    arrivals: stream_id, sequence, arrival_ms, a row for each time that a packet arrives. lost_before counts sequences that
    never arrive, since the one before. Rows with a null in any of the three are no packets. A stream is cut to runs of
    ``span`` sequences: windows stay in a run, and what other runs give comes as one row a run.
    """
    seen = arrivals.where("stream_id is not null and sequence is not null and arrival_ms is not null")
    once = seen.groupBy("stream_id", "sequence").agg(F.min("arrival_ms").alias("arrival_ms"), F.count("*").alias("copies"))
    own, upto, after, order = _by_runs(once, span)
    ends = _of_runs(own, __low=(F.min("arrival_ms"), F.min("____low"), False), __last=(F.max("sequence"), F.max("____last"), True))
    at = own.join(ends, ["stream_id", "__run"])
    missed = F.least(F.min("arrival_ms").over(after), F.col("__low"))
    before = F.coalesce(F.lag("sequence").over(order), F.col("__last"), F.lit(first - 1))
    at = at.select("stream_id", "sequence", "copies", "arrival_ms", "__run", missed.alias("missed"), (F.col("sequence") - before - 1).alias("lost_before"))
    given_up = F.when(F.col("lost_before") > 0, F.least("arrival_ms", "missed") + wait_ms)
    ready = F.greatest(F.least(F.col("arrival_ms"), F.col("missed") + wait_ms), given_up)
    late = F.coalesce(F.col("arrival_ms") > F.col("missed") + wait_ms, F.lit(False))
    at = at.select("*", ready.alias("ready"), late.alias("late"))
    tops = _of_runs(at, __top=(F.max("ready"), F.max("____top"), True))
    done = F.greatest(F.max("ready").over(upto), F.col("__top"))
    out = at.join(tops, ["stream_id", "__run"])
    return out.select(
        "stream_id", "sequence", "copies", "arrival_ms", F.when(F.col("late"), "late").otherwise("released").alias("status"), F.when(F.col("missed") < F.col("arrival_ms"), F.col("missed")).alias("missed_ms"),
        "lost_before", F.when(~F.col("late"), done).alias("release_ms"),
    )


def recovery_stats(recovered: DataFrame) -> DataFrame:
    """Per stream: released, late, repeated and lost packets, those asked for, and the longest wait in the buffer."""
    waited = F.col("release_ms") - F.col("arrival_ms")
    return recovered.groupBy("stream_id").agg(
        F.count_if(F.col("status") == "released").alias("released"), F.count_if(F.col("status") == "late").alias("late"), F.sum(F.col("copies") - 1).alias("repeated"), F.sum("lost_before").alias("lost"),
        F.count_if(F.col("missed_ms").isNotNull()).alias("asked"), F.max(waited).alias("longest_wait_ms"),
    )
