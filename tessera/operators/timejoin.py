"""Joins by time within a key: the last row before (as-of), and the spans that hold a time (interval)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def asof(left: DataFrame, right: DataFrame, on: Sequence[str], time: str, right_time: str | None = None, width: int = 3_600_000, within: int | None = None, name: str = "match") -> DataFrame:
    """left with ``name``, the struct of the last right row of the same key whose time is not after the left row's (null: none).

    time: integers. Of right rows of one key and time the greatest struct counts. ``within``: matches older than that do
    not count. Time is cut to ranges of ``width``: the rows of both sides meet range by range, and the last right row of
    each range reaches later ranges as one row, so a key of any length has many tasks. Left rows with a null key or time match nothing.
    """
    right_time = right_time or time
    keys = list(on)
    r, side, at, run, payload, carried = (fresh(n, left, right) for n in ("r", "side", "at", "run", "payload", "carried"))
    match = F.struct(*[F.col(c) for c in right.columns])
    there = F.col(right_time).isNotNull()
    for c in keys:
        there &= F.col(c).isNotNull()
    events = right.where(there).select(*keys, F.col(right_time).alias(at), match.alias(r))
    events = events.groupBy(*keys, at).agg(F.max(r).alias(r)).withColumn(run, F.floor(F.col(at) / width).cast("long"))
    asked = left.select(*keys, F.col(time).alias(at), F.struct(*[F.col(c) for c in left.columns]).alias(payload)).withColumn(run, F.floor(F.col(at) / width).cast("long"))
    last = events.groupBy(*keys, run).agg(F.max_by(r, at).alias(r))
    both = asked.select(*keys, run, at, F.lit(1).alias(side), payload, F.lit(None).cast(events.schema[r].dataType).alias(r))
    both = both.unionByName(events.select(*keys, run, at, F.lit(0).alias(side), F.lit(None).cast(asked.schema[payload].dataType).alias(payload), r))
    upto = Window.partitionBy(*keys, run).orderBy(at, side).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = both.withColumn(r, F.last(r, ignorenulls=True).over(upto)).where(F.col(side) == 1)
    ranges = asked.select(*keys, run).distinct().select(*keys, run, F.lit(None).cast(events.schema[r].dataType).alias(r), F.lit(1).alias(side)).unionByName(last.withColumn(side, F.lit(0)))
    before = Window.partitionBy(*keys).orderBy(run).rangeBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn(carried, F.last(r, ignorenulls=True).over(before)).where(F.col(side) == 1).select(*keys, run, carried)
    met = own.join(ranges, [*keys, run], "left")
    found: Column = F.coalesce(F.col(r), F.col(carried))
    if within is not None:
        found = F.when(F.col(at) - found[right_time] <= within, found)
    return met.select(f"{payload}.*", found.alias(name))


def stabbed(points: DataFrame, spans: DataFrame, on: Sequence[str], time: str, start: str, end: str, base: int = 1000) -> DataFrame:
    """Points with each span of the same key that holds their time (start <= time < end), columns of both; clashing names are the caller's to resolve.

    A span's class is the least width base * 4 ** c that is not below its length, so it meets two bins of its class at
    most, however long it is. Points look into one bin of each class that spans have; there are at most 32 classes.
    Bins are join keys, which adaptive execution splits where they are hot. Empty spans and nulls hold nothing.
    """
    taken = set(on) | {start, end}
    clash = (set(points.columns) - set(on)) & (set(spans.columns) - set(on))
    if clash:
        raise ValueError(f"both sides have columns {sorted(clash)}")
    k, b = (fresh(n, points, spans) for n in ("k", "b"))
    length = F.col(end) - F.col(start)
    kind = F.greatest(F.lit(0), F.ceil(F.log(4.0, length.cast("double") / base))).cast("int")
    kind = F.when(length > F.lit(base).cast("long") * F.pow(F.lit(4.0), kind).cast("long"), kind + 1).otherwise(kind)  # logarithms round
    width = lambda c: F.lit(base).cast("long") * F.pow(F.lit(4.0), c).cast("long")
    bin_ = lambda t, c: F.floor(t / width(c)).cast("long")
    whole = spans.where(F.col(end) > F.col(start)).withColumn(k, kind)
    whole = whole.withColumn(b, F.explode(F.sequence(bin_(F.col(start), F.col(k)), bin_(F.col(end) - 1, F.col(k)))))
    kinds = sorted(r[0] for r in spans.where(F.col(end) > F.col(start)).select(kind).distinct().collect())  # at most 32
    if not kinds:
        kinds = [0]
    at = points.where(F.col(time).isNotNull()).withColumn(k, F.explode(F.array(*[F.lit(c) for c in kinds]))).withColumn(b, bin_(F.col(time), F.col(k)))
    met = at.join(whole, [*on, k, b]).where((F.col(start) <= F.col(time)) & (F.col(time) < F.col(end)))
    return met.select(*points.columns, *[c for c in spans.columns if c not in on or c in taken - set(on)])


def sliding_rate(rows: DataFrame, key: str, time: str, size: str, window_ms: int, width: int | None = None) -> DataFrame:
    """rows with window_bytes and window_rows: sums over the rows of the key in (time - window_ms, time], and rate_bps.

    A RANGE frame over time. Time is cut to ranges of ``width`` (window_ms * 16 by default); each range gets a halo of
    copies of the rows less than window_ms before it, so a hot key has many tasks and a row at most one copy.
    """
    width = max(width or 16 * window_ms, window_ms)
    run, copy = fresh("run", rows), fresh("copy", rows)
    own = rows.withColumn(run, F.floor(F.col(time) / width).cast("long"))
    ahead = F.floor((F.col(time) + window_ms - 1) / width).cast("long")
    both = own.withColumn(run, F.explode(F.when(ahead > F.col(run), F.array(F.col(run), ahead)).otherwise(F.array(F.col(run)))))
    both = both.withColumn(copy, F.col(run) > F.floor(F.col(time) / width))
    over = Window.partitionBy(key, run).orderBy(time).rangeBetween(-(window_ms - 1), Window.currentRow)
    total = F.sum(size).over(over)
    out = both.select("*", total.alias("window_bytes"), F.count("*").over(over).alias("window_rows")).where(~F.col(copy))
    return out.select(*rows.columns, "window_bytes", "window_rows", (F.col("window_bytes") * 8000.0 / window_ms).alias("rate_bps"))


def sessions(rows: DataFrame, key: str, time: str, size: str, gap_ms: int, span: int = 86_400_000) -> DataFrame:
    """key, start_ms, end_ms (last row), packets, bytes of each session: rows less than ``gap_ms`` apart.

    First within ranges of time; a session that ends or begins less than ``gap_ms`` from a range's edge may go on in the
    next, so these few merge across ranges. So a hot key has many tasks.
    """
    if gap_ms > span:
        raise ValueError("span is shorter than the gap")

    def merged(parts: DataFrame, by: list[str]) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("start_ms", "end_ms")
        new = F.when(F.col("start_ms") - F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1)) < gap_ms, 0).otherwise(1)
        number = parts.withColumn("__new", new).withColumn("__session", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        return number.groupBy(*by, "__session").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes")).drop("__session")

    own = rows.where(F.col(time).isNotNull()).select(key, F.floor(F.col(time) / span).cast("long").alias("__run"), F.col(time).alias("start_ms"), F.col(time).alias("end_ms"), F.lit(1).cast("long").alias("packets"), F.col(size).alias("bytes"))
    parts = merged(own, [key, "__run"])
    edge = (F.col("start_ms") - F.col("__run") * span < gap_ms) | ((F.col("__run") + 1) * span - F.col("end_ms") < gap_ms)
    return parts.where(~edge).drop("__run").unionByName(merged(parts.where(edge).drop("__run"), [key]))
