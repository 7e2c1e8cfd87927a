"""Approximate aggregates that are stored and merged: sizes and magnitudes by quantile sketches, distinct values by counting sketches.

A sketch has bounded size whatever it has seen, and sketches of parts merge to that of the whole, so one pass over packets
gives every later report: by stream, by day, over all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: With this many items kept, ranks are off by less than one part in a hundred in all but about one of a hundred sketches.
K, BITS = 400, 14
RANK_ERROR = 0.01


def sketched(rows: DataFrame, keys: list[str | Column], value: str, distinct: str) -> DataFrame:
    """keys, n, quantiles (KLL sketch of the longs in ``value``) and kinds (HLL sketch of ``distinct``); nulls are in neither."""
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.kll_sketch_agg_bigint(F.col(value).cast("long"), K).alias("quantiles"), F.hll_sketch_agg(F.col(distinct).cast("long"), BITS).alias("kinds"))


def merged(sketches: DataFrame, keys: list[str | Column]) -> DataFrame:
    """The same of fewer keys."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("quantiles").alias("quantiles"), F.hll_union_agg("kinds").alias("kinds"))


def told(sketches: DataFrame, ranks: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """n, the estimated number of distinct values, and the values of these ranks (q50, ...); null where nothing was seen."""
    keys = [c for c in sketches.columns if c not in ("n", "quantiles", "kinds")]
    value = lambda r: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_bigint("quantiles", F.lit(r)))
    return sketches.select(*keys, "n", F.hll_sketch_estimate("kinds").alias("distinct_values"), *[value(r).alias(f"q{round(r * 100)}") for r in ranks])
