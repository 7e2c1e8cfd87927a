"""Colour palettes: one step of k-means as relations, whole palettes per frame in a kernel."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels


def distance_sq(r, g, b, cr, cg, cb) -> Column:
    return (r - cr) * (r - cr) + (g - cg) * (g - cg) + (b - cb) * (b - cb)


def sample(px: DataFrame, rate: float) -> DataFrame:
    """Every floor(max(1 / rate, 1))-th pixel by index i."""
    return px.where(F.col("i") % int(max(1 / rate, 1)) == 0)


def assign(px: DataFrame, centres: DataFrame) -> DataFrame:
    """px with cluster: the nearest centre (frame_id, cluster, cr, cg, cb), the least cluster of equals.

    A frame's centres come as one array, joined by frame: a handful of values, not a cross join.
    """
    held = centres.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("cluster", "cr", "cg", "cb"))).alias("cs"))
    near = F.array_min(F.transform("cs", lambda c: F.struct(distance_sq(F.col("r"), F.col("g"), F.col("b"), c["cr"], c["cg"], c["cb"]).alias("d"), c["cluster"].alias("cluster"))))
    return px.join(held, "frame_id").select("frame_id", "i", "r", "g", "b", near["cluster"].alias("cluster"), near["d"].alias("distance"))


def update(assigned: DataFrame, centres: DataFrame) -> DataFrame:
    """Floor means by cluster; clusters without pixels turn black."""
    means = assigned.groupBy("frame_id", "cluster").agg(*[F.floor(F.sum(c) / F.count("*")).alias(c) for c in "rgb"])
    return centres.select("frame_id", "cluster").join(means, ["frame_id", "cluster"], "left").select("frame_id", "cluster", *[F.coalesce(c, F.lit(0)).alias(c) for c in "rgb"])


def weights(assigned: DataFrame) -> DataFrame:
    """frame_id, cluster, weight of the clusters that have pixels."""
    counts = assigned.groupBy("frame_id", "cluster").agg(F.count("*").alias("n"))
    return counts.select("frame_id", "cluster", (F.col("n") / F.sum("n").over(Window.partitionBy("frame_id"))).alias("weight")).where("weight > 0")


def channel_ranges(px: DataFrame) -> DataFrame:
    return px.groupBy("frame_id").agg(*[f(c).alias(f"{name}_{c}") for c in "rgb" for f, name in ((F.min, "min"), (F.max, "max"))])


PALETTE = "colors array<struct<r: int, g: int, b: int>>, weights array<double>"


def _rows(df: DataFrame, one) -> DataFrame:
    def rows(batches):
        for batch in batches:
            made = [one(d or b"") for d in batch["rgb"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["frame_id"], pa.array([[dict(zip("rgb", c)) for c in m[0]] for m in made], pa.list_(pa.struct([(c, pa.int32()) for c in "rgb"]))), pa.array([m[1] for m in made], pa.list_(pa.float64()))], names=["frame_id", "colors", "weights"])

    return df.select("frame_id", "rgb").mapInArrow(rows, f"frame_id {dict(df.dtypes)['frame_id']}, {PALETTE}")


def kmeans(df: DataFrame, k: int = 5, rounds: int = 10, rate: float = 0.1) -> DataFrame:
    """frame_id, colors, weights of each frame's rgb bytes."""
    return _rows(df, lambda d: kernels.kmeans(d, k, rounds, rate))


def extract(df: DataFrame, colors: int = 5, rounds: int = 10, rate: float = 0.1) -> DataFrame:
    """``kmeans`` with at least one colour and a rate within 0.01 and 1."""
    return kmeans(df, max(1, colors), rounds, min(1.0, max(0.01, rate)))


def median_cut(df: DataFrame, count: int) -> DataFrame:
    return _rows(df, lambda d: (kernels.median_cut(d, count), []))
