"""Run-length masks: runs of v & 1 up to 65535 long, three bytes a run (length little-endian, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar, values


def runs(bits: DataFrame, key: str = "frame_id") -> DataFrame:
    """key, start, value, length from key, pos, bit: gaps and islands, long runs split."""
    w = Window.partitionBy(key).orderBy("pos")
    change = bits.select(key, "pos", F.col("bit").bitwiseAND(F.lit(1)).alias("value")).withColumn("new", F.when(F.col("value").eqNullSafe(F.lag("value").over(w)), 0).otherwise(1))
    island = change.withColumn("island", F.sum("new").over(w)).groupBy(key, "island").agg(F.min("pos").alias("start"), F.first("value").alias("value"), F.count("*").alias("n"))
    part = F.explode(F.expr(f"sequence(0L, (n - 1) div {values.RLE_MAX_RUN})"))
    most = F.lit(values.RLE_MAX_RUN).cast("long")
    return island.select(key, "start", "value", "n", part.alias("k")).select(key, (F.col("start") + F.col("k") * most).alias("start"), "value", F.least(most, F.col("n") - F.col("k") * most).alias("length"))


def encode(run_rows: DataFrame, key: str = "frame_id") -> DataFrame:
    """key and rle bytes of each mask."""
    text = F.transform(F.array_sort(F.collect_list(F.struct("start", "length", "value"))), lambda r: F.concat(scalar.hex_le(r["length"], 2), scalar.hex_be(r["value"], 1)))
    return run_rows.groupBy(key).agg(F.unhex(F.array_join(text, "")).alias("rle"))


def decode(rle: Column, total: Column) -> Column:
    """Array of ``total`` values: zeros where no run reaches; a trailing part of a run is ignored, values are as stored."""
    n = F.floor(F.length(rle) / 3).cast("int")
    each = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array_repeat(F.conv(F.hex(F.substring(rle, i * 3 + 3, F.lit(1))), 16, 10).cast("int"), F.conv(F.concat(F.hex(F.substring(rle, i * 3 + 2, F.lit(1))), F.hex(F.substring(rle, i * 3 + 1, F.lit(1)))), 16, 10).cast("int")))
    return F.slice(F.concat(F.flatten(each), F.array_repeat(F.lit(0), total.cast("int"))), F.lit(1), total.cast("int"))


def person_masks(encoded: DataFrame, foreground: Column, bbox: Column, width: int, height: int) -> DataFrame:
    """Records of masks over whole frames: total is width * height."""
    total = F.lit(width * height).cast("long")
    return encoded.select("*", bbox.alias("bbox"), foreground.alias("foreground"), total.alias("total"), scalar.coverage(foreground, total).alias("coverage"), F.length("rle").alias("mask_size"))
