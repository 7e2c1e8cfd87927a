from pyspark.sql import functions as F

from tessera import __version__
from tessera.functions import records, scalar


def test_defaults(spark):
    box = scalar.rect(*map(F.lit, (0, 0, 8, 8)))
    v = F.struct(F.lit(1).alias("block_x"), F.lit(2).alias("block_y"), F.lit(3).alias("dx"), F.lit(4).alias("dy"), F.lit(5).cast("long").alias("sad"))
    row = spark.range(1).select(
        records.animation().alias("a"), records.solid(box, records.color(1, 2, 3)).alias("s"), records.add_vector(records.d_payload(F.lit(4)), v).alias("d"), records.roi_region(box, confidence=F.lit(1.5)).alias("r"),
        records.scene(F.lit(b"1234")).alias("scene"), records.scene_delta("full_replace", F.lit(3), F.lit(b"12")).alias("delta"), records.ack(F.lit(9)).alias("ack"), records.pong().alias("pong"),
        records.correction_bytes(records.c_payload(F.lit(1), F.array(F.struct(F.lit(b"abc").alias("data")), F.struct(F.lit(b"de").alias("data"))))).alias("bytes"),
        records.dct_region(box, F.array(records.color(*records.WHITE)), F.array(F.struct(F.lit(0).alias("u"), F.lit(1).alias("v"), F.lit(2.5).alias("value")))).alias("dct"), records.i_payload(F.lit(640), F.lit(480), F.lit(30.0)).alias("i"),
    ).first()
    assert row["a"]["zoom_factor"] == 1.0 and row["a"]["duration"] == 1 and row["s"]["pattern_type"] == 0 and row["i"]["quality"] == 1
    assert row["d"]["vectors"][0]["sad"] == 5 and row["r"]["confidence"] == 1.0 and row["scene"]["bounds_max"] == [10.0] * 3
    assert row["delta"]["new_scene_version"] == 4 and row["ack"]["sequence"] == 9 and row["pong"]["command"] == 8 and row["bytes"] == 5
    assert row["dct"]["pattern_type"] == 5 and row["dct"]["dct_coefficients"][0]["value"] == 2.5 and __version__
