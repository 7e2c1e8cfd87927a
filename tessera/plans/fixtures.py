"""Relations derived from the star-schema tables, as DataFrames and as the same CTEs in SQL.

Integers come from floor or integer division before any cast, so both engines agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import scan


def blocks8(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, pos, v: each vector of 64 floats as an 8 x 8 block of bytes."""
    v = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("e").cast("double") + 0.5) * 255)))
    return scan(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "e")).select("vec_id", F.col("pos").cast("long").alias("pos"), v.cast("long").alias("v"))


def frames(spark: SparkSession, d: str) -> DataFrame:
    """frame_id, x, y, v: 64 blocks to a frame of 64 x 64; the last frame's missing blocks are zeros."""
    n = scan(spark, d, "embeddings").agg(F.count("*").alias("n"))
    missing = n.select(F.explode(F.expr("filter(sequence(n, n + 63), x -> x < (n + 63) div 64 * 64)")).alias("vec_id"))
    b = blocks8(spark, d).unionByName(missing.select("vec_id", F.explode(F.expr("sequence(0L, 63L)")).alias("pos"), F.lit(0).cast("long").alias("v")))
    return b.select(F.expr("vec_id div 64").alias("frame_id"), F.expr("vec_id % 64 % 8 * 8 + pos % 8").alias("x"), F.expr("(vec_id % 64) div 8 * 8 + pos div 8").alias("y"), "v")


def block_arrays(spark: SparkSession, d: str) -> DataFrame:
    """block, samples: the same blocks as arrays."""
    v = F.transform("embedding", lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e.cast("double") + 0.5) * 255))).cast("double"))
    return scan(spark, d, "embeddings").select(F.col("vec_id").alias("block"), v.alias("samples"))


def frame_rows(spark: SparkSession, d: str) -> DataFrame:
    """frame_id, width, height, data: the same frames as rows of bytes, put together from their 64 blocks."""
    own = block_arrays(spark, d).groupBy(F.expr("block div 64").alias("frame_id")).agg(F.collect_list(F.struct(F.expr("cast(block % 64 as int)").alias("slot"), F.transform("samples", lambda s: s.cast("int")).alias("v"))).alias("own"))

    def rows(batches):
        for batch in batches:
            blocks = batch["own"].flatten()
            v = np.zeros((batch.num_rows, 64, 64), np.uint8)
            row = np.repeat(np.arange(batch.num_rows), batch["own"].value_lengths().to_numpy())
            v[row, blocks.field("slot").to_numpy()] = blocks.field("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, 64)
            data = [x.tobytes() for x in v.reshape(-1, 8, 8, 8, 8).transpose(0, 1, 3, 2, 4)]  # rows of blocks, rows in a block, blocks, columns
            side = pa.array([64] * len(data), pa.int32())
            yield pa.RecordBatch.from_arrays([batch["frame_id"], side, side, pa.array(data, pa.binary())], names=["frame_id", "width", "height", "data"])

    return own.mapInArrow(rows, "frame_id long, width int, height int, data binary")


def rgb(spark: SparkSession, d: str) -> DataFrame:
    """frame_id, i, r, g, b: triples of a vector's values; the blue of the last is the mean of the vector's last two."""
    at = lambda k: F.max(F.when(F.col("pos") % 3 == k, F.col("v")))
    one = blocks8(spark, d).groupBy("vec_id", F.expr("least(pos, 62) div 3").alias("t"))
    last = F.expr("(max(case when pos = 62 then v end) + max(case when pos = 63 then v end)) div 2")
    b = one.agg(F.max(F.when((F.col("pos") % 3 == 0) & (F.col("pos") < 63), F.col("v"))).alias("r"), at(1).alias("g"), F.coalesce(last, at(2)).alias("b"))
    return b.select(F.expr("vec_id div 64").alias("frame_id"), F.expr("vec_id % 64 * 21 + t").alias("i"), "r", "g", "b")


def packets(spark: SparkSession, d: str) -> DataFrame:
    e = scan(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type").isin("view", "click"), 2).when(F.col("event_type") == "error", 3).otherwise(4)
    ms = F.unix_millis("ts") if dict(e.dtypes)["ts"] == "timestamp" else F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    out = e.select(F.col("user_id").alias("stream_id"), F.row_number().over(w).cast("long").alias("sequence"), kind.cast("long").alias("packet_type"), ms.alias("timestamp_ms"), F.floor(F.col("value") * 100).alias("payload_len"), "event_id", "value", "event_type")
    return out.withColumn("size", F.col("payload_len") + 20)


def motion_vectors(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """A vector for each packet, with ``more`` columns of the packet."""
    p = packets(spark, d)
    dx, dy = F.expr("floor(value) % 256 - 128"), F.expr("floor(value * 7) % 256 - 128")
    return p.select("stream_id", "sequence", "event_id", F.expr("event_id % 1000 % 16").alias("block_x"), F.expr("(event_id % 1000) div 16").alias("block_y"), dx.alias("dx"), dy.alias("dy"), (F.abs(dx) + F.abs(dy)).alias("sad"), *more)


def hybrid_frames(spark: SparkSession, d: str) -> DataFrame:
    p = packets(spark, d)
    key = F.col("packet_type") == 1
    delta = (F.col("packet_type") == 2) & (F.col("sequence") % 2 == 0)
    n = F.col("payload_len")
    return p.select(
        "stream_id", "sequence", "timestamp_ms", key.alias("is_keyframe"), F.when(key, F.col("sequence")).alias("scene_version"), F.when(key, n + 16).alias("scene_bytes"),
        F.when(delta, F.col("sequence") + 1).alias("delta_new_version"), F.when(delta, F.expr("payload_len div 4")).alias("delta_bytes"), F.when(F.col("packet_type").isin(1, 3), F.expr("payload_len div 8")).alias("mask_bytes"),
        n.alias("video_bytes"), F.expr("payload_len div 16").alias("audio_bytes"), F.when(key, 640 + F.col("sequence") % 3 * 320).otherwise(0).alias("width"), F.when(key, 480).otherwise(0).alias("height"),
    )


def masks(spark: SparkSession, d: str, long_runs: bool = False) -> DataFrame:
    """frame_id, pos, bit in raster order."""
    bit = (F.col("v") > 127).cast("long") if long_runs else F.col("v").bitwiseAND(F.lit(1))
    return frames(spark, d).select("frame_id", (F.col("y") * 64 + F.col("x")).alias("pos"), bit.alias("bit"))


def bodies(spark: SparkSession, d: str) -> DataFrame:
    return packets(spark, d).select(F.col("stream_id").alias("body_idx"), F.col("sequence").alias("t"), F.col("value").alias("x"), (F.col("value") / 2).alias("y"))


def sync_events(spark: SparkSession, d: str) -> DataFrame:
    m = motion_vectors(spark, d, "event_type")
    kind = F.when(F.col("event_type").isin("view", "click"), "Motion").otherwise("Spawn")
    return m.select("stream_id", "event_id", kind.alias("kind"), F.expr("event_id % 1000").alias("entity"), "dx", "dy", F.lit(0).alias("dz"))


BLOCKS8 = """blocks8 AS (SELECT vec_id, i - 1 AS pos, CAST(least(255, greatest(0, floor((CAST(embedding[i] AS DOUBLE) + 0.5) * 255))) AS BIGINT) AS v
  FROM embeddings CROSS JOIN range(1, 65) AS t(i))"""
FRAMES = BLOCKS8 + """, frames AS MATERIALIZED (SELECT vec_id // 64 AS frame_id, vec_id % 64 % 8 * 8 + pos % 8 AS x, (vec_id % 64) // 8 * 8 + pos // 8 AS y, v
  FROM (SELECT vec_id, pos, v FROM blocks8 UNION ALL SELECT vec_id, i, 0 FROM (SELECT unnest(range(count(*), (count(*) + 63) // 64 * 64)) AS vec_id FROM embeddings) CROSS JOIN range(0, 64) AS p(i)))"""
RGB = BLOCKS8 + """, rgb AS (SELECT vec_id // 64 AS frame_id, vec_id % 64 * 21 + least(pos, 62) // 3 AS i, max(CASE WHEN pos % 3 = 0 AND pos < 63 THEN v END) AS r, max(CASE WHEN pos % 3 = 1 THEN v END) AS g,
  coalesce((max(CASE WHEN pos = 62 THEN v END) + max(CASE WHEN pos = 63 THEN v END)) // 2, max(CASE WHEN pos % 3 = 2 THEN v END)) AS b FROM blocks8 GROUP BY 1, 2)"""
PACKETS = """packets AS (SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence,
  CASE WHEN event_type = 'signup' THEN 1 WHEN event_type IN ('view', 'click') THEN 2 WHEN event_type = 'error' THEN 3 ELSE 4 END AS packet_type,
  epoch_us(ts) // 1000 AS timestamp_ms, CAST(floor(value * 100) AS BIGINT) AS payload_len, event_id, value, event_type, CAST(floor(value * 100) AS BIGINT) + 20 AS size FROM events)"""
VECTORS = PACKETS + """, mv AS (SELECT stream_id, sequence, event_id, event_id % 1000 % 16 AS block_x, event_id % 1000 // 16 AS block_y,
  CAST(floor(value) AS BIGINT) % 256 - 128 AS dx, CAST(floor(value * 7) AS BIGINT) % 256 - 128 AS dy,
  abs(CAST(floor(value) AS BIGINT) % 256 - 128) + abs(CAST(floor(value * 7) AS BIGINT) % 256 - 128) AS sad FROM packets)"""
HYBRID = PACKETS + """, hybrid AS (SELECT stream_id, sequence, timestamp_ms, packet_type = 1 AS is_keyframe, CASE WHEN packet_type = 1 THEN sequence END AS scene_version,
  CASE WHEN packet_type = 1 THEN payload_len + 16 END AS scene_bytes, CASE WHEN packet_type = 2 AND sequence % 2 = 0 THEN sequence + 1 END AS delta_new_version,
  CASE WHEN packet_type = 2 AND sequence % 2 = 0 THEN payload_len // 4 END AS delta_bytes, CASE WHEN packet_type IN (1, 3) THEN payload_len // 8 END AS mask_bytes,
  payload_len AS video_bytes, payload_len // 16 AS audio_bytes, CASE WHEN packet_type = 1 THEN 640 + sequence % 3 * 320 ELSE 0 END AS width,
  CASE WHEN packet_type = 1 THEN 480 ELSE 0 END AS height FROM packets),
  tx AS (SELECT *, coalesce(last_value(CASE WHEN is_keyframe THEN scene_version ELSE delta_new_version END IGNORE NULLS) OVER w, 0) AS tx_scene_version,
  coalesce(last_value(CASE WHEN is_keyframe THEN width END IGNORE NULLS) OVER w, 0) AS tx_width, coalesce(last_value(CASE WHEN is_keyframe THEN height END IGNORE NULLS) OVER w, 0) AS tx_height,
  row_number() OVER (PARTITION BY stream_id ORDER BY sequence) AS tx_sequence, CASE WHEN is_keyframe THEN 0 ELSE timestamp_ms END AS tx_timestamp_ms
  FROM hybrid WINDOW w AS (PARTITION BY stream_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
MASKS = FRAMES + ", masks AS (SELECT frame_id, y * 64 + x AS pos, v & 1 AS bit FROM frames)"
BODIES = PACKETS + ", bodies AS (SELECT stream_id AS body_idx, sequence AS t, value AS x, value / 2 AS y FROM packets)"
SYNC = VECTORS + """, sync AS (SELECT mv.stream_id, mv.event_id, CASE WHEN event_type IN ('view', 'click') THEN 'Motion' ELSE 'Spawn' END AS kind,
  mv.event_id % 1000 AS entity, dx, dy, 0 AS dz FROM mv JOIN packets USING (event_id))"""
