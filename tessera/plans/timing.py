"""Queries by time: recovery, stateful table functions, as-of and interval joins, sliding rates, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sqlfuncs
from ..operators import recovery, sketches, stream, timejoin
from ..sources import tables
from . import fixtures as fx
from .queries import longs, query


def arrivals(spark, d) -> DataFrame:
    """stream_id, sequence, arrival_ms: packets sent a second apart, up to six seconds under way; one in 13 is lost, one in 11 comes twice."""
    p = fx.packets(spark, d).where("event_id % 13 <> 0")
    times = F.when(F.col("event_id") % 11 == 0, F.array(F.lit(0), F.lit(2500))).otherwise(F.array(F.lit(0)))
    return p.select("stream_id", "sequence", F.expr("sequence * 1000 + event_id * 7919 % 6000").alias("sent"), F.explode(times).alias("again")).select("stream_id", "sequence", (F.col("sent") + F.col("again")).alias("arrival_ms"))


ARRIVALS = fx.PACKETS + """, arrivals AS (SELECT stream_id, sequence, sequence * 1000 + event_id * 7919 % 6000 + again AS arrival_ms FROM packets, (VALUES (0), (2500)) AS t(again)
  WHERE event_id % 13 <> 0 AND (again = 0 OR event_id % 11 = 0)),
once AS (SELECT stream_id, sequence, min(arrival_ms) AS arrival_ms, count(*) AS copies FROM arrivals GROUP BY 1, 2),
missed AS (SELECT *, min(arrival_ms) OVER (PARTITION BY stream_id ORDER BY sequence ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS missed,
  sequence - coalesce(lag(sequence) OVER (PARTITION BY stream_id ORDER BY sequence), 0) - 1 AS lost_before FROM once),
ready AS (SELECT *, greatest(least(arrival_ms, missed + 2000), CASE WHEN lost_before > 0 THEN least(arrival_ms, missed) + 2000 END) AS ready, coalesce(arrival_ms > missed + 2000, false) AS late FROM missed),
recovered AS (SELECT stream_id, sequence, copies, arrival_ms, CASE WHEN late THEN 'late' ELSE 'released' END AS status, CASE WHEN missed < arrival_ms THEN missed END AS missed_ms, lost_before,
  CASE WHEN NOT late THEN max(ready) OVER (PARTITION BY stream_id ORDER BY sequence) END AS release_ms FROM ready)"""


@query(f"WITH {ARRIVALS} SELECT * FROM recovered")
def w10_recovery(spark, d):
    """What a receiver with a reorder buffer releases and when; it waits two seconds for what is missed."""
    return recovery.recover(arrivals(spark, d), 2000)


@query(f"""WITH {ARRIVALS} SELECT stream_id, count_if(status = 'released') AS released, count_if(status = 'late') AS late, CAST(sum(copies - 1) AS BIGINT) AS repeated, CAST(sum(lost_before) AS BIGINT) AS lost,
  count_if(missed_ms IS NOT NULL) AS asked, max(release_ms - arrival_ms) AS longest_wait_ms FROM recovered GROUP BY 1""")
def w10_recovery_stats(spark, d):
    return recovery.recovery_stats(recovery.recover(arrivals(spark, d), 2000))


# --- the transmitter and receiver as table functions ---------------------------------------------------------------


def boxed_frames(spark, d) -> DataFrame:
    """Hybrid frames whose masks have a box."""
    h = fx.hybrid_frames(spark, d)
    box = F.array(F.col("sequence") % 64, F.col("video_bytes") % 48, 16 + F.col("sequence") % 32, 16 + F.col("video_bytes") % 16)
    return h.withColumn("person_bbox", F.when(F.col("mask_bytes").isNotNull(), box))


BOX = ["sequence % 64", "video_bytes % 48", "16 + sequence % 32", "16 + video_bytes % 16"]
BOX_SQL = ", ".join(f"last_value(CASE WHEN mask_bytes IS NOT NULL THEN {b} END IGNORE NULLS) OVER w AS box_{n}" for b, n in zip(BOX, "xywh"))
RECEIVED = f"""SELECT stream_id, sequence, last_value(CASE WHEN is_keyframe AND scene_bytes > 0 THEN 1 END IGNORE NULLS) OVER w IS NOT NULL AS render_background,
  coalesce(last_value(CASE WHEN is_keyframe AND scene_bytes > 0 THEN scene_version END IGNORE NULLS) OVER w, 0) AS scene_version, last_value(CASE WHEN mask_bytes IS NOT NULL THEN sequence END IGNORE NULLS) OVER w AS mask_from,
  {BOX_SQL}, video_bytes AS person_video_size, tx_width AS frame_width, tx_height AS frame_height, count(*) OVER w AS frames_received FROM tx WINDOW w AS (PARTITION BY stream_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def _box(column: str) -> list:
    return [F.get(column, F.lit(k)).alias(f"box_{n}") for k, n in enumerate("xywh")]


@query(f"WITH {fx.HYBRID} {RECEIVED}")
def w3_receive_boxes(spark, d):
    """Composite instructions with the person's box, which stays until the next mask."""
    r = stream.receive(boxed_frames(spark, d))
    return longs(r.select("stream_id", "sequence", "render_background", "scene_version", "mask_from", *_box("person_bbox"), "person_video_size", "frame_width", "frame_height", "frames_received"))


@query(f"WITH {fx.HYBRID} {RECEIVED}")
def w3_receive_by_sql(spark, d):
    """The same from SQL: a table function with the receiver's state."""
    sqlfuncs.register(spark)
    return longs(spark.sql("SELECT * FROM hybrid_receiver(TABLE({frames}))", frames=boxed_frames(spark, d)).select(
        "stream_id", "sequence", "render_background", F.col("rx_scene_version").alias("scene_version"), "mask_from", *_box("rx_person_bbox"), "person_video_size", "frame_width", "frame_height", "frames_received"))


@query(f"""WITH {fx.HYBRID}, sums AS (SELECT *, sum(coalesce(CASE WHEN is_keyframe THEN scene_bytes ELSE delta_bytes END, 0) + coalesce(mask_bytes, 0) + video_bytes + audio_bytes) OVER w AS hybrid_bytes, sum(tx_width * tx_height * 3 // 20) OVER w AS traditional_bytes
  FROM tx WINDOW w AS (PARTITION BY stream_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  SELECT stream_id, sequence, tx_sequence, tx_scene_version, tx_width, tx_height, tx_timestamp_ms, CAST(hybrid_bytes AS BIGINT) AS hybrid_bytes, CAST(traditional_bytes AS BIGINT) AS traditional_bytes, CASE WHEN traditional_bytes = 0 THEN 0 ELSE floor((1 - hybrid_bytes / traditional_bytes) * 100) END AS saved_whole_percent FROM sums""")
def w1_transmit_by_sql(spark, d):
    """The transmitter as a table function: numbers, scene versions, running totals and savings so far."""
    sqlfuncs.register(spark)
    out = spark.sql("SELECT * FROM hybrid_transmitter(TABLE({frames}))", frames=fx.hybrid_frames(spark, d))
    return longs(out.select("stream_id", "sequence", "tx_sequence", "tx_scene_version", "tx_width", "tx_height", "tx_timestamp_ms", "hybrid_bytes", "traditional_bytes", F.floor("saved_percent").cast("double").alias("saved_whole_percent")))


# --- joins by time ---------------------------------------------------------------------------------------------------

KEYS = "keys AS (SELECT stream_id, timestamp_ms, max(sequence) AS sequence FROM packets WHERE packet_type = 1 GROUP BY 1, 2)"


@query(f"""WITH {fx.PACKETS}, {KEYS} SELECT d.stream_id, d.sequence, d.timestamp_ms, k.sequence AS key_sequence, d.timestamp_ms - k.timestamp_ms AS key_age_ms
  FROM (SELECT * FROM packets WHERE packet_type <> 1) d ASOF LEFT JOIN keys k ON d.stream_id = k.stream_id AND d.timestamp_ms >= k.timestamp_ms""")
def j8_asof_keyframes(spark, d):
    """Each packet with its stream's last keyframe by time; ranges of a day."""
    p = fx.packets(spark, d)
    rest, keys = p.where("packet_type <> 1").select("stream_id", "sequence", "timestamp_ms"), p.where("packet_type = 1").select("stream_id", "timestamp_ms", "sequence")
    out = timejoin.asof(rest, keys, ["stream_id"], "timestamp_ms", width=86_400_000, name="key")
    return out.select("stream_id", "sequence", "timestamp_ms", F.col("key.sequence").alias("key_sequence"), (F.col("timestamp_ms") - F.col("key.timestamp_ms")).alias("key_age_ms"))


@query(f"""WITH {fx.PACKETS}, s AS (SELECT stream_id, event_id AS span, timestamp_ms AS begin_ms, timestamp_ms + payload_len * payload_len * CASE WHEN event_id % 10 = 0 THEN 100 ELSE 1 END AS end_ms FROM packets WHERE packet_type = 3)
  SELECT p.stream_id, p.sequence, s.span FROM packets p JOIN s ON p.stream_id = s.stream_id AND p.timestamp_ms >= begin_ms AND p.timestamp_ms < end_ms""")
def j9_spans(spark, d):
    """Packets within the time spans that errors open: from nothing to hours, one in ten a hundred times as long."""
    p = fx.packets(spark, d)
    end = F.col("timestamp_ms") + F.col("payload_len") * F.col("payload_len") * F.when(F.col("event_id") % 10 == 0, 100).otherwise(1)
    spans = p.where("packet_type = 3").select("stream_id", F.col("event_id").alias("span"), F.col("timestamp_ms").alias("begin_ms"), end.alias("end_ms"))
    return timejoin.stabbed(p.select("stream_id", "sequence", "timestamp_ms"), spans, ["stream_id"], "timestamp_ms", "begin_ms", "end_ms").select("stream_id", "sequence", "span")


@query(f"""WITH {fx.PACKETS} SELECT stream_id, sequence, CAST(sum(size) OVER w AS BIGINT) AS window_bytes, count(*) OVER w AS window_rows, round(sum(size) OVER w * 8000.0 / 86400000, 4) AS rate_bps FROM packets
  WINDOW w AS (PARTITION BY stream_id ORDER BY timestamp_ms RANGE BETWEEN 86399999 PRECEDING AND CURRENT ROW)""")
def w11_sliding_bitrate(spark, d):
    """Bytes of the day up to each packet."""
    p = fx.packets(spark, d).select("stream_id", "sequence", "timestamp_ms", "size")
    return timejoin.sliding_rate(p, "stream_id", "timestamp_ms", "size", 86_400_000, width=4 * 86_400_000).select("stream_id", "sequence", "window_bytes", "window_rows", F.round("rate_bps", 4).alias("rate_bps"))


@query(f"""WITH {fx.PACKETS}, g AS (SELECT stream_id, timestamp_ms, size, CASE WHEN timestamp_ms - lag(timestamp_ms) OVER (PARTITION BY stream_id ORDER BY timestamp_ms) < 21600000 THEN 0 ELSE 1 END AS new FROM packets),
  n AS (SELECT *, sum(new) OVER (PARTITION BY stream_id ORDER BY timestamp_ms) AS session FROM g)
  SELECT stream_id, min(timestamp_ms) AS start_ms, max(timestamp_ms) AS end_ms, count(*) AS packets, CAST(sum(size) AS BIGINT) AS bytes FROM n GROUP BY stream_id, session""")
def w12_sessions(spark, d):
    """Sessions of each stream: packets less than six hours apart."""
    return timejoin.sessions(fx.packets(spark, d), "stream_id", "timestamp_ms", "size", 21_600_000)


# --- sketches -----------------------------------------------------------------------------------------------------------


@query(f"""WITH {fx.PACKETS} SELECT packet_type, count(*) AS n, count(DISTINCT stream_id) AS streams, true AS streams_near, true AS q50_near, true AS q90_near, true AS q99_near FROM packets GROUP BY 1""")
def a16_sketches(spark, d):
    """Sizes by kind from sketches by kind and day, merged: the values that they give for three ranks are within the bound of ranks, and their number of streams within five in a hundred, of the exact ones."""
    p = fx.packets(spark, d)
    daily = tables.stored(sketches.sketched(p, ["packet_type", F.expr("timestamp_ms div 86400000").alias("day")], "size", "stream_id"), "sketches")
    made = sketches.told(sketches.merged(daily, ["packet_type"]))
    ranks = {"q50": 0.5, "q90": 0.9, "q99": 0.99}
    met = p.join(made.withColumnRenamed("packet_type", "kind"), F.col("packet_type") == F.col("kind"))
    below = [c for q in ranks for c in (F.count_if(F.col("size") < F.col(q)).alias(f"{q}_below"), F.count_if(F.col("size") <= F.col(q)).alias(f"{q}_upto"))]
    exact = met.groupBy("packet_type").agg(F.first("n").alias("n"), F.count_distinct("stream_id").alias("streams"), F.first("distinct_values").alias("estimate"), F.count("*").alias("rows"), *below)
    slack = 3 * sketches.RANK_ERROR * F.col("rows") + 1  # merged of thirty days
    near = [((F.col(f"{q}_below") <= r * F.col("rows") + slack) & (F.col(f"{q}_upto") >= r * F.col("rows") - slack)).alias(f"{q}_near") for q, r in ranks.items()]
    return exact.select("packet_type", "n", "streams", (F.abs(F.col("estimate") - F.col("streams")) <= 0.05 * F.col("streams") + 1).alias("streams_near"), *near)
