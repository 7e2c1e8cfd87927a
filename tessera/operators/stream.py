"""Stream state in batch: sequences, scene versions, carry-forward, bandwidth and packet statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar


def packet_stats(packets: DataFrame) -> DataFrame:
    """Bytes, packets and packets by type of each stream: one partial aggregation, one small shuffle."""
    kind = F.col("packet_type")
    counts = [F.count_if(kind == k).alias(f"{name}_packets") for k, name in ((1, "i"), (2, "d"), (3, "c"), (4, "s"))]
    return packets.groupBy("stream_id").agg(F.sum("size").alias("total_bytes"), F.count("*").alias("total_packets"), *counts)


def motion_stats(vectors: DataFrame, key: str = "stream_id") -> DataFrame:
    m = scalar.magnitude(F.col("dx"), F.col("dy"))
    return vectors.groupBy(key).agg(F.coalesce(F.avg(m), F.lit(0.0)).alias("avg_magnitude"), F.coalesce(F.max(m), F.lit(0.0)).alias("max_magnitude"))


def carried(frames: DataFrame, marks: dict[str, Column], span: int = 4096) -> DataFrame:
    """``frames`` with the last value so far of each mark (null: none yet) by sequence within stream_id, and ``nth``, the row's number.

    A stream is cut to runs of ``span`` sequences: windows stay within a run, and what earlier runs end with comes from
    one row a run, its last. So a long stream has many tasks, and only its runs meet in one. Both read one shuffle of
    ``frames``: Spark reuses it as long as both need the same columns, which the condition on all of them sees to.
    """
    order = Window.partitionBy("stream_id", "__run").orderBy("sequence")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = frames.select("*", F.expr(f"sequence div {span}").alias("__run"), *[v.alias(f"__{k}") for k, v in marks.items()])
    inside = own.select(*frames.columns, "__run", F.count("*").over(upto).alias("__n"), *[F.last(f"__{k}", ignorenulls=True).over(upto).alias(f"__{k}") for k in marks], F.lead("sequence").over(order).alias("__next"))
    inside = inside.where(F.xxhash64(*inside.columns) % 2 < 2)
    before = Window.partitionBy("stream_id").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    ends = inside.where(F.col("__next").isNull())
    ends = ends.select("stream_id", "__run", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), *[F.last(f"__{k}", ignorenulls=True).over(before).alias(f"__end_{k}") for k in marks])
    met = inside.join(ends, ["stream_id", "__run"])
    return met.select(*frames.columns, (F.col("__n0") + F.col("__n")).alias("nth"), *[F.coalesce(f"__{k}", f"__end_{k}").alias(k) for k in marks])


def transmit(frames: DataFrame) -> DataFrame:
    """Adds tx_sequence, tx_scene_version, tx_width, tx_height and tx_timestamp_ms (keyframes: 0) to hybrid frames."""
    key = F.col("is_keyframe")
    marks = {"tx_scene_version": F.when(key, F.col("scene_version")).otherwise(F.col("delta_new_version")), "tx_width": F.when(key, F.col("width")), "tx_height": F.when(key, F.col("height"))}
    out = carried(frames, marks)
    return out.select(*frames.columns, F.col("nth").alias("tx_sequence"), *[F.coalesce(k, F.lit(0)).alias(k) for k in marks], F.when(key, 0).otherwise(F.col("timestamp_ms")).alias("tx_timestamp_ms"))


def receive(frames: DataFrame, apply_deltas: bool = False) -> DataFrame:
    """Composite instructions. Scene versions move on keyframes only, unless apply_deltas. Where frames have person_bbox, the last mask's is carried."""
    key, boxed = F.col("is_keyframe"), "person_bbox" in frames.columns
    shown = F.when(key & (F.col("scene_bytes") > 0), F.col("scene_version"))
    marks = {"rx_background": F.when(key & (F.col("scene_bytes") > 0), F.lit(True)), "rx_version": F.coalesce(shown, F.col("delta_new_version")) if apply_deltas else shown, "rx_mask": F.when(F.col("mask_bytes").isNotNull(), F.col("sequence")), "rx_width": F.when(key, F.col("width")), "rx_height": F.when(key, F.col("height"))}
    if boxed:  # one mark, so that a mask without a box leaves none
        marks["rx_mask"] = F.when(F.col("mask_bytes").isNotNull(), F.struct(F.col("sequence").alias("sequence"), F.col("person_bbox").alias("box")))
    zero = lambda k: F.coalesce(k, F.lit(0))
    mask = [F.col("rx_mask.sequence").alias("mask_from"), F.col("rx_mask.box").alias("person_bbox")] if boxed else [F.col("rx_mask").alias("mask_from")]
    return carried(frames, marks).select(
        "stream_id", "sequence", F.col("rx_background").isNotNull().alias("render_background"), zero("rx_version").alias("scene_version"), *mask,
        F.col("video_bytes").alias("person_video_size"), zero("rx_width").alias("frame_width"), zero("rx_height").alias("frame_height"), F.col("nth").alias("frames_received"),
    )


def bandwidth(transmitted: DataFrame) -> DataFrame:
    """Bytes by kind, hybrid and traditional totals, and what is saved, of each stream."""
    key = F.col("is_keyframe")
    kinds = {"scene": F.when(key, F.col("scene_bytes")), "delta": F.when(~key, F.col("delta_bytes")), "mask": F.col("mask_bytes"), "video": F.col("video_bytes"), "audio": F.col("audio_bytes")}
    total = sum((F.coalesce(v, F.lit(0)) for v in kinds.values()), F.lit(0))
    plain = F.floor(F.col("tx_width") * F.col("tx_height") * 3 / 20)
    out = transmitted.groupBy("stream_id").agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(f"{k}_bytes") for k, v in kinds.items()], F.sum(total).alias("hybrid_bytes"), F.sum(plain).alias("traditional_bytes"), F.count("*").alias("frame_count"))
    return out.select("*", scalar.savings_percent(F.col("hybrid_bytes"), F.col("traditional_bytes")).alias("saved_percent"), scalar.savings_ratio(F.col("hybrid_bytes"), F.col("traditional_bytes")).alias("saved_ratio"))


def report(stats: DataFrame) -> DataFrame:
    return stats.select("stream_id", F.format_string("frames %d, hybrid %d B (scene %d, delta %d, mask %d, video %d, audio %d), traditional %d B, saved %s %%, ratio %s", "frame_count", "hybrid_bytes", "scene_bytes", "delta_bytes", "mask_bytes", "video_bytes", "audio_bytes", "traditional_bytes", scalar.hundredths(F.col("saved_percent")), scalar.hundredths(F.col("saved_ratio"))).alias("report"))


def resolve_references(packets: DataFrame) -> DataFrame:
    """Delta packets with the keyframe they refer to: key_sequence is null for dangling references."""
    keys = packets.where("packet_type = 1").select("stream_id", F.col("sequence").alias("key_sequence"), F.col("timestamp_ms").alias("key_timestamp_ms"))
    deltas = packets.where("packet_type = 2")
    return deltas.join(keys, (deltas["stream_id"] == keys["stream_id"]) & (deltas["ref_sequence"] == keys["key_sequence"]), "left").select(deltas["stream_id"], "sequence", "ref_sequence", "key_sequence", "key_timestamp_ms")


def resolve_region_deltas(deltas: DataFrame, keyframes: DataFrame) -> DataFrame:
    """deltas (stream_id, sequence, ref_sequence, region_index) with region: the keyframe's (stream_id, sequence, regions) region of that index from 0; null if either is missing."""
    keys = keyframes.select(F.col("stream_id").alias("__s"), F.col("sequence").alias("__q"), F.col("regions").alias("__r"))
    met = deltas.join(keys, (F.col("stream_id") == F.col("__s")) & (F.col("ref_sequence") == F.col("__q")), "left")
    return met.select(*deltas.columns, F.get("__r", F.col("region_index").cast("int")).alias("region"))


def dangling(packets: DataFrame) -> DataFrame:
    keys = packets.where("packet_type = 1").select("stream_id", F.col("sequence").alias("ref_sequence"))
    return packets.where("packet_type = 2").join(keys, ["stream_id", "ref_sequence"], "left_anti")
