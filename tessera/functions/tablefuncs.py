"""Table functions with state for SQL: a stream's transmitter and receiver, each an instance per stream.

``SELECT * FROM hybrid_transmitter(TABLE(frames))`` and ``hybrid_receiver(TABLE(frames))``: any table with the columns
needed (NEEDED), each a number or boolean; others are carried along. Streams are dealt by stream_id and come in the order of
sequence. A stream is one instance, so it is in one task; ``operators.stream`` has the same as windows over runs.
"""

from __future__ import annotations

from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

NEEDED = {
    "HybridTransmitter": ("is_keyframe", "scene_version", "scene_bytes", "delta_new_version", "delta_bytes", "mask_bytes", "video_bytes", "audio_bytes", "width", "height", "timestamp_ms"),
    "HybridReceiver": ("is_keyframe", "scene_version", "scene_bytes", "mask_bytes", "video_bytes", "width", "height"),
}


def _analyze(name: str, frames: AnalyzeArgument, made: T.StructType) -> AnalyzeResult:
    if not frames.isTable:
        raise ValueError(f"{name} takes TABLE(...)")
    missing = [c for c in ("stream_id", "sequence", *NEEDED[name]) if c not in frames.dataType.names]
    if missing:
        raise ValueError(f"{name}: the table lacks {', '.join(missing)}")
    clash = set(made.names) & set(frames.dataType.names)
    if clash:
        raise ValueError(f"{name}: the table has columns named {', '.join(sorted(clash))} like the result")
    return AnalyzeResult(schema=T.StructType([*frames.dataType.fields, *made.fields]), partitionBy=[PartitioningColumn("stream_id")], orderBy=[OrderingColumn("sequence")])


def _longs(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


class HybridTransmitter:
    """Numbers the frames, keeps the scene version and counts bytes: running totals, savings so far."""

    MADE = T.StructType([*_longs("tx_sequence", "tx_scene_version", "tx_width", "tx_height", "tx_timestamp_ms", "hybrid_bytes", "traditional_bytes"), T.StructField("saved_percent", T.DoubleType()), T.StructField("saved_ratio", T.DoubleType())])

    def __init__(self):
        self.sequence = self.scene_version = self.width = self.height = self.hybrid = self.traditional = 0

    @staticmethod
    def analyze(frames: AnalyzeArgument) -> AnalyzeResult:
        return _analyze("HybridTransmitter", frames, HybridTransmitter.MADE)

    def eval(self, frame: T.Row):
        self.sequence += 1
        key = frame["is_keyframe"]
        if key:
            self.width, self.height = frame["width"], frame["height"]
        version = frame["scene_version"] if key else frame["delta_new_version"]
        if version is not None:
            self.scene_version = version
        self.hybrid += sum(frame[c] or 0 for c in ("scene_bytes" if key else "delta_bytes", "mask_bytes", "video_bytes", "audio_bytes"))
        self.traditional += self.width * self.height * 3 // 20
        percent = (1 - self.hybrid / self.traditional) * 100 if self.traditional else 0.0
        ratio = self.traditional / max(self.hybrid, 1) if self.traditional else 1.0
        yield (*frame, self.sequence, self.scene_version, self.width, self.height, 0 if key else frame["timestamp_ms"], self.hybrid, self.traditional, percent, ratio)


class HybridReceiver:
    """The composite instruction of each frame. A person's box comes from the table's person_bbox, where it has one; it is kept with the mask."""

    MADE = T.StructType([T.StructField("render_background", T.BooleanType()), *_longs("rx_scene_version", "mask_from"), T.StructField("rx_person_bbox", T.ArrayType(T.LongType())), *_longs("person_video_size", "frame_width", "frame_height", "frames_received")])

    def __init__(self):
        self.background, self.version, self.mask, self.box, self.width, self.height, self.received = False, 0, None, None, 0, 0, 0

    @staticmethod
    def analyze(frames: AnalyzeArgument) -> AnalyzeResult:
        return _analyze("HybridReceiver", frames, HybridReceiver.MADE)

    def eval(self, frame: T.Row):
        self.received += 1
        if frame["is_keyframe"]:
            if frame["scene_bytes"]:
                self.background, self.version = True, frame["scene_version"]
            self.width, self.height = frame["width"], frame["height"]
        if frame["mask_bytes"] is not None:
            self.mask = frame["sequence"]
            self.box = frame["person_bbox"] if "person_bbox" in frame else None
        yield (*frame, self.background, self.version, self.mask, self.box, frame["video_bytes"], self.width, self.height, self.received)
