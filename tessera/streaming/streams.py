"""Structured Streaming forms of stream statistics, sessions, references and of the receiver."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.stream import packet_stats


def stats(packets: DataFrame) -> DataFrame:
    """Running statistics of each stream (output mode complete or update)."""
    return packet_stats(packets)


def windowed_stats(packets: DataFrame, time: str = "ts", delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Statistics by event-time window; packets later than the watermark are dropped. time must be a TIMESTAMP."""
    kind = F.col("packet_type")
    return packets.withWatermark(time, delay).groupBy(F.window(time, window), "stream_id").agg(F.sum("size").alias("total_bytes"), F.count("*").alias("total_packets"), F.count_if(kind == 1).alias("i_packets"))


OUT = "stream_id long, sequence long, render_background boolean, scene_version long, mask_from long, person_video_size long, frame_width long, frame_height long, frames_received long"
STATE = "last_sequence long, background boolean, scene_version long, mask_from long, width long, height long, received long"


EMPTY = (-1, False, 0, None, 0, 0, 0)


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: tuple) -> tuple[pd.DataFrame, tuple]:
    """What a batch's frames give after ``state`` (STATE's fields), and the state after them."""
    last, background, version, mask, width, height, received = state
    frames = pd.concat(list(batches), ignore_index=True).sort_values("sequence")
    out = []
    for r in frames.itertuples(index=False):
        if r.sequence <= last:
            continue
        last, received = r.sequence, received + 1
        if r.is_keyframe:
            if r.scene_bytes is not None and r.scene_bytes > 0:
                background, version = True, r.scene_version
            width, height = r.width, r.height
        if r.mask_bytes is not None and r.mask_bytes == r.mask_bytes:
            mask = r.sequence
        out.append((key[0], r.sequence, background, version, mask, r.video_bytes, width, height, received))
    after = (int(last), bool(background), int(version), None if mask is None else int(mask), int(width), int(height), int(received))
    return pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")]), after


def _receive(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    out, after = _advance(key, batches, state.get if state.exists else EMPTY)
    state.update(after)
    yield out


class Receiver(StatefulProcessor):
    """The receiver for ``transformWithStateInPandas``: a stream's state is a value that lives ``ttl_ms`` (0: for ever) after its last frame."""

    def __init__(self, ttl_ms: int = 0):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("receiver", STATE, self.ttl_ms or None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out, after = _advance(key, rows, tuple(self.state.get()) if self.state.exists() else EMPTY)
        self.state.update(after)
        yield out

    def close(self) -> None:
        pass


COLUMNS = ["stream_id", "sequence", "is_keyframe", "scene_version", "scene_bytes", "mask_bytes", "video_bytes", "width", "height"]


def receive_with_state(frames: DataFrame, ttl_ms: int = 0) -> DataFrame:
    """Like ``receive``, with state that outlives the job's code and may expire; asks for the RocksDB state store."""
    mode = "ProcessingTime" if ttl_ms else "None"
    return frames.select(*COLUMNS).groupBy("stream_id").transformWithStateInPandas(Receiver(ttl_ms), OUT, "Append", mode)


def receive(frames: DataFrame) -> DataFrame:
    """Composite instructions with state kept across batches.

    Frames are put in order within a batch; a frame whose sequence isn't above the stream's last is late and dropped.
    """
    return frames.select(*COLUMNS).groupBy("stream_id").applyInPandasWithState(_receive, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def once(packets: DataFrame, time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Packets without repetitions of (stream_id, sequence) that come within ``delay`` of each other; state is dropped behind the watermark."""
    return packets.withWatermark(time, delay).dropDuplicatesWithinWatermark(["stream_id", "sequence"])


def session_stats(packets: DataFrame, time: str = "ts", gap: str = "6 hours", delay: str | None = "10 minutes") -> DataFrame:
    """stream_id, start, end (of the last packet's gap), packets and bytes of each session; the batch form is ``operators.timejoin.sessions``.

    delay: None for packets that have a watermark already, such as those of ``once``.
    """
    made = (packets.withWatermark(time, delay) if delay else packets).groupBy("stream_id", F.session_window(time, gap).alias("w")).agg(F.count("*").alias("packets"), F.sum("size").alias("bytes"))
    return made.select("stream_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "packets", "bytes")


def resolve_references(deltas: DataFrame, keyframes: DataFrame, time: str = "ts", within: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Deltas (stream_id, sequence, ref_sequence, time) with the keyframe (stream_id, sequence, time) that they refer to, sent at most ``within`` before or ``delay`` after.

    An outer join of two streams with bounded state: a delta whose keyframe is missing comes out with nulls once the
    watermark has passed all keyframes that it might refer to.
    """
    d = deltas.withWatermark(time, delay).select("stream_id", "sequence", "ref_sequence", F.col(time).alias("sent"))
    k = keyframes.withWatermark(time, delay).select(F.col("stream_id").alias("key_stream"), F.col("sequence").alias("key_sequence"), F.col(time).alias("key_sent"))
    near = F.expr(f"key_sent >= sent - interval {within} and key_sent <= sent + interval {delay}")
    met = d.join(k, (F.col("stream_id") == F.col("key_stream")) & (F.col("ref_sequence") == F.col("key_sequence")) & near, "leftOuter")
    return met.select("stream_id", "sequence", "ref_sequence", "sent", "key_sequence", "key_sent")
