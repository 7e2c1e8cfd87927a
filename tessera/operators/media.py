"""Video frames and voice as rows of bytes, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import media_kernels as kernels
from ..functions import wire
from ..functions.wire_arrow import slices


def encode_video(df: DataFrame, quality: int = 75, kind: str = "cdf53") -> DataFrame:
    """frame_id, coded from frame_id, width, height, rgb."""

    def rows(batches):
        for b in batches:
            made = [kernels.encode_frame(r["rgb"], r["width"], r["height"], quality, kind) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b["frame_id"], pa.array(made, pa.binary())], names=["frame_id", "coded"])

    return df.select("frame_id", "width", "height", "rgb").mapInArrow(rows, "frame_id long, coded binary")


def decode_video(df: DataFrame, kind: str = "cdf53") -> DataFrame:
    """frame_id, width, height, rgb; nulls for what can't be decoded. The wavelet isn't in the stream."""

    def rows(batches):
        for b in batches:
            made = [kernels.decode_frame(c or b"", kind) or (None, None, None) for c in b["coded"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["frame_id"], pa.array([m[1] for m in made], pa.int32()), pa.array([m[2] for m in made], pa.int32()), pa.array([m[0] for m in made], pa.binary())], names=["frame_id", "width", "height", "rgb"])

    return df.select("frame_id", "coded").mapInArrow(rows, "frame_id long, width int, height int, rgb binary")


def mean_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two byte strings of one length; null for others."""

    @F.arrow_udf("double")
    def of(x: pa.Array, y: pa.Array) -> pa.Array:
        x, y = x.cast(pa.large_binary()), y.cast(pa.large_binary())
        (p, p_ends), (q, q_ends) = as_bytes(x), as_bytes(y)
        n = np.diff(p_ends)
        fits = x.is_valid().to_numpy(zero_copy_only=False) & y.is_valid().to_numpy(zero_copy_only=False) & (n == np.diff(q_ends)) & (n > 0)
        p, q = p[np.repeat(fits, n)], q[np.repeat(fits, np.diff(q_ends))]
        total = np.concatenate(([0], np.cumsum(np.abs(p.astype(np.int16) - q), dtype=np.int64)))
        at = np.concatenate(([0], np.cumsum(np.where(fits, n, 0))))
        return pa.array((total[at[1:]] - total[at[:-1]]) / np.maximum(n, 1), mask=~fits)

    return of(a, b)


def as_bytes(column: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows and where each begins, without copies."""
    offsets = np.frombuffer(column.buffers()[1], "<i8")[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] and column.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def person_regions(pairs: DataFrame, quality: int = 75, kind: str = "cdf53", **how) -> DataFrame:
    """cur_id, bbox, foreground, coded: the bounding box of what moved, coded as gray; null where nothing did."""

    def rows(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                shape = (r["height"], r["width"])
                cur = np.frombuffer(r["cur"], np.uint8).reshape(shape)
                _, box, n = kernels.person_mask(cur, np.frombuffer(r["prev"], np.uint8).reshape(shape), **how)
                x, y, w, h = box
                crop = np.repeat(cur[y : y + h, x : x + w, None], 3, 2)
                out.append((r["cur_id"], box, n, kernels.encode_frame(crop.tobytes(), w, h, quality, kind) if n else None))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary()))], names=["cur_id", "bbox", "foreground", "coded"])

    return pairs.select("cur_id", "width", "height", "cur", "prev").mapInArrow(rows, "cur_id long, bbox array<long>, foreground long, coded binary")


def encode_voice(df: DataFrame, rate: int = 16_000, layer: int = 0) -> DataFrame:
    """stream_id, sequence, raw from stream_id, sequence, timestamp_ms, samples: an audio frame each; the first of a stream is a keyframe."""

    def rows(batches):
        for b in (part for received in batches for part in slices(received)):
            own, body = b["samples"].fill_null([]), [b""] * b.num_rows
            sizes = own.value_lengths().to_numpy(zero_copy_only=False)
            flat, ends = own.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.float32), np.cumsum(sizes)
            for n in np.unique(sizes).tolist():  # frames of one length at once
                who = np.flatnonzero(sizes == n)
                x = flat[(ends[who] - n)[:, None] + np.arange(n)]
                made = kernels.parametric_rows(x, rate) if layer == 0 else kernels.spectral_rows(x)
                for i, item in zip(who.tolist(), made):
                    body[i] = wire.pack_parametric([item]) if layer == 0 else wire.pack_spectral([item])
            out = [wire.audio_frame(q, t, layer, rate, n, q == 1, x) for q, t, n, x in zip(b["sequence"].to_pylist(), b["timestamp_ms"].to_pylist(), sizes.tolist(), body)]
            yield pa.RecordBatch.from_arrays([b["stream_id"], b["sequence"], pa.array(out, pa.binary())], names=["stream_id", "sequence", "raw"])

    return df.select("stream_id", "sequence", "timestamp_ms", "samples").mapInArrow(rows, "stream_id long, sequence long, raw binary")


def decode_voice(df: DataFrame) -> DataFrame:
    """stream_id, sequence, keyframe, samples; samples are null for what can't be decoded."""

    def read(raw):
        try:
            f = wire.read_audio_frame(raw or b"")
            return f["keyframe"], f["layer"], wire.unpack_parametric(f["payload"]) if f["layer"] == 0 else wire.unpack_spectral(f["payload"])
        except wire.WireError:
            return None, None, []

    def rows(batches):
        for b in (part for received in batches for part in slices(received)):
            found = [read(r) for r in b["raw"].to_pylist()]
            made: list[list] = [[] for _ in found]
            for parametric, kernel in ((True, kernels.synthesise_rows), (False, kernels.unspectral_rows)):
                own = [(i, p) for i, (_, layer, items) in enumerate(found) if layer is not None and (layer == 0) == parametric for p in items]
                for (i, _), x in zip(own, kernel([p for _, p in own])):
                    made[i].append(x)
            samples = [None if layer is None else np.concatenate(m) if m else np.zeros(0, np.float32) for m, (_, layer, _) in zip(made, found)]
            yield pa.RecordBatch.from_arrays([b["stream_id"], b["sequence"], pa.array([k for k, _, _ in found], pa.bool_()), pa.array(samples, pa.list_(pa.float32()))], names=["stream_id", "sequence", "keyframe", "samples"])

    return df.select("stream_id", "sequence", "raw").mapInArrow(rows, "stream_id long, sequence long, keyframe boolean, samples array<float>")


def audio_header(sequence, timestamp_ms, layer, rate, size, key, payload_len):
    """The 26 header bytes of an audio frame, little-endian, as hex."""
    from ..functions.scalar import hex_be, hex_le

    return F.concat(hex_le(sequence, 4), hex_le(timestamp_ms, 8), hex_be(layer, 1), hex_le(rate, 4), hex_le(size, 4), hex_be(key, 1), hex_le(payload_len, 4))
