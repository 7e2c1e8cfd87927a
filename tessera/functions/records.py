"""Records of packets, scenes and regions as struct columns, with the defaults that readers expect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scalar


def _struct(**fields) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()])


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


COLOR = "struct<r: int, g: int, b: int>"
COEFFICIENTS = "array<struct<u: int, v: int, value: float>>"
VECTORS = "array<struct<block_x: int, block_y: int, dx: int, dy: int, sad: long>>"


def color(r, g, b) -> Column:
    return _struct(r=r, g=g, b=b).cast(COLOR)


BLACK, WHITE = (0, 0, 0), (255, 255, 255)


def palette(colors: Column, weights: Column | None = None) -> Column:
    return _struct(colors=colors.cast(f"array<{COLOR}>"), weights=_null("array<float>") if weights is None else weights.cast("array<float>"))


def animation(zoom=1.0, pan_x=0.0, pan_y=0.0, rotation=0.0, duration=1, easing=0) -> Column:
    return _struct(zoom_factor=zoom, pan_x=pan_x, pan_y=pan_y, rotation=rotation, duration=duration, easing=easing)


def region(bounds: Column, pattern: int, colors: Column, coefficients: Column | None = None) -> Column:
    return _struct(bounds=bounds, pattern_type=pattern, palette=palette(colors), dct_coefficients=_null(COEFFICIENTS) if coefficients is None else coefficients.cast(COEFFICIENTS), params=_null("map<string, float>"))


def solid(bounds: Column, c: Column) -> Column:
    return region(bounds, 0, F.array(c))


def gradient(bounds: Column, colors: Column) -> Column:
    return region(bounds, 1, colors)


def dct_region(bounds: Column, colors: Column, coefficients: Column) -> Column:
    return region(bounds, 5, colors, coefficients)


RECT = "struct<x: long, y: long, width: long, height: long>"
PALETTE = f"struct<colors: array<{COLOR}>, weights: array<float>>"
REGION = f"struct<bounds: {RECT}, pattern_type: int, palette: {PALETTE}, dct_coefficients: {COEFFICIENTS}, params: map<string, float>>"
REGION_DELTA = f"struct<region_index: long, palette_delta: {PALETTE}, dct_delta: {COEFFICIENTS}, param_delta: map<string, float>>"


def i_payload(width, height, fps, quality=1, timestamp_ms=0) -> Column:
    return _struct(width=width, height=height, fps=fps, quality=quality, global_palette=palette(F.array()), regions=F.array().cast(f"array<{REGION}>"), timestamp_ms=timestamp_ms)


def with_quality(payload: Column, quality) -> Column:
    return payload.withField("quality", quality if isinstance(quality, Column) else F.lit(quality))


def with_palette(payload: Column, colors: Column) -> Column:
    return payload.withField("global_palette", colors.cast(PALETTE))


def add_region(payload: Column, added: Column) -> Column:
    return payload.withField("regions", F.array_append(payload["regions"], added.cast(REGION)))


def region_delta(region_index, palette_delta: Column | None = None, dct_delta: Column | None = None, param_delta: Column | None = None) -> Column:
    """What changes of the keyframe's region with this index (from 0); null parts stay."""
    return _struct(region_index=region_index, palette_delta=_null(PALETTE) if palette_delta is None else palette_delta, dct_delta=_null(COEFFICIENTS) if dct_delta is None else dct_delta, param_delta=_null("map<string, float>") if param_delta is None else param_delta).cast(REGION_DELTA)


def d_payload(ref_sequence, vectors: Column | None = None, timestamp_ms=0) -> Column:
    return _struct(ref_sequence=ref_sequence, vectors=F.array().cast(VECTORS) if vectors is None else vectors, region_deltas=F.array().cast(f"array<{REGION_DELTA}>"), timestamp_ms=timestamp_ms)


def add_region_delta(payload: Column, added: Column) -> Column:
    return payload.withField("region_deltas", F.array_append(payload["region_deltas"], added.cast(REGION_DELTA)))


def wire_payload(**fields) -> Column:
    """The payload struct of ``framing.encode_packets``: fields that are not given are null."""
    kinds = {"width": "long", "height": "long", "fps": "float", "quality": "int", "timestamp_ms": "long", "ref_sequence": "long", "vectors": VECTORS, "compact": "array<struct<dx: int, dy: int>>", "command": "int"}
    return _struct(**{k: fields[k].cast(t) if k in fields else _null(t) for k, t in kinds.items()})


def compact(dx=0, dy=0) -> Column:
    """A vector in two bytes; (0, 0) unless given."""
    return _struct(dx=dx, dy=dy).cast("struct<dx: int, dy: int>")


def expand(vector: Column, block_x, block_y, sad) -> Column:
    """The full vector of a compact one."""
    return _struct(block_x=block_x, block_y=block_y, dx=vector["dx"], dy=vector["dy"], sad=sad).cast("struct<block_x: int, block_y: int, dx: int, dy: int, sad: long>")


def add_vector(payload: Column, vector: Column) -> Column:
    return payload.withField("vectors", F.array_append(payload["vectors"], vector))


def c_payload(ref_sequence, corrections: Column, timestamp_ms=0) -> Column:
    """corrections: array of structs with a binary field data."""
    return _struct(ref_sequence=ref_sequence, corrections=corrections, correction_count=F.size(corrections), timestamp_ms=timestamp_ms)


def add_correction(payload: Column, added: Column) -> Column:
    more = F.array_append(payload["corrections"], added)
    return payload.withField("corrections", more).withField("correction_count", F.size(more))


def correction_bytes(payload: Column) -> Column:
    return F.aggregate(payload["corrections"], F.lit(0).cast("long"), lambda s, c: s + F.length(c["data"]))


S_PAYLOAD = "struct<command: int, sequence: long, bitrate_kbps: long, quality: long, timestamp_ms: long>"


def s_payload(command: int, sequence=None, bitrate_kbps=None, quality=None, timestamp_ms=0) -> Column:
    given = {"sequence": sequence, "bitrate_kbps": bitrate_kbps, "quality": quality}
    return _struct(command=command, **{k: _null("long") if v is None else v for k, v in given.items()}, timestamp_ms=timestamp_ms)


def request_keyframe() -> Column:
    return s_payload(1)


def ack(sequence) -> Column:
    return s_payload(2, sequence=sequence)


def nack(sequence) -> Column:
    return s_payload(3, sequence=sequence)


def end_of_stream() -> Column:
    return s_payload(4)


def bitrate_adjust(kbps) -> Column:
    return s_payload(5, bitrate_kbps=kbps)


def ping() -> Column:
    return s_payload(7)


def pong() -> Column:
    return s_payload(8)


def roi_region(bounds: Column, roi_type=0, priority=1, confidence=None) -> Column:
    return _struct(bounds=bounds, roi_type=roi_type, priority=priority, confidence=F.lit(1.0) if confidence is None else scalar.clamp01(confidence))


def scene(data: Column, version=1, name=None, resolution=None) -> Column:
    return _struct(data=data, bounds_min=F.array(*[F.lit(-10.0)] * 3), bounds_max=F.array(*[F.lit(10.0)] * 3), scene_version=version, name=_null("string") if name is None else name, render_resolution=_null("long") if resolution is None else resolution, size=F.length(data))


def scene_delta(kind: str, ref_version: Column, data: Column) -> Column:
    """kind: animation_update, node_transform, full_replace or svo_chunk; the new version is one more."""
    return _struct(kind=kind, ref_scene_version=ref_version, new_scene_version=ref_version + 1, data=data, size=F.length(data))
