"""The engine's functions by name, for SQL: ``register(spark)``.

What expressions can say is a SQL function of Spark's own; kernels are Arrow UDFs, a call a batch. Null arguments give
null; what can't be decoded gives null or a status. Arguments that may be left out: estimate_motion(cur, prev, width, height[,
block, reach, threshold, keep_zero]), dct_2d(block[, side]), idct_2d(block[, side]), quantize_dct(coeffs[, side, quality]),
dequantize_dct(coeffs[, side, quality]).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import codecs, kernels, media_kernels, tablefuncs, values, wire

VECTOR = "struct<block_x: int, block_y: int, dx: int, dy: int, sad: bigint>"
COLOR = "struct<r: int, g: int, b: int>"
ROI = "struct<x: bigint, y: bigint, width: bigint, height: bigint, roi_type: bigint, priority: bigint, confidence: double>"
PACKET = f"struct<status: string, kind: string, sequence: bigint, payload_len: bigint, width: bigint, height: bigint, fps: float, quality: int, timestamp_ms: bigint, ref_sequence: bigint, vectors: array<{VECTOR}>, command: int>"
NAMES = ("block_x", "block_y", "dx", "dy", "sad")


def each(f, kind: pa.DataType):
    """An Arrow UDF body that calls ``f`` for each row without nulls."""

    def run(*columns: pa.Array) -> pa.Array:
        return pa.array([None if any(x is None for x in row) else f(*row) for row in zip(*(c.to_pylist() for c in columns))], kind)

    return run


def image(data: bytes, width: int, height: int) -> np.ndarray | None:
    return np.frombuffer(data, np.uint8).reshape(height, width) if len(data) == width * height else None


def estimate_motion(cur: bytes, prev: bytes, width: int, height: int, block: int = 16, reach: int = 16, threshold: int = 256, keep_zero: bool = False) -> list[dict] | None:
    a, b = image(cur, width, height), image(prev, width, height)
    if a is None or b is None or block < 1:
        return None
    return [dict(zip(NAMES, r)) for r in kernels.diamond(a, b, block, reach, threshold).tolist() if keep_zero or r[2] or r[3]]


def colors(found: tuple[list, list]) -> list[dict]:
    return [dict(zip("rgb", c)) for c in found[0]]


def detect_roi(data: bytes, width: int, height: int) -> list[dict] | None:
    from ..operators.blocks import _detect

    px = image(data, width, height)
    return None if px is None else _detect(px, values.ROI_BLOCK, values.EDGE_THRESHOLD, values.CONTRAST_THRESHOLD)


def parse_packet(raw: bytes) -> dict:
    try:
        p = wire.parse(raw)
    except wire.WireError as e:
        return {"status": str(e)}
    return p | {"status": "ok", "vectors": [dict(zip(NAMES, v)) for v in p["vectors"]] if "vectors" in p else None}


def voice(samples, rate: int) -> bytes:
    x = np.array(samples, np.float32)
    return wire.audio_frame(1, 0, 0, rate, len(x), True, wire.pack_parametric([media_kernels.parametric(x, rate)]))


def unvoice(raw: bytes) -> list[float] | None:
    try:
        f = wire.read_audio_frame(raw)
        made = [media_kernels.synthesise(p) for p in wire.unpack_parametric(f["payload"])] if f["layer"] == 0 else [media_kernels.unspectral(p) for p in wire.unpack_spectral(f["payload"])]
    except wire.WireError:
        return None
    return np.concatenate(made).tolist() if made else []


def video(rgb: bytes, width: int, height: int, quality: int) -> bytes | None:
    return media_kernels.encode_frame(rgb, width, height, quality) if len(rgb) == 3 * width * height else None


def unvideo(coded: bytes) -> dict | None:
    made = media_kernels.decode_frame(coded)
    return None if made is None else {"rgb": made[0], "width": made[1], "height": made[2]}


@lru_cache(16)
def basis(n: int) -> np.ndarray:
    return np.kron(kernels.dct_basis(n), kernels.dct_basis(n))


def product(inverse: bool):
    """An Arrow UDF body: the transform of each array that is as long as its block of side n (8 if not given, at most 64), null for others."""

    def run(*columns: pa.Array) -> pa.Array:
        column, *sides = columns
        length = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        side = np.full(len(column), 8) if not sides else sides[0].cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
        fits = (length == side * side) & (side > 0) & (side <= 64)
        ends = np.concatenate(([0], np.cumsum(np.where(fits, length, 0)))).astype(np.int64)
        out = np.empty(int(ends[-1]))
        for n in np.unique(side[fits]).tolist():
            who = fits & (side == n)
            m = basis(n)
            y = column.filter(pa.array(who)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n * n) @ (m if inverse else m.T)
            out[ends[:-1][who][:, None] + np.arange(n * n)] = y
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out), mask=pa.array(~fits))

    return run


def quantized(back: bool):
    """Coefficients over (or times) the quanta of their side and quality; null if they are not as many as the block has."""

    def run(c: list, n: int = 8, quality: int = 50) -> list | None:
        from ..operators.transform import quant_matrix

        if not 0 < n <= 64 or len(c) != n * n or None in c:
            return None
        x, m = np.array(c, np.float64), np.array(quant_matrix(n, quality), np.float64)
        scaled = x * (1.0 / m)
        return (x * m).tolist() if back else (np.sign(scaled) * np.floor(np.abs(scaled) + 0.5)).astype(np.int64).tolist()

    return run


#: name: (function of a row, type)
ROWS = {
    "packet_status": (lambda raw: parse_packet(raw)["status"], "string"),
    "parse_packet": (parse_packet, PACKET),
    "create_i_packet": (lambda sequence, width, height, fps, ts: wire.frame("I", sequence, wire.i_table(width, height, fps, 1, ts)), "binary"),
    "create_d_packet": (lambda sequence, ref, vectors, ts: wire.frame("D", sequence, wire.d_table(ref, [tuple(v[c] for c in NAMES) for v in vectors], (), ts)), "binary"),
    "create_ping": (lambda sequence, ts: wire.frame("S", sequence, wire.s_table(wire.PING, ts)), "binary"),
    "create_pong": (lambda sequence, ts: wire.frame("S", sequence, wire.s_table(wire.PONG, ts)), "binary"),
    "estimate_motion": (estimate_motion, f"array<{VECTOR}>"),
    "dominant_colors": (lambda rgb: colors(kernels.kmeans(rgb)), f"array<{COLOR}>"),
    "extract_colors": (lambda rgb, k: colors(kernels.kmeans(rgb, k)), f"array<{COLOR}>"),
    "extract_color_weights": (lambda rgb, k: kernels.kmeans(rgb, k)[1], "array<double>"),
    "median_cut": (lambda rgb, k: [dict(zip("rgb", c)) for c in kernels.median_cut(rgb, k)], f"array<{COLOR}>"),
    "detect_roi": (detect_roi, f"array<{ROI}>"),
    "encode_video_frame": (video, "binary"),
    "decode_video_frame": (unvideo, "struct<rgb: binary, width: int, height: int>"),
    "encode_voice": (voice, "binary"),
    "decode_voice": (unvoice, "array<float>"),
    "quantize_dct": (quantized(False), "array<int>"),
    "dequantize_dct": (quantized(True), "array<double>"),
    "compress_correction": (lambda data, name: codecs.ENCODE[name](pa.array([data], pa.binary()))[0].as_py() if name in codecs.ENCODE else None, "binary"),
    "decompress_correction": (lambda data, name: codecs.DECODE[name](pa.array([data], pa.binary()))[0].as_py() if name in codecs.DECODE else None, "binary"),
}
BATCHES = {"dct_2d": (product(False), "array<double>"), "idct_2d": (product(True), "array<double>")}

#: SQL functions: (arguments, type, body).
EXPRESSIONS = {
    "encode_sparse_dct": ("c ARRAY<INT>, threshold DOUBLE", "ARRAY<STRUCT<u: INT, v: INT, value: FLOAT>>", "filter(transform(c, (x, i) -> named_struct('u', cast(i % 8 AS INT), 'v', cast(i div 8 AS INT), 'value', cast(x AS FLOAT))), p -> abs(p.value) > floor(threshold * 1000))"),
    "decode_sparse_dct": ("s ARRAY<STRUCT<u: INT, v: INT, value: FLOAT>>", "ARRAY<INT>", "transform(sequence(0, 63), i -> coalesce(cast(try_element_at(filter(s, p -> p.u < 8 AND p.v < 8 AND p.v * 8 + p.u = i), -1).value AS INT), 0))"),
    "estimate_hybrid_savings": ("w BIGINT, h BIGINT, coverage DOUBLE, scene BIGINT, bpp DOUBLE", "STRUCT<traditional: BIGINT, hybrid: BIGINT>", "named_struct('traditional', cast(floor(w * h / 8) AS BIGINT), 'hybrid', cast(floor(w * h * coverage * bpp / 8) + floor(w * h * coverage / 50) AS BIGINT) + scene)"),
    "rle_decode_mask": ("rle BINARY, total INT", "ARRAY<INT>", "slice(concat(flatten(transform(filter(sequence(0, length(rle) div 3), i -> i < length(rle) div 3), i -> array_repeat(cast(conv(hex(substring(rle, i * 3 + 3, 1)), 16, 10) AS INT), cast(conv(concat(hex(substring(rle, i * 3 + 2, 1)), hex(substring(rle, i * 3 + 1, 1))), 16, 10) AS INT)))), array_repeat(0, total)), 1, total)"),
    "frame_luminance": ("r INT, g INT, b INT", "DOUBLE", "0.299D * r + 0.587D * g + 0.114D * b"),
    "rects_intersect": ("ax BIGINT, ay BIGINT, aw BIGINT, ah BIGINT, bx BIGINT, by BIGINT, bw BIGINT, bh BIGINT", "BOOLEAN", "ax < bx + bw AND bx < ax + aw AND ay < by + bh AND by < ay + ah"),
    "vector_magnitude": ("dx BIGINT, dy BIGINT", "DOUBLE", "sqrt(dx * dx + dy * dy)"),
    "engine_version": ("", "STRING", "'{version}'"),
}


def rle_encode_mask(mask: bytes) -> bytes:
    """Runs of the low bits, at most 65535 long: length in two bytes, little-endian, then the value."""
    bits = np.frombuffer(mask, np.uint8) & 1
    if not len(bits):
        return b""
    starts = np.concatenate(([0], np.flatnonzero(np.diff(bits)) + 1))
    out = bytearray()
    for at, n in zip(starts.tolist(), np.diff(np.append(starts, len(bits))).tolist()):
        while n:
            part = min(n, values.RLE_MAX_RUN)
            out += part.to_bytes(2, "little") + bytes([bits[at]])
            n -= part
    return bytes(out)


ROWS["rle_encode_mask"] = (rle_encode_mask, "binary")


class RleRuns:
    """Runs of a run-length mask."""

    def eval(self, rle: bytes):
        at = 0
        for i in range(0, len(rle or b"") // 3 * 3, 3):
            n = int.from_bytes(rle[i : i + 2], "little")
            yield at, n, rle[i + 2]
            at += n


class DecodePacket:
    """Status, kind, sequence and payload length of a packet's bytes."""

    def eval(self, raw: bytes):
        p = parse_packet(raw or b"")
        yield p["status"], p.get("kind"), p.get("sequence"), p.get("payload_len")


def register(spark: SparkSession) -> None:
    """All functions of ROWS, BATCHES and EXPRESSIONS, and the table functions rle_runs(rle), decode_packet(raw), hybrid_transmitter(TABLE(frames)) and hybrid_receiver(TABLE(frames))."""
    from .. import __version__

    arrow = lambda kind: to_arrow_type(spark.createDataFrame([], f"x {kind}").schema["x"].dataType)
    made = {name: (each(f, arrow(kind)), kind) for name, (f, kind) in ROWS.items()} | BATCHES
    for name, (f, kind) in made.items():
        spark.udf.register(name, F.arrow_udf(f, kind))
    for name, (arguments, kind, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body.format(version=__version__) if 'version' in body else body}")
    spark.udtf.register("rle_runs", F.udtf(RleRuns, returnType="start: bigint, length: bigint, value: int"))
    spark.udtf.register("hybrid_transmitter", F.udtf(tablefuncs.HybridTransmitter))
    spark.udtf.register("hybrid_receiver", F.udtf(tablefuncs.HybridReceiver))
    spark.udtf.register("decode_packet", F.udtf(DecodePacket, returnType="status: string, kind: string, sequence: bigint, payload_len: bigint"))
