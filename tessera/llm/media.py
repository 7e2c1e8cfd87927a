"""Audio columns: lossless 8-bit samples, polyphase resampling, log-mel filterbanks, energy segments.

``store`` keeps bytes as mono unsigned 8-bit WAV at ``RATE`` Hz, padded with byte 32 to a positive multiple of
``PAD`` samples; ``from_wav`` returns exactly these samples. ``analyse`` resamples by 3/4 with a polyphase FIR
filter, takes overlapped frames to log-mel energies (in steps of 0.1 dB, so equal samples give equal features), and
cuts segments by hysteresis: on above median + ``RISE`` dB, off below median - ``RISE`` dB. Column ``tensors`` holds
the frames as an Arrow stream of fixed-shape tensors of ``SHAPE`` (16-bit tenths of dB, the last padded with zeros)
with the time span of each, column ``segments`` the spans that are on; ``read_tensors`` gives frames and spans back.

Null and empty texts are 192 bytes of padding. Long recordings go through in slabs of ``SLAB`` frames. Repeated
rows stay repeated; an empty table gives an empty result; other columns are ignored, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise

RATE, PAD, UP, DOWN, TAPS = 16_000, 192, 3, 4, 16
FRAME, HOP, MELS, SLAB, RISE = 256, 96, 32, 4096, 0.4
SHAPE = (32, MELS)
OUT_RATE = RATE * UP // DOWN
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def to_wav(raw: bytes) -> bytes:
    n = len(raw) + max(PAD * (not raw), -len(raw) % PAD)
    head = HEADER.pack(b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)
    return head + raw + b" " * (n - len(raw))


def from_wav(media: bytes) -> bytes:
    """The samples of a RIFF file, found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, kind = 12, None
    while at + 8 <= len(media):
        name, n = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            kind = struct.unpack_from("<HHIIHH", media, at + 8)
        if name == b"data":
            if kind is None or kind[:2] != (1, 1) or kind[5] != 8:
                raise ValueError("not mono 8-bit PCM")
            return media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


def _bank() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Polyphase filters [UP, TAPS], window [FRAME], mel weights [FRAME // 2 + 1, MELS]."""
    t = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    cut = 1 / max(UP, DOWN)
    low = np.sinc(t * cut) * np.kaiser(UP * TAPS, 8.0)
    phases = (low / low.sum() * UP).reshape(TAPS, UP).T[:, ::-1]
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60.0), mel(OUT_RATE / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / OUT_RATE)[:, None]
    weights = np.maximum(0, np.minimum((f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])))
    return np.ascontiguousarray(phases), np.hanning(FRAME + 1)[:-1], weights


PHASES, WINDOW, MEL = _bank()


def resample(samples: np.ndarray, a: int, b: int) -> np.ndarray:
    """Outputs a..b-1 of the polyphase filter (rate * UP / DOWN); silence outside the samples."""
    m0, m1 = a // UP, -(-b // UP)
    lo = m0 * DOWN - TAPS // 2
    hi = (m1 - 1) * DOWN + DOWN + TAPS // 2
    x = np.zeros(hi - lo)
    s, e = max(lo, 0), min(hi, len(samples))
    x[s - lo : e - lo] = (samples[s:e].astype(np.float64) - 128) / 128
    views = np.lib.stride_tricks.sliding_window_view(x, TAPS)
    out = np.empty((m1 - m0, UP))
    for p in range(UP):
        out[:, p] = views[p * DOWN // UP :: DOWN][: m1 - m0] @ PHASES[p * DOWN % UP]
    return out.reshape(-1)[a - m0 * UP : b - m0 * UP]


def log_mel(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames x MELS in tenths of dB, energy of each frame in dB in steps of 0.1)."""
    n = len(samples) * UP // DOWN
    count = max(1, 1 + (n - FRAME) // HOP) if n >= FRAME else 1
    mels, energy = np.empty((count, MELS), np.int16), np.empty(count)
    for f in range(0, count, SLAB):
        g = min(count, f + SLAB)
        y = resample(samples, f * HOP, (g - 1) * HOP + FRAME)
        frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP] * WINDOW
        power = np.abs(np.fft.rfft(frames)) ** 2
        mels[f:g] = np.round(100 * np.log10(power @ MEL + 1e-6))
        energy[f:g] = np.round(100 * np.log10(power.sum(1) + 1e-6)) / 10
    return mels, energy


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frames [a, b) that are on: switched on above median + RISE, off below median - RISE."""
    mid = np.median(energy)
    mark = np.where(energy > mid + RISE, 1, np.where(energy < mid - RISE, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.concatenate(([0], (last >= 0) & (mark[last] == 1), [0])).astype(np.int8)
    edge = np.flatnonzero(np.diff(on))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def tensors(mels: np.ndarray) -> pa.RecordBatch:
    """start_ms, end_ms, n_frames and a fixed-shape tensor for each run of SHAPE[0] frames."""
    n = -(-len(mels) // SHAPE[0])
    full = np.zeros((n * SHAPE[0], MELS), np.int16)
    full[: len(mels)] = mels
    kind = pa.fixed_shape_tensor(pa.int16(), SHAPE)
    values = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(full.reshape(-1)), SHAPE[0] * MELS))
    first = np.arange(n) * SHAPE[0]
    held = np.minimum(SHAPE[0], len(mels) - first)
    ms = lambda frame, more: (frame * HOP + more) * 1000 // OUT_RATE
    return pa.RecordBatch.from_arrays([pa.array(ms(first, 0)), pa.array(ms(first + held - 1, FRAME)), pa.array(held), values], names=["start_ms", "end_ms", "n_frames", "tensor"])


def read_tensors(stream: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(frames x MELS in tenths of dB, time span in ms of each tensor) from an Arrow stream."""
    with pa.ipc.open_stream(stream) as reader:
        held = pa.concat_tables([pa.Table.from_batches(reader)]).combine_chunks()
    parts = [b.column("tensor").to_numpy_ndarray()[k][:n] for b in held.to_batches() for k, n in enumerate(b.column("n_frames").to_pylist())]
    return np.concatenate(parts), list(zip(held["start_ms"].to_pylist(), held["end_ms"].to_pylist()))


def to_ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) written to the shared folder."""

    def rows(batch: pa.RecordBatch):
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            raw = [(t.as_py() or "").encode() for t in part["text"]]
            yield {"doc_id": part["doc_id"], "n_bytes": [len(r) for r in raw], "media": [to_wav(r) for r in raw]}

    return materialise(map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, n_bytes long, media binary", rows), "media")


def analyse(media: DataFrame) -> DataFrame:
    """Of each stored recording: what was read back, its features, the segments that are on and the tensors."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, segments array<struct<start_ms: long, end_ms: long>>, tensors binary"

    def one(doc_id, n_bytes, wav):
        raw = from_wav(wav)
        mels, energy = log_mel(np.frombuffer(raw, np.uint8))
        on = segments(energy)
        stream = to_ipc(tensors(mels))
        feature = f"frames={len(mels)};segments={len(on)};on={sum(b - a for a, b in on)};mean_db={float(energy.mean()):.1f};tensors={hashlib.sha256(stream).hexdigest()[:16]}"
        spans = [{"start_ms": a * HOP * 1000 // OUT_RATE, "end_ms": ((b - 1) * HOP + FRAME) * 1000 // OUT_RATE} for a, b in on]
        return doc_id, n_bytes, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(wav), hashlib.sha256(wav).hexdigest(), feature, spans, stream

    names = [x.split()[0] for x in schema.split(", ")[:8]] + ["segments", "tensors"]

    def rows(batch: pa.RecordBatch):
        for i in range(0, batch.num_rows, 256):
            made = [one(*(c.as_py() for c in r)) for r in zip(*(batch.slice(i, 256)[c] for c in ("doc_id", "n_bytes", "media")))]
            yield {c: [m[k] for m in made] for k, c in enumerate(names)}

    return map_arrow(media, schema, rows)
