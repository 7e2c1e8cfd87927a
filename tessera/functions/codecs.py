"""Codings of corrections: Raw, Rle, Lz4, Zstd and DeltaRle, for whole Arrow columns.

Runs are three bytes, like those of masks: length (little-endian, at most 65535) and value. DeltaRle codes the difference of
each byte to the one before it (the first to 0), modulo 256. Lz4 and Zstd are a frame's length (four bytes, little-endian) and
the compressed bytes. Null stays null; what can't be decoded becomes null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import values

CODES = {name: code for code, name in values.COMPRESSION_FORMATS.items()}


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, each row's end and whether it is there."""
    rows = [x or b"" for x in column.to_pylist()]
    return np.frombuffer(b"".join(rows), np.uint8), np.cumsum(np.array([len(x) for x in rows], np.int64)), column.is_valid().to_numpy(zero_copy_only=False)


def _column(data: np.ndarray, ends: np.ndarray, valid: np.ndarray) -> pa.Array:
    out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return pc.if_else(pa.array(valid), out, pa.nulls(len(ends), pa.large_binary()))


def rle(column: pa.Array, delta: bool = False) -> pa.Array:
    data, ends, valid = _flat(column)
    first = np.zeros(len(data), bool)
    starts = np.concatenate(([0], ends[:-1]))
    first[starts[starts < ends]] = True
    if delta:
        before = np.concatenate(([0], data[:-1])).astype(np.uint8)
        data = data - np.where(first, np.uint8(0), before)
    begins = np.flatnonzero(first | (data != np.concatenate(([0], data[:-1])).astype(np.uint8)))
    length = np.diff(begins, append=len(data))
    parts = -(-length // values.RLE_MAX_RUN)
    of = np.repeat(np.arange(len(begins)), parts)
    last = np.diff(of, append=-1) != 0
    size = np.where(last, (length - (parts - 1) * values.RLE_MAX_RUN)[of], values.RLE_MAX_RUN)
    out = np.empty((len(of), 3), np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = size & 255, size >> 8, data[begins[of]]
    runs_upto = np.concatenate(([0], np.cumsum(parts)))
    return _column(out.reshape(-1), 3 * runs_upto[np.searchsorted(begins, ends)], valid)


def unrle(column: pa.Array, delta: bool = False) -> pa.Array:
    data, ends, valid = _flat(column)
    sizes = np.diff(ends, prepend=0)
    valid = valid & (sizes % 3 == 0)
    data = data[np.repeat(valid, sizes)].reshape(-1, 3)
    count = data[:, 0].astype(np.int64) | data[:, 1].astype(np.int64) << 8
    made, upto = np.repeat(data[:, 2], count), np.concatenate(([0], np.cumsum(count)))
    ends = upto[np.cumsum(np.where(valid, sizes // 3, 0))]
    if delta:  # sums within rows: of all bytes so far, less those before the row
        total = np.concatenate(([0], np.cumsum(made, dtype=np.int64)))
        starts = np.concatenate(([0], ends[:-1]))
        made = ((total[1:] - np.repeat(total[starts], ends - starts)) & 255).astype(np.uint8)
    return _column(made, ends, valid)


def _packed(column: pa.Array, codec: str) -> pa.Array:
    c = pa.Codec(codec)
    return pa.array([None if x is None else len(x).to_bytes(4, "little") + c.compress(x, asbytes=True) for x in column.to_pylist()], pa.large_binary())


def _unpacked(column: pa.Array, codec: str) -> pa.Array:
    c, out = pa.Codec(codec), []
    for x in column.to_pylist():
        try:
            n = int.from_bytes(x[:4], "little") if x else -1
            out.append(None if n < 0 else c.decompress(x[4:], decompressed_size=n, asbytes=True) if n else b"")
        except (OSError, ValueError, pa.ArrowException):
            out.append(None)
    return pa.array(out, pa.large_binary())


ENCODE = {"Raw": lambda c: c.cast(pa.large_binary()), "Rle": rle, "Lz4": lambda c: _packed(c, "lz4_raw"), "Zstd": lambda c: _packed(c, "zstd"), "DeltaRle": lambda c: rle(c, True)}
DECODE = {"Raw": lambda c: c.cast(pa.large_binary()), "Rle": unrle, "Lz4": lambda c: _unpacked(c, "lz4_raw"), "Zstd": lambda c: _unpacked(c, "zstd"), "DeltaRle": lambda c: unrle(c, True)}
