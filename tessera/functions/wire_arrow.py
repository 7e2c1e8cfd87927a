"""Payload tables of whole Arrow batches: what ``wire`` writes and reads one at a time, by NumPy.

A table's layout depends only on its kind and on how many vectors it holds, so rows of one layout share a template and
differ in the bytes of their fields. Reading follows offsets for all rows at once and checks each against its row's
bounds.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import values, wire

VECTOR = np.dtype([("block_x", "<u2"), ("block_y", "<u2"), ("dx", "<i2"), ("dy", "<i2"), ("sad", "<u4")])
COMPACT = np.dtype([("dx", "i1"), ("dy", "i1")])
#: Slot and type of each scalar field by kind.
FIELDS = {
    "I": {"width": (0, "<u4"), "height": (1, "<u4"), "fps": (2, "<f4"), "quality": (3, "i1"), "timestamp_ms": (7, "<u8")},
    "D": {"ref_sequence": (0, "<u4"), "timestamp_ms": (5, "<u8")},
    "S": {"command": (0, "i1"), "timestamp_ms": (3, "<u8")},
}
HEADER, AROUND, CODES = struct.Struct(">4sBBHII"), values.HEADER_BYTES + values.CRC_BYTES, {name: code for code, name in values.PACKET_TYPES.items()}
#: What a field is if a table leaves it out.
DEFAULTS = {"quality": 1, "command": wire.PING}
#: Rows and bytes that kernels take at once (a row may be larger by itself), and bytes of templates that are kept.
SLICE_ROWS, SLICE_BYTES, TEMPLATE_BYTES = 1000, 1 << 20, 1 << 20


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of whole rows, so that what kernels hold does not follow the size of batches.

    A slice that is too large is halved, so that large rows beside small ones are told apart.
    """
    left = [batch.slice(i, SLICE_ROWS) for i in reversed(range(0, batch.num_rows, SLICE_ROWS))]
    while left:
        own = left.pop()
        if own.num_rows > 1 and own.nbytes > SLICE_BYTES:
            half = own.num_rows // 2
            left += [own.slice(half), own.slice(0, half)]
        else:
            yield own


def _lists(col: pa.ListArray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First element and length of each row's list (null: none), and all elements."""
    counts = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values, whole = col.flatten(), np.zeros(int(counts.sum()), kind)
    for name in kind.names:
        whole[name] = values.field(name).to_numpy(zero_copy_only=False).astype(np.int64).astype(kind[name])  # wraps, as fixed widths do
    return np.cumsum(counts) - counts, counts, whole


class Encoder:
    """Encodes batch after batch; templates are kept between them, up to TEMPLATE_BYTES."""

    def __init__(self, keep_quality: bool = False):
        self.keep_quality, self.templates, self.held = keep_quality, {}, 0

    def template(self, kind: str, vectors: int, compact: int) -> tuple[np.ndarray, dict]:
        """Bytes of a table with all fields zero, and where each field is."""
        if (kind, vectors, compact) not in self.templates:
            made = {"I": lambda: wire.i_table(0, 0, 0.0, 0, 0), "D": lambda: wire.d_table(0, [(0, 0, 0, 0, 0)] * vectors, [(0, 0)] * compact, 0), "S": lambda: wire.s_table(0, 0)}[kind]()
            outer = wire.Table(made, int.from_bytes(made[:4], "little"))
            t = wire.Table(made, outer.follow(1))
            if self.held + len(made) > TEMPLATE_BYTES:
                self.templates, self.held = {}, 0
            self.held += len(made)
            places = {name: t.place(slot) for name, (slot, _) in FIELDS[kind].items()} | {"vectors": t.follow(1) + 4, "compact": t.follow(2) + 4}
            self.templates[kind, vectors, compact] = np.frombuffer(made, np.uint8), places
        return self.templates[kind, vectors, compact]

    def __call__(self, kinds: np.ndarray, sequences: pa.Array, payload: pa.StructArray) -> pa.LargeBinaryArray:
        """Whole packets: header, payload table and checksum of each row, null where kind or sequence is. kinds are I, D, C or S; payload has the fields of FIELDS, vectors and compact."""
        n = len(kinds)
        col = lambda name: payload.field(name).fill_null(DEFAULTS.get(name, 0)).to_numpy(zero_copy_only=False)
        is_i, is_d = kinds == "I", kinds == "D"
        command = np.where((kinds == "S") & np.isin(col("command"), (wire.PING, wire.PONG)), col("command"), wire.PING)  # all that the wire keeps
        scalars = {name: col(name) for f in FIELDS.values() for name in f} | {"command": command}
        if not self.keep_quality:
            scalars["quality"] = np.ones(n, np.int8)
        (v_first, v_count, vectors), (c_first, c_count, compact) = _lists(payload.field("vectors"), VECTOR), _lists(payload.field("compact"), COMPACT)
        v_count, c_count = np.where(is_d, v_count, 0), np.where(is_d, c_count, 0)
        layout = np.stack([np.where(is_i, 0, np.where(is_d, 1, 2)), v_count, c_count], 1)
        groups, own = np.unique(layout, axis=0, return_inverse=True)
        codes = np.array([CODES.get(k, 0) for k in kinds], np.uint8)
        valid = (codes > 0) & sequences.is_valid().to_numpy(zero_copy_only=False)
        sequence = sequences.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).astype(">u4")
        made, sizes = [], np.zeros(n, np.int64)
        for g, (which, many_v, many_c) in enumerate(groups.tolist()):
            kind, who = "IDS"[which], np.flatnonzero((own.reshape(-1) == g) & valid)
            base, places = self.template(kind, many_v, many_c)
            rows = np.empty((len(who), len(base) + AROUND), np.uint8)
            rows[:, :16] = np.frombuffer(HEADER.pack(bytes.fromhex(values.MAGIC_HEX), values.VERSION, 0, 0, 0, len(base)), np.uint8)
            rows[:, 5], rows[:, 8:12] = codes[who], sequence[who].view(np.uint8).reshape(-1, 4)
            body = rows[:, 16:-4]
            body[:] = base
            for name, (_, code) in FIELDS[kind].items():
                value = scalars[name][who].astype(code if code == "<f4" else np.int64).astype(code)
                body[:, places[name] : places[name] + value.itemsize] = value.view(np.uint8).reshape(len(who), -1)
            for name, first, many, flat in (("vectors", v_first, many_v, vectors), ("compact", c_first, many_c, compact)):
                if many:
                    part = flat[first[who][:, None] + np.arange(many)]
                    body[:, places[name] : places[name] + many * flat.itemsize] = np.ascontiguousarray(part).view(np.uint8).reshape(len(who), -1)
            rows[:, -4:] = np.array([zlib.crc32(r) for r in rows[:, :-4].copy()], ">u4").view(np.uint8).reshape(-1, 4)
            sizes[who] = rows.shape[1]
            made.append((who, rows))
        ends = np.concatenate(([0], np.cumsum(sizes)))
        out = np.empty(int(ends[-1]), np.uint8)
        for who, rows in made:
            out[ends[who][:, None] + np.arange(rows.shape[1])] = rows
        gone = np.packbits(valid, bitorder="little")
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [pa.py_buffer(gone), pa.py_buffer(ends), pa.py_buffer(out)])


class Rows:
    """Byte strings of a batch as one array; reads at a position per row fail the rows where they leave their bounds."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], "<i8")[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        data = column.buffers()[2]
        self.start, self.end = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
        self.data = np.concatenate((np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8), np.zeros(16, np.uint8)))
        self.status = np.full(len(column), "ok", object)

    def packets(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Type, sequence and payload length of each packet's header, after its length, checksum and header were judged, in this order. What is left as bytes are the payloads."""
        whole = self.end - self.start >= AROUND
        self.fail(~whole, "incomplete")
        bounds, raw = zip(self.start.tolist(), (self.end - 4).tolist(), whole.tolist()), memoryview(self.data)
        sums = np.array([zlib.crc32(raw[a:b]) if ok else 0 for a, b, ok in bounds], np.int64)
        self.fail(sums != self.get(self.end - 4, ">u4", whole), "checksum")
        magic, kind = self.get(self.start, ">u4", whole), self.get(self.start + 5, "u1", whole)
        self.fail(magic != int(values.MAGIC_HEX, 16), "magic")
        self.fail(~np.isin(kind, tuple(values.PACKET_TYPES)), "type")
        sequence, length = (self.get(self.start + k, ">u4", whole).astype(np.int64) for k in (8, 12))
        self.start, self.end = np.where(whole, self.start + 16, 0), np.where(whole, self.end - 4, 0)
        return kind, sequence, length

    def fail(self, rows: np.ndarray, why: str) -> None:
        self.status[rows & (self.status == "ok")] = why

    def get(self, at: np.ndarray, code: str, wanted: np.ndarray) -> np.ndarray:
        """The value at each wanted row's position, 0 elsewhere."""
        size = np.dtype(code).itemsize
        wanted = wanted & (self.status == "ok")
        inside = (at >= self.start) & (at + size <= self.end)
        self.fail(wanted & ~inside, "malformed")
        at = np.where(wanted & inside, at, 0)
        got = self.data[at[:, None] + np.arange(size)].reshape(-1).view(code)
        return np.where(wanted & inside, got, np.zeros(1, code))


class _Tables:
    def __init__(self, rows: Rows, at: np.ndarray, wanted: np.ndarray):
        self.rows, self.at, self.wanted = rows, at, wanted
        self.vtable = at - rows.get(at, "<i4", wanted)
        self.size = rows.get(self.vtable, "<u2", wanted).astype(np.int64)

    def place(self, slot: int) -> np.ndarray:
        """Where the field is; -1 if the table leaves it out."""
        o = 4 + 2 * slot
        there = self.wanted & (o < self.size)
        rel = self.rows.get(self.vtable + o, "<u2", there).astype(np.int64)
        return np.where(there & (rel > 0), self.at + rel, -1)

    def scalar(self, slot: int, code: str, default) -> np.ndarray:
        p = self.place(slot)
        return np.where(p >= 0, self.rows.get(p, code, p >= 0), np.array(default, code))

    def follow(self, slot: int) -> np.ndarray:
        p = self.place(slot)
        return np.where(p >= 0, p + self.rows.get(p, "<u4", p >= 0).astype(np.int64), -1)

    def vector(self, slot: int, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
        """Length of each row's vector and all elements."""
        p = self.follow(slot)
        n = self.rows.get(p, "<u4", p >= 0).astype(np.int64)
        self.rows.fail((p >= 0) & (p + 4 + n * kind.itemsize > self.rows.end), "vector beyond the data")
        n = np.where((p >= 0) & (self.rows.status == "ok"), n, 0)
        at = np.repeat(p + 4, n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * kind.itemsize
        return n, self.rows.data[at[:, None] + np.arange(kind.itemsize)].reshape(-1).view(kind)


def read(rows: Rows, expected: np.ndarray, payload: pa.StructType) -> tuple[list[str], list[str | None], pa.StructArray]:
    """Status (ok or what is wrong), kind and payload of each row's table; ``expected``: the kind that it must be, or "" for any."""
    read_it = expected != "C"  # a C packet's content isn't on the wire
    rows.fail(read_it & (rows.end - rows.start < 8), "incomplete")
    outer = _Tables(rows, rows.start + rows.get(rows.start, "<u4", read_it).astype(np.int64), read_it)
    code, at = outer.scalar(0, "u1", 0), outer.follow(1)
    rows.fail(read_it & (~np.isin(code, tuple(wire.KINDS)) | (at < 0)), "no payload")
    kind = np.array([wire.KINDS.get(int(c)) for c in code], object)
    kind[~read_it] = "C"
    t = _Tables(rows, at, read_it & (kind != "C") & (rows.status == "ok"))
    made: dict[str, np.ndarray] = {}
    for own, fields in FIELDS.items():
        t.wanted = (kind == own) & read_it
        for name, (slot, dtype) in fields.items():
            value = t.scalar(slot, dtype, DEFAULTS.get(name, 0))
            made[name] = np.where(t.wanted, value, made[name]) if name in made else value
    t.wanted = (kind == "D") & read_it
    lists = {"vectors": t.vector(1, VECTOR), "compact": t.vector(2, COMPACT)}
    rows.fail((expected != "") & (kind != expected), "payload type")
    ok = rows.status == "ok"
    columns = []
    for f in payload:
        if f.name in lists:
            n, flat = lists[f.name]
            has = ok & (kind == "D")
            keep = np.repeat(has, n)
            ends = np.concatenate(([0], np.cumsum(np.where(has, n, 0)))).astype(np.int32)
            item = pa.StructArray.from_arrays([pa.array(flat[c.name][keep].astype(np.int64)).cast(c.type) for c in f.type.value_type], fields=list(f.type.value_type))
            columns.append(pa.ListArray.from_arrays(pa.array(ends), item, type=f.type, mask=pa.array(~has)))
        else:
            has = ok & np.isin(kind, [k for k, fields in FIELDS.items() if f.name in fields])
            value = made[f.name]
            columns.append(pa.array(value if value.dtype.kind == "f" else value.astype(np.int64), mask=~has).cast(f.type))
    whole = pa.StructArray.from_arrays(columns, fields=list(payload), mask=pa.array(~ok))
    return rows.status.tolist(), [k if good else None for k, good in zip(kind, ok)], whole
