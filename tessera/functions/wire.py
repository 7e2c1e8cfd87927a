"""Bytes of packets and of audio frames. Payload tables follow the FlatBuffers format, written and read directly."""

from __future__ import annotations

import struct
import zlib

from .values import MAGIC_HEX

MAGIC = bytes.fromhex(MAGIC_HEX)
#: Members of the payload union (fixed values).
UNION = {"I": 1, "D": 2, "C": 3, "S": 4}
KINDS = {1: "I", 2: "D", 3: "C", 4: "S"}
PING, PONG = 7, 8


class WireError(ValueError):
    pass


# --- tables ---------------------------------------------------------------------------------------------------


def _table(fields: list[tuple[int, str, object]], slots: int) -> bytes:
    """A vtable and its table. fields: (slot, struct code or "vector" or "table", value); offsets point behind the table."""
    vsize = 4 + 2 * slots
    scalars = [(s, k, v) for s, k, v in fields if k not in ("vector", "table")]
    refs = [(s, k, v) for s, k, v in fields if k in ("vector", "table")]
    order = sorted([(struct.calcsize(k), s, k, v) for s, k, v in scalars] + [(4, s, k, v) for s, k, v in refs], key=lambda x: -x[0])
    pad = -vsize % 8
    at, places = 4, {}
    if order and order[0][0] == 8:
        at = 8
    for size, s, _, _ in order:
        places[s] = at
        at += size
    size = at + -at % 8
    body, tail = bytearray(size), bytearray()
    base = pad + vsize
    struct.pack_into("<i", body, 0, vsize)
    for _, s, k, v in order:
        if k == "vector":
            item, packed = v
            lead = (-(base + size + len(tail) + 4)) % 8 if item > 4 else 0
            tail += bytes(lead)
            struct.pack_into("<I", body, places[s], size + len(tail) - places[s])
            tail += struct.pack("<I", len(packed) // item) + packed
            tail += bytes(-len(tail) % 8)
        elif k == "table":
            child, root = v
            tail += bytes(-(base + size + len(tail)) % 8)
            struct.pack_into("<I", body, places[s], size + len(tail) + root - places[s])
            tail += child
        else:
            struct.pack_into("<" + k, body, places[s], v)
    vtable = struct.pack("<HH", vsize, size) + b"".join(struct.pack("<H", places.get(s, 0)) for s in range(slots))
    return bytes(pad) + vtable + bytes(body) + bytes(tail)


def _root(data: bytes, slots: int) -> tuple[bytes, int]:
    """The table's bytes and where in them it starts."""
    return data, -(4 + 2 * slots) % 8 + 4 + 2 * slots


def payload_bytes(kind: str, table: bytes, slots: int) -> bytes:
    outer = _table([(0, "B", UNION[kind]), (1, "table", _root(table, slots))], 2)
    start = 8
    return struct.pack("<I", start + _root(outer, 2)[1]) + MAGIC + outer


def i_table(width: int, height: int, fps: float, quality: int = 1, timestamp_ms: int = 0) -> bytes:
    return payload_bytes("I", _table([(0, "I", width), (1, "I", height), (2, "f", fps), (3, "b", quality), (7, "Q", timestamp_ms)], 8), 8)


def d_table(ref_sequence: int, vectors=(), compact=(), timestamp_ms: int = 0) -> bytes:
    fields = [(0, "I", ref_sequence), (5, "Q", timestamp_ms)]
    if len(vectors):
        fields.append((1, "vector", (12, b"".join(struct.pack("<HHhhI", *v) for v in vectors))))
    if len(compact):
        fields.append((2, "vector", (2, b"".join(struct.pack("<bb", *v) for v in compact))))
    return payload_bytes("D", _table(fields, 6), 6)


def s_table(command: int = PING, timestamp_ms: int = 0) -> bytes:
    return payload_bytes("S", _table([(0, "b", command), (3, "Q", timestamp_ms)], 4), 4)


class Table:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at
        self.vtable = at - struct.unpack_from("<i", data, at)[0]
        self.size = struct.unpack_from("<H", data, self.vtable)[0]

    def place(self, slot: int) -> int:
        o = 4 + 2 * slot
        rel = struct.unpack_from("<H", self.data, self.vtable + o)[0] if o < self.size else 0
        return self.at + rel if rel else 0

    def scalar(self, slot: int, code: str, default):
        p = self.place(slot)
        return struct.unpack_from("<" + code, self.data, p)[0] if p else default

    def follow(self, slot: int) -> int:
        p = self.place(slot)
        return p + struct.unpack_from("<I", self.data, p)[0] if p else 0

    def vector(self, slot: int, code: str) -> list[tuple]:
        p = self.follow(slot)
        if not p:
            return []
        n, size = struct.unpack_from("<I", self.data, p)[0], struct.calcsize("<" + code)
        if p + 4 + n * size > len(self.data):
            raise WireError("vector beyond the data")
        return [struct.unpack_from("<" + code, self.data, p + 4 + k * size) for k in range(n)]


def read_payload(data: bytes) -> dict:
    """kind and fields of a payload; WireError if it can't be one."""
    if len(data) < 8:
        raise WireError("incomplete")
    try:
        outer = Table(data, struct.unpack_from("<I", data)[0])
        kind = KINDS.get(outer.scalar(0, "B", 0))
        at = outer.follow(1)
        if kind is None or not at:
            raise WireError("no payload")
        t = Table(data, at)
        if kind == "I":
            return {"kind": "I", "width": t.scalar(0, "I", 0), "height": t.scalar(1, "I", 0), "fps": t.scalar(2, "f", 0.0), "quality": t.scalar(3, "b", 1), "timestamp_ms": t.scalar(7, "Q", 0)}
        if kind == "D":
            return {"kind": "D", "ref_sequence": t.scalar(0, "I", 0), "vectors": t.vector(1, "HHhhI"), "compact": t.vector(2, "bb"), "timestamp_ms": t.scalar(5, "Q", 0)}
        if kind == "S":
            return {"kind": "S", "command": t.scalar(0, "b", PING), "timestamp_ms": t.scalar(3, "Q", 0)}
        return {"kind": "C"}
    except struct.error as e:
        raise WireError("malformed") from e


# --- packets ----------------------------------------------------------------------------------------------------


def frame(kind: str, sequence: int, payload: bytes, flags: int = 0) -> bytes:
    head = MAGIC + struct.pack(">BBHII", 1, UNION[kind], flags, sequence, len(payload))
    return head + payload + struct.pack(">I", zlib.crc32(head + payload))


def wire_payload(kind: str, p: dict) -> bytes:
    """What the wire keeps: an I packet's quality and a C packet's content are not written, and of commands only ping and pong."""
    ts = p.get("timestamp_ms") or 0
    if kind == "I":
        return i_table(p["width"], p["height"], p["fps"], 1, ts)
    if kind == "D":
        return d_table(p["ref_sequence"], p.get("vectors") or (), p.get("compact") or (), ts)
    command = p.get("command", PING) if kind == "S" else PING
    return s_table(command if command in (PING, PONG) else PING, ts)


def parse(data: bytes) -> dict:
    """Checks length, CRC, header and payload, in this order; WireError names the first that fails."""
    if len(data) < 20:
        raise WireError("incomplete")
    if zlib.crc32(data[:-4]) != int.from_bytes(data[-4:], "big"):
        raise WireError("checksum")
    if data[:4] != MAGIC:
        raise WireError("magic")
    _, kind, flags, sequence, size = struct.unpack_from(">BBHII", data, 4)
    if kind not in KINDS:
        raise WireError("type")
    payload = read_payload(data[16:-4]) if KINDS[kind] != "C" else {"kind": "C"}
    if payload["kind"] != KINDS[kind]:
        raise WireError("payload type")
    return payload | {"kind": KINDS[kind], "sequence": sequence, "flags": flags, "payload_len": size}


# --- audio --------------------------------------------------------------------------------------------------------

AUDIO = struct.Struct("<IQBIIBI")


def audio_frame(sequence: int, timestamp_ms: int, layer: int, rate: int, size: int, key: bool, payload: bytes) -> bytes:
    return AUDIO.pack(sequence, timestamp_ms, layer, rate, size, int(key), len(payload)) + payload


def read_audio_frame(data: bytes) -> dict:
    if len(data) < AUDIO.size:
        raise WireError("incomplete")
    sequence, ts, layer, rate, size, key, n = AUDIO.unpack_from(data)
    if layer not in (0, 1):
        raise WireError("layer")
    if AUDIO.size + n > len(data):
        raise WireError("truncated")
    return {"sequence": sequence, "timestamp_ms": ts, "layer": layer, "sample_rate": rate, "frame_size": size, "keyframe": bool(key), "payload": data[AUDIO.size : AUDIO.size + n]}


def pack_parametric(items: list[dict]) -> bytes:
    out = struct.pack("<I", len(items))
    for p in items:
        out += struct.pack("<H", len(p["coeffs"])) + struct.pack(f"<{len(p['coeffs'])}f", *p["coeffs"])
        out += struct.pack("<ffffBBffII", p["gain"], p["f0"], p["period"], p["pitch_confidence"], p["voiced"], p["active"], p["activity_confidence"], p["energy_db"], p["frame_size"], p["sample_rate"])
    return out


def unpack_parametric(data: bytes) -> list[dict]:
    try:
        count, at, out = struct.unpack_from("<I", data)[0], 4, []
        for _ in range(count):
            n = struct.unpack_from("<H", data, at)[0]
            coeffs = list(struct.unpack_from(f"<{n}f", data, at + 2))
            at += 2 + 4 * n
            f = struct.unpack_from("<ffffBBffII", data, at)
            at += 34
            names = ("gain", "f0", "period", "pitch_confidence", "voiced", "active", "activity_confidence", "energy_db", "frame_size", "sample_rate")
            out.append({"coeffs": coeffs} | dict(zip(names, f)) | {"voiced": bool(f[4]), "active": bool(f[5])})
        return out
    except struct.error as e:
        raise WireError("incomplete") from e


def pack_spectral(items: list[dict]) -> bytes:
    out = struct.pack("<I", len(items))
    for p in items:
        out += struct.pack("<fII", p["energy"], p["frame_size"], len(p["coefficients"])) + b"".join(struct.pack("<Hf", i, v) for i, v in p["coefficients"])
    return out


def unpack_spectral(data: bytes) -> list[dict]:
    try:
        count, at, out = struct.unpack_from("<I", data)[0], 4, []
        for _ in range(count):
            energy, size, n = struct.unpack_from("<fII", data, at)
            out.append({"energy": energy, "frame_size": size, "coefficients": [struct.unpack_from("<Hf", data, at + 12 + 6 * k) for k in range(n)]})
            at += 12 + 6 * n
        return out
    except struct.error as e:
        raise WireError("incomplete") from e
