"""Corrections coded in their formats, parity packets for lost ones, and regions composed over a background."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codecs


def _formatted(rows: DataFrame, data: str, format: str, into: str, by: dict) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    keep = [c for c in kinds if c != into]

    def run(batches):
        for batch in batches:
            names, out = batch[format].to_pylist(), [None] * batch.num_rows
            for name in set(names) & set(by):
                at = [i for i, n in enumerate(names) if n == name]
                for i, x in zip(at, by[name](batch[data].take(pa.array(at))).to_pylist()):
                    out[i] = x
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(out, pa.binary())], names=[*keep, into])

    return rows.mapInArrow(run, "".join(f"`{c}` {kinds[c]}, " for c in keep) + f"`{into}` binary")


def encode(rows: DataFrame, data: str = "data", format: str = "format", into: str = "coded") -> DataFrame:
    """Adds ``into``: the bytes of ``data`` in each row's format (Raw, Rle, Lz4, Zstd or DeltaRle); null for other formats and null data."""
    return _formatted(rows, data, format, into, codecs.ENCODE)


def decode(rows: DataFrame, data: str = "coded", format: str = "format", into: str = "data") -> DataFrame:
    """The inverse of ``encode``: null for what can't be decoded."""
    return _formatted(rows, data, format, into, codecs.DECODE)


def smallest(rows: DataFrame, key: list[str], data: str = "data", formats: tuple[str, ...] = ("Raw", "Rle", "DeltaRle")) -> DataFrame:
    """Each row in the format that makes it smallest (of equal ones the first), as format and coded; key identifies rows."""
    each = rows.withColumn("__order", F.explode(F.array(*[F.lit(k) for k in range(len(formats))])))
    coded = encode(each.withColumn("format", F.element_at(F.array(*[F.lit(f) for f in formats]), F.col("__order") + 1)), data)
    best = F.min_by(F.struct("format", "coded"), F.struct(F.length("coded"), "__order"))
    return coded.groupBy(*key).agg(best.alias("b")).select(*key, "b.format", "b.coded")


# --- forward error correction: Reed-Solomon by a Cauchy matrix over GF(256) -------------------------------------------


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Products and inverses in GF(256) with the polynomial 0x11d."""
    exp, log, x = np.zeros(510, np.int64), np.zeros(256, np.int64), 1
    for k in range(255):
        exp[k] = exp[k + 255] = x
        log[x] = k
        x = x << 1 ^ (0x11D if x & 128 else 0)
    product = exp[log[:, None] + log[None, :]]
    product[0], product[:, 0] = 0, 0
    return product.astype(np.uint8), exp[(255 - log) % 255].astype(np.uint8)


def _matrix(data: int, parity: int) -> np.ndarray:
    """1 / (x + y) for ``parity`` rows x and ``data`` columns y, all different: every square part has an inverse."""
    return _tables()[1][(np.arange(parity)[:, None] + data) ^ np.arange(data)[None, :]]


def _times(matrix: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """matrix (m, n) by rows (..., n, bytes)."""
    product = _tables()[0]
    out = np.zeros((*rows.shape[:-2], len(matrix), rows.shape[-1]), np.uint8)
    for i, line in enumerate(matrix):
        for k, c in enumerate(line):
            out[..., i, :] ^= product[c][rows[..., k, :]]
    return out


@lru_cache(4096)
def _inverse(data: int, parity: int, lost: tuple[int, ...], used: tuple[int, ...]) -> np.ndarray:
    """Of the part of the matrix with rows ``used`` and columns ``lost``, by elimination."""
    product, inverse = _tables()
    n = len(lost)
    m = np.concatenate((_matrix(data, parity)[np.ix_(used, lost)], np.eye(n, dtype=np.uint8)), 1)
    for k in range(n):
        pivot = k + int(np.flatnonzero(m[k:, k])[0])
        m[[k, pivot]] = m[[pivot, k]]
        m[k] = product[inverse[m[k, k]]][m[k]]
        for i in range(n):
            if i != k:
                m[i] ^= product[m[i, k]][m[k]]
    return m[:, n:]


def _shards(found: list[dict], data: int, width: int) -> np.ndarray:
    """(data, width): each packet's length and bytes in its slot, zeros behind and elsewhere."""
    out = np.zeros((data, width), np.uint8)
    for p in found:
        own = len(p["raw"]).to_bytes(4, "little") + p["raw"]
        out[p["slot"], : len(own)] = np.frombuffer(own, np.uint8)
    return out


def _groups(packets: DataFrame, data: int, first: int) -> DataFrame:
    place = F.col("sequence") - first
    rows = packets.where("stream_id is not null and sequence is not null and raw is not null").select("stream_id", F.floor(place / data).cast("long").alias("part"), (place % data).cast("int").alias("slot"), "raw")
    return rows.groupBy("stream_id", "part", "slot").agg(F.max("raw").alias("raw"))  # a packet that comes twice counts once


def parity(packets: DataFrame, data: int = 8, extra: int = 2, first: int = 1) -> DataFrame:
    """stream_id, part, slots, number (from 0), code: ``extra`` parity packets for each ``data`` sequences of a stream.

    slots: which of the sequences there are, as bits. Groups hold at most ``data`` packets; ``data`` is at most 63, ``data`` + ``extra`` 256.
    """
    if not (0 < data < 64 and 0 < extra and data + extra <= 256):
        raise ValueError("at most 63 packets a group, 256 with their parity")
    grouped = _groups(packets, data, first).groupBy("stream_id", "part").agg(F.collect_list(F.struct("slot", "raw")).alias("found"))

    def run(batches):
        m = _matrix(data, extra)
        for batch in batches:
            keys, slots, number, code = [], [], [], []
            for i, found in enumerate(batch["found"].to_pylist()):
                made = _times(m, _shards(found, data, 4 + max(len(p["raw"]) for p in found)))
                keys += [i] * extra
                slots += [sum(1 << p["slot"] for p in found)] * extra
                number += range(extra)
                code += [x.tobytes() for x in made]
            take = pa.array(keys, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["stream_id"].take(take), batch["part"].take(take), pa.array(slots, pa.int64()), pa.array(number, pa.int32()), pa.array(code, pa.binary())], names=["stream_id", "part", "slots", "number", "code"])

    kind = dict(packets.dtypes)["stream_id"]
    return grouped.mapInArrow(run, f"stream_id {kind}, part long, slots long, number int, code binary")


def restore(packets: DataFrame, codes: DataFrame, data: int = 8, extra: int = 2, first: int = 1) -> DataFrame:
    """stream_id, sequence, raw, status: packets that are there (received), those made again from parity (restored), and those that too few are left for (lost, raw is null).

    Of a group any ``data`` of its packets and parity packets will do. Groups without a parity packet give what was received.
    """
    own = _groups(packets, data, first).groupBy("stream_id", "part").agg(F.collect_list(F.struct("slot", "raw")).alias("found"))
    more = codes.where("code is not null").groupBy("stream_id", "part", "number").agg(F.max("code").alias("code"), F.max("slots").alias("slots")).groupBy("stream_id", "part").agg(F.collect_list(F.struct("number", "code")).alias("codes"), F.max("slots").alias("slots"))
    kind = dict(packets.dtypes)["stream_id"]

    def run(batches):
        m = _matrix(data, extra)
        for batch in batches:
            keys, slot, raw, status = [], [], [], []
            for i, r in enumerate(batch.to_pylist()):
                found, left = r["found"] or [], sorted(r["codes"] or [], key=lambda c: c["number"])
                there = {p["slot"] for p in found}
                lost = tuple(s for s in range(data) if (r["slots"] or 0) >> s & 1 and s not in there)
                for p in found:
                    slot.append(p["slot"]), raw.append(p["raw"]), status.append("received")
                used = tuple(c["number"] for c in left)[: len(lost)]
                if lost and len(used) == len(lost):
                    width = len(left[0]["code"])
                    code = np.stack([np.frombuffer(c["code"], np.uint8) for c in left[: len(lost)]])
                    code = code ^ _times(m[list(used)], _shards(found, data, width))
                    for s, x in zip(lost, _times(_inverse(data, extra, lost, used), code)):
                        n = int.from_bytes(x[:4].tobytes(), "little")
                        slot.append(s), raw.append(x[4 : 4 + n].tobytes()), status.append("restored")
                else:
                    for s in lost:
                        slot.append(s), raw.append(None), status.append("lost")
                keys += [i] * (len(slot) - len(keys))
            take = pa.array(keys, pa.int64())
            sequence = pc.add(pc.add(pc.multiply(batch["part"].take(take), data), pa.array(slot, pa.int64())), first)
            yield pa.RecordBatch.from_arrays([batch["stream_id"].take(take), sequence, pa.array(raw, pa.binary()), pa.array(status, pa.string())], names=["stream_id", "sequence", "raw", "status"])

    return own.join(more, ["stream_id", "part"], "full").mapInArrow(run, f"stream_id {kind}, sequence long, raw binary, status string")


# --- composition -----------------------------------------------------------------------------------------------------


def composed(background: np.ndarray, region: np.ndarray, x: int, y: int, mask: np.ndarray) -> np.ndarray:
    """background (height, width) with region from (x, y) on, where mask (as large as the background) isn't 0; what lies outside is cut."""
    out = background.copy()
    h, w = min(region.shape[0], out.shape[0] - y), min(region.shape[1], out.shape[1] - x)
    if x >= 0 and y >= 0 and h > 0 and w > 0:
        part = out[y : y + h, x : x + w]
        part[...] = np.where(mask[y : y + h, x : x + w] != 0, region[:h, :w], part)
    return out


def compose(rows: DataFrame, into: str = "composed") -> DataFrame:
    """Adds the frame that a composite instruction asks for: rows with width, height, background, bbox (x, y, width, height), region and rle (run-length mask of the whole frame).

    Without a background (null) the frame is black; without a box, region or mask the background stays. Null if width and
    height don't fit the background, or the box's the region.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    keep = [c for c in kinds if c != into]

    def one(r: dict) -> bytes | None:
        w, h = r["width"], r["height"]
        if w is None or h is None or (r["background"] is not None and len(r["background"]) != w * h):
            return None
        under = np.zeros((h, w), np.uint8) if r["background"] is None else np.frombuffer(r["background"], np.uint8).reshape(h, w)
        if r["bbox"] is None or r["region"] is None or r["rle"] is None:
            return under.tobytes()
        x, y, bw, bh = r["bbox"]
        if len(r["region"]) != bw * bh:
            return None
        runs = np.frombuffer(r["rle"][: len(r["rle"]) // 3 * 3], np.uint8).reshape(-1, 3)
        mask = np.zeros(w * h, np.uint8)
        made = np.repeat(runs[:, 2], runs[:, 0].astype(np.int64) | runs[:, 1].astype(np.int64) << 8)[: w * h]
        mask[: len(made)] = made
        return composed(under, np.frombuffer(r["region"], np.uint8).reshape(bh, bw), x, y, mask.reshape(h, w)).tobytes()

    need = ["width", "height", "background", "bbox", "region", "rle"]

    def run(batches):
        for batch in batches:
            made = [one(r) for r in batch.select(need).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(made, pa.binary())], names=[*keep, into])

    return rows.mapInArrow(run, "".join(f"`{c}` {kinds[c]}, " for c in keep) + f"`{into}` binary")


def crop(data: Column, width: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """The bytes of a box of a frame, row by row; the box lies inside."""
    rows = F.transform(F.sequence(F.lit(0), (h - 1).cast("int")), lambda k: F.hex(F.substring(data, ((y + k) * width + x + 1).cast("int"), w.cast("int"))))
    return F.unhex(F.array_join(rows, ""))
