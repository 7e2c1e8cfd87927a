"""Packet headers, flags, sizes, checksums and payload codecs over columns and rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar, values, wire_arrow


def header(packet_type: Column, sequence: Column, payload_len: Column, flags: Column | None = None) -> Column:
    """The 16 header bytes, big-endian."""
    text = F.concat(F.lit(values.MAGIC_HEX), scalar.hex_be(F.lit(values.VERSION), 1), scalar.hex_be(packet_type, 1), scalar.hex_be(F.lit(0) if flags is None else flags, 2), scalar.hex_be(sequence, 4), scalar.hex_be(payload_len, 4))
    return F.unhex(text)


def decode_header(raw: Column) -> Column:
    """Struct status, version, packet_type, flags, sequence, payload_len; fields are null unless status is ok. The version isn't judged."""
    kind = scalar.uint_be(raw, 5, 1)
    status = F.when(raw.isNull() | (F.length(raw) < values.HEADER_BYTES), "incomplete").when(F.hex(F.substring(raw, 1, 4)) != values.MAGIC_HEX, "magic").when(~kind.isin(*values.PACKET_TYPES), "type").otherwise("ok")
    ok = status == "ok"
    return F.struct(status.alias("status"), *[F.when(ok, scalar.uint_be(raw, at, n)).alias(name) for name, at, n in (("version", 4, 1), ("packet_type", 5, 1), ("flags", 6, 2), ("sequence", 8, 4), ("payload_len", 12, 4))])


def total_size(payload_len: Column) -> Column:
    return payload_len + values.HEADER_BYTES


def seal_crc(data: Column) -> Column:
    """data and its CRC-32, big-endian."""
    return F.concat(data, F.unhex(scalar.hex_be(F.crc32(data), 4)))


def crc_ok(raw: Column) -> Column:
    body = F.substring(raw, F.lit(1), F.length(raw) - values.CRC_BYTES)
    return (F.length(raw) >= values.HEADER_BYTES + values.CRC_BYTES) & (F.crc32(body) == F.conv(F.hex(F.substring(raw, -4, 4)), 16, 10).cast("long"))


def estimate_i(regions: Column) -> Column:
    return 64 + regions * 128


def estimate_d(vectors: Column, deltas: Column) -> Column:
    return 32 + vectors * 12 + deltas * 64


def estimate_c(lengths: Column) -> Column:
    """lengths: array of the corrections' byte counts."""
    return F.aggregate(lengths, F.lit(32).cast("long"), lambda s, x: s + x + 32)


def estimate_s() -> Column:
    return F.lit(64).cast("long")


def estimated_size(payload: Column) -> Column:
    return payload + values.HEADER_BYTES + values.CRC_BYTES


PAYLOAD = "struct<width: long, height: long, fps: float, quality: int, timestamp_ms: long, ref_sequence: long, vectors: array<struct<block_x: int, block_y: int, dx: int, dy: int, sad: long>>, compact: array<struct<dx: int, dy: int>>, command: int>"


def encode_packets(df: DataFrame, keep_quality: bool = False) -> DataFrame:
    """stream_id, kind (I, D, C or S), sequence, payload (PAYLOAD) to raw bytes. keep_quality: also an I packet's quality is written.

    Slices of Arrow batches are written as a whole: packets of one layout share a template. Rows without a kind or sequence give null.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    keep = [c for c in kinds if c not in ("payload", "raw")]

    def rows(batches):
        encoder = wire_arrow.Encoder(keep_quality)
        for batch in (own for whole in batches for own in wire_arrow.slices(whole)):
            raw = encoder(batch["kind"].to_numpy(zero_copy_only=False), batch["sequence"], batch["payload"])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), raw.cast(pa.binary())], names=[*keep, "raw"])

    return df.mapInArrow(rows, "".join(f"`{c}` {kinds[c]}, " for c in keep) + "raw binary")


def _payload_type(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.sparkSession.createDataFrame([], f"p {PAYLOAD}").schema["p"].dataType)


def decode_packets(df: DataFrame) -> DataFrame:
    """Adds status (ok or what failed first), kind, sequence, payload_len and payload to rows with raw.

    Length, checksum and header are judged in this order, and only what passes is read; slices of Arrow batches are read as a whole.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    keep, arrow = [c for c in types if c not in ("kind", "sequence", "payload_len", "payload", "status")], _payload_type(df)
    names = np.array([values.PACKET_TYPES.get(k, "") for k in range(1 + max(values.PACKET_TYPES))], object)

    def rows(batches):
        for batch in (part for received in batches for part in wire_arrow.slices(received)):
            own = wire_arrow.Rows(batch["raw"])
            code, sequence, length = own.packets()
            whole = own.status == "ok"
            status, kind, payload = wire_arrow.read(own, names[np.where(whole, code, 0)], arrow)
            bad = np.array([s != "ok" for s in status], bool)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(status), pa.array([None if b else k for k, b in zip(kind, bad)], pa.string()), pa.array(sequence, mask=bad), pa.array(length, mask=bad), payload], names=[*keep, "status", "kind", "sequence", "payload_len", "payload"])

    return df.select(*keep).mapInArrow(rows, "".join(f"`{c}` {types[c]}, " for c in keep) + f"status string, kind string, sequence long, payload_len long, payload {PAYLOAD}")


def read_payloads(df: DataFrame, body: str = "body", expected: str | None = None) -> DataFrame:
    """Adds status, kind and payload to rows with a payload table's bytes. With ``expected`` (I, D or S) other kinds are "payload type"; a C table has a kind only."""
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    keep, arrow = [c for c in types if c not in ("status", "kind", "payload")], _payload_type(df)

    def rows(batches):
        for batch in (part for received in batches for part in wire_arrow.slices(received)):
            status, kind, payload = wire_arrow.read(wire_arrow.Rows(batch[body]), np.full(batch.num_rows, expected or "", object), arrow)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(status), pa.array(kind, pa.string()), payload], names=[*keep, "status", "kind", "payload"])

    return df.mapInArrow(rows, "".join(f"`{c}` {types[c]}, " for c in keep) + f"status string, kind string, payload {PAYLOAD}")


def fits(raw: Column, capacity: Column) -> Column:
    """ok, or how many bytes a buffer of ``capacity`` lacks for ``raw``."""
    need = F.length(raw)
    return F.when(need <= capacity, "ok").otherwise(F.format_string("buffer too small: need %d, got %d", need, capacity))


def accessors(df: DataFrame) -> DataFrame:
    """kind, sequence, is_keyframe, payload_size and the variants' own fields, null for the other variants."""
    kind = F.col("kind")
    return df.select("*", (kind == "I").alias("is_keyframe"), *[F.when(kind == k, F.col("payload")).alias(f"as_{k.lower()}") for k in "IDCS"])
