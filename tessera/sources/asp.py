"""Packet files as a data source of Spark: ``spark.read.format("packets").load(folder)`` after ``register(spark)``.

A file is packets one after the other: header, payload, checksum. A folder's commits are numbered files in ``_commits`` that
name the data files and sizes of a write; what no commit names isn't there, so a write is all or nothing and a batch of a
stream that runs again is there once. A folder without ``_commits`` is read as the files that it holds.

Files are read in splits of ``splitBytes`` (64 MB): a split's packets are those that begin in it. Beside each file that this
source wrote, an index names the first packet after each STRIDE bytes, so splits begin at packets. Files without one are
resynchronised at the next packet whose checksum is right; should payloads hold whole packets, give such files an index (``index``)
or one split. Bytes that are no packet are told as one row with status damaged, their place and length; whoever read the packet
before them tells them. Comparisons of packet_type, sequence, flags and payload_len with values are applied to headers: a packet
that they reject is passed over if another follows it or the file ends, without reading its payload.
"""

from __future__ import annotations

import json
import operator
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds

from ..functions import values

SCHEMA = "file string, offset long, status string, packet_type int, flags int, sequence long, payload_len long, raw binary"
MAGIC, HEADER, AROUND = bytes.fromhex(values.MAGIC_HEX), struct.Struct(">4sBBHII"), values.HEADER_BYTES + values.CRC_BYTES
STRIDE, AHEAD, BATCH_ROWS, BATCH_BYTES = 1 << 20, 1 << 20, 1000, 8 << 20
COMPARE = {"EqualTo": operator.eq, "GreaterThan": operator.gt, "GreaterThanOrEqual": operator.ge, "LessThan": operator.lt, "LessThanOrEqual": operator.le, "In": lambda v, some: v in some}
FIELDS = ("packet_type", "flags", "sequence", "payload_len")


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if re.match(r"[a-z0-9]+:", folder) else f"file://{folder}")


@dataclass
class Split(ds.InputPartition):
    path: str
    start: int
    end: int
    size: int
    exact: bool  # start is known to be a packet's


class Window:
    """Bytes of a file by position, read AHEAD at a time."""

    def __init__(self, file: pa.NativeFile, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        if not (self.at <= at and at + n <= self.at + len(self.data)):
            self.file.seek(at)
            self.at, self.data = at, self.file.read(min(max(n, AHEAD), self.size - at))
        return self.data[at - self.at : at - self.at + n]

    def header(self, at: int) -> tuple | None:
        """Type, flags, sequence and payload length of what may be a packet at ``at``."""
        raw = self.get(at, values.HEADER_BYTES)
        if len(raw) < values.HEADER_BYTES or raw[:4] != MAGIC:
            return None
        _, _, kind, flags, sequence, n = HEADER.unpack(raw)
        return (kind, flags, sequence, n) if kind in values.PACKET_TYPES and at + n + AROUND <= self.size else None

    def packet(self, at: int, header: tuple) -> bytes | None:
        raw = self.get(at, header[3] + AROUND)
        return raw if zlib.crc32(raw[:-4]) == int.from_bytes(raw[-4:], "big") else None

    def next_packet(self, at: int, stop: int) -> int | None:
        """The first place from ``at`` and before ``stop`` where a packet with a right checksum begins."""
        while at < stop:
            found = self.get(at, min(AHEAD, stop + 3 - at)).find(MAGIC)
            if found < 0:
                at += max(1, min(AHEAD, stop + 3 - at) - 3)
                continue
            at += found
            if at < stop and (h := self.header(at)) and self.packet(at, h):
                return at
            at += 1
        return None


def packets(window: Window, split: Split, wanted) -> Iterator[tuple]:
    """(offset, status, header or None, bytes or None, length) of what begins in the split."""
    at = split.start if split.exact else window.next_packet(split.start, split.end)
    while at is not None and at < split.end:
        h = window.header(at)
        if h and not wanted(h):
            after = at + h[3] + AROUND
            if after == window.size or window.get(after, 4) == MAGIC or window.packet(at, h):
                at = after
            else:
                h = None
        elif h:
            raw = window.packet(at, h)
            if raw:
                yield at, "ok", h, raw, len(raw)
                at += len(raw)
            else:
                h = None
        if h and at < window.size and at >= split.end:  # damage right behind the last packet is told here
            after = window.header(at)
            if after and (not wanted(after) or window.packet(at, after)):
                return
            h = None
        if h is None:
            to = window.next_packet(at + 1, window.size)
            yield at, "damaged", None, None, (window.size if to is None else to) - at
            at = to


class Files:
    """The files of a folder, and their splits."""

    def __init__(self, options: dict):
        self.folder, self.step = options["path"], int(options.get("splitBytes", 64 << 20))

    def commits(self) -> list[str] | None:
        """Paths of the commits in order, None if the folder has none."""
        store, top = opened(self.folder)
        if store.get_file_info(f"{top}/_commits").type != fs.FileType.Directory:
            return None
        return sorted(f.path for f in store.get_file_info(fs.FileSelector(f"{top}/_commits")) if f.base_name[:1].isdigit())

    def named(self, commits: list[str]) -> list[tuple[str, int]]:
        store, top = opened(self.folder)
        out = []
        for path in commits:
            with store.open_input_stream(path) as f:
                out += [(f"{top}/{name}", size) for name, size in json.loads(f.read())["files"]]
        return out

    def files(self) -> list[tuple[str, int]]:
        commits = self.commits()
        if commits is not None:
            return self.named(commits)
        store, top = opened(self.folder)
        info = store.get_file_info(top)
        if info.type == fs.FileType.File:
            return [(top, info.size)]
        return sorted((f.path, f.size) for f in store.get_file_info(fs.FileSelector(top)) if f.type == fs.FileType.File and f.base_name[0] not in "._" and not f.base_name.endswith(".idx"))

    def splits(self, files: list[tuple[str, int]]) -> list[Split]:
        store, out = opened(self.folder)[0], []
        for path, size in files:
            edges, exact = list(range(0, size, self.step)) or [0], False
            if len(edges) > 1 and store.get_file_info(f"{path}.idx").type == fs.FileType.File:
                with store.open_input_stream(f"{path}.idx") as f:
                    known = np.frombuffer(f.read(), "<i8")
                edges, exact = sorted({0} | {int(known[k]) for k in np.searchsorted(known, edges) if k < len(known)}), True
            out += [Split(path, a, b, size, exact or a == 0) for a, b in zip(edges, [*edges[1:], size])]
        return out

    def read(self, split: Split, filters: list[tuple[str, str, object]]) -> Iterator[pa.RecordBatch]:
        checks = [(FIELDS.index(name), COMPARE[kind], value) for name, kind, value in filters]
        wanted = lambda h: all(f(h[k], v) for k, f, v in checks)
        rows, size = [], 0
        with opened(self.folder)[0].open_input_file(split.path) as file:
            for at, status, h, raw, n in packets(Window(file, split.size), split, wanted):
                if status == "damaged" and checks:
                    continue
                rows.append((split.path, at, status, *((h[0], h[1], h[2], h[3]) if h else (None, None, None, n)), raw))
                size += len(raw or b"")
                if len(rows) == BATCH_ROWS or size > BATCH_BYTES:
                    yield batch_of(rows)
                    rows, size = [], 0
        if rows:
            yield batch_of(rows)


ARROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("status", pa.string()), ("packet_type", pa.int32()), ("flags", pa.int32()), ("sequence", pa.int64()), ("payload_len", pa.int64()), ("raw", pa.binary())])


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


class Reader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.of, self.filters = Files(options), []

    def pushFilters(self, filters):
        for f in filters:
            kind, name = type(f).__name__, f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if kind in COMPARE and name in FIELDS and f.value is not None:
                self.filters.append((name, kind, tuple(f.value) if kind == "In" else f.value))
            yield f  # damage has no header, so Spark looks once more

    def partitions(self):
        return self.of.splits(self.of.files()) or [Split("", 0, 0, 0, True)]

    def read(self, partition):
        if partition.path:
            yield from self.of.read(partition, self.filters)


class StreamReader(ds.DataSourceStreamReader):
    """A batch's rows are those of the commits since the last; offsets count commits."""

    def __init__(self, options: dict):
        self.of = Files(options)

    def initialOffset(self):
        return {"commits": 0}

    def latestOffset(self):
        return {"commits": len(self.of.commits() or ())}

    def partitions(self, start, end):
        return self.of.splits(self.of.named((self.of.commits() or [])[start["commits"] : end["commits"]]))

    def read(self, partition):
        yield from self.of.read(partition, [])


@dataclass
class Written(ds.WriterCommitMessage):
    files: list


class Writing:
    def __init__(self, options: dict, overwrite: bool = False):
        self.of, self.overwrite, self.name = Files(options), overwrite, options.get("stream", "stream")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """A task's packets (column raw) as a file and its index; a row that isn't a packet fails the task."""
        store, top = opened(self.of.folder)
        store.create_dir(top)
        name, at, starts, file = f"part-{uuid.uuid4().hex}.packets", 0, [], None
        try:
            for batch in iterator:
                for raw in batch.column("raw").to_pylist():
                    if raw is None or len(raw) < AROUND or raw[:4] != MAGIC or HEADER.unpack(raw[:16])[5] + AROUND != len(raw) or zlib.crc32(raw[:-4]) != int.from_bytes(raw[-4:], "big"):
                        raise ValueError("raw isn't a packet")
                    file = file or store.open_output_stream(f"{top}/{name}")
                    if not starts or at // STRIDE > (starts[-1] - 1) // STRIDE:
                        starts.append(at)
                    file.write(raw)
                    at += len(raw)
        finally:
            if file:
                file.close()
        if not at:
            return Written([])
        with store.open_output_stream(f"{top}/{name}.idx") as f:
            f.write(np.array(starts, "<i8").tobytes())
        return Written([(name, at)])

    def put(self, messages, told: str) -> None:
        """The commit that names what was written, once for each ``told``."""
        store, top = opened(self.of.folder)
        there = self.of.commits() or []
        if any(p.endswith(f"-{told}") for p in there):
            return self.drop(messages)
        if self.overwrite:
            for path, _ in self.of.files():
                store.delete_file(path)
            for p in there:
                store.delete_file(p)
        store.create_dir(f"{top}/_commits")
        number = 1 + max((int(p.rsplit("/", 1)[-1].split("-")[0]) for p in there), default=0)
        files = [f for m in messages if m for f in m.files]
        with store.open_output_stream(f"{top}/_commits/_new-{told}") as f:
            f.write(json.dumps({"files": files}).encode())
        store.move(f"{top}/_commits/_new-{told}", f"{top}/_commits/{number:012d}-{told}")

    def drop(self, messages) -> None:
        store, top = opened(self.of.folder)
        for m in messages:
            for name, _ in m.files if m else ():
                for path in (f"{top}/{name}", f"{top}/{name}.idx"):
                    if store.get_file_info(path).type == fs.FileType.File:
                        store.delete_file(path)


class Writer(Writing, ds.DataSourceArrowWriter):
    def commit(self, messages):
        self.put(messages, uuid.uuid4().hex)

    def abort(self, messages):
        self.drop(messages)


class StreamWriter(Writing, ds.DataSourceStreamArrowWriter):
    """Option ``stream`` names the stream: a batch of it is committed once."""

    def commit(self, messages, batchId):
        self.put(messages, f"{self.name}.{batchId}")

    def abort(self, messages, batchId):
        self.drop(messages)


class PacketFiles(ds.DataSource):
    @classmethod
    def name(cls):
        return "packets"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options)

    def streamReader(self, schema):
        return StreamReader(self.options)

    def writer(self, schema, overwrite):
        return Writer(self.options, overwrite)

    def streamWriter(self, schema, overwrite):
        return StreamWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PacketFiles)


def index(path: str) -> None:
    """Write the index of a packet file without damage that this source didn't write."""
    store, top = opened(path)
    size, at, starts = store.get_file_info(top).size, 0, []
    with store.open_input_file(top) as file:
        window = Window(file, size)
        while at < size:
            h = window.header(at)
            if not h:
                raise ValueError(f"no packet at {at}")
            if not starts or at // STRIDE > (starts[-1] - 1) // STRIDE:
                starts.append(at)
            at += h[3] + AROUND
    with store.open_output_stream(f"{top}.idx") as f:
        f.write(np.array(starts, "<i8").tobytes())
