"""WARC archives: writing with deduplicated payloads, reading by boundary-chain verification.

``write`` makes a record per page. Of pages with equal payloads (SHA-1) of at least ``least`` bytes the one with
the largest page_id is a response and the others are revisits of it; all others are responses. A record is a gzip
member of its own, as readers of ``.warc.gz`` expect, so that its offset is where it can be read. Archives are closed
before they pass ``archive_bytes`` (a larger record has one for itself), so a task holds no more than one.

``read`` never trusts a magic on its own. Tasks scan archives and emit a candidate (offset, successor) for every
place that reads as a record, within payloads too. Inside a split of ``split`` bytes each candidate's chain is
followed to its exit, the first offset beyond the split; across splits, pointer jumping from offset 0 doubles
the reach each round. Only candidates on the chain from the file's start are records, and a chain that doesn't reach
its file's end is an error. Plain archives, and those compressed as a whole, are read too (offsets are then those of
the plain stream).

Null html is an empty payload, a null url an empty URI. Rows repeated with the same page_id are records each. A
null page_id is never the one that others refer to unless all are null. Empty tables make archives without records.
Columns other than page_id, url and html are ignored, so their names can't clash.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, bound_batches, map_arrow, materialise, shared_dir, shuffles_released

DATE = "2024-01-01T00:00:00Z"
MAGIC, GZIP = b"WARC/1.1\r\n", b"\x1f\x8b\x08"
ID = "urn:page:"
CRLF = "\r\n"


def roles(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, payload, n, digest, head: the page_id of the response if this row revisits it."""
    src = pages.select(F.col("page_id").cast("long"), "url", F.coalesce(F.col("html"), F.lit("")).alias("payload"))
    src = src.withColumn("n", F.octet_length("payload")).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    heads = src.where(F.col("n") >= least).groupBy(F.col("digest").alias("of")).agg(F.max("page_id").alias("head"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    met = src.join(heads.hint("merge"), F.col("digest") == F.col("of"), "left").drop("of")
    return met.withColumn("head", F.when(~F.col("page_id").eqNullSafe(F.col("head")), F.col("head")))


def record(page_id: int | None, url: str | None, payload: str, digest: str, n: int, head: int | None) -> bytes:
    """The record of a page, a revisit of ``head`` if that is given."""
    kind = "response" if head is None else "revisit"
    refers = "" if head is None else f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: <{ID}{head}>{CRLF}"
    block = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {n}{CRLF * 2}{payload if head is None else ''}".encode()
    uri = re.sub(r"[\r\n]+", " ", url or "")
    top = (
        f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>{CRLF}WARC-Date: {DATE}{CRLF}WARC-Target-URI: {uri}{CRLF}"
        f"WARC-Payload-Digest: sha1:{digest}{CRLF}{refers}Content-Type: application/http; msgtype=response{CRLF}Content-Length: {len(block)}{CRLF * 2}"
    )
    return top.encode() + block + b"\r\n\r\n"


def compressed(data: bytes) -> bytes:
    """A gzip member, the same for the same data."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


EMPTY = compressed(b"")


def write(pages: DataFrame, least: int = 1000, archive_bytes: int = 16 << 20) -> str:
    """Writes the archives into a new folder of the shared folder and returns its path.

    An archive is a row for Spark's text writer, which ends it with the byte 0: this is the last byte of the last
    member's size, or of an empty member after it.
    """
    bound_batches(pages.sparkSession)
    names = ["page_id", "url", "payload", "digest", "n", "head"]

    def archive(members: list[bytes]) -> pa.RecordBatch:
        data = b"".join(members if members[-1][-1] == 0 else [*members, EMPTY])
        return pa.RecordBatch.from_arrays([pa.array([data[:-1]], pa.binary())], names=["value"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch[c] for c in names)):
                member = compressed(record(*(x.as_py() for x in row)))
                if held and size + len(member) > archive_bytes:
                    yield archive(held)
                    held, size = [], 0
                held.append(member)
                size += len(member)
        if held:
            yield archive(held)

    spark, path = pages.sparkSession, f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    made = roles(pages, least).select(*names).mapInArrow(run, "value binary")
    with shuffles_released(spark):
        made.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)
    Tables.wrote(path)
    return path


FIELDS = "offset long, successor long, type string, page_id long, refers_to long, digest string, payload_bytes long, computed string"
NAMES = [x.split()[0] for x in FIELDS.split(", ")]


def parse(data: bytes, at: int) -> tuple | None:
    """FIELDS of the candidate at ``at``, or None if no well-formed record can start there."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    head = {}
    for line in data[at + len(MAGIC) : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            head[name.strip().lower()] = value.strip()
    size = head.get(b"content-length", b"")
    if not size.isdigit():
        return None
    block, stop = end + 4, end + 4 + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        return None
    number = lambda key: int(m[1]) if (m := re.fullmatch(rb"<urn:page:(-?\d+)>", head.get(key, b""))) else None
    kind, body = head.get(b"warc-type", b"").decode("latin-1"), data.find(b"\r\n\r\n", block, stop) + 4
    inner = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", data[block : max(block, body)])
    payload = data[body:stop] if body > 3 and kind == "response" else b""
    digest = head.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha1:")
    n = len(payload) if kind == "response" else int(inner[1]) if inner else 0
    return at, stop + 4, kind, number(b"warc-record-id"), number(b"warc-refers-to"), digest, n, hashlib.sha1(payload).hexdigest() if kind == "response" else None


def inflated(data: bytes, at: int, part: int = 1 << 16) -> tuple[bytes, int] | None:
    """What the gzip member at ``at`` holds and where it ends; None if there is none or it doesn't start as a record."""
    z, out, pos = zlib.decompressobj(31), [], at
    try:
        while not z.eof:
            if pos >= len(data):
                return None
            out.append(z.decompress(data[pos : pos + part]))
            pos += part
            if len(out) == 1 and not (out[0].startswith(MAGIC) or MAGIC.startswith(out[0])):
                return None
    except zlib.error:
        return None
    return b"".join(out), min(pos, len(data)) - len(z.unused_data)


def scan(data: bytes) -> tuple[int, list[tuple]]:
    """Length of the stream that offsets count in, and FIELDS of its candidates in order."""
    found, packed = [], data.startswith(GZIP)
    if packed and (first := inflated(data, 0)) and (made := parse(first[0], 0)) and made[1] < len(first[0]):
        data, packed = gzip.decompress(data), False  # compressed as a whole
    at = data.find(GZIP if packed else MAGIC)
    while at >= 0:
        if not packed:
            made = parse(data, at)
        elif made := inflated(data, at):
            (plain, end), made = made, None
            if plain.startswith(MAGIC) and (made := parse(plain, 0)):
                end += len(EMPTY) * data.startswith(EMPTY, end)
                made = (at, end, *made[2:]) if made[1] == len(plain) else None
        if made:
            found.append(made)
        at = data.find(GZIP if packed else MAGIC, at + 1)
    return len(data), found


def candidates(spark: SparkSession, path: str, split: int = 1 << 20) -> DataFrame:
    """file, its length, split, exit and FIELDS of every candidate."""

    def rows(batch: pa.RecordBatch):
        for name, content in zip(batch["path"], batch["content"]):
            length, found = scan(content.as_py())
            if length and not found:
                raise ValueError(f"{name.as_py()} has no record")
            leave: dict[int, int] = {}
            for f in reversed(found):
                inside = f[1] // split == f[0] // split
                leave[f[0]] = leave.get(f[1], f[1]) if inside else f[1]
            yield {"file": [name.as_py()] * len(found), "length": [length] * len(found), "split": [f[0] // split for f in found], "exit": [leave[f[0]] for f in found]} | {x: [f[k] for f in found] for k, x in enumerate(NAMES)}

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return map_arrow(files, f"file string, length long, split long, exit long, {FIELDS}", rows)


def read(spark: SparkSession, path: str, split: int = 1 << 20) -> DataFrame:
    """file and FIELDS of every record on the chain from its file's start; fails if a chain does not reach its file's end."""
    found = materialise(candidates(spark, path, split), "warc-candidates")
    jump = found.select("file", F.col("offset").alias("at"), F.col("exit").alias("to"))
    reach = jump.where("at = 0").select("file", "at")
    known = -1
    for _ in range(64):
        now = reach.count()
        if now == known:
            break
        known = now
        reach = materialise(reach.union(reach.join(jump.hint("merge"), ["file", "at"]).select("file", F.col("to").alias("at"))).distinct(), "warc-reach")
        jump = materialise(jump.join(jump.select("file", F.col("at").alias("to"), F.col("to").alias("far")).hint("merge"), ["file", "to"]).select("file", "at", F.col("far").alias("to")), "warc-jump")
    ends = found.select("file", F.col("length").alias("at")).distinct()
    if broken := ends.join(reach.hint("merge"), ["file", "at"], "left_anti").first():
        raise ValueError(f"{broken['file']} has no chain of records to its end")
    entry = reach.groupBy("file", F.expr(f"at div {split}").alias("split")).agg(F.min("at").alias("entry"))
    lists = found.groupBy("file", "split").agg(F.collect_list(F.struct(*NAMES)).alias("all")).join(entry.hint("merge"), ["file", "split"]).select("file", "entry", "all")

    def walk(batch: pa.RecordBatch):
        for name, entry, own in zip(batch["file"], batch["entry"], batch["all"]):
            kept, at = [], entry.as_py()
            there = {r["offset"]: r for r in own.as_py()}
            while r := there.get(at):
                kept.append(r)
                at = r["successor"]
            yield {"file": [name.as_py()] * len(kept)} | {c: [r[c] for r in kept] for c in NAMES}

    return map_arrow(lists, f"file string, {FIELDS}", walk)


def page_records(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, digest_ok of every record read."""
    return records.select("page_id", "payload_bytes", F.coalesce("computed", "digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to", (F.coalesce("computed", "digest") == F.col("digest")).alias("digest_ok"))
