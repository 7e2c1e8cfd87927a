"""Correction formats, parity packets, composition and packet files."""

import itertools
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import codecs, values
from tessera.operators import corrections
from tessera.sources import asp


def plain_runs(data):
    out = b""
    for v, own in itertools.groupby(data):
        n = len(list(own))
        while n:
            out += min(n, 65535).to_bytes(2, "little") + bytes([v])
            n -= min(n, 65535)
    return out


def test_codecs_are_lossless():
    rng = random.Random(2)
    rows = [None, b"", b"a", b"\0" * 200_000, bytes(range(256)) * 3, b"\xff" * 65535, b"\xff" * 65536]
    rows += [bytes(rng.choice(b"\0\1\xff") for _ in range(rng.randrange(50))) * rng.randrange(4) for _ in range(60)]
    column = pa.array(rows, pa.binary())
    for name in values.COMPRESSION_FORMATS.values():
        coded = codecs.ENCODE[name](column)
        assert codecs.DECODE[name](coded).to_pylist() == rows
        assert codecs.DECODE[name](codecs.ENCODE[name](column.slice(2, 3))).to_pylist() == rows[2:5]
        assert codecs.ENCODE[name](column.slice(0, 0)).to_pylist() == []
        if "Rle" in name:
            step = (lambda x: bytes((b - a) & 255 for a, b in zip(b"\0" + x, x))) if name == "DeltaRle" else bytes
            assert coded.to_pylist() == [None if x is None else plain_runs(step(x)) for x in rows]
    broken = pa.array([b"ab", b"\x05\0\0\0zzz", None, b"\x02\0x"], pa.binary())
    assert codecs.unrle(broken).to_pylist() == [None, None, None, b"xx"] and codecs._unpacked(broken, "zstd").to_pylist()[1] is None


def test_corrections(spark):
    df = spark.createDataFrame([(1, b"aaaa" * 9, "Rle"), (2, None, "Zstd"), (3, b"xyz", "Other"), (4, b"", "DeltaRle"), (5, b"abcabc", None)], "id long, data binary, format string").withColumn("coded", F.lit(b"z"))
    back = {r["id"]: r for r in corrections.decode(corrections.encode(df), into="data2").collect()}
    assert [back[k]["data2"] and bytes(back[k]["data2"]) for k in (1, 2, 3, 4, 5)] == [b"aaaa" * 9, None, None, b"", None]
    best = {r["id"]: (r["format"], len(r["coded"])) for r in corrections.smallest(df.where("id in (1, 3)").drop("format", "coded"), ["id"]).collect()}
    assert best == {1: ("Rle", 3), 3: ("Raw", 3)}
    assert corrections.encode(df.limit(0)).count() == 0


def test_parity_of_all_subsets():
    """Any as many packets and parity packets as there were packets restore the rest."""
    data, extra = 5, 3
    shards = corrections._shards([{"slot": s, "raw": bytes([s]) * (s * 3 + 1)} for s in range(data)], data, 20)
    code = corrections._times(corrections._matrix(data, extra), shards)
    for kept in itertools.combinations(range(data + extra), data):
        lost, used = tuple(s for s in range(data) if s not in kept), tuple(k - data for k in kept if k >= data)
        there = shards.copy()
        there[list(lost)] = 0
        left = code[list(used)] ^ corrections._times(corrections._matrix(data, extra)[list(used)], there) if lost else code[:0]
        made = corrections._times(corrections._inverse(data, extra, lost, used[: len(lost)]), left[: len(lost)]) if lost else left
        assert (made == shards[list(lost)]).all()
    product, inverse = corrections._tables()
    assert all(product[x, inverse[x]] == 1 for x in range(1, 256))


def test_restore(spark):
    rng = random.Random(5)
    rows = [(k, s, bytes(rng.randrange(256) for _ in range(rng.randrange(40)))) for k in range(3) for s in range(1, 30) if (k, s) != (1, 4)]
    sent = spark.createDataFrame([*rows, rows[0], (None, 1, b"x"), (0, None, b"x"), (0, 99, None)], "stream_id long, sequence long, raw binary")
    for data, extra in ((4, 2), (1, 1), (10, 6)):
        codes = corrections.parity(sent, data, extra).cache()
        assert codes.count() == extra * len({(k, (s - 1) // data) for k, s, _ in rows})
        gone = {(k, s) for k, s, _ in rows if rng.random() < 0.3}
        left = sent.join(spark.createDataFrame(sorted(gone), "stream_id long, sequence long"), ["stream_id", "sequence"], "left_anti")
        some = codes.where((F.col("part") + F.col("stream_id")) % 3 != 0) if data == 4 else codes
        got = {(r["stream_id"], r["sequence"]): (r["status"], r["raw"] and bytes(r["raw"])) for r in corrections.restore(left, some, data, extra).collect()}
        for k, s, raw in rows:
            part = (s - 1) // data
            lost = len([1 for i, q in gone if i == k and (q - 1) // data == part])
            coded = data != 4 or (part + k) % 3
            if (k, s) not in gone:
                assert got[k, s] == ("received", raw or None) or got[k, s][0] == "received"
            elif coded:
                assert got[k, s] == (("restored", raw or None) if lost <= extra else ("lost", None)) or (got[k, s][0] == "restored" and not raw)
            else:
                assert (k, s) not in got
        assert set(got) <= {(k, s) for k, s, _ in rows}
    with pytest.raises(ValueError):
        corrections.parity(sent, 64, 2)


def test_compose(spark):
    rng = np.random.default_rng(1)
    back, mask = rng.integers(0, 256, (6, 8), np.uint8), rng.integers(0, 2, (6, 8), np.uint8)
    region = rng.integers(0, 256, (3, 4), np.uint8)
    rle = plain_runs(mask.tobytes())
    rows = [(1, 8, 6, back.tobytes(), [2, 1, 4, 3], region.tobytes(), rle), (2, 8, 6, back.tobytes(), [6, 5, 4, 3], region.tobytes(), rle), (3, 8, 6, None, [2, 1, 4, 3], region.tobytes(), rle), (4, 8, 6, back.tobytes(), None, None, None), (5, 8, 5, back.tobytes(), None, None, None), (6, 8, 6, back.tobytes(), [0, 0, 2, 2], region.tobytes(), rle), (7, 8, 6, back.tobytes(), [2, 1, 4, 3], region.tobytes(), rle[:3])]
    df = spark.createDataFrame(rows, "id long, width int, height int, background binary, bbox array<long>, region binary, rle binary")
    got = {r["id"]: r["composed"] for r in corrections.compose(df).collect()}

    def want(under, x0, y0, m):
        out = under.copy()
        for y in range(6):
            for x in range(8):
                if m[y, x] and 0 <= x - x0 < 4 and 0 <= y - y0 < 3:
                    out[y, x] = region[y - y0, x - x0]
        return out.tobytes()

    short = np.zeros(48, np.uint8)
    n = int.from_bytes(rle[:2], "little")
    short[:n] = rle[2]
    assert bytes(got[1]) == want(back, 2, 1, mask) and bytes(got[2]) == want(back, 6, 5, mask) and bytes(got[3]) == want(np.zeros_like(back), 2, 1, mask)
    assert bytes(got[4]) == back.tobytes() and got[5] is None and got[6] is None and bytes(got[7]) == want(back, 2, 1, short.reshape(6, 8))


def packet(kind, sequence, body, flags=0):
    raw = struct.pack(">4sBBHII", b"ASP1", 1, kind, flags, sequence, len(body)) + body
    return raw + zlib.crc32(raw).to_bytes(4, "big")


@pytest.fixture()
def source(spark):
    asp.register(spark)
    return lambda path, **options: spark.read.format("packets").options(**options).load(str(path))


def told(df):
    return sorted((r["offset"], r["status"], r["sequence"], r["payload_len"]) for r in df.collect())


def test_splits_and_damage(spark, source, tmp_path, monkeypatch):
    rng = random.Random(9)
    data, want = b"", []
    for s in range(120):
        raw = packet(1 + s % 4, s, bytes(rng.randrange(256) for _ in range(rng.choice([0, 5, 90]))) + (b"ASP1" if s % 7 == 0 else b""))
        if s % 11 == 3:
            raw = raw[:9] + bytes([raw[9] ^ 1]) + raw[10:]  # the checksum tells
            want.append((len(data), "damaged", None, len(raw)))
        elif s % 17 == 5:
            junk = bytes(rng.randrange(256) for _ in range(30))
            want.append((len(data), "damaged", None, 30))
            data += junk
            want.append((len(data), "ok", s, len(raw) - 20))
        else:
            want.append((len(data), "ok", s, len(raw) - 20))
        data += raw
    data += b"ASP1\1"
    want.append((len(data) - 5, "damaged", None, 5))
    merged = []
    for w in want:  # neighbouring damage is one
        if merged and w[1] == merged[-1][1] == "damaged" and merged[-1][0] + merged[-1][3] == w[0]:
            merged[-1] = (*merged[-1][:3], merged[-1][3] + w[3])
        else:
            merged.append(w)
    (tmp_path / "x").mkdir()
    (tmp_path / "x/one.packets").write_bytes(data)
    (tmp_path / "x/none.packets").write_bytes(b"")
    for step in (1 << 20, 700, 97, 16):
        files = asp.Files({"path": str(tmp_path / "x"), "splitBytes": str(step)})
        for ahead in (1 << 20, 40):
            monkeypatch.setattr(asp, "AHEAD", ahead)
            got = [(r["offset"], r["status"], r["sequence"], r["payload_len"]) for s in files.splits(files.files()) for b in files.read(s, []) for r in b.to_pylist()]
            assert sorted(got) == sorted(merged)
            some = [r["sequence"] for s in files.splits(files.files()) for b in files.read(s, [("packet_type", "EqualTo", 2), ("sequence", "GreaterThan", 30)]) for r in b.to_pylist()]
            assert sorted(some) == [s for _, status, s, _ in merged if status == "ok" and 1 + s % 4 == 2 and s > 30]
    df = source(tmp_path / "x", splitBytes=500)
    assert told(df) == sorted(merged)
    assert told(df.where("packet_type in (1, 2) and sequence <= 50")) == sorted(w for w in merged if w[1] == "ok" and w[2] % 4 < 2 and w[2] <= 50)
    assert df.where("status = 'damaged'").count() == sum(w[1] == "damaged" for w in merged)


def test_round_trip(spark, source, tmp_path):
    """What is written comes back once, also where payloads hold packets; a commit is all or nothing."""
    inner = packet(1, 9999, b"inner")
    rows = [(packet(2, s, inner * (s % 3) + b"x" * 3000),) for s in range(1500)]
    df = spark.createDataFrame(rows, "raw binary").repartition(2)
    out = str(tmp_path / "out")
    df.write.format("packets").mode("append").save(out)
    df.limit(0).write.format("packets").mode("append").save(out)
    for step in (1 << 26, 1 << 20, 1 << 16):
        got = source(out, splitBytes=step)
        assert sorted(r["sequence"] for r in got.collect()) == list(range(1500)) and {bytes(r["raw"]) for r in got.select("raw").collect()} == {r[0] for r in rows}
    with pytest.raises(Exception, match="isn't a packet"):
        spark.createDataFrame([(b"no",)], "raw binary").union(df).coalesce(1).write.format("packets").mode("append").save(out)
    (tmp_path / "out/part-left.packets").write_bytes(packet(1, 7, b""))  # of a task that no commit names
    assert source(out).count() == 1500
    df.limit(10).write.format("packets").mode("append").save(out)
    assert source(out).count() == 1510
    df.limit(5).write.format("packets").mode("overwrite").save(out)
    assert source(out).count() == 5
    name = str(tmp_path / "alone.packets")
    with open(name, "wb") as f:
        f.write(b"".join(r[0] for r in rows))
    asp.index(name)
    assert sorted(r["sequence"] for r in source(name, splitBytes=1 << 20).collect()) == list(range(1500))


def test_streams(spark, source, tmp_path):
    """A stream from one folder to another; a batch that is committed again is there once."""
    here, there = str(tmp_path / "a"), str(tmp_path / "b")
    raws = lambda a, b: spark.createDataFrame([(packet(1, s, b"p" * (s % 9)),) for s in range(a, b)], "raw binary")
    for a in (0, 100):
        raws(a, a + 100).write.format("packets").mode("append").save(here)
        live = spark.readStream.format("packets").load(here).where("status = 'ok'").select("raw")
        q = live.writeStream.format("packets").option("stream", "s").option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start(there)
        q.awaitTermination(200)
        assert q.exception() is None and sorted(r["sequence"] for r in source(there).collect()) == list(range(a + 100))
    w = asp.StreamWriter({"path": there, "stream": "s"})
    again = w.write(iter([pa.RecordBatch.from_pydict({"raw": [packet(1, 5, b"")]})]))
    w.commit([again, None], 0)
    assert source(there).count() == 200
    w.commit([w.write(iter([pa.RecordBatch.from_pydict({"raw": [packet(1, 500, b"")]})]))], 77)
    assert source(there).count() == 201
    w.abort([w.write(iter([pa.RecordBatch.from_pydict({"raw": [packet(1, 501, b"")]})]))], 78)
    assert source(there).count() == 201 and len(list((tmp_path / "b").glob("*.packets"))) == len(asp.Files({"path": there}).files())
