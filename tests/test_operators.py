"""Operators on small inputs: masks, sparse blocks, sealed packets, SQL functions."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar, sqlfuncs, wire
from tessera.operators import blocks, bridges, framing, masks, stream, transform


def test_rle_golden_and_split(spark):
    bits = spark.range(40).select(F.lit(1).alias("frame_id"), F.col("id").alias("pos"), ((F.col("id") >= 10) & (F.col("id") < 30)).cast("long").alias("bit"))
    rle = masks.encode(masks.runs(bits)).first()["rle"]
    assert bytes(rle).hex() == "0a00001400010a0000"
    long_run = spark.range(70_000).select(F.lit(1).alias("frame_id"), F.col("id").alias("pos"), F.lit(3).cast("long").alias("bit"))
    got = [(r["start"], r["value"], r["length"]) for r in masks.runs(long_run).orderBy("start").collect()]
    assert got == [(0, 1, 65535), (65535, 1, 4465)]


def test_rle_decode_is_verbatim_and_tolerant(spark):
    df = spark.createDataFrame([(bytes.fromhex("020005010000ff"), 6), (b"", 3), (bytes.fromhex("090001"), 4)], "rle binary, n int")
    assert [r[0] for r in df.select(masks.decode(F.col("rle"), F.col("n"))).collect()] == [[5, 5, 0, 0, 0, 0], [0, 0, 0], [1, 1, 1, 1]]


def test_sparse(spark):
    df = spark.createDataFrame([([100, 0, 0, 0, 50, 0, 0, 0, -1],)], "c array<int>")
    s = df.select(transform.sparse_encode(F.col("c"), 3, 0.0).alias("a"), transform.sparse_encode(F.col("c"), 3).alias("b")).first()
    assert [tuple(x) for x in s["a"]] == [(0, 0, 100.0), (1, 1, 50.0), (2, 2, -1.0)] and len(s["b"]) == 2
    back = df.select(transform.sparse_decode(transform.sparse_encode(F.col("c"), 3), 3, 7).alias("d")).first()["d"]
    assert back == [100, 7, 7, 7, 50, 7, 7, 7, 7]


def test_quantize_rounds_half_away(spark):
    df = spark.createDataFrame([([v] + [0.0] * 63,) for v in (40.0, -40.0, 39.9)], "c array<double>")
    assert [r[0][0] for r in df.select(transform.quantize(F.col("c"))).collect()] == [3, -3, 2]


def test_sparse_decode_takes_the_last_of_equals(spark):
    df = spark.createDataFrame([([(1, 0, 5.0), (9, 0, 3.0), (1, 0, 7.0), (0, 2, -2.0)],)], "s array<struct<u: int, v: int, value: float>>")
    assert df.select(transform.sparse_decode(F.col("s"), 3).alias("d")).first()["d"] == [0, 7, 0, 0, 0, 0, -2, 0, 0]


def test_transforms_skip_what_is_no_block(spark):
    df = spark.createDataFrame([(1, [1.0] * 64), (2, None), (3, [1.0] * 5), (4, [2.0] * 64)], "block long, samples array<double>").coalesce(1)
    out = {r["block"]: r["coeffs"] for r in transform.forward(df).collect()}
    assert out[2] is None and out[3] is None and abs(out[1][0] - 8) < 1e-9 and abs(out[4][0] - 16) < 1e-9 and len(out[4]) == 64
    assert transform.forward(df.limit(0)).count() == 0


def test_block_operators_by_pixels(spark):
    """Strengths, regions and motion of frames whose sides aren't whole blocks, pixel by pixel."""
    rng = np.random.default_rng(9)
    px = np.repeat(np.repeat(rng.integers(0, 256, (3, 5, 7)), 9, 1), 8, 2)[:, :43, :53].astype(np.uint8)
    h, w, size = 43, 53, 16
    df = spark.createDataFrame([(k, w, h, px[k].tobytes()) for k in range(3)] + [(7, w, h, px[0].tobytes()), (8, 5, 5, b"x"), (9, None, None, None)], "frame_id long, width int, height int, data binary")
    v = lambda k, y, x: int(px[k][y][x])
    cells = [(by, bx) for by in range(h // size) for bx in range(w // size)]
    inside = lambda by, bx, m: [(y, x) for y in range(by * size + m, (by + 1) * size - m) for x in range(bx * size + m, (bx + 1) * size - m)]
    want = {(k, bx, by): max(v(k, y, x) for y, x in inside(by, bx, 0)) - min(v(k, y, x) for y, x in inside(by, bx, 0)) for k in range(3) for by, bx in cells}
    got = {(r["frame_id"], r["bx"], r["by"]): r["strength"] for r in blocks.contrast(df, size).collect() if r["frame_id"] < 3}
    assert got == want
    edges = {(k, bx, by): sum(abs(v(k, y, x + 1) - v(k, y, x - 1)) + abs(v(k, y + 1, x) - v(k, y - 1, x)) for y, x in inside(by, bx, 1)) // 196 for k in range(3) for by, bx in cells}
    assert {(r["frame_id"], r["bx"], r["by"]): r["strength"] for r in blocks.edge_strength(df, size).collect() if r["frame_id"] < 3} == edges
    moved = {(k, bx, by): sum(abs(v(k, y, x) - v(k - 1, y, x)) for y, x in inside(by, bx, 0)) // 256 for k in (1, 2) for by, bx in cells}
    assert {(r["frame_id"], r["bx"], r["by"]): r["strength"] for r in blocks.motion_magnitude(blocks.pairs(df), size).collect()} == moved

    def regions(k, *maps):
        out = [{"x": bx * 16, "y": by * 16, "width": 16, "height": 16, "roi_type": t, "priority": 1, "confidence": min(m[k, bx, by], 255) / 255} for m, above, t in maps for by, bx in cells if m.get((k, bx, by), -1) > above]
        merged, todo = [], sorted(out, key=lambda r: -r["width"] * r["height"])
        while todo:
            a, rest = dict(todo[0]), []
            for r in todo[1:]:
                s = todo[0]
                if s["x"] < r["x"] + r["width"] and r["x"] < s["x"] + s["width"] and s["y"] < r["y"] + r["height"] and r["y"] < s["y"] + s["height"]:
                    x1, y1 = max(a["x"] + a["width"], r["x"] + r["width"]), max(a["y"] + a["height"], r["y"] + r["height"])
                    a["x"], a["y"] = min(a["x"], r["x"]), min(a["y"], r["y"])
                    a["width"], a["height"], a["confidence"] = x1 - a["x"], y1 - a["y"], max(a["confidence"], r["confidence"])
                else:
                    rest.append(r)
            merged.append(a)
            todo = rest
        return sorted(tuple(a.values()) for a in merged)

    by_frame = lambda out, k: sorted((r["x"], r["y"], r["width"], r["height"], r["roi_type"], r["priority"], r["confidence"]) for r in out if r["frame_id"] == k)
    first, second = blocks.detect(df).collect(), blocks.detect_with_motion(blocks.pairs(df, "left")).collect()
    for k in range(3):
        assert by_frame(first, k) == regions(k, (edges, 30, 3), (want, 50, 2))
    assert by_frame(second, 0) == by_frame(first, 0) == by_frame(second, 7) and {r["roi_type"] for r in second} >= {2, 3} and 4 in {r["roi_type"] for r in second} | {4}


def test_rect_edges(spark):
    r = scalar.rect(F.lit(10), F.lit(10), F.lit(100), F.lit(100))
    row = spark.range(1).select(scalar.area(r).alias("area"), *[scalar.contains(r, F.lit(x), F.lit(y)).alias(f"c{x}") for x, y in ((50, 50), (5, 5), (110, 10))], scalar.intersects(scalar.rect(*map(F.lit, (0, 0, 16, 16))), scalar.rect(*map(F.lit, (16, 0, 16, 16)))).alias("touch")).first()
    assert row["area"] == 10000 and row["c50"] and not row["c5"] and not row["c110"] and not row["touch"]


def test_header_golden(spark):
    h = spark.range(1).select(F.hex(framing.header(F.lit(1), F.lit(42), F.lit(1024)))).first()[0]
    assert h == "4153503101010000" + "0000002A" + "00000400"


def test_savings(spark):
    row = spark.range(1).select(scalar.savings_percent(F.lit(55800), F.lit(500000)).alias("p"), scalar.savings_ratio(F.lit(55800), F.lit(500000)).alias("r"), scalar.savings_percent(F.lit(1), F.lit(0)).alias("z"), scalar.savings_ratio(F.lit(1), F.lit(0)).alias("o")).first()
    assert row["p"] == pytest.approx(88.84) and row["r"] == pytest.approx(8.9606, abs=1e-4) and row["z"] == 0 and row["o"] == 1
    e = spark.range(1).select(scalar.estimate_bytes(F.lit(1920), F.lit(1080), F.lit(0.2), F.lit(5000), F.lit(1.0)).alias("e")).first()["e"]
    assert e["traditional"] == 259200 and e["hybrid"] == 65134


def test_seal_needs_key_and_sequence(spark):
    df = spark.createDataFrame([(1, 5, b"abc")], "stream_id long, sequence long, raw binary")
    key = bridges.derive_key(F.col("stream_id"), F.lit("s").cast("binary"))
    sealed = bridges.seal(df, key)
    assert bytes(bridges.open_sealed(sealed, key).first()["raw"]) == b"abc"
    assert bridges.open_sealed(sealed.withColumn("sequence", F.lit(6)), key).first()["raw"] is None


def test_empty_motion_stats(spark):
    none = spark.createDataFrame([], "stream_id long, dx long, dy long")
    assert stream.motion_stats(none).count() == 0
    some = spark.createDataFrame([(1, 3, 4), (1, 6, 8)], "stream_id long, dx long, dy long")
    assert tuple(stream.motion_stats(some).first())[1:] == (7.5, 10.0)


def transform_quantized(spark):
    c = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda x: 30.0 - 5 * x)
    return spark.range(1).select(transform.quantize(c, 4, 75)).first()[0]


def test_sql_functions(spark):
    from tessera import __version__
    from tessera.functions import kernels

    sqlfuncs.register(spark)
    one = lambda q: spark.sql(f"SELECT {q}").first()[0]
    raw = wire.frame("S", 9, wire.s_table(7, 1)).hex()
    assert spark.sql(f"select packet_status(unhex('{raw}')), packet_status(unhex('00')), packet_status(null)").first()[:] == ("ok", "incomplete", None)
    assert [tuple(r) for r in spark.sql("select * from rle_runs(unhex('0a00001400010a0000'))").collect()] == [(0, 10, 0), (10, 20, 1), (30, 10, 0)]
    assert spark.sql(f"select kind, sequence from decode_packet(unhex('{raw}'))").first()[:] == ("S", 9)
    assert one("parse_packet(create_i_packet(3L, 64L, 48L, float(30), 5L)).width") == 64 and one("parse_packet(create_pong(3L, 5L)).command") == 8 and one("parse_packet(create_ping(3L, 5L)).timestamp_ms") == 5
    d = one("parse_packet(create_d_packet(4L, 3L, array(named_struct('block_x', 1, 'block_y', 2, 'dx', -3, 'dy', 4, 'sad', 5L)), 6L))")
    assert d["ref_sequence"] == 3 and tuple(d["vectors"][0]) == (1, 2, -3, 4, 5)
    assert one("aggregate(idct_2d(dct_2d(transform(sequence(0, 63), x -> double(x)))), 0D, (s, x) -> s + abs(x))") == pytest.approx(2016) and one("dct_2d(array(1D))") is None
    assert one("size(encode_sparse_dct(transform(sequence(0, 63), x -> if(x in (3, 9), 50 - x, 1)), 0.001D))") == 2
    assert one("decode_sparse_dct(array(named_struct('u', 1, 'v', 0, 'value', float(5)), named_struct('u', 1, 'v', 0, 'value', float(7))))")[:3] == [0, 7, 0]
    assert tuple(one("estimate_hybrid_savings(1920, 1080, 0.2D, 5000, 1.0D)")) == (259200, 65134)
    assert one("rle_decode_mask(rle_encode_mask(unhex('00000101010100')), 9)") == [0, 0, 1, 1, 1, 1, 0, 0, 0] and one("hex(rle_encode_mask(unhex('')))") == "" and one("rle_decode_mask(unhex(''), 2)") == [0, 0]
    rgb = "unhex(repeat('FF0000', 75) || repeat('0000FF', 25))"
    assert [tuple(c) for c in one(f"median_cut({rgb}, 2)")] == [(127, 0, 127), (255, 0, 0)] and tuple(one(f"extract_colors({rgb}, 2)")[0]) == (255, 0, 0) and one(f"extract_color_weights({rgb}, 2)")[0] > 0.5 and len(one(f"dominant_colors({rgb})")) <= 5
    rng = np.random.default_rng(3)
    prev = rng.integers(0, 256, (48, 48)).astype(np.uint8)
    cur = np.roll(prev, (1, 2), (0, 1))
    got = one(f"estimate_motion(unhex('{cur.tobytes().hex()}'), unhex('{prev.tobytes().hex()}'), 48, 48)")
    assert [tuple(r) for r in got] == [tuple(r) for r in kernels.diamond(cur, prev).tolist() if r[2] or r[3]]
    got = one(f"estimate_motion(unhex('{cur.tobytes().hex()}'), unhex('{prev.tobytes().hex()}'), 48, 48, 8, 4, 0, true)")
    assert [tuple(r) for r in got] == [tuple(r) for r in kernels.diamond(cur, prev, 8, 4, 0).tolist()] and len(got) == 36
    assert one("aggregate(idct_2d(dct_2d(transform(sequence(0, 15), x -> double(x)), 4), 4), 0D, (s, x) -> s + abs(x))") == pytest.approx(120) and one("dct_2d(transform(sequence(0, 15), x -> double(x)), 5)") is None
    sides = spark.sql("select n, dct_2d(transform(sequence(1, n * n), x -> double(x)), n) as c from values (2), (8), (4), (2) as t(n)").collect()
    assert all(len(r["c"]) == r["n"] ** 2 and r["c"][0] == pytest.approx(sum(range(1, r["n"] ** 2 + 1)) / r["n"]) for r in sides)
    assert one("quantize_dct(transform(sequence(0, 15), x -> 30D - 5 * x), 4, 75)") == transform_quantized(spark) and one("dequantize_dct(quantize_dct(transform(sequence(0, 63), x -> double(0)), 8, 10), 8, 10)") == [0.0] * 64 and one("quantize_dct(array(1D))") is None
    assert one("hex(compress_correction(unhex('0505050505'), 'Rle'))") == "050005" and one("hex(decompress_correction(compress_correction(unhex('0102'), 'Zstd'), 'Zstd'))") == "0102" and one("compress_correction(unhex('01'), 'None')") is None
    assert one(f"size(detect_roi(unhex('{cur.tobytes().hex()}'), 48, 48))") > 0 and one("detect_roi(unhex('00'), 48, 48)") is None
    back = one(f"decode_video_frame(encode_video_frame({rgb}, 10, 10, 90))")
    assert (back["width"], back["height"], len(back["rgb"])) == (10, 10, 300) and one("decode_video_frame(unhex('00'))") is None
    assert len(one("decode_voice(encode_voice(transform(sequence(1, 320), x -> float(sin(x / 9D))), 16000))")) == 320 and one("decode_voice(unhex('00'))") is None
    assert one("vector_magnitude(3, 4)") == 5 and one("rects_intersect(0, 0, 16, 16, 16, 0, 16, 16)") is False and one("frame_luminance(255, 255, 255)") == pytest.approx(255) and one("engine_version()") == __version__


def test_packet_files(spark, tmp_path):
    from tessera.sources import tables

    df = spark.createDataFrame([(1, 2, b"x"), (1, 1, b"y")], "stream_id long, sequence long, raw binary")
    tables.write_packets(df, str(tmp_path / "p"))
    assert [r["sequence"] for r in tables.read_packets(spark, str(tmp_path / "p")).collect()] == [1, 2]


def test_overlaps_of_all_sizes(spark):
    """From a pixel to a billion, one of them over all others; a large rectangle is four rows, not a row a cell."""
    rng = np.random.default_rng(8)
    sizes = [1, 5, 63, 64, 65, 300, 5000, 10**6, 10**9]
    rows = [(int(rng.integers(0, 2)), k, (int(rng.integers(0, 4000)), int(rng.integers(0, 4000)), int(rng.choice(sizes)), int(rng.choice(sizes)))) for k in range(90)]
    rows += [(0, 100, (0, 0, 2 * 10**9, 2 * 10**9)), (0, 101, (5, 5, 0, 9)), (0, 102, None), (1, 103, (0, 0, 3, 10**9))]
    df = spark.createDataFrame(rows, "key long, id long, r struct<x: long, y: long, width: long, height: long>")
    meets = lambda a, b: a[0] < b[0] + b[2] and b[0] < a[0] + a[2] and a[1] < b[1] + b[3] and b[1] < a[1] + a[3]
    want = sorted((k, i, j) for k, i, a in rows for q, j, b in rows if k == q and i < j and a and b and min(a[2:] + b[2:]) > 0 and meets(a, b))
    got = sorted(tuple(x) for x in blocks.overlaps(df).collect())
    assert got == want and len(want) > 200
    assert blocks.overlaps(df.limit(0)).count() == 0


def test_overlaps_are_all_pairs(spark):
    rng = random.Random(2)
    rows = [(i % 2, i, rng.randrange(-100, 400), rng.randrange(0, 400), rng.randrange(1, 150), rng.randrange(1, 90)) for i in range(160)]
    r = spark.createDataFrame(rows, "key long, id long, x long, y long, w long, h long").select("key", "id", scalar.rect(*[F.col(c) for c in "xywh"]).alias("r"))
    meet = lambda a, b: a[0] == b[0] and a[2] < b[2] + b[4] and b[2] < a[2] + a[4] and a[3] < b[3] + b[5] and b[3] < a[3] + a[5]
    want = sorted((a[0], a[1], b[1]) for a, b in itertools.combinations(rows, 2) if meet(a, b))
    got = sorted(tuple(x) for x in blocks.overlaps(r).collect())
    assert got == want and max(x[2] for x in got) > 40


def test_full_search_over_the_whole_range(spark):
    """Two frames with motion far beyond one pixel, against brute force."""
    px = np.random.default_rng(4).integers(0, 256, (2, 48, 48))
    px[1, 16:32, 16:32] = px[0, 5:21, 30:46]
    rows = [(f, x, y, int(px[f, y, x])) for f in range(2) for y in range(48) for x in range(48)]
    want = []
    for by, bx in itertools.product(range(3), range(3)):
        y, x = by * 16, bx * 16
        all_ = [(int(abs(px[1, y : y + 16, x : x + 16] - px[0, y + dy : y + dy + 16, x + dx : x + dx + 16]).sum()), (dx, dy) != (0, 0), dy, dx) for dy in range(-16, 17) for dx in range(-16, 17) if 0 <= y + dy <= 32 and 0 <= x + dx <= 32]
        sad, _, dy, dx = min(all_)
        want.append((1, bx, by, dx, dy, sad))
    frames = blocks.pairs(blocks.frame_rows(spark.createDataFrame(rows, "frame_id long, x long, y long, v long")))
    assert sorted(tuple(r) for r in blocks.full_search(frames, 16, 16).collect()) == sorted(want)
    assert (1, 1, 1, 14, -11, 0) in want


def test_payloads_of_batches_are_those_of_single_ones(spark):
    """Whole batches against the scalar writer and reader, with nulls, wrapped values, damage and cut tables."""
    rng = random.Random(5)
    rows = []
    for i in range(400):
        kind = rng.choice("IDCS")
        vec = [(rng.randrange(70_000), rng.randrange(9), rng.randrange(-300, 300), -5, rng.randrange(1 << 33)) for _ in range(rng.randrange(5))]
        small = [(rng.randrange(-128, 128), 3) for _ in range(rng.randrange(4))]
        one = lambda v: None if rng.random() < 0.1 else v
        rows.append((i, kind, i * 7, None if kind == "C" else (one(640), one(480), 29.97, one(i % 4), one(1 << 40), one(i), one(vec), one(small), one(i % 9))))
    df = spark.createDataFrame(rows, f"stream_id long, kind string, sequence long, payload {framing.PAYLOAD}")
    for keep in (False, True):
        got = {r["stream_id"]: bytes(r["raw"]) for r in framing.encode_packets(df, keep).collect()}
        for i, kind, n, p in rows:
            w, h, fps, quality, ts, ref, vec, small, command = p or (0, 0, 0, None, 0, 0, None, None, None)
            vec = [(a & 65535, b, c, d, e & (1 << 32) - 1) for a, b, c, d, e in vec or ()]
            table = {"I": lambda: wire.i_table(w or 0, h or 0, fps, (1 if quality is None else quality) if keep else 1, ts or 0), "D": lambda: wire.d_table(ref or 0, vec, small or (), ts or 0)}.get(kind, lambda: wire.wire_payload(kind, {"command": command or 7, "timestamp_ms": ts}))()  # noqa: B023
            assert got[i] == wire.frame(kind, n, table)
    raws = [got[i] for i in range(400)]
    for k in range(1200):  # damage with a right checksum
        raw = bytearray(raws[k % 400][:-4])
        for _ in range(rng.randrange(1, 4)):
            raw[rng.randrange(16 if rng.random() < 0.9 else 4, len(raw))] = rng.choice((0, 1, 4, 127, 255, rng.randrange(256)))
        raw = bytes(raw[: len(raw) if rng.random() < 0.7 else rng.randrange(16, len(raw))])
        raws.append(raw + zlib.crc32(raw).to_bytes(4, "big") if rng.random() < 0.95 else raw)
    raws += [b"", None, b"x" * 19]
    out = framing.decode_packets(spark.createDataFrame(list(enumerate(raws)), "i long, raw binary").repartition(3)).collect()
    good = bad = 0
    for r in out:
        try:
            want = wire.parse(raws[r["i"]] or b"")
        except (wire.WireError, ValueError, OverflowError) as e:
            assert r["status"] != "ok" and (r["status"] == str(e) or {r["status"], str(e)} <= {"malformed", "no payload", "vector beyond the data", "payload type", "incomplete"} and r["payload"] is None and r["kind"] is None), (r, e)
            bad += 1
            continue
        if r["status"] != "ok":
            assert r["status"] in ("malformed", "no payload", "vector beyond the data"), r  # offsets before the table's bytes are refused
            continue
        good += 1
        assert (r["kind"], r["sequence"], r["payload_len"]) == (want["kind"], want["sequence"], want["payload_len"])
        p = r["payload"]
        for name in ("width", "height", "quality", "ref_sequence", "command"):
            assert p[name] == want.get(name), (name, r, want)
        assert p["timestamp_ms"] == (None if "timestamp_ms" not in want else want["timestamp_ms"] if want["timestamp_ms"] < 1 << 63 else want["timestamp_ms"] - (1 << 64))
        assert (p["vectors"] is None) == ("vectors" not in want) and [tuple(v) for v in p["vectors"] or ()] == want.get("vectors", []) and [tuple(v) for v in p["compact"] or ()] == want.get("compact", [])
    assert good > 700 and bad > 200 and len(out) == len(raws)


def test_readers_of_payloads(spark):
    bodies = [("I", wire.i_table(4, 5, 1.0, 3, 9)), ("D", wire.d_table(1, [(1, 2, 3, 4, 5)], [(6, 7)])), ("S", wire.s_table(8, 2)), ("short", b"1234567"), ("none", wire.i_table(1, 1, 1.0)[:20])]
    df = spark.createDataFrame(bodies, "name string, body binary")
    any_kind = {r["name"]: (r["status"], r["kind"]) for r in framing.read_payloads(df).collect()}
    assert any_kind["I"] == ("ok", "I") and any_kind["D"] == ("ok", "D") and any_kind["S"] == ("ok", "S") and any_kind["short"] == ("incomplete", None) and any_kind["none"][0] != "ok"
    for kind in "IDS":
        got = {r["name"]: r["status"] for r in framing.read_payloads(df, expected=kind).collect()}
        assert got[kind] == "ok" and all(got[k] == "payload type" for k in "IDS" if k != kind)
    assert framing.read_payloads(df.limit(0)).count() == 0
    need = spark.range(1).select(framing.fits(F.lit(b"12345"), F.lit(5)).alias("a"), framing.fits(F.lit(b"12345"), F.lit(4)).alias("b")).first()
    assert need[:] == ("ok", "buffer too small: need 5, got 4")


def test_records(spark):
    from tessera.functions import records

    bounds = scalar.rect(*map(F.lit, (0, 0, 8, 8)))
    i = records.add_region(records.with_palette(records.with_quality(records.i_payload(F.lit(64), F.lit(48), F.lit(30.0)), 3), records.palette(F.array(records.color(F.lit(1), F.lit(2), F.lit(3))))), records.solid(bounds, records.color(F.lit(9), F.lit(9), F.lit(9))))
    d = records.add_region_delta(records.d_payload(F.lit(1)), records.region_delta(F.lit(0), palette_delta=records.palette(F.array(records.color(F.lit(7), F.lit(7), F.lit(7))))))
    c = records.add_correction(records.c_payload(F.lit(1), F.array(F.struct(F.lit(b"abc").alias("data")))), F.struct(F.lit(b"de").alias("data")))
    small = scalar.to_compact(F.lit(5), F.lit(-7))
    row = spark.range(1).select(i.alias("i"), d.alias("d"), c.alias("c"), records.correction_bytes(c).alias("n"), records.expand(small, F.lit(1), F.lit(2), F.lit(3)).alias("e"), records.compact().alias("z")).first()
    assert row["i"]["quality"] == 3 and row["i"]["global_palette"]["colors"][0]["b"] == 3 and len(row["i"]["regions"]) == 1 and row["i"]["regions"][0]["bounds"]["width"] == 8
    assert row["d"]["region_deltas"][0]["region_index"] == 0 and row["d"]["region_deltas"][0]["dct_delta"] is None
    assert row["c"]["correction_count"] == 2 and row["n"] == 5 and tuple(row["e"]) == (1, 2, 5, -7, 3) and tuple(row["z"]) == (0, 0)


def test_hundredths_round_as_printf(spark):
    """The exact value decides, ties to even: reports agree with SQL's printf."""
    rng = random.Random(3)
    values = [0.125, 0.375, 8.125, 1.005, 2.675, 0.005, 0.015, 0.995, 99.995, 99.99999, -0.125, -0.001, -7.625, 0.0, 1e-9, 0.0039, 1e15 / 3, 123456789.125, 2.0**53]
    values += [rng.uniform(-300, 300) for _ in range(300)] + [rng.randrange(-4000, 4000) / 8 for _ in range(300)] + [rng.randrange(100_000) / 1000 for _ in range(300)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", scalar.hundredths(F.col("v")).alias("t")).collect()
    assert [r["t"] for r in got] == ["%.2f" % r["v"] for r in got]
    told = spark.sql("SELECT 1L stream_id, 70L frame_count, 626688L hybrid_bytes, 0L scene_bytes, 0L delta_bytes, 0L mask_bytes, 0L video_bytes, 0L audio_bytes, 5091840L traditional_bytes, 87.6923076923077D saved_percent, 8.125D saved_ratio")
    assert stream.report(told).first()["report"].endswith("saved 87.69 %, ratio 8.12")


class Caught:
    """Takes the place of a frame: what is mapped over its batches is told instead of run."""

    schema = ()

    def select(self, *_):
        return self

    def mapInArrow(self, rows, _):
        return rows


def test_voice_kernels_take_few_rows(monkeypatch):
    import pyarrow as pa

    from tessera.functions import media_kernels
    from tessera.operators import media

    most = []
    for name in ("parametric_rows", "synthesise_rows"):
        def count(x, *more, kernel=getattr(media_kernels, name)):
            most.append(len(x))
            return kernel(x, *more)

        monkeypatch.setattr(media_kernels, name, count)
    n = 2500
    samples = pa.array(np.random.default_rng(2).normal(0, 0.1, (n, 64)).astype(np.float32).tolist(), pa.list_(pa.float32()))
    batch = pa.RecordBatch.from_arrays([pa.array([1] * n), pa.array(range(n)), pa.array(range(n)), samples], names=["stream_id", "sequence", "timestamp_ms", "samples"])
    coded = list(media.encode_voice(Caught())([batch]))
    back = list(media.decode_voice(Caught())(coded))
    assert max(most) <= 1000 and [q for b in back for q in b["sequence"].to_pylist()] == list(range(n))


def test_packet_kernels_take_slices_and_keep_few_templates():
    import pyarrow as pa

    from tessera.functions import wire_arrow

    sizes = [2000 + k for k in range(150)]
    item = pa.struct([(c, pa.int64()) for c in ("block_x", "block_y", "dx", "dy", "sad")])
    vectors = pa.array([[{c: k % 100 for c in ("block_x", "block_y", "dx", "dy", "sad")}] * k for k in sizes], pa.list_(item))
    fields = {"ref_sequence": pa.array(range(150)), "vectors": vectors, "compact": pa.nulls(150, pa.list_(pa.struct([("dx", pa.int32()), ("dy", pa.int32())])))}
    fields |= {k: pa.nulls(150, t) for k, t in (("width", pa.int64()), ("height", pa.int64()), ("fps", pa.float32()), ("quality", pa.int32()), ("timestamp_ms", pa.int64()), ("command", pa.int32()))}
    batch = pa.RecordBatch.from_arrays([pa.array(["D"] * 150), pa.array(range(150)), pa.StructArray.from_arrays(fields.values(), fields)], names=["kind", "sequence", "payload"])
    parts, encoder, raw = list(wire_arrow.slices(batch)), wire_arrow.Encoder(), []
    assert len(parts) > 1 and all(p.num_rows == 1 or p.nbytes <= wire_arrow.SLICE_BYTES for p in parts)
    for p in parts:
        raw += encoder(p["kind"].to_numpy(zero_copy_only=False), p["sequence"], p["payload"]).to_pylist()
        assert sum(len(t) for t, _ in encoder.templates.values()) <= wire_arrow.TEMPLATE_BYTES
    assert raw == wire_arrow.Encoder()(np.array(["D"] * 150, object), batch["sequence"], batch["payload"]).to_pylist()


def test_compact_packets_of_a_long_stream(spark, tmp_path):
    """A stream of 9,000 events beside a short one: no packet holds more than 4096 vectors, and sums are those of SQL."""
    from tessera.plans.queries import QUERIES, SQL, compact_packets

    from .compare import connect, rows

    made = spark.range(9010).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "if(id < 9000, 1L, 2L) AS user_id", "'view' AS event_type", "id % 977 / 4D AS value", "'' AS props")
    made.toPandas().to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    d = str(tmp_path)
    assert max(r["n"] for r in compact_packets(spark, d).select(F.greatest(F.size("payload.vectors"), F.size("payload.compact")).alias("n")).collect()) <= 4096
    assert rows(QUERIES["s14_compact_vectors"](spark, d).toPandas()) == rows(connect(d).execute(SQL["s14_compact_vectors"]).fetchdf())
