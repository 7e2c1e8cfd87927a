"""Kernels against scalar specifications, goldens and round trips."""

import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions import kernels, wire
from tessera.functions import media_kernels as mk
from tessera.operators import transform


def search_one(cur, prev, bx, by, block, reach, threshold):
    """One block's diamond search, step by step."""
    h, w = cur.shape
    x0, y0 = bx * block, by * block
    own = cur[y0 : y0 + block, x0 : x0 + block].astype(int)

    def sad(dx, dy):
        x, y = x0 + dx, y0 + dy
        if abs(dx) > reach or abs(dy) > reach or x < 0 or y < 0 or x + block > w or y + block > h:
            return None
        return int(np.abs(own - prev[y : y + block, x : x + block].astype(int)).sum())

    at, best = (0, 0), sad(0, 0)
    if best < threshold:
        return bx, by, 0, 0, best
    for phase in ("large", "small"):
        rounds = 0
        while True:
            improved = False
            for sx, sy in kernels.LARGE if phase == "large" else kernels.SMALL:
                value = sad(at[0] + sx, at[1] + sy)
                if value is not None and value < best:
                    at, best, improved = (at[0] + sx, at[1] + sy), value, True
                    if phase == "large" and best < threshold:
                        return bx, by, *at, best
            rounds += 1
            if not improved or (phase == "large" and rounds >= 2 * reach):
                break
    return bx, by, *at, best


@pytest.mark.parametrize("seed", range(6))
def test_diamond_matches_single_blocks(seed):
    rng = np.random.default_rng(seed)
    prev = np.kron(rng.integers(0, 256, (10, 12)), np.ones((5, 5), int)).astype(np.uint8)
    cur = np.roll(prev, (rng.integers(-4, 5), rng.integers(-4, 5)), (0, 1)) if seed % 2 else rng.integers(0, 256, prev.shape).astype(np.uint8)
    got = kernels.diamond(cur, prev, 8, 6, 100)
    want = [search_one(cur, prev, bx, by, 8, 6, 100) for by in range(cur.shape[0] // 8) for bx in range(cur.shape[1] // 8)]
    assert [tuple(r) for r in got.tolist()] == want


def test_static_frame_has_no_motion():
    f = np.full((64, 64), 128, np.uint8)
    assert not kernels.diamond(f, f)[:, 2:4].any()


def test_shifted_square_moves():
    prev = np.zeros((128, 128), np.uint8)
    prev[32:48, 32:48] = 255
    cur = np.roll(prev, (3, 5), (0, 1))
    assert (kernels.diamond(cur, prev)[:, 2:4] != 0).any()


def test_palettes():
    red, blue = bytes([255, 0, 0]), bytes([0, 0, 255])
    assert kernels.kmeans(red * 300) == ([(255, 0, 0)], [1.0])
    colors, weights = kernels.kmeans(red * 75 + blue * 25, 2, 10, 1.0)
    assert colors == [(255, 0, 0), (0, 0, 255)] and weights == [0.75, 0.25]
    assert kernels.kmeans(b"") == ([(0, 0, 0)], [1.0]) and kernels.kmeans(red * 9, 0) == ([(0, 0, 0)], [1.0])
    assert kernels.median_cut(red * 50 + blue * 50, 2) == [(0, 0, 255), (255, 0, 0)]
    assert kernels.median_cut(b"", 4) == [(0, 0, 0)]


def region(x, y, w, h, kind=0, sure=1.0):
    return {"x": x, "y": y, "width": w, "height": h, "roi_type": kind, "priority": 1, "confidence": sure}


def test_merge_is_greedy_and_not_transitive():
    out = kernels.merge_regions([region(0, 0, 20, 20), region(10, 10, 20, 20), region(100, 100, 20, 20)])
    assert [(r["x"], r["y"], r["width"], r["height"]) for r in out] == [(0, 0, 30, 30), (100, 100, 20, 20)]
    touching = kernels.merge_regions([region(0, 0, 16, 16), region(16, 0, 16, 16)])
    assert len(touching) == 2
    chain = kernels.merge_regions([region(0, 0, 30, 30, 1, 0.5), region(25, 0, 20, 20, 2, 0.9), region(44, 0, 10, 10, 3)])
    assert len(chain) == 2 and chain[0]["roi_type"] == 1 and chain[0]["confidence"] == 0.9


def test_dct_basis_and_quality():
    b = kernels.dct_basis(8)
    assert np.allclose(b @ b.T, np.eye(8))
    assert transform.quant_matrix(8, 50)[0] == 16 and transform.quant_matrix(8, 75)[0] == 8 and transform.quant_matrix(4, 50) == [8, 12, 16, 20, 12, 16, 20, 24, 16, 20, 24, 28, 20, 24, 28, 32]


@pytest.mark.parametrize("kind", mk.STEPS)
@settings(max_examples=15, deadline=None)
@given(st.integers(1, 20), st.integers(1, 20), st.integers(0, 2**31))
def test_wavelets_invert(kind, h, w, seed):
    plane = np.random.default_rng(seed).integers(-512, 512, (h, w))
    assert (mk.unwavelet(mk.wavelet(plane, kind), kind) == plane).all()


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 255), max_size=400))
def test_rans_inverts(values):
    s = np.array(values, np.uint8)
    h = np.bincount(s, minlength=256)
    assert (mk.rans_decode(mk.rans_encode(s, h), h, len(s)) == s).all()


def test_video_round_trip_and_bad_data():
    yy, xx = np.mgrid[:16, :16]
    rgb = np.stack([255 * xx / 16, 255 * yy / 16, np.full((16, 16), 128)], -1).astype(np.uint8)
    for kind in mk.STEPS:
        out, w, h = mk.decode_frame(mk.encode_frame(rgb.tobytes(), 16, 16, 75, kind), kind)
        assert (w, h) == (16, 16) and np.abs(np.frombuffer(out, np.uint8).astype(int) - rgb.reshape(-1)).mean() < 50
    assert mk.decode_frame(b"short") is None
    with pytest.raises(ValueError):
        mk.encode_frame(b"12", 16, 16)


def test_voice():
    x = (0.5 * np.sin(2 * math.pi * 200 * np.arange(8000) / 16000)).astype(np.float32)
    p = mk.parametric(x, 16000)
    assert p["voiced"] and abs(p["f0"] - 200) < 10 and len(mk.synthesise(p)) == 8000
    assert wire.unpack_parametric(wire.pack_parametric([p]))[0]["frame_size"] == 8000
    s = mk.spectral(x[:64], 64)
    assert np.abs(mk.unspectral(wire.unpack_spectral(wire.pack_spectral([s]))[0]) - x[:64]).max() < 1e-3


def test_packets():
    d = wire.frame("D", 43, wire.d_table(42, [(0, 0, 5, -3, 100), (1, 0, 2, 1, 50)], [(1, -2)], 12345))
    p = wire.parse(d)
    assert p["ref_sequence"] == 42 and p["vectors"] == [(0, 0, 5, -3, 100), (1, 0, 2, 1, 50)] and p["compact"] == [(1, -2)] and p["timestamp_ms"] == 12345
    assert wire.parse(wire.frame("I", 1, wire.i_table(1920, 1080, 30.0, 2)))["quality"] == 2
    assert wire.parse(wire.frame("S", 1, wire.wire_payload("S", {"command": 1})))["command"] == wire.PING
    bad = bytearray(d)
    bad[20] ^= 255
    for data, why in ((bytes(bad), "checksum"), (d[:19], "incomplete"), (b"", "incomplete")):
        with pytest.raises(wire.WireError, match=why):
            wire.parse(data)
    wrong = b"XXXX" + d[4:-4]
    with pytest.raises(wire.WireError, match="magic"):
        wire.parse(wrong + zlib.crc32(wrong).to_bytes(4, "big"))
    assert zlib.crc32(b"123456789") == 0xCBF43926


def test_payloads_read_by_the_format_runtime():
    pytest.importorskip("flatbuffers")
    from flatbuffers import encode
    from flatbuffers import number_types as n
    from flatbuffers.table import Table

    raw = bytearray(wire.d_table(42, [(7, 8, -1, 2, 9)], [], 99))
    root = Table(raw, encode.Get(n.UOffsetTFlags.packer_type, raw, 0))
    t = Table(raw, root.Indirect(root.Offset(6) + root.Pos))
    assert t.Get(n.Uint32Flags, t.Offset(4) + t.Pos) == 42 and t.VectorLen(t.Offset(6)) == 1 and t.Get(n.Uint64Flags, t.Offset(14) + t.Pos) == 99


@settings(max_examples=20, deadline=None)
@given(st.binary(max_size=40), st.integers(0, 2**32 - 1), st.booleans())
def test_audio_frames(payload, sequence, key):
    f = wire.read_audio_frame(wire.audio_frame(sequence, 5, 1, 16000, 320, key, payload))
    assert f["payload"] == payload and f["sequence"] == sequence and f["keyframe"] == key
