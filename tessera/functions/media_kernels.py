"""Media kernels from the literature: YCoCg-R (Malvar and Sullivan), lifting wavelets (Daubechies and Sweldens; Le Gall 5/3),
rANS (Duda), linear prediction (Levinson and Durbin). Streams are our own: no other codec's bits are claimed."""

from __future__ import annotations

import struct

import numpy as np

# --- colour ---------------------------------------------------------------------------------------------------


def to_ycocg(rgb: np.ndarray) -> list[np.ndarray]:
    r, g, b = (rgb[..., c].astype(np.int32) for c in range(3))
    co = r - b
    t = b + (co >> 1)
    cg = g - t
    return [t + (cg >> 1), co, cg]


def from_ycocg(y: np.ndarray, co: np.ndarray, cg: np.ndarray) -> np.ndarray:
    t = y - (cg >> 1)
    g = cg + t
    b = t - (co >> 1)
    return np.clip(np.stack([b + co, g, b], -1), 0, 255).astype(np.uint8)


# --- wavelets -------------------------------------------------------------------------------------------------

#: Lifting steps (onto, weight): "d" updates details from evens, "s" evens from details. CDF 9/7 as in JPEG 2000.
STEPS = {
    "haar": [("d", -0.5), ("s", 0.25)],
    "cdf53": [("d", -0.5), ("s", 0.25)],
    "cdf97": [("d", -1.586134342), ("s", -0.05298011854), ("d", 0.8829110762), ("s", 0.4435068522)],
}


def _lift(even: np.ndarray, odd: np.ndarray, onto: str, weight: float, kind: str) -> np.ndarray:
    """What a step adds, rounded: symmetric at the edges."""
    if kind == "haar":
        return (-even[: len(odd)]) if onto == "d" else np.concatenate((odd, np.zeros((len(even) - len(odd), *odd.shape[1:]), odd.dtype))) >> 1
    if onto == "d":
        right = np.concatenate((even[1:], even[-1:]))[: len(odd)]
        return np.floor(weight * (even[: len(odd)] + right) + 0.5).astype(np.int32)
    if not len(odd):
        return np.zeros_like(even)
    left = np.concatenate((odd[:1], odd))[: len(even)]
    here = np.concatenate((odd, odd[-1:]))[: len(even)]
    return np.floor(weight * (left + here) + 0.5).astype(np.int32)


def _forward(a: np.ndarray, kind: str) -> np.ndarray:
    even, odd = a[::2].copy(), a[1::2].copy()
    for onto, weight in STEPS[kind]:
        more = _lift(even, odd, onto, weight, kind)
        if onto == "d":
            odd += more
        else:
            even += more
    return np.concatenate((even, odd))


def _inverse(a: np.ndarray, kind: str) -> np.ndarray:
    n = -(-len(a) // 2)
    even, odd = a[:n].copy(), a[n:].copy()
    for onto, weight in reversed(STEPS[kind]):
        more = _lift(even, odd, onto, weight, kind)
        if onto == "d":
            odd -= more
        else:
            even -= more
    out = np.empty_like(a)
    out[::2], out[1::2] = even, odd
    return out


def wavelet(plane: np.ndarray, kind: str = "cdf53", levels: int = 3) -> np.ndarray:
    """Integer 2-D transform, exactly inverted by ``unwavelet``."""
    out, (h, w) = plane.astype(np.int32).copy(), plane.shape
    for _ in range(levels):
        if min(h, w) < 2:
            break
        out[:h, :w] = _forward(_forward(out[:h, :w], kind).T, kind).T
        h, w = -(-h // 2), -(-w // 2)
    return out


def unwavelet(coeffs: np.ndarray, kind: str = "cdf53", levels: int = 3) -> np.ndarray:
    out, sizes = coeffs.astype(np.int32).copy(), []
    h, w = coeffs.shape
    for _ in range(levels):
        if min(h, w) < 2:
            break
        sizes.append((h, w))
        h, w = -(-h // 2), -(-w // 2)
    for h, w in reversed(sizes):
        out[:h, :w] = _inverse(_inverse(out[:h, :w].T, kind).T, kind)
    return out


# --- symbols and entropy coding -----------------------------------------------------------------------------------


def to_symbols(coeffs: np.ndarray) -> tuple[np.ndarray, int, float]:
    low, high = (int(coeffs.min()), int(coeffs.max())) if coeffs.size else (0, 0)
    if high - low <= 255:
        return (coeffs - low).astype(np.uint8), low, 0.0
    scale = np.float32(255) / np.float32(high - low)
    return np.clip(((coeffs - low).astype(np.float32) * scale).astype(np.int32), 0, 255).astype(np.uint8), low, float(scale)


def from_symbols(symbols: np.ndarray, low: int, scale: float) -> np.ndarray:
    if scale == 0:
        return symbols.astype(np.int32) + low
    return (symbols.astype(np.float32) * (np.float32(1) / np.float32(scale)) + np.float32(0.5)).astype(np.int32) + low


BITS = 12


def _frequencies(hist: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2 ** BITS, at least one for each symbol present."""
    total = int(hist.sum())
    freq = np.where(hist > 0, np.maximum(1, hist.astype(np.int64) * (1 << BITS) // max(total, 1)), 0)
    while (over := int(freq.sum()) - (1 << BITS)) != 0:
        k = int(freq.argmax())
        freq[k] -= min(over, int(freq[k]) - 1) if over > 0 else over
    return freq


def _lanes(n: int) -> int:
    """How many coders share a stream of n symbols: a row of symbols each step, at least 32 steps, at most 4096 wide."""
    return min(4096, max(1, n >> 5))


def rans_encode(symbols: np.ndarray, hist: np.ndarray) -> bytes:
    """Symbol k belongs to lane k % lanes; lanes code side by side with 32-bit states and 16-bit words. The stream is the
    lanes' states, then the words in the order in which decoding wants them."""
    n = len(symbols)
    if not n:
        return b""
    lanes, freq = _lanes(n), _frequencies(hist).astype(np.uint64)
    start = np.cumsum(freq) - freq
    state, out = np.full(lanes, 1 << 16, np.uint64), []
    for at in range((n - 1) // lanes * lanes, -1, -lanes):
        s = symbols[at : at + lanes]
        f, x = freq[s], state[: len(s)]
        full = x >= f << np.uint64(32 - BITS)
        out.append((x[full] & np.uint64(0xFFFF)).astype("<u2"))
        x = np.where(full, x >> np.uint64(16), x)
        state[: len(s)] = (x // f << np.uint64(BITS)) + x % f + start[s]
    return state.astype("<u4").tobytes() + np.concatenate(out[::-1]).tobytes()


def rans_decode(data: bytes, hist: np.ndarray, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint8)
    lanes, freq = _lanes(n), _frequencies(hist).astype(np.uint64)
    start, owner = np.cumsum(freq) - freq, np.repeat(np.arange(256, dtype=np.uint8), freq.astype(np.int64))
    state = np.frombuffer(data, "<u4", lanes).astype(np.uint64)
    words = np.concatenate((np.frombuffer(data, "<u2", offset=4 * lanes), np.zeros(lanes, "<u2"))).astype(np.uint64)  # a cut stream ends in zeros
    out, at = np.empty(n, np.uint8), 0
    for k in range(0, n, lanes):
        x = state[: min(lanes, n - k)]
        low = x & np.uint64((1 << BITS) - 1)
        s = owner[low.astype(np.int64)]
        out[k : k + len(x)] = s
        x = freq[s] * (x >> np.uint64(BITS)) + low - start[s]
        empty = np.flatnonzero(x < 1 << 16)
        if at + len(empty) > len(words):
            raise ValueError("the stream is cut")
        x[empty] = x[empty] << np.uint64(16) | words[at : at + len(empty)]
        at += len(empty)
        state[: len(x)] = x
    return out


# --- frames -----------------------------------------------------------------------------------------------------

FRAME = struct.Struct("<IIiiiiiifff")


def encode_frame(rgb: bytes, width: int, height: int, quality: int = 75, kind: str = "cdf53") -> bytes:
    px = np.frombuffer(rgb, np.uint8)
    if len(px) != width * height * 3:
        raise ValueError("size of the data isn't width * height * 3")
    step = max(1, (100 - quality) // 6)
    lows, scales, hists, streams = [], [], b"", b""
    for plane in to_ycocg(px.reshape(height, width, 3)):
        c = wavelet(plane, kind)
        q = np.sign(c) * (np.abs(c) // step)
        symbols, low, scale = to_symbols(q.reshape(-1))
        hist = np.bincount(symbols, minlength=256)
        bits = rans_encode(symbols, hist)
        lows.append(low)
        scales.append(scale)
        hists += struct.pack("<I", 256) + hist.astype("<u4").tobytes()
        streams += struct.pack("<I", len(bits)) + bits
    return FRAME.pack(width, height, step, step, step, *lows, *scales) + hists + streams


def decode_frame(data: bytes, kind: str = "cdf53") -> tuple[bytes, int, int] | None:
    if len(data) < FRAME.size:
        return None
    width, height, *rest = FRAME.unpack_from(data)
    steps, lows, scales, at = rest[:3], rest[3:6], rest[6:], FRAME.size
    hists, planes = [], []
    try:
        for _ in range(3):
            n = struct.unpack_from("<I", data, at)[0]
            hists.append(np.frombuffer(data, "<u4", n, at + 4))
            at += 4 + 4 * n
        for c in range(3):
            n = struct.unpack_from("<I", data, at)[0]
            symbols = rans_decode(data[at + 4 : at + 4 + n], hists[c], width * height)
            at += 4 + n
            q = from_symbols(symbols, lows[c], scales[c])
            planes.append(unwavelet((q * steps[c]).reshape(height, width), kind))
    except (struct.error, ValueError, IndexError):
        return None
    return from_ycocg(*planes).tobytes(), width, height


def person_mask(cur: np.ndarray, ref: np.ndarray, threshold: int = 25, least: int = 100, dilate: int = 2, erode: int = 1) -> tuple[np.ndarray, list[int], int]:
    """Mask of what moved, its bounding box [x, y, w, h] and its pixels; empty below ``least`` pixels."""
    mask = np.abs(cur.astype(np.int16) - ref.astype(np.int16)) > threshold

    def near(m, any_of):
        p = np.pad(m, 1, constant_values=not any_of)
        parts = [p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
        return np.logical_or.reduce(parts) if any_of else np.logical_and.reduce(parts)

    for _ in range(dilate):
        mask = near(mask, True)
    for _ in range(erode):
        mask = near(mask, False)
    n = int(mask.sum())
    if n < least:
        return np.zeros_like(mask), [0, 0, 0, 0], 0
    ys, xs = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    return mask, [int(xs[0]), int(ys[0]), int(xs[-1] - xs[0] + 1), int(ys[-1] - ys[0] + 1)], n


# --- voice --------------------------------------------------------------------------------------------------------


def lpc_rows(samples: np.ndarray, order: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Prediction coefficients and gain of each row, by autocorrelation and the Levinson-Durbin recursion."""
    rows, n = samples.shape
    x = samples.astype(np.float64) * np.hamming(n) if n else np.zeros((rows, 1))
    r = np.stack([np.einsum("rn,rn->r", x[:, : x.shape[1] - k], x[:, k:]) if k < x.shape[1] else np.zeros(rows) for k in range(order + 1)], 1)
    a, err = np.zeros((rows, order)), r[:, 0].copy()
    for i in range(order):
        going = err > 1e-12
        k = np.where(going, (r[:, i + 1] - np.einsum("rn,rn->r", a[:, :i], r[:, i:0:-1])) / np.where(going, err, 1), 0)
        a[:, :i], a[:, i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1], k
        err = err * (1 - k * k)
    return a.astype(np.float32), np.sqrt(np.maximum(err, 0) / max(x.shape[1], 1))


def pitch_rows(samples: np.ndarray, rate: int, low: float = 60.0, high: float = 400.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """f0, period, confidence and voiced of each row."""
    rows, n = samples.shape
    a, b = max(int(rate / high), 1), min(int(rate / low), n - 1)
    nothing = np.zeros(rows)
    if not n or b <= int(rate / high):
        return nothing, nothing, nothing, nothing > 0
    x = samples.astype(np.float64)
    x = x - x.mean(1, keepdims=True)
    power = np.einsum("rn,rn->r", x, x)
    loud = power > 1e-9
    scores = np.stack([np.einsum("rn,rn->r", x[:, :-k], x[:, k:]) for k in range(a, b + 1)], 1) / np.where(loud, power, 1)[:, None]
    best = scores.argmax(1)
    period = np.where(loud, a + best, 0).astype(np.float64)
    sure = np.where(loud, np.maximum(0.0, scores[np.arange(rows), best]), 0.0)
    return np.where(loud, rate / np.maximum(period, 1), 0.0), period, sure, sure > 0.3


def parametric_rows(samples: np.ndarray, rate: int) -> list[dict]:
    """What describes each row (all of one length)."""
    (coeffs, gain), (f0, period, sure, voiced), n = lpc_rows(samples), pitch_rows(samples, rate), samples.shape[1]
    energy = 10 * np.log10((samples.astype(np.float64) ** 2).mean(1) + 1e-10) if n else np.full(len(samples), -100.0)
    activity = np.minimum(1.0, np.maximum(0.0, (energy + 60) / 60))
    columns = {"coeffs": coeffs, "gain": gain, "f0": f0, "period": period, "pitch_confidence": sure, "voiced": voiced, "active": energy > -50, "activity_confidence": activity, "energy_db": energy}
    lists = {k: v.tolist() for k, v in columns.items()}
    return [{k: v[i] for k, v in lists.items()} | {"frame_size": n, "sample_rate": rate} for i in range(len(samples))]


def synthesise_rows(items: list[dict]) -> list[np.ndarray]:
    """Samples of each item: frames of one size and order run through their filters side by side, a sample of all a step."""
    out: list = [None] * len(items)
    alike: dict[tuple[int, int], list[int]] = {}
    for i, p in enumerate(items):
        alike.setdefault((p["frame_size"], len(p["coeffs"])), []).append(i)
    for (n, m), own in alike.items():
        e, noise = np.zeros((len(own), n)), np.random.default_rng(0).standard_normal(n)
        for k, i in enumerate(own):
            p = items[i]
            if p["voiced"] and p["period"] >= 1:
                e[k, :: int(round(p["period"]))] = np.sqrt(p["period"])
            else:
                e[k] = noise
        e *= np.array([items[i]["gain"] for i in own])[:, None]
        back = np.array([items[i]["coeffs"][::-1] for i in own]).reshape(len(own), m)
        made = np.zeros((m + n, len(own)))
        for k in range(n):
            made[m + k] = e[:, k] + np.einsum("rm,mr->r", back, made[k : m + k])
        for k, i in enumerate(own):
            out[i] = made[m:, k].astype(np.float32)
    return out


def parametric(samples: np.ndarray, rate: int) -> dict:
    return parametric_rows(samples[None], rate)[0]


def synthesise(p: dict) -> np.ndarray:
    return synthesise_rows([p])[0]


def _cosines(n: int) -> np.ndarray:
    """The orthonormal DCT of n samples; rows are coefficients."""
    k, x = np.mgrid[:n, :n]
    return np.sqrt(2 / max(n, 1)) * np.where(k == 0, np.sqrt(0.5), 1.0) * np.cos((2 * x + 1) * k * np.pi / (2 * max(n, 1)))


def spectral_rows(samples: np.ndarray, keep: int = 16) -> list[dict]:
    """The largest coefficients of each row's orthonormal DCT."""
    n = samples.shape[1]
    c = samples.astype(np.float64) @ _cosines(n).T
    at = np.sort(np.argsort(-np.abs(c), 1, kind="stable")[:, :keep], 1)
    values, energy = np.take_along_axis(c, at, 1).astype(np.float32), (samples.astype(np.float64) ** 2).sum(1)
    return [{"energy": e, "frame_size": n, "coefficients": list(zip(i, v))} for e, i, v in zip(energy.tolist(), at.tolist(), values.tolist())]


def unspectral_rows(items: list[dict]) -> list[np.ndarray]:
    out: list = [None] * len(items)
    for n in {p["frame_size"] for p in items}:
        own = [i for i, p in enumerate(items) if p["frame_size"] == n]
        c = np.zeros((len(own), n))
        for k, i in enumerate(own):
            for at, v in items[i]["coefficients"]:
                c[k, at] = v
        for i, x in zip(own, (c @ _cosines(n)).astype(np.float32)):
            out[i] = x
    return out


def spectral(samples: np.ndarray, keep: int = 16) -> dict:
    return spectral_rows(samples[None], keep)[0]


def unspectral(p: dict) -> np.ndarray:
    return unspectral_rows([p])[0]
