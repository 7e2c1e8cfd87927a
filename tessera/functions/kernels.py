"""NumPy kernels for what is sequential within a frame: one call per frame or pair of frames."""

from __future__ import annotations

import numpy as np

LARGE = [(0, -2), (-1, -1), (1, -1), (-2, 0), (2, 0), (-1, 1), (1, 1), (0, 2)]
SMALL = [(0, -1), (-1, 0), (1, 0), (0, 1)]
FEW = 256


def still_sad(cur: np.ndarray, prev: np.ndarray, block: int) -> np.ndarray:
    """Sum of absolute differences at no offset of every whole block [by, bx]: rows of a block first, in small integers."""
    ny, nx = cur.shape[0] // block, cur.shape[1] // block
    a, b = (x[: ny * block, : nx * block].reshape(ny, block, nx * block) for x in (cur, prev))
    out = np.zeros((ny, nx), np.int64)
    moved = np.flatnonzero((a != b).reshape(ny, -1).any(1))  # rows of blocks that are the same throughout need no sums
    if len(moved) < ny:
        a, b = a[moved], b[moved]
    lines = (np.maximum(a, b) - np.minimum(a, b)).sum(1, dtype=np.uint16 if block <= 257 else np.int64)
    out[moved] = lines.reshape(len(moved), nx, block).sum(2, dtype=np.int64)
    return out


def diamond(cur: np.ndarray, prev: np.ndarray, block: int = 16, reach: int = 16, threshold: int = 256) -> np.ndarray:
    """Rows (bx, by, dx, dy, sad) of every whole block, in raster order.

    All blocks move in lockstep: each step of the pattern tries one offset for the blocks that are still looking,
    around the centre that each has by then, which is what a block on its own would do.
    """
    if cur.shape != prev.shape or cur.ndim != 2:
        return np.zeros((0, 5), np.int64)
    h, w = cur.shape
    ny, nx = h // block, w // block
    if not ny * nx:
        return np.zeros((0, 5), np.int64)
    own = cur[: ny * block, : nx * block].reshape(ny, block, nx, block).swapaxes(1, 2)
    views = np.lib.stride_tricks.sliding_window_view(prev, (block, block))
    oy, ox = (a.reshape(-1) * block for a in np.mgrid[:ny, :nx])

    def sad(who, y, x):
        out = np.empty(len(who), np.int64)
        for i in range(0, len(who), 4096):
            part = slice(i, i + 4096)
            out[part] = np.abs(own[who[part] // nx, who[part] % nx].astype(np.int16) - views[y[part], x[part]]).sum((1, 2), dtype=np.int64)
        return out

    n = ny * nx
    dx, dy, best = np.zeros(n, np.int64), np.zeros(n, np.int64), still_sad(cur, prev, block).reshape(-1)
    done = best < threshold

    def scan(who, pattern, early):
        """Blocks of ``who`` that improved."""
        better = np.zeros(n, bool)
        for sx, sy in pattern:
            who = who[~done[who]] if early else who
            x, y = dx[who] + sx, dy[who] + sy
            ok = (np.abs(x) <= reach) & (np.abs(y) <= reach) & (ox[who] + x >= 0) & (oy[who] + y >= 0) & (ox[who] + x + block <= w) & (oy[who] + y + block <= h)
            at, x, y = who[ok], x[ok], y[ok]
            value = sad(at, oy[at] + y, ox[at] + x)
            win = value < best[at]
            at = at[win]
            best[at], dx[at], dy[at], better[at] = value[win], x[win], y[win], True
            if early:
                done[at] = best[at] < threshold
        return better

    def scan_few(who, pattern, early):
        """The same for few blocks, where calls cost more than sums: all offsets left are tried around a block's centre at once,
        the first that improves moves it, and those after it are tried again around the new one."""
        better, offsets = np.zeros(n, bool), np.array(pattern)
        who = who[~done[who]] if early else who
        start = np.zeros(len(who), np.int64)
        while len(who):
            x, y = dx[who][:, None] + offsets[:, 0], dy[who][:, None] + offsets[:, 1]
            px, py = ox[who][:, None] + x, oy[who][:, None] + y
            ok = (np.arange(len(offsets)) >= start[:, None]) & (np.abs(x) <= reach) & (np.abs(y) <= reach) & (px >= 0) & (py >= 0) & (px + block <= w) & (py + block <= h)
            value = np.full(ok.shape, np.iinfo(np.int64).max)
            value[ok] = sad(who[ok.nonzero()[0]], py[ok], px[ok])
            win = value < best[who][:, None]
            first, row = win.argmax(1), np.flatnonzero(win.any(1))
            who, first = who[row], first[row]
            dx[who], dy[who], best[who], better[who] = x[row, first], y[row, first], value[row, first], True
            more = first + 1 < len(offsets)
            if early:
                done[who] = best[who] < threshold
                more &= ~done[who]
            who, start = who[more], first[more] + 1
        return better

    look, rounds = np.flatnonzero(~done), 0
    refine = look
    while len(look):
        better = (scan if len(look) > FEW else scan_few)(look, LARGE, True)
        rounds += 1
        if rounds >= 2 * reach:
            break
        look = look[better[look] & ~done[look]]
    look = refine[~done[refine]]
    while len(look):
        look = look[(scan if len(look) > FEW else scan_few)(look, SMALL, False)[look]]
    return np.stack([ox // block, oy // block, dx, dy, best], 1)


def full_search(cur: np.ndarray, prev: np.ndarray, block: int = 16, reach: int = 16) -> np.ndarray:
    """Rows (bx, by, dx, dy, sad) of every whole block: the best of all offsets, zero first, then the least (dy, dx)."""
    if cur.shape != prev.shape:
        return np.zeros((0, 5), np.int64)
    (h, w), ny, nx = cur.shape, cur.shape[0] // block, cur.shape[1] // block
    own = cur[: ny * block, : nx * block].astype(np.int16)
    wide = np.zeros((ny * block + 2 * reach, nx * block + 2 * reach), np.int16)
    part = prev[: ny * block + reach, : nx * block + reach]
    wide[reach : reach + part.shape[0], reach : reach + part.shape[1]] = part
    oy, ox = (a * block for a in np.mgrid[:ny, :nx])
    best = np.full((ny, nx), 1 << 62, np.int64)
    move = np.zeros((2, ny, nx), np.int64)
    offsets = [(0, 0)] + [(dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1) if dy or dx]
    for dy, dx in offsets:
        d = np.abs(own - wide[reach + dy : reach + dy + ny * block, reach + dx : reach + dx + nx * block])
        value = d.reshape(ny, block, nx, block).sum((1, 3), dtype=np.int64)
        win = (value < best) & (oy + dy >= 0) & (oy + dy + block <= h) & (ox + dx >= 0) & (ox + dx + block <= w)
        best[win], move[0][win], move[1][win] = value[win], dy, dx
    return np.stack([(ox // block).reshape(-1), (oy // block).reshape(-1), move[1].reshape(-1), move[0].reshape(-1), best.reshape(-1)], 1)


def sample_pixels(rgb: bytes, rate: float) -> np.ndarray:
    px = np.frombuffer(rgb, np.uint8)
    return px[: len(px) // 3 * 3].reshape(-1, 3)[:: int(max(1 / rate, 1.0))].astype(np.int64)


def _distances(px: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((px[:, None] - centres[None]) ** 2).sum(2)


def kmeans(rgb: bytes, k: int = 5, rounds: int = 10, rate: float = 0.1) -> tuple[list[tuple], list[float]]:
    """Colours and weights, heaviest first. Starts at the middle sample, then the farthest (the last of equals)."""
    px = sample_pixels(rgb, rate) if len(rgb) >= 3 else np.zeros((0, 3), np.int64)
    if not len(px) or k == 0:
        return [(0, 0, 0)], [1.0]
    centres = [px[len(px) // 2]]
    near = _distances(px, centres[0][None])[:, 0]
    while len(centres) < k:
        centres.append(px[len(px) - 1 - int(near[::-1].argmax())])
        near = np.minimum(near, _distances(px, centres[-1][None])[:, 0])
    centres, own = np.array(centres), np.zeros(len(px), np.int64)
    for _ in range(rounds):
        found = _distances(px, centres).argmin(1)
        changed, own = bool((found != own).any()), found
        counts = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, px[:, c], k) for c in range(3)], 1).astype(np.int64)
        centres = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], 0)
        if not changed:
            break
    weights = (np.bincount(own, minlength=k).astype(np.float32) / np.float32(len(px))).tolist()
    kept = sorted((i for i in range(k) if weights[i] > 0), key=lambda i: -weights[i])
    return [tuple(centres[i].tolist()) for i in kept], [weights[i] for i in kept]


def median_cut(rgb: bytes, count: int) -> list[tuple]:
    px = np.frombuffer(rgb, np.uint8)
    px = px[: len(px) // 3 * 3].reshape(-1, 3).astype(np.int64)
    if not len(px) or count == 0:
        return [(0, 0, 0)]
    boxes = [px]
    for _ in range(int(np.ceil(np.log2(count)))):
        cut = []
        for b in boxes:
            if len(b) <= 1:
                cut.append(b)
                continue
            channel = int((b.max(0) - b.min(0)).argmax())  # the first of equals: red, green, blue
            b = b[np.argsort(b[:, channel], kind="stable")]
            cut += [b[: len(b) // 2], b[len(b) // 2 :]]
        boxes = cut
    return [tuple((b.sum(0) // len(b)).tolist()) for b in boxes if len(b)][:count]


def merge_regions(regions: list[dict]) -> list[dict]:
    """One pass of greedy merging, largest first: a region takes in what meets its own bounds; type and priority are its own."""
    if len(regions) < 2:
        return [dict(r) for r in regions]
    todo = sorted(regions, key=lambda r: -r["width"] * r["height"])
    out = []
    while todo:
        seed, rest = todo[0], []
        x0, y0, x1, y1, sure = seed["x"], seed["y"], seed["x"] + seed["width"], seed["y"] + seed["height"], seed["confidence"]
        left, top, right, bottom = x0, y0, x1, y1
        for r in todo[1:]:
            rx, ry = r["x"] + r["width"], r["y"] + r["height"]
            if left < rx and r["x"] < right and top < ry and r["y"] < bottom:
                x0, y0, x1, y1, sure = min(x0, r["x"]), min(y0, r["y"]), max(x1, rx), max(y1, ry), max(sure, r["confidence"])
            else:
                rest.append(r)
        out.append(dict(seed, x=x0, y=y0, width=x1 - x0, height=y1 - y0, confidence=sure))
        todo = rest
    return out


def dct_basis(n: int) -> np.ndarray:
    """Rows u, columns x: with B, the transform of X (rows y) is B X B'."""
    u, x = np.mgrid[:n, :n]
    return np.sqrt(2 / n) * np.where(u == 0, np.sqrt(0.5), 1.0) * np.cos((2 * x + 1) * u * np.pi / (2 * n))
