"""Column-wise construction of the Burrows-Wheeler transform of a collection of byte strings.

Each round inserts one symbol of every string, last symbols first: the suffix of length j + 1 of string i goes to
the row that its first symbol c and the row of its suffix of length j give (all rows of smaller symbols, then
the c's above that row). Rows hold the symbol before the suffix and the length of the common prefix with the row
above, up to ``CAP``; both live in files that every round reads and writes from end to end. The prefix a new
row shares with its neighbours is one more than the least value between the rows that their remainders have.
"""

from __future__ import annotations

import tempfile

import numpy as np

CAP, NEAR, BLOCK = 255, (64, 1024, 8192), 256
ONES, LOWS, HIGHS = np.uint64(0x0101010101010101), np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)


def windows(a: np.ndarray, width: int) -> np.ndarray:
    """All windows of a contiguous array, as ``sliding_window_view`` has them, without its cost a call."""
    return np.ndarray((len(a) - width + 1, width), a.dtype, a, strides=2 * a.strides)


class Columns:
    """Two sequential files (symbols, common prefixes), replaced by new ones every round; gone when closed."""

    def __init__(self):
        self.files = [tempfile.TemporaryFile(), tempfile.TemporaryFile()]

    def write(self, *arrays: np.ndarray) -> None:
        for f, a in zip(self.files, arrays):
            f.seek(0)
            f.truncate()
            f.write(a.data)

    def read(self, n: int) -> list[np.ndarray]:
        """Both columns with a margin of zeros on either side, so that windows around any row exist."""
        out = []
        for f in self.files:
            f.seek(0)
            a = np.zeros(n + 2 * NEAR[-1], np.uint8)
            f.readinto(a[NEAR[-1] : n + NEAR[-1]].data)
            out.append(a)
        return out

    def close(self) -> None:
        for f in self.files:
            f.close()


def occurrences(bwt: np.ndarray, at: np.ndarray, c: np.ndarray, sigma: int, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often symbol c stands above each row of ``at``, and the counts of all symbols. base: each row's block times sigma."""
    n = len(bwt)
    blocks = -(-n // BLOCK)
    table = np.bincount(base[:n] + bwt, minlength=blocks * sigma).reshape(blocks, sigma)
    above = np.zeros((blocks + 1, sigma), np.int64)
    np.cumsum(table, axis=0, out=above[1:])
    full = np.zeros(blocks * BLOCK, np.uint8)
    full[:n] = bwt
    block = at // BLOCK
    rows = full.reshape(blocks, BLOCK)[block]
    inside = (rows == c[:, None]) & (np.arange(BLOCK, dtype=np.int16) < (at - block * BLOCK).astype(np.int16)[:, None])
    return above[block, c] + np.count_nonzero(inside, axis=1), above[-1]


def _in_eight(bwt: np.ndarray, prefix: np.ndarray, at: np.ndarray, c: np.ndarray, down: bool) -> tuple[np.ndarray, np.ndarray]:
    """What ``least_between`` finds within eight rows, eight bytes to a machine word: values, and where there are any. at counts the margin."""
    start = at + 1 if down else at - 8
    word = lambda a, i: windows(a, 8)[i].view("<u8").reshape(-1)
    x = word(bwt, start) ^ (c.astype(np.uint64) * ONES)
    zero = ~(((x & LOWS) + LOWS) | x | LOWS)  # the high bit of each byte that is c
    near = word(prefix, start if down else start + 1)
    if down:
        low = zero & (~zero + np.uint64(1))
        near |= ~((low << np.uint64(1)) - np.uint64(1))
    else:
        y = zero | zero >> np.uint64(8)
        y |= y >> np.uint64(16)
        y |= y >> np.uint64(32)
        above = np.bitwise_count(y & HIGHS).astype(np.uint64)
        near |= (np.uint64(1) << (np.uint64(8) * (np.maximum(above, np.uint64(1)) - np.uint64(1)))) - np.uint64(1)
    a = near.view(np.uint8).reshape(-1, 8)
    a = np.minimum(a[:, :4], a[:, 4:])
    a = np.minimum(a[:, :2], a[:, 2:])
    return np.minimum(a[:, 0], a[:, 1]), zero != 0


def least_between(bwt: np.ndarray, prefix: np.ndarray, at: np.ndarray, c: np.ndarray, there: np.ndarray, down: bool) -> np.ndarray:
    """Least prefix value between each row of ``at`` and the nearest row with symbol c above (or below); -1 where ``there`` says that there is none.

    bwt and prefix have margins. The prefix values that count are those of the rows after the upper one up to the lower one.
    """
    edge = NEAR[-1]
    values, found = _in_eight(bwt, prefix, at + edge, c, down)
    out, todo = np.where(found & there, values.astype(np.int16), np.int16(-1)), np.flatnonzero(~found & there)
    for width in NEAR:
        if not len(todo):
            return out
        start = at[todo] + edge + (1 if down else -width)
        hit = windows(bwt, width)[start] == c[todo][:, None]
        near = windows(prefix, width)[start if down else start + 1]
        step = np.arange(width, dtype=np.int16)
        first = (hit if down else hit[:, ::-1]).argmax(1).astype(np.int16)
        found = hit.any(1)
        outside = step > first[:, None] if down else step < (width - 1 - first)[:, None]
        near[outside] = CAP
        out[todo[found]] = near.min(1)[found]
        todo = todo[~found]
    if not len(todo):
        return out
    own, low = bwt[edge:-edge], prefix[edge:-edge]
    wanted = np.zeros(256, bool)
    wanted[c[todo]] = True
    rows = np.flatnonzero(wanted[own])  # of all these symbols in one pass
    order = np.argsort(own[rows], kind="stable")  # by counting, as these are bytes
    keys = own[rows[order]].astype(np.int64) * len(own) + rows[order]
    key = c[todo].astype(np.int64) * len(own) + at[todo]
    k = np.searchsorted(keys, key, side="right") if down else np.searchsorted(keys, key) - 1
    there = (k >= 0) & (k < len(keys))
    near = keys[np.clip(k, 0, len(keys) - 1)]
    there &= near // len(own) == c[todo]
    for t, x, y in zip(todo[there].tolist(), at[todo[there]].tolist(), (near[there] % len(own)).tolist()):
        out[t] = low[x + 1 : y + 1].min() if down else low[y + 1 : x + 1].min()
    return out


def build(strings: list[bytes], files: Columns, needed: int = 0, marks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The transform over compact symbols, 0 for a string's start, and the prefixes.

    With needed and marks, strings come to their marks in the same round, and from there a string ends to the left where
    no substring of ``needed`` symbols over its mark can be shared any more: its suffix from p shares less than up to
    the mark's two symbols with any other, or less than needed - p. What could match it is in the rows by then.
    """
    m, lens = len(strings), np.array([len(s) for s in strings], np.int64)
    flat = np.frombuffer(b"".join(strings), np.uint8)
    used = np.flatnonzero(np.bincount(flat, minlength=256))
    code = np.zeros(256, np.uint8)
    if len(used) > 255:
        raise ValueError("256 byte values leave no symbol for a string's start")
    code[used] = np.arange(1, len(used) + 1)
    symbols, sigma = code[flat], len(used) + 1
    ends = np.cumsum(lens)

    def symbol(who: np.ndarray, j: int) -> np.ndarray:
        """Symbol before the suffix of length j; 0 at the string's start."""
        return np.where(lens[who] > j, symbols[np.maximum(ends[who] - 1 - j, 0)], 0).astype(np.uint8)

    total, edge = int(lens.sum()) + m, NEAR[-1]
    base = np.repeat(np.arange(-(-total // BLOCK), dtype=np.int64) * sigma, BLOCK)
    right = np.zeros(m, np.int64) if marks is None else lens - marks
    delay = right.max(initial=0) - right  # so that all strings come to their marks in one round
    files.write(np.zeros(m, np.uint8), np.zeros(m, np.uint8))
    n, who, row = m, np.zeros(0, np.int64), np.zeros(0, np.int64)
    for j in range(int((delay + lens).max(initial=0))):
        wide, wide_prefix = files.read(n)
        bwt, prefix = wide[edge:-edge], wide_prefix[edge:-edge]
        fresh = np.flatnonzero(delay == j)
        bwt[fresh] = symbol(fresh, 0)
        who, row = np.concatenate((who, fresh)), np.concatenate((row, fresh))
        live = bwt[row] > 0
        who, row = who[live], row[live]
        if not len(who):
            files.write(bwt, prefix)
            continue
        c = bwt[row]
        rank, counts = occurrences(bwt, row, c, sigma, base)
        first = m + np.concatenate(([0, 0], np.cumsum(counts[1:-1])))
        to = first[c] + rank
        order = np.argsort(to, kind="stable")
        who, row, to, c, rank = who[order], row[order], to[order], c[order], rank[order]
        up = least_between(wide, wide_prefix, row, c, rank > 0, False)
        last = np.flatnonzero(np.append(to[1:] != to[:-1] + 1, True))  # others stand above a new row
        low = least_between(wide, wide_prefix, row[last], c[last], rank[last] + 1 < counts[c[last]], True)
        age = j - delay[who] + 1
        before = symbol(who, age)
        if marks is not None:
            below = np.append(np.where(to[1:] == to[:-1] + 1, up[1:], -1), -1)
            below[last] = low
            p = lens[who] - age
            before[(p <= marks[who]) & (np.maximum(up, below) + 1 < np.maximum(marks[who] - p + 2, needed - p))] = 0
        n += len(to)
        new = np.zeros(n, bool)
        new[to] = True
        old, grown, shared = ~new, np.empty(n, np.uint8), np.empty(n, np.uint8)
        grown[old], shared[old] = bwt, prefix
        grown[to] = before
        shared[to] = np.where(up >= 0, np.minimum(up + 1, CAP), 0)
        below = low >= 0
        shared[to[last][below] + 1] = np.minimum(low[below] + 1, CAP)
        files.write(grown, shared)
        row = to
    return tuple(x[edge:-edge] for x in files.read(n))


def repeated_starts(strings: list[bytes], length: int, marks: list[int] | None = None) -> list[np.ndarray]:
    """For each string, which of its len - length + 1 substrings of ``length`` bytes stand elsewhere in the collection too.

    marks: a place in each string whose two symbols are in each of those substrings and tell where they may match.
    """
    files = Columns()
    try:
        bwt, prefix = build(strings, files, *((length, np.array(marks, np.int64)) if marks else ()))
    finally:
        files.close()
    m, n = len(strings), len(bwt)
    hit = np.zeros(n, bool)
    hit[1:] = prefix[1:] >= length
    hit[:-1] |= hit[1:]
    # following the symbols from the ends of the strings leads through their suffixes, shortest first
    order = np.argsort(bwt, kind="stable")
    step = np.empty(n, np.int64)
    step[order] = np.arange(n) + m - int((bwt == 0).sum())
    lens = np.array([len(s) for s in strings], np.int64)
    out = [np.zeros(max(0, k - length + 1), bool) for k in lens.tolist()]
    most = int(lens.max(initial=0))
    flags = np.zeros((most + 1, m), bool)
    at, who = np.arange(m), np.arange(m)
    for j in range(most + 1):
        flags[j, who] = hit[at]
        more = bwt[at] > 0
        at, who = step[at[more]], who[more]
    for i, k in enumerate(lens.tolist()):
        if k >= length:
            out[i] = flags[length : k + 1, i][::-1].copy()
    return out
