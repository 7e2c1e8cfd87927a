"""Runs of words that repeat with a period, found through a grammar (Re-Pair), and their removal but for the first period.

A run is a stretch of consecutive words with smallest period q and at least max(6, 4 * q) words that no neighbouring
word extends. In a run each string of three words starts at least three times, so documents are first cut where a
string of three does not (counted by hash, which can only count too much); parts of less than six words hold no run.
The parts of a batch of documents are the strings of one grammar: in a round, pairs at least half as frequent as the most
frequent one become nonterminals, the more frequent first where two overlap. A run lies inside a smallest
nonterminal (or the start rule) and crosses the boundary between two of its parts, so for each nonterminal, at one place
where it stands, the runs that cross its boundary are found. They are then translated to all places where the
nonterminal is derived; where its end cuts one off, a larger nonterminal has the whole, and intervals inside others of
the same period go.

To find the runs across a boundary: one side has two periods, say the right one; so the string of K <= q words before and
after the boundary stands again q words later. K doubles; candidates for q in [K, 2 * K) are the next places of the same
K words (by hash), checked word by word. What has period q up to some place rules out longer periods that reach no
further, so there are few candidates. The left side is the same on the reversed string.

Null and empty texts have no words. Repeated rows stay repeated, an empty table gives an empty result. Only the columns
in ``keep`` are kept; one of them with a name of the result gives way to it. A document is in one task, as it is one value.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

LEAST, TIMES, PART = 6, 4, 4 << 20
MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * MIX[0]
    return h ^ h >> np.uint64(29)


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), then first[1], ..."""
    ends = np.cumsum(count)
    return np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


def parts(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the parts of documents that may hold runs; ends: where each document ends."""
    n = len(words)
    if n < LEAST:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w, doc = words.astype(np.uint64), np.repeat(np.arange(len(ends), dtype=np.uint64), np.diff(ends, prepend=0))
    h = mixed(((w[:-2] * MIX[0] + w[1:-1]) * MIX[1] + w[2:]) * MIX[0] + doc[:-2])
    inside = doc[:-2] == doc[2:]
    slot = (h >> np.uint64(64 - max(8, int(4 * n).bit_length()))).astype(np.int64)
    good = inside & (np.bincount(slot[inside], minlength=slot.max() + 1)[slot] >= 3)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], good.astype(np.int8), [0]))))
    first, many = edge[::2], edge[1::2] - edge[::2] + 2
    return first[many >= LEAST], many[many >= LEAST]


class Grammar:
    """Re-Pair over strings of numbers from 0, each followed by -1."""

    def __init__(self, text: np.ndarray):
        terminals, self.symbols = np.unique(text, return_inverse=True)
        self.symbols = self.symbols - (terminals[0] < 0)  # -1 stays -1
        self.at, self.terminals = np.arange(len(text)), int(self.symbols.max(initial=-1)) + 1
        self.size = np.ones(self.terminals, np.int64)
        self.left, self.right, self.place = (np.full(self.terminals, -1) for _ in range(3))
        self.rounds = [self.terminals]
        while self._replace():
            self.rounds.append(len(self.size))

    def _replace(self) -> bool:
        sym, total = self.symbols, len(self.size)
        if len(sym) < 2:
            return False
        fits, same = (sym[:-1] >= 0) & (sym[1:] >= 0), sym[:-1] == sym[1:]
        if (same & fits).any():  # in a stretch of one symbol every other pair counts
            begins = np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), np.arange(len(sym)), 0))[:-1]
            fits &= ~(same & ((np.arange(len(same)) - begins) % 2 == 1))
        at = np.flatnonzero(fits)
        kinds, kind, count = np.unique(sym[at] * total + sym[at + 1], return_inverse=True, return_counts=True)
        most = count.max(initial=0)
        if most < 2:
            return False
        order = np.empty(len(kinds), np.int64)
        order[np.lexsort((mixed(kinds.astype(np.uint64)), -count))] = np.arange(len(kinds))
        often = count[kind] >= max(2, (most + 1) // 2)
        rank = np.full(len(sym) + 2, len(kinds))
        rank[at[often] + 1] = order[kind[often]]
        chosen = (rank[1:-1] < rank[:-2]) & (rank[1:-1] < rank[2:])
        place = np.flatnonzero(chosen)
        made, first, number = np.unique(rank[1:-1][place], return_index=True, return_inverse=True)
        left, right = sym[place[first]], sym[place[first] + 1]
        self.size = np.concatenate((self.size, self.size[left] + self.size[right]))
        self.left, self.right, self.place = (np.concatenate(x) for x in ((self.left, left), (self.right, right), (self.place, self.at[place[first]])))
        sym[place] = total + number
        stay = np.ones(len(sym), bool)
        stay[place + 1] = False
        self.symbols, self.at = sym[stay], self.at[stay]
        return True

    def derived(self, wanted: np.ndarray):
        """(symbols, places) of all places where a wanted symbol (boolean array) is derived, a level at a time."""
        within = wanted.copy()
        for a, b in zip(self.rounds[:-1], self.rounds[1:]):
            within[a:b] |= within[self.left[a:b]] | within[self.right[a:b]]
        there = (self.symbols >= 0) & within[self.symbols]
        sym, at = self.symbols[there], self.at[there]
        while len(sym):
            yield sym[wanted[sym]], at[wanted[sym]]
            sym, at = sym[sym >= self.terminals], at[sym >= self.terminals]
            sym, at = np.concatenate((self.left[sym], self.right[sym])), np.concatenate((at, at + self.size[self.left[sym]]))
            sym, at = sym[within[sym]], at[within[sym]]


def equal_ahead(text: np.ndarray, a: int, b: int, most: int) -> int:
    """How many of at most ``most`` symbols from a and from b on are equal."""
    done, step = 0, 32
    while done < most:
        end = min(most, done + step)
        differ = text[a + done : a + end] != text[b + done : b + end]
        k = int(differ.argmax())
        if differ[k]:
            return done + k
        done, step = end, step * 4
    return most


def crossing_right(text: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(number, start, end, period) of the runs in [lo, hi) that cross mid and have two periods or more from there on."""
    back, n, found = text[::-1], len(text), []
    reach, least = np.minimum((hi - lo) // TIMES, (hi - mid) // 2), np.ones(len(lo), np.int64)
    grams, k = text.astype(np.uint64), 1
    while len(some := np.flatnonzero(reach >= np.maximum(k, least))):
        inside = np.zeros(n + 1, np.int64)
        np.add.at(inside, lo[some], 1)
        np.add.at(inside, hi[some], -1)
        where = np.flatnonzero(np.cumsum(inside[: len(grams)]) > 0)
        names, name = np.unique(grams[where], return_inverse=True)
        keys = np.sort(name * n + where)
        own = np.searchsorted(names, grams[mid[some] - 1])
        while len(some):
            start = mid[some] - 1
            spot = np.minimum(np.searchsorted(keys, own * n + start + np.maximum(k, least[some])), len(keys) - 1)
            q = keys[spot] % n - start
            ok = (keys[spot] // n == own) & (q >= np.maximum(k, least[some])) & (q < 2 * k) & (q <= reach[some])
            some, own, start, q = some[ok], own[ok], start[ok], q[ok]
            least[some] = q + 1
            like = np.ones(len(some), bool)
            for quarter in range(5):
                at = start + q * quarter // 4
                like &= text[at] == text[at + q]
            for x, s, p in zip(some[like].tolist(), start[like].tolist(), q[like].tolist()):
                end = s + p + equal_ahead(text, s, s + p, int(hi[x]) - s - p)
                begin = s - equal_ahead(back, n - s, n - s - p, s - int(lo[x]))
                least[x] = max(p + 1, end - s - p + 1)
                if end - s - 1 >= 2 * p and end - begin >= max(LEAST, TIMES * p):
                    found.append((x, begin, end, p))
        grams, k = mixed(grams[:-k] * MIX[1] + grams[k:]), 2 * k
    return found


def crossing(text: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Rows (number, start, end, period) of the runs in [lo, hi) that cross mid."""
    n = len(text)
    right = crossing_right(text, lo, mid, hi)
    left = [(x, n - e, n - b, p) for x, b, e, p in crossing_right(text[::-1].copy(), n - hi, n - mid, n - lo)]
    return np.array(right + left, np.int64).reshape(-1, 4)


def runs(text: np.ndarray, first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period; text: strings, each followed by -1, that start at first."""
    g = Grammar(text)
    rules = np.arange(g.terminals, len(g.size))
    place, size = g.place[rules], g.size[rules]
    part = np.searchsorted(first, g.at, side="right") - 1
    inner = np.flatnonzero((g.symbols[:-1] >= 0) & (g.symbols[1:] >= 0))
    lo, mid, hi = (np.concatenate(x) for x in ((place, first[part[inner]]), (place + g.size[g.left[rules]], g.at[inner + 1]), (place + size, (first + many)[part[inner]])))
    long = np.flatnonzero(hi - lo >= LEAST)
    got = crossing(text, lo[long], mid[long], hi[long])
    own = long[got[:, 0]]
    spans = [got[own >= len(rules)][:, 1:]]
    got, own = got[own < len(rules)], own[own < len(rules)]
    by = np.argsort(own, kind="stable")
    got, own = got[by, 1:] - np.stack([place[own[by]]] * 2 + [np.zeros(len(by), np.int64)], 1), own[by] + g.terminals
    wanted = np.zeros(len(g.size), bool)
    wanted[own] = True
    begins, ends = np.searchsorted(own, np.arange(len(g.size))), np.searchsorted(own, np.arange(len(g.size)), side="right")
    for sym, at in g.derived(wanted):
        count = ends[sym] - begins[sym]
        rows = got[spread(begins[sym], count)]
        rows[:, :2] += np.repeat(at, count)[:, None]
        spans.append(rows)
    start, end, period = np.concatenate(spans).T
    by = np.lexsort((-end, start, period))
    start, end, period = start[by], end[by], period[by]
    reach = np.cumsum(np.diff(period, prepend=0) != 0) * (len(text) + 1) + end
    whole = reach > np.concatenate(([-1], np.maximum.accumulate(reach)[:-1])) if len(reach) else np.zeros(0, bool)
    out = np.stack((start, end - start, period), 1)[whole]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def find(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Runs (start, length, period) of all documents, numbered through, and where each document ends; docs: lists of words."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    words = np.fromiter(map(number.__getitem__, chain.from_iterable(docs)), np.int64)
    ends = np.cumsum(np.array([len(d) for d in docs], np.int64))
    first, many = parts(words, ends)
    if not len(first):
        return np.zeros((0, 3), np.int64), ends
    origin = spread(first, many + 1)
    text = words[np.minimum(origin, len(words) - 1)]
    at = np.concatenate(([0], np.cumsum(many + 1)))
    text[at[1:] - 1] = -1
    out = runs(text, at[:-1], many)
    out[:, 0] = origin[out[:, 0]]
    return out[np.lexsort((out[:, 2], out[:, 0]))], ends


RESULT = "runs array<struct<start: long, length: long, period: long>>, collapsed string"


def periodic_runs(docs: DataFrame, keep: tuple = ("doc_id",)) -> DataFrame:
    """``keep`` columns, runs (start in words, length, period; by start, then period) and the words, joined by spaces, without those that a run has after its first period."""
    keep, kinds = tuple(c for c in keep if c not in ("runs", "collapsed")), dict(docs.dtypes)

    def made(batch: pa.RecordBatch):
        raw, at = [len(t.as_buffer()) if t.is_valid else 0 for t in batch["text"].cast(pa.large_binary())], 0
        while at < batch.num_rows:
            end, size = at + 1, raw[at]
            while end < batch.num_rows and (size := size + raw[end]) <= PART:
                end += 1
            part = batch.slice(at, end - at)
            words = [(t or b"").split() for t in part["text"].cast(pa.large_binary()).to_pylist()]
            found, ends = find(words)
            own = np.searchsorted(ends, found[:, 0], side="right")
            begins = ends - np.array([len(d) for d in words], np.int64)
            all_runs, gone = [[] for _ in words], np.zeros(int(ends[-1]) + 1, np.int64)
            np.add.at(gone, found[:, 0] + found[:, 2], 1)
            np.add.at(gone, found[:, 0] + found[:, 1], -1)
            stay = np.cumsum(gone) == 0
            for d, (start, length, period) in zip(own.tolist(), (found - np.stack([begins[own]] + [np.zeros(len(own), np.int64)] * 2, 1)).tolist()):
                all_runs[d].append({"start": start, "length": length, "period": period})
            kept = [[w for w, s in zip(d, stay[a : a + len(d)].tolist()) if s] if r else d for d, r, a in zip(words, all_runs, begins.tolist())]
            yield {c: part[c] for c in keep} | {"runs": all_runs, "collapsed": [b" ".join(d).decode() for d in kept]}
            at = end

    head = "".join(f"`{c}` {kinds[c]}, " for c in keep)
    return map_arrow(docs.select(*dict.fromkeys((*keep, "text"))), head + RESULT, made)


def made_periodic(docs: DataFrame) -> DataFrame:
    """doc_id and text; of every tenth document (by CRC-32 of its id) the words from some place on repeat the first of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    n, g = F.size("w"), F.expr("h div 10")
    a = g % n
    p = 1 + F.expr("(size(w) - a) div (3 + h div 10 % 8)")
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w")).withColumn("a", F.when(n > 0, a).cast("int")).withColumn("p", p.cast("int"))
    repeated = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[a + (i - a) % p])), ' ')")
    return rows.select("doc_id", F.when(n > 0, repeated).otherwise(F.col("text")).alias("text"))


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of greatest length by period (ties: the first), and SHA-256 of the runs and of the collapsed text."""
    best = F.expr("aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    out = rows.withColumn("b", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "b.start", "b.length", "b.period", F.expr("1000 * b.length div b.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
