"""Line deduplication by pairwise alignment.

The shortest runs of consecutive lines that reach the deletion rule (at least ``least_lines`` lines or
``least_chars`` characters, one line not blank) are hashed: documents share a block that may be deleted just if they
share such runs, however short its lines. Documents that share a hash become pairs: all pairs of a rare hash (in at
most ``rare`` documents), and for the others each document with the first one that has the run. Each pair is aligned
by patience diff (lines unique in both, longest increasing run, then equal neighbours, again between matches), and
aligned blocks that reach the rule are deleted from the later document (larger doc_id, null first; ties by text
hash). A run that brought the pair together but that the diff leaves apart, as its lines are there twice or in
crossed order, goes too. All decisions look at the input texts. A pair's row holds the runs that the two share, and
the diff sees the lines of these runs only: other lines aren't in a block that may be deleted. So what travels and what
a pair costs follow what documents share, not their sizes.

So a line is deleted just if it is in a run of lines that reaches the rule and that an earlier document has too,
whatever pairs were aligned: no pair beyond these can add to that, and no group's pairs are all made. The shared runs
decide; the diff finds them as longer blocks.

Null and empty texts are left as they are. Rows repeated with the same doc_id and text count once and share
their result. Blank lines never reach the rule alone but may be part of a block. Texts without a line end are one
line. An empty table gives an empty result. Other columns stay, whatever their names; one called n_lines or n_removed
gives way to the result's.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, map_arrow, materialise

SPACES = r"^[\x20\x09-\x0D]*$"
#: Runs of lines are hashed as polynomials modulo 2^64, so that any run's hash comes from sums over its document.
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)


def unique_matches(a: list, b: list, alo: int, ahi: int, blo: int, bhi: int) -> list[tuple[int, int]]:
    """Longest run, increasing in both, of lines that occur once in each range."""
    seen: dict = {}
    for i in range(alo, ahi):
        seen[a[i]] = -1 if a[i] in seen else i
    there: dict = {}
    for j in range(blo, bhi):
        there[b[j]] = -1 if b[j] in there else j
    pairs = [(seen[x], j) for x, j in there.items() if j >= 0 and seen.get(x, -1) >= 0]
    tops, ends, back = [], [], [0] * len(pairs)
    for k, (i, _) in enumerate(pairs):  # in order of b
        at = bisect_left(tops, i)
        back[k] = ends[at - 1] if at else -1
        tops[at : at + 1] = [i]
        ends[at : at + 1] = [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Matched lines (i, j) of a patience diff."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo >= ahi or blo >= bhi:
            continue
        i, j = alo, blo
        for x, y in unique_matches(a, b, alo, ahi, blo, bhi):
            todo.append((i, x, j, y))
            out.append((x, y))
            i, j = x + 1, y + 1
        if i > alo:
            todo.append((i, ahi, j, bhi))
    return sorted(out)


def common_blocks(a: list, b: list, lens: list, least_lines: int, least_chars: int, blank: set) -> list[int]:
    """Lines of b in aligned blocks that are long enough; blank lines don't count as lines."""
    out, block = [], []
    for i, j in [*align(a, b), (-2, -2)]:
        if block and (i, j) != (block[-1][0] + 1, block[-1][1] + 1):
            own = [y for _, y in block]
            words = sum(y not in blank for y in own)
            if words >= least_lines or words and sum(lens[y] for y in own) >= least_chars:
                out += own
            block = []
        block.append((i, j))
    return out


def windows(hashes: np.ndarray, lens: np.ndarray, counts: np.ndarray, least_lines: int, least_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (exclusive) of the shortest runs of lines that may be deleted, from every start and to every end.

    hashes and lens hold the lines of several documents, ``counts`` each; no run crosses documents. Each line of a block
    that may be deleted is inside one of these runs that is inside the block: the shortest from the block's start, or
    one that starts or ends at the line. So documents that share a block share all its runs.
    """
    n, first = len(hashes), np.repeat(np.cumsum(counts) - counts, counts)
    stop = first + np.repeat(counts, counts)
    lines = np.concatenate(([0], np.cumsum(lens >= 0)))
    chars = np.concatenate(([0], np.cumsum(np.where(lens >= 0, lens, -1 - lens))))
    at = np.arange(n)
    end = np.maximum(np.searchsorted(lines, lines[:-1] + 1), np.minimum(np.searchsorted(lines, lines[:-1] + least_lines), np.searchsorted(chars, chars[:-1] + least_chars)))
    last = lambda a, x: np.searchsorted(a, x, side="right") - 1
    start = np.minimum(last(lines, lines[1:] - 1), np.maximum(last(lines, lines[1:] - least_lines), last(chars, chars[1:] - least_chars)))
    ahead, back = end <= stop, start >= first
    s, e = np.divmod(np.unique(np.concatenate(((at * (n + 1) + end)[ahead], (start * (n + 1) + at + 1)[back]))), n + 1)
    power = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, BASE, np.uint64))))
    undo = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, INVERSE, np.uint64))))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes.view(np.uint64) * power[:n])))
    h = (sums[e] - sums[s]) * undo[s] + (e - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return h.view(np.int64), s, e


def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column without nulls as one array of longs, and the length of each list."""
    counts = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts.astype(np.int64)


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), then first[1], ..."""
    ends = np.cumsum(count)
    return np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


def lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values) if isinstance(values, np.ndarray) else values)


def sketch(docs: DataFrame, least_lines: int, least_chars: int) -> DataFrame:
    """k (doc_id, null first), th (hash of the text) and runs, once per distinct (doc_id, text).

    A run: its hash, the lines where it begins, and the hashes and lengths (negative: blank) of its lines.
    """
    own_lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    own = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k"), F.xxhash64("text").alias("th"), F.transform(own_lines, lambda x: F.xxhash64(x)).alias("hashes"),
        F.transform(own_lines, lambda x: F.when(x.rlike(SPACES), -1 - F.char_length(x)).otherwise(F.char_length(x))).alias("lens"),
    )

    def rows(batch: pa.RecordBatch) -> dict:
        hashes, counts = flat(batch["hashes"])
        lens = flat(batch["lens"])[0]
        h, s, e = windows(hashes, lens, counts, least_lines, least_chars)
        doc, first = np.repeat(np.arange(len(counts)), counts)[s], (np.cumsum(counts) - counts)
        order = np.lexsort((s, h, doc))
        h, s, e, doc = h[order], s[order], e[order], doc[order]
        new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))) if len(h) else np.zeros(0, np.int64)
        size = (e - s)[new]
        at = spread(s[new], size)
        places = lists((s - first[doc]).astype(np.int32), np.diff(new, append=len(h)))
        run = pa.StructArray.from_arrays([pa.array(h[new]), places, lists(hashes[at], size), lists(lens[at].astype(np.int32), size)], ["h", "at", "lines", "lens"])
        return {"k": batch["k"], "th": batch["th"], "runs": lists(run, np.bincount(doc[new], minlength=len(counts)))}

    made = map_arrow(own, "k long, th long, runs array<struct<h: long, at: array<int>, lines: array<long>, lens: array<int>>>", rows)
    return materialise(made.groupBy("k", "th").agg(F.first("runs").alias("runs")), "lines-sketch")


def candidates(once: DataFrame, rare: int) -> DataFrame:
    """(ka, ta, kb, tb, runs): pairs of documents, the earlier one first, and the runs that they share with their places (a, b) in both."""
    occ = once.select(F.explode("runs").alias("r"), "k", "th").select("r.h", F.struct("k", "th", "r.at").alias("b"), "r.lines", "r.lens")
    counts = occ.groupBy("h").agg(F.count("*").alias("df"), F.min("b").alias("a")).where("df > 1")
    met = materialise(occ.join(counts.hint("merge"), "h"), "lines-shared")
    few = met.where(F.col("df") <= rare).groupBy("h").agg(F.collect_list("b").alias("m"), F.first("lines").alias("lines"), F.first("lens").alias("lens"))
    few = few.select("*", F.explode("m").alias("b")).select("h", F.explode("m").alias("a"), "b", "lines", "lens")
    both = few.union(met.where(F.col("df") > rare).select("h", "a", "b", "lines", "lens")).where("a < b")
    found = both.groupBy(F.col("a.k").alias("ka"), F.col("a.th").alias("ta"), F.col("b.k").alias("kb"), F.col("b.th").alias("tb")).agg(F.collect_list(F.struct(F.col("a.at").alias("a"), F.col("b.at").alias("b"), "lines", "lens")).alias("runs"))
    pairs = materialise(found, "lines-pairs")
    discard(met)
    return pairs


def excerpt(runs: list[dict], side: str) -> tuple[list[int], list, list[int]]:
    """Numbers, hashes and lengths of a document's lines in the runs, in order; between lines that aren't neighbours stands one that nothing equals."""
    found = {x + i: (line, n) for r in runs for x in r[side] for i, (line, n) in enumerate(zip(r["lines"], r["lens"]))}
    at, lines, lens = [], [], []
    for k in sorted(found):
        if at and at[-1] != k - 1:
            at.append(-1), lines.append((side, k)), lens.append(-1)
        at.append(k), lines.append(found[k][0]), lens.append(found[k][1])
    return at, lines, lens


def shared_lines(runs: list[dict], least_lines: int, least_chars: int) -> list[int]:
    """Lines of the later document that go, of a pair with these runs: its aligned blocks, and the runs that the diff leaves apart."""
    (_, a, _), (at, b, lens) = excerpt(runs, "a"), excerpt(runs, "b")
    blank = {j for j, n in enumerate(lens) if n < 0}
    gone = {at[j] for j in common_blocks(a, b, [n if n >= 0 else -1 - n for n in lens], least_lines, least_chars, blank)}
    for r in runs:
        for x in r["b"]:
            gone.update(range(x, x + len(r["lines"])))
    return sorted(gone)


def removed_lines(docs: DataFrame, rare: int = 4, least_lines: int = 2, least_chars: int = 100) -> DataFrame:
    """(k, th, removed): indexes of the lines to delete, for documents that lose any."""
    once = sketch(docs, least_lines, least_chars)
    pairs = candidates(once, rare)

    def rows(batch: pa.RecordBatch) -> dict:
        return {"k": batch["kb"], "th": batch["tb"], "removed": [shared_lines(r.as_py(), least_lines, least_chars) for r in batch["runs"]]}

    cut = map_arrow(pairs.select("kb", "tb", "runs"), "k long, th long, removed array<int>", rows)
    found = materialise(cut.groupBy("k", "th").agg(F.array_distinct(F.flatten(F.collect_list("removed"))).alias("removed")), "lines-cut")
    discard(once, pairs)
    return found


def dedup(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with text after deletion, and n_lines and n_removed of the input; all other columns as they are."""
    docs = docs.drop("n_lines", "n_removed")
    k, th, gone = (fresh(c, docs) for c in ("k", "th", "removed"))
    cut = removed_lines(docs, **how).toDF(k, th, gone)
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    met = docs.join(cut.hint("merge"), (own == F.col(k)) & (F.xxhash64("text") == F.col(th)), "left")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def rows(batch: pa.RecordBatch) -> dict:
        texts, n, lost = [], [], []
        for text, removed in zip(batch["text"].to_pylist(), batch[gone].to_pylist()):
            lines = [] if text is None else text.split("\n")
            n.append(len(lines))
            lost.append(len(removed or ()))
            if removed:
                keep = np.ones(len(lines), bool)
                keep[removed] = False
                text = "\n".join([x for x, k in zip(lines, keep) if k])
            texts.append(text)
        return {c: batch[c] for c in kinds} | {"text": texts, "n_lines": n, "n_removed": lost}

    schema = ", ".join(f"`{c}` {t}" for c, t in kinds.items())
    return map_arrow(met.select(*[F.col(f"`{c}`") for c in kinds], gone), f"{schema}, n_lines long, n_removed long", rows)
