"""Repeated byte strings, by suffix order of a collection, and their removal.

A string of ``length`` bytes that starts in two places must be found at both. Building one transform over whole
documents takes a round per byte of the longest, each over all data, so documents are cut first: the least
hash among the ``k``-byte strings of a window is the same in equal windows, so the runs of windows that share its
place (segments of at most 2 * length - k bytes) are dealt by it to buckets, and equal windows always meet in one
bucket. Hashes that occur once are dropped, equal segments of a bucket are held once with their number, and a
bucket needs no order if it has one distinct segment or if each of its segments repeats as a whole. The others go,
whole buckets at a time, into collections of about ``collection`` strings for ``bwt.repeated_starts``, which inserts a
symbol of each string a round. All windows of a bucket hold its k-byte string, so it stands there as two symbols
that only this bucket has: equal windows stay equal, different ones different, and the rounds are fewer by k.
Buckets of more than ``hot`` distinct segments are cut anew with a longer k, at last with k = length, so none is
unbounded.

Matches never cross documents. Null and empty texts have nothing to remove. Repeated rows repeat each other. An
empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt import repeated_starts, windows
from .common import discard, map_arrow, materialise

LEVELS = (112, 160, 200)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-byte strings: linear ones of power-of-two lengths by doubling, of others from two that overlap, mixed at the end."""
    h, size, weight = data.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15

    def join(left, right):
        return left * np.uint64(weight) + right

    while size * 2 <= k:
        h, size, weight = join(h[:-size], h[size:]), size * 2, (weight * 0xD1342543DE82EF95 + 2) % (1 << 64)
    if size < k:
        h = join(h[: len(h) - (k - size)], h[k - size :])
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        h, size = np.minimum(h[:-size], h[size:]), size * 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if size < width else h


def segments(data: bytes, k: int, length: int, part: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, least hash (signed) and its place of each run of windows whose leftmost least hash stands in the same place."""
    firsts, least, places, width = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], length - k + 1
    for a in range(0, len(data) - length + 1, part):
        h = gram_hashes(np.frombuffer(data[a : a + part + length - 1], np.uint8), k)
        low = sliding_least(h, width)
        change = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (h[: len(low) - 1] == low[:-1]))))
        firsts.append(change + a)
        least.append(low[change])
        place = change + width - 1  # what came in, if it is less than the least so far
        look = np.flatnonzero(low[change] >= low[np.maximum(change - 1, 0)])
        views = windows(h, width)
        for i in range(0, len(look), 4096):
            at = change[look[i : i + 4096]]
            place[look[i : i + 4096]] = at + views[at].argmin(1)
        places.append(place + a)
    return np.concatenate(firsts), np.concatenate(least).view(np.int64), np.concatenate(places)


def squeezed(buckets: list[list[tuple[bytes, int]]], k: int) -> list[bytes] | None:
    """Strings of (segment, place of the key) of each bucket with the key as two symbols; None if too few symbols are free."""
    used = np.zeros(256, bool)
    for b in buckets:
        for seg, _ in b:
            used[np.frombuffer(seg, np.uint8)] = True
    known, free = int(used.sum()), math.isqrt(max(0, len(buckets) - 1)) + 1
    if known + free > 255:
        return None
    code = np.zeros(256, np.uint8)
    code[used] = np.arange(known)
    table, out = code.tobytes(), []
    for n, b in enumerate(buckets):
        name = bytes((known + n // free, known + n % free))
        out += [seg[:at].translate(table) + name + seg[at + k :].translate(table) for seg, at in b]
    return out


def _runs(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [{"a": a, "b": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


def find(strings: DataFrame, length: int = 200, hot: int = 2048, collection: int = 4096, level: int = 0) -> DataFrame:
    """(k1, k2, a, b): runs [a, b) of window starts that are repeated. strings: k1, k2 (their key), data, many (counts as two)."""
    k = min(LEVELS[level], length) if level < len(LEVELS) - 1 else length

    def mark(batch: pa.RecordBatch):
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            made = [segments(d.as_py() or b"", k, length) for d in part["data"]]
            again = []
            for _, least, _ in made:
                least = np.sort(least)
                again.append(np.unique(least[1:][least[1:] == least[:-1]]))
            yield {"k1": part["k1"], "k2": part["k2"], "firsts": [m[0] for m in made], "least": [m[1] for m in made], "places": [m[2] - m[0] for m in made], "again": again}

    marks = map_arrow(strings.where(F.octet_length("data") >= length).select("k1", "k2", "data"), "k1 long, k2 long, firsts array<int>, least array<long>, places array<int>, again array<long>", mark)
    marks = materialise(marks.withColumn("id", F.monotonically_increasing_id()), f"suffix-marks-{level}")
    rows = marks.select("id", "again", F.explode(F.array_distinct("least")).alias("key")).select("id", "key", F.when(F.array_contains("again", F.col("key")), 2).otherwise(1).alias("c"))
    shared = rows.groupBy("key").agg(F.sum("c").alias("n")).where("n > 1").select("key")
    kept = rows.select("id", "key").join(shared, "key").groupBy("id").agg(F.collect_list("key").alias("wanted"))
    wanted = marks.join(kept, "id").select("k1", "k2", "firsts", "least", "places", "wanted").dropDuplicates(["k1", "k2"])

    def cut(batch: pa.RecordBatch):
        for i in range(0, batch.num_rows, 64):
            out: list[tuple] = []
            for r in batch.slice(i, 64).to_pylist():
                data, firsts, least, keep, own = r["data"], r["firsts"], r["least"], set(r["wanted"]), {}
                ends = [*firsts[1:], len(data) - length + 1]
                for a, b, key, place in zip(firsts, ends, least, r["places"]):
                    if key in keep:
                        own.setdefault((key, place, data[a : b + length - 1]), []).append(a)
                for (key, place, seg), starts in own.items():
                    h = xxhash.xxh3_128_digest(seg)
                    out.append((r["k1"], r["k2"], key, int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True), starts, place, len(seg) - length + 1, r["many"], seg))
            yield {c: [o[n] for o in out] for n, c in enumerate(("k1", "k2", "key", "s1", "s2", "starts", "place", "wide", "many", "seg"))}

    met = strings.withColumnsRenamed({"k1": "d1", "k2": "d2"}).join(wanted, (F.col("d1") == F.col("k1")) & (F.col("d2") == F.col("k2"))).drop("d1", "d2")
    occ = materialise(map_arrow(met.select("k1", "k2", "data", "many", "firsts", "least", "places", "wanted"), "k1 long, k2 long, key long, s1 long, s2 long, starts array<long>, place int, wide int, many boolean, seg binary", cut), f"suffix-segments-{level}")
    discard(marks)
    #: k1, k2 and at are those of the one occurrence where n is 1; of others nothing reads them.
    classes = occ.groupBy("key", "s1", "s2").agg(F.sum(F.size("starts") + F.col("many").cast("int")).alias("n"), F.first("place").alias("place"), F.first("seg").alias("seg"), F.first("k1").alias("k1"), F.first("k2").alias("k2"), F.first(F.col("starts")[0]).alias("at"))
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()), f"suffix-classes-{level}")
    sizes = classes.groupBy("key").agg(F.count("*").alias("size"), F.min("n").alias("least_n")).where("size > 1 and least_n = 1").drop("least_n")
    sized = classes.join(sizes, "key")

    def order(batches):
        held: list[dict] = []

        def done(rows: list[dict]):
            buckets: list[list[tuple[bytes, int]]] = []
            for n, r in enumerate(rows):
                if not n or rows[n - 1]["key"] != r["key"]:
                    buckets.append([])
                buckets[-1].append((r["seg"], r["place"]))
            small = squeezed(buckets, k)
            found = repeated_starts(small, length - k + 2, [r["place"] for r in rows]) if small else repeated_starts([r["seg"] for r in rows], length)
            new = [(r["k1"], r["k2"], r["at"] + x["a"], r["at"] + x["b"]) for r, f in zip(rows, found) if r["n"] == 1 and f.any() for x in _runs(f)]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in new], pa.int64()) for i in range(4)], names=["k1", "k2", "a", "b"])

        for batch in batches:
            for r in batch.to_pylist():
                if len(held) >= collection and held[-1]["key"] != r["key"]:
                    yield done(held)
                    held = []
                held.append(r)
        if held:
            yield done(held)

    ordered = sized.where(F.col("size") <= hot).select("key", "n", "place", "seg", "k1", "k2", "at").repartition("key").sortWithinPartitions("key")
    found = ordered.mapInArrow(order, "k1 long, k2 long, a long, b long")
    over = sized.where(F.col("size") > hot)
    if k < length:
        over = materialise(over.select("cid", "k1", "k2", "at", F.col("seg").alias("data"), (F.col("n") > 1).alias("many")), f"suffix-hot-{level}")
        if not over.isEmpty():
            inner = find(over.select(F.col("cid").alias("k1"), F.lit(0).cast("long").alias("k2"), "data", "many"), length, hot, collection, level + 1).select(F.col("k1").alias("cid"), "a", "b")
            found = found.union(inner.join(over.where("not many").drop("data"), "cid").select("k1", "k2", F.col("at") + F.col("a"), F.col("at") + F.col("b")))
    found = materialise(found, f"suffix-found-{level}")
    whole = occ.select("k1", "k2", "key", "s1", "s2", "starts", "wide").join(classes.where("n > 1").select("key", "s1", "s2"), ["key", "s1", "s2"])
    return found.union(whole.select("k1", "k2", F.explode("starts").alias("a"), "wide").select("k1", "k2", "a", F.col("a") + F.col("wide")))


def strings_of(docs: DataFrame) -> DataFrame:
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k1"), F.xxhash64("text").alias("k2"), data.alias("data"), F.lit(False).alias("many"))


def remove(docs: DataFrame, length: int = 200, with_kept: bool = False, **how) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept, spans]) of every document."""
    found = find(strings_of(docs), length, **how)
    spans = found.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("runs")).withColumnsRenamed({"k1": "r1", "k2": "r2"})
    spans = materialise(spans, "suffix-spans")
    src = docs.select(F.col("doc_id").cast("long"), "text").withColumn("k1", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("k2", F.xxhash64("text"))
    met = src.join(spans, (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2")), "left").select("doc_id", "text", "runs")

    def one(text: str | None, runs: list | None):
        data, merged = (text or "").encode(), []
        for r in runs or ():
            a, b = r["a"], r["b"] + length - 1
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        at, parts = 0, []
        for a, b in merged:
            parts.append(data[at:a])
            at = b
        kept = b"".join([*parts, data[at:]])
        return len(data), len(data) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept if with_kept else None, [{"start": a, "end": b} for a, b in merged] if with_kept else None

    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]

    def rows(batch: pa.RecordBatch):
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            made = [one(t.as_py(), r.as_py()) for t, r in zip(part["text"], part["runs"])]
            yield {"doc_id": part["doc_id"]} | {c: [m[n] for m in made] for n, c in enumerate(names)}

    out = map_arrow(met, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start: long, end: long>>", rows)
    return out if with_kept else out.drop("kept", "spans")
