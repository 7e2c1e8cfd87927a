"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints of ``bits`` = 64 are split into four blocks of 16. Two fingerprints that differ in at most two
bits differ in at most two blocks, so they agree on at least two: joining on each of the six pairs of blocks
(32-bit keys) meets every close pair. Buckets of up to ``small`` fingerprints verify their pairs by Hamming
distance; larger ones link through one-bit neighbours instead (two fingerprints within two bits share one),
which finds the same components with rows in proportion to the bucket.

Null or wordless texts have fingerprint zero and are linked like any other. Equal fingerprints always share a
component. An empty table gives an empty result; extra columns are ignored by ``components`` and stay with
``representatives``, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, fresh, map_arrow, materialise

BLOCKS = [0xFFFF << (16 * k) for k in range(4)]
#: Masks of the six pairs of blocks, as signed 64-bit values.
KEYS = [((a | b) ^ (1 << 63)) - (1 << 63) for a, b in combinations(BLOCKS, 2)]


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """XXH64 (seed 42) of every run of ``width`` words of the ASCII-lower-cased text, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    buf = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(buf, 42)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    view, digest = memoryview(buf), xxhash.xxh64_intdigest
    return [digest(view[a:b], 42) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]


def fingerprint(hashes: list[int]) -> int:
    if not hashes:
        return 0
    counts, part = np.zeros(64, np.int64), 1 << 16
    for i in range(0, len(hashes), part):
        raw = np.array(hashes[i : i + part], dtype=">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp: signed long)."""

    def rows(batch: pa.RecordBatch) -> dict:
        made = [fingerprint(shingle_hashes(t.as_py(), width)) for t in batch["text"]]
        return {"doc_id": batch["doc_id"], "fp": np.array(made, np.uint64).view(np.int64)}

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, fp long", rows)


def close_links(fps: DataFrame, small: int = 32) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) with the components of 'at most two bits differ'."""
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(k)) for k in KEYS])).alias("t", "key"))
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = materialise(keyed.join(sizes, ["t", "key"]), "simhash-met")
    tight = met.where(F.col("n") <= small).groupBy("t", "key").agg(F.array_sort(F.collect_list("fp")).alias("m"))
    pairs = tight.select(F.explode("m").alias("u"), "m").select("u", F.explode(F.filter("m", lambda v: (v > F.col("u")) & (F.bit_count(v.bitwiseXOR(F.col("u"))) <= 2))).alias("v"))
    #: Bits that members of bucket t may differ in, and zero for the fingerprint itself.
    flips = [[0] + [((1 << b) ^ (1 << 63)) - (1 << 63) for b in range(64) if not k >> b & 1] for k in KEYS]
    free = F.element_at(F.array(*[F.array(*[F.lit(x) for x in f]) for f in flips]), F.col("t") + 1)
    near = met.where(F.col("n") > small).select("t", "key", "fp", F.explode(F.transform(free, lambda b: F.col("fp").bitwiseXOR(b))).alias("near"))
    hubs = near.groupBy("t", "key", "near").agg(F.min("fp").alias("v"), F.count("*").alias("c")).where("c > 1")
    return pairs.union(near.join(hubs, ["t", "key", "near"]).select(F.col("fp").alias("u"), "v")).where("u <> v").distinct()


def components(docs: DataFrame, width: int = 3, small: int = 32) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links of at most two bits."""
    prints = materialise(fingerprints(docs, width), "simhash-fp")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(close_links(least.select("fp"), small)).withColumnRenamed("node", "fp")
    by_fp = least.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    heads = by_fp.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(by_fp.join(heads, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, width: int = 3, small: int = 32) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id (null is less than any) of each component over links of at most two bits.

    Of several texts under that doc_id, the one with the least hash stays; rows repeated with doc_id and text count once.
    What is stored and met with ``docs`` are the keys of rows that go or are repeated: as long as these are few, no text is shuffled.
    """
    names = [fresh(c, docs) for c in ("k", "h1", "h2")]
    own = (F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), F.xxhash64("text"), F.xxhash64(F.lit(7), "text"))

    def rows(batch: pa.RecordBatch) -> dict:
        made = [fingerprint(shingle_hashes(t.as_py(), width)) for t in batch["text"]]
        return {c: batch[c] for c in ("k", "h1", "h2")} | {"fp": np.array(made, np.uint64).view(np.int64)}

    keyed = docs.select(own[0].alias("k"), own[1].alias("h1"), own[2].alias("h2"), "text")
    prints = materialise(map_arrow(keyed, "k long, h1 long, h2 long, fp long", rows), "simhash-fp")
    least = materialise(prints.groupBy("fp").agg(F.min(F.struct("k", "h1", "h2")).alias("least")), "simhash-least")
    roots = connected_components(close_links(least.select("fp"), small)).withColumnRenamed("node", "fp")
    by_root = least.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root"))
    first = by_root.agg(F.min("least").alias("f")).select("f.*", F.lit(True).alias("first"))
    times = prints.groupBy("k", "h1", "h2").agg(F.count("*").alias("n")).join(first.hint("merge"), ["k", "h1", "h2"], "left")
    marked = times.where("first is null or n > 1").select(*[F.col(c).alias(n) for c, n in zip(("k", "h1", "h2"), names)], "first")
    marked = materialise(marked, "simhash-marked")
    same = [a == F.col(b) for a, b in zip(own, names)]
    kept, again = docs.join(marked.drop("first"), same, "left_anti"), marked.where("first").drop("first")
    if again.isEmpty():
        return kept
    return kept.unionByName(docs.join(again, same).dropDuplicates(names).drop(*names))


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
