"""Near-duplicates of word shingles by an exact prefix-filter join.

Groups are the components of all pairs with a Jaccard similarity of their five-word shingle sets of 0.8 or more.
Fingerprint blocks meet such pairs only with some chance, and that falls with the input, so pairs meet on shingles
instead. With the shingles of every text in one fixed order, two sets of similarity s share one among the first
(1 - s) n + 1 of the larger and the first (1 - 2s / (1 + s)) n + 1 of the smaller; these prefixes are joined. A pair
is dropped before it is verified only where sizes or what follows the first common shingle rule it out. This holds
for any order; so that few pairs meet, shingles that are frequent in a sample of ``sample`` texts (at most
``frequent`` of them are kept) come last.

Pairs are verified by their whole shingle sets, in two rounds. The first links texts to a hub for each shingle of
their prefix: of its texts, the one that shares most of its own prefix with others, which among edited copies is the
least edited. The second takes all pairs that are not yet in one component, so that copies of one text need no
verification of each with each, and no pair that could join two components is left out.

Equal texts are held once. Texts without words equal each other. Rows repeated with doc_id and text count once. A
null doc_id is the smallest. An empty table gives an empty result. Other columns stay, whatever
their names.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, fresh, map_arrow, materialise
from .simhash import shingle_hashes


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, width), np.uint64).view(np.int64))


def keyed(docs: DataFrame) -> DataFrame:
    """k (doc_id, null as the least long), h1 and h2 (hashes of the text) and text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"), "text")


def frequent_shingles(texts: DataFrame, n: int, width: int, sample: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and in how many texts of the sample they are."""
    share = min(1_000_000, math.ceil(1e6 * sample / max(1, n)))

    def rows(batch: pa.RecordBatch):
        for i in range(0, batch.num_rows, 200):
            own = [shingle_set(t.as_py(), width) for t in batch["text"][i : i + 200]]
            yield {"s": np.concatenate(own)}

    found = map_arrow(texts.where(F.pmod("h2", F.lit(1_000_000)) < share).select("text"), "s long", rows)
    top = found.groupBy("s").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "s").limit(most).toPandas().sort_values("s")
    return top["s"].to_numpy(np.int64), top["n"].to_numpy(np.int64)


def sketch(docs: DataFrame, width: int, similarity: float, sample: int, most: int) -> DataFrame:
    """rid, k, h1, h2, size (shingles) and prefix of every distinct text; k is its first doc_id."""
    heads = materialise(keyed(docs).groupBy("h1", "h2").agg(F.min("k").alias("k")), "neardup-texts")
    texts = keyed(docs).join(heads, ["h1", "h2", "k"], "left_semi")
    often, df = frequent_shingles(texts, heads.count(), width, sample, most)
    s = Fraction(str(similarity))

    def rows(batch: pa.RecordBatch) -> dict:
        sizes, prefixes = [], []
        for t in batch["text"]:
            own = shingle_set(t.as_py(), width)
            at = np.minimum(np.searchsorted(often, own), max(0, len(often) - 1))
            rank = np.where(often[at] == own, df[at], 0) if len(often) else np.zeros(len(own), np.int64)
            sizes.append(len(own))
            prefixes.append(own[np.lexsort((own, rank))][: len(own) - math.ceil(s * len(own)) + 1])
        return {"k": batch["k"], "h1": batch["h1"], "h2": batch["h2"], "size": sizes, "prefix": prefixes}

    made = map_arrow(texts, "k long, h1 long, h2 long, size int, prefix array<long>", rows).dropDuplicates(["h1", "h2"])
    sk = materialise(made.withColumn("rid", F.monotonically_increasing_id()), "neardup-sketch")
    discard(heads)
    return sk


def similar(docs: DataFrame, sk: DataFrame, pairs: DataFrame, width: int, s: Fraction) -> DataFrame:
    """(u, v): the pairs (a, b) whose shingle sets are similar."""
    near = materialise(pairs, "neardup-pairs")
    wanted = near.select(F.col("a").alias("rid")).union(near.select("b")).distinct().join(sk.select("rid", "k", "h1", "h2"), "rid")
    texts = keyed(docs).join(wanted, ["k", "h1", "h2"]).select("rid", "text")

    def rows(batch: pa.RecordBatch) -> dict:
        return {"rid": batch["rid"], "own": [shingle_set(t.as_py(), width) for t in batch["text"]]}

    sets = materialise(map_arrow(texts, "rid long, own array<long>", rows).dropDuplicates(["rid"]), "neardup-sets")
    both = near.join(sets.select(F.col("rid").alias("a"), F.col("own").alias("sa")), "a").join(sets.select(F.col("rid").alias("b"), F.col("own").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    enough = common * s.denominator >= (F.size("sa") + F.size("sb") - common) * s.numerator
    found = materialise(both.where(enough).select(F.col("a").alias("u"), F.col("b").alias("v")), "neardup-links")
    discard(near, sets)
    return found


def links(docs: DataFrame, sk: DataFrame, width: int, similarity: float) -> DataFrame:
    """(u, v): links between rids with the components of all similar pairs."""
    s = Fraction(str(similarity))
    p, q = s.numerator, s.denominator
    tokens = sk.select("rid", "size", F.posexplode("prefix").alias("pos", "token")).repartition("token")
    shared = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    met = materialise(tokens.join(shared, "token"), "neardup-met")

    def possible(sa, pa_, sb, pb):
        """Sizes and what follows a first common shingle allow the similarity."""
        overlap = F.least(sa - pa_, sb - pb)
        return (F.least(sa, sb) * q >= F.greatest(sa, sb) * p) & (overlap * (p + q) >= (sa + sb) * p)

    share = met.groupBy("rid").agg((F.count("*") / F.first("size")).alias("share"))
    scored = met.join(share, "rid")
    hubs = scored.groupBy("token").agg(F.max(F.struct("share", "rid", "size", "pos")).alias("hub"))
    first = met.join(hubs, "token").where((F.col("hub.rid") != F.col("rid")) & possible(F.col("hub.size"), F.col("hub.pos"), F.col("size"), F.col("pos")))
    none = sk.where("size = 0").select("rid")
    blank = none.crossJoin(none.agg(F.min("rid").alias("u"))).where("rid <> u").select("u", F.col("rid").alias("v"))
    linked = similar(docs, sk, first.select(F.least("hub.rid", "rid").alias("a"), F.greatest("hub.rid", "rid").alias("b")).distinct(), width, s)
    known = materialise(linked.union(blank), "neardup-known")

    roots = connected_components(known)
    held = materialise(met.join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid")), "neardup-held")
    discard(met, linked, roots)
    index = held.where(F.col("pos") * (p + q) <= F.col("size") * (q - p))
    a, b = (x.select("token", *[F.col(c).alias(f"{c}_{side}") for c in ("rid", "size", "pos", "root")]) for x, side in ((index, "a"), (held, "b")))
    earlier = (F.col("size_a") < F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("rid_a") < F.col("rid_b")))
    apart = F.col("root_a") != F.col("root_b")
    rest = a.hint("merge").join(b, "token").where(earlier & apart & possible(F.col("size_a"), F.col("pos_a"), F.col("size_b"), F.col("pos_b")))
    more = similar(docs, sk, rest.select(F.col("rid_a").alias("a"), F.col("rid_b").alias("b")).distinct(), width, s)
    found = materialise(known.union(more), "neardup-all")
    discard(held, known, more)
    return found


def representatives(docs: DataFrame, width: int = 5, similarity: float = 0.8, sample: int = 20_000, frequent: int = 200_000) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of each group of near-duplicates."""
    names = [fresh(c, docs) for c in ("k", "h1", "h2")]
    sk = sketch(docs, width, similarity, sample, frequent)
    found = links(docs, sk, width, similarity)
    roots = connected_components(found)
    named = sk.select("rid", "k", "h1", "h2").join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    first = materialise(named.groupBy("root").agg(F.min(F.struct("k", "h1", "h2")).alias("f")).select("f.*").toDF(*names), "neardup-first")
    discard(sk, found, roots)
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    own = (k, F.xxhash64("text"), F.xxhash64(F.lit(7), "text"))
    kept = docs.join(first.hint("merge"), [a == F.col(b) for a, b in zip(own, names)])
    return kept.dropDuplicates(names).drop(*names)
