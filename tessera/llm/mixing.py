"""Mixing sources to target weights.

The words of each source form one stream (its documents in hash order of doc_id), cut into blocks of
``block_words``. The mix is a number of slots, dealt to output shards of ``shard_slots``. Each shard draws its
sources' counts from a multinomial with its own seed; the n-th slot of a source takes block perm_e(n mod B) of
that source's B blocks, where perm_e is a keyed Feistel permutation for the e-th pass, so passes differ and no
block is taken twice in one pass. Slots meet blocks in a join by (source, index).

What the independent draws give a source above or below its quota is settled by moving its last slots to
sources that are short, so each source takes its target to within a block, and none more than ``cap`` passes.
Everything depends only on the table and ``seed``: reruns agree.

Targets: sources in code point order, null last, have the weights 5, 2, 1, repeating, and share ``share`` times
all words; a target stops at ``cap`` times its source's words and the excess is shared anew by weight.
Null texts have no words; their documents are returned and take nothing. An empty table gives no rows. The
list of sources and their sums is held by the driver (a mix is configured by source); nothing else is.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, map_arrow, materialise

WEIGHTS = (5, 2, 1)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Mix(NamedTuple):
    docs: DataFrame  # rid, doc_id, source, src, size
    pieces: DataFrame  # src, block, rid, from_word, words: which words of which document a block holds
    slots: DataFrame  # shard, slot, src, pass (of the source's blocks), block
    sources: list  # (source, words, target) in order; src is the index


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS) -> list[float]:
    """Water-filling: shares by weight, stopped at cap times the size, the excess reshared until none is above."""
    out, rest, free = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while free:
        weight = sum(weights[i % len(weights)] for i in free)
        over = [i for i in sorted(free) if rest * weights[i % len(weights)] / weight > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = rest * weights[i % len(weights)] / weight
            break
        for i in over:
            out[i] = cap * sizes[i]
            free.remove(i)
        rest = share * sum(sizes) - sum(out[i] for i in range(len(sizes)) if i not in free)
    return out


def permuted(k: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Position k of a pseudorandom permutation of 0..n-1 chosen by key (uint64), by a Feistel network and cycle walking."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2).astype(np.float64) + 1) / 2)).astype(np.uint64)
    mask, x = (np.uint64(1) << half) - np.uint64(1), k.astype(np.uint64)
    n = n.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        m, h, y = mask[todo], half[todo], x[todo]
        left, right = y >> h, y & m
        for r in range(4):
            f = right + key[todo] + np.uint64(0x9E3779B97F4A7C15 * (r + 1) % (1 << 64))
            f = (f ^ (f >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f ^ (f >> np.uint64(31))) & m)
        x[todo] = (left << h) | right
        todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


def running(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over a key's earlier rows, in the order of bucket, then ``order``.

    Rows of a key are summed bucket by bucket, and only the buckets' sums meet, so a hot key has many tasks.
    """
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("__sum"))
    base = sums.select(*keys, bucket, (F.sum("__sum").over(Window.partitionBy(*keys).orderBy(bucket)) - F.col("__sum")).alias("__base"))
    inside = F.sum(value).over(Window.partitionBy(*keys, bucket).orderBy(*order)) - F.col(value)
    return df.withColumn("__inside", inside).join(base, [*keys, bucket]).withColumn("before", F.col("__base") + F.col("__inside")).drop("__base", "__inside", bucket)


def mix(docs: DataFrame, block_words: int = 64, shard_slots: int = 16_384, share: float = 1.5, cap: float = 2.0, seed: int = 17, bucket_rows: int = 2000, rid: Column | None = None) -> Mix:
    """rid: a number that is each row's own and stays so when ``docs`` is read again; made here if not given."""
    spark = docs.sparkSession
    rid = F.monotonically_increasing_id() if rid is None else rid
    sized = materialise(docs.select(rid.alias("rid"), F.col("doc_id").cast("long"), "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    names, sizes = [r["source"] for r in totals], np.array([r["words"] for r in totals], np.int64)
    goals = targets(sizes.tolist(), share, cap)
    n_blocks = -(-sizes // block_words)
    quota = np.array([min(round(g * b / w), math.floor(cap * b)) if w else 0 for g, w, b in zip(goals, sizes.tolist(), n_blocks.tolist())], np.int64)

    index = spark.createDataFrame([(s, k) for k, s in enumerate(names)], "name string, src int")
    sized = sized.join(F.broadcast(index), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    buckets = max(1, math.ceil(sum(r["n"] for r in totals) / bucket_rows))
    placed = sized.where("size > 0").withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(buckets)))
    placed = running(placed, ["src"], "bucket", ["doc_id", "rid"], "size").withColumnRenamed("before", "at")
    length = F.lit(block_words).cast("long")
    pieces = placed.select("src", "rid", "size", "at", F.explode(F.sequence(F.expr(f"at div {block_words}"), F.expr(f"(at + size - 1) div {block_words}"))).alias("block"))
    start = F.greatest(F.col("block") * length, F.col("at"))
    pieces = pieces.select("src", "block", "rid", (start - F.col("at")).alias("from_word"), (F.least((F.col("block") + 1) * length, F.col("at") + F.col("size")) - start).alias("words"))

    n_slots = int(quota.sum())
    slots = _slots(spark, quota, n_blocks, n_slots, shard_slots, seed) if n_slots else spark.createDataFrame([], "shard long, slot int, src int, pass int, block long")
    return Mix(sized, pieces, slots, list(zip(names, sizes.tolist(), goals)))


def _slots(spark, quota: np.ndarray, n_blocks: np.ndarray, n_slots: int, shard_slots: int, seed: int) -> DataFrame:
    shards, share = -(-n_slots // shard_slots), quota / n_slots

    def draw(batches):
        for batch in batches:
            ids = batch["id"].to_pylist()
            counts = [np.random.default_rng([seed, j]).multinomial(min(shard_slots, n_slots - j * shard_slots), share).tolist() for j in ids]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.list_(pa.int64()))], names=["shard", "counts"])

    drawn = materialise(spark.range(shards).mapInArrow(draw, "shard long, counts array<long>").select("shard", F.posexplode("counts").alias("src", "n")), "mix-draws")
    got = np.zeros(len(quota), np.int64)
    for r in drawn.groupBy("src").agg(F.sum("n").alias("n")).collect():
        got[r["src"]] = r["n"]
    above, below = np.maximum(got - quota, 0), np.maximum(quota - got, 0)
    above_at, below_end = np.cumsum(above) - above, np.cumsum(below)

    def fill(batches):
        for batch in batches:
            for r in batch.to_pylist():
                rng = np.random.default_rng([seed, 1, r["shard"]])
                own = sorted(r["own"], key=lambda x: x["src"])
                src = np.repeat([x["src"] for x in own], [x["n"] for x in own])
                k = np.concatenate([x["first"] + np.arange(x["n"]) for x in own])
                moved = k >= quota[src]
                x = above_at[src[moved]] + k[moved] - quota[src[moved]]
                to = np.searchsorted(below_end, x, side="right")
                src[moved], k[moved] = to, quota[to] - (below_end[to] - x)
                key = (k // n_blocks[src]).astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + src.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(seed)
                block = permuted(k % n_blocks[src], n_blocks[src], key)
                order = rng.permutation(len(src))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(src), r["shard"])), pa.array(np.arange(len(src), dtype=np.int32)), pa.array(src[order].astype(np.int32)), pa.array((k // n_blocks[src])[order].astype(np.int32)), pa.array(block[order])], names=["shard", "slot", "src", "pass", "block"])

    first = running(drawn.withColumn("run", F.expr("shard div 1024")), ["src"], "run", ["shard"], "n")
    own = first.withColumnRenamed("before", "first").groupBy("shard").agg(F.collect_list(F.struct("src", "n", "first")).alias("own"))
    return own.mapInArrow(fill, "shard long, slot int, src int, pass int, block long")


def taken(m: Mix) -> DataFrame:
    """(rid, doc_id, size, source_size, target, taken) of every document.

    Slots and pieces both grow with the input, and no estimate sees how many slots a shard makes: always a merge join.
    """
    met = m.slots.join(m.pieces.hint("merge"), ["src", "block"]).groupBy("rid").agg(F.sum("words").alias("taken"))
    sources = m.docs.sparkSession.createDataFrame([(k, w, t) for k, (_, w, t) in enumerate(m.sources)], "src int, source_size long, target double")
    out = m.docs.join(F.broadcast(sources), "src").join(met, "rid", "left")
    return out.select("rid", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def spans(text: str, own: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Characters [a, b) of ``text`` that runs of its words cover: (first word, number of words), in any order; neighbours become one."""
    words = [m.span() for m in WORD.finditer(text)]
    out, last = [], -1
    for first, n in sorted(own):
        a, b = words[first][0], words[first + n - 1][1]
        if first == last:
            out[-1] = out[-1][0], b
        else:
            out.append((a, b))
        last = first + n
    return out


def resample(docs: DataFrame, seed: int = 17, **how) -> DataFrame:
    """The mix as rows of ``docs``: what the slots take of each row, and nothing else.

    Where a pass over a source's blocks takes the whole row, it is there as it stands; where it takes some of its
    blocks, there is a row for each run of neighbouring ones, with the text from the run's first word to its last and
    the row's other columns, whatever their names. So the words of each source are those of its slots, long documents
    included. Rows without words are not taken; repeated doc_ids are rows of their own.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    rid, runs = fresh("rid", docs), fresh("own", docs)
    held = materialise(docs.withColumn(rid, F.monotonically_increasing_id()), "mix-docs")
    m = mix(held, seed=seed, rid=F.col(rid), **how)
    met = m.slots.join(m.pieces.hint("merge"), ["src", "block"])
    own = met.groupBy("rid", "pass").agg(F.sum("words").alias("all"), F.collect_list(F.struct("from_word", "words")).alias("own"))
    own = own.join(m.docs.select("rid", "size"), "rid").select(F.col("rid").alias(rid), F.when(F.col("all") < F.col("size"), F.col("own")).alias(runs))
    taken_of = held.join(own.hint("merge"), rid).drop(rid)

    def rows(batch: pa.RecordBatch) -> dict:
        at, texts = [], []
        for k, (text, part) in enumerate(zip(batch["text"].to_pylist(), batch[runs].to_pylist())):
            made = [text] if part is None else [text[a:b] for a, b in spans(text, [(r["from_word"], r["words"]) for r in part])]
            texts += made
            at += [k] * len(made)
        index = pa.array(at, pa.int64())
        return {c: texts if c == "text" else batch[c].take(index) for c in kinds}

    return map_arrow(taken_of, ", ".join(f"`{c}` {t}" for c, t in kinds.items()), rows)
