"""Phrases of two to four words that occur more often than their parts let expect, per language.

Phrases are counted by sorting suffix pointers: every word of a piece stands for the up to four words from there on. A
first pass counts words, exactly. Pointers whose first or second word cannot be frequent are dropped, and others end
before the first such word; tasks know these words by a bitmap of fixed size that is set for all frequent ones, so it may
let others through but loses none. Equal pointers of a task become one with their number. They are routed by their leading
two words to buckets, whose number grows with the words; where both words are very frequent (more than ``bucket`` times)
by three, and where the third is too, by all four; the counts of the shorter phrases then go ahead as pointers that end
there. So a bucket has a bounded load whatever is frequent. In a bucket a multikey quicksort with three-way partitions sorts
pointers word by word; the sizes of the equal partitions are the counts, and partitions of less than ``least`` are left.

The text's A-Z are lower-cased, pieces end at ``.,;:!?`` and line ends, words at spaces and tabs. A null language is
``und``, null and empty texts have no words. Repeated rows count again. An empty table gives an empty result. Columns other
than text and lang are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialise

WIDTH, BITS, PART, HELD = 4, 1 << 24, 4 << 20, 3 << 19
ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
TOKEN = re.compile(rb"[^ \n]+|\n")
MIX = np.uint64(0x9E3779B97F4A7C15)


def streams(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(lang, text) in parts of about PART bytes, lower-cased, pieces apart by line ends; no piece is cut."""
    for batch in batches:
        own = defaultdict(list)
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.large_binary()).to_pylist()):
            if text:
                own["und" if lang is None else lang].append(text)
        for lang, texts in own.items():
            data, at = b"\n".join(texts).lower().translate(ENDS), 0
            while at < len(data):
                end = data.rfind(b"\n", at, at + PART) if at + PART < len(data) else len(data)
                if end <= at:
                    end = data.find(b"\n", at + PART)
                end = len(data) if end < 0 else end
                yield lang, data[at:end]
                at = end + 1


def count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, f), each word once a task."""
    found: dict[str, defaultdict] = {}
    counts: dict[str, np.ndarray] = {}
    for lang, data in streams(batches):
        number = found.setdefault(lang, defaultdict())
        number.default_factory = number.__len__
        new = np.bincount(np.fromiter(map(number.__getitem__, TOKEN.findall(data)), np.int64), minlength=len(number))
        new[: len(counts.get(lang, ()))] += counts.get(lang, 0)
        counts[lang] = new
    for lang, number in found.items():
        rows = ((w, f) for w, f in zip(number, counts[lang].tolist()) if w != b"\n")
        while part := list(islice(rows, 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([w.decode() for w, _ in part]), pa.array([f for _, f in part], pa.int64())], names=["lang", "word", "f"])


def bitmap(words: DataFrame) -> np.ndarray:
    """One bit for the hash of each (lang, word), as BITS bits whatever their number."""
    at = F.pmod(F.xxhash64(F.concat("lang", F.lit("\t"), "word")), F.lit(BITS)) + 1  # these functions count from 1
    rows = words.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for k, bits in rows.collect():  # at most 512 rows of 4 kB
        out[(k - 1) * 4096 : k * 4096] = np.frombuffer(bits, np.uint8)
    return out


class Pointers:
    """Suffix pointers of a task, and their blocks by bucket."""

    def __init__(self, frequent: np.ndarray, heavy: np.ndarray, buckets: int):
        self.frequent, self.heavy, self.buckets = frequent, heavy, buckets
        self.number: dict[str, defaultdict] = {}
        self.words: dict[str, list[bytes]] = {}
        self.hashes: dict[str, np.ndarray] = {}
        self.flags: dict[str, np.ndarray] = {}
        self.held: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        self.size = 0

    def _numbers(self, lang: str, data: bytes) -> np.ndarray:
        """Number of each word (0 between pieces); new words get their hashes and flags."""
        if lang not in self.number:
            number = self.number[lang] = defaultdict()
            number.default_factory = number.__len__
            number[b"\n"]
            self.words[lang], self.hashes[lang], self.flags[lang] = [b""], np.zeros(1, np.uint64), np.zeros((2, 1), bool)
        number = self.number[lang]
        w = np.fromiter(map(number.__getitem__, TOKEN.findall(data)), np.int64)
        if len(number) > len(self.words[lang]):
            new = list(islice(number, len(self.words[lang]), None))
            h = np.array([xxhash.xxh64_intdigest(lang.encode() + b"\t" + x, 42) for x in new], np.uint64)
            at = (h.view(np.int64) % BITS).astype(np.int64)
            bits = [(m[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool) for m in (self.frequent, self.heavy)]
            self.words[lang] += new
            self.hashes[lang], self.flags[lang] = np.concatenate((self.hashes[lang], h)), np.concatenate((self.flags[lang], bits), 1)
        return w

    def add(self, lang: str, data: bytes) -> None:
        w = self._numbers(lang, data)
        ok = self.flags[lang][0][w]
        w = np.concatenate((np.where(ok, w, 0), np.zeros(WIDTH, np.int64)))
        step = len(w) if len(np.unique(w)) < 1 << 16 else 1 << 15  # so that a part's words have numbers of 16 bits
        for a in range(0, len(w) - WIDTH, step):
            own, code = np.unique(w[a : a + step + WIDTH - 1], return_inverse=True)
            if own[0] != 0:
                own, code = np.concatenate(([0], own)), code + 1
            n = min(step, len(code) - WIDTH + 1)
            key, going = code[:n].astype(np.uint64), code[:n] > 0
            for k in range(1, WIDTH):
                going = going & (code[k : n + k] > 0)
                key = key << np.uint64(16) | np.where(going, code[k : n + k], 0).astype(np.uint64)
            self._hold(lang, *np.unique(key[(code[:n] > 0) & (code[1 : n + 1] > 0)], return_counts=True), own)

    def _hold(self, lang: str, key: np.ndarray, count: np.ndarray, own: np.ndarray) -> None:
        cols = np.stack([own[(key >> np.uint64(16 * (WIDTH - 1 - k)) & np.uint64(0xFFFF)).astype(np.int64)] for k in range(WIDTH)])
        heavy = self.flags[lang][1][cols]
        depth = np.full(len(key), 2)  # words that route, and that the shortest phrase counted here has
        for k in range(2, WIDTH):
            depth[(depth == k) & heavy[:k].all(0)] = k + 1
        depth = np.where(cols[np.minimum(depth, WIDTH) - 1, np.arange(len(key))] > 0, depth, 0)  # those that end earlier go ahead only
        cols, count = cols.astype(np.int32), count.astype(np.uint32)
        rows = [(cols[:, depth > 0], count[depth > 0], depth[depth > 0].astype(np.uint8))]
        for k in range(2, WIDTH):
            short = heavy[:k].all(0)
            if short.any():
                kinds, at, kind = np.unique(key[short] >> np.uint64(16 * (WIDTH - k)), return_index=True, return_inverse=True)
                some = cols[:, short][:, at]
                some[k:] = 0
                if (whole := some[k - 1] > 0).any():
                    rows.append((some[:, whole], np.bincount(kind, count[short]).astype(np.uint32)[whole], np.full(int(whole.sum()), k, np.uint8)))
        self.held.setdefault(lang, []).extend(rows)
        self.size += sum(len(r[1]) for r in rows)

    def blocks(self) -> Iterator[pa.RecordBatch]:
        """(bucket, lang, words, codes, counts, depths): a row for each bucket and language, packed, and forget them."""
        pack = zstandard.ZstdCompressor(level=3).compress
        for lang, rows in self.held.items():
            cols, count, depth = (np.concatenate(x, -1) for x in zip(*rows))
            mixed = np.zeros(len(count), np.uint64)
            for k in range(WIDTH):
                mixed = (mixed ^ np.where(k < depth, self.hashes[lang][cols[k]], np.uint64(0))) * MIX
                mixed ^= mixed >> np.uint64(29)
            bucket = (mixed % np.uint64(self.buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            cols, count, depth, bucket = cols[:, by], count[by], depth[by], bucket[by]
            edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=self.buckets))
            made = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                own, code = np.unique(cols[:, a:b], return_inverse=True)
                if own[0] != 0:
                    own, code = np.concatenate(([0], own)), code + 1
                words = self.words[lang]
                codes = code.astype("<u2" if len(own) < 1 << 16 else "<u4")
                made.append((int(bucket[a]), lang, *map(pack, (b"\n".join([words[i] for i in own.tolist()]), codes.tobytes(), count[a:b].tobytes(), depth[a:b].tobytes()))))
                if len(made) == 256 or b == len(count):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made), (pa.int64(), pa.string(), *[pa.binary()] * 4))], names=["bucket", "lang", "words", "codes", "counts", "depths"])
                    made = []
        self.held, self.size = {}, 0


def equal_partitions(cols: np.ndarray, count: np.ndarray, depth: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, words, count) of the phrases with counts of ``least`` or more; cols: the words of each pointer (0: none), depth: its shortest phrase counted.

    Three-way partitions of all open segments at once: each takes its middle pointer's word as the pivot.
    """
    rows, sizes, at, found = np.arange(len(count)), np.array([len(count)]), np.zeros(1, np.int64), []
    sizes, at = sizes[sizes > 0], at[sizes > 0]
    while len(sizes):
        segment, begin = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
        key = cols[at[segment], rows]
        pivot = key[begin + sizes // 2]
        side = 3 * segment + 1 + (key > pivot[segment]) - (key < pivot[segment])
        many = np.bincount(side, minlength=3 * len(sizes))
        weight = np.bincount(side, count[rows], minlength=3 * len(sizes))
        rows = rows[np.argsort(side, kind="stable")]
        same, to = np.arange(3 * len(sizes)) % 3 == 1, np.repeat(at, 3)
        to[same] += 1
        first = np.minimum(np.cumsum(many) - many, len(rows) - 1)
        word = same & np.repeat(pivot > 0, 3) & (weight >= least)
        whole = np.flatnonzero(word & (to >= 2))
        if len(whole):
            counted = np.bincount(np.repeat(np.arange(len(many)), many), np.where(depth[rows] <= to[np.repeat(np.arange(len(many)), many)], count[rows], 0), minlength=len(many))
            whole = whole[counted[whole] >= least]
            found.append((rows[first[whole]], to[whole], counted[whole].astype(np.int64)))
        open_ = (weight >= least) & (many > 0) & np.where(same, word & (to < WIDTH), True)
        rows, sizes, at = rows[np.repeat(open_, many)], many[open_], to[open_]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def count_bucket(table: pa.Table, least: int) -> pa.Table:
    """(lang, phrase, words, f) of a bucket's blocks."""
    number: dict[tuple[str, bytes], int] = {}
    cols, count, depth = [np.zeros((WIDTH, 0), np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    names: list[tuple[str, bytes]] = [("", b"")]
    number[names[0]] = 0
    unpack = zstandard.ZstdDecompressor().decompress
    for i in range(table.num_rows):
        r = table.slice(i, 1).to_pylist()[0]
        r |= {c: unpack(r[c]) for c in ("words", "codes", "counts", "depths")}
        own = np.zeros(r["words"].count(b"\n") + 1, np.int64)
        for i, w in enumerate(r["words"].split(b"\n")):
            if w:
                own[i] = number.setdefault((r["lang"], w), len(names))
                if own[i] == len(names):
                    names.append((r["lang"], w))
        n = len(r["depths"])
        cols.append(own[np.frombuffer(r["codes"], "<u2" if len(r["codes"]) == 2 * WIDTH * n else "<u4").reshape(WIDTH, n)])
        count.append(np.frombuffer(r["counts"], "<u4").astype(np.int64))
        depth.append(np.frombuffer(r["depths"], np.uint8).astype(np.int64))
    cols = np.concatenate(cols, 1)
    row, words, f = equal_partitions(cols, np.concatenate(count), np.concatenate(depth), least)
    told = [[names[c] for c in cols[:k, i].tolist()] for i, k in zip(row.tolist(), words.tolist())]
    return pa.table({"lang": pa.array([t[0][0] for t in told], pa.string()), "phrase": pa.array([b" ".join(w for _, w in t).decode() for t in told], pa.string()), "words": pa.array(words, pa.int32()), "f": pa.array(f, pa.int64())})


def count_phrases(docs: DataFrame, least: int = 30, bucket: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(lang, word, f) of all words, and (lang, phrase, words, f) of the phrases with f >= least, both stored."""
    bound_batches(docs.sparkSession)
    spark, src = docs.sparkSession, docs.select("text", "lang")
    words = materialise(src.mapInArrow(count_words, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f")), "collocate-words")
    total = words.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    buckets = -(-total // bucket) or 1
    maps = spark.sparkContext.broadcast((bitmap(words.where(F.col("f") >= least)), bitmap(words.where(F.col("f") > bucket))))

    def pointers(batches):
        own = Pointers(*maps.value, buckets)
        for lang, data in streams(batches):
            own.add(lang, data)
            if own.size > HELD:
                yield from own.blocks()
        yield from own.blocks()

    blocks = src.mapInArrow(pointers, "bucket long, lang string, words binary, codes binary, counts binary, depths binary")
    phrases = blocks.groupBy("bucket").applyInArrow(lambda table: count_bucket(table, least), "lang string, phrase string, words int, f long")
    return words, materialise(phrases, "collocate-phrases")


def collocations(docs: DataFrame, least: int = 30, cover: int = 80, top: int = 2000, bucket: int = 1 << 20) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases.

    a, l and r count the phrase and the two parts of its lowest-scoring cut, n all words of the language. A phrase inside a
    longer one with at least ``cover`` percent of its occurrences is left out.
    """
    words, phrases = count_phrases(docs, least, bucket)
    known = phrases.select("lang", F.col("phrase").alias("part"), F.col("f").alias("pf")).union(words.where(F.col("f") >= least))
    own = F.split("phrase", " ")
    longer = phrases.where("words > 2").select("lang", "f", own.alias("w"), F.explode(F.expr("sequence(2, words - 1)")).alias("k"))
    inside = longer.select("lang", "f", F.explode(F.expr("transform(sequence(1, size(w) - k + 1), i -> array_join(slice(w, i, k), ' '))")).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    left = phrases.join(inside.hint("merge"), ["lang", "phrase"], "left").where(F.expr(f"most is null or 100 * cast(most as decimal(20)) < {cover} * cast(f as decimal(20))"))
    cuts = left.select("lang", "phrase", F.col("f").alias("a"), own.alias("w"), F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("head"), F.expr("array_join(slice(w, k + 1, size(w)), ' ')").alias("tail"))
    for part, name in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(known.select("lang", F.col("part").alias(part), F.col("pf").alias(name)).hint("merge"), ["lang", part])
    score = F.expr("cast(2000000 * cast(a as decimal(20)) div (cast(l as decimal(20)) + cast(r as decimal(20))) as long)")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    for share in (F.pmod(F.xxhash64("phrase"), F.lit(64)), None):  # the first of each share, then of these
        by = "partition by lang" + (", share" if share is not None else "") + " order by score desc, a desc, phrase"
        best = best.withColumn("share", share) if share is not None else best
        best = best.withColumn("rank", F.expr(f"cast(row_number() over ({by}) as long)")).where(F.col("rank") <= top)
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return best.join(n.hint("merge"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
