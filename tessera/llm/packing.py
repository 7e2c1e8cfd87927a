"""Token ids as fixed-width bit-packed blocks.

``write_ids`` encodes documents in ascending doc_id order (ties by text), appends ``end_id`` to each, and
writes shards of blocks. A block holds ``block_ids`` ids (the last of a shard fewer) of ``bits`` bits each,
little-endian, where ``bits`` is the least width that holds the vocabulary. All blocks but the last of a shard
have the same size, so id i of a shard lies in block i // block_ids at bit (i % block_ids) * bits, and any
range is read by unpacking whole blocks with numpy. Each block also lists the documents that overlap it.

Null and empty texts have the end id only. Repeated doc_ids are documents of their own. An empty table writes
no block and reads back no row. Columns other than doc_id and text are ignored, so their names can't clash.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, materialise

BLOCK_SCHEMA = "shard int, block int, bits int, n_ids int, doc_ids array<long>, firsts array<long>, lens array<long>, payload binary"


def width_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as one little-endian bit string of ``bits`` bits each."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}", copy=False).tobytes()
    raw = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(raw[:, :bits].reshape(-1), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", n).astype("<u4")
    raw = np.unpackbits(np.frombuffer(payload, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    full = np.zeros((n, 32), np.uint8)
    full[:, :bits] = raw
    return np.packbits(full, axis=1, bitorder="little").view("<u4").reshape(-1)


def crc32_join(a: int, b: int, n: int) -> int:
    """crc32 of x + y from crc32(x), crc32(y) and len(y) = n bytes: n zero bytes are applied to a by squaring."""

    def times(m, v):
        out = 0
        for row in m:
            if v & 1:
                out ^= row
            v >>= 1
        return out

    step = [0xEDB88320] + [1 << k for k in range(31)]  # one zero bit
    for _ in range(3):
        step = [times(step, r) for r in step]  # one zero byte
    while n:
        if n & 1:
            a = times(step, a)
        step, n = [times(step, r) for r in step], n >> 1
    return a ^ b


#: ASCII punctuation that ends a run of letters for the tokenizer; the apostrophe may start a contraction.
PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class WordEncoder:
    """Encodes texts with a lower-casing word-end BPE tokenizer whose tokens never cross ASCII white space.

    ``words`` maps words as they stand to the bytes of their ids; it is refilled from ``cores`` (lower-cased runs
    of letters) and ``tails`` (punctuation after them and anything else). Unknown cores of ASCII letters go to the
    tokenizer's model one by one, others through the whole tokenizer many at a time, told apart by their word-end
    tokens; if the number of these isn't the number of cores (letters that change class when normalised), one at a
    time. A full map becomes the old one, and what is still in use comes back from there, so frequent words are
    encoded once while rare ones go.
    """

    def __init__(self, path: str, most_words: int = 250_000, most_cores: int = 250_000, end: str = "</w>"):
        from tokenizers import Tokenizer

        self.tokenizer, self.most_words, self.most_cores = Tokenizer.from_file(path), most_words, most_cores
        self.words: dict[bytes, bytes] = {}
        self.cores: dict[bytes, bytes] = {}
        self.old_words: dict[bytes, bytes] = {}
        self.old_cores: dict[bytes, bytes] = {}
        self.tails: dict[bytes, bytes] = {b"": b""}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        top = max(vocabulary.values())
        self.kind = np.dtype("<u2" if top < 1 << 16 else "<u4")
        self.ends = np.zeros(top + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(end)]] = True

    def one_by_one(self, words: list[bytes], into: dict) -> None:
        made = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        into.update(zip(words, (np.array(x.ids, self.kind).tobytes() for x in made)))

    def letters(self, words: list[bytes]) -> None:
        size = self.kind.itemsize
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, self.kind)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(words):
            flat, cuts = ids.tobytes(), (cuts * size).tolist()
            self.cores.update((w, flat[a:b]) for w, a, b in zip(words, [0, *cuts], cuts))
        else:
            self.one_by_one(words, self.cores)

    def learn(self, new: set[bytes]) -> None:
        if len(self.cores) > self.most_cores:
            self.old_cores, self.cores = self.cores, {}
        if len(self.tails) > self.most_words:
            self.tails = {b"": b""}
        cores, tails, words, old_words, old_cores = self.cores, self.tails, self.words, self.old_words, self.old_cores
        parts, need, odd = [], set(), set()
        for w in new:
            if w in old_words:
                words[w] = old_words[w]
                continue
            core = w.rstrip(PUNCTUATION)
            if core.isalpha():  # ASCII letters
                key = core.lower()
            elif core and (text := core.decode()).isalpha() and text.lower().isalpha():
                key = core
            else:
                key, core = None, b""
            tail = w[len(core) :]
            if key is not None and key not in cores and key in old_cores:
                cores[key] = old_cores[key]
            if (key is None or key in cores) and tail in tails:
                words[w] = (cores[key] if key else b"") + tails[tail]
                continue
            if key is not None and key not in cores:
                need.add(key)
            if tail not in tails:
                odd.add(tail)
            parts.append((w, key, tail))
        plain = [c for c in need if c.isascii()]  # nothing to normalise or to cut: the model alone
        tokenize, kind = self.tokenizer.model.tokenize, self.kind
        cores.update((c, np.array([x.id for x in tokenize(c.decode())], kind).tobytes()) for c in plain)
        if len(plain) < len(need):
            self.letters([c for c in need if not c.isascii()])
        if odd:
            self.one_by_one([*odd], tails)
        words.update((w, (cores[c] if c else b"") + tails[t]) for w, c, t in parts)

    def __call__(self, texts: pa.StringArray) -> list[np.ndarray]:
        """Ids of each text (null: none). Words are told apart batch by batch, so Python meets each once a batch."""
        if len(self.words) > self.most_words:
            self.old_words, self.words = self.words, {}
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        counts = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))
        coded = words.flatten().dictionary_encode()
        index, known = coded.indices.to_numpy(), coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        ids = [*map(self.words.get, known)]
        new = [k for k, m in enumerate(ids) if m is None]
        if new:
            self.learn({known[k] for k in new} - {b""})
            for k in new:
                ids[k] = self.words.get(known[k], b"")
        flat = np.frombuffer(b"".join(ids), self.kind)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
        n = sizes[index]
        ends = np.cumsum(n)
        out = flat[np.repeat((np.cumsum(sizes) - sizes)[index] - ends + n, n) + np.arange(int(n.sum()))]
        at = np.concatenate(([0], np.concatenate(([0], ends))[counts]))
        return [out[a:b] for a, b in zip(at, at[1:])]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's own, kept between tasks (a function of the module, as what tasks refer to by name is shared)."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_ids(docs: DataFrame, tokenizer_path: str, vocabulary: int, end_id: int, shards: int | None = None, block_ids: int = 65_536) -> DataFrame:
    """The blocks (BLOCK_SCHEMA) as written to and read from the shared folder."""
    bits = width_for(vocabulary)
    bound_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long"), "text")
    by = [F.col("doc_id"), F.col("text")]
    src = (src.repartitionByRange(shards, "doc_id") if shards else src.repartitionByRange("doc_id")).sortWithinPartitions(*by)

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, shard = encoder(tokenizer_path), TaskContext.get().partitionId()
        last = np.array([end_id], encode.kind)
        held, n_held, block, done = [], 0, 0, 0  # ids not yet written; `done` ids of the shard are
        docs_held: list[tuple[int, int, int]] = []

        def flush(ids: np.ndarray):
            nonlocal block, done, docs_held
            end = done + len(ids)
            mine = [d for d in docs_held if d[1] < end]
            docs_held = [d for d in docs_held if d[1] + d[2] > end]
            cols = [[shard], [block], [bits], [len(ids)], [[d[0] for d in mine]], [[d[1] for d in mine]], [[d[2] for d in mine]], [pack(ids, bits)]]
            block, done = block + 1, end
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32()] * 4 + [pa.list_(pa.int64())] * 3 + [pa.binary()])], names=["shard", "block", "bits", "n_ids", "doc_ids", "firsts", "lens", "payload"])

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for doc_id, ids in zip(part["doc_id"].to_pylist(), encode(part["text"])):
                    docs_held.append((doc_id, done + n_held, len(ids) + 1))
                    held += [ids, last]
                    n_held += len(ids) + 1
                    if n_held >= block_ids:
                        flat = np.concatenate(held)
                        whole = n_held // block_ids * block_ids
                        for k in range(0, whole, block_ids):
                            yield flush(flat[k : k + block_ids])
                        held, n_held = [flat[whole:]], n_held - whole
        if n_held:
            yield flush(np.concatenate(held))

    return materialise(src.mapInArrow(run, BLOCK_SCHEMA), "packed-ids", "none")


def read_ids(blocks: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, unpacked from the blocks."""

    def run(batches):
        for batch in batches:
            made = []
            for r in batch.to_pylist():
                ids = unpack(r["payload"], r["bits"], r["n_ids"])
                at = r["block"] * block_ids
                for doc_id, first, n in zip(r["doc_ids"], r["firsts"], r["lens"]):
                    a, b = max(first - at, 0), min(first + n - at, len(ids))
                    piece = ids[a:b]
                    made.append((r["shard"], doc_id, first, n, r["block"], b - a, zlib.crc32(piece), piece if with_ids else None))
            names = ["shard", "doc_id", "first", "n_tokens", "block", "n", "crc", "ids"]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate(types)], names=names)

    @F.udf("long")
    def join(parts):
        crc, parts = 0, sorted(parts or ())
        for k, (_, n, c) in enumerate(parts):
            crc = crc32_join(crc, c, 4 * n) if k else c
        return crc

    first = blocks.where("block = 0").agg(F.max("n_ids")).first()[0]
    block_ids = first or 1
    pieces = blocks.mapInArrow(run, "shard int, doc_id long, first long, n_tokens long, block int, n long, crc long, ids array<long>")
    ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "ids"))), lambda x: x["ids"])) if with_ids else F.lit(None)
    found = pieces.groupBy("shard", "doc_id", "first", "n_tokens").agg(F.collect_list(F.struct("block", "n", "crc")).alias("parts"), ids.alias("ids"))
    one = F.size("parts") == 1
    found = found.select("shard", "doc_id", "first", "n_tokens", F.when(one, F.col("parts")[0]["crc"]).otherwise(join(F.when(~one, F.col("parts")))).alias("ids_crc32"), "ids")
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("size"))
    base = sizes.select("shard", (F.sum("size").over(Window.orderBy("shard")) - F.col("size")).alias("base"))
    out = found.join(base, "shard").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", "ids")
    return out if with_ids else out.drop("ids")
