"""Byte-level BPE encoding and decoding over rank files, with padded matrices.

A text is cut into the matches of ``pattern``, each of which is encoded by itself. One that is a token is that token.
The others that a batch holds, each once, are dealt to matrices by length: a row for each, a cell for each byte,
padded at the end. In every round each row merges the leftmost of its pairs of least rank, which takes a cell from each
row, so that the matrix stays a rectangle; only the two pairs beside a merged one get new ranks, from a hash table of
all pairs of tokens that make a token. A row without such a pair is finished and leaves. A row of w cells takes w rounds
over w cells, so a match of more than ``WIDEST`` bytes is merged in the same order through a heap of its pairs.

Null and empty texts have no ids. Repeated rows stay repeated, an empty table gives an empty result. Only the columns in
``keep`` are kept; one of them with a name of the result gives way to it. Long texts are matched a run at a time.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_arrow

WIDEST, CELLS, NONE = 1024, 1 << 20, np.int32(2**31 - 1)
#: Characters of text encoded at once, matches taken at once from a longer one, and matches whose ids are kept at most.
CHARS, RUN, KNOWN = 1 << 20, 1 << 16, 1 << 18


class PairTable:
    """(left, right) -> value, for arrays of pairs: open addressing with linear steps."""

    def __init__(self, left: np.ndarray, right: np.ndarray, value: np.ndarray):
        self.bits = max(4, int(4 * len(left)).bit_length())
        self.keys, self.values, self.steps = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE), 1
        key, at = self._key(left, right), np.arange(len(left))
        slot = self._slot(key)
        while len(at):
            free = self.keys[slot] == -1
            first = np.zeros(len(at), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.values[slot[put]] = key[at[put]], value[at[put]]
            at, slot = at[~put], (slot[~put] + 1) & ((1 << self.bits) - 1)
            self.steps += 1

    def _key(self, left, right):
        return left.astype(np.int64) << 32 | right.astype(np.int64)

    def _slot(self, key):
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Values, NONE where there is none; one dimension."""
        key = self._key(left, right)
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], NONE)
        at = np.flatnonzero((found != key) & (found != -1))
        for _ in range(self.steps):
            if not len(at):
                break
            slot[at] = (slot[at] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[at]]
            hit = found == key[at]
            out[at[hit]] = self.values[slot[at[hit]]]
            at = at[~hit & (found != -1)]
        return out


class ByteBpe:
    """A rank file: ids of texts, bytes of ids."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        if any(bytes([b]) not in self.ids for b in range(256)):
            raise ValueError("the rank file lacks single bytes")
        self.find = regex.compile(pattern)
        self.tokens = {i: t for t, i in self.ids.items()}
        self.sizes = np.zeros(max(self.tokens) + 1, np.int64)
        for i, t in self.tokens.items():
            self.sizes[i] = len(t)
        self.bytes = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        self.pad = np.int32(len(self.sizes))
        made = [(self.ids[t[:k]], self.ids[t[k:]], i) for t, i in self.ids.items() for k in range(1, len(t)) if t[:k] in self.ids and t[k:] in self.ids]
        self.pairs = PairTable(*np.array(made, np.int64).reshape(-1, 3).T)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.counts, self.ends = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge_rows(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after the other, and how many each has; cells: ids of bytes, padded at the end."""
        n, width = cells.shape
        out, rows, row = np.full((n, width), self.pad), np.arange(n), np.arange(n)
        ranks = self.pairs.get(cells[:, :-1].ravel(), cells[:, 1:].ravel()).reshape(n, width - 1)
        while len(rows):
            at = ranks.argmin(1) if ranks.shape[1] else None
            least = ranks[row, at] if ranks.shape[1] else np.full(len(rows), NONE)
            if (over := least == NONE).any():
                out[rows[over], : cells.shape[1]] = cells[over]
                rows, cells, ranks, at, least = rows[~over], cells[~over], ranks[~over], None if at is None else at[~over], least[~over]
                row = np.arange(len(rows))
            if not len(rows):
                break
            cells[row, at] = least
            stay = np.ones(cells.shape, bool)
            stay[row, at + 1] = False
            cells = cells[stay].reshape(len(rows), -1)
            stay = np.ones(ranks.shape, bool)
            stay[row, at] = False
            ranks = ranks[stay].reshape(len(rows), -1)
            for shift in (-1, 0):
                there = np.flatnonzero((at + shift >= 0) & (at + shift < ranks.shape[1]))
                left = at[there] + shift
                ranks[there, left] = self.pairs.get(cells[there, left], cells[there, left + 1])
        used = out != self.pad
        return out[used], used.sum(1)

    def merge_long(self, piece: bytes) -> list[int]:
        """The same merges of one long piece, through a heap of (rank, place)."""
        cell, after, before = self.bytes[np.frombuffer(piece, np.uint8)].tolist(), list(range(1, len(piece) + 1)), list(range(-1, len(piece) - 1))
        ranks = self.pairs.get(np.array(cell[:-1]), np.array(cell[1:])).tolist() + [int(NONE)]
        heap = [(r, i) for i, r in enumerate(ranks) if r != NONE]
        heapq.heapify(heap)
        token = lambda i: self.tokens[cell[i]]
        while heap:
            rank, i = heapq.heappop(heap)
            if ranks[i] != rank:
                continue
            gone = after[i]
            cell[i], after[i], ranks[gone] = rank, after[gone], -1
            if after[i] < len(piece):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0:
                    ranks[k] = self.ids.get(token(k) + token(after[k]), int(NONE)) if after[k] < len(piece) else int(NONE)
                    if ranks[k] != NONE:
                        heapq.heappush(heap, (ranks[k], k))
        i, out = 0, []
        while i < len(piece):
            out.append(cell[i])
            i = after[i]
        return out

    def learn(self, pieces: Iterable[str]) -> None:
        """Append the ids of pieces to ``flat`` and their numbers to ``known``."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        whole: list[str] = []
        flat, counts = [self.flat], [self.counts]
        for p in pieces:
            raw = p.encode()
            if raw in self.ids:
                whole.append(p)
            elif len(raw) > WIDEST:
                flat.append(np.array(self.merge_long(raw), np.int32))
                counts.append(np.array([len(flat[-1])]))
                self.known[p] = len(self.known)
            else:
                step = 1 << max(0, len(raw).bit_length() - 3)  # four widths between powers of two
                by_width.setdefault(-(-len(raw) // step) * step, []).append((p, raw))
        flat.append(np.array([self.ids[p.encode()] for p in whole], np.int32))
        counts.append(np.ones(len(whole), np.int64))
        self.known.update(zip(whole, range(len(self.known), len(self.known) + len(whole))))
        for width, own in by_width.items():
            for a in range(0, len(own), max(1, CELLS // width)):
                part = own[a : a + max(1, CELLS // width)]
                cells = np.full((len(part), width), self.pad)
                cells[np.arange(width) < np.array([len(raw) for _, raw in part])[:, None]] = self.bytes[np.frombuffer(b"".join(raw for _, raw in part), np.uint8)]
                for kept, made in zip((flat, counts), self.merge_rows(cells)):
                    kept.append(made)
                self.known.update(zip((p for p, _ in part), range(len(self.known), len(self.known) + len(part))))
        self.flat, self.counts = np.concatenate(flat), np.concatenate(counts)
        self.ends = np.cumsum(self.counts)

    def _ids(self, pieces: list[list[str]]) -> list[np.ndarray]:
        """Ids of each list of pieces."""
        if len(self.known) > KNOWN:
            self.forget()
        self.learn({p for own in pieces for p in own if p not in self.known})
        number = np.fromiter(map(self.known.__getitem__, chain.from_iterable(pieces)), np.int64)
        counts = self.counts[number]
        after = np.cumsum(counts)
        ids = self.flat[np.repeat(self.ends[number] - after, counts) + np.arange(after[-1] if len(after) else 0)]
        after = np.concatenate(([0], after))[np.cumsum([0, *map(len, pieces)])]
        return [ids[a:b] for a, b in zip(after[:-1].tolist(), after[1:].tolist())]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out, at = [], 0
        while at < len(texts):
            if len(texts[at]) > CHARS:
                found, parts = (m.group() for m in self.find.finditer(texts[at])), []
                while run := list(islice(found, RUN)):
                    parts += self._ids([run])
                out.append(np.concatenate(parts))
                at += 1
                continue
            end, size = at, 0
            while end < len(texts) and (size := size + len(texts[end])) <= CHARS:
                end += 1
            out += self._ids([self.find.findall(t) for t in texts[at:end]])
            at = end
        return out

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Bytes of each list of ids (null: empty)."""
        own = ids.fill_null([]) if ids.null_count else ids
        flat = own.flatten().to_numpy()
        ends = np.concatenate(([0], np.cumsum(self.sizes[flat])))
        counts = np.concatenate(([0], np.cumsum([len(x) for x in own])))
        data = b"".join(map(self.tokens.__getitem__, flat.tolist()))
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(ends[counts].astype(np.int64)), pa.py_buffer(data)])


_models: dict[tuple[str, str], ByteBpe] = {}


def model(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _models:
        _models[path, pattern] = ByteBpe(path, pattern)
    return _models[path, pattern]


def _head(rows: DataFrame, keep: tuple) -> str:
    kinds = dict(rows.dtypes)
    return "".join(f"`{c}` {kinds[c]}, " for c in keep)


def encode(docs: DataFrame, path: str, pattern: str, keep: tuple = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ids (array<int>) of the text."""
    keep = tuple(c for c in keep if c != "ids")

    def made(batch: pa.RecordBatch) -> dict:
        own = model(path, pattern).encode([t or "" for t in batch["text"].to_pylist()])
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int32)
        ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(own) if own else [], pa.int32()))
        return {c: batch[c] for c in keep} | {"ids": ids}

    return map_arrow(docs.select(*dict.fromkeys((*keep, "text"))), f"{_head(docs, keep)}ids array<int>", made)


def decode(rows: DataFrame, path: str, pattern: str, keep: tuple = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the bytes (data) that the ids stand for; ids may cut characters apart, so this is binary."""
    keep = tuple(c for c in keep if c != "data")

    def made(batch: pa.RecordBatch) -> dict:
        return {c: batch[c] for c in keep} | {"data": model(path, pattern).decode(batch["ids"])}

    return map_arrow(rows.select(*dict.fromkeys((*keep, "ids"))), f"{_head(rows, keep)}data binary", made)


DIGESTS = ("n_tokens", "ids_sha256", "decoded_sha256")


def digests(rows: DataFrame, path: str, pattern: str, keep: tuple = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_tokens, SHA-256 of the ids as little-endian unsigned 32-bit integers and of the bytes that they are decoded to."""
    keep = tuple(c for c in keep if c not in DIGESTS)

    def made(batch: pa.RecordBatch) -> dict:
        ids = [np.asarray(x.values if x.is_valid else [], "<u4") for x in batch["ids"]]
        data = model(path, pattern).decode(batch["ids"])
        return {c: batch[c] for c in keep} | {"n_tokens": [len(x) for x in ids], "ids_sha256": [hashlib.sha256(x.tobytes()).hexdigest() for x in ids], "decoded_sha256": [hashlib.sha256(x.as_buffer()).hexdigest() for x in data]}

    return map_arrow(rows.select(*dict.fromkeys((*keep, "ids"))), f"{_head(rows, keep)}n_tokens long, ids_sha256 string, decoded_sha256 string", made)
