"""SentencePiece encoding and decoding by a max-plus parallel scan.

Text of up to ``chunk`` characters is one chunk and is encoded as such. Longer documents are split at every
``chunk`` characters, wherever that falls. The state at a split is the piece that covers it: [p, q) with
p < split <= q. Each chunk yields the matrix of the best values from each state at its start to each state at
its end; the matrices are multiplied in the (max, +) semiring, associatively, in groups of ``GROUP`` (and groups
of groups), which settles the states at all splits; then every chunk is traced back on its own.

Two kinds of model fit the same scan. For unigram models a path's value is the sum of its pieces' scores. For
BPE models it is 0 if each pair of neighbours is a valid BPE pair (encoding their concatenation gives them
back) and minus infinity otherwise; the BPE encoding is the only path of valid pairs. Where no piece crosses the
start of a word, the part of a chunk between its first and last word start is the same in all paths and cancels
from the matrix; a chunk without word starts (no white space) is scanned whole.

Decoding concatenates pieces, turns bytes back into UTF-8 and word marks into spaces. Null and empty texts have
no ids. Repeated rows stay repeated. An empty table gives an empty result. Only the columns in ``keep`` are kept; one
of them with a name of the result gives way to it. Models that normalise text are refused: pieces must be substrings.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise
from .packing import crc32_join

GROUP, MARK, NONE = 64, "▁", float("-inf")


class Pieces:
    """A model's processors with and without the dummy prefix, and what the scan asks of its vocabulary."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            raw = f.read()
        proto.ParseFromString(raw)
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("the model normalises text")
        self.prefix, self.bpe = spec.add_dummy_prefix, proto.trainer_spec.model_type == 2
        if not self.bpe and proto.trainer_spec.model_type != 1:
            raise ValueError("neither a unigram nor a BPE model")
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=raw)
        spec.add_dummy_prefix = False
        self.part = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.ids = {p.piece: k for k, p in enumerate(proto.pieces) if p.type in (1, 4)}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type in (1, 4)}
        self.unknown = min(self.scores.values(), default=0.0) - 10.0
        self.longest = max(map(len, self.ids), default=1)
        #: No piece has a mark after another character, so pieces end before each word start.
        self.splits = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.valid = lru_cache(1 << 18)(self._valid)

    def id_list(self, token: str) -> list[int]:
        if token in self.ids:
            return [self.ids[token]]
        return self.part.encode(token.replace(MARK, " "))

    def _valid(self, a: str, b: str) -> bool:
        """Whether b may follow a (empty: nothing before)."""
        if not self.bpe:
            return True
        return self.part.encode((a + b).replace(MARK, " ")) == (self.id_list(a) if a else []) + self.id_list(b)

    def value(self, token: str) -> float:
        return 0.0 if self.bpe else self.scores.get(token, self.unknown)

    def tokens_at(self, text: str, end: int, start: int) -> list[tuple[int, str]]:
        """(p, piece) of every piece, or else single character, that ends at ``end`` and starts at ``start`` or later."""
        found = [(p, t) for p in range(max(start, end - self.longest), end) if (t := text[p:end]) in self.ids]
        if end > start and (not found or found[-1][0] < end - 1):
            found.append((end - 1, text[end - 1]))
        return found

    def states(self, text: str, at: int) -> list[tuple[int, int]]:
        """Pieces that cover the split at ``at``, as [p, q), in order."""
        out = []
        for q in range(at, min(len(text), at + self.longest - 1) + 1):
            out += [(p, q) for p, t in self.tokens_at(text, q, 0) if p < at and self.valid("", t)]
        return sorted(out)

    def walk(self, text: str, start: int, end: int, before: str) -> dict[int, tuple[float, int]]:
        """Best value and last piece's start for every position reached from ``start``, after piece ``before``."""
        best = {start: (0.0, -1)}
        for i in range(start + 1, end + 1):
            for p, t in self.tokens_at(text, i, start):
                if p in best:
                    value = best[p][0] + self.value(t)
                    if (i not in best or value > best[i][0]) and self.valid(before if p == start else text[best[p][1] : p], t):
                        best[i] = value, p
        return best

    def word_starts(self, text: str, a: int, b: int) -> tuple[int, int] | None:
        """First and last position in [a, b) where a word starts."""
        if not self.splits:
            return None
        is_start = lambda i: 0 < i < len(text) and text[i] == MARK and text[i - 1] != MARK
        first = next((i for i in range(a, b) if is_start(i)), None)
        return None if first is None else (first, next(i for i in range(b - 1, a - 1, -1) if is_start(i)))

    def transfer(self, text: str, a: int, b: int) -> np.ndarray:
        """(max, +) matrix from the states at ``a`` to those at ``b``; one state at the text's start and end."""
        ins = self.states(text, a) if a else [(0, 0)]
        outs = self.states(text, b) if b < len(text) else [(-1, len(text))]
        top = max(q for _, q in outs)
        cut = self.word_starts(text, a, b)

        def to_outs(found):
            return [found[q][0] if p < 0 and q in found else found[p][0] + self.value(text[p:q]) if 0 <= p and p in found and self.valid(text[found[p][1] : p] if found[p][1] >= 0 else before, text[p:q]) else NONE for p, q in outs]

        if cut and cut[0] < cut[1]:
            left = []
            for p, q in ins:
                found = self.walk(text, q, cut[0], text[p:q])
                left.append(found.get(cut[0], (NONE, 0))[0])
            before = ""
            right = to_outs(self.walk(text, cut[1], top, ""))
            return np.add.outer(np.array(left), np.array(right))
        rows = []
        for p, q in ins:
            before = text[p:q]
            rows.append(to_outs(self.walk(text, q, top, before)))
        return np.array(rows)

    def trace(self, text: str, a: int, b: int, i: int, j: int) -> list[str]:
        """The pieces after state i at ``a`` up to and with state j at ``b``."""
        p, q = self.states(text, a)[i] if a else (0, 0)
        op, oq = self.states(text, b)[j] if b < len(text) else (-1, len(text))
        cut = self.word_starts(text, a, b)

        def back(start: int, end: int, before: str) -> list[str]:
            found, out = self.walk(text, start, end, before), []
            while end > start:
                out.append(text[found[end][1] : end])
                end = found[end][1]
            return out[::-1]

        stop, last = (oq, []) if op < 0 else (op, [text[op:oq]])
        if cut and cut[0] < cut[1]:
            return [*back(q, cut[0], text[p:q]), (cut[0], cut[1]), *back(cut[1], stop, ""), *last]
        return [*back(q, stop, text[p:q]), *last]

    def trace_ids(self, text: str, a: int, b: int, i: int, j: int) -> list[int]:
        out = []
        for t in self.trace(text, a, b, i, j):
            out += self.id_list(t) if isinstance(t, str) else self.part.encode(text[t[0] : t[1]].replace(MARK, " "))
        return out


def chain(mats: list[np.ndarray], i: int, j: int) -> list[int]:
    """States at the inner and last splits of the best path from i to j."""
    value, back = mats[0][i], []
    for m in mats[1:]:
        both = value[:, None] + m
        back.append(both.argmax(0))
        value = both.max(0)
    if value[j] == NONE:
        raise ValueError("no path through the chunks")
    out = [j]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


def product(mats: list[np.ndarray]) -> np.ndarray:
    out = mats[0]
    for m in mats[1:]:
        out = (out[:, :, None] + m[None]).max(1)
    return out


def _matrices(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [np.array(m, np.float64).reshape(r, -1) for r, m in zip(pdf["n_in"], pdf["m"])]


def settle(mats: DataFrame, chunks: int) -> DataFrame:
    """(rid, k, i, j): the states at both ends of every chunk, from matrices (rid, k, n_in, m) of up to ``chunks`` chunks a document."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        ends = chain(_matrices(pdf), int(pdf["gi"].iloc[0]), int(pdf["gj"].iloc[0]))
        return pd.DataFrame({"rid": pdf["rid"], "k": pdf["k"], "i": [int(pdf["gi"].iloc[0]), *ends[:-1]], "j": ends})

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        m = product(_matrices(pdf))
        return pd.DataFrame({"rid": pdf["rid"][:1], "k": pdf["k"][:1] // GROUP, "n_in": [m.shape[0]], "m": [m.reshape(-1).tolist()]})

    grouped = mats.withColumn("g", F.expr(f"k div {GROUP}"))
    if chunks <= GROUP:
        ready = grouped.withColumn("gi", F.lit(0)).withColumn("gj", F.lit(0))
    else:
        up = materialise(grouped.groupBy("rid", "g").applyInPandas(multiply, "rid long, k long, n_in int, m array<double>"), "pieces-up")
        ends = settle(up, -(-chunks // GROUP)).select("rid", F.col("k").alias("g"), F.col("i").alias("gi"), F.col("j").alias("gj"))
        ready = grouped.join(ends.hint("merge"), ["rid", "g"])
    return ready.groupBy("rid", "g").applyInPandas(solve, "rid long, k long, i int, j int")


_models: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def decode(rows: DataFrame, path: str, keep: tuple = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the text of the ids in column ``ids`` (null: empty)."""
    kinds = dict(rows.dtypes)

    def texts(batch: pa.RecordBatch) -> dict:
        return {c: batch[c] for c in keep} | {"text": model(path).whole.decode([x or [] for x in batch["ids"].to_pylist()], num_threads=1)}

    return map_arrow(rows.select(*keep, "ids"), "".join(f"`{c}` {kinds[c]}, " for c in keep) + "text string", texts)


RESULT = ("rid", "text", "n_chars", "n_chunks", "n_tokens", "ids_crc32", "round_trip", "ids")
OUT = "rid long, k long, n_tokens long, crc long, round_trip boolean, ids array<int>"


def _row(ids: list[int], ok: bool, with_ids: bool) -> tuple:
    return len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ok, ids if with_ids else None


def encode(docs: DataFrame, path: str, chunk: int = 16_384, keep: tuple = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """``keep`` columns, n_chars, n_chunks, n_tokens, ids_crc32 (little-endian unsigned 32-bit), round_trip[, ids]."""
    keep = tuple(c for c in keep if c not in RESULT)
    src = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = F.char_length("text")
    kinds = dict(docs.dtypes)
    head = "".join(f"`{c}` {kinds[c]}, " for c in keep)
    names = ["n_tokens", "ids_crc32", "round_trip", "ids"]

    def short(batch: pa.RecordBatch):
        p = model(path)
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = part["text"].to_pylist()
            ids = p.whole.encode(texts, num_threads=1)
            made = [_row(i, d == t, with_ids) for i, d, t in zip(ids, p.whole.decode(ids, num_threads=1), texts)]
            yield {c: part[c] for c in keep} | {"n_chars": [len(t) for t in texts], "n_chunks": [1] * len(texts)} | {c: [m[k] for m in made] for k, c in enumerate(names)}

    schema = f"{head}n_chars long, n_chunks long, n_tokens long, ids_crc32 long, round_trip boolean, ids array<int>"
    done = map_arrow(src.where(size <= chunk), schema, short)

    long = materialise(src.where(size > chunk).withColumn("rid", F.monotonically_increasing_id()), "pieces-long")
    most = long.agg(F.max(F.char_length("text"))).first()[0]
    if most is not None:
        pieces = model(path)
        reach, lead = pieces.longest, int(pieces.prefix)
        marked = long.select("rid", F.concat(F.lit(MARK * lead), F.translate("text", " ", MARK)).alias("t")).withColumn("n", F.char_length("t"))
        cut = marked.select("rid", "n", "t", F.explode(F.expr(f"sequence(0L, (n - 1) div {chunk})")).alias("k"))
        cut = cut.withColumn("a", F.col("k") * chunk).withColumn("b", F.least((F.col("k") + 1) * chunk, F.col("n"))).withColumn("from", F.greatest(F.col("a") - 2 * reach, F.lit(0)))
        cut = cut.withColumn("to", F.least(F.col("b") + 2 * reach, F.col("n")))
        cut = cut.select("rid", "k", "n", "a", "b", "from", "to", F.expr("substring(t, cast(from + 1 as int), cast(to - from as int))").alias("t"))
        cut = materialise(cut.repartition("rid", "k"), "pieces-chunks")

        def matrices(batch: pa.RecordBatch) -> dict:
            p, made = model(path), []
            for r in batch.to_pylist():
                m = p.transfer(r["t"], r["a"] - r["from"], r["b"] - r["from"])
                made.append((m.shape[0], m.reshape(-1).tolist()))
            return {"rid": batch["rid"], "k": batch["k"], "n_in": [m[0] for m in made], "m": [m[1] for m in made]}

        def traced(batch: pa.RecordBatch) -> dict:
            p, made = model(path), []
            for r in batch.to_pylist():
                a, b = r["a"] - r["from"], r["b"] - r["from"]
                ids = p.trace_ids(r["t"], a, b, r["i"], r["j"])
                start = p.states(r["t"], a)[r["i"]][1] if a else 0
                stop = p.states(r["t"], b)[r["j"]][1] if b < len(r["t"]) else len(r["t"])
                made.append(_row(ids, p.part.decode(ids) == r["t"][start:stop].replace(MARK, " "), with_ids))
            return {"rid": batch["rid"], "k": batch["k"]} | {c: [m[x] for m in made] for x, c in enumerate(["n_tokens", "crc", "round_trip", "ids"])}

        mats = materialise(map_arrow(cut, "rid long, k long, n_in int, m array<double>", matrices), "pieces-matrices")
        ends = settle(mats, -(-(most + lead) // chunk))
        parts = map_arrow(cut.join(ends.hint("merge"), ["rid", "k"]), OUT, traced)  # no estimate sees what Python makes

        @F.udf("long")
        def joined(found):
            crc, found = 0, sorted(found)
            for x, (_, n, c) in enumerate(found):
                crc = crc32_join(crc, c, 4 * n) if x else c
            return crc

        ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])) if with_ids else F.lit(None).cast("array<int>")
        whole = parts.groupBy("rid").agg(F.count("*").alias("n_chunks"), F.sum("n_tokens").alias("n_tokens"), joined(F.collect_list(F.struct("k", "n_tokens", "crc"))).alias("ids_crc32"), F.every("round_trip").alias("round_trip"), ids.alias("ids"))
        done = done.union(long.select("rid", *keep, F.char_length("text").cast("long").alias("n_chars")).join(whole.hint("merge"), "rid").select(*keep, "n_chars", "n_chunks", "n_tokens", "ids_crc32", "round_trip", "ids"))
    return done if with_ids else done.drop("ids")
