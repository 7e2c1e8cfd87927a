"""Language identification as inference of a multilingual mixture.

``fit`` counts hashed letter trigrams (word edges included) of labelled documents per language, on a sample
bounded by ``most`` documents per language (chosen by hash of doc_id), into ``BINS`` smoothed likelihoods.
``predict`` treats each document as a mixture: expectation-maximisation finds the proportions of languages from
its trigrams' likelihoods, and the set of languages grows while the log-likelihood, penalised by
``penalty`` / 2 * log(n) for each further language, gets better. lang_pred is the language with the largest
proportion (the first by name if equal), score that proportion.

Null texts and texts without a letter of any plane (so emoji alone) are ``und`` with score 0. Without any labelled
document, an empty table included, every text is ``und``. Whole texts count, very long ones in parts of PART
characters. Repeated rows get equal values. An empty table gives an empty result. Only the columns in ``keep`` are
kept; one of them with a name of the result (lang_pred, score, mixture) gives way to it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

BINS, PART = 1 << 16, 1 << 20
#: Which code points are letters, in all planes of Unicode.
LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Bins and counts of the text's trigrams; None without a letter."""
    if not text:
        return None
    full, any_letter = None, False
    for i in range(0, len(text), PART):
        codes = np.frombuffer(text[i : i + PART].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = LETTER[codes]
        any_letter |= bool(letter.any())
        c = np.concatenate(([0], np.where(letter, codes, 0), [0])).astype(np.uint64)
        c = c[(c > 0) | np.concatenate(([True], c[:-1] > 0))]  # one gap between words
        h = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1] * np.uint64(0x85EBCA77) + c[2:] * np.uint64(0xC2B2AE3D)) * np.uint64(0x9E3779B97F4A7C15)
        found = (h >> np.uint64(48)).astype(np.int64)
        if len(text) <= BINS // 4:
            return np.unique(found, return_counts=True) if any_letter else None
        full = np.bincount(found, minlength=BINS) + (0 if full is None else full)
    bins = np.flatnonzero(full)
    return (bins, full[bins]) if any_letter else None


def mixture(like: np.ndarray, counts: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Proportions of the columns of ``like`` (P(gram | language)) by expectation-maximisation, and the log-likelihood."""
    p = np.full(like.shape[1], 1 / like.shape[1])
    n, last = counts.sum(), -math.inf
    for _ in range(rounds):
        mixed = like @ p
        value = float(counts @ np.log(mixed))
        if value - last < 1e-6 * abs(value):
            break
        last = value
        p = p * ((counts / mixed) @ like) / n
    return p, float(counts @ np.log(like @ p))


def infer(model: np.ndarray, bins: np.ndarray, counts: np.ndarray, penalty: float = 6.0) -> dict[int, float]:
    """Chosen languages and their proportions: forward selection by penalised likelihood. model: languages x BINS."""
    like, counts = model[:, bins].T, counts.astype(np.float64)
    single = counts @ np.log(like)
    chosen = [int(single.argmax())]
    value, share, cost = float(single.max()), np.ones(1), penalty / 2 * math.log(max(2.0, counts.sum()))
    rest = [int(k) for k in np.argsort(-single, kind="stable") if k != chosen[0]]
    while rest:
        tried = [(mixture(like[:, [*chosen, k]], counts), k) for k in rest]
        (p, v), k = max(tried, key=lambda x: x[0][1])
        if v - value <= cost:
            break
        chosen, value, share = [*chosen, k], v, p
        rest.remove(k)
    return dict(zip(chosen, share.tolist()))


def fit(labelled: DataFrame, most: int = 3000) -> tuple[list[str], np.ndarray]:
    """(languages, likelihoods) from columns doc_id, text, lang: at most about ``most`` documents per language."""
    known = labelled.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], np.zeros((0, BINS))
    u = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1_000_000))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1_000_000, math.ceil(1e6 * most / n)))])
    sample = known.where(u < F.element_at(share, F.col("lang"))).select("lang", "text")

    def rows(batch: pa.RecordBatch):
        total: dict[str, np.ndarray] = {}
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
            if found := grams(text.as_py()):
                total.setdefault(lang, np.zeros(BINS, np.int64))[found[0]] += found[1]
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield {"lang": [lang] * len(at), "bin": at, "n": counts[at]}

    counted = map_arrow(sample, "lang string, bin int, n long", rows).groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sizes)
    model = np.full((len(langs), BINS), 0.5)
    for k, lang in enumerate(langs):
        own = counted[counted["lang"] == lang]
        model[k, own["bin"].to_numpy()] += own["n"].to_numpy()
    return langs, model / model.sum(1, keepdims=True)


def predict(docs: DataFrame, langs: list[str], model: np.ndarray, keep: list[str], penalty: float = 6.0) -> DataFrame:
    """``keep`` columns, lang_pred, score and the mixture of every row. The model has a fixed size per language."""
    keep = [c for c in keep if c not in ("lang_pred", "score", "mixture")]
    held = docs.sparkSession.sparkContext.broadcast((langs, model))
    kinds = dict(docs.dtypes)

    def one(text):
        names, table = held.value
        found = grams(text) if names else None
        if found is None:
            return "und", 0.0, []
        share = infer(table, *found, penalty)
        top = max(share, key=lambda k: (share[k], -k))
        return names[top], min(1.0, share[top]), [{"lang": names[k], "share": v} for k, v in sorted(share.items())]

    def rows(batch: pa.RecordBatch) -> dict:
        made = [one(t.as_py()) for t in batch["text"]]
        return {c: batch[c] for c in keep} | {"lang_pred": [m[0] for m in made], "score": [m[1] for m in made], "mixture": [m[2] for m in made]}

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return map_arrow(docs.select(*dict.fromkeys(["text", *keep])), f"{schema}, lang_pred string, score double, mixture array<struct<lang: string, share: double>>", rows)


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4
