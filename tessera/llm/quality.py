"""Quality rules with risk-controlled thresholds.

Each document gets counts; each of five rules compares one ratio with a cutoff. Cutoffs are chosen per stratum
(``lang``, null its own). A stratum's labelled documents are dealt to two halves by a hash of doc_id. On the first half a path
of settings is laid: from all rules off, each step makes one rule's cutoff stricter, where that rejects the most more bad
documents, and at least ``gain`` bad ones for each good one. The second half, the holdout, tests the settings of that path
in order: with n good documents of which x would be rejected by any rule, a setting passes if the exact binomial tail
P(X <= x | n, alpha) is at most delta / strata; the first that fails ends the sequence, and the last that passed is used.
The path is fixed before the holdout is looked at, so within a stratum the sequence needs no further correction, however many
rules and cutoffs there are; Bonferroni over strata does the rest. So with probability 1 - delta no stratum loses more than
``alpha`` of its good documents to all rules together. With four strata a holdout of 86 good documents is the least that can
pass a setting: ln(delta / strata) / ln(1 - alpha).

Null text: no words, fails the base rule. Unlabelled or thinly labelled strata have no cutoffs: only the base
rule applies. Empty labels: the same. Empty documents: no rows. Documents repeated in the table are judged row by
row; repeated labels of a document count once, bad if any says so. A kept column with a result's name (n_words and
the other counts, base_failed, kept) gives way to it.

The bound holds for good documents that pass the base rule: what the base rule rejects is fixed beforehand and is
not chosen by labels, so it is not part of the risk that is controlled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_SPACE, fresh, map_arrow, materialise

SYMBOLS = "#*$%&|<>"
#: rule -> cutoffs from mild to strict; a document is rejected above the cutoff.
GRIDS = {
    "symbol_ratio": [2.0, 1.0, 0.5, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04],
    "dup_line_ratio": [0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03],
    "repeat_ratio": [0.18, 0.15, 0.12, 0.1, 0.08, 0.06, 0.04, 0.02],
    "long_words": [15.0, 12.0, 10.0, 9.5, 9.0, 8.5, 8.0, 7.5, 7.0, 6.75, 6.5],
    "short_words": [-2.0, -2.5, -3.0, -3.5, -4.0, -4.5],
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RESULT = {*COUNTS, "base_failed", "kept"}


def repeated_words(words: list, width: int = 5) -> int:
    """Words covered by ``width``-word windows that occur twice or more, the first occurrence included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    known: dict = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    if len(known) == len(words):
        return 0
    base, code = len(known), ids[:n].copy()
    span = base
    for k in range(1, width):
        if span * base >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            span = n
        code, span = code * base + ids[k : k + n], span * base
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    hit = np.zeros(n + 1, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """COUNTS of one text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, ASCII_SPACE))
    lines = [x for x in text.split("\n") if x.strip(ASCII_SPACE)]
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, COUNTS and base_failed of every row."""

    def rows(batch: pa.RecordBatch) -> dict:
        made = np.array([text_counts(t.as_py()) for t in batch["text"]], np.int64).reshape(-1, 5)
        return {c: batch[c] for c in keep} | {c: made[:, k] for k, c in enumerate(COUNTS)}

    kinds = dict(docs.dtypes)
    out = map_arrow(docs.select(*dict.fromkeys(["text", *keep])), ", ".join(f"`{c}` {kinds[c]}" for c in keep) + "".join(f", {c} long" for c in COUNTS), rows)
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def ratios() -> dict:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    mean = F.col("word_chars") / n
    return {"symbol_ratio": F.col("n_symbols") / n, "dup_line_ratio": F.col("n_dup_lines") / n, "repeat_ratio": F.col("n_repeat_words") / n, "long_words": mean, "short_words": -mean}


def first_step(rule: str, ratio: Column) -> Column:
    """The number, from 1, of the first cutoff on the way from mild to strict that rejects the ratio; one more than there are if none does."""
    return sum((F.when(ratio > c, -1).otherwise(0) for c in GRIDS[rule]), F.lit(1 + len(GRIDS[rule]))).cast("int")


def binomial_tail(x: int, n: int, p: float) -> float:
    """P(X <= x) for X ~ Binomial(n, p), summed exactly from the largest term down until terms no longer count."""
    if x >= n:
        return 1.0
    k = min(x, math.floor((n + 1) * p))  # the largest term up to x
    top = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    terms, odds = [1.0], p / (1 - p)
    for step, last in ((-1, 0), (1, x)):
        at, term = k, 1.0
        while at != last and term > 1e-20:
            term *= at / (n - at + 1) / odds if step < 0 else (n - at) / (at + 1) * odds
            at += step
            terms.append(term)
    return min(1.0, math.exp(top) * math.fsum(terms))


def rejects(setting: tuple[int, ...], cell: tuple[int, ...]) -> bool:
    return any(first <= k for first, k in zip(cell, setting))


def path(good: dict, bad: dict, gain: float) -> list[tuple[int, ...]]:
    """Settings from mild to strict: how many cutoffs of each rule's grid were gone down (0: off). good and bad: number of documents by ``first_step`` of each rule."""
    setting, out = tuple(0 for _ in GRIDS), []
    while True:
        left = [{x: n for x, n in seen.items() if not rejects(setting, x)} for seen in (good, bad)]
        best = None
        for i, grid in enumerate(GRIDS.values()):
            for k in range(setting[i] + 1, len(grid) + 1):
                lost, caught = (sum(n for x, n in seen.items() if x[i] <= k) for seen in left)
                if caught and caught >= gain * lost and (best is None or (caught, -lost, -i, -k) > best):
                    best = caught, -lost, -i, -k
        if best is None:
            return out
        setting = tuple(-best[3] if i == -best[2] else k for i, k in enumerate(setting))
        out.append(setting)


def cutoffs(measured: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.05, delta: float = 0.05, gain: float = 10.0) -> list[tuple]:
    """(stratum, cutoff or None of each rule) of the strata with rules on. Only counts by stratum, half, label and cell of the grids reach the driver."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = measured.where(~F.col("base_failed")).join(marks, "doc_id")
    cells = F.array(*[first_step(rule, v) for rule, v in ratios().items()])
    half = F.pmod(F.xxhash64(F.lit(29), F.col("doc_id").cast("long")), F.lit(2))
    found = known.groupBy(F.col(stratum).alias("s"), half.alias("half"), (F.col("quality") > 0).alias("good"), cells.alias("cell")).agg(F.count("*").alias("n")).collect()
    seen: dict = {}
    for r in found:
        seen.setdefault(r["s"], {}).setdefault((r["half"], r["good"]), {})[tuple(r["cell"])] = r["n"]
    strata, chosen = sum(any(good for _, good in own) for own in seen.values()), []
    for key, own in seen.items():
        held, last = own.get((1, True), {}), None
        for setting in path(own.get((0, True), {}), own.get((0, False), {}), gain):
            lost = sum(n for x, n in held.items() if rejects(setting, x))
            if binomial_tail(lost, sum(held.values()), alpha) > delta / strata:
                break
            last = setting
        if last:
            chosen.append((key, *[grid[k - 1] if k else None for k, grid in zip(last, GRIDS.values())]))
    return chosen


def judge(docs: DataFrame, labels: DataFrame, keep: list[str], stratum: str = "lang", **risk) -> DataFrame:
    """``keep`` columns, COUNTS, base_failed and kept of every row of ``docs``."""
    if stratum in RESULT:
        raise ValueError(f"{stratum} is the name of a result")
    keep = [c for c in keep if c not in RESULT]
    cols = list(dict.fromkeys([*keep, "doc_id", stratum]))
    measured = materialise(measure(docs, cols), "quality-counts")
    kind = measured.schema[stratum].dataType
    on = measured.sparkSession.createDataFrame(cutoffs(measured, labels, stratum, **risk), T.StructType([T.StructField("s", kind), *[T.StructField(rule, T.DoubleType()) for rule in GRIDS]]))
    names = {c: fresh(f"cutoff_{c}", measured) for c in on.columns}
    met = measured.join(on.toDF(*names.values()), measured[stratum].eqNullSafe(F.col(names["s"])), "left")  # a row a stratum: small enough to be sent to all, or joined as any table
    rejected = F.lit(False)
    for rule, v in ratios().items():
        rejected = rejected | F.coalesce(v > F.col(names[rule]), F.lit(False))
    return met.withColumn("kept", ~F.col("base_failed") & ~rejected).select(*keep, *COUNTS, "base_failed", "kept")
