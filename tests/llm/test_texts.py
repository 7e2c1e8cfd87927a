"""Fingerprints, near copies, lines and quality rules against brute force."""

import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import linededup, neardup, quality, simhash
from tessera.llm.common import Tables, connected_components, discard, materialise


def spaces(text):
    return (text or "").encode().lower().split()


def plain_fingerprint(text, width=3):
    w = spaces(text)
    s = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def plain_components(prints):
    """Least doc_id reachable; prints: (doc_id, value)."""
    own = [None if d is None else d for d, _ in prints]
    n, root = len(prints), list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in itertools.combinations(range(n), 2):
        if bin(prints[i][1] ^ prints[j][1]).count("1") <= 2:
            root[find(i)] = find(j)
    groups = {}
    for i in range(n):
        if own[i] is not None:
            groups.setdefault(find(i), []).append(own[i])
    return [min(groups.get(find(i), [None])) if groups.get(find(i)) else None for i in range(n)]


def test_simhash(docs, rows, empty):
    for small in (32, 1):
        got = sorted((repr(r["doc_id"]), r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.components(docs, small=small).collect())
        prints = [(d, plain_fingerprint(t)) for d, t, _, _ in rows]
        assert got == sorted((repr(d), fp, c) for (d, fp), c in zip(prints, plain_components(prints)))
    assert simhash.components(empty).count() == 0


def test_simhash_representatives(spark, docs, rows, empty):
    """One row of each component of fingerprints, by brute force over all pairs; columns stay."""
    items = sorted({(-(1 << 63) if d is None else d, t) for d, t, _, _ in rows}, key=lambda x: (x[0], x[1] or ""))
    heads = set(plain_components([(i, plain_fingerprint(t)) for i, (_, t) in enumerate(items)]))
    for small in (32, 1):
        kept = simhash.representatives(docs, small=small)
        assert sorted((-(1 << 63) if r["doc_id"] is None else r["doc_id"], r["text"]) for r in kept.select("doc_id", "text").collect()) == sorted(items[i] for i in heads)
    assert kept.columns == docs.columns and simhash.representatives(empty).count() == 0
    odd = docs.select("*", F.lit(1).alias("k"), F.lit(2).alias("fp"), F.lit(3).alias("root"), F.lit(4).alias("least"))
    assert simhash.representatives(odd).count() == len(heads) and set(simhash.representatives(odd).columns) == set(odd.columns)


def test_pipeline_near_dedup_is_by_fingerprints(spark):
    """A phrase a hundred times with two tails: the shingle sets are unlike, the fingerprints (repeats count) are equal."""
    import corpus_pipeline

    texts = ["mill river stone " * 100 + tail for tail in ("a b c d e f g h i j k l m n o p", "q r s t u v w x y z 1 2 3 4 5 6")]
    assert plain_fingerprint(texts[0]) == plain_fingerprint(texts[1])
    made = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, made, "").collect()] == [0]


def test_near_dedup_shuffles_no_text(spark):
    """Few rows go, so texts stay where they are; with many (no broadcast), and with repeated rows, the same rows stay."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    texts = ["mill river stone house", "a b c d e f", "mill river stone house", "one two three four"]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, first string").repartition(2)
    twice = spark.createDataFrame([*rows, rows[1], rows[2], (None, None, None), (None, None, None)], plain.schema)
    before = spark.conf.get(key)
    try:
        for threshold in ("10m", "-1"):
            spark.conf.set(key, threshold)
            kept = simhash.representatives(plain.cache())
            assert ("hashpartitioning" in kept._jdf.queryExecution().executedPlan().toString()) == (threshold == "-1")
            assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 3]
            again = simhash.representatives(twice)
            assert sorted(repr(r["doc_id"]) for r in again.collect()) == ["0", "1", "3", "None"] and again.columns == plain.columns
    finally:
        spark.conf.set(key, before)


def test_spark_hash_is_xxh64(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_close_links_in_crowded_blocks(spark):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 1 << 62, 6)]
    fps = sorted({b ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 4), False)) for b in base for _ in range(60)})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    want = plain_components([(f, f) for f in fps])
    for small in (1, 8, 1000):
        roots = {r["node"] & (1 << 64) - 1: r["root"] for r in connected_components(simhash.close_links(df, small)).collect()}
        groups = {}
        for f, w in zip(fps, want):
            groups.setdefault(w, set()).add(roots.get(f, f))
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_a_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "u long, v long")
    got = {r["node"]: r["root"] for r in connected_components(e).collect()}
    assert set(got.values()) == {0, 1000} and len(got) == 203


def plain_representatives(items):
    """Of (doc_id, text) pairs, the first of each component of similar shingle sets."""
    sets = {}
    for d, t in items:
        w = spaces(t)
        sets[(d, t)] = {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    items = sorted(sets, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    root = {x: x for x in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(items, 2):
        both = len(sets[a] & sets[b])
        if (not sets[a] and not sets[b]) or both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            ra, rb = find(a), find(b)
            root[max(ra, rb, key=items.index)] = min(ra, rb, key=items.index)
    return [x for x in items if find(x) == x]


def test_neardup_keeps_one_of_each_group(docs, rows, empty):
    kept = sorted(repr(r["doc_id"]) for r in neardup.representatives(docs).collect())
    assert kept == sorted(repr(x[0]) for x in plain_representatives([r[:2] for r in rows]))
    assert neardup.representatives(empty).count() == 0 and set(neardup.representatives(docs).columns) == set(docs.columns)


def test_neardup_is_exact_in_a_crowd(spark):
    """Hundreds of pages of one template and a large group of near copies: every similar pair decides, not neighbours."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    frame = [word() for _ in range(120)]
    pages = [" ".join(frame + [word() for _ in range(rng.randrange(18, 60))]) for _ in range(500)]
    texts = list(pages)
    for i in range(0, 60, 2):  # pairs that just reach the similarity, or just miss it
        texts.append(" ".join(pages[i].split()[: -rng.randrange(8, 40)] + [word() for _ in range(4)]))
    core = [word() for _ in range(80)]
    texts += [" ".join(core + [word() for _ in range(rng.randrange(0, 12))]) for _ in range(300)]
    rng.shuffle(texts)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    want = [i for i in range(len(texts)) if find(i) == i]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for frequent in (200_000, 0):  # the order of shingles changes the work, not the result
        assert sorted(r["doc_id"] for r in neardup.representatives(docs, frequent=frequent).collect()) == want


def test_neardup_meets_every_pair_that_just_reaches_the_similarity(spark):
    """Fifteen hundred pairs of 40 and 36 shingles, 34 shared: 34 of 42 is 0.81."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    texts = []
    for _ in range(1500):
        shared = [word() for _ in range(38)]
        texts += [" ".join(shared + [word() for _ in range(6)]), " ".join(shared + [word(), word()])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in neardup.representatives(docs).collect()) == list(range(0, 3000, 2))


def plain_line_dedup(rows, least_lines=2, least_chars=100):
    """No alignment: every run of lines that reaches the rule and that an earlier document has goes."""
    items = sorted({(-(1 << 63) if d is None else d, t) for d, t, _, _ in rows}, key=lambda x: (x[0], xxhash_signed(x[1])))
    lines = {x: (x[1] or "").split("\n") for x in items}
    seen, out = set(), {}
    for x in items:
        own, gone, found = lines[x], set(), set()
        for s in range(len(own)):
            words, chars, run, known = 0, 0, None, True
            for e in range(s, len(own)):
                words, chars, run = words + bool(own[e].strip(" \t\n\v\f\r")), chars + len(own[e]), hash((run, own[e]))
                if words >= least_lines or words and chars >= least_chars:
                    found.add(run)
                    known = known and run in seen
                    if known:
                        gone.update(range(s, e + 1))
        seen |= found
        out[x] = "\n".join(t for j, t in enumerate(own) if j not in gone)
    return out


def xxhash_signed(text):
    if text is None:
        return 42
    v = xxhash.xxh64_intdigest(text.encode(), 42)
    return v - (1 << 64) if v >> 63 else v


def test_line_dedup(docs, rows, empty):
    want = plain_line_dedup(rows)
    clash = docs.withColumn("was", F.col("text")).withColumn("removed", F.lit("x")).withColumn("n_removed", F.lit("y")).withColumn("k", F.lit(1)).withColumn("hashes", F.lit(2))
    for rare in (4, 0):
        out = linededup.dedup(clash, rare=rare)
        assert out.columns == [c for c in clash.columns if c != "n_removed"] + ["n_lines", "n_removed"]
        for r in out.collect():
            key = (-(1 << 63) if r["doc_id"] is None else r["doc_id"], r["was"])
            assert (r["text"] or "") == want[key] and r["removed"] == "x" and r["n_lines"] == (0 if r["was"] is None else r["was"].count("\n") + 1)
    assert linededup.dedup(empty).count() == 0


def test_line_dedup_is_that_of_all_runs(spark):
    """Short and blank lines, frequent lines apart, twice or in crossed order in the first documents: every run counts."""
    rng = random.Random(3)
    own = itertools.count()
    other = lambda: f"only here {next(own)}"
    one, two, long = "a line that many hold", "another that many hold", "x" * 101
    texts = [[one, two, other()], [one, other()], [other(), two], [other(), one, two]]  # the whole block is in the first only
    texts += [[one, other(), one, two, other(), one, two], [two, one, other(), two, one], [other(), one, two, ""], [long, "", "s"], ["s", long, "", ""]]
    texts += [["so short", "a list", other()], [other(), "so short", "a list"], ["\t" * 60, "\t" * 60, other()], [other(), "\t" * 60, "\t" * 60]]
    texts += [["l1 of many", "l2 of many"]] + [["l1 of many", other()]] * 6 + [[other(), "l2 of many"]] * 6 + [["l1 of many", "l2 of many"]]
    lines = [one, two, long, "a", "b", "c", "", " ", "\t" * 60, "y" * 45]
    texts += [[other() if rng.random() < 0.15 else rng.choice(lines) for _ in range(rng.randrange(1, 14))] for _ in range(70)]
    texts += [["z" * 3_000_000], ["before", "z" * 3_000_000]]  # very long lines
    rows = [(10 * i, "\n".join(x), None, None) for i, x in enumerate(texts)]
    want = plain_line_dedup(rows)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    for rare in (4, 1):
        assert [r["text"] for r in linededup.dedup(docs, rare=rare).orderBy("doc_id").collect()] == [want[r[:2]] for r in rows]
    assert want[rows[3][:2]].count("\n") == 0 and want[rows[25][:2]] == "" and want[rows[-1][:2]] == "before"
    removed = [set() for _ in texts]  # what patience diffs of all pairs find is part of it
    for (i, a), (j, b) in itertools.combinations(enumerate(texts[:-2]), 2):
        removed[j].update(linededup.common_blocks(a, b, [len(x) for x in b], 2, 100, {k for k, x in enumerate(b) if not x.strip(" \t\n\v\f\r")}))
    for r, b, gone in zip(rows, texts, removed):
        kept = Counter(want[r[:2]].split("\n"))
        assert not kept - Counter([x for k, x in enumerate(b) if k not in gone] or [""])


def test_line_dedup_of_a_hot_line(spark):
    """A passage that thousands of documents hold, twice in some: each is aligned once, and all but the first lose it."""
    long = "a line of over a hundred characters that very many documents hold, with the same words in each of them, to the end"
    docs = spark.range(3000).selectExpr("id AS doc_id", f"concat('own ', id, '\n{long}', if(id % 3 = 0, concat('\nmore ', id, '\n{long}'), '')) AS text")
    once = linededup.sketch(docs, 2, 100)
    assert linededup.candidates(once, 4).count() == 2999
    got = {r["doc_id"]: r["text"] for r in linededup.dedup(docs).collect()}
    assert got[0].count(long) == 2 and all(long not in got[i] and f"own {i}" in got[i] for i in range(1, 3000))


def test_line_dedup_of_short_lines(spark):
    """A repeated verse without a line of 20 characters."""
    verse = [f"short {i}" for i in range(60)]
    docs = spark.createDataFrame([(1, "\n".join(verse)), (2, "\n".join(["before", *verse, "after"]))], "doc_id long, text string")
    assert [r["text"] for r in linededup.dedup(docs).orderBy("doc_id").collect()] == ["\n".join(verse), "before\nafter"]


def test_line_dedup_of_crossed_runs(spark):
    """Fifty thousand lines, in runs of two whose order is reversed, in seconds; a compilation takes a small row for each document it is made of."""
    import time

    lines = [(f"line number {k} of the first", f"and the line after {k}") for k in range(25_000)]
    a, b = "\n".join(x for p in lines for x in p), "\n".join(x for p in reversed(lines) for x in p)
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    runs = linededup.candidates(linededup.sketch(docs, 2, 100), 4).collect()[0]["runs"]
    own, began = [r.asDict() for r in runs], time.perf_counter()
    assert linededup.shared_lines(own, 2, 100) == list(range(50_000)) and time.perf_counter() - began < 2
    parts = [f"part {k} has this line\nand part {k} has that one" for k in range(2000)]
    docs = spark.createDataFrame([*enumerate(parts), (9999, "\n".join(f"{p}\nbetween {k}" for k, p in enumerate(parts)))], "doc_id long, text string")
    pairs = linededup.candidates(linededup.sketch(docs, 2, 100), 4)
    assert pairs.count() == 2000 and pairs.agg(F.max(F.size("runs"))).first()[0] == 1
    left = linededup.dedup(docs).where("doc_id = 9999").first()["text"]
    assert left == "\n".join(f"between {k}" for k in range(2000))


def test_clashing_names(spark, docs):
    """Columns with names that operators use inside, in any case of letters, stay as they are."""
    from tessera.llm import mixing

    odd = docs.where("doc_id < 20")
    for c in ("k", "TH", "removed", "h1", "H2", "rid", "own", "__k", "__rid", "s", "runs_"):
        odd = odd.withColumn(c, F.lit(f"own {c}"))
    for made in (linededup.dedup(odd), neardup.representatives(odd), mixing.resample(odd)):
        rows = made.collect()
        assert rows and all(r[c] == f"own {c}" for r in rows for c in ("k", "TH", "removed", "H2", "rid", "own", "__k", "__rid", "s"))


def test_patience_alignment():
    a, b = list("abcdefg"), list("xbcydefz")
    assert linededup.align(a, b) == [(1, 1), (2, 2), (3, 4), (4, 5), (5, 6)]
    assert linededup.align([], b) == [] and linededup.align(a, a) == [(i, i) for i in range(7)]
    assert linededup.common_blocks(a, b, [1] * 8, 3, 999, set()) == [4, 5, 6]


def plain_counts(text):
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_quality_counts(docs, rows, empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = sorted(repr((r["doc_id"], *(r[c] for c in quality.COUNTS), r["base_failed"], r["kept"])) for r in quality.judge(docs, labels, ["doc_id"]).collect())
    want = []
    for d, t, _, _ in rows:
        c = plain_counts(t)
        bad = c[0] < 10 or 100 * c[4] > 20 * c[0]
        want.append(repr((d, *c, bad, not bad)))
    assert got == sorted(want)
    assert quality.judge(empty, labels, ["doc_id"]).count() == 0


def halves(spark, ids):
    """Which half (1: holdout) each label is dealt to."""
    rows = spark.createDataFrame([(d,) for d in ids], "d long").select("d", F.pmod(F.xxhash64(F.lit(29), "d"), F.lit(2)).alias("h")).collect()
    return {r["d"]: r["h"] for r in rows}


def plain_verdicts(rows, marks, half, alpha=0.05, delta=0.05, gain=10):
    """doc_id -> kept, by the description: a path laid on one half of the labels, tested in order on the other."""
    counts = {d: plain_counts(t) for d, t, _ in rows}
    ratio = {"symbol_ratio": lambda c: c[2] / max(1, c[0]), "dup_line_ratio": lambda c: c[3] / max(1, c[0]), "repeat_ratio": lambda c: c[4] / max(1, c[0]), "long_words": lambda c: c[1] / max(1, c[0]), "short_words": lambda c: -c[1] / max(1, c[0])}
    passed = {d for d, c in counts.items() if c[0] >= 10 and 100 * c[4] <= 20 * c[0]}
    by = {}
    for d, _, lang in rows:
        if d in passed and d in marks:
            by.setdefault(lang, {(h, q): [] for h in (0, 1) for q in (0, 1)})[half[d], marks[d]].append(counts[d])
    strata = [x for x in by if by[x][0, 1] or by[x][1, 1]]
    fails = lambda cut, c: any(ratio[rule](c) > x for rule, x in cut.items())
    cut = {}
    for lang in by:
        way, now = [], {}
        while True:
            steps = []
            good, bad = ([c for c in by[lang][0, q] if not fails(now, c)] for q in (1, 0))
            for i, (rule, grid) in enumerate(quality.GRIDS.items()):
                for k, x in enumerate(grid):
                    if x < now.get(rule, math.inf):
                        lost, caught = sum(ratio[rule](c) > x for c in good), sum(ratio[rule](c) > x for c in bad)
                        if caught and caught >= gain * lost:
                            steps.append((-caught, lost, i, k, rule, x))
            if not steps:
                break
            now = now | {min(steps)[4]: min(steps)[5]}
            way.append(now)
        n = len(by[lang][1, 1])
        for setting in way:
            lost = sum(fails(setting, c) for c in by[lang][1, 1])
            if sum(math.comb(n, k) * alpha**k * (1 - alpha) ** (n - k) for k in range(lost + 1)) > delta / len(strata):
                break
            cut[lang] = setting
    return {d: d in passed and not fails(cut.get(lang, {}), counts[d]) for d, _, lang in rows}, cut


def test_verdicts_by_brute_force(spark):
    """Several languages (one of them null, one too small for any bound), labels with errors, rules that hurt good documents."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows, marks = [], {}
    for d in range(3600):
        lang, bad = ("en", "de", None, "xx")[d % 4 if d < 3400 or d % 4 < 3 else 0] if d < 40 or d % 4 < 3 else "en", rng.random() < 0.25
        n = rng.randrange(4 if d % 50 == 0 else 14, 40)
        words = [word(rng.randrange(3, 13 if bad and lang == "de" else 7)) for _ in range(n)]
        if bad and lang == "en":
            words = [w + rng.choice("#$|") if rng.random() < 0.5 else w for w in words]
        text = " ".join(words)
        if bad and lang is None:
            text += f"\n{word(5)} x" + "\na b" * 5
        elif rng.random() < 0.01:
            text += " # $ % &"
        rows.append((d, text, lang))
        if d % 5:
            marks[d] = int(bad != (rng.random() < 0.02)) ^ 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([*marks.items(), (1, None), (None, 1)], "doc_id long, quality int")
    want, cut = plain_verdicts(rows, marks, halves(spark, marks))
    clash = docs.withColumn("n_words", F.lit("x")).withColumn("kept", F.lit(7))
    out = quality.judge(clash, labels, ["doc_id", "n_words", "kept"])
    assert out.columns == ["doc_id", *quality.COUNTS, "base_failed", "kept"]
    assert {r["doc_id"]: r["kept"] for r in out.collect()} == want and len(cut) >= 3 and len({r for c in cut.values() for r in c}) >= 3 and 0 < sum(want.values()) < len(want)


@pytest.mark.parametrize("rule", list(quality.GRIDS))
def test_each_rule_catches_alone(spark, rule):
    """Bad documents that only one rule tells from good ones; 86 good documents in the holdout are the least for four strata."""
    size = {"long_words": 18, "short_words": 2}.get(rule, 7)
    tail = {"symbol_ratio": " # $ % &", "dup_line_ratio": "\nsame line" * 5, "repeat_ratio": " one two six ten new old" * 2}.get(rule, "")
    body = lambda n, d: " ".join("abcdefghijklmnop"[: n - 2] + chr(97 + k % 26) + chr(97 + (k // 26 + d) % 26) for k in range(60))
    rows = [(d, body(7, d), "en") for d in range(260)] + [(1000 + d, body(size, d) + tail, "en") for d in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, int(d < 1000)) for d, _, _ in rows], "doc_id long, quality int")
    on = quality.cutoffs(quality.measure(docs, ["doc_id", "lang"]), labels)
    assert [x is not None for x in on[0][1:]] == [r == rule for r in quality.GRIDS]
    out = quality.judge(docs, labels, ["doc_id"]).collect()
    assert all(r["kept"] == (r["doc_id"] < 1000) for r in out)
    assert math.ceil(math.log(0.05 / 4) / math.log(0.95)) == 86


def test_thresholds_are_bounded(spark):
    n = 1200
    good = [(i, "clean words of a plain text that says nothing much at all " + str(i), "en") for i in range(n)]
    bad = [(n + i, "a| b# c$ d% e& f* g< h> i| j# k$ l% " + str(i), "en") for i in range(100)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, int(d < n)) for d in range(n + 100)] + [(0, 1)], "doc_id long, quality int")
    out = quality.judge(docs, labels, ["doc_id"]).collect()
    assert all(r["kept"] == (r["doc_id"] < n) for r in out)
    few = labels.where("doc_id < 30 or doc_id >= 1200")
    assert all(r["kept"] for r in quality.judge(docs, few, ["doc_id"]).collect())  # too few good labels for any bound


def test_binomial_tail():
    exact = sum(math.comb(50, k) * 0.1**k * 0.9 ** (50 - k) for k in range(4))
    assert abs(quality.binomial_tail(3, 50, 0.1) - exact) < 1e-12 and quality.binomial_tail(50, 50, 0.1) == 1
    for n, p in ((40, 0.3), (300, 0.02)):
        for x in range(n):
            exact = math.fsum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x + 1))
            assert abs(quality.binomial_tail(x, n, p) - exact) < 1e-9 * exact + 1e-15


def test_hash_of_nothing():
    assert simhash.fingerprint([]) == 0 and hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_tables_are_their_threads_own(spark):
    """What a block drops is its own: not what other blocks, other threads or nobody's block wrote."""
    import os
    import threading

    made = lambda n: materialise(spark.range(n).toDF("x"), "test-tables")
    there = lambda t: os.path.isdir(t._tessera_path.removeprefix("file://"))
    free, other = made(1), []
    with Tables(spark) as own:
        a = made(3)
        thread = threading.Thread(target=lambda: other.append(made(2)))
        thread.start()
        thread.join()
        with Tables(spark) as inner:
            b = made(4)
        inner.drop()
    assert there(a) and not there(b) and a.count() == 3
    own.drop(keep=a)
    assert there(a)
    own.drop()
    assert not there(a) and there(free) and other[0].count() == 2
    discard(free, *other)
    assert not there(free) and not there(other[0])
