"""Runs, phrases and byte-level BPE against brute force and the library."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import bytebpe, collocate, runs
from tessera.llm.queries import queries

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
ODD = "doc_id long, text string, lang string, ids string, runs int, collapsed long, data string, n_tokens long, f int, word string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty texts, repeated rows and columns with names of the results."""
    texts = [None, "", " \n", "a", "a " * 40, "x y " * 9 + "z", "é中\U0001f600 " * 8, "one, two. one two! one\ttwo\vthree", "q" * 3000]
    rows = [(i, t, None if i % 3 else "en", "x", 1, 2, "d", 3, 4, "w") for i, t in enumerate(texts)] * 2 + [(None, "b b b b b b b", "en", *[None] * 7)]
    return spark.createDataFrame(rows, ODD)


def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q) and not any(all(w[x] == w[x + p] for x in range(i, j + q - p)) for p in range(1, q)):
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(w, found):
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def words_of(text):
    return [x.decode() for x in (text or "").encode().split()]


def test_runs_of_random_words():
    rng = random.Random(3)
    for _ in range(150):
        docs = []
        for _ in range(rng.randrange(1, 9)):
            kinds = rng.choice(["a", "ab", "abc", "abcdefghij"])
            w = [rng.choice(kinds) for _ in range(rng.randrange(40))]
            for _ in range(rng.randrange(4)):
                p = [rng.choice(kinds) for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 30]))]
                w = (w + (p * 9)[: rng.randrange(1, 9 * len(p))] + [rng.choice(kinds)] * rng.randrange(3)) * rng.choice([1, 1, 1, 4])
            docs.append([x.encode() for x in w[:300]])
        found, ends = runs.find(docs)
        begins = np.concatenate(([0], ends))
        assert [tuple(r) for r in found.tolist()] == [(s + int(b), n, q) for d, b in zip(docs, begins) for s, n, q in plain_runs(d)]


def test_runs_of_long_words():
    for w, want in (([b"a"] * 100_000, [(0, 100_000, 1)]), ([b"x", b"y", b"z"] * 30_000, [(0, 90_000, 3)]), ([b"%d" % i for i in range(20_000)] * 5, [(0, 100_000, 20_000)]), ([b"%d" % i for i in range(50_000)], [])):
        assert [tuple(r) for r in runs.find([w])[0].tolist()] == want
    a, b = "a", "ab"
    while len(b) < 50_000:
        a, b = b, b + a
    assert not len(runs.find([[c.encode() for c in b]])[0])  # no fourth powers in a Fibonacci word


def test_periodic_runs(docs, odd, empty):
    for df in (docs, odd):
        own = [(r["doc_id"], r["text"]) for r in df.collect()]
        want = Counter()
        for d, t in own:
            w = words_of(t)
            found = plain_runs(w)
            want[d, tuple(found), plain_collapsed(w, found)] += 1
        got = Counter((r["doc_id"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in runs.periodic_runs(df).collect())
        assert got == want
        assert runs.periodic_runs(df, keep=("doc_id", "lang", "runs")).columns == ["doc_id", "lang", "runs", "collapsed"]
        assert runs.digests(runs.periodic_runs(runs.made_periodic(df))).count() == len(own)
    assert runs.digests(runs.periodic_runs(runs.made_periodic(empty))).count() == 0


def test_op11(spark, data):
    source = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    out = queries()["op11_runs"](spark, data)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got, most = out.collect(), 0
    assert len(got) == len(source) == 200
    for r in got:
        w, h = words_of(source[r["doc_id"]]), zlib.crc32(str(r["doc_id"]).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        found = plain_runs(w) if n < 3000 or h % 10 == 0 else [tuple(x) for x in runs.find([[x.encode() for x in w]])[0].tolist()]
        best = max(found, key=lambda x: (x[1] / x[2], -x[0], -x[2])) if found else None
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2])
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(plain_collapsed(w, found).encode()).hexdigest()
        most += len(found)
    assert most >= 10


def plain_phrases(rows):
    """Counts of words and phrases by language."""
    f = Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            for k in range(1, 5):
                f.update((lang or "und", tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    return f


def plain_collocations(rows, least, top):
    f, out = plain_phrases(rows), {}
    often = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    inside = Counter()
    for (lang, w), v in often.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(inside[lang, w[i : i + k]], v)
    for (lang, w), a in often.items():
        if 100 * inside[lang, w] < 80 * a:
            score, _, left, right = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    n = Counter()
    for (lang, w), v in f.items():
        n[lang] += v * (len(w) == 1)
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, own in out.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:top])}


def test_collocations(docs, odd, empty):
    for df in (docs, odd):
        rows = [(r["text"], r["lang"]) for r in df.collect()]
        for least, top, bucket in ((3, 50, 1 << 20), (2, 2000, 60), (2, 10, 7)):  # the smaller buckets are, the more words are very frequent
            got = [tuple(r) for r in collocate.collocations(df, least, top=top, bucket=bucket).collect()]
            assert len(got) == len(set(got)) and set(got) == plain_collocations(rows, least, top)
    assert collocate.collocations(empty).count() == 0


def test_equal_partitions():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n = int(rng.integers(0, 300))
        cols = rng.integers(0, 4, (4, n))
        cols[1:][cols[:-1] == 0] = 0
        cols[2:][cols[1:-1] == 0] = 0
        cols[3:][cols[2:-1] == 0] = 0
        count = rng.integers(1, 5, n)
        row, words, f = collocate.equal_partitions(cols, count, np.full(n, 2), 6)
        want = Counter()
        for i in range(n):
            for k in range(2, 5):
                if cols[:k, i].all():
                    want[tuple(cols[:k, i])] += int(count[i])
        assert {tuple(cols[:k, i]): c for i, k, c in zip(row, words, f)} == {k: c for k, c in want.items() if c >= 6}


def library():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bytebpe_is_the_library(monkeypatch):
    rng, lib = random.Random(1), library()
    texts = ["".join(rng.choice(kinds) for _ in range(n)) for n in (1, 2, 7, 60, 1023, 1030, 4000) for kinds in ("a", "ab", "abcdefgh ", "é中a\U0001f600", "  \n\t a", "'s're'LL 12,.;")]
    own = bytebpe.ByteBpe(PATH, PATTERN)
    want = [lib.encode_ordinary(t) for t in texts]
    assert [x.tolist() for x in own.encode(texts)] == want
    for name, value in (("CHARS", 100), ("RUN", 3), ("KNOWN", 5), ("WIDEST", 4), ("CELLS", 50)):
        monkeypatch.setattr(bytebpe, name, value)
        assert [x.tolist() for x in bytebpe.ByteBpe(PATH, PATTERN).encode(texts)] == want


def test_every_character():
    lib, own = library(), bytebpe.ByteBpe(PATH, PATTERN)
    texts = [f"a{chr(c)}1 {chr(c)}{chr(c)}b" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for a in range(0, len(texts), 100_000):
        assert [x.tolist() for x in own.encode(texts[a : a + 100_000])] == lib.encode_ordinary_batch(texts[a : a + 100_000])


def test_bytebpe(docs, odd, empty):
    lib = library()
    for df in (docs, odd):
        coded = bytebpe.encode(df, PATH, PATTERN, keep=("doc_id", "text", "ids"))
        assert coded.columns == ["doc_id", "text", "ids"]
        got = coded.collect()
        assert len(got) == df.count() and all(r["ids"] == lib.encode_ordinary(r["text"] or "") for r in got)
        back = bytebpe.decode(coded, PATH, PATTERN, keep=("text",)).collect()
        assert all(bytes(r["data"]).decode() == (r["text"] or "") for r in back)
    nothing = odd.select("doc_id", F.lit(None).cast("array<int>").alias("ids"))
    assert {bytes(r["data"]) for r in bytebpe.decode(nothing, PATH, PATTERN).collect()} == {b""}
    assert bytebpe.digests(bytebpe.encode(empty, PATH, PATTERN), PATH, PATTERN).count() == 0


def test_op13(spark, data):
    lib, source = library(), {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    out = queries()["op13_bytebpe"](spark, data)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = out.collect()
    assert len(got) == 200
    for r in got:
        ids = lib.encode_ordinary(source[r["doc_id"]] or "")
        want = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((source[r["doc_id"]] or "").encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), *want)
