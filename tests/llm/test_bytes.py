"""Tokens, pieces, media, archives, mixing, languages and repeats: round trips and brute force."""

import gzip
import hashlib
import itertools
import math
import random
import tempfile
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import bwt, langid, media, mixing, packing, pieces, suffix, warc

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# --- bit packing --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 32])
def test_pack_unpack(bits):
    x = np.random.default_rng(bits).integers(0, 1 << bits, 1001).astype(np.uint32)
    assert (packing.unpack(packing.pack(x, bits), bits, len(x)) == x).all()


def test_crc_join():
    for a, b in ((b"", b""), (b"abc", b""), (b"", b"xy"), (b"abc" * 99, b"defg" * 1000)):
        assert packing.crc32_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_word_encoder_is_the_tokenizer():
    e = packing.WordEncoder(WORD, most_words=200, most_cores=150)
    rng, letters = random.Random(1), "abcXÉéßİıſ中文ñ'’.,!?<|>0123 \t\n\x0b\x1c ̸́&#日本ΣςⅫ½é"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["it's don't <|startoftext|>x a<|endoftext|>", ""]
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for k in range(0, len(texts), 500) for x in e(pa.array(texts[k : k + 500]))] == want
    assert [x.tolist() for x in e(pa.array([None, "", " \n", "a  b "]))] == [[], [], [], e.tokenizer.encode("a b", add_special_tokens=False).ids]


def test_tokens(docs, rows, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    got = packing.read_ids(packing.write_ids(docs, WORD, 49_408, 2, shards=3, block_ids=64), with_ids=True).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start, want = 0, []
    for d, text, _, _ in order:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((d, start, len(ids), crc(ids), ids))
        start += len(ids)
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) for r in got] == want
    assert packing.read_ids(packing.write_ids(empty, WORD, 49_408, 2)).count() == 0


# --- pieces -------------------------------------------------------------------------------------------------------


def split_encode(p, text, chunk):
    t = (pieces.MARK if p.prefix else "") + text.replace(" ", pieces.MARK)
    cuts = [*range(0, len(t), chunk), len(t)]
    ends = pieces.chain([p.transfer(t, a, b) for a, b in zip(cuts, cuts[1:])], 0, 0)
    return [i for a, b, s, e in zip(cuts, cuts[1:], [0, *ends], ends) for i in p.trace_ids(t, a, b, s, e)]


ADVERSE = ["a" * 300, " " * 200 + "x", "the" * 100, "é" * 90, "internationalization" * 20, "日本語中文" * 40]


@pytest.mark.parametrize("chunk", [33, 100])
def test_scan_gives_the_models_pieces(rows, chunk):
    p = pieces.model(PIECE)
    rng = random.Random(2)
    noise = ["".join(rng.choice("abcdehinorstéß 中日. ▁\n0😀ĀQ") for _ in range(rng.randrange(1, 300))) for _ in range(60)]
    for text in [*{(t or "")[:900] for _, t, _, _ in rows}, *ADVERSE, *noise]:
        if text:
            assert split_encode(p, text, chunk) == p.whole.encode(text)


def test_scan_of_a_unigram_model():
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    with open(PIECE, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1  # the same vocabulary and scores, read as a unigram model
    for x in m.pieces:
        x.score = max(x.score, -40_000)
    with tempfile.NamedTemporaryFile(suffix=".model") as f:
        f.write(m.SerializeToString())
        f.flush()
        p = pieces.Pieces(f.name)
    value = lambda ids: sum(p.scores.get(p.whole.id_to_piece(i), 0.0) for i in ids)
    for text in ["hello world, this is a test", "internationalization " * 9, "thethethe" * 20]:
        got, want = split_encode(p, text, 40), p.whole.encode(text)
        assert got == want or abs(value(got) - value(want)) < 1e-3 * abs(value(want))


def test_pieces_over_rows(docs, rows, empty, monkeypatch):
    sp = pieces.model(PIECE).whole
    monkeypatch.setattr(pieces, "GROUP", 3)
    out = pieces.encode(docs, PIECE, chunk=200, with_ids=True)
    got = sorted(repr((r["doc_id"], r["n_tokens"], r["ids_crc32"], r["ids"])) for r in out.collect())
    want = [(d, sp.encode(t or "")) for d, t, _, _ in rows]
    assert got == sorted(repr((d, len(i), crc(i), i)) for d, i in want)
    back = {repr(r["doc_id"]): r["text"] for r in pieces.decode(out.where("doc_id < 300"), PIECE).collect()}
    assert all(back[repr(d)] == t for d, t, _, _ in rows if d is not None and d < 300)
    assert max(r["n_chunks"] for r in out.collect()) > 9
    assert pieces.encode(empty, PIECE).count() == 0


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "a b", 7, "x", "y", 3)], "doc_id long, text string, n_chars long, ids string, shard string, first long")
    out = pieces.encode(docs, PIECE, keep=("doc_id", "n_chars", "ids"), with_ids=True)
    assert out.columns == ["doc_id", "n_chars", "n_chunks", "n_tokens", "ids_crc32", "round_trip", "ids"] and out.first()["n_chars"] == 3
    assert packing.read_ids(packing.write_ids(docs, WORD, 49_408, 2)).count() == 1
    assert suffix.remove(docs.withColumn("k1", F.lit("z")).withColumn("runs", F.lit(1))).first()["n_bytes"] == 3
    assert mixing.resample(docs.withColumn("source", F.lit("s")).withColumn("rid", F.lit(1)).withColumn("size", F.lit(1))).first()["rid"] == 1
    assert media.analyse(media.store(docs.withColumn("media", F.lit(1)))).first()["n_bytes"] == 3


# --- media --------------------------------------------------------------------------------------------------------


def test_media(docs, rows, empty):
    stored = media.store(docs)
    got = {}
    for r in media.analyse(stored).collect():
        got.setdefault(repr(r["doc_id"]), []).append(r)
    for d, t, _, _ in rows:
        raw = (t or "").encode()
        raw += b" " * (192 if not raw else -len(raw) % 192)
        r = next(x for x in got[repr(d)] if x["payload_sha256"] == hashlib.sha256(raw).hexdigest())
        wav = media.to_wav((t or "").encode())
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len((t or "").encode()), len(raw), zlib.crc32(raw[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(wav), hashlib.sha256(wav).hexdigest()) and media.from_wav(wav) == raw
    for same in (0, 1):
        assert got[repr(100 + same)][0]["feature"] == got[repr(105 + same)][0]["feature"]
    assert media.analyse(media.store(empty)).count() == 0


def test_resampling_is_filtering():
    x = np.random.default_rng(0).integers(0, 256, 960).astype(np.uint8)
    t = np.arange(media.UP * media.TAPS) - (media.UP * media.TAPS - 1) / 2
    h = np.sinc(t / max(media.UP, media.DOWN)) * np.kaiser(len(t), 8.0)
    z = np.zeros(len(x) * media.UP)
    z[:: media.UP] = (x.astype(float) - 128) / 128
    full, n = np.convolve(z, h / h.sum() * media.UP), len(x) * media.UP // media.DOWN
    y = media.resample(x, 0, n)
    assert min(np.abs(full[s :: media.DOWN][20 : n - 20] - y[20 : n - 20]).max() for s in range(60)) < 1e-9
    assert np.array_equal(y, np.concatenate([media.resample(x, 0, 100), media.resample(x, 100, 331), media.resample(x, 331, n)]))


def test_segments_and_tensors():
    e = np.array([0, 0, 9, 9, 5, 5, 0, 0, 9, 0, 5.0, 5, 5, 5])
    assert media.segments(e) == [(2, 6), (8, 9)]
    b = media.tensors(np.ones((70, media.MELS), np.int16))
    assert b["n_frames"].to_pylist() == [32, 32, 6] and b["tensor"].type.shape == list(media.SHAPE) and b["start_ms"].to_pylist() == [0, 256, 512]
    frames, spans = media.read_tensors(media.to_ipc(b))
    assert frames.shape == (70, media.MELS) and (frames == 1).all() and spans[1] == (256, (63 * 96 + 256) * 1000 // 12000)


def plain_features(raw):
    """Frames of tenths of dB, frame energies and segments, from the definitions: sums over taps, samples and bins."""
    x = [(b - 128) / 128 for b in raw]
    taps = media.UP * media.TAPS
    h = np.sinc((np.arange(taps) - (taps - 1) / 2) / 4) * np.kaiser(taps, 8.0)
    h = h / h.sum() * media.UP
    n = len(x) * 3 // 4
    y = [sum(h[k] * x[i] for i in range(max(0, j * 4 // 3 - 20), min(len(x), j * 4 // 3 + 20)) if 0 <= (k := j * 4 - i * 3 + 21) < taps) for j in range(max(n, 256))]
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    edges = [700 * (10 ** ((mel(60) + (mel(6000) - mel(60)) * k / (media.MELS + 1)) / 2595) - 1) for k in range(media.MELS + 2)]
    frames, energy = [], []
    for at in range(0, max(1, n - 255), 96) if n >= 256 else [0]:
        w = [y[at + k] * (0.5 - 0.5 * math.cos(2 * math.pi * k / 256)) for k in range(256)]
        power = [abs(sum(w[k] * complex(math.cos(2 * math.pi * b * k / 256), -math.sin(2 * math.pi * b * k / 256)) for k in range(256))) ** 2 for b in range(129)]
        own = []
        for lo, mid, hi in zip(edges, edges[1:], edges[2:]):
            own.append(sum(p * max(0, min((f - lo) / (mid - lo), (hi - f) / (hi - mid))) for b, p in enumerate(power) for f in [b * 12000 / 256]))
        frames.append([100 * math.log10(v + 1e-6) for v in own])
        energy.append(100 * math.log10(sum(power) + 1e-6))
    return np.array(frames), np.array(energy)


def test_features_from_the_definitions(spark):
    """Steps may differ by one where a value lies between two."""
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc xyz~!\n") for _ in range(700)), "short", "a" * 300 + "~" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in media.analyse(media.store(docs)).collect():
        raw = texts[r["doc_id"]].encode()
        raw += b" " * (-len(raw) % 192)
        frames, spans = media.read_tensors(r["tensors"])
        want, energy = plain_features(raw)
        assert frames.shape == want.shape and np.abs(frames - want).max() <= 0.5 + 1e-6
        on, state = [], False
        mid = np.median(np.round(energy) / 10)
        for k, v in enumerate(np.round(energy) / 10):
            state = True if v > mid + media.RISE else False if v < mid - media.RISE else state
            if state and on and on[-1][1] == k:
                on[-1][1] = k + 1
            elif state:
                on.append([k, k + 1])
        assert [(s["start_ms"], s["end_ms"]) for s in r["segments"]] == [(a * 8, ((b - 1) * 96 + 256) * 1000 // 12000) for a, b in on]
        assert r["feature"].startswith(f"frames={len(want)};segments={len(on)};on={sum(b - a for a, b in on)};")
        assert spans[0] == (0, ((min(32, len(want)) - 1) * 96 + 256) * 1000 // 12000)


# --- archives -----------------------------------------------------------------------------------------------------


def archives(path):
    return sorted(f for f in Path(path.removeprefix("file:").replace("//", "/", 1)).glob("part-*") if f.stat().st_size)


def test_warc(spark):
    record = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:7>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    big = "x" * 1500
    rows = [(1, "u", big), (2, "u", big), (9, None, big), (3, "u\r\nv", record * 3), (4, "u", "WARC/1.1\r\n" * 50), (5, "u", None), (6, "u", ""), (7, "u", "é" * 600), (8, "u", "short"), (10, "u", "short"), (None, "u", "n" * 2000)]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, head string, payload int").repartition(2)
    for split, size in ((1 << 20, 1 << 20), (700, 2000), (100, 100)):
        path = warc.write(pages, archive_bytes=size)
        made = [gzip.decompress(f.read_bytes()).count(b"WARC-Record-ID") - 3 * gzip.decompress(f.read_bytes()).count(b"hello") // 3 for f in archives(path)]
        assert sum(made) == len(rows) and all(f.stat().st_size <= size + len(warc.EMPTY) or n == 1 for f, n in zip(archives(path), made)) and (len(made) == len(rows)) == (size == 100)
        got = {r["page_id"]: r for r in warc.page_records(warc.read(spark, path, split)).collect()}
        assert len(got) == len(rows) and all(r["digest_ok"] for r in got.values())
        for d, _, html in rows:
            raw = (html or "").encode()
            r = got[d]
            assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
            assert (r["record_type"], r["refers_to"]) == (("revisit", 9) if d in (1, 2) else ("response", None))
    assert warc.read(spark, warc.write(pages.limit(0))).count() == 0


def test_members_of_archives(spark):
    """Each record can be read at its offset alone, and the file is gzip to its last byte, large records included."""
    rng = random.Random(6)
    noise = "".join(chr(rng.randrange(32, 1000)) for _ in range(3000))
    pages = spark.createDataFrame([(1, "u", noise), (2, "u", "y" * (17 << 20)), (3, "v", "z")], "page_id long, url string, html string").coalesce(1)
    path = warc.write(pages, archive_bytes=64 << 20)
    (one,) = archives(path)
    data, sizes = one.read_bytes(), {1: len(noise.encode()), 2: 17 << 20, 3: 1}
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 3
    for r in warc.read(spark, path).collect():
        z = zlib.decompressobj(31)
        plain = z.decompress(data[r["offset"] :])
        assert z.eof and plain.startswith(b"WARC/1.1\r\n") and plain.count(b"WARC-Type") == 1 and r["payload_bytes"] == sizes[r["page_id"]]
    path = warc.write(pages.where("page_id = 2"))
    assert archives(path)[0].read_bytes().endswith(warc.EMPTY) and warc.read(spark, path).count() == 1


def test_archives_in_payloads(spark, tmp_path):
    """Stored, not compressed: whole members inside a payload are candidates but not on the chain."""
    inner = warc.compressed(warc.record(5, "u", "inner", hashlib.sha1(b"inner").hexdigest(), 5, None))
    block = b"HTTP/1.1 200 OK\r\nContent-Length: " + str(3 * len(inner)).encode() + b"\r\n\r\n" + inner * 3
    outer = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: " + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(0, zlib.DEFLATED, 31)
    member = z.compress(outer) + z.flush()
    last = warc.compressed(warc.record(2, "u", "after", hashlib.sha1(b"after").hexdigest(), 5, None))
    assert len(warc.scan(member + last)[1]) == 5
    for k, data in enumerate((member + last, outer + gzip.decompress(last), gzip.compress(outer + gzip.decompress(last)))):
        folder = tmp_path / str(k)
        folder.mkdir()
        (folder / "a.warc.gz").write_bytes(data)
        for split in (1 << 20, 64):
            assert sorted(r["page_id"] for r in warc.read(spark, str(folder), split).collect()) == [1, 2]


def test_long_headers_and_broken_archives(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "data:," + "x" * 100_000, "b"), (3, "u", "c")], "page_id long, url string, html string").coalesce(1)
    path = warc.write(pages)
    assert {r["page_id"] for r in warc.read(spark, path).collect()} == {1, 2, 3}
    whole = b"".join(f.read_bytes() for f in archives(path))
    for k, data in enumerate((gzip.decompress(whole)[:-9], whole[:-9], whole[: len(whole) // 2] + b"?" + whole[len(whole) // 2 + 1 :], b"nothing")):
        (tmp_path / f"{k}.warc").write_bytes(data)
        with pytest.raises(Exception, match="record"):
            warc.read(spark, str(tmp_path / f"{k}.warc"))


# --- mixing -------------------------------------------------------------------------------------------------------


def test_targets():
    assert mixing.targets([100, 100, 100]) == [200, 166 + 2 / 3, 83 + 1 / 3]
    t = mixing.targets([10, 1000, 10, 500, 3])
    assert abs(sum(t) - 1.5 * 1523) < 1e-6 and all(a <= 2 * b + 1e-9 for a, b in zip(t, [10, 1000, 10, 500, 3]))
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]


def test_permutation():
    for n in (1, 2, 7, 100):
        x = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 9, np.uint64))
        assert sorted(x.tolist()) == list(range(n))


def test_mix(docs, rows, empty):
    m = mixing.mix(docs, block_words=8, shard_slots=50)
    got = mixing.taken(m).collect()
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").encode().split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goals = dict(zip(names, mixing.targets([sizes[s] for s in names])))
    assert len(got) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in got)
    own = {r["rid"]: r["source"] for r in m.docs.collect()}
    for s in names:
        mine = [r for r in got if own[r["rid"]] == s]
        assert all(r["source_size"] == sizes[s] and abs(r["target"] - goals[s]) < 1e-9 for r in mine)
        assert abs(sum(r["taken"] for r in mine) - goals[s]) <= 16
    assert sorted((r["doc_id"] or -1, r["taken"]) for r in mixing.taken(mixing.mix(docs, block_words=8, shard_slots=50)).collect()) == sorted((r["doc_id"] or -1, r["taken"]) for r in got)
    assert mixing.taken(mixing.mix(empty)).count() == 0 and mixing.resample(empty).count() == 0


def plain_permuted(k, n, key):
    """A Feistel network of four rounds over numbers of 2 * half bits, walked until it falls below n."""
    half = max(1, math.ceil(math.log2(max(n, 2) + 1) / 2))
    mask, full = (1 << half) - 1, (1 << 64) - 1
    while True:
        left, right = k >> half, k & mask
        for r in range(4):
            f = (right + key + 0x9E3779B97F4A7C15 * (r + 1)) & full
            f = (f ^ f >> 30) * 0xBF58476D1CE4E5B9 & full
            f = (f ^ f >> 27) * 0x94D049BB133111EB & full
            left, right = right, left ^ ((f ^ f >> 31) & mask)
        k = left << half | right
        if k < n:
            return k


def test_slots_and_blocks(docs):
    """Every draw, move, permutation and block join, one slot at a time."""
    words, per_shard, seed = 8, 50, 17
    m = mixing.mix(docs, block_words=words, shard_slots=per_shard, seed=seed)
    sizes, goals = [w for _, w, _ in m.sources], [g for _, _, g in m.sources]
    blocks = [-(-w // words) for w in sizes]
    quota = [min(round(g * b / w), 2 * b) if w else 0 for g, w, b in zip(goals, sizes, blocks)]
    n, met, want = sum(quota), [0] * len(sizes), Counter()
    drawn = []
    for shard in range(-(-n // per_shard)):
        counts = np.random.default_rng([seed, shard]).multinomial(min(per_shard, n - shard * per_shard), np.array(quota) / n)
        for src, c in enumerate(counts.tolist()):
            drawn += [(shard, src, met[src] + i) for i in range(c)]
            met[src] += c
    short = [(src, k) for src in range(len(sizes)) for k in range(met[src], quota[src])]
    over = sorted(((src, k, shard) for shard, src, k in drawn if k >= quota[src]), key=lambda x: x[:2])
    place = {(src, k): to for (src, k, _), to in zip(over, short, strict=True)}
    for shard, src, k in drawn:
        src, k = place.get((src, k), (src, k))
        key = (k // blocks[src] * 0xD1342543DE82EF95 + src * 0x2545F4914F6CDD1D + seed) & (1 << 64) - 1
        want[shard, src, k // blocks[src], plain_permuted(k % blocks[src], blocks[src], key)] += 1
    slots = m.slots.collect()
    assert Counter((r["shard"], r["src"], r["pass"], r["block"]) for r in slots) == want and max(want.values()) == 1
    assert all(sorted(r["slot"] for r in slots if r["shard"] == s) == list(range(min(per_shard, n - s * per_shard))) for s in {r["shard"] for r in slots})

    held = {}  # what each block holds: whole documents tile the source's stream
    for r in m.pieces.collect():
        held.setdefault((r["src"], r["block"]), []).append((r["rid"], r["from_word"], r["words"]))
    for src, w in enumerate(sizes):
        assert all(sum(x[2] for x in held[src, b]) == min(words, w - b * words) for b in range(blocks[src]))
    own = {r["rid"]: r for r in m.docs.collect()}
    for rid, r in own.items():
        mine = sorted((a, n) for (src, _), xs in held.items() for q, a, n in xs if q == rid)
        assert [a for a, _ in mine] == list(itertools.accumulate([0] + [n for _, n in mine]))[:-1] and sum(n for _, n in mine) == r["size"]
        assert all(src == r["src"] for (src, _), xs in held.items() for q, _, _ in xs if q == rid)
    taken = Counter()
    for r in slots:
        for rid, _, n_words in held[r["src"], r["block"]]:
            taken[rid] += n_words
    assert {r["rid"]: r["taken"] for r in mixing.taken(m).collect()} == {rid: taken[rid] for rid in own}


def test_spans_of_words():
    text = "  one two\n three\tfour  five "
    assert [text[a:b] for a, b in mixing.spans(text, [(3, 1), (0, 1), (1, 1)])] == ["one two", "four"]
    assert [text[a:b] for a, b in mixing.spans(text, [(0, 5)])] == ["one two\n three\tfour  five"]


def test_resampled_words_are_those_of_the_slots(spark, data, docs, rows):
    """Each source's emitted words meet its target, documents of many blocks included, and each row is part of its document."""
    long = spark.range(1800).selectExpr("id AS doc_id", "concat('s', id % 6) AS source", "repeat(concat('word', id, ' '), 320) AS text")
    for source, words in ((long, 16), (docs, 8), (spark.read.parquet(f"{data}/../sf0.01/documents.parquet"), 64)):
        out = mixing.resample(source, block_words=words)
        got, sizes, texts = Counter(), Counter(), {}
        for r in source.collect():
            sizes[r["source"]] += len((r["text"] or "").encode().split())
            texts.setdefault((r["doc_id"], r["source"]), []).append(r["text"] or "")
        for r in out.collect():
            got[r["source"]] += len(r["text"].encode().split())
            assert r["text"] and any(r["text"] in t for t in texts[r["doc_id"], r["source"]])
        names = sorted(sizes, key=lambda s: (s is None, s or ""))
        for s, goal in zip(names, mixing.targets([sizes[s] for s in names])):
            assert abs(got[s] - goal) <= max(2 * words, 0.01 * goal)
        assert out.columns == source.columns
    m = mixing.mix(docs, block_words=8)
    assert sum(r["taken"] for r in mixing.taken(m).collect()) == sum(len(r["text"].encode().split()) for r in mixing.resample(docs, block_words=8).collect())


# --- languages ----------------------------------------------------------------------------------------------------

def test_every_language_is_tried():
    """The second language is far from the first: three look-alikes of the first come before it when each is alone."""
    rng = np.random.default_rng(1)
    base = rng.dirichlet(np.full(400, 0.3))
    alike = [0.9 * base + 0.1 * rng.dirichlet(np.full(400, 0.3)) for _ in range(5)]
    far = np.concatenate((np.full(400, 1e-6), rng.dirichlet(np.full(400, 0.3))))
    model = np.stack([np.concatenate((x, np.full(400, 1e-6))) for x in [base, *alike]] + [far]) + 1e-9
    model /= model.sum(1, keepdims=True)
    counts = rng.multinomial(3000, 0.7 * model[0] + 0.3 * model[6])
    at = np.flatnonzero(counts)
    found = langid.infer(model, at, counts[at])
    assert abs(found[0] - 0.7) < 0.1 and abs(found[6] - 0.3) < 0.1


def test_mixture_of_two(spark):
    en, de = "the cat sat on the mat and then it went home ", "der hund und die katze sind nicht im haus gewesen "
    docs = spark.createDataFrame([(i, (en if i % 2 else de) * 5, "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string")
    langs, table = langid.fit(docs)
    assert langs == ["de", "en"]
    test = spark.createDataFrame([(1, en * 3), (2, de * 3), (3, en * 30 + de * 10), (4, None), (5, "12 34 !"), (6, ""), (7, "é" * 40_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.predict(test, langs, table, ["doc_id"]).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["en", "de", "en"] and [got[i]["lang_pred"] for i in (4, 5, 6)] == ["und"] * 3
    share = {x["lang"]: x["share"] for x in got[3]["mixture"]}
    assert 0.6 < share["en"] < 0.85 and abs(sum(share.values()) - 1) < 1e-6 and len(got[1]["mixture"]) == 1 and 0 <= got[7]["score"] <= 1
    none, blank = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict(test, none, blank, ["doc_id"]).collect()} == {"und"}


def plain_mixture(columns, counts, rounds=400):
    """Proportions and log-likelihood by expectation-maximisation, one gram and one language at a time."""
    share = [1 / len(columns)] * len(columns)
    for _ in range(rounds):
        new = [0.0] * len(columns)
        for g, n in enumerate(counts):
            parts = [share[k] * columns[k][g] for k in range(len(columns))]
            for k, part in enumerate(parts):
                new[k] += n * part / sum(parts)
        share = [x / sum(counts) for x in new]
    return share, sum(n * math.log(sum(s * c[g] for s, c in zip(share, columns))) for g, n in enumerate(counts))


def test_mixture_is_that_of_all_sets():
    """The chosen set is the best of all sets by penalised likelihood, its proportions those of a plain EM."""
    rng = np.random.default_rng(5)
    for trial in range(12):
        like = rng.dirichlet(np.full(25, 0.3), 5) + 1e-4
        like /= like.sum(1, keepdims=True)
        true = np.zeros(5)
        true[rng.choice(5, 1 + trial % 3, False)] = rng.uniform(0.4, 1, 1 + trial % 3)
        counts = rng.multinomial(600, true / true.sum() @ like)
        bins = np.flatnonzero(counts)
        got = langid.infer(like, bins, counts[bins])
        best = None
        for n in range(1, 6):
            for own in itertools.combinations(range(5), n):
                share, value = plain_mixture([like[k, bins].tolist() for k in own], counts[bins].tolist(), 150)
                value -= 3.0 * math.log(600) * (n - 1)
                if best is None or value > best[0]:
                    best = value, dict(zip(own, share))
        assert set(got) == set(best[1]) and all(abs(got[k] - best[1][k]) < 0.02 for k in got)


def test_letters_of_all_planes(spark):
    docs = spark.createDataFrame([(1, "\U0001f600\U0001f680 \U0001f1e9\U0001f1ea"), (2, "\U00010400\U00010428 \U00020000"), (3, "١٢٣ ½ ․"), (4, "\U0001f600 hello")], "doc_id long, text string")
    langs, table = langid.fit(spark.createDataFrame([(1, "hello world", "en"), (2, "hallo welt", "de")], "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, langs, table, ["doc_id"]).collect()}
    assert got[1] == got[3] == "und" and got[2] in langs and got[4] == "en"
    assert langid.predict(docs.limit(0), langs, table, ["doc_id"]).count() == 0
    clash = langid.predict(docs.withColumn("score", F.lit("x")), langs, table, ["doc_id", "score"])
    assert clash.columns == ["doc_id", "lang_pred", "score", "mixture"] and {r["doc_id"]: r["lang_pred"] for r in clash.collect()} == got


def test_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    held = langid.remainder(F.col("doc_id")) == 2
    out = langid.predict(docs.where(held), *langid.fit(docs.where(~held)), keep=["doc_id", "lang"]).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) >= 0.9
    assert zlib.crc32(b"12") % 4 == spark.range(1).select(langid.remainder(F.lit(12))).first()[0]


# --- repeats ------------------------------------------------------------------------------------------------------


def test_transform_and_prefixes():
    rng = random.Random(3)
    for n in range(60):
        strings = [bytes(rng.choice(b"ab" if n % 2 else b"abcdefgh") for _ in range(rng.randrange(40))) for _ in range(rng.randrange(1, 12))]
        files = bwt.Columns()
        _, prefix = bwt.build(strings, files)
        files.close()
        order = sorted(([b + 1 for b in s[i:]] + [0], k) for k, s in enumerate(strings) for i in range(len(s) + 1))
        common = lambda x, y: next(i for i in range(len(x)) if x[i] == 0 or y[i] == 0 or x[i] != y[i])
        assert prefix.tolist() == [0] + [common(a[0], b[0]) for a, b in zip(order, order[1:])]
        length = rng.randrange(1, 7)
        counts = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        want = [[counts[s[i : i + length]] > 1 for i in range(len(s) - length + 1)] for s in strings]
        assert [x.tolist() for x in bwt.repeated_starts(strings, length)] == want


def test_rows_of_far_symbols():
    """Nearest rows beyond all windows, of many symbols at once, as by a plain search; all of them are found by one pass over the rows."""
    rng = np.random.default_rng(5)
    edge, n = bwt.NEAR[-1], 40_000
    column, prefix = np.zeros(n + 2 * edge, np.uint8), np.zeros(n + 2 * edge, np.uint8)
    own, low = column[edge:-edge], prefix[edge:-edge]
    own[:], low[:] = rng.integers(1, 4, n), rng.integers(1, 200, n)
    own[rng.choice(n, 60, False)] = np.arange(60) % 30 + 10
    at, c = rng.integers(0, n, 300), rng.integers(10, 41, 300).astype(np.uint8)
    for down in (False, True):
        want = []
        for t, x in zip(at.tolist(), c.tolist()):
            rows = [r for r in np.flatnonzero(own == x).tolist() if (r > t if down else r < t)]
            want.append(-1 if not rows else int(low[t + 1 : rows[0] + 1].min()) if down else int(low[rows[-1] + 1 : t + 1].min()))
        scans, plain = [], np.flatnonzero
        bwt.np.flatnonzero = lambda a: (scans.append(len(a) == n), plain(a))[1]
        try:
            got = bwt.least_between(column, prefix, at, c, np.array(want) >= 0, down)
        finally:
            bwt.np.flatnonzero = plain
        assert got.tolist() == want and sum(scans) == 1


@pytest.mark.parametrize("how", [{}, {"hot": 2, "collection": 20}])
def test_repeats(docs, rows, empty, how):
    length, counts = 200, Counter()
    for _, t, _, _ in rows:
        b = (t or "").encode()
        counts.update(b[i : i + length] for i in range(len(b) - length + 1))
    want = []
    for d, t, _, _ in rows:
        b = (t or "").encode()
        cover = np.zeros(len(b) + length + 1, bool)
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                cover[i : i + length] = True
        cover = cover[: len(b)]
        spans = int((np.diff(np.concatenate(([0], cover.astype(int)))) == 1).sum())
        want.append(repr((d, len(b), int(cover.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~cover].tobytes()).hexdigest())))
    got = [repr((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in suffix.remove(docs, **how).collect()]
    assert sorted(got) == sorted(want)
    assert suffix.remove(empty).count() == 0
