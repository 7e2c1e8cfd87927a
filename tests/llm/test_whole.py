"""Each query over the whole of the smallest tables against brute force from its description."""

import hashlib
import itertools
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import xxhash

from tessera.llm import media, mixing
from tessera.llm.queries import queries

from .test_texts import halves, plain_components, plain_fingerprint, plain_line_dedup, plain_representatives, plain_verdicts


@pytest.fixture(scope="module")
def source(spark, data):
    """doc_id -> row of documents."""
    found = {r["doc_id"]: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert len(found) == 200
    return found


def result(spark, data, name):
    out = queries()[name](spark, data)
    return out, [r.asDict() for r in out.collect()]


def raw(row):
    return (row["text"] or "").encode()


def test_op1(spark, data, source):
    out, got = result(spark, data, "op1_media")
    assert out.columns[:8] == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] and len(got) == 200
    for r in got:
        own = raw(source[r["doc_id"]])
        full = own + b" " * (-len(own) % 192 if own else 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(own), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        frames, spans = media.read_tensors(r["tensors"])
        assert r["media_bytes"] == len(full) + 44 and f"frames={len(frames)};" in r["feature"] and len(spans) == -(-len(frames) // media.SHAPE[0])
        assert all(a["start_ms"] < a["end_ms"] <= spans[-1][1] for a in r["segments"])


def test_op3(spark, data, source):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    _, got = result(spark, data, "op3_pieces")
    assert len(got) == 200 and any(r["n_chunks"] > 1 for r in got)
    for r in got:
        ids = sp.encode(source[r["doc_id"]]["text"] or "")
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) and r["round_trip"] == (sp.decode(ids) == (source[r["doc_id"]]["text"] or ""))


def test_op4(spark, data, source):
    out, got = result(spark, data, "op4_suffix")
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] and len(got) == 200
    hashes = {d: [xxhash.xxh3_64_intdigest(t[i : i + 200]) for i in range(len(t) - 199)] for d, t in ((d, raw(r)) for d, r in source.items())}
    counts = Counter(itertools.chain.from_iterable(hashes.values()))
    removed = 0
    for r in got:
        t = raw(source[r["doc_id"]])
        edge = np.zeros(len(t) + 1, np.int64)
        for i, h in enumerate(hashes[r["doc_id"]]):
            if counts[h] > 1:
                edge[i] += 1
                edge[i + 200] -= 1
        gone = np.cumsum(edge[:-1]) > 0 if t else np.zeros(0, bool)
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
        removed += r["n_removed"]
    assert removed


def test_op5(spark, data, source):
    out, got = result(spark, data, "op5_langid")
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"] and len(got) == 200
    langs = {r["lang"] for d, r in source.items() if zlib.crc32(str(d).encode()) % 4 != 2}
    right = []
    for r in got:
        text = source[r["doc_id"]]["text"]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or "")) and r["lang_pred"] in langs | {"und"}
        if r["held_out"]:
            right.append(r["lang_pred"] == source[r["doc_id"]]["lang"])
    assert np.mean(right) >= 0.9


def test_op6(spark, data, source):
    out, got = result(spark, data, "op6_simhash")
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    prints = [(d, plain_fingerprint(r["text"])) for d, r in source.items()]
    want = {d: (f"{fp:016x}", c) for (d, fp), c in zip(prints, plain_components(prints))}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == want


def test_op7(spark, data, source):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out, got = result(spark, data, "op7_packing")
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    at, by = 0, {r["doc_id"]: r for r in got}
    for d in sorted(source):
        ids = t.encode(source[d]["text"] or "", add_special_tokens=False).ids + [2]
        assert (by[d]["start"], by[d]["n_tokens"], by[d]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op8(spark, data, source):
    _, got = result(spark, data, "op8_linededup")
    want = plain_line_dedup([(d, r["text"], None, None) for d, r in source.items()])
    assert len(got) == 200
    for r in got:
        kept = want[r["doc_id"], source[r["doc_id"]]["text"]].encode()
        assert (r["kept_bytes"], r["kept_sha256"]) == (len(kept), hashlib.sha256(kept).hexdigest())
    assert any(r["n_removed"] for r in got)


def test_op9(spark, data, source):
    _, got = result(spark, data, "op9_quality")
    marks = {}
    for r in spark.read.parquet(f"{data}/labels.parquet").collect():
        if r["quality"] is not None:
            marks[r["doc_id"]] = min(marks.get(r["doc_id"], 1), int(r["quality"] > 0))
    want, _ = plain_verdicts([(d, r["text"], r["lang"]) for d, r in source.items()], marks, halves(spark, marks))
    assert {r["doc_id"]: r["kept"] for r in got} == want


def test_op9_where_rules_act(spark, data):
    """A thousand documents: the largest stratum has the labels that cutoffs need."""
    data = data.replace("0.001", "0.01")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    marks = {}
    for r in spark.read.parquet(f"{data}/labels.parquet").collect():
        if r["quality"] is not None:
            marks[r["doc_id"]] = min(marks.get(r["doc_id"], 1), int(r["quality"] > 0))
    want, cut = plain_verdicts(rows, marks, halves(spark, marks))
    got = {r["doc_id"]: (r["kept"], r["base_failed"]) for r in queries()["op9_quality"](spark, data).collect()}
    assert {d: k for d, (k, _) in got.items()} == want and cut and any(not k and not b for k, b in got.values())


def test_op10(spark, data, source):
    out, got = result(spark, data, "op10_mixing")
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"] and len(got) == 200
    sizes = Counter()
    for r in source.values():
        sizes[r["source"]] += len(raw(r).split())
    names = sorted(sizes)
    goals = dict(zip(names, mixing.targets([sizes[s] for s in names])))
    taken = Counter()
    for r in got:
        own = source[r["doc_id"]]
        assert r["size"] == len(raw(own).split()) and r["source_size"] == sizes[own["source"]] and abs(r["target"] - goals[own["source"]]) < 1e-6 and r["taken"] <= 2 * r["size"]
        taken[own["source"]] += r["taken"]
    assert all(abs(taken[s] - goals[s]) <= 128 for s in names)
    assert sorted(map(str, result(spark, data, "op10_mixing")[1])) == sorted(map(str, got))


def test_two_pipelines_at_once(spark, data):
    """In two threads they give what they give in turn, and their tables are gone when they are released."""
    import os
    import threading

    from tessera.llm.common import release, shared_dir

    place = shared_dir(spark).removeprefix("file://")
    rows = lambda df: sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in df.collect())
    before, got = set(os.listdir(place)), {}
    first = corpus_pipeline.run(spark, data)
    want = rows(first)
    release(first)

    def one(k):
        made = corpus_pipeline.run(spark, data)
        got[k] = rows(made)
        release(made)

    threads = [threading.Thread(target=one, args=(k,)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert got == {0: want, 1: want} and set(os.listdir(place)) == before


def test_pipeline_by_brute_force(spark, data, source):
    """Stage after stage; the mix by its words, as its draws are tested by themselves; the last by the library."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    at, stages = spark.read.parquet(f"{data}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        at = corpus_pipeline.materialise(stage(spark, at, data), "brute")
        stages.append([r.asDict() for r in at.collect()])
    marks = {r["doc_id"]: int(r["quality"] > 0) for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    verdicts, _ = plain_verdicts([(d, r["text"], r["lang"]) for d, r in source.items()], marks, halves(spark, marks))
    kept = {d: source[d]["text"] for d in source if verdicts[d]}
    assert {r["doc_id"]: r["text"] for r in stages[0]} == kept
    cut = plain_line_dedup([(d, t, None, None) for d, t in kept.items()])
    cut = {d: t for (d, _), t in cut.items() if t.encode().split()}
    assert {r["doc_id"]: r["text"] for r in stages[1]} == cut
    first = dict(plain_representatives(list(cut.items())))
    assert {r["doc_id"]: r["text"] for r in stages[2]} == first and 0 < len(first) <= len(cut) <= len(kept) < 200
    sizes, got = Counter(), Counter()
    for d, t in first.items():
        sizes[source[d]["source"]] += len(t.encode().split())
    for r in stages[3]:
        assert r["text"] in first[r["doc_id"]] and r["n_chars"] == len(r["text"]) and r["lang"] == source[r["doc_id"]]["lang"]
        got[r["source"]] += len(r["text"].encode().split())
    for s, goal in zip(sorted(sizes), mixing.targets([sizes[s] for s in sorted(sizes)])):
        assert abs(got[s] - goal) <= 128
    want = Counter((r["doc_id"], tuple(sp.encode(r["text"]))) for r in stages[3])
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in stages[4]) == want
