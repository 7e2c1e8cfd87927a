"""Recovery, stateful table functions and joins by time against plain Python, on small and on skewed streams."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import sqlfuncs
from tessera.operators import recovery, stream, timejoin
from tessera.plans import fixtures as fx
from tessera.plans import timing
from tessera.streaming import recovery as live

WAIT = 1500


def replay(rows, wait=WAIT, first=1):
    """Events of one stream from (sequence, arrival), one arrival at a time."""
    rows, out = sorted(rows, key=lambda r: (r[1], r[0])), []
    held, gaps, lost, after, high = set(), {}, set(), first, first - 1

    def release(at):
        nonlocal after
        while after in held or after in lost:
            if after in held:
                out.append(("released", after, at))
            after += 1

    def give_up(before):
        for deadline in sorted({d for d in gaps.values() if d < before}):
            gone = [s for s, d in gaps.items() if d == deadline]
            for s in gone:
                del gaps[s]
                lost.add(s)
            out.extend(("lost", s, deadline) for s in gone)
            release(deadline)

    seen = set()
    for s, t in rows:
        give_up(t)
        if s in seen:
            out.append(("repeated", s, t))
            continue
        seen.add(s)
        if s > high:
            for m in range(high + 1, s):
                gaps[m] = t + wait
                out.append(("nack", m, t))
            high = s
        elif s in gaps:
            del gaps[s]
        else:
            out.append(("late", s, t))
            continue
        held.add(s)
        release(t)
    give_up(1 << 60)
    return sorted(out)


def lossy(rng, n, streams):
    rows = []
    for k in streams:
        for s in range(1, n + 1):
            if rng.random() > 0.12:
                rows += [(k, s, s * 1000 + rng.randrange(6000)) for _ in range(1 + (rng.random() < 0.1))]
    return rows


def events(rows):
    """Ranges of events as single sequences, under the names of ``replay``."""
    names = {"request_keyframe": "lost"}
    return sorted((r["stream_id"], names.get(r["event"], r["event"]), s, r["at_ms"]) for r in rows for s in range(r["sequence"], r["upto"] + 1))


@pytest.mark.parametrize("span", [4096, 7])
def test_recover(spark, span):
    rows = lossy(random.Random(4), 60, range(5)) + [(9, 1, 5), (None, 3, 4), (9, None, 4), (9, 2, None)]
    df = spark.createDataFrame(rows, "stream_id long, sequence long, arrival_ms long")
    got = recovery.recover(df, WAIT, span=span).collect()
    for k in (*range(5), 9):
        own = [(s, t) for i, s, t in rows if i == k and s is not None and t is not None]
        want, mine = replay(own), [r for r in got if r["stream_id"] == k]
        assert sorted((r["sequence"], r["release_ms"]) for r in mine if r["status"] == "released") == sorted((s, t) for e, s, t in want if e == "released")
        assert sorted(r["sequence"] for r in mine if r["status"] == "late") == sorted(s for e, s, _ in want if e == "late")
        assert {r["sequence"]: r["missed_ms"] for r in mine if r["missed_ms"] is not None} == {s: t for e, s, t in want if e == "nack" and s in {x for x, _ in own}}
        assert sum(r["lost_before"] for r in mine) == len({s for e, s, _ in want if e == "lost"} - {x for x, _ in own})
    assert len(got) == len({(k, s) for k, s, t in rows if None not in (k, s, t)})
    assert recovery.recovery_stats(recovery.recover(df.limit(0), WAIT)).count() == 0


def test_recovery_with_state(spark, tmp_path):
    """Batches in the order of arrival, a restart between them; timers end what never comes."""
    rows = sorted(lossy(random.Random(8), 40, range(4)), key=lambda r: r[2])
    parts = [rows[a : a + 60] for a in range(0, len(rows), 60)]
    last = [(99, 1, 10**7)], [(99, 2, 10**7 + 1)]  # another stream moves the watermark on
    for k, part in enumerate([*parts, *last]):
        spark.createDataFrame(part, "stream_id long, sequence long, arrival_ms long").coalesce(1).write.parquet(str(tmp_path / f"in/{k:03d}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = str(tmp_path / "out")

    def run(upto):
        src = spark.readStream.schema("stream_id long, sequence long, arrival_ms long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / upto))
        q = live.recover(src, WAIT).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None

    try:
        run("in/00[0-1]")
        run("in/*")  # from the checkpoint
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = events(spark.read.parquet(out).where("stream_id < 99").collect())
    want = sorted((k, *e) for k in range(4) for e in replay([(s, t) for i, s, t in rows if i == k]))
    assert got == want
    batch = recovery.recover(spark.createDataFrame(rows, "stream_id long, sequence long, arrival_ms long"), WAIT).where("status = 'released'")
    assert sorted((r["stream_id"], r["sequence"], r["release_ms"]) for r in batch.collect()) == sorted((k, s, t) for k, e, s, t in got if e == "released")


def test_table_functions(spark, data):
    sqlfuncs.register(spark)
    frames = timing.boxed_frames(spark, data).where("stream_id < 10").withColumn("extra", F.lit("x"))
    got = spark.sql("SELECT * FROM hybrid_receiver(TABLE({f}))", f=frames)
    assert got.columns[: len(frames.columns)] == frames.columns and "extra" in got.columns
    want = stream.receive(frames)
    key = lambda r, v, b: (r["stream_id"], r["sequence"], r["render_background"], r[v], r["mask_from"], r[b], r["person_video_size"], r["frame_width"], r["frame_height"], r["frames_received"])
    assert sorted(key(r, "rx_scene_version", "rx_person_bbox") for r in got.collect()) == sorted(key(r, "scene_version", "person_bbox") for r in want.collect())
    plain = spark.sql("SELECT * FROM hybrid_receiver(TABLE({f}))", f=frames.drop("person_bbox"))
    assert plain.where("rx_person_bbox is not null").count() == 0
    last = spark.sql("SELECT stream_id, max_by(struct(hybrid_bytes, traditional_bytes, saved_percent, saved_ratio), sequence) AS l FROM hybrid_transmitter(TABLE({f})) GROUP BY 1", f=frames)
    want = {r["stream_id"]: (r["hybrid_bytes"], r["traditional_bytes"], pytest.approx(r["saved_percent"]), pytest.approx(r["saved_ratio"])) for r in stream.bandwidth(stream.transmit(frames)).collect()}
    assert {r["stream_id"]: tuple(r["l"]) for r in last.collect()} == want
    for bad, why in ((frames.drop("scene_bytes"), "lacks scene_bytes"), (frames.withColumn("mask_from", F.lit(1)), "columns named mask_from")):
        with pytest.raises(Exception, match=why):
            spark.sql("SELECT * FROM hybrid_receiver(TABLE({f}))", f=bad)


def skewed(rng, n):
    """(key, time, value): nine tenths of one key; nulls and ties."""
    return [(None if rng.random() < 0.02 else 7 if rng.random() < 0.9 else rng.randrange(5), None if rng.random() < 0.02 else rng.randrange(2000), v) for v in range(n)]


@pytest.mark.parametrize("width", [50, 700, 10**6])
def test_asof(spark, width):
    rng = random.Random(width)
    a, b = skewed(rng, 300), skewed(rng, 120)
    left, right = spark.createDataFrame(a, "k long, t long, v long"), spark.createDataFrame(b, "k long, t long, w long").withColumn("run", F.lit(1))
    for within in (None, 40):
        got = [(r["k"], r["t"], r["v"], r["m"] and (r["m"]["t"], r["m"]["w"])) for r in timejoin.asof(left, right, ["k"], "t", width=width, within=within, name="m").collect()]
        want = []
        for k, t, v in a:
            fits = [(rt, w) for rk, rt, w in b if k is not None and t is not None and rk == k and rt is not None and rt <= t]
            best = max(fits, default=None)
            want.append((k, t, v, best if best and (within is None or t - best[0] <= within) else None))
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert timejoin.asof(left.limit(0), right, ["k"], "t").count() == 0 and timejoin.asof(left, right.limit(0), ["k"], "t").where("match is not null").count() == 0


def test_stabbed(spark):
    rng = random.Random(3)
    points = skewed(rng, 200)
    spans = [(rng.choice([7, 7, 1, None]), s, s + rng.choice([0, 1, 3, 9, 100, 1600, -5, 4, 16, 64]), i) for i, s in enumerate(rng.randrange(2000) for _ in range(80))] + [(7, None, 5, 900), (7, 5, None, 901)]
    p, s = spark.createDataFrame(points, "k long, t long, v long"), spark.createDataFrame(spans, "k long, a long, z long, i long")
    made = timejoin.stabbed(p, s, ["k"], "t", "a", "z", base=4)
    want = sorted((v, i) for k, t, v in points for sk, a, z, i in spans if None not in (k, t, a, z) and k == sk and a <= t < z)
    assert sorted((r["v"], r["i"]) for r in made.collect()) == want and len(want) > 300
    assert timejoin.stabbed(p, s.limit(0), ["k"], "t", "a", "z").count() == 0
    long = spark.createDataFrame([(7, 0, 10**12, 1)], "k long, a long, z long, i long")
    assert timejoin.stabbed(p, long, ["k"], "t", "a", "z", base=4).count() == sum(k == 7 and t is not None for k, t, _ in points)
    with pytest.raises(ValueError, match="both sides"):
        timejoin.stabbed(p, s.withColumn("v", F.lit(1)), ["k"], "t", "a", "z")


def test_sliding_and_sessions(spark):
    rng = random.Random(6)
    rows = [r for r in skewed(rng, 400) if r[1] is not None and r[0] is not None]
    df = spark.createDataFrame(rows, "k long, t long, v long").withColumn("run", F.lit(0))
    got = {r["v"]: (r["window_bytes"], r["window_rows"]) for r in timejoin.sliding_rate(df, "k", "t", "v", 30, width=64).collect()}
    assert got == {v: (sum(x for q, u, x in rows if q == k and t - 30 < u <= t), sum(q == k and t - 30 < u <= t for q, u, _ in rows)) for k, t, v in rows}
    for span in (20, 300, 10**6):
        want = []
        for k in {r[0] for r in rows}:
            own, at = sorted((t, v) for q, t, v in rows if q == k), []
            for t, v in own:
                if at and t - at[-1][1] < 9:
                    at[-1] = (at[-1][0], t, at[-1][2] + 1, at[-1][3] + v)
                else:
                    at.append((t, t, 1, v))
            want += [(k, *x) for x in at]
        assert sorted(map(tuple, timejoin.sessions(df, "k", "t", "v", 9, span=span).collect())) == sorted(want)


def test_carried_of_a_hot_stream(spark):
    """One stream holds nine tenths of the frames: runs cut it, and the result is the same."""
    rng = random.Random(1)
    rows = [(1 if k < 900 else 2 + k % 3, k, rng.random() < 0.05, rng.choice([None, 5])) for k in range(1000)]
    df = spark.createDataFrame(rows, "stream_id long, sequence long, is_keyframe boolean, mask_bytes int")
    marks = {"m": F.when(F.col("is_keyframe"), F.col("sequence"))}
    want = [tuple(r) for r in stream.carried(df, marks, span=1 << 40).orderBy("stream_id", "sequence").collect()]
    assert [tuple(r) for r in stream.carried(df, marks, span=16).orderBy("stream_id", "sequence").collect()] == want
    assert fx.PACKETS
