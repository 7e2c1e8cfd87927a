"""Streams give what batches give, over several micro-batches."""

from pyspark.sql import functions as F

from tessera.operators import stream
from tessera.plans import fixtures as fx
from tessera.streaming import streams


def drained(spark, query_df, mode, name, tmp_path):
    q = query_df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_receiver_and_stats(spark, data, tmp_path):
    frames = fx.hybrid_frames(spark, data).where("stream_id < 12")
    folder = str(tmp_path / "in")
    for k in range(3):
        frames.where(f"sequence > {k * 4} and sequence <= {(k + 1) * 4 if k < 2 else 10**9}").coalesce(1).write.mode("append").parquet(folder)
    src = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = drained(spark, streams.receive(src), "append", "received", tmp_path)
    want = stream.receive(frames)
    key = lambda df: sorted(map(tuple, df.select("stream_id", "sequence", "render_background", "scene_version", "mask_from", "person_video_size", "frame_width", "frame_height", "frames_received").collect()), key=repr)
    assert key(got) == key(want)
    store = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = drained(spark, streams.receive_with_state(src), "append", "received_state", tmp_path)
        assert key(got) == key(want)
    finally:
        spark.conf.unset(store)

    packets = fx.packets(spark, data).select("stream_id", "packet_type", "size")
    packets.repartition(3).write.parquet(str(tmp_path / "packets"))
    live = spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "packets"))
    got = drained(spark, streams.stats(live), "complete", "stats", tmp_path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stream.packet_stats(packets).collect()))


def test_windowed_stats_drop_late(spark, tmp_path):
    # rows are judged by the watermark before the last batch's
    rows = [(1, 1, 10, "2024-01-01 00:00:00"), (1, 2, 20, "2024-01-01 01:00:00")], [(1, 2, 7, "2024-01-01 01:30:00")], [(1, 2, 99, "2024-01-01 00:00:30"), (1, 2, 5, "2024-01-01 02:00:00")], [(1, 2, 1, "2024-01-01 03:00:00")]
    schema = "stream_id long, packet_type long, size long, ts timestamp"
    for k, part in enumerate(rows):
        df = spark.createDataFrame(part, "stream_id long, packet_type long, size long, ts string").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.parquet(str(tmp_path / f"w/{k}"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "w/*"))
    got = drained(spark, streams.windowed_stats(src), "append", "windowed", tmp_path)
    assert 99 not in [r["total_bytes"] for r in got.collect()] and 10 in [r["total_bytes"] for r in got.collect()]


def parts(spark, tmp_path, name, batches, schema):
    for k, part in enumerate(batches):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}/{k}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"{name}/*"))


def at(minutes):
    from datetime import datetime, timedelta

    return datetime(2024, 1, 1) + timedelta(minutes=minutes)


def test_sessions_and_repetitions(spark, tmp_path):
    """Sessions of the stream are those of the batch form; packets that come twice count once."""
    from tessera.operators import timejoin

    rows = [(k % 3, k, 10 + k, at(37 * k * k % 5000)) for k in range(60)]
    rows.sort(key=lambda r: r[3])
    batches = [rows[a : a + 15] + rows[a : a + 4] for a in range(0, 60, 15)] + [[(9, 1, 1, at(20_000))], [(9, 2, 1, at(40_000))]]
    src = parts(spark, tmp_path, "s", batches, "stream_id long, sequence long, size long, ts timestamp")
    got = drained(spark, streams.session_stats(streams.once(src, delay="1 minute"), gap="100 minutes", delay=None), "append", "sessions", tmp_path)
    batch = timejoin.sessions(spark.createDataFrame(rows, "stream_id long, sequence long, size long, ts timestamp").withColumn("ms", F.unix_millis("ts")), "stream_id", "ms", "size", 100 * 60_000)
    assert sorted((r["stream_id"], r["packets"], r["bytes"]) for r in got.where("stream_id < 9").collect()) == sorted((r["stream_id"], r["packets"], r["bytes"]) for r in batch.collect())


def test_references_across_streams(spark, tmp_path):
    """Deltas find keyframes of earlier and later batches; dangling ones come out when the watermark has passed."""
    deltas = [[(1, 2, 1, at(2)), (1, 4, 3, at(4)), (1, 9, 8, at(9))], [(2, 2, 1, at(12))], [(9, 1, 0, at(5000))], [(9, 2, 0, at(9000))], [(9, 3, 0, at(9001))]]
    keys = [[(1, 1, at(1))], [(1, 3, at(5)), (2, 1, at(11))], [(9, 7, at(5000))], [(9, 8, at(9000))], [(9, 9, at(9001))]]
    d = parts(spark, tmp_path, "d", deltas, "stream_id long, sequence long, ref_sequence long, ts timestamp")
    k = parts(spark, tmp_path, "k", keys, "stream_id long, sequence long, ts timestamp")
    got = drained(spark, streams.resolve_references(d, k), "append", "references", tmp_path)
    assert {(r["stream_id"], r["sequence"]): r["key_sequence"] for r in got.where("stream_id < 9").collect()} == {(1, 2): 1, (1, 4): 3, (1, 9): None, (2, 2): 1}


def test_sketches_merge(spark):
    from tessera.operators import sketches

    rows = spark.range(20_000).selectExpr("id % 7 AS k", "id % 3 AS part", "id * 7919 % 20000 AS v", "id % 500 AS who").unionByName(spark.createDataFrame([(8, 0, None, None)], "k long, part long, v long, who long"))
    daily = sketches.sketched(rows, ["k", "part"], "v", "who")
    r = sketches.told(sketches.merged(daily.where("k < 8"), [])).first()
    assert r["n"] == 20_000 and abs(r["distinct_values"] - 500) <= 25
    assert all(abs(r[q] / 20_000 - rank) < 0.03 for q, rank in (("q50", 0.5), ("q90", 0.9), ("q99", 0.99)))
    nothing = sketches.told(sketches.merged(daily, ["k"])).where("k = 8").first()
    assert nothing["n"] == 0 and nothing["q50"] is None
