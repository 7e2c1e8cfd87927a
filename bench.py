"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

import numpy as np
from pyspark.sql import SparkSession

from tessera.functions import kernels
from tessera.operators import blocks
from tessera.plans.queries import QUERIES

HEADLINE = ["a1_stream_stats", "s9_s10_packet_round_trip", "m1_m2_diamond", "m4_f9_full_search", "k1_dct", "k9_sparse_pipeline", "a5_edge_strength", "m9_detect_with_motion", "m5_kmeans", "w3_receive", "w6_rle_encode", "a13_bandwidth", "v1_v2_video_round_trip", "b2_w8_j5_snapshot"]


def motion_rate(spark: SparkSession, cpus: int, width: int = 1920, height: int = 1080, frames: int = 256) -> dict[str, float]:
    """Frames a second of the diamond search (block 16, range 16) over pairs of frames held as rows: a ramp with a patch of 50 x 50.

    Also of what takes the rows to Python and back alone, and the milliseconds a frame that the search itself takes.
    """

    def made(batches):
        import pyarrow as pa

        prev = np.tile(np.arange(width) % 256, (height, 1)).astype(np.uint8)
        cur = prev.copy()
        cur[50:100, 50:100] = 200
        for b in batches:
            for k in b["id"].to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([width], pa.int32()), pa.array([height], pa.int32()), pa.array([cur.tobytes()]), pa.array([prev.tobytes()])], names=["cur_id", "width", "height", "cur", "prev"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    pairs = spark.range(0, frames, 1, cpus).mapInArrow(made, "cur_id long, width int, height int, cur binary, prev binary").cache()
    pairs.count()

    def passed(batches):
        for b in batches:
            yield b.select(["cur_id"])

    def best(work) -> float:
        took = []
        for _ in range(3):
            began = time.perf_counter()
            work()
            took.append(time.perf_counter() - began)
        return min(took)

    whole = best(lambda: blocks.estimate_motion(pairs).write.format("noop").mode("overwrite").save())
    moved = best(lambda: pairs.mapInArrow(passed, "cur_id long").write.format("noop").mode("overwrite").save())
    one = pairs.select("cur", "prev").first()
    cur, prev = (np.frombuffer(x, np.uint8).reshape(height, width) for x in one)
    kernel = best(lambda: kernels.diamond(cur, prev))
    pairs.unpersist()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    return {"motion_1920x1080_frames_per_second": round(frames / whole, 1), "motion_transfer_frames_per_second": round(frames / moved, 1), "motion_kernel_ms_per_frame": round(1000 * kernel, 2)}


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["a1_stream_stats"](spark, folder).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds = time.perf_counter() - began
            best = seconds if best is None else min(best, seconds)
        took[name] = round(best, 3)
    rate = motion_rate(spark, int(cpus))
    spark.stop()
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rsplit("sf", 1)[-1], "rates": rate}))


if __name__ == "__main__":
    main()
