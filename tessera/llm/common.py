"""Shared helpers of the corpus operators: table access, shared storage, Arrow mapping, components."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space; bytes.split() cuts at exactly these six bytes.
ASCII_SPACE = " \t\n\v\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; where none is configured, a temporary one in local mode and an error on a cluster."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark, "_tessera_shared", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that the driver and the executors share")
        found = spark._tessera_shared = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
    return found


class Tables:
    """The tables written to the shared folder by what runs inside ``with Tables(spark) as own:``, in this thread.

    Tables outlive the block, as lazy results read them; ``own.drop()`` deletes them, for when the results are stored. What
    other threads and other blocks write is theirs. Blocks may be nested: the innermost owns.
    """

    _now: ContextVar[Tables | None] = ContextVar("tables", default=None)

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Tables:
        self._before = Tables._now.set(self)
        return self

    def __exit__(self, *_) -> None:
        Tables._now.reset(self._before)

    @staticmethod
    def wrote(path: str) -> None:
        if (own := Tables._now.get()) is not None:
            own.paths.append(path)

    def drop(self, keep: DataFrame | None = None) -> None:
        """Delete these tables, but for ``keep``, which stays theirs."""
        held = getattr(keep, "_tessera_path", None)
        for path in self.paths:
            if path != held:
                _delete(self.spark, path)
        self.paths = [path for path in self.paths if path == held]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing reads any more: what was made of them is stored."""
    for t in tables:
        _delete(t.sparkSession, t._tessera_path)


def release(result: DataFrame) -> None:
    """Delete the tables that a result of ``corpus_pipeline.run`` reads; for when it is stored."""
    for own in getattr(result, "_tessera_tables", ()):
        own.drop()


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name like ``name`` that none of the frames has, in any case of letters."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleaning, _lock = [0, "false"], threading.Lock()


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Within, shuffle files go as soon as they have served: for writing tables that what follows reads. Threads may overlap."""
    with _lock:
        if not _cleaning[0]:
            _cleaning[1] = spark.conf.get(CLEANUP)
        _cleaning[0] += 1
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            _cleaning[0] -= 1
            if not _cleaning[0]:
                spark.conf.set(CLEANUP, _cleaning[1])


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_released(spark):
        df.write.option("compression", codec).parquet(path)
    Tables.wrote(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


#: Rows and bytes of an Arrow batch at most (a row may be larger by itself).
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def bound_batches(spark: SparkSession) -> None:
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def map_arrow(df: DataFrame, schema: str, rows: Callable[[pa.RecordBatch], Iterator[dict] | dict]) -> DataFrame:
    """``rows`` turns a record batch into one dict of columns (or several, one at a time)."""
    bound_batches(df.sparkSession)
    out = df.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for batch in batches:
            made = rows(batch)
            for cols in [made] if isinstance(made, dict) else made:
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long): root is the component's smallest node.

    Alternating large-star and small-star rounds; every round is a pair of shuffles over the edge list and
    is written to the shared folder. Nothing but two counters reaches the driver. The result can be discarded.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, seen = materialise(e, "cc-0"), None
    for k in range(max_rounds):
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = e.union(e.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        before, e = e, materialise(small, f"cc-{k + 1}")
        discard(before)
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
    roots._tessera_path = e._tessera_path
    return roots
