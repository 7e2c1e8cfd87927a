"""Table scans and the packet archive format (one binary packet a row)."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def scan(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table: columns and filters are pushed into the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in spark.checkpoint.dir; in local mode without that a temporary one, which goes with the process."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that the driver and the executors share")
        made = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        top = f"file://{made}"
    return f"{top}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written with all nested fields to a new shared folder and read back."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


PACKET_FILE = T.StructType([T.StructField("stream_id", T.LongType()), T.StructField("sequence", T.LongType()), T.StructField("raw", T.BinaryType())])


def write_packets(packets: DataFrame, path: str) -> None:
    """Sink of framed packets, clustered by stream so that a stream's packets are read together."""
    packets.select("stream_id", "sequence", "raw").repartition("stream_id").sortWithinPartitions("stream_id", "sequence").write.mode("errorifexists").parquet(path)


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PACKET_FILE).parquet(path)


def read_packet_stream(spark: SparkSession, path: str) -> DataFrame:
    """The same files as a streaming source."""
    return spark.readStream.schema(PACKET_FILE).parquet(path)
