"""Other sources of motion as delta packets: sync events and snapshots of bodies; sealed packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar


def vectors_of_events(events: DataFrame, grid: int) -> DataFrame:
    """Motion events only: block of the entity on a grid, dx, dy, sad = |dx| + |dy|; the third component is dropped."""
    cell = scalar.grid_cell(F.col("entity"), grid)
    return events.where("kind = 'Motion'").select("*", cell["block_x"].alias("block_x"), cell["block_y"].alias("block_y"), (F.abs("dx") + F.abs("dy")).alias("sad"))


def packets_of_vectors(vectors: DataFrame, key: str, ref_sequence: Column, order: str, span: int | None = None) -> DataFrame:
    """Delta packets of a key's vectors in order: ref_sequence, sequence (one more) and vectors.

    One packet a key, or with ``span`` one for each range of so many values of ``order`` (a long that is each vector's own),
    so that no packet holds more and a key of any size is many rows; column part tells the ranges.
    """
    keys = [key] if span is None else [key, F.expr(f"{order} div {span}").alias("part")]
    out = vectors.groupBy(*keys).agg(F.max(ref_sequence).alias("ref_sequence"), F.transform(F.array_sort(F.collect_list(F.struct(order, "block_x", "block_y", "dx", "dy", "sad"))), lambda v: F.struct(v["block_x"].alias("block_x"), v["block_y"].alias("block_y"), v["dx"].alias("dx"), v["dy"].alias("dy"), v["sad"].alias("sad"))).alias("vectors"))
    return out.withColumn("sequence", F.col("ref_sequence") + 1)


def motions_of_packets(packets: DataFrame, grid: int, key: str) -> DataFrame:
    """entity, dx, dy, dz = 0 of every vector."""
    return packets.select(key, F.explode("vectors").alias("v")).select(key, scalar.from_grid(F.col("v.block_x"), F.col("v.block_y"), grid).alias("entity"), "v.dx", "v.dy", F.lit(0).alias("dz"))


def clamp16(c: Column) -> Column:
    """Truncated toward zero, within 16 bits."""
    return F.greatest(F.lit(-32768), F.least(F.lit(32767), F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))))


def snapshot_deltas(bodies: DataFrame, grid: int) -> DataFrame:
    """Vectors between a body's consecutive snapshots, in hundredths; both under 1e-6 is no motion."""
    w = Window.partitionBy("body_idx").orderBy("t")
    d = bodies.select("*", (F.col("x") - F.lag("x").over(w)).alias("fx"), (F.col("y") - F.lag("y").over(w)).alias("fy")).where("fx is not null and not (abs(fx) < 1e-6 and abs(fy) < 1e-6)")
    cell = scalar.grid_cell(F.col("body_idx"), grid)
    d = d.select("body_idx", "t", cell["block_x"].alias("block_x"), cell["block_y"].alias("block_y"), clamp16(F.round(F.col("fx") * 100, 6)).alias("dx"), clamp16(F.round(F.col("fy") * 100, 6)).alias("dy"))
    return d.withColumn("sad", F.abs("dx") + F.abs("dy"))


def body_deltas(vectors: DataFrame, grid: int) -> DataFrame:
    return vectors.select("t", scalar.from_grid(F.col("block_x"), F.col("block_y"), grid).alias("body_idx"), (F.col("dx") / 100).alias("fx"), (F.col("dy") / 100).alias("fy"))


def content_hash(raw: Column) -> Column:
    return F.sha2(raw, 256)


def derive_key(channel: Column, secret: Column) -> Column:
    """32 bytes from a context label, the channel and the secret."""
    return F.unhex(F.sha2(F.concat(F.lit("tessera stream key v1\x00").cast("binary"), channel.cast("string").cast("binary"), F.lit("\x00").cast("binary"), secret), 256))


def seal(df: DataFrame, key: Column) -> DataFrame:
    """raw encrypted (AES-GCM, random nonce), its sequence in clear and authenticated."""
    return df.withColumn("sealed", F.aes_encrypt("raw", key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), F.col("sequence").cast("string").cast("binary"))).drop("raw")


def open_sealed(df: DataFrame, key: Column) -> DataFrame:
    """raw, or null if the key, the sequence or the bytes are wrong."""
    return df.withColumn("raw", F.try_aes_decrypt("sealed", key, F.lit("GCM"), F.lit("DEFAULT"), F.col("sequence").cast("string").cast("binary")))


def distinct_packets(df: DataFrame) -> DataFrame:
    """One row for each content."""
    return df.withColumn("content", content_hash(F.col("raw"))).dropDuplicates(["content"])
