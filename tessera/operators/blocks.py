"""Frames as rows of bytes (frame_id, width, height, data, a byte a pixel in raster order): matching, strengths, regions.

A frame is one value, so block operators need no shuffle: NumPy works on a frame, or a frame and the one before, at a
time. Only whole blocks count; frames whose data isn't width * height bytes long have none.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels, scalar, values


def frame_rows(pixels: DataFrame) -> DataFrame:
    """frame_id, width, height, data from pixels (frame_id, x, y, v): one aggregation, bytes in raster order."""
    px = F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda p: F.lpad(F.hex(p["v"].cast("long")), 2, "0"))
    return pixels.groupBy("frame_id").agg((F.max("x") + 1).cast("int").alias("width"), (F.max("y") + 1).cast("int").alias("height"), F.unhex(F.array_join(px, "")).alias("data"))


def pairs(frames: DataFrame, how: str = "inner") -> DataFrame:
    """cur_id, prev_id, width, height and both frames' data, for consecutive frames of one size (left: frames without one too)."""
    prev = frames.select((F.col("frame_id") + 1).alias("cur_id"), F.col("frame_id").alias("prev_id"), F.col("width").alias("pw"), F.col("height").alias("ph"), F.col("data").alias("prev"))
    cur = frames.withColumnsRenamed({"frame_id": "cur_id", "data": "cur"})
    met = cur.join(prev, "cur_id", how)
    same = F.expr("width = pw and height = ph")
    met = met.where(same) if how == "inner" else met.withColumn("prev", F.when(same, F.col("prev")))
    return met.drop("pw", "ph")


def _each(df: DataFrame, names: list[str], schema: str, make: Callable[..., list[np.ndarray]], key: str = "frame_id") -> DataFrame:
    """Columns of ``schema`` after ``key``, from ``make`` of each row's images (``names``; None where null or of another size)."""

    def rows(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for batch in batches:
            keys, sides = batch[key].to_pylist(), zip(batch["height"].to_pylist(), batch["width"].to_pylist())
            for i, shape in enumerate(sides):
                held = [batch[n][i].as_buffer() for n in names]  # no copies: frames are large
                images = [np.frombuffer(x, np.uint8).reshape(shape) if x is not None and None not in shape and len(x) == shape[0] * shape[1] else None for x in held]
                if images[0] is not None:
                    made = make(*images)
                    yield pa.RecordBatch.from_arrays([pa.array([keys[i]] * len(made[0]), arrow[0].type), *(pa.array(c, f.type) for c, f in zip(made, list(arrow)[1:]))], schema=arrow)

    out = df.sparkSession.createDataFrame([], f"{key} long, {schema}").schema
    return df.select(key, "width", "height", *names).mapInArrow(rows, f"{key} long, {schema}")


def _blocks(image: np.ndarray, block: int) -> np.ndarray:
    """Whole blocks as [by, bx, y, x]."""
    ny, nx = image.shape[0] // block, image.shape[1] // block
    return image[: ny * block, : nx * block].reshape(ny, block, nx, block).swapaxes(1, 2)


def _raster(per_block: np.ndarray) -> list[np.ndarray]:
    """bx, by and value of every block, in raster order."""
    by, bx = (a.reshape(-1) for a in np.mgrid[: per_block.shape[0], : per_block.shape[1]])
    return [bx, by, per_block.reshape(-1).astype(np.int64)]


def contrast_of(image: np.ndarray, block: int) -> np.ndarray:
    b = _blocks(image, block)
    return b.max((2, 3)).astype(np.int64) - b.min((2, 3)) if b.size else np.zeros(b.shape[:2], np.int64)


def edges_of(image: np.ndarray, block: int) -> np.ndarray:
    b = _blocks(image, block).astype(np.int64)
    line = np.abs(b[:, :, 1:-1, 2:] - b[:, :, 1:-1, :-2]) + np.abs(b[:, :, 2:, 1:-1] - b[:, :, :-2, 1:-1])
    return line.sum((2, 3)) // max(1, (block - 2) ** 2)


def difference_of(cur: np.ndarray, prev: np.ndarray, block: int) -> np.ndarray:
    return kernels.still_sad(cur, prev, block)


STRENGTH = "bx long, by long, strength long"


def contrast(frames: DataFrame, block: int) -> DataFrame:
    """Largest less smallest value of each block: frame_id, bx, by, strength."""
    return _each(frames, ["data"], STRENGTH, lambda x: _raster(contrast_of(x, block)))


def edge_strength(frames: DataFrame, block: int) -> DataFrame:
    """Mean of |right - left| + |below - above| over each block's inner pixels, truncated."""
    return _each(frames, ["data"], STRENGTH, lambda x: _raster(edges_of(x, block)))


def block_sad(frame_pairs: DataFrame, block: int) -> DataFrame:
    """Sum of absolute differences of each block to the frame before, at no offset: frame_id, bx, by, sad."""
    made = _each(frame_pairs.where("prev is not null"), ["cur", "prev"], "bx long, by long, sad long", lambda x, y: _raster(difference_of(x, y, block)), "cur_id")
    return made.withColumnRenamed("cur_id", "frame_id")


def motion_magnitude(frame_pairs: DataFrame, block: int) -> DataFrame:
    """Mean absolute difference of each block to the frame before, truncated: frame_id, bx, by, strength."""
    return block_sad(frame_pairs, block).select("frame_id", "bx", "by", F.floor(F.col("sad") / (block * block)).alias("strength"))


def estimate_motion(frame_pairs: DataFrame, block: int = 16, reach: int = 16, threshold: int = 256, keep_zero: bool = False) -> DataFrame:
    """Motion vectors of every pair by diamond search, without zero vectors unless asked: cur_id, prev_id, block_x, block_y, dx, dy, sad."""

    def make(cur, prev):
        mv = kernels.diamond(cur, prev, block, reach, threshold) if prev is not None else np.zeros((0, 5), np.int64)
        return list((mv if keep_zero else mv[(mv[:, 2] != 0) | (mv[:, 3] != 0)]).T)

    made = _each(frame_pairs, ["cur", "prev"], "block_x long, block_y long, dx long, dy long, sad long", make, "cur_id")
    return made.select("cur_id", (F.col("cur_id") - 1).alias("prev_id"), "block_x", "block_y", "dx", "dy", "sad")


def full_search(frame_pairs: DataFrame, block: int = 16, reach: int = 16) -> DataFrame:
    """Least sum of absolute differences over all offsets up to ``reach``, per block of each pair: cur_id, block_x, block_y, dx, dy, sad.

    Ties go to the zero offset, then to the least (dy, dx).
    """

    def make(cur, prev):
        found = kernels.full_search(cur, prev, block, reach) if prev is not None else np.zeros((0, 5), np.int64)
        return list(found.T)

    return _each(frame_pairs, ["cur", "prev"], "block_x long, block_y long, dx long, dy long, sad long", make, "cur_id")


def overlaps(regions: DataFrame, cell: int = 64) -> DataFrame:
    """(key, a, b), a < b: all pairs of a key's rectangles (key, id, r) that intersect.

    A rectangle's level is the first grid, of cells ``cell`` * 4 ** level wide, whose cells aren't smaller than it, so it covers
    at most four cells there, and on coarser grids. Two rectangles meet on the grid of the larger one's level, and count
    in the cell of the first corner of what they share, so a pair is there once. Rows grow with the number of levels that
    occur (at most 32), not with areas. Rectangles without an area and nulls meet nothing.
    """
    r, size = F.col("r"), lambda n: F.lit(cell).cast("long") * F.pow(F.lit(4.0), n).cast("long")
    level = F.expr(f"cast(size(filter(transform(sequence(0, 25), l -> {cell}D * pow(4D, l)), w -> w < greatest(r.width, r.height))) as int)")
    held = regions.where((r["width"] > 0) & (r["height"] > 0)).select("key", "id", "r", level.alias("own"))
    kinds = sorted(x[0] for x in held.select("own").distinct().collect())  # at most 32
    at = lambda c, n, l: F.floor((r[c] + (r[n] - 1 if n else 0)) / size(l)).cast("long")

    def cells(rows: DataFrame, side: str) -> DataFrame:
        spread = rows.withColumn("cx", F.explode(F.sequence(at("x", None, F.col("level")), at("x", "width", F.col("level"))))).withColumn("cy", F.explode(F.sequence(at("y", None, F.col("level")), at("y", "height", F.col("level")))))
        return spread.select("key", "level", "cx", "cy", F.col("id").alias(f"id_{side}"), F.col("r").alias(f"r_{side}"), F.col("own").alias(f"own_{side}"))

    large = cells(held.withColumn("level", F.col("own")), "l")
    small = cells(held.withColumn("level", F.explode(F.array(*[F.lit(k) for k in kinds or [0]]))).where(F.col("level") >= F.col("own")), "s")
    ra, rb = F.col("r_s"), F.col("r_l")
    first = (F.floor(F.greatest(ra["x"], rb["x"]) / size(F.col("level"))) == F.col("cx")) & (F.floor(F.greatest(ra["y"], rb["y"]) / size(F.col("level"))) == F.col("cy"))
    once = (F.col("own_s") < F.col("own_l")) | (F.col("id_s") < F.col("id_l"))
    met = small.join(large, ["key", "level", "cx", "cy"]).where(once & scalar.intersects(ra, rb) & first)
    return met.select("key", F.least("id_s", "id_l").alias("a"), F.greatest("id_s", "id_l").alias("b"))


def region_rows(strengths: DataFrame, block: int, threshold: int, roi_type: int, least_area: int = values.MIN_REGION_AREA) -> DataFrame:
    """Regions of the blocks above the threshold, from frame_id, bx, by, strength."""
    size: Column = F.lit(block).cast("long")
    found = strengths.where(F.col("strength") > threshold).select("frame_id", (F.col("bx") * block).cast("long").alias("x"), (F.col("by") * block).cast("long").alias("y"), size.alias("width"), size.alias("height"), F.lit(roi_type).cast("long").alias("roi_type"), F.lit(1).cast("long").alias("priority"), (F.least(F.col("strength"), F.lit(255)) / 255.0).alias("confidence"))
    return found.where(F.col("width") * F.col("height") >= least_area)


REGION = "x long, y long, width long, height long, roi_type long, priority long, confidence double"
FIELDS = [c.split()[0] for c in REGION.split(", ")]


def _found(strengths: np.ndarray, block: int, threshold: int, roi_type: int) -> list[dict]:
    if block * block < values.MIN_REGION_AREA:
        return []
    return [dict(zip(FIELDS, (int(x) * block, int(y) * block, block, block, roi_type, 1, min(int(s), 255) / 255.0))) for x, y, s in zip(*_raster(strengths)) if s > threshold]


def _detect(image: np.ndarray, block: int, edge: int, contrast_above: int) -> list[dict]:
    return kernels.merge_regions(_found(edges_of(image, block), block, edge, 3) + _found(contrast_of(image, block), block, contrast_above, 2))


def _columns(found: list[dict]) -> list[list]:
    return [[r[c] for r in found] for c in FIELDS]


def detect(frames: DataFrame, block: int = values.ROI_BLOCK, edge: int = values.EDGE_THRESHOLD, contrast_above: int = values.CONTRAST_THRESHOLD) -> DataFrame:
    """Edge regions, then high contrast (text), merged: frame_id and REGION."""
    return _each(frames, ["data"], REGION, lambda x: _columns(_detect(x, block, edge, contrast_above)))


def detect_with_motion(frame_pairs: DataFrame, block: int = values.ROI_BLOCK, edge: int = values.EDGE_THRESHOLD, contrast_above: int = values.CONTRAST_THRESHOLD, motion: int = values.MOTION_THRESHOLD) -> DataFrame:
    """The merged regions of ``detect`` and those that moved since the frame before (if any), merged again: frame_id and REGION."""

    def make(cur, prev):
        moved = _found(difference_of(cur, prev, block) // (block * block), block, motion, 4) if prev is not None else []
        return _columns(kernels.merge_regions(_detect(cur, block, edge, contrast_above) + moved))

    return _each(frame_pairs, ["cur", "prev"], REGION, make, "cur_id").withColumnRenamed("cur_id", "frame_id")
