"""Block transforms over arrays of n * n values: DCT as a matrix product a batch, quantization, sparse coefficients."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values
from ..functions.kernels import dct_basis


def _product(df: DataFrame, source: str, made: str, matrix: np.ndarray) -> DataFrame:
    """block and the product of ``matrix`` with each row's array; null where the array is null or not as long as a block."""
    size = matrix.shape[1]

    def rows(batches):
        for batch in batches:
            col = batch[source]
            fits = (pc.list_value_length(col).to_numpy(zero_copy_only=False) == size) if len(col) else np.zeros(0, bool)
            fits = np.array([x is True or x is np.True_ for x in fits.tolist()], bool)
            x = col.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
            y = x @ matrix.T
            ends = np.concatenate(([0], np.cumsum(np.where(fits, size, 0)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["block"], pa.ListArray.from_arrays(pa.array(ends), pa.array(y.reshape(-1)), mask=pa.array(~fits))], names=["block", made])

    return df.select("block", source).mapInArrow(rows, f"block {dict(df.dtypes)['block']}, {made} array<double>")


def forward(df: DataFrame, n: int = 8) -> DataFrame:
    """block, coeffs (index v * n + u) from block, samples (index y * n + x): no shuffle."""
    b = dct_basis(n)
    return _product(df, "samples", "coeffs", np.kron(b, b))


def inverse(df: DataFrame, n: int = 8) -> DataFrame:
    """block, samples from block, coeffs."""
    b = dct_basis(n)
    return _product(df, "coeffs", "samples", np.kron(b, b).T)


def quant_matrix(n: int = 8, quality: int = 50) -> list[int]:
    """The luminance table for n = 8, else 4 (x + y + 2), scaled by quality as JPEG does."""
    base = values.LUMINANCE_QUANT if n == 8 else [4 * (x + y + 2) for y in range(n) for x in range(n)]
    q = min(100, max(1, quality))
    scale = 5000 // q if q < 50 else 200 - 2 * q
    return [max(1, math.floor(m * scale / 100)) for m in base]


def quant_column(n: int, quality: int) -> Column:
    return F.array(*[F.lit(m) for m in quant_matrix(n, quality)])


def quantize(coeffs: Column, n: int = 8, quality: int = 50) -> Column:
    """Each coefficient over its quantum, rounded half away from zero."""
    return F.zip_with(coeffs, quant_column(n, quality), lambda c, m: F.round(c * (1.0 / m)).cast("int"))


def dequantize(q: Column, n: int = 8, quality: int = 50) -> Column:
    return F.zip_with(q, quant_column(n, quality), lambda c, m: (c * m).cast("double"))


def sparse_threshold(threshold: float = 0.001) -> int:
    return math.floor(threshold * 1000)


def sparse_encode(coeffs: Column, n: int = 8, threshold: float = 0.001) -> Column:
    """Array of (u, v, value) of the coefficients above the threshold, from an array in order."""
    least = sparse_threshold(threshold)
    pairs = F.transform(coeffs, lambda c, i: F.struct((i % n).cast("int").alias("u"), F.floor(i / n).cast("int").alias("v"), c.cast("float").alias("value")))
    return F.filter(pairs, lambda p: F.abs(p["value"]) > least)


def sparse_decode(sparse: Column, n: int = 8, default: int = 0) -> Column:
    """The dense array; entries beyond n are ignored, the last of several for one coefficient wins."""
    put = lambda dense, p: F.transform(dense, lambda x, i: F.when(i == p["v"] * n + p["u"], p["value"].cast("int")).otherwise(x))
    return F.aggregate(F.filter(sparse, lambda p: (p["u"] < n) & (p["v"] < n)), F.array_repeat(F.lit(default), n * n), put)


def energy_compaction(df: DataFrame, key: str = "block") -> DataFrame:
    """1 - sum of squared errors over sum of squares, per key; 1 without energy."""
    err, power = F.sum((F.col("o") - F.col("r")) ** 2), F.sum(F.col("o") ** 2)
    return df.groupBy(key).agg(F.when(power == 0, 1.0).otherwise(1 - err / power).alias("compaction"))


def symbol_scale(low: Column, high: Column) -> Column:
    """0 where a symbol is a value less the lowest; else the 32-bit factor that maps the range to 0..255."""
    width = high - low
    return F.when(width <= 255, F.lit(0.0)).otherwise(255.0 / F.greatest(width, F.lit(1))).cast("float")


def to_symbol(v: Column, low: Column, scale: Column) -> Column:
    scaled = ((v - low).cast("float") * scale).cast("int")
    return F.when(scale == 0, v - low).otherwise(F.least(F.lit(255), F.greatest(F.lit(0), scaled))).cast("long")


def from_symbol(symbol: Column, low: Column, scale: Column) -> Column:
    inverse = F.when(scale != 0, 1.0 / scale).cast("float")
    return F.when(scale == 0, symbol).otherwise((symbol.cast("float") * inverse + F.lit(0.5).cast("float")).cast("int")).cast("long") + low
