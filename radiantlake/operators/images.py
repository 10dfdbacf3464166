"""Errors between images held as rows of pixels, or as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

INF = float("inf")


def pixel_errors(df: DataFrame, by: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """mse, l1 by group of pixel rows."""
    d = F.col(a) - F.col(b)
    return df.groupBy(*by).agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("l1"))


def decibels(mse: Column) -> Column:
    """-10 log10 of a mean squared error; infinite at zero."""
    return F.when(mse > 0, -10 * F.log10(mse)).otherwise(F.lit(INF))


def psnr(df: DataFrame, image: list[str], channel: str | None = None) -> DataFrame:
    """psnr by image: of all pixels or, with a channel column, the mean of its channels'. The two differ."""
    if channel is None:
        return pixel_errors(df, image).select(*image, decibels(F.col("mse")).alias("psnr"))
    return pixel_errors(df, [*image, channel]).groupBy(*image).agg(F.avg(decibels(F.col("mse"))).alias("psnr"))


def _blur(x: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Separable filter with zeros beyond the border."""
    for axis in (0, 1):
        pad = [(0, 0)] * x.ndim
        pad[axis] = (len(window) // 2,) * 2
        wide = np.pad(x, pad)
        n = x.shape[axis]
        x = sum(w * np.take(wide, range(k, k + n), axis=axis) for k, w in enumerate(window))
    return x


def structural_similarity(a: np.ndarray, b: np.ndarray, size: int = 11, sigma: float = 1.5) -> float:
    """SSIM of two (height, width, channel) images in 0..1: Gaussian window, zero borders."""
    window = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    window /= window.sum()
    ma, mb = _blur(a, window), _blur(b, window)
    va, vb, cov = _blur(a * a, window) - ma * ma, _blur(b * b, window) - mb * mb, _blur(a * b, window) - ma * mb
    # fixed values: 0.01 and 0.03 squared keep quotients defined
    return float((((2 * ma * mb + 0.0001) * (2 * cov + 0.0009)) / ((ma * ma + mb * mb + 0.0001) * (va + vb + 0.0009))).mean())


def ssim(df: DataFrame, a: str, b: str, height: str = "height", width: str = "width") -> DataFrame:
    """df with ssim of two flat arrays of height x width x 3 values."""

    @pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for x, y, h, w in parts:
            yield pd.Series([structural_similarity(np.array(p, dtype=float).reshape(m, n, 3), np.array(q, dtype=float).reshape(m, n, 3)) for p, q, m, n in zip(x, y, h, w, strict=True)])

    return df.withColumn("ssim", score(a, b, height, width))


@pandas_udf(T.ArrayType(T.DoubleType()))
def bilinear(grid: pd.Series, width: pd.Series, xs: pd.Series, ys: pd.Series) -> pd.Series:
    """Values of a flat grid at points, between its cells' centres; the border's value beyond it."""

    def one(g, w, x, y):
        m = np.array(g, dtype=float).reshape(-1, int(w))
        x, y = np.clip(np.array(x, dtype=float), 0, m.shape[1] - 1), np.clip(np.array(y, dtype=float), 0, m.shape[0] - 1)
        i, j = np.floor(x).astype(int), np.floor(y).astype(int)
        i2, j2 = np.minimum(i + 1, m.shape[1] - 1), np.minimum(j + 1, m.shape[0] - 1)
        u, v = x - i, y - j
        return ((m[j, i] * (1 - u) + m[j, i2] * u) * (1 - v) + (m[j2, i] * (1 - u) + m[j2, i2] * u) * v).tolist()

    return pd.Series([one(*r) for r in zip(grid, width, xs, ys, strict=True)])


def training_loss(l1: Column, ssim_value: Column, depth_l1: Column | None = None, depth_weight: Column | float = 0.0, share: float = 0.2) -> Column:
    """(1 - share) l1 + share (1 - ssim), and a weighted depth term."""
    out = (1 - share) * l1 + share * (1 - ssim_value)
    return out if depth_l1 is None else out + depth_weight * depth_l1


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """bin, n over values in low..high."""
    return df.where((F.col(column) >= low) & (F.col(column) <= high)).groupBy(F.least(F.floor((F.col(column) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
