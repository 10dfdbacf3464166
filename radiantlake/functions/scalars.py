"""Scalar functions over columns: activations, vectors, camera optics, schedules, names."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: probabilities are kept so far from 0 and 1 before a logit.
LOGIT_MARGIN = 1e-7


def sigmoid(x: Column) -> Column:
    """1 / (1 + e^-x); each branch only raises e to a negative power, so no overflow."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def logit(p: Column, margin: float = 0.0) -> Column:
    """ln(p / (1 - p)); with a margin, p is first kept so far inside (0, 1)."""
    if margin:
        p = F.least(F.greatest(p, F.lit(margin)), F.lit(1 - margin))
    return F.log(p) - F.log1p(-p)


def reset_opacity(raw: Column, ceiling: float = 0.01) -> Column:
    """Raw opacity whose activated value is at most ceiling."""
    return logit(F.least(sigmoid(raw), F.lit(ceiling)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def unit(a: Column) -> Column:
    """a over its norm; a zero vector stays zero."""
    n = norm(a)
    return scaled(a, F.when(n > 0, 1 / n).otherwise(F.lit(1.0)))


def matvec(rows: Column, v: Column) -> Column:
    """An array of rows times a vector."""
    return F.transform(rows, lambda row: dot(row, v))


def focal_of_fov(fov: Column, pixels: Column) -> Column:
    return pixels / (2 * F.tan(fov / 2))


def fov_of_focal(focal: Column, pixels: Column) -> Column:
    return 2 * F.atan(pixels / (2 * focal))


def log_linear_rate(step: Column, first: float, last: float, delay_steps: int = 0, delay_share: float = 1.0, steps: int = 1_000_000) -> Column:
    """Learning rate that falls from first to last log-linearly over steps; a delay
    starts it at delay_share and eases it in by a quarter sine. Zero for a negative
    step, or if both ends are zero."""
    if first == 0 and last == 0:
        return F.lit(0.0)
    t = F.least(F.greatest(step / steps, F.lit(0.0)), F.lit(1.0))
    rate = F.exp(math.log(first) * (1 - t) + math.log(last) * t)
    if delay_steps > 0:
        ease = F.sin(math.pi / 2 * F.least(F.greatest(step / delay_steps, F.lit(0.0)), F.lit(1.0)))
        rate = rate * (delay_share + (1 - delay_share) * ease)
    return F.when(step < 0, 0.0).otherwise(rate)


def composite(value: Column, alpha: Column, white: bool) -> Column:
    """A colour in 0..1 over a white or black background, as a truncated byte."""
    return F.floor((value * alpha + (1 - alpha) * (1.0 if white else 0.0)) * 255).cast("int")


def resized(width: Column, height: Column, factor: int = -1, widest: int = 1600, scale: float = 1.0) -> Column:
    """Width and height after resizing. A factor of 1, 2, 4 or 8 divides and rounds;
    -1 only shrinks images wider than widest; another factor is a target width. The
    last two truncate."""
    if factor in (1, 2, 4, 8):
        by = F.lit(float(scale * factor))
        return F.struct(F.bround(width / by).cast("int").alias("width"), F.bround(height / by).cast("int").alias("height"))
    target = F.when(width > widest, width / widest).otherwise(F.lit(1.0)) if factor == -1 else width / factor
    by = target * scale
    return F.struct(F.floor(width / by).cast("int").alias("width"), F.floor(height / by).cast("int").alias("height"))


def reliable_depth(scale: Column, median: Column) -> Column:
    """Whether a depth scale is between a fifth and five times the median."""
    return (scale >= 0.2 * median) & (scale <= 5 * median)


def affine_depth(depth: Column, scale: Column, offset: Column) -> Column:
    return F.when(scale > 0, depth * scale + offset).otherwise(depth)


def exposed(rgb: Column, matrix: Column) -> Column:
    """A colour through a 3 x 4 exposure matrix."""
    return F.transform(matrix, lambda row: dot(F.slice(row, 1, 3), rgb) + F.element_at(row, 4))


def stem(name: Column) -> Column:
    """A file name without folders and its last extension."""
    return F.regexp_replace(F.substring_index(name, "/", -1), r"\.[^.]*$", "")


def scene_name(name: Column) -> Column:
    """A scene's name without the first of these suffixes that it has."""
    return F.regexp_replace(name, "(_wb|_sqr|_test)$", "")


def number_suffix(name: Column) -> Column:
    """The integer after the last underscore; null if none."""
    digits = F.regexp_extract(name, r"_(\d+)$", 1)
    return F.when(digits != "", digits.cast("int"))


def index_bytes(bits: Column) -> Column:
    """Bytes that an index of so many bits is stored in: 1, 2 or 4."""
    return F.when(bits <= 8, 1).when(bits <= 16, 2).otherwise(4)
