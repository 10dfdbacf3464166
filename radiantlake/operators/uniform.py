"""Uniform scalar quantization over an attribute's global range."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_range(df: DataFrame, column: str) -> DataFrame:
    """One row: low, high over all rows and dimensions of an array column."""
    return df.agg(F.min(F.array_min(column)).alias("low"), F.max(F.array_max(column)).alias("high"))


def ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row of the ranges of several array columns, in one pass."""
    return df.agg(*(e for c in columns for e in (F.min(F.array_min(c)).alias(f"{c}_low"), F.max(F.array_max(c)).alias(f"{c}_high"))))


def step(low: Column, high: Column, bits: int) -> Column:
    """Width of a level; 1 for a constant attribute."""
    return F.when(high > low, (high - low) / ((1 << bits) - 1)).otherwise(F.lit(1.0))


def code(x: Column, low: Column, width: Column, bits: int) -> Column:
    """Level of x, halves to even, kept in range."""
    return F.least(F.greatest(F.rint((x - low) / width), F.lit(0.0)), F.lit(float((1 << bits) - 1))).cast("int")


def middle(q: Column, low: Column, width: Column) -> Column:
    return q * width + low


def _each(column: str, f) -> Column:
    return F.transform(column, lambda x: f(x))


def quantize(df: DataFrame, bits: dict[str, int]) -> DataFrame:
    """df with each array column replaced by its codes, and columns NAME_low, NAME_step.

    One aggregate finds all ranges (combined map-side); its single row is broadcast."""
    span = ranges(df, list(bits))
    joined = df.crossJoin(F.broadcast(span))
    out = {}
    for c, b in bits.items():
        low, width = F.col(f"{c}_low"), step(F.col(f"{c}_low"), F.col(f"{c}_high"), b)
        out[c] = _each(c, partial(code, low=low, width=width, bits=b))
        out[f"{c}_step"] = width
    return joined.withColumns(out).drop(*(f"{c}_high" for c in bits))


def dequantize(df: DataFrame, columns: list[str]) -> DataFrame:
    """The inverse: codes back to the middle of their levels."""
    out = {c: _each(c, partial(middle, low=F.col(f"{c}_low"), width=F.col(f"{c}_step"))) for c in columns}
    return df.withColumns(out).drop(*(f"{c}_{x}" for c in columns for x in ("low", "step")))
