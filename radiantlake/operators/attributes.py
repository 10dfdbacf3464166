"""The primitive table: attribute arrays, their named columns and band selections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Array attributes of a primitive and their widths; opacity is a scalar.
WIDTHS = {"xyz": 3, "sh_dc": 3, "scales": 3, "rotations": 4, "sh_rest": 45}
PER_CHANNEL = 15


def from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primitives from the first 59 of the embeddings' 64 dimensions: splat_id, scene,
    xyz, sh_dc, opacity, scales, rotations, sh_rest, in double precision."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    e = F.transform("embedding", lambda x: x.cast("double"))
    return rows.select(F.col("vec_id").alias("splat_id"), F.col("label").alias("scene"), e.alias("e")).select(
        "splat_id", "scene", F.slice("e", 1, 3).alias("xyz"), F.slice("e", 4, 3).alias("sh_dc"), F.get("e", F.lit(6)).alias("opacity"), F.slice("e", 8, 3).alias("scales"), F.slice("e", 11, 4).alias("rotations"), F.slice("e", 15, 45).alias("sh_rest")
    )


def pack_columns(df: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """Columns PREFIXn as one array for each prefix, by number; other columns stay."""
    out, used = [], set()
    for prefix, name in prefixes.items():
        cols = sorted((c for c in df.columns if re.fullmatch(re.escape(prefix) + r"\d+", c)), key=lambda c: int(c[len(prefix) :]))
        used.update(cols)
        out.append(F.array(*(F.col(c).cast("double") for c in cols)).alias(name))
    return df.select(*(c for c in df.columns if c not in used), *out)


def unpack_columns(df: DataFrame, arrays: dict[str, tuple[str, int]]) -> DataFrame:
    """The inverse: an array of n values as columns PREFIX0 to PREFIXn-1."""
    plain = [c for c in df.columns if c not in arrays]
    return df.select(*plain, *(F.get(F.col(name), F.lit(i)).alias(f"{prefix}{i}") for name, (prefix, n) in arrays.items() for i in range(n)))


def truncated(rest: Column, degree: int, by_band: bool = False) -> Column:
    """Coefficients up to degree: the first 3 ((degree + 1)^2 - 1) as they lie, or, by
    band, the same share of each channel."""
    k = (degree + 1) ** 2 - 1
    if not by_band:
        return F.slice(rest, 1, 3 * k)
    return F.concat(*(F.slice(rest, c * PER_CHANNEL + 1, k) for c in range(3))) if k else F.slice(rest, 1, 0)


def padded(rest: Column, width: int = 45) -> Column:
    """With zeros up to width."""
    return F.concat(rest, F.array_repeat(F.lit(0.0), F.greatest(F.lit(width) - F.size(rest), F.lit(0))))


def band_zeroed(rest: Column, band: int) -> Column:
    """With the coefficients of one band (1 to 3) of each channel at zero."""
    low, high = band * band - 1, (band + 1) ** 2 - 1
    return F.transform(rest, lambda v, i: F.when((i % PER_CHANNEL >= low) & (i % PER_CHANNEL < high), 0.0).otherwise(v))


def shape_vector() -> Column:
    """Scales, rotation and opacity as one vector of eight."""
    return F.concat("scales", "rotations", F.array("opacity"))


def split_shape(v: Column) -> dict[str, Column]:
    return {"scales": F.slice(v, 1, 3), "rotations": F.slice(v, 4, 4), "opacity": F.get(v, F.lit(7))}
