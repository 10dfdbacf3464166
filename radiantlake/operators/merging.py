"""Merging the primitives of a voxel into one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dot, logit, sigmoid

# What is added to a sum of weights, the least norm of a summed quaternion.
WEIGHT_MARGIN = 1e-10
LEAST_NORM = 1e-10
OPACITY_MARGIN = 1e-7
COLUMNS = ("xyz", "sh_dc", "opacity", "scales", "rotations", "sh_rest")


def _elementwise(f, column: str, n: int, weight: Column | None = None) -> Column:
    return F.array(*(f(F.get(column, F.lit(i)) * weight if weight is not None else F.get(column, F.lit(i))) for i in range(n)))


def voxel_merge(df: DataFrame, threshold: int = 3, max_variance: float | None = None, size: Column | None = None, rest_width: int = 45) -> tuple[DataFrame, DataFrame]:
    """(kept rows, merged rows) of a table with the column voxel.

    A voxel is merged if it has over threshold rows and its summed position variance
    is at most max_variance (default: twice its squared size, column voxel_size).
    Opacity-weighted means of position and colour, plain mean of log scales, weighted
    quaternion sum with signs aligned to the lowest splat_id's, joint opacity.
    threshold 0 merges nothing.

    All of it is aggregates that combine map-side: a crowded voxel costs a row for
    each task, not one task for all its rows. Merged rows carry n_members and the
    lowest splat_id."""
    size = F.col("voxel_size") if size is None else size
    limit = F.lit(float(max_variance)) if max_variance is not None else 2 * size * size
    weight = sigmoid(F.col("opacity"))
    rows = df.withColumn("_w", weight).withColumn("_limit", limit)
    facts = rows.groupBy("voxel").agg(F.count("*").alias("n_members"), sum(F.var_pop(F.get("xyz", F.lit(i))) for i in range(3)).alias("variance"), F.min_by("rotations", "splat_id").alias("_lead"), F.min("_limit").alias("_limit"))
    chosen = facts.withColumn("_merge", (F.lit(threshold) > 0) & (F.col("n_members") > threshold) & (F.col("variance") <= F.col("_limit"))).drop("_limit")
    marked = rows.drop("_limit").join(chosen, "voxel")
    kept = marked.where(~F.col("_merge")).select(df.columns)
    sign = F.when(dot(F.col("rotations"), F.col("_lead")) < 0, -1.0).otherwise(1.0)
    members = marked.where("_merge").withColumn("_sign", sign)
    total = F.sum("_w") + WEIGHT_MARGIN
    w = F.col("_w")
    # 1 - prod(1 - o), as a sum of logs
    clear = F.exp(F.sum(F.log1p(-F.least(sigmoid(F.col("opacity")), F.lit(1 - 1e-16)))))
    merged = members.groupBy("voxel").agg(
        F.min("splat_id").alias("splat_id"),
        F.count("*").alias("n_members"),
        _elementwise(lambda x: F.sum(x) / total, "xyz", 3, w).alias("xyz"),
        _elementwise(lambda x: F.sum(x) / total, "sh_dc", 3, w).alias("sh_dc"),
        logit(F.least(F.greatest(1 - clear, F.lit(OPACITY_MARGIN)), F.lit(1 - OPACITY_MARGIN))).alias("opacity"),
        _elementwise(F.avg, "scales", 3).alias("scales"),
        _elementwise(lambda x: F.sum(x) / total, "rotations", 4, w * F.col("_sign")).alias("_sum"),
        F.first("_lead").alias("_lead"),
        _elementwise(lambda x: F.sum(x) / total, "sh_rest", rest_width, w).alias("sh_rest"),
    )
    length = F.sqrt(dot(F.col("_sum"), F.col("_sum")))
    turned = F.when(length < LEAST_NORM, F.col("_lead")).otherwise(F.transform("_sum", lambda x: x / length))
    return kept, merged.withColumn("rotations", turned).select("voxel", "splat_id", "n_members", *COLUMNS)


def merge_statistics(df: DataFrame, threshold: int = 3, max_variance: float | None = None) -> DataFrame:
    """One row: what voxel_merge does to a table with voxel and voxel_size."""
    limit = F.lit(float(max_variance)) if max_variance is not None else 2 * F.min(F.col("voxel_size")) * F.min(F.col("voxel_size"))
    facts = df.groupBy("voxel").agg(F.count("*").alias("n"), sum(F.var_pop(F.get("xyz", F.lit(i))) for i in range(3)).alias("variance"), limit.alias("_limit"))
    full = F.col("n") > threshold
    merge = full & (F.col("variance") <= F.col("_limit")) if threshold > 0 else F.lit(False)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = facts.agg(
        F.sum("n").alias("n_before"),
        F.count("*").alias("n_voxels"),
        count(merge).alias("n_merged_voxels"),
        F.sum(F.when(merge, F.col("n")).otherwise(0)).alias("n_merged_rows"),
        F.sum(F.when(~merge, F.col("n")).otherwise(0)).alias("n_kept_rows"),
        count(full & ~merge).alias("n_rejected_voxels"),
    )
    return out.withColumn("n_after", F.col("n_kept_rows") + F.col("n_merged_voxels")).withColumn("ratio", F.col("n_before") / F.col("n_after"))


def blended(df: DataFrame, threshold: int = 3, max_variance: float | None = None) -> DataFrame:
    """Kept and merged rows together."""
    kept, merged = voxel_merge(df, threshold, max_variance)
    names = ["splat_id", *COLUMNS]
    return kept.select(names).unionByName(merged.select(names))
