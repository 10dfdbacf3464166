"""Growing and pruning a primitive table by supplied gradients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import rotation_matrix
from ..functions.scalars import dot, sigmoid


def gradient_means(observed: DataFrame) -> DataFrame:
    """splat_id, gradient (mean of norms over views that saw it, 0 if none did), radius (largest)."""
    seen = F.col("radius") > 0
    rows = observed.groupBy("splat_id").agg(F.sum(F.when(seen, F.col("gradient")).otherwise(0.0)).alias("_s"), F.sum(F.when(seen, 1).otherwise(0)).alias("_n"), F.max("radius").alias("radius"))
    return rows.select("splat_id", F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")).otherwise(0.0).alias("gradient"), "radius")


def visible(observed: DataFrame) -> DataFrame:
    return observed.where(F.col("radius") > 0)


def _largest() -> Column:
    return F.exp(F.array_max("scales"))


def cloned(df: DataFrame, threshold: float, extent: float, share: float = 0.01) -> DataFrame:
    """Small rows of a strong gradient, once more (column gradient)."""
    return df.where((F.col("gradient") >= threshold) & (_largest() <= share * extent))


def split(df: DataFrame, threshold: float, extent: float, share: float = 0.01, n: int = 2, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, children): each large row of a strong gradient becomes n children,
    drawn from its own distribution, of scale 1 / (0.8 n)."""
    chosen = (F.col("gradient") >= threshold) & (_largest() > share * extent)
    parents = df.where(chosen).withColumn("child", F.explode(F.sequence(F.lit(1), F.lit(n))))
    drawn = parents.withColumn("_e", F.array(*(F.randn(seed + i) * F.exp(F.get("scales", F.lit(i))) for i in range(3))))
    turned = F.transform(rotation_matrix(F.col("rotations")), lambda row: dot(row, F.col("_e")))
    placed = drawn.withColumn("xyz", F.zip_with("xyz", turned, lambda a, b: a + b)).withColumn("scales", F.transform("scales", lambda s: s - F.log(F.lit(0.8 * n)))).drop("_e", "child")
    return df.where(~chosen), placed


def prunable(least_opacity: float, extent: float | None = None, largest_radius: float | None = None) -> Column:
    """Whether a row is too faint or, where a limit is given, too large on screen or in the scene."""
    out = sigmoid(F.col("opacity")) < least_opacity
    if largest_radius is not None:
        out = out | (F.col("radius") > largest_radius)
    if extent is not None:
        out = out | (_largest() > 0.1 * extent)
    return out


def densified(df: DataFrame, threshold: float, extent: float, least_opacity: float, largest_radius: float | None = None, seed: int = 0) -> DataFrame:
    """Clone, then split, then prune."""
    grown = df.unionByName(cloned(df, threshold, extent).withColumn("gradient", F.lit(0.0)))
    stay, children = split(grown, threshold, extent, seed=seed)
    return stay.unionByName(children).where(~prunable(least_opacity, extent if largest_radius is not None else None, largest_radius))


def random_cloud(spark, n: int = 100_000, half: float = 1.3, seed: int = 0) -> DataFrame:
    """n points uniform in a cube around the origin, with colours."""
    at = lambda k: (F.rand(seed + k) * 2 - 1) * half
    return spark.range(n).select(F.col("id").alias("point_id"), F.array(*(at(k) for k in range(3))).alias("xyz"), F.array(*(F.rand(seed + 3 + k) for k in range(3))).alias("rgb"))


def nearest_distances(points: DataFrame, cell: float) -> DataFrame:
    """point_id, distance2: squared distance to the nearest other point within a cell's
    length, by a join on grid cells (a point meets its own and the 26 around); null if
    there is none. A cell's points are the only ones compared."""
    cells = points.select("point_id", "xyz", *(F.floor(F.get("xyz", F.lit(i)) / cell).alias(f"g{i}") for i in range(3)))
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    probes = cells.select("point_id", "xyz", *(F.col(f"g{i}") for i in range(3)))
    for i in range(3):
        probes = probes.withColumn("_d", F.explode(steps)).withColumn(f"g{i}", F.col(f"g{i}") + F.col("_d")).drop("_d")
    other = cells.select(F.col("point_id").alias("o_id"), F.col("xyz").alias("o_xyz"), *(F.col(f"g{i}") for i in range(3)))
    d2 = F.aggregate(F.zip_with("xyz", "o_xyz", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    near = probes.join(other, ["g0", "g1", "g2"]).where("point_id <> o_id").groupBy("point_id").agg(F.min(d2).alias("distance2"))
    return points.select("point_id").join(near, "point_id", "left").select("point_id", F.when(F.col("distance2") <= cell * cell, F.col("distance2")).alias("distance2"))


def seeded(points: DataFrame, cell: float) -> DataFrame:
    """Primitives from a coloured point cloud: log distance to the nearest point as scale,
    opacity 0.1, no rotation, colour as the constant harmonic."""
    from ..functions.harmonics import harmonic_of_rgb

    rows = points.join(nearest_distances(points, cell), "point_id")
    scale = F.log(F.sqrt(F.greatest(F.coalesce("distance2", F.lit(cell * cell)), F.lit(1e-7))))
    return rows.select(F.col("point_id").alias("splat_id"), "xyz", harmonic_of_rgb(F.col("rgb")).alias("sh_dc"), F.log(F.lit(0.1 / 0.9)).alias("opacity"), F.array_repeat(scale, 3).alias("scales"), F.array(*(F.lit(float(v)) for v in (1, 0, 0, 0))).alias("rotations"), F.array_repeat(F.lit(0.0), 45).alias("sh_rest"))
