"""Cameras, images, points and depth parameters: lookups and fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import norm, stem

# Camera models by id, with their parameter counts.
MODELS = [
    (0, "SIMPLE_PINHOLE", 3),
    (1, "PINHOLE", 4),
    (2, "SIMPLE_RADIAL", 4),
    (3, "RADIAL", 5),
    (4, "OPENCV", 8),
    (5, "OPENCV_FISHEYE", 8),
    (6, "FULL_OPENCV", 12),
    (7, "FOV", 5),
    (8, "SIMPLE_RADIAL_FISHEYE", 4),
    (9, "RADIAL_FISHEYE", 5),
    (10, "THIN_PRISM_FISHEYE", 12),
]


def model_catalogue(spark: SparkSession) -> DataFrame:
    """model_id, model, n_params."""
    return spark.createDataFrame(MODELS, "model_id int, model string, n_params int")


def with_camera(images: DataFrame, cameras: DataFrame) -> DataFrame:
    """Images with their camera, by camera_id; images without one go."""
    return images.join(cameras, "camera_id")


def with_model(cameras: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Cameras with their model's name; the catalogue has eleven rows."""
    return cameras.join(F.broadcast(catalogue), "model_id")


def with_depth_params(images: DataFrame, params: DataFrame) -> DataFrame:
    """Images with scale and offset by their name's stem; null where there are none."""
    keyed = images.withColumn("_stem", stem(F.col("name")))
    return keyed.join(params.select(F.col("name").alias("_stem"), "scale", "offset"), "_stem", "left").drop("_stem")


def with_exposure(images: DataFrame, exposures: DataFrame) -> DataFrame:
    """Images with their exposure matrix by name; null where there is none."""
    return images.join(exposures, "name", "left")


def flagged(images: DataFrame, test_names: DataFrame) -> DataFrame:
    """Images with is_test: whether their name is listed."""
    listed = test_names.select(F.col("name")).distinct().withColumn("is_test", F.lit(True))
    return images.join(listed, "name", "left").withColumn("is_test", F.coalesce("is_test", F.lit(False)))


def for_training(images: DataFrame, with_test: bool = False) -> DataFrame:
    """Training images; with_test takes the test images too."""
    return images if with_test else images.where(~F.col("is_test"))


def observed_points(images: DataFrame, points: DataFrame) -> DataFrame:
    """A row for each observation of a 3D point: image columns, x, y, point columns; observations of none go."""
    seen = images.select("image_id", F.explode("observations").alias("o")).select("image_id", F.col("o.x").alias("x"), F.col("o.y").alias("y"), F.col("o.point3d_id").alias("point_id"))
    return seen.where(F.col("point_id") >= 0).join(points, "point_id")


def in_view(df: DataFrame) -> DataFrame:
    """Observations inside their image (columns x, y, width, height) with positive depth."""
    return df.where("x >= 0 and y >= 0 and x < width and y < height and depth > 0")


def median_positive_scale(params: DataFrame) -> DataFrame:
    """One row: median_scale over positive scales; 0 if there is none."""
    return params.agg(F.coalesce(F.median(F.when(F.col("scale") > 0, F.col("scale"))), F.lit(0.0)).alias("median_scale"))


def depth_fit(df: DataFrame, by: str, target: str, source: str, least: int = 10, least_range: float = 1e-3) -> DataFrame:
    """scale and offset, by group, that take source inverse depths to target ones: medians
    match, and mean absolute deviations from them. Zeros where a group has no more than
    `least` rows or a target range no over least_range."""
    rows = df.where(F.col(target).isNotNull() & F.col(source).isNotNull())
    middle = rows.groupBy(by).agg(F.median(target).alias("_mt"), F.median(source).alias("_ms"), F.count("*").alias("_n"), (F.max(target) - F.min(target)).alias("_range"))
    spread = rows.join(middle, by).groupBy(by, "_mt", "_ms", "_n", "_range").agg(F.avg(F.abs(F.col(target) - F.col("_mt"))).alias("_at"), F.avg(F.abs(F.col(source) - F.col("_ms"))).alias("_as"))
    good = (F.col("_n") > least) & (F.col("_range") > least_range) & (F.col("_as") > 0)
    scale = F.when(good, F.try_divide(F.col("_at"), F.col("_as"))).otherwise(0.0)
    return spread.select(by, scale.alias("scale"), F.when(good, F.col("_mt") - F.col("_ms") * scale).otherwise(0.0).alias("offset"))


def scene_sphere(df: DataFrame, center: str, by: list[str], margin: float = 1.1) -> DataFrame:
    """center and radius (1.1 x the farthest camera's distance) by group."""
    middle = df.groupBy(*by).agg(F.array(*(F.avg(F.get(center, F.lit(i))) for i in range(3))).alias("center"))
    far = norm(F.zip_with(center, "_c", lambda a, b: a - b))
    return df.join(middle.withColumnRenamed("center", "_c"), by).groupBy(*by, "_c").agg((F.max(far) * margin).alias("radius")).withColumnRenamed("_c", "center")


def mean_track_length(points: DataFrame) -> DataFrame:
    """One row: mean observations of a point."""
    return points.agg(F.avg(F.size("track")).alias("mean_track_length"))


def each_view(prims: DataFrame, cameras: DataFrame, most: int = 10_000) -> DataFrame:
    """Every primitive seen from every camera: direction from the camera's centre.

    Cameras are a stated set, broadcast; more than `most` must be taken in parts."""
    if cameras.limit(most + 1).count() > most:
        raise ValueError(f"over {most} cameras: take them in parts")
    pairs = prims.crossJoin(F.broadcast(cameras.select("camera_id", F.col("center").alias("_center"))))
    ray = F.zip_with("xyz", "_center", lambda a, b: a - b)
    n = norm(F.col("_ray"))
    return pairs.withColumn("_ray", ray).withColumn("direction", F.transform("_ray", lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))).drop("_ray", "_center")
