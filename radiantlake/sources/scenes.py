"""JSON beside scenes: camera transforms, depth parameters, exposures, camera lists, results, options."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import flip_axes, rigid_inverse
from ..functions.scalars import stem

FRAMES = "camera_angle_x double, frames array<struct<file_path:string,transform_matrix:array<array<double>>>>"


def read_transforms(spark: SparkSession, path: str, extension: str = ".png") -> DataFrame:
    """name, file, fov_x, rotation (rows, world to camera) and translation of each frame."""
    rows = spark.read.schema(FRAMES).json(path, multiLine=True).select("camera_angle_x", F.explode("frames").alias("f"))
    view = rigid_inverse(flip_axes(F.col("f.transform_matrix")))
    out = rows.select((F.col("f.file_path") if not extension else F.concat("f.file_path", F.lit(extension))).alias("file"), F.col("camera_angle_x").alias("fov_x"), view.alias("v"))
    return out.select(stem(F.col("file")).alias("name"), "file", "fov_x", F.transform(F.slice("v", 1, 3), lambda r: F.slice(r, 1, 3)).alias("rotation"), F.transform(F.slice("v", 1, 3), lambda r: F.element_at(r, 4)).alias("translation"))


def _map(spark: SparkSession, path: str, kind: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{kind}>")).alias("name", "value"))


def read_depth_params(spark: SparkSession, path: str) -> DataFrame:
    """name, scale, offset."""
    return _map(spark, path, "struct<scale:double,offset:double>").select("name", "value.*")


def read_exposures(spark: SparkSession, path: str) -> DataFrame:
    """name, matrix (3 x 4)."""
    return _map(spark, path, "array<array<double>>").select("name", F.col("value").alias("matrix"))


def _one_object(df: DataFrame, key: str, value: Column) -> str:
    """Rows as one JSON object; they stream through the driver."""
    rows = df.select(F.col(key).alias("k"), F.to_json(value).alias("v")).orderBy("k").toLocalIterator()
    return "{" + ", ".join(f"{json.dumps(r.k)}: {r.v}" for r in rows) + "}"


def write_depth_params(df: DataFrame, path: str) -> None:
    with open(path, "w") as f:
        f.write(_one_object(df, "name", F.struct("scale", "offset")))


def write_exposures(df: DataFrame, path: str) -> None:
    with open(path, "w") as f:
        f.write(_one_object(df, "name", F.col("matrix")))


def camera_records(cameras: DataFrame) -> DataFrame:
    """id, img_name, width, height, position, rotation (camera to world), fx, fy of
    cameras (camera_id, name, width, height, rotation, translation, fov_x, fov_y)."""
    from ..functions.geometry import camera_center
    from ..functions.scalars import focal_of_fov

    turned = F.array(*(F.array(*(F.col("rotation")[j][i] for j in range(3))) for i in range(3)))
    return cameras.select(F.col("camera_id").alias("id"), F.col("name").alias("img_name"), "width", "height", camera_center(F.col("rotation"), F.col("translation")).alias("position"), turned.alias("rotation"), focal_of_fov(F.col("fov_x"), F.col("width")).alias("fx"), focal_of_fov(F.col("fov_y"), F.col("height")).alias("fy"))


def append_results(df: DataFrame, path: str) -> None:
    """Add result rows to a folder of JSON lines, by configuration run."""
    df.write.mode("append").json(path)


def merged_options(stored: str, given: dict) -> dict:
    """Options of a JSON text, overridden by those given that are not null."""
    return json.loads(stored) | {k: v for k, v in given.items() if v is not None}


def checkpoint(df: DataFrame, folder: str, iteration: int) -> str:
    """A snapshot of a table, by iteration."""
    path = f"{folder.rstrip('/')}/iteration={iteration}"
    df.write.mode("overwrite").parquet(path)
    return path


def restore(spark: SparkSession, folder: str, iteration: int | None = None) -> DataFrame:
    """The snapshot of an iteration; the newest if none is named."""
    rows = spark.read.parquet(folder)
    if iteration is None:
        iteration = rows.agg(F.max("iteration")).first()[0]
    return rows.where(F.col("iteration") == iteration).drop("iteration")


def paired_images(renders: DataFrame, truth: DataFrame) -> DataFrame:
    """name, render, truth of two binaryFile tables, by equal file names."""
    name = F.substring_index("path", "/", -1)
    return renders.select(name.alias("name"), F.col("content").alias("render")).join(truth.select(name.alias("name"), F.col("content").alias("truth")), "name")
