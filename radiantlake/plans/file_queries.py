"""Registered queries that write files, read them back and look their rows up, each beside its SQL.

Files go to a new folder within the one that the session's machines share."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, scalars
from ..operators import cameras
from ..sources import colmap, container, ply, scenes
from . import codecs
from .queries import P, prims, query, r, table

FORMS = "(SELECT unnest(['bin', 'txt']) AS form)"


def scratch(spark: SparkSession) -> str:
    """A new folder that files can be opened in: within spark.checkpoint.dir, or a temporary one where it is unset."""
    top = (spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()).removeprefix("file://").removeprefix("file:")
    path = os.path.join(top, f"files-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


_FLAT = {"x": "xyz[1]", "dc2": "sh_dc[3]", "rest44": "sh_rest[45]", "opacity": "opacity", "s1": "scales[2]", "q3": "rotations[4]"}
_FLAT_COLUMNS = {"x": ("xyz", 0), "dc2": ("sh_dc", 2), "rest44": ("sh_rest", 44), "opacity": ("opacity", None), "s1": ("scales", 1), "q3": ("rotations", 3)}


def _flat(rows: DataFrame) -> list:
    return [r(F.col(c) if i is None else F.get(c, F.lit(i))).alias(name) for name, (c, i) in _FLAT_COLUMNS.items()]


@query(f"WITH {P} SELECT row_number() OVER (ORDER BY splat_id) - 1 AS splat_id, count(*) OVER () AS n, " + ", ".join(f"round({x}, 6) + 0.0 AS {c}" for c, x in _FLAT.items()) + " FROM p")
def primitive_file(spark: SparkSession, sf: str) -> DataFrame:
    """Primitives written to a PLY file and read by byte range; n is from its header."""
    model = os.path.join(scratch(spark), "point_cloud", "iteration_7")
    os.makedirs(model)
    ply.write_primitives(prims(spark, sf), os.path.join(model, "point_cloud.ply"))
    path = ply.newest_model(os.path.dirname(os.path.dirname(model)))
    rows = ply.read_primitives(spark, path)
    return rows.select("splat_id", F.lit(ply.vertex_count(path)).cast("bigint").alias("n"), *_flat(rows))


@query(f"WITH {P} SELECT row_number() OVER (ORDER BY splat_id) - 1 AS point_id, round(xyz[2], 6) + 0.0 AS y, round((splat_id % 250) / 255.0, 6) + 0.0 AS red, round(7 / 255.0, 6) + 0.0 AS blue FROM p")
def point_file(spark: SparkSession, sf: str) -> DataFrame:
    """Coloured points written to a PLY file and read back."""
    path = os.path.join(scratch(spark), "points.ply")
    red = (F.col("splat_id") % 250 + 0.5) / 255
    ply.write_points(prims(spark, sf).select(F.col("splat_id").alias("point_id"), "xyz", F.array(red, F.lit(0.5), F.lit(7.5 / 255)).alias("rgb")), path)
    rows = ply.read_points(spark, path)
    return rows.select("point_id", r(F.get("xyz", F.lit(1))).alias("y"), r(F.get("rgb", F.lit(0))).alias("red"), r(F.get("rgb", F.lit(2))).alias("blue"))


def _both(spark: SparkSession, df: DataFrame, kind: str) -> DataFrame:
    """df written as a binary and as a text file, and both read back, told apart by form."""
    folder, out = scratch(spark), None
    for form in ("bin", "txt"):
        path = os.path.join(folder, f"{kind}.{form}")
        colmap.write_table(df, path, kind)
        rows = colmap.point_lines(spark, path) if (kind, form) == ("points3D", "txt") else colmap.read_table(spark, path, kind)
        rows = rows.withColumn("form", F.lit(form))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"SELECT form, s_suppkey::INT AS camera_id, 'PINHOLE' AS model, 100 + s_nationkey::BIGINT AS width, s_acctbal AS fx, s_suppkey / 3 AS cy, 4::INT AS n_params FROM supplier, {FORMS}")
def cameras_files(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as cameras, with the model's name and parameter count from the catalogue."""
    params = F.array("s_acctbal", "s_acctbal", F.lit(1.5), F.col("s_suppkey") / 3)
    lens = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("int").alias("camera_id"), F.lit(1).alias("model_id"), F.lit("PINHOLE").alias("model"), (F.lit(100) + F.col("s_nationkey")).cast("bigint").alias("width"), F.lit(7).cast("bigint").alias("height"), params.alias("params"))
    rows = cameras.with_model(_both(spark, lens, "cameras").drop("model"), cameras.model_catalogue(spark))
    return rows.select("form", "camera_id", "model", "width", F.get("params", F.lit(0)).alias("fx"), F.get("params", F.lit(3)).alias("cy"), "n_params")


@query(
    f"""WITH o AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total, sum(CASE WHEN o_orderstatus = 'P' THEN -1 ELSE o_orderkey END)::BIGINT AS ids FROM orders GROUP BY o_custkey)
SELECT form, c_custkey::INT AS image_id, c_name || '.png' AS name, c_nationkey AS camera_id, c_acctbal AS tz, coalesce(n, 0)::INT AS n, round(coalesce(total, 0), 2) AS total, coalesce(ids, 0)::BIGINT AS ids FROM customer LEFT JOIN o ON o_custkey = c_custkey, {FORMS}"""
)
def images_files(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as images, their orders as observations."""
    seen = F.struct(F.col("o_totalprice").alias("x"), F.lit(0.5).alias("y"), F.when(F.col("o_orderstatus") == "P", F.lit(-1)).otherwise(F.col("o_orderkey")).alias("point3d_id"))
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(seen).alias("seen"))
    none = F.array().cast("array<struct<x:double,y:double,point3d_id:bigint>>")
    shots = table(spark, sf, "customer").join(orders, "c_custkey", "left").select(F.col("c_custkey").cast("int").alias("image_id"), F.array(*(F.lit(v) for v in (1.0, 0.0, 0.0, 0.0))).alias("rotation"), F.array(F.lit(0.1), F.lit(0.2), F.col("c_acctbal")).alias("translation"), F.col("c_nationkey").alias("camera_id"), F.concat("c_name", F.lit(".png")).alias("name"), F.coalesce("seen", none).alias("observations"))
    total = F.aggregate("observations", F.lit(0.0), lambda a, o: a + o["x"])
    ids = F.aggregate("observations", F.lit(0).cast("bigint"), lambda a, o: a + o["point3d_id"])
    return _both(spark, shots, "images").select("form", "image_id", "name", "camera_id", F.get("translation", F.lit(2)).alias("tz"), F.size("observations").alias("n"), F.round(total, 2).alias("total"), ids.alias("ids"))


@query(f"WITH t AS (SELECT l_partkey, count(*) AS n, sum(l_suppkey)::BIGINT AS images FROM lineitem GROUP BY l_partkey) SELECT form, p_partkey AS point_id, p_retailprice AS x, p_size AS red, coalesce(n, 0)::INT AS n, coalesce(images, 0)::BIGINT AS images FROM part LEFT JOIN t ON l_partkey = p_partkey, {FORMS}")
def points_files(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as points, their line items as tracks."""
    seen = F.struct(F.col("l_suppkey").cast("int").alias("image_id"), F.col("l_linenumber").cast("int").alias("point2d_index"))
    tracks = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.collect_list(seen).alias("seen"))
    none = F.array().cast("array<struct<image_id:int,point2d_index:int>>")
    points = table(spark, sf, "part").join(tracks, "p_partkey", "left").select(F.col("p_partkey").alias("point_id"), F.array(F.col("p_retailprice"), F.lit(0.1), F.lit(-2.0)).alias("xyz"), F.array(F.col("p_size"), F.lit(0), F.lit(255)).cast("array<int>").alias("rgb"), F.lit(0.25).alias("error"), F.coalesce("seen", none).alias("track"))
    images = F.aggregate("track", F.lit(0).cast("bigint"), lambda a, t: a + t["image_id"])
    return _both(spark, points, "points3D").select("form", "point_id", F.get("xyz", F.lit(0)).alias("x"), F.get("rgb", F.lit(0)).alias("red"), F.size("track").alias("n"), images.alias("images"))


def _turned(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as camera poses: a turn about z, and a place."""
    c, s = F.cos(F.col("s_suppkey") * 0.01), F.sin(F.col("s_suppkey") * 0.01)
    zero, one = F.lit(0.0), F.lit(1.0)
    rotation = F.array(F.array(c, -s, zero), F.array(s, c, zero), F.array(zero, zero, one))
    return table(spark, sf, "supplier").select("*", rotation.alias("rotation"), F.array(F.col("s_acctbal") / 1000, F.col("s_nationkey").cast("double"), F.lit(2.0)).alias("translation"))


_POSE = "WITH q AS (SELECT *, cos(s_suppkey * 0.01) AS c, sin(s_suppkey * 0.01) AS s, s_acctbal / 1000 AS tx, s_nationkey::DOUBLE AS ty FROM supplier)"


@query(_POSE + " SELECT s_name AS name, 0.7::DOUBLE AS fov_x, round(c, 6) + 0.0 AS r00, round(s, 6) + 0.0 AS r01, round(-c, 6) + 0.0 AS r11, round(-(c * tx + s * ty), 6) + 0.0 AS t0, round(-(s * tx - c * ty), 6) + 0.0 AS t1, 2.0::DOUBLE AS t2 FROM q")
def transforms_file(spark: SparkSession, sf: str) -> DataFrame:
    """Camera transforms as a JSON file; axes flipped and inverted as they are read."""
    last = F.array(*(F.lit(float(v)) for v in (0, 0, 0, 1)))
    matrix = F.array(*(F.concat(F.col("rotation")[i], F.array(F.col("translation")[i])) for i in range(3)), last)
    frames = _turned(spark, sf).select(F.to_json(F.struct(F.concat(F.lit("./train/"), "s_name").alias("file_path"), matrix.alias("transform_matrix"))).alias("f"))
    path = os.path.join(scratch(spark), "transforms.json")
    with open(path, "w") as f:
        f.write('{"camera_angle_x": 0.7, "frames": [' + ",\n".join(x.f for x in frames.toLocalIterator()) + "]}")
    v = scenes.read_transforms(spark, path)
    return v.select("name", "fov_x", r(F.col("rotation")[0][0]).alias("r00"), r(F.col("rotation")[0][1]).alias("r01"), r(F.col("rotation")[1][1]).alias("r11"), *(r(F.col("translation")[i]).alias(f"t{i}") for i in range(3)))


@query("WITH m AS (SELECT coalesce(median(s_acctbal) FILTER (s_acctbal > 0), 0) AS med FROM supplier) SELECT s_name AS name, s_acctbal AS scale, s_nationkey::DOUBLE AS \"offset\", s_acctbal >= 0.2 * med AND s_acctbal <= 5 * med AS reliable, round(CASE WHEN s_acctbal > 0 THEN 0.5 * s_acctbal + s_nationkey ELSE 0.5 END, 6) + 0.0 AS depth FROM supplier, m")
def depth_params_file(spark: SparkSession, sf: str) -> DataFrame:
    """Depth parameters as a JSON file; which are reliable, and a depth through each."""
    path = os.path.join(scratch(spark), "depth.json")
    scenes.write_depth_params(table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("scale"), F.col("s_nationkey").cast("double").alias("offset")), path)
    rows = scenes.read_depth_params(spark, path)
    both = rows.crossJoin(F.broadcast(cameras.median_positive_scale(rows)))
    return both.select("name", "scale", "offset", scalars.reliable_depth(F.col("scale"), F.col("median_scale")).alias("reliable"), r(scalars.affine_depth(F.lit(0.5), F.col("scale"), F.col("offset"))).alias("depth"))


@query("SELECT c_name AS name, CASE WHEN s_suppkey IS NULL THEN NULL ELSE round(0.1 * s_acctbal / 1000 + 0.3 * s_nationkey, 6) + 0.0 END AS red FROM customer LEFT JOIN supplier ON 'Customer#' || right(s_name, 9) = c_name")
def exposures_file(spark: SparkSession, sf: str) -> DataFrame:
    """Exposure matrices as a JSON file; images with theirs, and a colour through it."""
    path = os.path.join(scratch(spark), "exposure.json")
    row = F.array(F.col("s_acctbal") / 1000, F.lit(0.0), F.col("s_nationkey").cast("double"), F.lit(0.0))
    name = F.concat(F.lit("Customer#"), F.expr("right(s_name, 9)"))
    scenes.write_exposures(table(spark, sf, "supplier").select(name.alias("name"), F.array(row, row, row).alias("matrix")), path)
    shots = cameras.with_exposure(table(spark, sf, "customer").select(F.col("c_name").alias("name")), scenes.read_exposures(spark, path))
    return shots.select("name", r(scalars.exposed(F.array(F.lit(0.1), F.lit(0.2), F.lit(0.3)), F.col("matrix"))[0]).alias("red"))


@query(_POSE + " SELECT s_suppkey AS id, s_name AS img_name, round(-(c * tx + s * ty), 6) + 0.0 AS px, round(s * tx - c * ty, 6) + 0.0 AS py, -2.0::DOUBLE AS pz, round(s, 6) + 0.0 AS r01, round(640 / (2 * tan(0.4)), 6) + 0.0 AS fx FROM q")
def camera_list_file(spark: SparkSession, sf: str) -> DataFrame:
    """A scene's camera list as JSON lines, read back."""
    path = os.path.join(scratch(spark), "cameras")
    lens = _turned(spark, sf).select(F.col("s_suppkey").alias("camera_id"), F.col("s_name").alias("name"), F.lit(640).alias("width"), F.lit(480).alias("height"), "rotation", "translation", F.lit(0.8).alias("fov_x"), F.lit(0.6).alias("fov_y"))
    scenes.camera_records(lens).write.json(path)
    rows = spark.read.json(path)
    return rows.select("id", "img_name", *(r(F.col("position")[i]).alias(n) for i, n in enumerate(("px", "py", "pz"))), r(F.col("rotation")[0][1]).alias("r01"), r("fx").alias("fx"))


@query("SELECT event_type AS scene, (2 * count(*))::BIGINT AS n, round(avg(value), 6) + 0.0 AS value FROM events GROUP BY event_type")
def results_file(spark: SparkSession, sf: str) -> DataFrame:
    """Result rows appended in two runs, and their means."""
    path = os.path.join(scratch(spark), "results")
    for run in range(2):
        scenes.append_results(table(spark, sf, "events").select(F.col("event_type").alias("scene"), "value", F.lit(run).alias("run")), path)
    return spark.read.json(path).groupBy("scene").agg(F.count("*").alias("n"), r(F.avg("value")).alias("value"))


@query("SELECT s_suppkey, s_acctbal FROM supplier")
def newest_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Two iterations of a table; the newest comes back."""
    folder, rows = scratch(spark), table(spark, sf, "supplier")
    scenes.checkpoint(rows.select("s_suppkey", F.lit(0.0).alias("s_acctbal")), folder, 9)
    scenes.checkpoint(rows.select("s_suppkey", "s_acctbal"), folder, 30)
    return scenes.restore(spark, folder)


@query("SELECT kind, vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) + 0.0 AS total FROM embeddings, (SELECT unnest(['tensor', 'npz']) AS kind)")
def array_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as arrays in both containers, told apart by their first bytes. One array is one value of a file, so it passes the driver, as far as codecs.CONTAINER_ROWS."""
    rows = table(spark, sf, "embeddings").limit(codecs.CONTAINER_ROWS + 1).toPandas()
    if len(rows) > codecs.CONTAINER_ROWS:
        raise ValueError("too many rows for a container")
    arrays = {"ids": rows["vec_id"].to_numpy(), "vectors": np.stack(rows["embedding"].to_numpy()).astype("<f4")}
    folder, out = scratch(spark), None
    for dump in (container.dump, container.dump_npz):
        path = os.path.join(folder, dump.__name__)
        with open(path, "wb") as f:
            f.write(dump(arrays))
        with open(path, "rb") as f:
            back = container.load(f.read())
        some = spark.createDataFrame(list(zip(back["ids"].tolist(), back["vectors"].astype(float).sum(axis=1).tolist(), strict=True)), "vec_id bigint, total double")
        some = some.select(F.lit(container.kind_of(path)).alias("kind"), "vec_id", r("total").alias("total"))
        out = some if out is None else out.unionByName(some)
    return out


def _decoded(c: str, i: int | None, bits: int) -> str:
    x = c if i is None else f"{c}[{i + 1}]"
    step = f"CASE WHEN {c}_high > {c}_low THEN ({c}_high - {c}_low) / {(1 << bits) - 1} ELSE 1 END"
    return f"round(least(greatest(round_even(({x} - {c}_low) / ({step}), 0), 0), {(1 << bits) - 1}) * ({step}) + {c}_low, 5) + 0.0"


_STORED = {"x": ("xyz", 0), "dc2": ("sh_dc", 2), "s1": ("scales", 1), "q3": ("rotations", 3), "opacity": ("opacity", None)}
_BITS = codecs.Options().bits()


@query(
    f"WITH {P}, s AS (SELECT min(opacity) AS opacity_low, max(opacity) AS opacity_high, " + ", ".join(f"min(list_min({c})) AS {c}_low, max(list_max({c})) AS {c}_high" for c in ("xyz", "sh_dc", "scales", "rotations")) + " FROM p) SELECT row_number() OVER (ORDER BY splat_id) - 1 AS splat_id, "
    + ", ".join(f"{_decoded(c, i, _BITS[c])} AS {name}" for name, (c, i) in _STORED.items())
    + " FROM p, s"
)
def coded_file(spark: SparkSession, sf: str) -> DataFrame:
    """A primitive file to a coded file and back to a primitive file, of doubles: rounded to floats some would fall to the other side of a fifth place."""
    folder = scratch(spark)
    raw, coded, back = (os.path.join(folder, n) for n in ("raw.ply", "coded.ts", "back.ply"))
    ply.write_primitives(prims(spark, sf), raw)
    codecs.compress_file(spark, raw, coded)
    codecs.decompress_file(spark, coded, back, "double")
    rows = ply.read_primitives(spark, back)
    return rows.select("splat_id", *((F.round(F.col(c) if i is None else F.get(c, F.lit(i)), 5) + F.lit(0.0)).alias(name) for name, (c, i) in _STORED.items()))


@query(_POSE + " SELECT s_suppkey, round(-s, 6) + 0.0 AS v01, round(tx, 6) + 0.0 AS v03, round(1 / tan(0.4), 6) + 0.0 AS p00, round(100.0 / (100.0 - 0.01), 6) + 0.0 AS p22, round((c * 1 - s * 2 + tx) / (3 + 2 + 1e-7), 6) + 0.0 AS seen_x, round((s * 1 + c * 2 + ty) / (3 + 2 + 1e-7), 6) + 0.0 AS seen_y FROM q")
def camera_matrices(spark: SparkSession, sf: str) -> DataFrame:
    """World-to-view and projection matrices of cameras, and a point through a matrix."""
    view = geometry.world_to_view(F.col("rotation"), F.col("translation"))
    lens = geometry.projection(0.01, 100.0, F.lit(0.8), F.lit(0.6))
    rows = _turned(spark, sf).select("s_suppkey", view.alias("v"), lens.alias("p"))
    pinhole = F.concat(F.slice("v", 1, 3), F.array(F.col("v")[2]))  # w is the depth
    seen = geometry.project_point(pinhole, F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    return rows.select("s_suppkey", r(F.col("v")[0][1]).alias("v01"), r(F.col("v")[0][3]).alias("v03"), r(F.col("p")[0][0]).alias("p00"), r(F.col("p")[2][2]).alias("p22"), r(seen[0]).alias("seen_x"), r(seen[1]).alias("seen_y"))


@query(f"WITH {P}, u AS (SELECT splat_id, list_transform(rotations, lambda x: x / sqrt(list_sum(list_transform(rotations, lambda y: y * y))) * CASE WHEN rotations[1] < 0 THEN -1 ELSE 1 END) AS q FROM p) SELECT splat_id, " + ", ".join(f"round(q[{i + 1}], 5) + 0.0 AS q{i}" for i in range(4)) + " FROM u")
def quaternions_back(spark: SparkSession, sf: str) -> DataFrame:
    """Quaternions to rotation matrices and back, up to sign."""
    q = geometry.quaternion(geometry.rotation_matrix(F.col("rotations")))
    rows = prims(spark, sf).select("splat_id", q.alias("q"))
    return rows.select("splat_id", *((F.round(F.col("q")[i], 5) + F.lit(0.0)).alias(f"q{i}") for i in range(4)))


@query("SELECT p_partkey, round_even(p_size * 50 / 4.0, 0)::INT AS w4, floor(CASE WHEN p_size * 50 > 1600 THEN p_size * 50 / (p_size * 50 / 1600.0) ELSE p_size * 50 END)::INT AS w1600, floor((p_size / 100.0 * 0.25 + 0.75) * 255)::INT AS white, floor((p_size / 100.0 * 0.25) * 255)::INT AS black FROM part")
def image_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes after resizing, and colours over a background."""
    width, height = F.col("p_size") * 50, F.lit(100)
    value = F.col("p_size") / 100.0
    return table(spark, sf, "part").select("p_partkey", scalars.resized(width, height, 4)["width"].alias("w4"), scalars.resized(width, height)["width"].alias("w1600"), scalars.composite(value, F.lit(0.25), True).alias("white"), scalars.composite(value, F.lit(0.25), False).alias("black"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice >= 0 AND o_totalprice < 200000 AND o_custkey < 1000 AND o_orderkey > 0 AND o_orderpriority NOT LIKE '1%'")
def training_observations(spark: SparkSession, sf: str) -> DataFrame:
    """Observations of training images that fall inside their image."""
    seen = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("x"), F.col("o_custkey").alias("y"), F.lit(200000).alias("width"), F.lit(1000).alias("height"), F.col("o_orderkey").alias("depth"), F.col("o_orderpriority").like("1%").alias("is_test"))
    return cameras.for_training(cameras.in_view(seen)).select("o_orderkey", "o_custkey")


@query("SELECT s_suppkey AS id, 7::INT AS bits, 'b' AS name FROM supplier WHERE s_suppkey = 1")
def merged_settings(spark: SparkSession, sf: str) -> DataFrame:
    """Stored options, overridden by those given."""
    stored = scenes.merged_options(json.dumps({"bits": 3, "name": "b"}), {"bits": 7, "name": None})
    return table(spark, sf, "supplier").where("s_suppkey = 1").select(F.col("s_suppkey").alias("id"), F.lit(stored["bits"]).alias("bits"), F.lit(stored["name"]).alias("name"))
