"""Files: written and read back."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from radiantlake.operators import attributes
from radiantlake.operators.densify import random_cloud
from radiantlake.sources import colmap, container, ply, scenes


def test_primitive_file(spark, small, tmp_path):
    rows = attributes.from_embeddings(spark, small)
    path = str(tmp_path / "a.ply")
    assert ply.write_primitives(rows, path) == rows.count() == ply.vertex_count(path)
    want = {i: r for i, r in enumerate(rows.orderBy("splat_id").collect())}
    back = ply.read_ply(spark, path, rows_per_partition=100)
    assert back.rdd.getNumPartitions() > 1 and len(back.columns) == 63
    for r in ply.read_primitives(spark, path).collect():
        w = want[r.splat_id]
        for c in ("xyz", "sh_dc", "scales", "rotations", "sh_rest"):
            assert np.allclose(r[c], w[c], atol=1e-6)
        assert abs(r.opacity - w.opacity) < 1e-6


def test_point_file_and_ascii(spark, tmp_path):
    cloud = random_cloud(spark, 50)
    path = str(tmp_path / "p.ply")
    ply.write_points(cloud, path)
    want = {r.point_id: r for r in cloud.collect()}
    for r in ply.read_points(spark, path).collect():
        assert np.allclose(r.xyz, want[r.point_id].xyz, atol=1e-5) and np.allclose(r.rgb, want[r.point_id].rgb, atol=1 / 255)
    text = tmp_path / "t.ply"
    text.write_text("ply\nformat ascii 1.0\ncomment x\nelement vertex 2\nproperty float x\nproperty uchar red\nend_header\n1.5 7\n2.5 255\n")
    assert sorted((r.x, r.red) for r in ply.read_ply(spark, str(text)).collect()) == [(1.5, 7), (2.5, 255)]
    big = tmp_path / "b.ply"
    big.write_bytes(b"ply\nformat binary_big_endian 1.0\nelement vertex 1\nproperty int a\nend_header\n" + struct.pack(">i", 258))
    assert ply.read_ply(spark, str(big)).first().a == 258
    empty = tmp_path / "e.ply"
    empty.write_text("ply\nformat ascii 1.0\nelement face 0\nend_header\n")
    with pytest.raises(ValueError):
        ply.vertex_count(str(empty))


def test_newest_model(tmp_path):
    for n in (7000, 30000):
        d = tmp_path / "point_cloud" / f"iteration_{n}"
        d.mkdir(parents=True)
    assert ply.newest_model(str(tmp_path)).endswith("iteration_30000/point_cloud.ply")
    assert ply.newest_model(str(tmp_path / "none")) is None


@pytest.mark.parametrize("ext", [".bin", ".txt"])
def test_reconstruction(spark, tmp_path, ext):
    cams = spark.createDataFrame([(1, 1, "PINHOLE", 640, 480, [500.0, 501.0, 320.0, 240.0]), (2, 0, "SIMPLE_PINHOLE", 10, 20, [1.0, 2.0, 3.0])], colmap.CAMERAS)
    shots = spark.createDataFrame([(3, [1.0, 0.0, 0.0, 0.0], [0.5, 1.5, 2.5], 1, "b.png", [(1.0, 2.0, -1), (3.0, 4.0, 9)]), (4, [0.5] * 4, [0.0] * 3, 2, "a.png", [])], colmap.IMAGES)
    points = spark.createDataFrame([(9, [1.0, 2.0, 3.0], [1, 2, 255], 0.25, [(3, 1), (4, 0)]), (10, [0.0] * 3, [0, 0, 0], 0.0, [])], colmap.POINTS)
    colmap.write_model({"cameras": cams, "images": shots, "points3D": points}, str(tmp_path), ext)
    assert colmap.model_format(str(tmp_path)) == ext
    back = colmap.read_model(spark, str(tmp_path))
    for kind, df in (("cameras", cams), ("images", shots), ("points3D", points)):
        assert sorted(map(repr, back[kind].collect())) == sorted(map(repr, df.collect()))
    if ext == ".txt":
        assert sorted(map(repr, colmap.point_lines(spark, str(tmp_path / "points3D.txt")).collect())) == sorted(map(repr, points.collect()))


def test_dense_map():
    a = np.arange(24, dtype="<f4").reshape(4, 3, 2)  # width, height, channels
    data = b"4&3&2&" + a.tobytes(order="F")
    assert np.array_equal(colmap.read_dense(data), a.transpose(1, 0, 2))
    assert colmap.read_dense(b"4&3&1&" + a[..., :1].tobytes(order="F")).shape == (3, 4)


def test_scene_json(spark, tmp_path):
    m = [[1.0, 0.0, 0.0, 1.0], [0.0, 1.0, 0.0, 2.0], [0.0, 0.0, 1.0, 3.0], [0.0, 0.0, 0.0, 1.0]]
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"camera_angle_x": 0.7, "frames": [{"file_path": "./train/r_0", "transform_matrix": m}]}, indent=1))
    r = scenes.read_transforms(spark, str(path)).first()
    assert (r.name, r.fov_x) == ("r_0", 0.7) and np.allclose(r.rotation, np.diag([1, -1, -1])) and np.allclose(r.translation, [-1, 2, 3])
    params = spark.createDataFrame([("a", 1.5, 0.25), ("b", 0.0, 0.0)], "name string, scale double, offset double")
    scenes.write_depth_params(params, str(tmp_path / "d.json"))
    assert sorted(scenes.read_depth_params(spark, str(tmp_path / "d.json")).collect()) == sorted(params.collect())
    exposure = spark.createDataFrame([("a", [row[:4] for row in m[:3]])], "name string, matrix array<array<double>>")
    scenes.write_exposures(exposure, str(tmp_path / "e.json"))
    assert scenes.read_exposures(spark, str(tmp_path / "e.json")).first().matrix == m[:3]
    assert scenes.merged_options('{"a": 1, "b": 2}', {"b": 3, "a": None}) == {"a": 1, "b": 3}


def test_snapshots_and_results(spark, tmp_path):
    df = spark.range(3)
    scenes.checkpoint(df, str(tmp_path / "s"), 10)
    scenes.checkpoint(df.limit(1), str(tmp_path / "s"), 20)
    assert scenes.restore(spark, str(tmp_path / "s")).count() == 1
    assert scenes.restore(spark, str(tmp_path / "s"), 10).count() == 3
    for k in range(2):
        scenes.append_results(df.select(F.lit(k).alias("run"), "id"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 6


def test_containers():
    arrays = {"a": np.arange(6, dtype=np.float32).reshape(2, 3), "b": np.array(7, dtype=np.int32), "c": np.zeros(0, dtype=np.uint8), "h": np.ones(3, dtype=np.float16)}
    for data in (container.dump(arrays), container.dump_npz(arrays)):
        back = container.load(data)
        assert back.keys() == arrays.keys()
        assert all(np.array_equal(back[k], v) and back[k].dtype == v.dtype for k, v in arrays.items())
    assert container.dump(arrays)[:4] == container.MARK
