"""Sparse reconstructions: cameras, images and points, binary and text."""

from __future__ import annotations

import os
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.cameras import MODELS

CAMERAS = "camera_id int, model_id int, model string, width bigint, height bigint, params array<double>"
IMAGES = "image_id int, rotation array<double>, translation array<double>, camera_id int, name string, observations array<struct<x:double,y:double,point3d_id:bigint>>"
POINTS = "point_id bigint, xyz array<double>, rgb array<int>, error double, track array<struct<image_id:int,point2d_index:int>>"
BY_ID = {i: (name, n) for i, name, n in MODELS}
BY_NAME = {name: (i, n) for i, name, n in MODELS}


class Bytes:
    """Little-endian values one after another."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str) -> tuple:
        out = struct.unpack_from("<" + form, self.data, self.at)
        self.at += struct.calcsize("<" + form)
        return out

    def records(self, kind: np.dtype, n: int) -> np.ndarray:
        out = np.frombuffer(self.data, dtype=kind, count=n, offset=self.at)
        self.at += n * kind.itemsize
        return out

    def name(self) -> str:
        end = self.data.index(b"\0", self.at)
        out = self.data[self.at : end].decode()
        self.at = end + 1
        return out


SEEN = np.dtype([("x", "<f8"), ("y", "<f8"), ("point3d_id", "<i8")])
TRACK = np.dtype([("image_id", "<i4"), ("point2d_index", "<i4")])


def _dicts(a: np.ndarray) -> list[dict]:
    return [dict(zip(a.dtype.names, row, strict=True)) for row in a.tolist()]


def cameras_bin(data: bytes) -> Iterator[tuple]:
    b = Bytes(data)
    for _ in range(b.take("Q")[0]):
        camera, model, width, height = b.take("iiQQ")
        name, n = BY_ID[model]
        yield camera, model, name, width, height, list(b.take(f"{n}d"))


def images_bin(data: bytes) -> Iterator[tuple]:
    b = Bytes(data)
    for _ in range(b.take("Q")[0]):
        image, *pose, camera = b.take("i7di")
        name = b.name()
        yield image, pose[:4], pose[4:], camera, name, _dicts(b.records(SEEN, b.take("Q")[0]))


def points_bin(data: bytes) -> Iterator[tuple]:
    b = Bytes(data)
    for _ in range(b.take("Q")[0]):
        point, x, y, z, red, green, blue, error = b.take("Q3d3Bd")
        yield point, [x, y, z], [red, green, blue], error, _dicts(b.records(TRACK, b.take("Q")[0]))


def _lines(data: bytes, blank: bool = False) -> list[list[str]]:
    """Words of lines that are no comment; blank ones only if they mean something."""
    return [line.split() for line in data.decode().splitlines() if not line.startswith("#") and (blank or line.strip())]


def cameras_txt(data: bytes) -> Iterator[tuple]:
    for camera, model, width, height, *params in _lines(data):
        yield int(camera), BY_NAME[model][0], model, int(width), int(height), [float(p) for p in params]


def images_txt(data: bytes) -> Iterator[tuple]:
    lines = _lines(data, blank=True)
    for head, seen in zip(lines[::2], lines[1::2] + [[]] * (len(lines) % 2), strict=False):
        if not head:
            continue
        pose = [float(v) for v in head[1:8]]
        yield int(head[0]), pose[:4], pose[4:], int(head[8]), head[9], [{"x": float(x), "y": float(y), "point3d_id": int(p)} for x, y, p in zip(seen[::3], seen[1::3], seen[2::3], strict=True)]


def points_txt(data: bytes) -> Iterator[tuple]:
    for w in _lines(data):
        yield int(w[0]), [float(v) for v in w[1:4]], [int(v) for v in w[4:7]], float(w[7]), [{"image_id": int(i), "point2d_index": int(k)} for i, k in zip(w[8::2], w[9::2], strict=True)]


PARSERS: dict[str, tuple[str, Callable, Callable]] = {"cameras": (CAMERAS, cameras_bin, cameras_txt), "images": (IMAGES, images_bin, images_txt), "points3D": (POINTS, points_bin, points_txt)}


def read_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """cameras, images or points3D from a .bin or .txt file (or a glob of them).

    Records have no fixed width, so a file is parsed whole, in one task, a batch at a
    time; several files are parsed side by side. Spark opens the path."""
    ddl, binary, text = PARSERS[kind]
    parse = binary if path.endswith(".bin") else text
    struct_type = T._parse_datatype_string(ddl)
    arrow = to_arrow_schema(struct_type)

    def rows(batches):
        def batch(part):
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*part, strict=True), arrow, strict=True)], schema=arrow)

        for files in batches:
            for content in files.column(0):
                part = []
                for row in parse(content.as_py()):
                    part.append(row)
                    if len(part) == 4096:
                        yield batch(part)
                        part = []
                if part:
                    yield batch(part)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, struct_type)


def point_lines(spark: SparkSession, path: str) -> DataFrame:
    """points3D from text, by lines: a large file splits over tasks."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    w = F.split(F.trim("value"), r"\s+")
    track = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 10) / 2).cast("int")), lambda k: F.struct(F.get(F.col("w"), 8 + 2 * k).cast("int").alias("image_id"), F.get(F.col("w"), 9 + 2 * k).cast("int").alias("point2d_index")))
    return lines.select(w.alias("w")).select(
        F.get("w", F.lit(0)).cast("bigint").alias("point_id"), F.slice("w", 2, 3).cast("array<double>").alias("xyz"), F.slice("w", 5, 3).cast("array<int>").alias("rgb"), F.get("w", F.lit(7)).cast("double").alias("error"), F.when(F.size("w") >= 10, track).otherwise(F.array().cast("array<struct<image_id:int,point2d_index:int>>")).alias("track")
    )


def model_format(folder: str) -> str | None:
    """.bin or .txt, by which three files a folder has; binary first."""
    return next((ext for ext in (".bin", ".txt") if all(os.path.isfile(os.path.join(folder, k + ext)) for k in PARSERS)), None)


def read_model(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    ext = model_format(folder)
    if ext is None:
        raise FileNotFoundError(f"no reconstruction in {folder}")
    return {k: read_table(spark, os.path.join(folder, k + ext), k) for k in PARSERS}


def _record(kind: str, r, text: bool) -> bytes:
    words = lambda *x: (" ".join(map(str, x)) + "\n").encode()
    if kind == "cameras":
        return words(r.camera_id, r.model, r.width, r.height, *r.params) if text else struct.pack(f"<iiQQ{len(r.params)}d", r.camera_id, r.model_id, r.width, r.height, *r.params)
    if kind == "images":
        if text:
            return words(r.image_id, *r.rotation, *r.translation, r.camera_id, r.name) + words(*(v for o in r.observations for v in (o.x, o.y, o.point3d_id)))
        seen = b"".join(struct.pack("<ddq", o.x, o.y, o.point3d_id) for o in r.observations)
        return struct.pack("<i7di", r.image_id, *r.rotation, *r.translation, r.camera_id) + r.name.encode() + b"\0" + struct.pack("<Q", len(r.observations)) + seen
    if text:
        return words(r.point_id, *r.xyz, *r.rgb, r.error, *(v for t in r.track for v in (t.image_id, t.point2d_index)))
    return struct.pack("<Q3d3BdQ", r.point_id, *r.xyz, *r.rgb, r.error, len(r.track)) + b"".join(struct.pack("<ii", t.image_id, t.point2d_index) for t in r.track)


def write_table(df: DataFrame, path: str, kind: str) -> int:
    """The inverse of read_table, in id order. Rows stream through the driver, a partition at a time."""
    text, n = path.endswith(".txt"), 0
    with open(path, "wb") as f:
        f.write(f"# {kind}\n".encode() if text else struct.pack("<Q", 0))
        for r in df.orderBy({"cameras": "camera_id", "images": "image_id", "points3D": "point_id"}[kind]).toLocalIterator():
            f.write(_record(kind, r, text))
            n += 1
        if not text:
            f.seek(0)
            f.write(struct.pack("<Q", n))
    return n


def write_model(tables: dict[str, DataFrame], folder: str, ext: str = ".bin") -> None:
    for kind, df in tables.items():
        write_table(df, os.path.join(folder, kind + ext), kind)


def read_dense(data: bytes) -> np.ndarray:
    """A dense map: WIDTH&HEIGHT&CHANNELS& and column-major floats; one channel loses its axis."""
    at = 0
    sizes = []
    for _ in range(3):
        end = data.index(b"&", at)
        sizes.append(int(data[at:end]))
        at = end + 1
    return np.frombuffer(data, dtype="<f4", offset=at).reshape(sizes, order="F").transpose(1, 0, 2).squeeze()
