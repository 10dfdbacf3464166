"""Fixed-width PLY files as tables: read by byte range, written by byte range."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.attributes import pack_columns, unpack_columns
from ..operators.ordering import numbered

NUMPY = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
ORDERS = {"binary_little_endian": "<", "binary_big_endian": ">", "ascii": ""}
SPARK = {"i1": T.ByteType(), "u1": T.ShortType(), "i2": T.ShortType(), "u2": T.IntegerType(), "i4": T.IntegerType(), "u4": T.LongType(), "f4": T.FloatType(), "f8": T.DoubleType()}
# The columns of a primitive file, in order; all are floats, unless doubles are asked for.
PRIMITIVE_COLUMNS = ["x", "y", "z", "nx", "ny", "nz", *(f"f_dc_{i}" for i in range(3)), *(f"f_rest_{i}" for i in range(45)), "opacity", *(f"scale_{i}" for i in range(3)), *(f"rot_{i}" for i in range(4))]
POINT_COLUMNS = [*((c, "float") for c in ("x", "y", "z", "nx", "ny", "nz")), *((c, "uchar") for c in ("red", "green", "blue"))]


@dataclass
class Header:
    """Of the vertex element: its rows, their columns and types, the byte they begin at, and the format."""

    count: int
    columns: list[tuple[str, str]]
    start: int
    order: str

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([(name, (self.order or "<") + kind) for name, kind in self.columns])


def read_header(path: str) -> Header:
    """The header of a PLY file whose first element is vertex. ValueError if it has none."""
    count, order, columns, element = -1, None, [], None
    with open(path, "rb") as f:
        if f.readline().strip() != b"ply":
            raise ValueError(f"{path} is not a PLY file")
        for line in iter(f.readline, b""):
            word = line.decode("ascii", "replace").split()
            if not word or word[0] == "comment":
                continue
            if word[0] == "end_header":
                break
            if word[0] == "format":
                order = ORDERS[word[1]]
            elif word[0] == "element":
                element = word[1]
                if element == "vertex":
                    count = int(word[2])
            elif word[0] == "property" and element == "vertex":
                if word[1] == "list":
                    raise ValueError("vertex lists have no fixed width")
                columns.append((word[2], NUMPY[word[1]]))
        start = f.tell()
    if count < 0 or order is None:
        raise ValueError(f"{path} has no vertex element")
    return Header(count, columns, start, order)


def vertex_count(path: str) -> int:
    """Rows of a PLY file, from its header alone."""
    return read_header(path).count


class Span(InputPartition):
    def __init__(self, first: int, rows: int):
        self.first, self.rows = first, rows


class PlyReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows, self.header = path, rows, read_header(path)

    def partitions(self) -> list[Span]:
        n = self.header.count
        if not self.header.order:
            return [Span(0, n)]
        return [Span(at, min(self.rows, n - at)) for at in range(0, n, self.rows)] or [Span(0, 0)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        head, kind = self.header, self.header.dtype
        with open(self.path, "rb") as f:
            if not head.order:
                f.seek(head.start)
                rows = np.array([tuple(f.readline().split()[: len(kind.names)]) for _ in range(span.rows)], dtype=[(n, "f8") for n in kind.names]).astype(kind)
                parts = [(0, rows)]
            else:
                f.seek(head.start + span.first * kind.itemsize)
                parts = ((span.first + at, np.frombuffer(f.read(min(65536, span.rows - at) * kind.itemsize), dtype=kind)) for at in range(0, span.rows, 65536))
            for first, rows in parts:
                native = [rows[name].astype(rows[name].dtype.newbyteorder("=")) for name in kind.names]
                wide = [x.astype({"u1": "i2", "u2": "i4", "u4": "i8"}.get(k, x.dtype)) for x, (_, k) in zip(native, head.columns, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(rows), dtype=np.int64)), *map(pa.array, wide)], names=["row", *kind.names])


class PlySource(DataSource):
    """spark.read.format("ply").load(path): row (place in the file), and a column for each
    property. A file is read in ranges of rowsPerPartition rows; its path must be one
    that every executor can open (a shared mount)."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> T.StructType:
        head = read_header(self.options["path"])
        return T.StructType([T.StructField("row", T.LongType()), *(T.StructField(n, SPARK[k]) for n, k in head.columns)])

    def reader(self, schema: T.StructType) -> PlyReader:
        return PlyReader(self.options["path"], int(self.options.get("rowsPerPartition", "1000000")))


def read_ply(spark: SparkSession, path: str, rows_per_partition: int = 1_000_000) -> DataFrame:
    spark.dataSource.register(PlySource)
    return spark.read.format("ply").option("rowsPerPartition", str(rows_per_partition)).load(path)


def read_primitives(spark: SparkSession, path: str) -> DataFrame:
    """A primitive file as attribute arrays: splat_id (place in the file), xyz, sh_dc,
    opacity, scales, rotations, sh_rest (all of red, then green, then blue)."""
    rows = read_ply(spark, path).withColumnRenamed("row", "splat_id").withColumnsRenamed({"x": "p_0", "y": "p_1", "z": "p_2"}).drop("nx", "ny", "nz").withColumn("opacity", F.col("opacity").cast("double"))
    return pack_columns(rows, {"p_": "xyz", "f_dc_": "sh_dc", "f_rest_": "sh_rest", "scale_": "scales", "rot_": "rotations"})


def write_ply(df: DataFrame, path: str, columns: list[tuple[str, str]], by: list[str]) -> int:
    """Write columns of df in the order of `by`; returns the row count.

    The driver writes the header; each task then writes its rows at their own place
    in the file (a shared mount), so no task holds it all, and a task that is tried
    again writes the same bytes to the same place."""
    rows = numbered(df, by)
    n = df.count()
    head = "".join(["ply\nformat binary_little_endian 1.0\n", f"element vertex {n}\n", *(f"property {kind} {name}\n" for name, kind in columns), "end_header\n"]).encode()
    kind = np.dtype([(name, "<" + NUMPY[k]) for name, k in columns])
    with open(path, "wb") as f:
        f.write(head)
        f.truncate(len(head) + n * kind.itemsize)
    names = [c for c, _ in columns]

    def put(batches):
        written = 0
        with open(path, "r+b") as f:
            for batch in batches:
                at = batch.column(0).to_numpy(zero_copy_only=False)
                out = np.zeros(len(at), dtype=kind)
                for i, name in enumerate(names):
                    out[name] = batch.column(i + 1).to_numpy(zero_copy_only=False)
                cuts = np.flatnonzero(np.diff(at) != 1) + 1  # runs of neighbours
                for ats, part in zip(np.split(at, cuts), np.split(out, cuts), strict=True):
                    if len(ats):
                        f.seek(len(head) + int(ats[0]) * kind.itemsize)
                        f.write(part.tobytes())
                written += len(at)
        yield pa.RecordBatch.from_arrays([pa.array([written], type=pa.int64())], names=["n"])

    done = rows.select("ordinal", *names).mapInArrow(put, "n bigint").agg(F.sum("n")).first()[0]
    return int(done or 0)


def write_primitives(df: DataFrame, path: str, kind: str = "float") -> int:
    """The inverse of read_primitives, with zero normals; as kind "double" no digit is lost."""
    flat = unpack_columns(df, {"xyz": ("p_", 3), "sh_dc": ("f_dc_", 3), "sh_rest": ("f_rest_", 45), "scales": ("scale_", 3), "rotations": ("rot_", 4)})
    flat = flat.withColumnsRenamed({"p_0": "x", "p_1": "y", "p_2": "z"}).withColumns({c: F.lit(0.0) for c in ("nx", "ny", "nz")})
    return write_ply(flat, path, [(c, kind) for c in PRIMITIVE_COLUMNS], ["splat_id"])


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """A point file: point_id, xyz, rgb in 0..1."""
    rows = read_ply(spark, path)
    return rows.select(F.col("row").alias("point_id"), F.array("x", "y", "z").cast("array<double>").alias("xyz"), F.array(*(F.col(c) / 255.0 for c in ("red", "green", "blue"))).alias("rgb"))


def write_points(df: DataFrame, path: str) -> int:
    """point_id, xyz, rgb in 0..1 as a point file with zero normals and byte colours."""
    flat = df.select("point_id", *(F.get("xyz", F.lit(i)).alias(c) for i, c in enumerate("xyz")), *(F.lit(0.0).alias(c) for c in ("nx", "ny", "nz")), *(F.floor(F.get("rgb", F.lit(i)) * 255).cast("int").alias(c) for i, c in enumerate(("red", "green", "blue"))))
    return write_ply(flat, path, POINT_COLUMNS, ["point_id"])


def newest_model(folder: str) -> str | None:
    """The primitive file of a model folder's highest iteration, a .ply path as it is; null if none."""
    if folder.endswith(".ply"):
        return folder if os.path.exists(folder) else None
    top = os.path.join(folder, "point_cloud")
    found = [int(d.rsplit("_", 1)[1]) for d in os.listdir(top) if d.startswith("iteration_") and d.rsplit("_", 1)[1].isdigit()] if os.path.isdir(top) else []
    return os.path.join(top, f"iteration_{max(found)}", "point_cloud.ply") if found else None
