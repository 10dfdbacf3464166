"""Whole codecs of primitive tables, as plans over DataFrames.

A coded table stays a table: codes, and the few numbers that decode them, in Parquet
(zstd). Containers are for tables that fit the driver."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attributes, codebook, deltas, factor, merging, ordering, rotation_codec, uniform
from ..sources import container, ply

#: Rows that a container may take through the driver.
CONTAINER_ROWS = 5_000_000
#: Rows that leave the driver as one; codes that are packed at once, whole bytes at any width.
BLOCK_ROWS, STRETCH = 16_384, 1 << 20


@dataclass(frozen=True)
class Options:
    """Bits of each attribute, pruning, and how rows are ordered."""

    sh_bits: int = 3
    pos_bits: int = 16
    dc_bits: int = 16
    scale_bits: int = 16
    rot_bits: int = 8
    opacity_bits: int = 8
    prune_ratio: float = 0.0
    sh_degree: int = 3
    seed: int = 0
    ordered: bool = False

    def aggressive(self) -> Options:
        """Smaller, at more loss: options that still have their defaults are lowered."""
        low = {"prune_ratio": 0.5, "sh_degree": 2, "sh_bits": 2, "pos_bits": 12, "dc_bits": 8, "scale_bits": 8, "opacity_bits": 6}
        plain = Options()
        return replace(self, **{k: v for k, v in low.items() if getattr(self, k) == getattr(plain, k)})

    @property
    def rest_width(self) -> int:
        return 3 * ((self.sh_degree + 1) ** 2 - 1)

    def bits(self) -> dict[str, int]:
        return {"xyz": self.pos_bits, "sh_dc": self.dc_bits, "scales": self.scale_bits, "rotations": self.rot_bits, "opacity": self.opacity_bits}


SCALARS = ["xyz", "sh_dc", "scales", "rotations", "opacity"]
WIDTHS = {**attributes.WIDTHS, "opacity": 1}


def _rotated(rows: DataFrame, column: str, d: int, options: Options) -> DataFrame:
    """Rotation codes of a column, as sh_codes and sh_norm."""
    out = rotation_codec.encode_bulk(rows, column, d, options.sh_bits, options.seed)
    return out.withColumnRenamed("codes", "sh_codes").withColumn("sh_norm", F.col("norm").cast("float")).drop("norm")


def _unrotated(rows: DataFrame, column: str, d: int, options: Options) -> DataFrame:
    """The inverse, as a column."""
    named = rows.withColumnRenamed("sh_codes", "codes").withColumn("norm", F.col("sh_norm").cast("double")).drop("sh_norm")
    return rotation_codec.decode_bulk(named, d, options.sh_bits, options.seed, column).drop("codes", "norm")


def _coded(rows: DataFrame, options: Options) -> DataFrame:
    """Uniform codes of the scalar attributes, rotation codes of sh_rest."""
    out = uniform.quantize(rows.withColumn("opacity", F.array("opacity")), options.bits())
    if options.rest_width:
        out = _rotated(out, "sh_rest", options.rest_width, options)
    else:
        out = out.withColumn("sh_codes", F.array().cast("array<int>")).withColumn("sh_norm", F.lit(0.0).cast("float"))
    return out.drop("sh_rest")


def _decoded(coded: DataFrame, options: Options) -> DataFrame:
    rows = uniform.dequantize(coded, SCALARS).withColumn("opacity", F.get("opacity", F.lit(0)))
    if not options.rest_width:
        return rows.withColumn("sh_rest", F.array_repeat(F.lit(0.0), 45)).drop("sh_codes", "sh_norm")
    rows = _unrotated(rows, "sh_rest", options.rest_width, options)
    return rows.withColumn("sh_rest", attributes.padded(F.col("sh_rest")))


def compress(df: DataFrame, options: Options = Options()) -> DataFrame:
    """Prune, truncate, order (by Morton code, if asked), quantize."""
    rows = ordering.prune(df, options.prune_ratio).withColumn("sh_rest", attributes.truncated(F.col("sh_rest"), options.sh_degree))
    if options.ordered:
        rows = ordering.morton_sorted(rows)
    return _coded(rows, options)


def decompress(coded: DataFrame, options: Options = Options()) -> DataFrame:
    """The inverse, with sh_rest padded to 45; the order stays as coded."""
    return _decoded(coded, options).drop("morton")


def compress_voxels(df: DataFrame, options: Options = Options(sh_bits=2, sh_degree=2, dc_bits=8, scale_bits=8), resolution: int = 512, threshold: int = 3, offset_bits: int = 4) -> DataFrame:
    """Prune, merge crowded voxels, truncate, order by voxel, code positions as cell and offset."""
    rows = ordering.voxel_keys(ordering.prune(df, options.prune_ratio), resolution)
    grid = ["box_min", "voxel_size", "gx", "gy", "gz", "voxel"]
    if threshold > 0:
        names = ["splat_id", *merging.COLUMNS]
        kept, merged = merging.voxel_merge(rows, threshold)
        box = rows.select("box_min", "voxel_size").limit(1)
        again = kept.select(names).unionByName(merged.select(names)).crossJoin(F.broadcast(box))
        cell = lambda i: F.least(F.greatest(F.floor((F.get("xyz", F.lit(i)) - F.col("box_min")[i]) / F.col("voxel_size")), F.lit(0)), F.lit(resolution - 1)).cast("bigint")
        rows = again.withColumns({"gx": cell(0), "gy": cell(1), "gz": cell(2)}).withColumn("voxel", F.col("gx") * resolution * resolution + F.col("gy") * resolution + F.col("gz"))
    rows = rows.select("splat_id", *merging.COLUMNS, *grid).withColumn("sh_rest", attributes.truncated(F.col("sh_rest"), options.sh_degree))
    rows = deltas.anchored(ordering.by_voxel(rows), resolution, offset_bits)
    bits = {k: v for k, v in options.bits().items() if k != "xyz"}
    out = uniform.quantize(rows.withColumn("opacity", F.array("opacity")), bits)
    return _rotated(out, "sh_rest", options.rest_width, options).drop("sh_rest", "xyz", "voxel")


def decompress_voxels(coded: DataFrame, options: Options = Options(sh_bits=2, sh_degree=2, dc_bits=8, scale_bits=8), offset_bits: int = 4) -> DataFrame:
    """The inverse: positions at the middle of their step."""
    rows = deltas.unanchored(coded, offset_bits)
    rows = uniform.dequantize(rows, [c for c in SCALARS if c != "xyz"]).withColumn("opacity", F.get("opacity", F.lit(0)))
    rows = _unrotated(rows, "sh_rest", options.rest_width, options)
    return rows.withColumn("sh_rest", attributes.padded(F.col("sh_rest"))).select("splat_id", *merging.COLUMNS)


def compress_factors(df: DataFrame, k: int = 12, options: Options = Options(sh_bits=2, dc_bits=10, scale_bits=8), grid: int | None = None, clusters: int = 256) -> tuple[DataFrame, dict]:
    """Principal components of sh_rest, rotation-coded; the rest uniform, or, with a grid,
    scale, rotation and opacity by codebooks local to its voxels.

    Returns the coded table and what decodes it: mean, components and, with a grid, codebooks."""
    _, mean, cov = factor.moments(df, "sh_rest", 45)
    rows, _ = factor.components(cov, k)
    coded = factor.project(df, "sh_rest", mean, rows).drop("sh_rest")
    coded = _rotated(coded, "projected", k, options).drop("projected")
    facts = {"mean": mean, "components": rows, "k": k, "options": options}
    if grid is None:
        return uniform.quantize(coded.withColumn("opacity", F.array("opacity")), options.bits()), facts
    shaped = ordering.voxel_keys(coded.withColumn("shape", attributes.shape_vector()), grid, least=ordering.LEAST_EXTENT).drop("box_min", "voxel_size", "gx", "gy", "gz")
    books = factor.voxel_codebooks(shaped, "shape", clusters)
    out = factor.code_rows(shaped, "shape", books).drop("shape", "scales", "rotations", "opacity")
    return uniform.quantize(out, {c: options.bits()[c] for c in ("xyz", "sh_dc")}), facts | {"books": books}


def decompress_factors(coded: DataFrame, facts: dict) -> DataFrame:
    """The inverse."""
    options, k = facts["options"], facts["k"]
    scalars = ["xyz", "sh_dc"] if "books" in facts else SCALARS
    rows = uniform.dequantize(coded, scalars)
    if "books" in facts:
        rows = factor.decode_rows(rows, facts["books"], "shape", 8)
        rows = rows.withColumns(attributes.split_shape(F.col("shape"))).drop("shape", "voxel", "code")
    else:
        rows = rows.withColumn("opacity", F.get("opacity", F.lit(0)))
    rows = _unrotated(rows, "projected", k, options)
    return factor.unproject(rows, "projected", facts["mean"], facts["components"], "sh_rest").drop("projected")


def stored_bits(options: Options) -> int:
    """Bits of a coded primitive before entropy coding."""
    return 3 * options.pos_bits + 3 * options.dc_bits + 3 * options.scale_bits + 4 * options.rot_bits + options.opacity_bits + options.rest_width * options.sh_bits + 16


def _pack(codes: np.ndarray, bits: int) -> np.ndarray:
    """Codes as a bit stream, the first in the high bits; a byte each for other widths."""
    flat = codes.ravel().astype(np.uint8, copy=False)
    if bits not in (2, 3, 4):
        return flat
    group = {2: 8, 3: 24, 4: 8}[bits]
    parts = []
    for at in range(0, len(flat), STRETCH):
        whole = ((flat[at : at + STRETCH, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8)) & 1).ravel()
        parts.append(np.packbits(np.concatenate([whole, np.zeros(-len(whole) % group, dtype=np.uint8)])))
    return np.concatenate(parts) if parts else flat


def _unpack(data: np.ndarray, bits: int, n: int) -> np.ndarray:
    if bits not in (2, 3, 4):
        return data[:n]
    out = np.empty(n, dtype=np.uint8)
    for at in range(0, n, STRETCH):
        m = min(STRETCH, n - at)
        planes = np.unpackbits(data[at * bits // 8 : -(-(at + m) * bits // 8)])[: m * bits].reshape(m, bits)
        out[at : at + m] = (planes << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=1)
    return out


def _kind(bits: int) -> np.dtype:
    """The integers that codes are stored as."""
    return np.dtype("<u1" if bits <= 8 else "<u2" if bits <= 16 else "<u4")


def _blocks(coded: DataFrame, options: Options) -> list:
    """A coded table in its order as rows of bytes, one for each Arrow batch: n, sh_norm,
    sh_codes and, for each scalar attribute, its codes, low and step."""
    kinds = {name: _kind(bits) for name, bits in options.bits().items()} | {"sh_codes": np.dtype("u1")}

    def flat(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            out = {"n": batch.num_rows, "sh_norm": batch.column("sh_norm").to_numpy(zero_copy_only=False).astype("<f2").tobytes()}
            for name, kind in kinds.items():
                values = batch.column(name).flatten()
                if values.null_count or batch.column(name).null_count:
                    raise ValueError(f"null in {name}")
                out[name] = values.to_numpy(zero_copy_only=False).astype(kind).tobytes()
                if name != "sh_codes":
                    out |= {f"{name}_{x}": batch.column(f"{name}_{x}")[0].as_py() for x in ("low", "step")}
            yield pa.RecordBatch.from_pylist([out])

    order = ["morton", "splat_id"] if "morton" in coded.columns else ["splat_id"]
    schema = "n bigint, sh_norm binary, " + ", ".join(f"{c} binary, {c}_low double, {c}_step double" for c in options.bits()) + ", sh_codes binary"
    names = [c for c in coded.columns if c not in ("splat_id", "morton", "scene")]
    return coded.orderBy(*order).select(*names).mapInArrow(flat, schema).collect()


def to_arrays(coded: DataFrame, options: Options) -> dict[str, np.ndarray]:
    """A coded table as named arrays: positions as wrapped deltas, 16 bit codes by byte
    planes, sh codes packed. Collects the table, as bytes; over CONTAINER_ROWS rows are refused."""
    if coded.limit(CONTAINER_ROWS + 1).count() > CONTAINER_ROWS:
        raise ValueError(f"over {CONTAINER_ROWS} rows: keep the coded table as Parquet")
    blocks = _blocks(coded, options)
    n = sum(b["n"] for b in blocks)
    whole = lambda name, kind: np.frombuffer(b"".join(b[name] for b in blocks), dtype=kind)
    out: dict[str, np.ndarray] = {"n": np.array(n, dtype=np.int32)}
    for name, bits in options.bits().items():
        kind = _kind(bits)
        flat = whole(name, kind)
        if name == "xyz" and kind.itemsize == 2:
            # unsigned differences wrap at 2^16
            flat = np.diff(flat.reshape(n, WIDTHS[name]), axis=0, prepend=np.zeros((1, WIDTHS[name]), dtype=kind)).ravel()
        out[name] = flat.view("u1").reshape(-1, kind.itemsize).T.ravel().copy() if kind.itemsize > 1 else flat
        out[f"{name}_range"] = np.array([blocks[0][f"{name}_low"], blocks[0][f"{name}_step"]] if n else [0.0, 1.0])
    out["sh_norm"] = whole("sh_norm", "<f2")
    out["sh_codes"] = _pack(whole("sh_codes", "u1"), options.sh_bits)
    out["rotation"] = np.array(codebook.rotation(max(options.rest_width, 1), options.seed), dtype=np.float32)
    return out


def from_arrays(spark, arrays: dict[str, np.ndarray], options: Options) -> DataFrame:
    """The inverse of to_arrays: a coded table whose splat_id is the stored order. Blocks
    of BLOCK_ROWS rows leave the driver as bytes and become rows in the tasks."""
    n = int(arrays["n"])
    parts, lows = {}, {}
    for name, bits in options.bits().items():
        kind, data = _kind(bits), arrays[name]
        q = (data.reshape(kind.itemsize, -1).T.copy().view(kind) if kind.itemsize > 1 else data).reshape(n, WIDTHS[name])
        if name == "xyz" and kind.itemsize == 2:
            q = np.cumsum(q, axis=0, dtype=kind)
        parts[name] = q
        lows[name] = tuple(map(float, arrays[f"{name}_range"]))
    parts["sh_codes"] = _unpack(arrays["sh_codes"], options.sh_bits, n * options.rest_width).reshape(n, options.rest_width)
    parts["sh_norm"] = arrays["sh_norm"]
    shapes = {name: (q.dtype, q.shape[1]) for name, q in parts.items() if name != "sh_norm"}

    def rows(batches):
        for batch in batches:
            for b in batch.to_pylist():
                out = {"splat_id": pa.array(np.arange(b["first"], b["first"] + b["n"], dtype=np.int64))}
                for name, (kind, width) in shapes.items():
                    values = pa.array(np.frombuffer(b[name], dtype=kind).astype(np.int32))
                    out[name] = pa.ListArray.from_arrays(pa.array(np.arange(b["n"] + 1, dtype=np.int32) * width), values)
                    if name in lows:
                        out |= {f"{name}_{x}": pa.array(np.full(b["n"], v)) for x, v in zip(("low", "step"), lows[name], strict=True)}
                out["sh_norm"] = pa.array(np.frombuffer(b["sh_norm"], dtype="<f2").astype(np.float32))
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    blocks = [(at, min(BLOCK_ROWS, n - at), *(q[at : at + BLOCK_ROWS].tobytes() for q in parts.values())) for at in range(0, n, BLOCK_ROWS)]
    stored = spark.createDataFrame(blocks, "first bigint, n bigint, " + ", ".join(f"{c} binary" for c in parts))
    schema = "splat_id bigint, " + ", ".join(f"{c} array<int>, {c}_low double, {c}_step double" for c in options.bits()) + ", sh_codes array<int>, sh_norm float"
    return stored.mapInArrow(rows, schema)


def compress_file(spark: SparkSession, path: str, to: str, options: Options = Options()) -> int:
    """A primitive file to a coded container, with its options; returns the container's bytes."""
    arrays = to_arrays(compress(ply.read_primitives(spark, path), options), options)
    arrays["options"] = np.frombuffer(json.dumps(asdict(options)).encode(), dtype=np.uint8)
    data = container.dump(arrays)
    with open(to, "wb") as f:
        f.write(data)
    return len(data)


def decompress_file(spark: SparkSession, path: str, to: str, kind: str = "float") -> int:
    """A coded container to a primitive file, in the stored order; returns the rows.

    Levels are worked out in double precision, which a file of kind "double" keeps."""
    with open(path, "rb") as f:
        arrays = container.load(f.read())
    options = Options(**json.loads(arrays["options"].tobytes()))
    return ply.write_primitives(decompress(from_arrays(spark, arrays, options), options), to, kind)


def attribute_errors(before: DataFrame, after: DataFrame) -> DataFrame:
    """attribute, mse, nmse (mse over variance) between two tables, by splat_id."""
    names = [*attributes.WIDTHS, "opacity"]
    left = before.withColumn("opacity", F.array("opacity")).select("splat_id", *(F.col(c).alias(f"{c}_a") for c in names))
    right = after.withColumn("opacity", F.array("opacity")).select("splat_id", *(F.col(c).alias(f"{c}_b") for c in names))
    long = left.join(right, "splat_id").select(F.explode(F.array(*(F.struct(F.lit(c).alias("attribute"), F.arrays_zip(F.col(f"{c}_a").alias("a"), F.col(f"{c}_b").alias("b")).alias("v")) for c in names))).alias("x"))
    flat = long.select("x.attribute", F.explode("x.v").alias("p")).select("attribute", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    d = F.col("a") - F.col("b")
    out = flat.groupBy("attribute").agg(F.avg(d * d).alias("mse"), F.var_pop("a").alias("_v"))
    return out.select("attribute", "mse", F.when(F.col("_v") > 0, F.col("mse") / F.col("_v")).alias("nmse"))


def bits_sweep(df: DataFrame, d: int, column: str, bits: tuple[int, ...], by: str) -> DataFrame:
    """bits, BY, nmse of the rotation codec of a column, for each number of bits.

    One branch for each setting, by matrix products: literals of several rotations
    would make a plan too large to compile."""
    power = F.aggregate(column, F.lit(0.0), lambda s, x: s + x * x)
    out = None
    for b in bits:
        coded = rotation_codec.encode_bulk(df.select(by, column), column, d, b)
        error = rotation_codec.squared_error(F.col(column), F.col("decoded"))
        one = rotation_codec.decode_bulk(coded, d, b).groupBy(by).agg((F.sum(error) / F.sum(power)).alias("nmse")).select(F.lit(b).alias("bits"), by, "nmse")
        out = one if out is None else out.unionByName(one)
    return out


def threshold_sweep(df: DataFrame, resolution: int, thresholds: tuple[int, ...] = (0, 2, 3, 5, 8)) -> DataFrame:
    """threshold and merge statistics, for each threshold, of one voxel grid."""
    rows = ordering.voxel_keys(df, resolution)
    out = None
    for t in thresholds:
        one = merging.merge_statistics(rows, t).withColumn("threshold", F.lit(t))
        out = one if out is None else out.unionByName(one)
    return out


def factor_sweep(df: DataFrame, components: tuple[int, ...], clusters: tuple[int | None, ...] = (None,), grid: int = 32, options: Options = Options(sh_bits=2, dc_bits=10, scale_bits=8)) -> DataFrame:
    """components, clusters (null: no codebooks), attribute, mse, nmse for every pair of settings."""
    out = None
    for k in components:
        for c in clusters:
            coded, facts = compress_factors(df, k, options, None if c is None else grid, c or 256)
            one = attribute_errors(df, decompress_factors(coded, facts)).select(F.lit(k).alias("components"), F.lit(c).cast("int").alias("clusters"), "attribute", "mse", "nmse")
            out = one if out is None else out.unionByName(one)
    return out


def scene_report(df: DataFrame, options: Options = Options()) -> DataFrame:
    """One row: primitives before and after, stored bits, compression ratio, and error of each attribute."""
    coded = compress(df, options)
    errors = attribute_errors(df, decompress(coded, options)).groupBy().pivot("attribute", [*attributes.WIDTHS, "opacity"]).agg(F.first("nmse"))
    counts = df.agg(F.count("*").alias("n_before")).crossJoin(coded.agg(F.count("*").alias("n_after")))
    bits = stored_bits(options)
    return counts.withColumn("bits", F.lit(bits)).withColumn("ratio", F.when(F.col("n_after") > 0, F.col("n_before") * 59 * 32 / (F.col("n_after") * bits))).crossJoin(errors)
