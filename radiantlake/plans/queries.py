"""Registered queries over the driver's tables, each beside its SQL.

Primitives are the first 59 dimensions of `embeddings`; metric tables, camera lists
and images are views of the other tables. Every query reads its tables whole.
Floating-point results are rounded to six places on both sides."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, harmonics, scalars
from ..operators import attributes, bitpack, cameras, codebook, deltas, densify, factor, images, merging, ordering, reports, rotation_codec, uniform
from . import codecs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | Callable[[], str] | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql if isinstance(sql, str) else sql()
        return f

    return add


def r(x: Column | str) -> Column:
    """Six places, no negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6) + F.lit(0.0)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def prims(spark: SparkSession, sf: str) -> DataFrame:
    return attributes.from_embeddings(spark, sf)


def joined(x: Column | str) -> Column:
    return F.array_join(F.transform(x, lambda v: v.cast("string")), ",")


P = """p AS (SELECT vec_id AS splat_id, label AS scene, e[1:3] AS xyz, e[4:6] AS sh_dc, e[7] AS opacity, e[8:10] AS scales, e[11:14] AS rotations, e[15:59] AS sh_rest, e
  FROM (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings))"""
SIG = "1 / (1 + exp(-opacity))"
DIM, BITS, RATIO, GRID = 64, 2, 0.3, 4


def _nums(xs) -> str:
    return "[" + ", ".join(repr(float(x)) for x in xs) + "]::DOUBLE[]"


def _rotq_sql(tail: str) -> str:
    levels = codebook.centroids(DIM, BITS)
    turn = codebook.rotation(DIM, 0)
    rows = "[" + ", ".join(_nums(x) for x in turn) + "]"
    back = "[" + ", ".join(_nums(x) for x in zip(*turn, strict=True)) + "]"
    code = " + ".join(f"(y > {c!r})::INT" for c in codebook.boundaries(levels))
    return f"""WITH {P}, m AS (SELECT {rows} AS rot, {back} AS back, {_nums(levels)} AS levels),
n AS (SELECT splat_id, scene, e, rot, back, levels, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM p, m),
c AS (SELECT *, list_transform(list_transform(rot, lambda row: list_sum(list_transform(range(1, 65), lambda i: row[i] * e[i])) / norm), lambda y: {code}) AS codes FROM n),
d AS (SELECT *, list_transform(codes, lambda k: levels[k + 1]) AS y FROM c),
b AS (SELECT *, list_transform(back, lambda row: norm * list_sum(list_transform(range(1, 65), lambda i: row[i] * y[i]))) AS decoded FROM d)
{tail}"""


def _whole(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    return rows.select(F.col("vec_id").alias("splat_id"), F.col("label").alias("scene"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))


@query(_rotq_sql("SELECT scene, count(*) AS n, round(avg(list_sum(list_transform(range(1, 65), lambda i: (e[i] - decoded[i]) ** 2))), 6) + 0.0 AS error FROM b GROUP BY scene"))
def rotation_codec_error(spark: SparkSession, sf: str) -> DataFrame:
    """Mean squared reconstruction error of the rotation codec, by label."""
    back = rotation_codec.decode_bulk(rotation_codec.encode_bulk(_whole(spark, sf), "e", DIM, BITS), DIM, BITS)
    return back.groupBy("scene").agg(F.count("*").alias("n"), r(F.avg(rotation_codec.squared_error(F.col("e"), F.col("decoded")))).alias("error"))


@query(_rotq_sql("SELECT splat_id, array_to_string(codes, ',') AS codes, round(norm, 6) + 0.0 AS norm FROM c"))
def rotation_codec_codes(spark: SparkSession, sf: str) -> DataFrame:
    rows = rotation_codec.encode_bulk(_whole(spark, sf), "e", DIM, BITS)
    return rows.select("splat_id", joined("codes").alias("codes"), r("norm").alias("norm"))


@query()
def codebooks(spark: SparkSession, sf: str) -> DataFrame:
    """Levels and expected error by bits; checked by properties in the tests."""
    rows = [(b, [float(x) for x in codebook.centroids(45, b)], codebook.expected_error(45, b)) for b in (1, 2, 3, 4)]
    return spark.createDataFrame(rows, "bits int, levels array<double>, error double")


ATTRS = {"xyz": 16, "sh_dc": 10, "scales": 10, "rotations": 8}
_Q = lambda c, b: f"""list_transform({c}, lambda x: least(greatest(round_even((x - {c}_low) / CASE WHEN {c}_high > {c}_low THEN ({c}_high - {c}_low) / {(1 << b) - 1} ELSE 1 END, 0), 0), {(1 << b) - 1})::INT)"""
_RANGES = ", ".join(f"min(list_min({c})) AS {c}_low, max(list_max({c})) AS {c}_high" for c in ATTRS)


@query(f"WITH {P}, s AS (SELECT {_RANGES} FROM p) SELECT splat_id, " + ", ".join(f"array_to_string({_Q(c, b)}, ',') AS {c}" for c, b in ATTRS.items()) + " FROM p, s")
def uniform_codes(spark: SparkSession, sf: str) -> DataFrame:
    rows = uniform.quantize(prims(spark, sf), ATTRS)
    return rows.select("splat_id", *(joined(c).alias(c) for c in ATTRS))


@query(
    f"WITH {P}, s AS (SELECT {_RANGES} FROM p), q AS (SELECT p.*, s.*, "
    + ", ".join(f"{_Q(c, b)} AS {c}_q" for c, b in ATTRS.items())
    + " FROM p, s) "
    + " UNION ALL ".join(f"SELECT '{c}' AS attribute, round(avg(list_sum(list_transform(range(1, len({c}) + 1), lambda i: ({c}[i] - ({c}_q[i] * (({c}_high - {c}_low) / {(1 << b) - 1}) + {c}_low)) ** 2))) * 1e6, 6) + 0.0 AS error_e6 FROM q" for c, b in ATTRS.items())
)
def uniform_error(spark: SparkSession, sf: str) -> DataFrame:
    rows = prims(spark, sf)
    back = uniform.dequantize(uniform.quantize(rows.select("splat_id", *ATTRS, *(F.col(c).alias(f"{c}_was") for c in ATTRS)), ATTRS), list(ATTRS))
    e = back.agg(*(F.avg(rotation_codec.squared_error(F.col(c), F.col(f"{c}_was"))).alias(c) for c in ATTRS))
    return e.select(F.explode(F.array(*(F.struct(F.lit(c).alias("attribute"), r(F.col(c) * 1e6).alias("error_e6")) for c in ATTRS))).alias("x")).select("x.*")


_IMPORTANCE = f"({SIG}) * exp((scales[1] + scales[2] + scales[3]) / 3)"


@query(f"WITH {P}, i AS (SELECT splat_id, scene, {_IMPORTANCE} AS v FROM p), k AS (SELECT *, row_number() OVER (ORDER BY v DESC, splat_id) AS rn, count(*) OVER () AS n FROM i) SELECT splat_id, scene FROM k WHERE rn <= greatest((n * (1 - {RATIO}))::DOUBLE // 1, 1)")
def prune_by_importance(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.prune(prims(spark, sf), RATIO).select("splat_id", "scene")


@query(
    f"""WITH {P}, t AS (SELECT scene, sh_rest[1:24] AS lead, list_concat(sh_rest[1:24], list_transform(range(21), lambda i: 0.0::DOUBLE)) AS padded,
  list_transform(range(1, 46), lambda i: CASE WHEN (i - 1) % 15 BETWEEN 3 AND 7 THEN 0.0 ELSE sh_rest[i] END) AS zeroed, list_concat(list_concat(sh_rest[1:8], sh_rest[16:23]), sh_rest[31:38]) AS bands FROM p)
SELECT scene, max(len(padded)) AS width, round(sum(list_sum(lead)), 6) + 0.0 AS lead, round(sum(list_sum(zeroed)), 6) + 0.0 AS zeroed, round(sum(list_sum(bands)), 6) + 0.0 AS bands, round(sum(list_sum(list_transform(range(1, 46), lambda i: padded[i] * i))), 6) + 0.0 AS padded FROM t GROUP BY scene"""
)
def harmonic_selections(spark: SparkSession, sf: str) -> DataFrame:
    """Truncation, padding, a zeroed band, and truncation by band."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    rest = F.col("sh_rest")
    rows = prims(spark, sf).select("scene", attributes.truncated(rest, 2).alias("lead"), attributes.padded(attributes.truncated(rest, 2)).alias("padded"), attributes.band_zeroed(rest, 2).alias("zeroed"), attributes.truncated(rest, 2, by_band=True).alias("bands"))
    weighted = F.transform("padded", lambda v, i: v * (i + 1))
    return rows.groupBy("scene").agg(F.max(F.size("padded")).alias("width"), r(F.sum(total(F.col("lead")))).alias("lead"), r(F.sum(total(F.col("zeroed")))).alias("zeroed"), r(F.sum(total(F.col("bands")))).alias("bands"), r(F.sum(total(weighted))).alias("padded"))


@query(f"WITH {P} SELECT splat_id, " + ", ".join(f"round(xyz[{i + 1}], 6) + 0.0 AS p_{i}, round(rotations[{i + 1}], 6) + 0.0 AS rot_{i}" for i in range(3)) + ", round(rotations[4], 6) + 0.0 AS rot_3 FROM p")
def unpacked_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Arrays to numbered columns and back, and out again."""
    named = {"xyz": ("p_", 3), "rotations": ("rot_", 4)}
    rows = attributes.unpack_columns(prims(spark, sf).select("splat_id", *named), named)
    again = attributes.unpack_columns(attributes.pack_columns(rows, {"p_": "xyz", "rot_": "rotations"}), named)
    return again.select("splat_id", *(r(f"p_{i}").alias(f"p_{i}") for i in range(3)), *(r(f"rot_{i}").alias(f"rot_{i}") for i in range(4)))


@query(f"WITH {P} SELECT round(min(xyz[1]), 6) + 0.0 AS x0, round(min(xyz[2]), 6) + 0.0 AS y0, round(min(xyz[3]), 6) + 0.0 AS z0, round(max(xyz[1]) - min(xyz[1]), 6) + 0.0 AS dx, round(max(xyz[2]) - min(xyz[2]), 6) + 0.0 AS dy, round(max(xyz[3]) - min(xyz[3]), 6) + 0.0 AS dz FROM p")
def bounding_box(spark: SparkSession, sf: str) -> DataFrame:
    box = ordering.bounding_box(prims(spark, sf))
    return box.select(*(r(F.col("box_min")[i]).alias(n) for i, n in enumerate(("x0", "y0", "z0"))), *(r(F.col("box_size")[i]).alias(n) for i, n in enumerate(("dx", "dy", "dz"))))


def _voxels(n: int) -> str:
    cell = lambda i: f"least(greatest(floor((xyz[{i}] - b.lo[{i}]) / b.size), 0), {n - 1})::BIGINT"
    return f"""b AS (SELECT [min(xyz[1]), min(xyz[2]), min(xyz[3])] AS lo, greatest(max(xyz[1]) - min(xyz[1]), max(xyz[2]) - min(xyz[2]), max(xyz[3]) - min(xyz[3])) / {n} AS size FROM p),
v AS (SELECT p.*, b.lo, b.size, {cell(1)} AS gx, {cell(2)} AS gy, {cell(3)} AS gz, {cell(1)} * {n * n} + {cell(2)} * {n} + {cell(3)} AS voxel FROM p, b)"""


@query(f"WITH {P}, {_voxels(GRID)} SELECT voxel, count(*) AS n FROM v GROUP BY voxel")
def voxel_groups(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.voxel_keys(prims(spark, sf), GRID).groupBy("voxel").agg(F.count("*").alias("n"))


@query(f"WITH {P}, {_voxels(8)} SELECT count(DISTINCT voxel) AS n_voxels FROM v")
def voxel_occupied(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.voxel_count(ordering.voxel_keys(prims(spark, sf), 8))


_TOP = (1 << 21) - 1
_BITS = lambda i, k: f"list_sum(list_transform(range(21), lambda j: (((c[{i}] >> j::INT) & 1) << (3 * j + {k})::INT)::BIGINT))::BIGINT"
_MORTON = f"""bb AS (SELECT [min(xyz[1]), min(xyz[2]), min(xyz[3])] AS lo, [greatest(max(xyz[1]) - min(xyz[1]), 1e-6), greatest(max(xyz[2]) - min(xyz[2]), 1e-6), greatest(max(xyz[3]) - min(xyz[3]), 1e-6)] AS ext FROM p),
cc AS (SELECT p.*, list_transform([1, 2, 3], lambda i: least(greatest(floor((xyz[i] - lo[i]) / ext[i] * {_TOP}), 0), {_TOP})::BIGINT) AS c FROM p, bb),
mm AS (SELECT *, {_BITS(1, 0)} + {_BITS(2, 1)} + {_BITS(3, 2)} AS morton FROM cc)"""


@query(f"WITH {P}, {_MORTON} SELECT splat_id, morton, row_number() OVER (ORDER BY morton, splat_id) - 1 AS ordinal FROM mm")
def morton_order(spark: SparkSession, sf: str) -> DataFrame:
    rows = ordering.numbered(ordering.with_morton(prims(spark, sf)), ["morton", "splat_id"])
    return rows.select("splat_id", "morton", "ordinal")


@query(f"WITH {P}, {_voxels(16)} SELECT splat_id, voxel, row_number() OVER (PARTITION BY scene ORDER BY voxel, splat_id) - 1 AS ordinal FROM v")
def voxel_order(spark: SparkSession, sf: str) -> DataFrame:
    rows = ordering.numbered(ordering.voxel_keys(prims(spark, sf), 16), ["voxel", "splat_id"], ["scene"])
    return rows.select("splat_id", "voxel", F.col("ordinal").cast("bigint").alias("ordinal"))


_MERGE = f"""WITH {P}, {_voxels(GRID)},
f AS (SELECT voxel, count(*) AS n, var_pop(xyz[1]) + var_pop(xyz[2]) + var_pop(xyz[3]) AS var, arg_min(rotations, splat_id) AS lead, any_value(size) AS size FROM v GROUP BY voxel),
mv AS (SELECT * FROM f WHERE n > 3 AND var <= {{limit}}),
m AS (SELECT v.*, mv.lead, {SIG} AS w, CASE WHEN rotations[1] * lead[1] + rotations[2] * lead[2] + rotations[3] * lead[3] + rotations[4] * lead[4] < 0 THEN -1.0 ELSE 1.0 END AS sgn FROM v JOIN mv USING (voxel)),
g AS (SELECT voxel, min(splat_id) AS splat_id, count(*) AS n_members, {", ".join(f"sum(w * xyz[{i}]) / (sum(w) + 1e-10) AS x{i}" for i in (1, 2, 3))}, avg(scales[1]) AS s1, sum(w * sh_rest[45]) / (sum(w) + 1e-10) AS r45,
  least(greatest(1 - exp(sum(ln(1 - w))), 1e-7), 1 - 1e-7) AS o, {", ".join(f"sum(w * sgn * rotations[{i}]) / (sum(w) + 1e-10) AS q{i}" for i in (1, 2, 3, 4))} FROM m GROUP BY voxel)"""


@query(
    _MERGE.format(limit="2 * size * size")
    + " SELECT voxel, splat_id, n_members, round(x1, 6) + 0.0 AS x, round(x2, 6) + 0.0 AS y, round(x3, 6) + 0.0 AS z, round(s1, 6) + 0.0 AS scale_0, round(r45, 6) + 0.0 AS rest_44, round(ln(o / (1 - o)), 6) + 0.0 AS opacity, round(q1 / sqrt(q1*q1 + q2*q2 + q3*q3 + q4*q4), 6) + 0.0 AS rot_0, round(q4 / sqrt(q1*q1 + q2*q2 + q3*q3 + q4*q4), 6) + 0.0 AS rot_3 FROM g"
)
def voxel_merge(spark: SparkSession, sf: str) -> DataFrame:
    _, merged = merging.voxel_merge(ordering.voxel_keys(prims(spark, sf), GRID))
    at = lambda c, i: r(F.get(c, F.lit(i)))
    return merged.select("voxel", "splat_id", "n_members", at("xyz", 0).alias("x"), at("xyz", 1).alias("y"), at("xyz", 2).alias("z"), at("scales", 0).alias("scale_0"), at("sh_rest", 44).alias("rest_44"), r("opacity").alias("opacity"), at("rotations", 0).alias("rot_0"), at("rotations", 3).alias("rot_3"))


@query(
    f"""WITH {P}, {_voxels(GRID)}, f AS (SELECT voxel, count(*) AS n, var_pop(xyz[1]) + var_pop(xyz[2]) + var_pop(xyz[3]) AS var, any_value(size) AS size FROM v GROUP BY voxel),
t AS (SELECT unnest([0, 2, 3, 5, 8]) AS threshold), k AS (SELECT t.threshold, f.*, n > t.threshold AS crowded, t.threshold > 0 AND n > t.threshold AND var <= 2 * size * size AS merge FROM f, t)
SELECT threshold, sum(n)::BIGINT AS n_before, count(*) AS n_voxels, count(*) FILTER (merge) AS n_merged_voxels, coalesce(sum(n) FILTER (merge), 0)::BIGINT AS n_merged_rows, count(*) FILTER (crowded AND NOT merge) AS n_rejected_voxels,
  (coalesce(sum(n) FILTER (NOT merge), 0) + count(*) FILTER (merge))::BIGINT AS n_after, round(sum(n) / (coalesce(sum(n) FILTER (NOT merge), 0) + count(*) FILTER (merge)), 6) + 0.0 AS ratio FROM k GROUP BY threshold"""
)
def merge_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """Merge statistics by threshold."""
    out = codecs.threshold_sweep(prims(spark, sf), GRID)
    return out.select("threshold", *(F.col(c).cast("bigint").alias(c) for c in ("n_before", "n_voxels", "n_merged_voxels", "n_merged_rows", "n_rejected_voxels", "n_after")), r("ratio").alias("ratio"))


_SHARE = lambda i, g: f"least(greatest((xyz[{i}] - (lo[{i}] + {g} * size)) / size, 0), 1 - 1e-6)"


@query(f"WITH {P}, {_voxels(32)}, a AS (SELECT *, floor({_SHARE(1, 'gx')} * 16)::INT AS o1, floor({_SHARE(2, 'gy')} * 16)::INT AS o2, floor({_SHARE(3, 'gz')} * 16)::INT AS o3 FROM v) SELECT splat_id, o1, o2, o3, round(lo[1] + gx * size + (o1 + 0.5) / 16 * size, 6) + 0.0 AS x, round(lo[3] + gz * size + (o3 + 0.5) / 16 * size, 6) + 0.0 AS z FROM a")
def anchored_positions(spark: SparkSession, sf: str) -> DataFrame:
    rows = deltas.unanchored(deltas.anchored(ordering.voxel_keys(prims(spark, sf), 32), 32), name="decoded")
    return rows.select("splat_id", *(F.get("offsets", F.lit(i)).alias(f"o{i + 1}") for i in range(3)), r(F.get("decoded", F.lit(0))).alias("x"), r(F.get("decoded", F.lit(2))).alias("z"))


_QX = f"{P}, s AS (SELECT min(list_min(xyz)) AS xyz_low, max(list_max(xyz)) AS xyz_high FROM p), q AS (SELECT p.splat_id, scene, rotations, {_Q('xyz', 16)} AS q FROM p, s)"
_WRAP = lambda x: f"((({x}) + 32768) % 65536 + 65536) % 65536 - 32768"


@query(f"WITH {_QX}, l AS (SELECT *, lag(q) OVER (PARTITION BY scene ORDER BY splat_id) AS b FROM q) SELECT splat_id, " + ", ".join(f"({_WRAP(f'q[{i}] - coalesce(b[{i}], 0)')})::BIGINT AS d{i}" for i in (1, 2, 3)) + " FROM l")
def position_deltas(spark: SparkSession, sf: str) -> DataFrame:
    rows = uniform.quantize(prims(spark, sf).select("splat_id", "scene", "xyz"), {"xyz": 16})
    rows = deltas.delta_encode(rows, "xyz", ["splat_id"], ["scene"])
    return rows.select("splat_id", *(F.get("xyz", F.lit(i)).cast("bigint").alias(f"d{i + 1}") for i in range(3)))


@query(f"WITH {_QX} SELECT splat_id, q[1]::BIGINT AS x, q[2]::BIGINT AS y, q[3]::BIGINT AS z FROM q")
def position_deltas_back(spark: SparkSession, sf: str) -> DataFrame:
    """Codes through deltas in blocks and back."""
    rows = uniform.quantize(prims(spark, sf).select("splat_id", "scene", "xyz"), {"xyz": 16})
    rows = deltas.blocks(rows, ["splat_id"], 64, ["scene"])
    by, group = ["ordinal"], ["scene", "block"]
    rows = deltas.delta_decode(deltas.delta_encode(rows, "xyz", by, group), "xyz", 3, by, group)
    return rows.select("splat_id", *(F.get("xyz", F.lit(i)).cast("bigint").alias(n) for i, n in enumerate("xyz")))


_DOT = " + ".join(f"rotations[{i}] * b[{i}]" for i in (1, 2, 3, 4))


@query(
    f"""WITH {P}, l AS (SELECT *, lag(rotations) OVER w AS b FROM p WINDOW w AS (PARTITION BY scene ORDER BY splat_id)),
k AS (SELECT *, {_DOT} AS d FROM l), z AS (SELECT *, sum(CASE WHEN d = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY scene ORDER BY splat_id) AS run FROM k),
s AS (SELECT *, CASE WHEN sum(CASE WHEN d < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY scene, run ORDER BY splat_id) % 2 = 1 THEN -1 ELSE 1 END AS sgn FROM z),
t AS (SELECT *, lag(sgn) OVER (PARTITION BY scene ORDER BY splat_id) AS bs FROM s)
SELECT splat_id, """
    + ", ".join(f"round(rotations[{i}] * sgn - coalesce(b[{i}] * bs, 0), 6) + 0.0 AS d{i}" for i in (1, 2, 3, 4))
    + " FROM t"
)
def quaternion_deltas(spark: SparkSession, sf: str) -> DataFrame:
    rows = deltas.rotation_deltas(prims(spark, sf), ["splat_id"], ["scene"])
    return rows.select("splat_id", *(r(F.get("rotations", F.lit(i))).alias(f"d{i + 1}") for i in range(4)))


def _packed(bits: int, spark: SparkSession, sf: str) -> DataFrame:
    coded = uniform.quantize(prims(spark, sf).select("splat_id", "scene", "sh_rest"), {"sh_rest": bits})
    rows = ordering.numbered(coded, ["splat_id"], ["scene"])
    return bitpack.pack_stream(rows, "sh_rest", 45, bits, ["scene"])


def _packed_sql(bits: int) -> str:
    n, size = bitpack.GROUPS[bits]
    value = f"sum(code::BIGINT << ({n * bits - bits} - {bits} * (pos % {n}))::INT)::BIGINT"
    parts = " UNION ALL ".join(f"SELECT scene, g * {size} + {k} AS at, ((v >> {8 * (size - 1 - k)}) & 255)::INT AS byte FROM g" for k in range(size))
    return f"""WITH {P}, s AS (SELECT min(list_min(sh_rest)) AS sh_rest_low, max(list_max(sh_rest)) AS sh_rest_high FROM p),
q AS (SELECT scene, row_number() OVER (PARTITION BY scene ORDER BY splat_id) - 1 AS o, {_Q("sh_rest", bits)} AS q FROM p, s),
u AS (SELECT scene, o * 45 + j AS pos, q[j + 1] AS code FROM q, (SELECT unnest(range(45)) AS j)),
g AS (SELECT scene, pos // {n} AS g, {value} AS v FROM u GROUP BY scene, pos // {n}) {parts}"""


@query(lambda: _packed_sql(2))
def packed_two_bits(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(2, spark, sf)


@query(lambda: _packed_sql(3))
def packed_three_bits(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(3, spark, sf)


@query(lambda: _packed_sql(4))
def packed_four_bits(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(4, spark, sf)


@query(f"WITH {P}, s AS (SELECT min(list_min(sh_rest)) AS sh_rest_low, max(list_max(sh_rest)) AS sh_rest_high FROM p) SELECT splat_id, array_to_string({_Q('sh_rest', 3)}, ',') AS codes, 18 AS n_bytes FROM p, s")
def packed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Three-bit codes packed within rows, and unpacked again."""
    rows = uniform.quantize(prims(spark, sf).select("splat_id", "sh_rest"), {"sh_rest": 3}).withColumn("data", bitpack.packed(F.col("sh_rest"), 45, 3))
    return rows.select("splat_id", joined(bitpack.unpacked(F.col("data"), 45, 3)).alias("codes"), F.size("data").alias("n_bytes"))


@query(f"WITH {_QX}, o AS (SELECT scene, row_number() OVER (PARTITION BY scene ORDER BY splat_id) - 1 AS o, count(*) OVER (PARTITION BY scene) AS n, q[1]::BIGINT AS x FROM q) SELECT scene, o AS at, (x & 255)::INT AS byte FROM o UNION ALL SELECT scene, n + o, (x >> 8)::INT FROM o")
def byte_planes(spark: SparkSession, sf: str) -> DataFrame:
    rows = uniform.quantize(prims(spark, sf).select("splat_id", "scene", "xyz"), {"xyz": 16})
    rows = ordering.numbered(rows, ["splat_id"], ["scene"]).withColumn("x", F.get("xyz", F.lit(0)))
    return bitpack.byte_shuffled(rows, "x", 2, ["scene"])


# Views: a metric by scene (event type), view, split and band, from events.
M = "e AS (SELECT event_type AS scene, event_id AS view, CASE WHEN event_id % 3 = 0 THEN 'test' ELSE 'train' END AS split, (user_id % 4)::INT AS band, value, ts FROM events)"


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_type").alias("scene"), F.col("event_id").alias("view"), F.when(F.col("event_id") % 3 == 0, "test").otherwise("train").alias("split"), (F.col("user_id") % 4).cast("int").alias("band"), "value", "ts")


@query(f"WITH {M} SELECT scene, round(avg(value) FILTER (split = 'train'), 6) + 0.0 AS train, round(avg(value) FILTER (split = 'test'), 6) + 0.0 AS test, round(avg(value) FILTER (split = 'train') - avg(value) FILTER (split = 'test'), 6) + 0.0 AS gap FROM e GROUP BY scene")
def train_test_gap(spark: SparkSession, sf: str) -> DataFrame:
    return reports.train_test_gap(metrics(spark, sf), ["scene"], "value").select("scene", *(r(c).alias(c) for c in ("train", "test", "gap")))


_DROPS = f"""WITH {M}, a AS (SELECT scene, band, avg(value) FILTER (split = 'train') AS tr, avg(value) FILTER (split = 'test') AS te FROM e GROUP BY scene, band),
d AS (SELECT a.scene, a.band, b.tr - a.tr AS train_drop, b.te - a.te AS test_drop FROM a JOIN a b ON a.scene = b.scene AND b.band = 0 WHERE a.band > 0)"""
_RULES = {
    "exact": "CASE WHEN test_drop <> 0 THEN train_drop / test_drop ELSE 'inf'::DOUBLE END",
    "small": "CASE WHEN abs(test_drop) > 1e-6 THEN train_drop / test_drop ELSE 'inf'::DOUBLE END",
    "signed": "CASE WHEN abs(test_drop) < 1e-4 THEN CASE WHEN train_drop > 0 THEN 'inf'::DOUBLE ELSE 'nan'::DOUBLE END WHEN test_drop < 0 AND train_drop > 0 THEN 'inf'::DOUBLE ELSE train_drop / test_drop END",
}


@query(_DROPS + " SELECT scene, band, round(train_drop, 6) + 0.0 AS train_drop, round(test_drop, 6) + 0.0 AS test_drop, " + ", ".join(f"CASE WHEN isinf({q}) THEN 'inf' WHEN isnan({q}) THEN 'nan' ELSE 'number' END AS {n}_kind, CASE WHEN isfinite({q}) THEN round({q}, 6) + 0.0 END AS {n}_ratio" for n, q in _RULES.items()) + " FROM d")
def band_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """Drops by band, and their ratio by the three rules."""
    rows = reports.band_drops(metrics(spark, sf), ["scene"], "value")
    out = [F.col("scene"), F.col("band"), r("train_drop").alias("train_drop"), r("test_drop").alias("test_drop")]
    for rule in _RULES:
        x = reports.ratio(F.col("train_drop"), F.col("test_drop"), rule)
        out += [F.when(F.isnan(x), "nan").when(F.abs(x) == math.inf, "inf").otherwise("number").alias(f"{rule}_kind"), r(reports.finite(x)).alias(f"{rule}_ratio")]
    return rows.select(*out)


@query(f"WITH {M} SELECT scene, count(*) AS n, round(avg(value), 6) + 0.0 AS value FROM e GROUP BY ROLLUP (scene)")
def rolled_means(spark: SparkSession, sf: str) -> DataFrame:
    return reports.rolled_means(metrics(spark, sf), "scene", ["value"]).select("scene", "n", r("value").alias("value"))


@query(f"WITH {M}, b AS (SELECT scene, band, avg(value) AS v FROM e GROUP BY scene, band), x AS (SELECT * FROM b WHERE band = 1), y AS (SELECT * FROM b WHERE band = 2) SELECT scene, round(x.v, 6) + 0.0 AS before, round(y.v, 6) + 0.0 AS after, round(y.v - x.v, 6) + 0.0 AS change FROM x JOIN y USING (scene)")
def paired_runs(spark: SparkSession, sf: str) -> DataFrame:
    means = reports.means(metrics(spark, sf), ["scene", "band"], ["value"])
    rows = reports.paired(means.where("band = 1"), means.where("band = 2"), ["scene"], "value")
    return rows.select("scene", *(r(c).alias(c) for c in ("before", "after", "change")))


@query("SELECT c_name AS name, (row_number() OVER (ORDER BY c_name) - 1) % 8 = 0 AS is_test FROM customer")
def held_out_views(spark: SparkSession, sf: str) -> DataFrame:
    return reports.held_out(table(spark, sf, "customer").select(F.col("c_name").alias("name")), ["name"]).select("name", "is_test")


@query(f"WITH {M}, w AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY view) - 1 AS i, count(*) OVER (PARTITION BY scene) AS n FROM e) SELECT scene, view FROM w WHERE n <= 15 OR list_contains(list_transform(range(15), lambda k: round_even(k * (n - 1) / 14, 0)::BIGINT), i)")
def evenly_spaced_views(spark: SparkSession, sf: str) -> DataFrame:
    return reports.evenly_spaced(metrics(spark, sf), ["view"], 15, ["scene"]).select("scene", "view")


@query(f"WITH {M}, w AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY view) AS i, count(*) OVER (PARTITION BY scene) AS n FROM e) SELECT scene, view, 'first' AS kind FROM w WHERE i <= 5 UNION ALL SELECT scene, view, 'probe' FROM w, (SELECT unnest([5, 10, 15, 20, 25]) AS k) WHERE k % n = i - 1")
def chosen_views(spark: SparkSession, sf: str) -> DataFrame:
    """The first five views, and five fixed places."""
    rows = metrics(spark, sf).select("scene", "view")
    first = reports.first_views(rows, ["view"], 5, ["scene"]).select("scene", "view", F.lit("first").alias("kind"))
    return first.unionByName(reports.probe_views(rows, ["view"], ["scene"]).select("scene", "view", F.lit("probe").alias("kind")))


@query(f"WITH {M}, k AS (SELECT scene, value, count(*) OVER (PARTITION BY scene) - row_number() OVER (PARTITION BY scene ORDER BY view) AS back FROM e) SELECT scene, round(sum(value * 0.4 * pow(0.6, back)), 6) + 0.0 AS smoothed FROM k GROUP BY scene")
def smoothed_metric(spark: SparkSession, sf: str) -> DataFrame:
    """Moving average at the end of each scene's views."""
    return reports.smoothed(metrics(spark, sf), "value", ["scene"], "view").select("scene", r("smoothed").alias("smoothed"))


@query(f"WITH {M} SELECT scene, sum(236) AS raw_bytes, sum(view % 100) AS stored_bytes, round(sum(236) / sum(view % 100), 6) + 0.0 AS ratio FROM e GROUP BY scene")
def compression_ratios(spark: SparkSession, sf: str) -> DataFrame:
    out = reports.compression(metrics(spark, sf), F.lit(236), F.col("view") % 100, ["scene"])
    return out.select("scene", F.col("raw_bytes").cast("bigint").alias("raw_bytes"), F.col("stored_bytes").cast("bigint").alias("stored_bytes"), r("ratio").alias("ratio"))


_ROT = {
    "xx": "1 - 2 * (y*y + z*z)", "xy": "2 * (x*y - w*z)", "xz": "2 * (x*z + w*y)",
    "yx": "2 * (x*y + w*z)", "yy": "1 - 2 * (x*x + z*z)", "yz": "2 * (y*z - w*x)",
    "zx": "2 * (x*z - w*y)", "zy": "2 * (y*z + w*x)", "zz": "1 - 2 * (x*x + y*y)",
}


@query(
    f"""WITH {P}, u AS (SELECT splat_id, scales, sqrt(rotations[1]**2 + rotations[2]**2 + rotations[3]**2 + rotations[4]**2) AS n, rotations FROM p),
k AS (SELECT splat_id, exp(2 * scales[1]) AS a, exp(2 * scales[2]) AS b, exp(2 * scales[3]) AS c, rotations[1] / n AS w, rotations[2] / n AS x, rotations[3] / n AS y, rotations[4] / n AS z FROM u),
m AS (SELECT splat_id, a, b, c, {", ".join(f"{v} AS {n}" for n, v in _ROT.items())} FROM k)
SELECT splat_id, """
    + ", ".join(f"round({i}x * {j}x * a + {i}y * {j}y * b + {i}z * {j}z * c, 6) + 0.0 AS c_{i}{j}" for i, j in ("xx", "xy", "xz", "yy", "yz", "zz"))
    + " FROM m"
)
def covariances(spark: SparkSession, sf: str) -> DataFrame:
    c = geometry.covariance(F.transform("scales", lambda s: F.exp(s)), F.col("rotations"))
    rows = prims(spark, sf).select("splat_id", c.alias("c"))
    return rows.select("splat_id", *(r(F.col("c")[k]).alias(f"c_{n}") for k, n in enumerate(("xx", "xy", "xz", "yy", "yz", "zz"))))


def views(spark: SparkSession, sf: str) -> DataFrame:
    """A camera for each nation."""
    k = F.col("n_nationkey").cast("double")
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("camera_id"), F.array(F.cos(k / 2) * 3, F.sin(k / 2) * 3, k / 10).alias("center"))


_VIEWS = "vw AS (SELECT n_nationkey::INT AS camera_id, cos(n_nationkey / 2) * 3 AS cx, sin(n_nationkey / 2) * 3 AS cy, n_nationkey / 10 AS cz FROM nation)"
_C0, _C1 = math.sqrt(1 / (4 * math.pi)), math.sqrt(3 / (4 * math.pi))


@query(
    f"""WITH {P}, {_VIEWS}, d AS (SELECT camera_id, sh_dc, sh_rest, xyz[1] - cx AS a, xyz[2] - cy AS b, xyz[3] - cz AS c FROM p, vw),
u AS (SELECT *, a / sqrt(a*a + b*b + c*c) AS x, b / sqrt(a*a + b*b + c*c) AS y, c / sqrt(a*a + b*b + c*c) AS z FROM d)
SELECT camera_id, """
    + ", ".join(f"round(avg(greatest({_C0!r} * sh_dc[{k + 1}] + {_C1!r} * (-y * sh_rest[{15 * k + 1}] + z * sh_rest[{15 * k + 2}] - x * sh_rest[{15 * k + 3}]) + 0.5, 0)), 6) + 0.0 AS {n}" for k, n in enumerate(("red", "green", "blue")))
    + " FROM u GROUP BY camera_id"
)
def view_colors(spark: SparkSession, sf: str) -> DataFrame:
    """Mean colour of all primitives from each camera, to degree 1."""
    rows = cameras.each_view(prims(spark, sf), views(spark, sf))
    c = harmonics.shown(harmonics.radiance(1, F.col("sh_dc"), F.col("sh_rest"), F.col("direction")))
    rows = rows.select("camera_id", c.alias("c"))
    return rows.groupBy("camera_id").agg(*(r(F.avg(F.col("c")[k])).alias(n) for k, n in enumerate(("red", "green", "blue"))))


@query()
def full_harmonics(spark: SparkSession, sf: str) -> DataFrame:
    """Radiance to degree 3 from each camera; tested against an integral of the basis."""
    rows = cameras.each_view(prims(spark, sf), views(spark, sf))
    return rows.select("splat_id", "camera_id", harmonics.radiance(3, F.col("sh_dc"), F.col("sh_rest"), F.col("direction")).alias("radiance"))


@query(
    f"""WITH {P}, a AS (SELECT scene, avg(xyz[1]) AS x, avg(xyz[2]) AS y, avg(xyz[3]) AS z FROM p GROUP BY scene)
SELECT scene, round(any_value(x), 6) + 0.0 AS cx, round(1.1 * max(sqrt((xyz[1] - x)**2 + (xyz[2] - y)**2 + (xyz[3] - z)**2)), 6) + 0.0 AS radius FROM p JOIN a USING (scene) GROUP BY scene"""
)
def scene_spheres(spark: SparkSession, sf: str) -> DataFrame:
    rows = cameras.scene_sphere(prims(spark, sf), "xyz", ["scene"])
    return rows.select("scene", r(F.col("center")[0]).alias("cx"), r("radius").alias("radius"))


@query(
    f"""WITH {M}, k AS (SELECT scene, value AS t, value * 0.5 + view % 7 AS s FROM e), m AS (SELECT scene, median(t) AS mt, median(s) AS ms, count(*) AS n, max(t) - min(t) AS rng FROM k GROUP BY scene),
d AS (SELECT scene, any_value(mt) AS mt, any_value(ms) AS ms, any_value(n) AS n, any_value(rng) AS rng, avg(abs(t - mt)) AS ta, avg(abs(s - ms)) AS sa FROM k JOIN m USING (scene) GROUP BY scene)
SELECT scene, round(CASE WHEN n > 10 AND rng > 1e-3 THEN ta / sa ELSE 0 END, 6) + 0.0 AS scale, round(CASE WHEN n > 10 AND rng > 1e-3 THEN mt - ms * (ta / sa) ELSE 0 END, 6) + 0.0 AS "offset" FROM d"""
)
def depth_fits(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics(spark, sf).select("scene", F.col("value").alias("t"), (F.col("value") * 0.5 + F.col("view") % 7).alias("s"))
    return cameras.depth_fit(rows, "scene", "t", "s").select("scene", r("scale").alias("scale"), r("offset").alias("offset"))


@query("SELECT coalesce(median(s_acctbal) FILTER (s_acctbal > 0), 0) AS median_scale FROM supplier")
def median_scale(spark: SparkSession, sf: str) -> DataFrame:
    return cameras.median_positive_scale(table(spark, sf, "supplier").select(F.col("s_acctbal").alias("scale")))


# Views: orders as images with customers as cameras; part names as depth parameters.
@query("SELECT c_nationkey AS model_id, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey")
def images_with_cameras(spark: SparkSession, sf: str) -> DataFrame:
    shots = table(spark, sf, "orders").select(F.col("o_custkey").alias("camera_id"), "o_totalprice")
    lens = table(spark, sf, "customer").select(F.col("c_custkey").alias("camera_id"), F.col("c_nationkey").alias("model_id"))
    return cameras.with_camera(shots, lens).groupBy("model_id").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("WITH i AS (SELECT c_custkey, 'dir/' || c_name || '.png' AS name, c_name AS stem FROM customer), d AS (SELECT 'Customer#' || right(s_name, 9) AS stem, s_acctbal AS scale, s_nationkey::DOUBLE AS shift FROM supplier) SELECT c_custkey AS image_id, scale, shift AS \"offset\" FROM i LEFT JOIN d USING (stem)")
def images_with_depth(spark: SparkSession, sf: str) -> DataFrame:
    shots = table(spark, sf, "customer").select(F.col("c_custkey").alias("image_id"), F.concat(F.lit("dir/"), "c_name", F.lit(".png")).alias("name"))
    params = table(spark, sf, "supplier").select(F.concat(F.lit("Customer#"), F.expr("right(s_name, 9)")).alias("name"), F.col("s_acctbal").alias("scale"), F.col("s_nationkey").cast("double").alias("offset"))
    return cameras.with_depth_params(shots, params).select("image_id", "scale", "offset")


@query("SELECT is_test, count(*) AS n FROM (SELECT c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%') AS is_test FROM customer) GROUP BY is_test")
def listed_tests(spark: SparkSession, sf: str) -> DataFrame:
    shots = table(spark, sf, "customer").select(F.col("c_custkey").alias("name"))
    listed = table(spark, sf, "orders").where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("name"))
    return cameras.flagged(shots, listed).groupBy("is_test").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS image_id, count(*) AS n, round(sum(p_retailprice), 2) AS total FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'R' GROUP BY o_orderkey")
def observed_points(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as observations of parts; returned ones observe none."""
    seen = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    point = F.when(F.col("l_returnflag") == "R", F.lit(-1)).otherwise(F.col("l_partkey"))
    shots = seen.groupBy(F.col("l_orderkey").alias("image_id")).agg(F.collect_list(F.struct(F.col("l_quantity").alias("x"), F.col("l_tax").alias("y"), point.alias("point3d_id"))).alias("observations"))
    points = table(spark, sf, "part").select(F.col("p_partkey").alias("point_id"), "p_retailprice")
    return cameras.observed_points(shots, points).groupBy("image_id").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"))


@query("SELECT round(avg(n), 6) + 0.0 AS mean_track_length FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey)")
def track_length(spark: SparkSession, sf: str) -> DataFrame:
    points = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.collect_list("l_orderkey").alias("track"))
    return cameras.mean_track_length(points).select(r("mean_track_length").alias("mean_track_length"))


_G = f"WITH {P}, o AS (SELECT l_suppkey, l_partkey % 500 AS splat_id, l_discount AS g, CASE WHEN l_linenumber > 2 THEN l_quantity ELSE 0 END AS rad FROM lineitem), gm AS (SELECT splat_id, CASE WHEN count(*) FILTER (rad > 0) > 0 THEN sum(g) FILTER (rad > 0) / count(*) FILTER (rad > 0) ELSE 0 END AS gradient, max(rad) AS radius FROM o GROUP BY splat_id)"


def _grown(spark: SparkSession, sf: str) -> DataFrame:
    seen = table(spark, sf, "lineitem").select((F.col("l_partkey") % 500).alias("splat_id"), F.col("l_discount").alias("gradient"), F.when(F.col("l_linenumber") > 2, F.col("l_quantity")).otherwise(0.0).alias("radius"))
    return densify.gradient_means(seen)


@query(_G + " SELECT splat_id, round(gradient, 6) + 0.0 AS gradient, radius FROM gm")
def gradient_means(spark: SparkSession, sf: str) -> DataFrame:
    return _grown(spark, sf).select("splat_id", r("gradient").alias("gradient"), "radius")


@query(_G + f", k AS (SELECT p.splat_id, gradient, radius, exp(list_max(scales)) AS big, {SIG} AS o FROM p JOIN gm USING (splat_id)) SELECT count(*) AS n, count(*) FILTER (gradient >= 0.05 AND big <= 1.15) AS clones, count(*) FILTER (gradient >= 0.05 AND big > 1.15) AS splits, count(*) FILTER (o < 0.49 OR radius > 49 OR big > 1.25) AS pruned FROM k")
def densified_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that are cloned, split (two children each) and pruned."""
    rows = prims(spark, sf).join(_grown(spark, sf), "splat_id")
    copies = densify.cloned(rows, 0.05, 115.0).agg(F.count("*").alias("clones"))
    stay, children = densify.split(rows, 0.05, 115.0)
    halves = children.agg((F.count("*") / 2).cast("bigint").alias("splits"))
    out = rows.agg(F.count("*").alias("n"), F.sum(densify.prunable(0.49, 12.5, 49.0).cast("bigint")).alias("pruned"))
    return out.crossJoin(copies).crossJoin(halves).select("n", "clones", "splits", "pruned")


_PIX = f"{P}, px AS (SELECT splat_id, scene, i % 3 AS channel, e[i + 1] AS a, round(e[i + 1], 2) AS b FROM p, (SELECT unnest(range(60)) AS i))"


@query(f"WITH {_PIX}, w AS (SELECT scene, avg((a - b) ** 2) AS mse, avg(abs(a - b)) AS l1 FROM px GROUP BY scene), c AS (SELECT scene, avg(-10 * log10(m)) AS by_channel FROM (SELECT scene, channel, avg((a - b) ** 2) AS m FROM px GROUP BY scene, channel) GROUP BY scene) SELECT scene, round(-10 * log10(mse), 6) + 0.0 AS whole, round(by_channel, 6) + 0.0 AS by_channel, round(l1 * 1000, 6) + 0.0 AS l1_e3 FROM w JOIN c USING (scene)")
def image_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as images of three channels against themselves at two decimals; both PSNRs."""
    e = _whole(spark, sf).select("scene", F.posexplode(F.slice("e", 1, 60)).alias("i", "a"))
    rows = e.select("scene", (F.col("i") % 3).alias("channel"), "a", F.round("a", 2).alias("b"))
    whole = images.psnr(rows, ["scene"]).withColumnRenamed("psnr", "whole")
    by_channel = images.psnr(rows, ["scene"], "channel").withColumnRenamed("psnr", "by_channel")
    l1 = images.pixel_errors(rows, ["scene"]).select("scene", r(F.col("l1") * 1000).alias("l1_e3"))
    return whole.join(by_channel, "scene").join(l1, "scene").select("scene", r("whole").alias("whole"), r("by_channel").alias("by_channel"), "l1_e3")


@query("SELECT least(floor((value - 0) / (500 / 20)), 19)::INT AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 500 GROUP BY 1")
def value_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return images.histogram(table(spark, sf, "events"), "value", 0.0, 500.0, 20)


@query(f"WITH {P} SELECT scene, " + ", ".join(f"round(stddev_pop(scales[{i}]), 6) + 0.0 AS s{i}" for i in (1, 2, 3)) + ", round(covar_samp(sh_rest[1], sh_rest[2]), 9) + 0.0 AS cov FROM p GROUP BY scene")
def scale_spreads(spark: SparkSession, sf: str) -> DataFrame:
    rows = prims(spark, sf)
    stds = factor.column_stds(rows, "scales", 3, ["scene"])
    cov = rows.groupBy("scene").agg((F.round(F.covar_samp(F.get("sh_rest", F.lit(0)), F.get("sh_rest", F.lit(1))), 9) + 0.0).alias("cov"))
    return stds.join(cov, "scene").select("scene", *(r(F.col("stds")[i]).alias(f"s{i + 1}") for i in range(3)), "cov")


@query()
def explained_variance(spark: SparkSession, sf: str) -> DataFrame:
    return factor.explained_curve(prims(spark, sf), "sh_rest", 45)


@query("SELECT s_suppkey AS step, round(CASE WHEN s_suppkey < 0 THEN 0 ELSE exp(ln(1.6e-4) * (1 - least(greatest(s_suppkey / 100, 0), 1)) + ln(1.6e-6) * least(greatest(s_suppkey / 100, 0), 1)) * (0.01 + 0.99 * sin(pi() / 2 * least(greatest(s_suppkey / 20, 0), 1))) END * 1e6, 6) + 0.0 AS rate_e6, round(s_suppkey / (2 * tan(0.8 / 2)), 6) + 0.0 AS focal, round(2 * atan(s_suppkey / (2 * 500.0)), 6) + 0.0 AS fov FROM supplier")
def schedules(spark: SparkSession, sf: str) -> DataFrame:
    """Learning rate, focal length and field of view by step."""
    s = F.col("s_suppkey")
    rate = scalars.log_linear_rate(s, 1.6e-4, 1.6e-6, 20, 0.01, 100)
    return table(spark, sf, "supplier").select(s.alias("step"), r(rate * 1e6).alias("rate_e6"), r(scalars.focal_of_fov(F.lit(0.8), s)).alias("focal"), r(scalars.fov_of_focal(F.lit(500.0), s)).alias("fov"))


@query(f"WITH {P} SELECT splat_id, round({SIG}, 6) + 0.0 AS opacity, round(ln(least({SIG}, 0.01) / (1 - least({SIG}, 0.01))), 6) + 0.0 AS reset, round((0.5 - 0.5) / {_C0!r} + (e[4] - 0.5) / {_C0!r}, 6) + 0.0 AS harmonic, round(e[4] * {_C0!r} + 0.5, 6) + 0.0 AS rgb FROM p")
def activations(spark: SparkSession, sf: str) -> DataFrame:
    rows = prims(spark, sf)
    return rows.select("splat_id", r(scalars.sigmoid(F.col("opacity"))).alias("opacity"), r(scalars.reset_opacity(F.col("opacity"))).alias("reset"), r(harmonics.harmonic_of_rgb(F.col("sh_dc"))[0]).alias("harmonic"), r(harmonics.rgb_of_harmonic(F.col("sh_dc"))[0]).alias("rgb"))


@query("WITH n AS (SELECT p_partkey, 'a/b/' || p_name || CASE p_partkey % 4 WHEN 0 THEN '_wb' WHEN 1 THEN '_sqr' WHEN 2 THEN '_test' ELSE '' END AS name, 'f_rest_' || p_partkey AS col, p_size AS bits FROM part) SELECT p_partkey, regexp_replace(name, '(_wb|_sqr|_test)$', '') AS scene, regexp_extract(col, '_([0-9]+)$', 1)::INT AS number, (CASE WHEN bits <= 8 THEN 1 WHEN bits <= 16 THEN 2 ELSE 4 END)::INT AS n_bytes FROM n")
def names(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    tail = F.when(key % 4 == 0, "_wb").when(key % 4 == 1, "_sqr").when(key % 4 == 2, "_test").otherwise("")
    return table(spark, sf, "part").select(key, scalars.scene_name(F.concat(F.lit("a/b/"), "p_name", tail)).alias("scene"), scalars.number_suffix(F.concat(F.lit("f_rest_"), key.cast("string"))).alias("number"), scalars.index_bytes(F.col("p_size")).cast("int").alias("n_bytes"))


@query()
def bit_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Relative error of the rotation codec by bits and scene."""
    return codecs.bits_sweep(_whole(spark, sf), DIM, "e", (1, 2, 3, 4), "scene")


@query()
def codec_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Errors by attribute after the ordered codec and back."""
    options = codecs.Options(ordered=True)
    rows = prims(spark, sf)
    return codecs.attribute_errors(rows, codecs.decompress(codecs.compress(rows, options), options))


@query()
def voxel_codec_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Errors by attribute after the voxel codec without merging."""
    options = codecs.Options(sh_bits=4, dc_bits=8, scale_bits=8)
    rows = prims(spark, sf)
    return codecs.attribute_errors(rows, codecs.decompress_voxels(codecs.compress_voxels(rows, options, threshold=0), options))


@query()
def factor_codec_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Errors by attribute after the factor codec with codebooks by voxel."""
    rows = prims(spark, sf)
    coded, facts = codecs.compress_factors(rows, 32, codecs.Options(sh_bits=4, dc_bits=10, scale_bits=8), grid=4, clusters=16)
    return codecs.attribute_errors(rows, codecs.decompress_factors(coded, facts))
