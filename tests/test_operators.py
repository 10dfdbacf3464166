"""Operators by properties, hand-made cases and round trips."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from radiantlake.functions import geometry, harmonics, scalars
from radiantlake.operators import attributes, bitpack, cameras, codebook, deltas, densify, factor, images, merging, ordering, reports, rotation_codec, uniform
from radiantlake.plans import codecs, queries


@pytest.fixture(scope="module")
def prims(spark, small):
    return attributes.from_embeddings(spark, small).cache()


def test_codebook_levels_are_symmetric_and_errors_fall():
    errors = []
    for bits in (1, 2, 3, 4):
        levels = np.array(codebook.centroids(48, bits))
        assert len(levels) == 1 << bits and (np.diff(levels) > 0).all()
        assert np.allclose(levels, -levels[::-1], atol=1e-9)
        errors.append(codebook.expected_error(48, bits) * 48)
    assert np.allclose(errors, [0.36, 0.117, 0.034, 0.009], atol=0.01)
    assert all(e <= math.sqrt(3) * math.pi / 2 * 4.0**-b for e, b in zip(errors, (1, 2, 3, 4), strict=True))


def test_density_integrates_to_one():
    x = np.linspace(-1, 1, 100_001)
    assert abs(np.trapezoid(codebook.density(x, 48), x) - 1) < 1e-4
    assert (codebook.density(x, 2) == 0.5).all()


def test_rotation_is_proper():
    q = np.array(codebook.rotation(45, 7))
    assert np.allclose(q @ q.T, np.eye(45), atol=1e-12) and np.linalg.det(q) > 0


def test_zero_vector_and_forms_agree(spark):
    d = 9
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([np.zeros(d), *np.random.default_rng(1).standard_normal((20, d))])]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    a = {r.id: (r.c.norm, r.c.codes) for r in df.withColumn("c", rotation_codec.encode(F.col("v"), d, 3)).collect()}
    bulk = rotation_codec.encode_bulk(df, "v", d, 3)
    assert {r.id: r.codes for r in bulk.collect()} == {k: x[1] for k, x in a.items()}
    assert a[0][0] == 0.0
    back = rotation_codec.decode_bulk(bulk, d, 3).collect()
    assert next(r.decoded for r in back if r.id == 0) == [0.0] * d


def test_uniform_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 1.0]), (2, [1.0, 1.0])], "id int, c array<double>")
    got = uniform.quantize(df, {"c": 8})
    assert {tuple(r.c) for r in got.collect()} == {(0, 0)}
    assert {tuple(r.c) for r in uniform.dequantize(got, ["c"]).collect()} == {(1.0, 1.0)}
    halves = spark.createDataFrame([(1, [0.0, 0.5, 1.5, 2.5, 3.0])], "id int, c array<double>")
    assert uniform.quantize(halves, {"c": 2}).first().c == [0, 0, 2, 2, 3]


def test_prune_ties_and_counts(spark, prims):
    rows = prims.limit(10).withColumn("opacity", F.lit(0.0)).withColumn("scales", F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    kept = sorted(r.splat_id for r in ordering.prune(rows, 0.9).collect())
    assert kept == sorted(r.splat_id for r in rows.collect())[:1]
    assert ordering.prune(prims, 0.0).count() == prims.count()
    assert ordering.prune(prims, 0.5).count() == prims.count() // 2
    assert ordering.prune(prims.limit(0), 0.5).count() == 0


def test_morton_against_loop(spark):
    rng = np.random.default_rng(3)
    rows = [tuple(int(v) for v in x) for x in rng.integers(0, 1 << 21, (50, 3))] + [((1 << 21) - 1,) * 3, (0, 0, 0)]
    df = spark.createDataFrame(rows, "x long, y long, z long")
    for r in df.withColumn("m", ordering.morton(F.col("x"), F.col("y"), F.col("z"))).collect():
        assert r.m == sum(((v >> b) & 1) << (3 * b + k) for k, v in enumerate((r.x, r.y, r.z)) for b in range(21))


def test_merge_boundaries(spark):
    def prim(i, x, q, opacity=0.0):
        return (i, [x, 0.0, 0.0], [0.1] * 3, opacity, [0.0] * 3, q, [0.0] * 45, 7, 1.0)

    schema = "splat_id long, xyz array<double>, sh_dc array<double>, opacity double, scales array<double>, rotations array<double>, sh_rest array<double>, voxel long, voxel_size double"
    q = [1.0, 0.0, 0.0, 0.0]
    three = spark.createDataFrame([prim(i, 0.1 * i, q) for i in range(3)], schema)
    kept, merged = merging.voxel_merge(three, 3)
    assert (kept.count(), merged.count()) == (3, 0)
    four = spark.createDataFrame([prim(i, 0.1 * i, [v * (-1) ** i for v in q]) for i in range(4)], schema)
    kept, merged = merging.voxel_merge(four, 3)
    r = merged.first()
    assert kept.count() == 0 and r.n_members == 4 and r.splat_id == 0
    assert np.allclose(r.xyz, [0.15, 0, 0]) and np.allclose(r.rotations, q)
    assert abs(1 / (1 + math.exp(-r.opacity)) - (1 - 0.5**4)) < 1e-9
    assert merging.voxel_merge(four, 3, max_variance=1e-6)[1].count() == 0
    assert merging.voxel_merge(four, 0)[1].count() == 0


def test_delta_wraps_and_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(i, 0, [int(v) for v in x]) for i, x in enumerate(rng.integers(0, 65536, (40, 3)))]
    df = spark.createDataFrame(rows, "i int, s int, v array<int>")
    coded = deltas.delta_encode(df, "v", ["i"], ["s"])
    assert all(-32768 <= v < 32768 for r in coded.collect() for v in r.v)
    back = deltas.delta_decode(coded, "v", 3, ["i"], ["s"])
    assert {r.i: list(r.v) for r in back.collect()} == {i: v for i, _, v in rows}


def test_hemisphere_restarts_at_zero_dot(spark):
    qs = [[1.0, 0, 0, 0], [-1.0, 0, 0, 0], [0.0, 1, 0, 0], [0.0, 1, 0, 0], [0.0, -1, 0, 0]]
    df = spark.createDataFrame([(i, 0, [float(v) for v in q]) for i, q in enumerate(qs)], "i int, s int, rotations array<double>")
    got = [r.sign for r in deltas.hemisphere_signs(df, ["i"], ["s"]).orderBy("i").collect()]
    signs = [1.0]
    for a, b in zip(qs, qs[1:], strict=False):
        d = signs[-1] * float(np.dot(a, b))
        signs.append(-1.0 if d < 0 else 1.0)
    assert got == signs
    sums = deltas.rotation_sums(deltas.rotation_deltas(df, ["i"], ["s"]), ["i"], ["s"]).orderBy("i").collect()
    assert np.allclose([r.rotations for r in sums], [[s * v for v in q] for s, q in zip(signs, qs, strict=True)])


@pytest.mark.parametrize("bits", [2, 3, 4, 8])
@pytest.mark.parametrize("rows,width", [(1, 1), (3, 5), (7, 9)])
def test_bit_streams(spark, bits, rows, width):
    rng = np.random.default_rng(bits)
    data = [(0, i, [int(v) for v in rng.integers(0, 1 << bits, width)]) for i in range(rows)]
    df = spark.createDataFrame(data, "s int, ordinal long, c array<int>")
    packed = bitpack.pack_stream(df, "c", width, bits, ["s"])
    text = "".join(format(v, f"0{bits}b") for _, _, c in data for v in c)
    group = {2: 8, 3: 24, 4: 8, 8: 8}[bits]
    text += "0" * (-len(text) % group)
    assert [r.byte for r in packed.orderBy("at").collect()] == [int(text[i : i + 8], 2) for i in range(0, len(text), 8)]
    back = bitpack.unpack_stream(packed, width, bits, ["s"], F.lit(rows * width)).orderBy("ordinal", "j").collect()
    assert [r.code for r in back] == [v for _, _, c in data for v in c]
    own = df.select(bitpack.unpacked(bitpack.packed(F.col("c"), width, bits), width, bits).alias("u"), "c").collect()
    assert all(list(r.u) == list(r.c) for r in own)


def test_byte_planes(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([1, 65535, 4660])], "s int, ordinal long, v int")
    out = bitpack.byte_shuffled(df, "v", 2, ["s"])
    assert [r.byte for r in out.orderBy("at").collect()] == list(np.array([1, 65535, 4660], dtype="<u2").view("u1").reshape(-1, 2).T.ravel())
    assert [r.value for r in bitpack.byte_unshuffled(out, 2, ["s"]).orderBy("ordinal").collect()] == [1, 65535, 4660]
    assert [r.value for r in bitpack.byte_unshuffled(out, 2, ["s"], signed=True).orderBy("ordinal").collect()] == [1, -1, 4660]


def test_ratio_rules(spark):
    cases = [(1.0, 0.0), (1.0, 5e-5), (-1.0, 5e-5), (1.0, -2.0), (-1.0, -2.0), (2.0, 4.0), (0.0, 0.0)]
    df = spark.createDataFrame(cases, "a double, b double")
    got = {rule: [r[0] for r in df.select(reports.ratio(F.col("a"), F.col("b"), rule)).collect()] for rule in ("exact", "small", "signed")}
    inf = math.inf
    assert got["exact"][:2] == [inf, 1.0 / 5e-5] and got["small"][0] == inf
    assert got["signed"][:2] == [inf, inf] and math.isnan(got["signed"][2]) and got["signed"][3:6] == [inf, 0.5, 0.5] and math.isnan(got["signed"][6])


def test_reports_edges(spark):
    df = spark.createDataFrame([("a", "train", 1.0), ("a", "test", 3.0), ("b", "train", 2.0)], "s string, split string, v double")
    got = {r.s: r.gap for r in reports.train_test_gap(df, ["s"], "v").collect()}
    assert got["a"] == -2.0 and math.isnan(got["b"])
    many = spark.createDataFrame([(0, i) for i in range(10)], "s int, i int")
    pick = lambda n: sorted(r.i for r in reports.evenly_spaced(many, ["i"], n, ["s"]).collect())
    assert pick(20) == list(range(10)) and pick(2) == [0, 9] and pick(1) == [0] and pick(3) == [0, 4, 9]
    values = [3.0, 1.0, 4.0, 1.0, 5.0]
    ema = 0.0
    for v in values:
        ema = 0.4 * v + 0.6 * ema
    seq = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "s int, i int, v double")
    assert abs(reports.smoothed(seq, "v", ["s"], "i").first().smoothed - ema) < 1e-12
    odd = spark.createDataFrame([("x", 1.0, None), ("x", math.inf, None), ("x", math.nan, None), ("x", 9.0, "failed")], "s string, v double, error string")
    assert reports.rolled_means(odd, "s", ["v"]).where("s is not null").first().v == 1.0


def test_rotations_round_trip(spark):
    rng = np.random.default_rng(2)
    qs = rng.standard_normal((20, 4))
    qs /= np.linalg.norm(qs, axis=1, keepdims=True)
    qs *= np.where(qs[:, :1] < 0, -1, 1)
    df = spark.createDataFrame([(i, [float(v) for v in q]) for i, q in enumerate(qs)], "i int, q array<double>").withColumn("m", geometry.rotation_matrix(F.col("q")))
    for r in df.withColumn("b", geometry.quaternion("m")).collect():
        m = np.array(r.m)
        assert np.allclose(m @ m.T, np.eye(3), atol=1e-9) and np.allclose(r.b, r.q, atol=1e-6)


def test_camera_matrices(spark):
    m = [[0.0, -1.0, 0.0, 2.0], [1.0, 0.0, 0.0, 3.0], [0.0, 0.0, 1.0, 4.0], [0.0, 0.0, 0.0, 1.0]]
    df = spark.createDataFrame([(m,)], "m array<array<double>>")
    r = df.select(geometry.rigid_inverse(F.col("m")).alias("i"), geometry.flip_axes(F.col("m")).alias("f")).first()
    assert np.allclose(np.array(r.i) @ np.array(m), np.eye(4))
    assert np.allclose(np.array(r.f)[:, 1:3], -np.array(m)[:, 1:3])
    inv = np.array(r.i)
    cam = spark.createDataFrame([([[float(v) for v in row[:3]] for row in inv[:3]], [float(v) for v in inv[:3, 3]], [1.0, 1.0, 1.0])], "r array<array<double>>, t array<double>, p array<double>")
    got = cam.select(geometry.camera_center(F.col("r"), F.col("t")).alias("c"), geometry.world_to_view(F.col("r"), F.col("t")).alias("v"), geometry.world_to_view(F.col("r"), F.col("t"), F.array(*(F.lit(1.0),) * 3), 2.0).alias("w"), geometry.project_point(geometry.projection(0.01, 100.0, F.lit(1.0), F.lit(1.0)), F.col("p")).alias("x")).first()
    assert np.allclose(got.c, [2, 3, 4]) and np.allclose(got.v, inv)
    assert np.allclose(np.linalg.inv(np.array(got.w))[:3, 3], [6, 8, 10])
    assert abs(got.x[0] - 1 / math.tan(0.5) / (1 + 1e-7)) < 1e-9


def test_harmonics_are_orthonormal(spark):
    """Gauss points in z, even steps in the angle: exact for products to degree 8."""
    z, w = np.polynomial.legendre.leggauss(12)
    angles = np.arange(24) * 2 * math.pi / 24
    rows = [(float(math.sqrt(1 - a * a) * math.cos(t)), float(math.sqrt(1 - a * a) * math.sin(t)), float(a), float(b) * 2 * math.pi / 24) for a, b in zip(z, w, strict=True) for t in angles]
    df = spark.createDataFrame(rows, "x double, y double, z double, w double")
    got = df.select(F.array(*harmonics.basis(4, F.col("x"), F.col("y"), F.col("z"))).alias("b"), "w").collect()
    b, weight = np.array([r.b for r in got]), np.array([r.w for r in got])
    assert np.allclose(b.T @ (b * weight[:, None]), np.eye(25), atol=1e-9)


def test_scalars(spark):
    df = spark.createDataFrame([(-800.0,), (0.0,), (800.0,)], "x double")
    assert [r[0] for r in df.select(scalars.sigmoid(F.col("x"))).collect()] == [0.0, 0.5, 1.0]
    one = spark.range(1)
    got = one.select(
        scalars.resized(F.lit(3201), F.lit(1000)).alias("cap"), scalars.resized(F.lit(1500), F.lit(1000)).alias("free"), scalars.resized(F.lit(1001), F.lit(999), 2).alias("half"),
        scalars.composite(F.lit(0.5), F.lit(0.5), True).alias("white"), scalars.stem(F.lit("a/b.c/d.e.png")).alias("stem"), scalars.number_suffix(F.lit("f_rest_12")).alias("n"), scalars.number_suffix(F.lit("x")).alias("none"),
    ).first()
    assert tuple(got.cap) == (1600, 499) and tuple(got.free) == (1500, 1000) and tuple(got.half) == (500, 500)
    assert got.white == 191 and got.stem == "d.e" and got.n == 12 and got.none is None


def test_factors(spark, prims):
    x = np.array([r.sh_rest for r in prims.select("sh_rest").collect()])
    n, mean, cov = factor.moments(prims, "sh_rest", 45)
    assert n == len(x) and np.allclose(mean, x.mean(axis=0)) and np.allclose(cov, np.cov(x.T), atol=1e-12)
    rows, values = factor.components(cov, 45)
    assert abs(factor.explained(values)[-1] - 1) < 1e-9
    back = factor.unproject(factor.project(prims, "sh_rest", mean, rows), "projected", mean, rows, "again")
    assert all(np.allclose(r.again, r.sh_rest, atol=1e-9) for r in back.select("again", "sh_rest").collect())
    assert factor.moments(prims.limit(0), "sh_rest", 45)[0] == 0


def test_codebooks_by_voxel(spark, prims):
    rows = ordering.voxel_keys(prims.withColumn("shape", attributes.shape_vector()), 3)
    books = factor.voxel_codebooks(rows, "shape", clusters=8)
    sizes = {r.voxel: r.n for r in rows.groupBy("voxel").agg(F.count("*").alias("n")).collect()}
    assert {r.voxel: len(r.codebook) for r in books.collect()} == {v: min(n, 8) for v, n in sizes.items()}
    coded = factor.code_rows(rows, "shape", books)
    back = factor.decode_rows(coded, books, "near", 8).collect()
    assert len(back) == prims.count()
    for r in back:
        if sizes[r.voxel] <= 8:
            assert np.allclose(r.near, r.shape)
    lost = spark.createDataFrame([(999, 3)], "voxel long, code int")
    assert factor.decode_rows(lost, books, "near", 8).first().near == [0.0] * 8
    firsts = factor.codebook_offsets(books).orderBy("voxel").collect()
    assert [r.first for r in firsts] == [0, *np.cumsum([r.n for r in firsts])[:-1]]


def test_growth(spark, prims):
    seen = spark.createDataFrame([(1, 0.5, 0.0), (1, 0.7, 2.0), (2, 0.9, 0.0)], "splat_id int, gradient double, radius double")
    got = {r.splat_id: (r.gradient, r.radius) for r in densify.gradient_means(seen).collect()}
    assert got == {1: (0.7, 2.0), 2: (0.0, 0.0)}
    rows = prims.withColumn("gradient", F.lit(1.0)).withColumn("radius", F.lit(1.0))
    stay, children = densify.split(rows, 0.5, 0.001)
    assert stay.count() == 0 and children.count() == 2 * prims.count()
    pair = children.join(prims.select("splat_id", F.col("scales").alias("was")), "splat_id").first()
    assert np.allclose(np.array(pair.was) - np.array(pair.scales), math.log(1.6))
    assert densify.densified(rows, 0.5, 1e6, 0.0).count() == 2 * prims.count()
    cloud = densify.random_cloud(spark, 300)
    near = {r.point_id: r.distance2 for r in densify.nearest_distances(cloud, 5.2).collect()}
    x = np.array([r.xyz for r in cloud.orderBy("point_id").collect()])
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    assert all(abs(near[i] - d[i].min()) < 1e-9 for i in range(300))
    assert densify.seeded(cloud, 1.0).count() == 300


def test_images(spark):
    a = np.random.default_rng(0).random((16, 16, 3))
    assert abs(images.structural_similarity(a, a) - 1) < 1e-12
    assert images.structural_similarity(a, 1 - a) < 0.5
    df = spark.createDataFrame([(0, 1.0, 1.0)], "i int, a double, b double")
    assert images.psnr(df, ["i"]).first().psnr == math.inf
    flat = [float(v) for v in a.ravel()]
    assert abs(images.ssim(spark.createDataFrame([(flat, flat, 16, 16)], "a array<double>, b array<double>, height int, width int"), "a", "b").first().ssim - 1) < 1e-12
    grid = spark.createDataFrame([([0.0, 1.0, 2.0, 3.0], 2, [0.5, 1.0, 9.0], [0.5, 0.0, 9.0])], "g array<double>, w int, x array<double>, y array<double>")
    assert grid.select(images.bilinear("g", "w", "x", "y").alias("v")).first().v == [1.5, 1.0, 3.0]


def test_depth_fit_rules(spark):
    few = spark.createDataFrame([(0, float(i), float(2 * i)) for i in range(10)], "g int, t double, s double")
    assert tuple(cameras.depth_fit(few, "g", "t", "s").first())[1:] == (0.0, 0.0)
    more = spark.createDataFrame([(0, 3.0 * i + 1, float(i)) for i in range(11)], "g int, t double, s double")
    assert np.allclose(tuple(cameras.depth_fit(more, "g", "t", "s").first())[1:], (3.0, 1.0))


def test_containers_and_options(spark, prims):
    options = codecs.Options(ordered=True, sh_bits=3)
    coded = codecs.compress(prims, options).cache()
    arrays = codecs.to_arrays(coded, options)
    again = codecs.decompress(codecs.from_arrays(spark, arrays, options), options)
    want = codecs.decompress(coded, options)
    ids = [r.splat_id for r in coded.orderBy("morton", "splat_id").select("splat_id").collect()]
    by = {r.splat_id: r for r in want.collect()}
    for r in again.collect():
        w = by[ids[r.splat_id]]
        assert np.allclose(r.xyz, w.xyz) and np.allclose(r.sh_rest, w.sh_rest, atol=2e-3) and abs(r.opacity - w.opacity) < 1e-9
    assert codecs.Options().aggressive() == codecs.Options(prune_ratio=0.5, sh_degree=2, sh_bits=2, pos_bits=12, dc_bits=8, scale_bits=8, opacity_bits=6)
    assert codecs.Options(sh_bits=4).aggressive().sh_bits == 4
    assert codecs.stored_bits(codecs.Options(sh_bits=2, sh_degree=2, dc_bits=10, scale_bits=10, rot_bits=10)) == 48 + 30 + 30 + 40 + 8 + 48 + 16


def test_voxel_codec_merges(spark, prims):
    options = codecs.Options(sh_bits=2, sh_degree=2, dc_bits=8, scale_bits=8)
    back = codecs.decompress_voxels(codecs.compress_voxels(prims, options, resolution=4), options)
    stats = merging.merge_statistics(ordering.voxel_keys(prims, 4)).first()
    assert back.count() == stats.n_after < prims.count()


def test_noise(spark, prims):
    rows = prims.select("splat_id", "sh_rest")
    same = {r.splat_id: r.sh_rest for r in rows.collect()}
    assert {r.splat_id: r.sh_rest for r in rotation_codec.with_noise(rows, "sh_rest", 45, 2, training=False).collect()} == same
    changed = sum(r.sh_rest != same[r.splat_id] for r in rotation_codec.with_noise(rows, "sh_rest", 45, 2, 0.5).collect())
    assert 0.3 * len(same) < changed < 0.7 * len(same)


def test_sweep(spark, small):
    rows = {(r.bits, r.scene): r.nmse for r in queries.bit_sweep(spark, small).collect()}
    for scene in {s for _, s in rows}:
        assert rows[1, scene] > rows[2, scene] > rows[3, scene] > rows[4, scene]


def test_small_reports(spark, prims):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 2.0), ("b", 2, 4.0)], "s string, k int, v double")
    assert sorted(map(tuple, reports.summary(df, "s", "k", [1, 2], "v").collect())) == [("a", 1.5, None), ("b", None, 4.0)]
    ids = [r.splat_id for r in reports.shuffled(prims, "splat_id", 3).select("splat_id").collect()]
    assert ids != sorted(ids) and ids == [r.splat_id for r in reports.shuffled(prims.repartition(3), "splat_id", 3).select("splat_id").collect()]
    assert reports.same_rows(df, df.orderBy("v")) and not reports.same_rows(df, df.union(df))
    shots = spark.createDataFrame([("x",), ("y",)], "name string")
    light = spark.createDataFrame([("x", [[1.0]])], "name string, matrix array<array<double>>")
    assert {r.name: r.matrix for r in cameras.with_exposure(shots, light).collect()} == {"x": [[1.0]], "y": None}


def test_scene_report(spark, prims):
    r = codecs.scene_report(prims, codecs.Options(prune_ratio=0.5)).first()
    assert r.n_after == r.n_before // 2 and r.ratio > 4 and 0 < r.sh_rest < 0.2
    rows = codecs.factor_sweep(prims, (8, 45)).where("attribute = 'sh_rest'").collect()
    assert {x.components: x.nmse for x in rows}[45] < {x.components: x.nmse for x in rows}[8]
