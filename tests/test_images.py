"""Resampling, distances, augmentation and tiles against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinframe.operators import audit, augment, geometry, grid, resample, split


def frames_of(spark, *images):
    return spark.createDataFrame([(i, *a.shape, a.ravel().tolist()) for i, a in enumerate(images)], "frame_id int, height int, width int, v array<double>")


def brute_distances(marks):
    at = np.argwhere(marks)
    return np.array([[min((math.dist((y, x), p) for p in at), default=math.inf) for x in range(marks.shape[1])] for y in range(marks.shape[0])])


@pytest.mark.parametrize("share", [0.0, 0.01, 0.1, 0.6, 1.0])
def test_distances_against_brute_force(share):
    rng = np.random.default_rng(int(share * 100))
    for shape in ((1, 1), (1, 40), (37, 1), (31, 44)):
        marks = rng.random(shape) < share
        if share == 0.01:
            marks[:] = False
            marks[0, 0] = True  # one corner: all else is far
        assert np.allclose(grid.distances(marks), brute_distances(marks))


def test_edges_of_frames_and_of_points_agree(spark):
    rng = np.random.default_rng(4)
    a, b, valid = (rng.random((40, 30)) < p for p in (0.02, 0.03, 0.9))
    a[35:, 25:] = True  # far from all of b
    b[10:, :] = False
    d = np.concatenate([brute_distances(b & valid)[a & valid], brute_distances(a & valid)[b & valid]])
    want = [*np.percentile(d, [50, 75, 90]), np.mean(d <= 1.5)]
    assert want[2] > 20
    columns = [F.array(*(F.lit(float(x)) for x in m.ravel())) for m in (a, b, valid)]
    got = spark.range(1).select(grid.edge_agreement(*columns, F.lit(40), F.lit(30)).alias("d")).first()["d"]
    assert np.allclose(tuple(got), want)
    rows = lambda m: spark.createDataFrame([("f", int(y) - 7, int(x) + 900) for y, x in np.argwhere(m & valid)] + [("odd", None, 3)], "k string, y int, x int")
    assert np.allclose(tuple(grid.chamfer(rows(a), rows(b), "k").first())[1:], want)
    one = spark.createDataFrame([("only a", 1, 1)], "k string, y int, x int")
    assert tuple(grid.chamfer_rating(grid.chamfer(one, one.where("false"), "k")).first()) == ("only a", None, None, None, 0.0, "unavailable")
    assert grid.chamfer(one.where("false"), one.where("false"), "k").count() == 0


def test_resampling():
    a = np.random.default_rng(1).random((9, 14))
    for how in ("lanczos", "bilinear", "area"):
        assert np.allclose(resample.resampled(a, 9, 14, how), a)
        assert np.allclose(resample.resampled(np.full((9, 14), 3.5), 4, 5, how), 3.5)
        assert np.allclose(resample.weights(14, 5, how).sum(axis=1), 1)
    # areas by counting in the smallest common steps
    fine = np.repeat(np.repeat(a, 4, axis=0), 5, axis=1)
    assert np.allclose(resample.resampled(a, 4, 5, "area"), fine.reshape(4, 9, 5, 14).mean(axis=(1, 3)))
    assert np.allclose(resample.weights(4, 2, "bilinear")[0], np.array([0.75, 0.75, 0.25, 0]) / 1.75)
    whole = resample.resampled(np.random.default_rng(2).integers(0, 256, (40, 50)).astype(float), 32, 32, "lanczos", 255)
    assert (whole == np.floor(whole)).all() and whole.min() >= 0 and whole.max() <= 255
    with pytest.raises(ValueError, match="shrink"):
        resample.weights(3, 5, "area")
    assert resample.fitted(100, 50, 40) == (40, 20) and resample.fitted(10, 5, 40) == (10, 5) and resample.fitted(1000, 1, 40) == (40, 1)


def test_rotation():
    a = np.arange(35.0).reshape(5, 7)
    assert augment.rotated(a, 0.0) is a
    square = np.random.default_rng(1).random((6, 6))
    assert np.allclose(augment.rotated(square, 90.0), np.rot90(square))
    assert np.allclose(augment.rotated(square, -90.0), np.rot90(square, -1))
    assert np.allclose(augment.rotated(np.full((8, 5), 2.0), 5.0), 2.0)  # nothing dark comes in at the corners
    there = augment.rotated(augment.rotated(np.outer(np.arange(30.0), np.ones(30)), 4.0), -4.0)
    assert np.abs(there - np.outer(np.arange(30.0), np.ones(30)))[5:-5, 5:-5].max() < 1e-6


def test_colour():
    import colorsys

    rng = np.random.default_rng(3)
    rgb = rng.random((3, 50))
    rgb[:, 0], rgb[:, 1] = 0.4, [1, 1, 0]
    assert np.allclose(augment.coloured(rgb, 1, 1, 1, 0.0), rgb)
    assert np.allclose(augment.coloured(rgb, 1, 1, 1, 1.0), rgb)
    turned = augment.coloured(rgb, 1, 1, 1, 0.3)
    for i in range(50):
        h, s, v = colorsys.rgb_to_hsv(*rgb[:, i])
        assert np.allclose(turned[:, i], colorsys.hsv_to_rgb((h + 0.3) % 1, s, v))
    grey = np.tensordot(augment.GREY, rgb, 1)
    assert np.allclose(augment.coloured(rgb, 1, 1, 0, 0.0), grey)
    assert np.allclose(augment.coloured(rgb, 1, 0, 1, 0.0), grey.mean())
    assert np.allclose(augment.coloured(rgb, 2, 1, 1, 0.0), np.clip(2 * rgb, 0, 1))


def test_draws(spark):
    s = spark.range(4000).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("sample_id"), F.lit(20).alias("height"), F.lit(9).alias("width"))
    p = augment.augment_params(s, 1, 2, 10, flip=0.3, flip_v=0.0, rotate=0.6, degrees=7.0, colour=1.0, hue=0.5).toPandas()
    assert p.equals(augment.augment_params(s.repartition(7), 1, 2, 10, flip=0.3, flip_v=0.0, rotate=0.6, degrees=7.0, colour=1.0, hue=0.5).toPandas().sort_values("sample_id", key=lambda c: c.str[1:].astype(int), ignore_index=True))
    assert set(p["crop_y"]) == set(range(11)) and set(p["crop_x"]) == {0} and not p["flip_v"].any()
    assert 0.25 < p["flip"].mean() < 0.35 and 0.55 < (p["angle"] != 0).mean() < 0.65 and p["angle"].abs().max() <= 7
    assert 0.9 <= p["brightness"].min() < 0.91 and 1.09 < p["contrast"].max() <= 1.1 and 0.4 < p["hue"].max() <= 0.5
    still = augment.augment_params(s, 1, 2, 10, training=False).first()
    assert tuple(still)[1:] == (5, 0, 0.0, False, False, 1.0, 1.0, 1.0, 0.0)
    with pytest.raises(ValueError, match="no probability"):
        augment.augment_params(s, 1, 2, 10, rotate=1.5)


def test_all_that_is_drawn_is_applied(spark):
    a = np.random.default_rng(5).random((12, 15))
    f = frames_of(spark, a, a).withColumn("u", F.transform("v", lambda x: -x))
    p = spark.createDataFrame([(0, 1, 2, 12.0, True, True), (1, 0, 0, 0.0, False, False)], "frame_id int, crop_y int, crop_x int, angle double, flip boolean, flip_v boolean")
    first, second = augment.apply_geometry(f, p, 8, ("v", "u")).orderBy("frame_id").collect()
    want = augment.rotated(a[1:9, 2:10], 12.0)[::-1, ::-1]
    assert np.allclose(first["v"], want.ravel()) and np.allclose(first["u"], -want.ravel()) and np.allclose(second["v"], a[:8, :8].ravel())
    rgb = f.select("frame_id", F.col("v").alias("r"), F.reverse("v").alias("g"), F.transform("v", lambda x: x / 2).alias("b"), F.lit(3).alias("brightness"))
    k = spark.createDataFrame([(0, 1.1, 0.9, 1.2, 0.1)], "frame_id int, brightness double, contrast double, saturation double, hue double")
    got = augment.apply_colour(rgb, k).first()
    assert np.allclose([got["r"], got["g"], got["b"]], augment.coloured(np.array([a.ravel(), a.ravel()[::-1], a.ravel() / 2]), 1.1, 0.9, 1.2, 0.1)) and got["brightness"] == 3


def test_tiles_are_padded_and_weighted(spark):
    w = grid.hann(4)
    one = [0.0, 0.75, 0.75, 0.0]
    assert np.allclose(w, np.maximum(1e-3, np.outer(one, one))) and (grid.hann(1) == 1).all()
    seen = []
    f = frames_of(spark, np.arange(15.0).reshape(3, 5))
    got = grid.score_tiled(f, lambda t: t + t.shape[-1], 8, 2, factor=4).first()
    assert got["v"] == [x + 8 for x in range(15)] and (got["height"], got["width"]) == (3, 5) and not seen
    mirrored = grid.score_tiled(frames_of(spark, np.arange(20.0).reshape(4, 5)), lambda t: t * 0 + t.sum(axis=(1, 2), keepdims=True), 6, 2).first()["v"]
    assert set(mirrored) == {np.pad(np.arange(20.0).reshape(4, 5), [(0, 2), (0, 1)], mode="reflect").sum()}
    for tile, overlap, factor in ((6, 2, 4), (0, 0, 1), (4, 4, 1)):
        with pytest.raises(ValueError, match="tile"):
            grid.score_tiled(f, lambda t: t, tile, overlap, factor)


def test_sharpness_shrinks_wide_frames(spark):
    a = np.random.default_rng(2).random((7, 20))
    v, h, w = (F.col(c) for c in ("v", "height", "width"))
    f = frames_of(spark, a)
    small = resample.resampled(a, int(7 * 10 / 20), 10, "area")
    got = f.select(grid.sharpness(v, h, w, 10).alias("s"), grid.sharpness(v, h, w).alias("t")).first()
    wide = lambda x: np.pad(x, 1, mode="reflect")
    laplace = lambda x: wide(x)[1:-1, :-2] + wide(x)[1:-1, 2:] + wide(x)[:-2, 1:-1] + wide(x)[2:, 1:-1] - 4 * x
    assert np.isclose(got["s"], laplace(small).var()) and np.isclose(got["t"], laplace(a).var())


def brute_targets(n, ratio):
    """All ways to share n groups; the one that takes the whole parts, then the rest by remainder, share and order."""
    raw = [n * (1 - ratio), n * ratio]
    got = [max(1, math.floor(x)) for x in raw]
    order = sorted((0, 1), key=lambda k: (-(raw[k] - math.floor(raw[k])), -(1 - ratio, ratio)[k], k))
    for k in order:
        if sum(got) < n:
            got[k] += 1
    return min(n - 1, got[1])


def test_targets_of_ties():
    for n, ratio in itertools.product(range(2, 40), (0.1, 0.15, 0.2, 0.25, 0.3, 0.5, 0.75)):
        assert split.target_groups(n, ratio) == brute_targets(n, ratio)
    assert [split.target_groups(*x) for x in ((5, 0.3), (6, 0.25), (10, 0.15), (10, 0.25), (3, 0.5), (2, 0.9))] == [1, 1, 1, 2, 1, 1]


def test_medoids_against_brute_force(spark):
    rng = random.Random(8)
    h = lambda: [1 + rng.gauss(0, 0.02), rng.gauss(0, 0.02), rng.gauss(0, 3), rng.gauss(0, 0.02), 1 + rng.gauss(0, 0.02), rng.gauss(0, 3), rng.gauss(0, 1e-4), rng.gauss(0, 1e-4), 1.0]
    groups = {g: [h() for _ in range(rng.randint(1, 6))] for g in range(40)}
    global_ = {g: h() for g in groups}
    at = [(x, y) for y in (0, 49.5, 99) for x in (0, 99.5, 199)]
    see = lambda m: [((m[0] * x + m[1] * y + m[2]) / (m[6] * x + m[7] * y + m[8]), (m[3] * x + m[4] * y + m[5]) / (m[6] * x + m[7] * y + m[8])) for x, y in at]
    far = lambda a, b: float(np.median([math.dist(p, q) for p, q in zip(see(a), see(b), strict=True)]))
    models = spark.createDataFrame([(g, i, m) for g, ms in groups.items() for i, m in enumerate(ms)], "g int, name int, h array<double>")
    reference = spark.createDataFrame(list(global_.items()), "g int, h array<double>")
    pairs, whole = ({r["g"]: tuple(r)[1:] for r in geometry.select_medoid(models, ["g"], "name", 200.0, 100.0, ref).collect()} for ref in (None, reference))
    for g, ms in groups.items():
        d = [[0.0 if i == j else far(a, b) for j, b in enumerate(ms)] for i, a in enumerate(ms)]
        best = int(np.argmin(np.median(d, axis=1)))
        assert np.allclose(pairs[g], (best, np.median(d[best]), max(d[best])))
        d = [far(a, global_[g]) for a in ms]
        assert np.allclose(whole[g], (int(np.argmin(d)), np.median(d), max(d)))


def test_frames_are_made_once_for_their_pixels(spark):
    """Frames without pixels, and null pixels, have no rows; Spark must not make every frame twice to find that out."""
    rows = [(0, 2, 2, [1.0, None, 3.0, 4.0], 0), (1, 0, 0, [], 0), (2, 2, 2, None, 0), (3, 1, 2, [5.0, 6.0], 1)]
    frames = spark.createDataFrame(rows, "frame_id int, height int, width int, v array<double>, crop_y int")
    flat = grid.to_pixels(frames)
    assert sorted(tuple(r) for r in flat.collect()) == [(0, 0, 0, 1.0), (0, 1, 0, 3.0), (0, 1, 1, 4.0), (3, 0, 0, 5.0), (3, 0, 1, 6.0)]
    whole = frames.where("frame_id = 3").select("frame_id", "height", "width", "v")
    turned = grid.to_pixels(augment.apply_geometry(whole, whole.select("frame_id", F.lit(0).alias("crop_y"), F.lit(0).alias("crop_x"), F.lit(True).alias("flip")), 1))
    assert turned._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [tuple(r) for r in turned.collect()] == [(3, 0, 0, 5.0)]


def test_models_are_seen_once_by_the_medoid(spark):
    """Sums in another order give other last digits each time a model is made; the two of a group are still equally far apart."""
    def made(frames):
        rng = np.random.default_rng()
        for f in frames:
            f["h"] = [[1.0, 0.0, x, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0] for x in f["name"] + rng.normal(0, 1e-12, len(f))]
            yield f

    names = spark.range(400).selectExpr("id div 2 as g", "cast(id % 2 as int) as name")
    out = geometry.select_medoid(names.mapInPandas(made, "g bigint, name int, h array<double>"), ["g"], "name", 200.0, 100.0).collect()
    assert len(out) == 200 and {r["medoid"] for r in out} == {0}


def test_gates(spark):
    issues = spark.createDataFrame([], "level string, code string")
    version = spark.createDataFrame([("d", True, 2, "nested")], "digest string, formal boolean, schema_version int, algorithm string")
    about = lambda *row: spark.createDataFrame([row], "digest string, audit_level string, formal_ready boolean")
    audit.assert_usable(version, "d", issues, about("d", "full", True), "nested", 2)
    for row, algorithm, schema, what in ((("e", "full", True), "nested", 2, "audit_digest"), (("d", "basic", True), "nested", 2, "audit_level"), (("d", "full", None), "nested", 2, "audit_ready"), (("d", "full", True), "other", 2, "algorithm"), (("d", "full", True), "nested", 1, "schema")):
        with pytest.raises(ValueError, match=what):
            audit.assert_usable(version, "d", issues, about(*row), algorithm, schema)
    with pytest.raises(ValueError, match="audit_digest"):
        audit.assert_usable(version, "d", issues, about("d", "full", True).where("false"), "nested", 2)
    rows = spark.createDataFrame([(1, 0.5, True, None), (2, float("nan"), True, True), (3, None, None, True), (4, 0.05, True, False)], "id int, edge_correlation double, usable boolean, preview_exists boolean")
    assert [tuple(r) for r in audit.registration_review(rows).orderBy("id").select("id", "review", "note").collect()] == [(1, "pass_information_only", "missing_sync_preview"), (2, "manual_review", "edge_correlation_unavailable"), (4, "manual_review", "missing_sync_preview")]


def test_readiness_wants_the_exact_set(spark):
    rows = [("whole", c, f"{c}1") for c in "ab"] + [("two clips", "a", "x"), ("two clips", "a", "y"), ("two clips", "b", "z")] + [("more", c, c) for c in "abq"] + [("less", "a", "a")]
    s = spark.createDataFrame(rows, "experiment_key string, category string, clip_id string")
    assert [r["experiment_key"] for r in audit.complete_experiments(s, ["a", "b"]).collect()] == ["whole"]
    assert {r["complete_experiments"] for r in audit.readiness(s, ["a", "b"]).collect()} == {1}
    assert audit.complete_experiments(s, ["a"], 2).count() == 0
