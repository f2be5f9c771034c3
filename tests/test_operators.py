"""Small cases: refusals, determinism, identities, files and streams."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinframe.functions import keys
from twinframe.operators import audit, augment, geometry, grid, neardup, pairing, series, split
from twinframe.sources import scans, sinks
from twinframe.streaming.intake import start_intake


def make_samples(spark, experiments=6, categories=("a", "b", "c"), clips=1, groups=None):
    rows = [(f"s{e}{c}{k}", f"e{e}", c, f"e{e}{c}{k}", f"g{(groups or experiments) and e % (groups or experiments)}", True, f"{e}{c}{k}", 1) for e in range(experiments) for c in categories for k in range(clips)]
    return spark.createDataFrame(rows, "sample_id string, experiment_key string, category string, clip_id string, leakage_group_id string, usable boolean, sha string, n_chars int")


def png(width, height, grey):
    raw = b"".join(b"\0" + bytes([grey] * 3 * width) for _ in range(height))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_keys(spark):
    assert one(spark, keys.norm_id(F.lit(" Day12345 "), "day")) == "day12345" and one(spark, keys.norm_id(F.lit("day 1"), "day")) is None
    assert one(spark, keys.norm_id(F.lit("x7"), "day")) is None
    assert one(spark, keys.safe_path(F.lit("C:\\outside\\x"))) is None
    assert one(spark, keys.safe_path(F.lit("a\\b"))) == "a/b"
    assert one(spark, keys.safe_path(F.lit("a/../b"))) is None
    assert one(spark, keys.source_ref(F.lit("/x/input/day1/c.mp4"))) == "day1/c.mp4"
    assert one(spark, keys.source_ref(F.lit("x/c.mp4"))) == "c.mp4"
    assert one(spark, keys.parse_bool(F.lit("maybe"))) is None


def test_contract(spark):
    ok = audit.experiment_contract(make_samples(spark), ["a", "b", "c"])
    assert ok.where("not ok").count() == 0
    assert audit.experiment_contract(make_samples(spark, categories=("a", "b")), ["a", "b", "c"]).where("missing = 'c'").count() == 6
    assert audit.experiment_contract(make_samples(spark, clips=2), ["a", "b", "c"]).where("bad_clip_counts = 3").count() == 6


@pytest.mark.parametrize("seed", [42, 43])
def test_split_sizes(spark, seed):
    got = split.nested_group_split(make_samples(spark), seed=seed, trials=32).groupBy("inner_split").count().collect()
    assert {r["inner_split"]: r["count"] for r in got} == {"train": 4, "val": 1, "test": 1}


def test_split_refuses_few_groups(spark):
    with pytest.raises(ValueError, match="fewer than 6"):
        split.nested_group_split(make_samples(spark, 5))


def test_split_is_repeatable_and_keeps_groups_whole(spark):
    rows = make_samples(spark, 12, groups=6)
    runs = [sorted(map(tuple, split.nested_group_split(rows, trials=16).collect())) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == 6


def test_leak_is_fatal(spark):
    """One content in all splits, in one split alone, null and empty: only the first is fatal, and it closes the gates."""
    rows = make_samples(spark)
    groups = split.nested_group_split(rows, trials=8)
    test = next(r["leakage_group_id"] for r in groups.collect() if r["inner_split"] == "test")
    rows = rows.withColumn("sha", F.when(F.col("category") == "a", "same").when(F.col("category") == "b", "").otherwise(F.lit(None)))
    rows = rows.withColumn("rgb", F.when(F.col("leakage_group_id") == test, F.col("sample_id")).when(F.col("category") == "c", "train only"))
    members = pairing.split_members(rows, groups.where("inner_split <> 'val'"))
    found = audit.exact_duplicates(rows, members, {"ir": "sha", "rgb": "rgb"})
    assert {(r["modality"], r["sha"], r["level"], r["copies"]) for r in found.collect()} == {("ir", "same", "fatal", 6), ("rgb", "train only", "warning", 5)}
    assert not audit.audit_summary(found, True).first()["formal_ready"]
    with pytest.raises(ValueError, match="cross_split_exact_duplicate: 1"):
        audit.raise_on_fatal(found)
    version = spark.createDataFrame([("d", True, 1)], "digest string, formal boolean, schema_version int")
    with pytest.raises(ValueError, match="audit"):
        audit.assert_usable(version, "d", found)


def test_held_out_collection(spark):
    rows = make_samples(spark)
    members = pairing.split_members(rows, split.nested_group_split(rows, trials=8))
    version = spark.createDataFrame([("d", True, 1)], "digest string, formal boolean, schema_version int")
    none = spark.createDataFrame([], "level string, code string")
    found, about = audit.collect_heldout(version, "d", none, rows, members)
    assert found.count() == 3 and about.first()["pairs"] == 3 and len(about.first()["split_digest"]) == 64
    one = members.where("split = 'train'").limit(1)
    for wrong, code in ((members.union(one.select("sample_id", F.lit("test"))), "shared_sample"), (members.union(spark.createDataFrame([("x", "test")])), "member_unknown"), (members.union(members.where("split = 'test'")), "member_duplicate"), (members.where("split <> 'val'"), "empty_split")):
        with pytest.raises(ValueError, match=code):
            audit.collect_heldout(version, "d", none, rows, wrong)
    with pytest.raises(ValueError, match="duplicate_sample_id"):
        audit.collect_heldout(version, "d", none, rows.union(rows.limit(1)), members)
    with pytest.raises(ValueError, match="digest"):
        audit.collect_heldout(version, "e", none, rows, members)


def brute_greedy(features, seed, second, ratio, trials):
    """The same search over dictionaries, scored from scratch at each step."""
    names = sorted({k for f in features.values() for k in f})
    weight = {k: split.WEIGHTS[k[0]] for k in names}
    share = {False: 1 - ratio, True: ratio}
    total = {k: sum(f.get(k, 0) for f in features.values()) for k in names}

    def cost(chosen):
        return sum(weight[k] * ((sum(features[g].get(k, 0) for g in chosen if chosen[g] == side) - total[k] * share[side]) / max(1.0, total[k] * share[side])) ** 2 for k in names for side in (False, True))

    best = None
    for trial in range(trials):
        draw = {g: hashlib.sha256(f"{seed}:{trial}:{g}".encode()).digest() for g in features}
        chosen = {}
        for g in sorted(features, key=lambda g: (-features[g][("pairs", "all")], -features[g][("experiments", "all")], draw[g])):
            open_ = [s for s in (False, True) if list(chosen.values()).count(s) < (second if s else len(features) - second)]
            costs = {s: cost(chosen | {g: s}) for s in open_}
            chosen[g] = bool(draw[g][0] & 1) if len(open_) == 2 and abs(costs[False] - costs[True]) < 1e-12 else min(open_, key=costs.get)
        if best is None or (round(cost(chosen), 9), trial) < best[:2]:
            best = (round(cost(chosen), 9), trial, chosen)
    return best[2]


def test_greedy_split_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(f"s{i}", f"e{rng.randrange(14)}", rng.choice("abc"), "k", f"g{rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 6])}", True, "", 1) for i in range(80)]
    samples = spark.createDataFrame(rows, make_samples(spark).schema)
    features = split.group_features(samples, ("experiment_key",))
    plain = {}
    for r in features.collect():
        plain.setdefault(r["leakage_group_id"], {})[r["kind"], r["name"]] = r["value"]
    got = split.assign_stage(features, 0.3, 5, 12, greedy=True)
    assert {r["leakage_group_id"]: r["second"] for r in got.collect()} == brute_greedy(plain, 5, split.target_groups(7, 0.3), 0.3, 12)
    with pytest.raises(ValueError, match="more than 3 groups"):
        split.greedy_table(features, 5, 2, 2, 0.3, most_groups=3)


def test_use_gate(spark):
    version = spark.createDataFrame([("d", True, 1)], "digest string, formal boolean, schema_version int")
    issues = spark.createDataFrame([], "level string, code string")
    audit.assert_usable(version, "d", issues)
    with pytest.raises(ValueError, match="digest"):
        audit.assert_usable(version, "other", issues)


def test_epoch_order(spark):
    df = spark.range(100)
    order = lambda e: [r["id"] for r in series.epoch_order(df, "id", 1, e).orderBy("place").collect()]
    assert sorted(order(0)) == list(range(100)) and order(0) == order(0) != order(1)


def test_tile_starts(spark):
    starts = one(spark, grid.tile_starts(F.lit(91), 32, 8))
    assert starts[0] == 0 and starts[-1] == 59 and all(b - a <= 24 for a, b in zip(starts, starts[1:], strict=False))


def test_homography_is_found_again(spark):
    rng = np.random.default_rng(0)
    h = np.array([[1.2, 0.1, 5], [-0.05, 0.9, 3], [1e-4, 2e-4, 1]])
    rows = []
    for pair in range(6):
        for i in range(20):
            x, y = rng.uniform(0, 600, 2)
            p = h @ [x, y, 1]
            rows.append((1, pair, i, float(x), float(y), float(p[0] / p[2]) + 40 * (pair == 5), float(p[1] / p[2])))
    points = spark.createDataFrame(rows, "g int, pair int, idx int, ir_x double, ir_y double, rgb_x double, rgb_y double")
    good = points.where("pair < 5")
    assert np.allclose(geometry.fit_homography(good, ["g"]).first()["h"], h.ravel(), atol=1e-6)
    kept, rejected = geometry.filter_pairs(points, ["g"], "pair")
    assert {r["pair"] for r in kept.select("pair").distinct().collect()} == set(range(5)) and [(r["pair"], r["stage"]) for r in rejected.collect()] == [(5, "robust_global")]
    assert geometry.fit_robust(points, ["g"], 24, 1.0).first()["inliers"] == 100
    assert geometry.leave_one_out(good, ["g"], "pair").where("rmse > 1e-4").count() == 0


def test_pairs_are_rejected_whole_and_together(spark):
    """Two boards are off as a whole; of another, one corner is: all three go, though there are only five boards in the second group."""
    rng = np.random.default_rng(1)
    rows = []
    for g in range(2):
        for pair in range(8 if g else 5):
            for i in range(20):
                x, y = rng.uniform(0, 600, 2)
                off = 30 * (pair in (1, 3)) + 9 * (pair == 2 and i == 7)
                rows.append((g, pair, i, float(x), float(y), float(1.1 * x + 5 + off), float(0.9 * y + 3)))
    points = spark.createDataFrame(rows, "g int, pair int, idx int, ir_x double, ir_y double, rgb_x double, rgb_y double")
    kept, rejected = geometry.filter_pairs(points, ["g"], "pair")
    assert {(r["g"], r["pair"]) for r in rejected.collect()} == {(g, p) for g in (0, 1) for p in (1, 2, 3)}
    assert kept.count() == 20 * (2 + 5)
    none, all_ = geometry.filter_pairs(points.where("pair in (1, 2)"), ["g"], "pair", -1.0)
    assert none.count() == 0 and all_.count() == 4


def test_quality_status(spark):
    rows = [(20, 9.0, 1.0, 1.0, 1.0, False), (20, 0.5, 1.0, 2.0, 1.1, False), (20, 0.5, 1.0, 2.0, 1.1, True), (10, 0.5, 1.0, 2.0, 1.1, False), (20, 0.5, 1.3, 2.0, 1.1, False), (20, 0.5, 1.0, 2.0, None, False), (3, 0.1, 0.1, 0.1, 0.1, False)]
    df = spark.createDataFrame(rows, "pairs int, rmse double, p95 double, max_error double, left_out double, warning boolean")
    w = "provisional_warning"
    assert [r["status"] for r in geometry.quality_status(df).collect()] == [w, "formal", w, "provisional", w, w, "failed"]


def test_board_order(spark):
    rows = [(1, i, float(i % 4), float(i // 4), 10.0 + (11 - i) % 4, 20.0 + (11 - i) // 4) for i in range(12)]
    points = spark.createDataFrame(rows, "p int, idx int, ir_x double, ir_y double, rgb_x double, rgb_y double")
    assert geometry.order_corners(points, ["p"], 4, 3).select("turn").distinct().first()["turn"] == "reversed"


def frames_of(spark, *images):
    return spark.createDataFrame([(i, *a.shape, a.ravel().tolist()) for i, a in enumerate(images)], "frame_id int, height int, width int, v array<double>")


def test_pixel_work(spark):
    a = np.random.default_rng(2).random((12, 15))
    f = frames_of(spark, a, np.zeros((12, 15)))
    v, h, w = (F.col(c) for c in ("v", "height", "width"))
    assert abs(f.select(grid.ssim(v, v, h, w).alias("s")).first()["s"] - 1) < 1e-9
    q = f.select(grid.fusion_quality(v, v, v, h, w).alias("q")).first()["q"]
    assert abs(q["total"]) < 1e-9
    assert [r["r"] is None for r in f.select(grid.edge_correlation(v, v, h, w).alias("r")).collect()] == [False, True]
    other = F.slice(v, 1, 10)
    assert f.select(grid.edge_correlation(v, other, h, w).alias("r")).first()["r"] is None
    assert grid.from_pixels(grid.to_pixels(f)).orderBy("frame_id").collect() == f.collect()
    odd = frames_of(spark, np.array([[np.nan, np.inf, 3.0, 1.0]]))
    assert odd.select(grid.normalise_8bit(v).alias("v")).first()["v"] == [0, 0, 255, 85]
    assert not odd.select(grid.check_unit_range(v).alias("ok")).first()["ok"]
    identity = F.array(*(F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0, 0, 0, 1)))
    seen = f.select(grid.warp(v, h, w, identity).alias("x")).first()["x"]
    assert np.allclose(seen["v"], a.ravel()) and seen["overlap"] == 1


def test_scores_are_checked(spark):
    f = frames_of(spark, np.random.default_rng(2).random((91, 75)))
    same = grid.score_tiled(f, lambda t: t, 32, 8).first()["v"]
    assert np.allclose(same, f.first()["v"], atol=1e-12)
    assert grid.score_tiled(frames_of(spark, np.ones((5, 40))), lambda t: t * 2, 32, 8).first()["v"] == [2.0] * 200
    assert grid.score(f, lambda a: a + 1).first()["v"][0] == f.first()["v"][0] + 1
    for wrong, match in ((lambda t: t[..., 1:], "shape"), (lambda t: t * np.nan, "finite")):
        with pytest.raises(Exception, match=match):
            grid.score_tiled(f, wrong, 32, 8).collect()
    with pytest.raises(ValueError, match="no tile"):
        grid.blended([(0, 0, np.ones((2, 2)))], (3, 2))
    assert grid.starts(91, 32, 8) == one(spark, grid.tile_starts(F.lit(91), 32, 8)) and grid.starts(20, 32, 8) == [0]


def test_crops_are_padded_and_shared(spark):
    a = np.arange(12.0).reshape(3, 4)
    assert (augment.cropped(a, 0, 1, True, 2) == [[2, 1], [6, 5]]).all()
    assert (augment.cropped(a, 0, 0, False, 5) == np.pad(a, ((1, 1), (0, 1)), mode="reflect")).all()
    assert (augment.cropped(a, 0, 0, False, 12) == np.pad(a, ((4, 5), (4, 4)), mode="edge")).all()  # wider than the frame
    f = frames_of(spark, a).withColumn("u", F.transform("v", lambda x: -x))
    p = spark.createDataFrame([(0, 1, 1, True)], "frame_id int, crop_y int, crop_x int, flip boolean")
    r = augment.apply_geometry(f, p, 2, ("v", "u")).first()
    assert r["v"] == [6, 5, 10, 9] and r["u"] == [-6, -5, -10, -9] and (r["height"], r["width"]) == (2, 2)


def test_hash_of_a_flat_frame_and_its_copies(spark):
    f = frames_of(spark, np.zeros((32, 32)), np.zeros((32, 32)), np.random.default_rng(1).random((32, 32)))
    h = f.select(F.col("frame_id").alias("id"), F.lit("ir").alias("modality"), neardup.phash(F.col("v"), F.col("height"), F.col("width")).alias("h")).select("id", "modality", "h.hi", "h.lo")
    assert [(r["class_a"], r["class_b"], r["n_a"], r["distance"]) for r in neardup.near_classes(h).collect()] == [(0, 0, 2, 0)]
    assert [(r["id_a"], r["id_b"]) for r in neardup.near_duplicates(h).collect()] == [(0, 1)]


def test_annotated_duplicates_are_one_row_each(spark):
    pairs = spark.createDataFrame([("ir", "a", "b", 1), ("ir", "a", "c", 2), ("ir", "a", "x", 0)], "modality string, id_a string, id_b string, distance bigint")
    samples = spark.createDataFrame([("a", "g1", True), ("b", "g2", True), ("c", "g3", True), ("x", "g4", False)], "sample_id string, leakage_group_id string, usable boolean")
    members = spark.createDataFrame([("a", "train"), ("a", "train_pool"), ("b", "val"), ("b", "train_pool"), ("c", "train"), ("c", "train_pool")], "sample_id string, split string")
    got = [(r["id_b"], r["group_b"], r["split_a"], r["split_b"], r["cross_split"]) for r in neardup.annotate_duplicates(pairs, samples, members).orderBy(*neardup.REPORT_ORDER).collect()]
    assert got == [("b", "g2", "train", "val", True), ("c", "g3", "train", "train", False)]


def test_short_clips_are_issues(spark):
    df = spark.createDataFrame([("a", i, float(i % 3)) for i in range(6)] + [("b", 0, 1.0)], "clip string, i int, s double")
    picked, short = series.select_bin_maxima(df, "clip", "i", "s", 3)
    assert sorted((r["clip"], r["i"]) for r in picked.collect()) == [("a", 1), ("a", 2), ("a", 5)] and [(r["clip"], r["rows"]) for r in short.collect()] == [("b", 1)]


def test_lag(spark):
    rows = [("c", t, float((t * t * 7) % 13), float(((t - 2) * (t - 2) * 7) % 13)) for t in range(30)]
    s = spark.createDataFrame(rows, "clip string, t int, a double, b double")
    assert series.best_lag(series.lag_correlation(s, "clip"), "clip").first()["best_lag"] == 2
    assert series.sync_diagnostic(s, "clip").first()["warning"]
    flat = s.withColumn("b", F.lit(1.0))
    assert series.lag_correlation(flat, "clip").where("r is not null").count() == 0


def test_files(spark, tmp_path):
    for i, name in enumerate(("day1/experiment2/healthy/clip3/ir/000001.png", "day1/experiment2/healthy/clip3/rgb/000001.png")):
        (tmp_path / name).parent.mkdir(parents=True)
        (tmp_path / name).write_bytes(png(4, 2, 100 + i))
    (tmp_path / "odd.png").write_bytes(b"no image")
    root = str(tmp_path)
    assert scans.scan_fingerprints(spark, root).select("sha256").distinct().count() == 3
    heads = scans.scan_png_headers(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root))
    assert heads.where("readable and width = 4 and height = 2 and bit_depth = 8 and mode = 'RGB'").count() == 2
    g = scans.scan_grid(spark, root, 2).orderBy("frame_id").collect()
    assert [(r["height"], r["width"]) for r in g] == [(1, 2), (1, 2)] and np.allclose([r["v"] for r in g], [[100 / 255] * 2, [101 / 255] * 2])
    parsed = scans.parse_paths(scans.scan_fingerprints(spark, root)).where("parsed").orderBy("modality").collect()
    assert [(r["day"], r["experiment"], r["clip"], r["modality"]) for r in parsed] == [("day1", "experiment2", "03", "ir"), ("day1", "experiment2", "03", "rgb")]


def test_csv_and_jobs(spark, tmp_path):
    (tmp_path / "t.csv").write_text("\ufeffa,b\n1,\n")
    assert scans.read_table(spark, str(tmp_path / "t.csv"), ["a", "b"]).first()["b"] == ""
    with pytest.raises(ValueError, match="lacks c"):
        scans.read_table(spark, str(tmp_path / "t.csv"), ["c"])
    pair = "clip:string,category:string,ir:string,rgb:string,user_confirmed:boolean"
    rows = [("t", "experiment", 2, [("clip1", "a", "../x", "y", True), ("02", "a", "a", "b", False), ("3", "b", "a", "b", True), ("4", "a", "i", "r", True)]), ("u", "calibration", None, None), ("v", "experiment", 3, None), ("w", "experiment", 2, [])]
    jobs = spark.createDataFrame(rows, f"task string, job_type string, schema_version int, pairs array<struct<{pair}>>")
    files = spark.createDataFrame([("u", None, "ir", "07"), ("u", None, "rgb", "7"), ("u", None, "rgb", "x")], "task string, category string, modality string, stem string")
    pairs, issues = scans.read_job_pairs(jobs, files, ["a"])
    assert sorted(map(tuple, pairs.collect())) == [("t", "a", "04", "i", "r"), ("u", None, "07", "07", "7")]
    assert {(r["task"], r["code"]) for r in issues.collect()} == {("t", "unsafe_path"), ("t", "not_confirmed"), ("t", "unknown_category"), ("u", "not_a_number"), ("v", "unknown_version"), ("w", "no_pairs")}
    files = spark.createDataFrame([("a", "READY"), ("a", "job.json"), ("b", "READY")], "task string, name string")
    assert [r["task"] for r in scans.ready_tasks(files).collect()] == ["a"]


def test_json_documents_and_reports(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.json").write_text('{"task": "T",\n "frames": 3}')
    (tmp_path / "s/b.json").write_text("[1, 2")
    good, bad = scans.read_summaries(spark, str(tmp_path / "s"), "task string, frames int")
    assert [(r["task"], r["frames"]) for r in good.collect()] == [("T", 3)] and [r["path"][-6:] for r in bad.collect()] == ["b.json"]
    results = spark.createDataFrame([("t", "success", "")], "task string, status string, message string")
    for run in ("1", "2"):
        sinks.write_run_report(results, f"{tmp_path}/runs", run)
    assert spark.read.parquet(f"{tmp_path}/runs").where("run_id = 2").count() == 1
    rows = spark.createDataFrame([(3, "b"), (1, "c"), (2, "a")], "distance int, id_a string").repartition(3)
    sinks.write_audit({"near": rows}, f"{tmp_path}/audit", {"near": ["distance"]})
    files = sorted((tmp_path / "audit/near").glob("part-*.parquet"))
    assert [r["distance"] for f in files for r in spark.read.parquet(str(f)).collect()] == [1, 2, 3]


def test_loose_identity(spark):
    d, e, c = scans.parse_loose_identity(F.col("p"), ["health", "sick"])
    rows = [("health/experiment2/day1/x/sick", ("day1", "experiment1", "sick")), ("a/Day02/3/health", ("day2", "experiment3", "health")), ("day 4/experiment1/sick", (None, None, None)), ("day5", ("day5", "experiment1", None))]
    df = spark.createDataFrame([(p,) for p, _ in rows], "p string").select("p", d.alias("d"), e.alias("e"), c.alias("c"))
    assert {r["p"]: (r["d"], r["e"], r["c"]) for r in df.collect()} == dict(rows)
    assert [one(spark, keys.norm_clip(F.lit(x))) for x in ("clip01", "CLIP7", "120", "clip 1", "x")] == ["01", "07", "120", None, None]


def test_migration(spark):
    v1 = spark.createDataFrame([("t", [("ir", "01"), ("rgb", "1"), ("ir", "x")])], "task string, files array<struct<modality:string,stem:string>>")
    row = pairing.migrate_jobs(v1).first()
    assert row["schema_version"] == 2 and [(p["ir"], p["rgb"]) for p in row["pairs"]] == [("01", "1")]


def test_sinks(spark, tmp_path):
    df = spark.range(3)
    meta = spark.createDataFrame([("d",)], "digest string")
    sinks.publish_version(spark, f"{tmp_path}/v", "v1", {"t": df}, meta)
    assert sinks.read_version(spark, f"{tmp_path}/v", "v1", "t").count() == 3
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.publish_version(spark, f"{tmp_path}/v", "v1", {"t": df}, meta)
    with pytest.raises(ValueError):
        sinks.publish_version(spark, f"{tmp_path}/v", "../x", {"t": df}, meta)
    sinks.replace_run(df, f"{tmp_path}/runs")
    sinks.replace_run(spark.range(5), f"{tmp_path}/runs")
    assert sinks.current_run(spark, f"{tmp_path}/runs").count() == 5


def test_intake_adds_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.bin").write_bytes(b"1")
    (tmp_path / "in/b.bin").write_bytes(b"1")
    run = lambda: start_intake(spark, f"{tmp_path}/in", f"{tmp_path}/table", f"{tmp_path}/cp").awaitTermination(120)
    run()
    assert spark.read.parquet(f"{tmp_path}/table").count() == 1
    (tmp_path / "in/c.bin").write_bytes(b"2")
    (tmp_path / "in/d.bin").write_bytes(b"1")
    run()
    assert spark.read.parquet(f"{tmp_path}/table").count() == 2
