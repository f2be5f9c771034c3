"""What has to hold at any size: bounded buffers, refinement, files of any length, writers at once, batches run again."""

import collections
import hashlib
import os
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinframe.operators import geometry, neardup, pairing, quantiles, series
from twinframe.sources import ranged, scans, sinks
from twinframe.streaming import intake
from twinframe.streaming.intake import start_intake

# --- quantiles ----------------------------------------------------------------------------------------------------

PS = {"low": 0.0, "third": 1 / 3, "median": 0.5, "p95": 0.95, "high": 1.0}


def same_as_percentile(df, large, buffer):
    got = quantiles.exact_percentiles(df, ["k"], "v", PS, large, buffer)
    want = df.groupBy("k").agg(*(F.percentile("v", p).alias(n) for n, p in PS.items()))
    return sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_quantiles_of_odd_groups(spark):
    rng = random.Random(1)
    rows = [("ties", float(rng.choice([1, 1, 1, 2, 5]))) for _ in range(900)] + [("wide", rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300)) for _ in range(700)] + [("equal", 3.0)] * 400
    rows += [("edges", x) for x in (float("inf"), float("-inf"), 0.0, -0.0, 1e308, -1e308) for _ in range(60)] + [(None, float(i)) for i in range(300)] + [("nulls", None)] * 5 + [("few", 1.0), ("few", None), ("few", 2.5)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    assert same_as_percentile(df, 100, 20)
    assert same_as_percentile(df, 10_000, 20)
    assert quantiles.exact_percentiles(df.where("false"), ["k"], "v", PS).count() == 0


def test_quantiles_of_ten_million_values_of_one_key(spark):
    """No buffer holds more than 50,000 values, and few passes are made."""
    df = spark.range(10_000_000).select(F.lit(1).alias("k"), (F.pmod(F.col("id") * 7919, F.lit(10_000_019)) / 3.0).alias("v"))
    row = quantiles.exact_percentiles(df, ["k"], "v", {"median": 0.5, "p95": 0.95}, buffer=50_000).first()
    values = np.sort((np.arange(10_000_000, dtype=np.int64) * 7919 % 10_000_019) / 3.0)
    assert np.isclose(row["median"], np.percentile(values, 50), rtol=1e-15) and np.isclose(row["p95"], np.percentile(values, 95), rtol=1e-15)


def test_metrics_by_selection(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), (F.col("id") % 977 / 100).alias("e"), F.lit(2.0).alias("f"))
    plain, chosen = (sorted(map(tuple, series.error_metrics(df, ["g"], large=n).collect())) for n in (None, 100))
    assert np.allclose(plain, chosen, rtol=1e-12)
    plain, chosen = (sorted(map(tuple, series.joint_score(df, "g", "e", "f", n).collect())) for n in (None, 100))
    assert np.allclose(plain, chosen, rtol=1e-12)


# --- homographies -------------------------------------------------------------------------------------------------


def noisy_points(seed, groups, noise, n=30):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        h = np.array([1 + rng.normal() * 0.1, rng.normal() * 0.1, rng.normal() * 20, rng.normal() * 0.1, 1 + rng.normal() * 0.1, rng.normal() * 20, rng.normal() * 3e-4, rng.normal() * 3e-4, 1])
        for i in range(n):
            x, y = rng.random(2) * [640, 480]
            d = h[6] * x + h[7] * y + 1
            u, v = (h[0] * x + h[1] * y + h[2]) / d, (h[3] * x + h[4] * y + h[5]) / d
            rows.append((g, i, i % 5, x, y, *(np.array([u, v]) + rng.normal(size=2) * noise).tolist()))
    return [(a, b, c, *map(float, rest)) for a, b, c, *rest in rows]


POINTS = "g int, i int, pair int, ir_x double, ir_y double, rgb_x double, rgb_y double"


def gauss_newton(p, h):
    """A plain solver over all points of a group, with derivatives by differences."""
    def errors(h):
        d = h[6] * p[:, 0] + h[7] * p[:, 1] + 1
        return np.concatenate([(h[0] * p[:, 0] + h[1] * p[:, 1] + h[2]) / d - p[:, 2], (h[3] * p[:, 0] + h[4] * p[:, 1] + h[5]) / d - p[:, 3]])

    h = np.array(h[:8])
    for _ in range(30):
        e = errors(h)
        steps = np.maximum(np.abs(h), 1e-3) * 1e-6
        j = np.stack([(errors(h + np.eye(8)[k] * steps[k]) - errors(h - np.eye(8)[k] * steps[k])) / (2 * steps[k]) for k in range(8)], axis=1)
        h = h + np.linalg.lstsq(j, -e, rcond=None)[0]
    return np.sqrt((errors(h) ** 2).sum() / len(p))


@pytest.mark.parametrize("noise", [0.0, 0.5, 6.0])
def test_refinement_against_a_solver(spark, noise):
    rows = noisy_points(int(noise * 10), 6, noise)
    df = spark.createDataFrame([*rows, (99, 0, 0, 1.0, 1.0, 1.0, 1.0)], POINTS).repartition(3)
    linear, refined = (geometry.fit_homography(df, ["g"], n) for n in (0, 10))
    models = {r["g"]: r["h"] for r in refined.collect()}
    assert len(models) == 7 and models[99] is None
    rmse = lambda m: {r["g"]: r["rmse"] for r in series.error_metrics(geometry.project_points(df, m, ["g"]), ["g"]).collect()}
    before, after = rmse(linear), rmse(refined)
    for g in range(6):
        assert after[g] <= before[g] * (1 + 1e-9) + 1e-9
        p = np.array([r[3:] for r in rows if r[0] == g])
        assert np.isclose(after[g], gauss_newton(p, models[g]), rtol=1e-6, atol=1e-6)
    if noise == 6.0:
        assert any(after[g] < before[g] * 0.999 for g in range(6))


def test_refined_leave_one_out(spark):
    rows = noisy_points(3, 2, 1.0, 20)
    df = spark.createDataFrame(rows, POINTS)
    got = {(r["g"], r["pair"]): r["rmse"] for r in geometry.leave_one_out(df, ["g"], "pair", 5).collect()}
    rest = spark.createDataFrame([(r[0] * 10 + p, *r[1:]) for r in rows for p in range(5) if r[2] != p], POINTS)
    models = {r["g"]: r["h"] for r in geometry.fit_homography(rest, ["g"], 5).collect()}
    assert len(got) == 10
    for (g, pair), rmse in got.items():
        h = models[g * 10 + pair]
        p = np.array([r[3:] for r in rows if r[0] == g and r[2] == pair])
        d = h[6] * p[:, 0] + h[7] * p[:, 1] + 1
        e = ((h[0] * p[:, 0] + h[1] * p[:, 1] + h[2]) / d - p[:, 2]) ** 2 + ((h[3] * p[:, 0] + h[4] * p[:, 1] + h[5]) / d - p[:, 3]) ** 2
        assert np.isclose(rmse, np.sqrt(e.mean()), rtol=1e-5)


def test_robust_fit_among_many_outliers(spark):
    rng = random.Random(2)
    rows = noisy_points(7, 3, 0.2, 60)
    rows = [(*r[:5], r[5] + (rng.uniform(-200, 200) if r[1] % 5 < 2 else 0), r[6] + (rng.uniform(20, 200) if r[1] % 5 < 2 else 0)) for r in rows]
    df = spark.createDataFrame(rows + rows[:7], POINTS).repartition(5)
    got = {r["g"]: (r["inliers"], r["h"]) for r in geometry.fit_robust(df, ["g"], trials=128, threshold=3.0, refine=5).collect()}
    assert len(got) == 3
    for g, (n, h) in got.items():
        good = np.array([r[3:] for r in rows if r[0] == g and r[1] % 5 >= 2])
        d = h[6] * good[:, 0] + h[7] * good[:, 1] + 1
        e = np.hypot((h[0] * good[:, 0] + h[1] * good[:, 1] + h[2]) / d - good[:, 2], (h[3] * good[:, 0] + h[4] * good[:, 1] + h[5]) / d - good[:, 3])
        assert n >= 30 and e.max() < 3
    draw = lambda parts: sorted(tuple(r) for r in geometry.draw_points(df.repartition(parts), ["g"], 16).collect())
    assert draw(1) == draw(9) and len(draw(3)) == 3 * 16 * 4


def test_trials_are_scored_without_python(spark):
    """A point was a row with all models of its group in an Arrow batch; points at infinity, or without a coordinate, are within nothing."""
    rng = np.random.default_rng(3)
    points = [(g, *map(float, rng.normal(0, 1, 4))) for g in (0, 1, 1, 1, 2, 2, None) for _ in range(20)] + [(0, 1.0, 0.0, 1.0, 1.0), (1, None, 0.0, 0.0, 0.0), (3, 0.0, 0.0, 0.0, 0.0)]
    models = [(g, t, [*map(float, rng.normal(0, 1, 6)), -1.0 if t == 4 else 0.1, 0.0, 1.0]) for g in (0, 1, 2, 4) for t in range(5)]
    got = geometry.trial_scores(spark.createDataFrame(points, "g int, ir_x double, ir_y double, rgb_x double, rgb_y double"), spark.createDataFrame(models, "g int, trial int, h array<double>"), ["g"], 1.5)
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().executedPlan().toString())
    want = {}
    for g, t, h in models[:15]:
        e = [((h[0] * x + h[1] * y + h[2]) / d - u) ** 2 + ((h[3] * x + h[4] * y + h[5]) / d - v) ** 2 for k, x, y, u, v in points if k == g and x is not None and (d := h[6] * x + h[7] * y + 1)]
        want[g, t] = (sum(1 - a / 2.25 for a in e if a <= 2.25), sum(a <= 2.25 for a in e))
    have = {(r["g"], r["trial"]): (r["score"], r["inliers"]) for r in got.collect()}
    assert have.keys() == want.keys() and all(np.allclose(have[k], want[k]) for k in want) and sum(n for _, n in want.values()) > 50


def test_strict_issues_need_no_join(spark, tmp_path):
    """A column of a wide table is taken for small and was sent to all tasks; rows that share a key, or whose key has a null, each are an issue."""
    rng = random.Random(4)
    sides = [[(rng.choice([None, *range(40)]), rng.choice([None, "x", "y"])) for _ in range(120)] + [(None, "z")] * n for n in (70_000, 0)]
    for name, rows in zip("ab", sides, strict=True):
        spark.createDataFrame(rows, "k int, m string").write.parquet(f"{tmp_path}/{name}")
    a, b = (spark.read.parquet(f"{tmp_path}/{name}") for name in "ab")
    issues = pairing.pair_strict(a, b, ["k", "m"])[1]
    plan = issues._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
    lone = lambda own, other: [r for r in own if None in r or r not in other]
    want = collections.Counter([("only_left", *r) for r in lone(*sides)] + [("only_right", *r) for r in lone(*sides[::-1])])
    assert issues.columns == ["code", "k", "m"] and collections.Counter(tuple(r) for r in issues.collect()) == want


def test_boards_are_never_sent_to_the_driver(spark, tmp_path):
    """Spark takes points that are made of a small table for as small as that; corners that are missing are left out."""
    spark.range(50).write.parquet(f"{tmp_path}/boards")
    i = F.col("idx")
    p = spark.read.parquet(f"{tmp_path}/boards").select("id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("idx")).where("idx <> id % 12 or id < 30")
    at = F.when(F.col("id") % 2 == 0, 11 - i).otherwise(i)
    x, y = (lambda k: (k % 4) * 20.0 + 100), (lambda k: F.floor(k / 4) * 20.0 + 50)
    p = p.select("id", "idx", x(i).alias("ir_x"), y(i).alias("ir_y"), (x(at) * 1.1).alias("rgb_x"), (y(at) + 3).alias("rgb_y"))
    got = geometry.order_corners(p, ["id"], 4, 3)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    rows = got.collect()
    assert {r["id"]: r["turn"] for r in rows} == {n: "same" if n % 2 else "reversed" for n in range(50)}
    assert all(r["ir_y"] == (r["idx"] if r["turn"] == "same" else 11 - r["idx"]) // 4 * 20 + 50 for r in rows)


@pytest.mark.parametrize("threshold", [20, 40])
def test_wide_thresholds_compare_blocks(spark, threshold, monkeypatch):
    """Every close pair of hashes once, whatever the blocks, without a join on bands of a few bits."""
    monkeypatch.setattr(neardup, "BLOCK", 50)
    rng = random.Random(3)
    rows = [(i, "ab"[i % 2], rng.getrandbits(32), rng.getrandbits(32)) for i in range(200)]
    rows += [(i + 1000, *rows[i][1:]) for i in range(20)] + [(5000, "a", None, None)]
    df = spark.createDataFrame(rows, "id long, modality string, hi long, lo long")
    near = neardup.near_duplicates(df, threshold)
    assert "FlatMapGroupsInPandas" in near._jdf.queryExecution().executedPlan().toString()
    bits = lambda a, b: bin((a[2] ^ b[2]) << 32 | (a[3] ^ b[3])).count("1")
    want = [(a[1], a[0], b[0], bits(a, b)) for a in rows[:-1] for b in rows[:-1] if a[0] < b[0] and a[1] == b[1] and bits(a, b) <= threshold]
    assert sorted(map(tuple, near.collect())) == sorted(want)


@pytest.mark.parametrize(("threshold", "sorted_", "compared"), [(5, 64, 1 << 28), (14, 64, 1 << 28), (30, 64, 1 << 28), (30, 2, 4000), (30, 0, 500), (64, 20, 3000), (63, 0, 1 << 28)])
def test_wide_reports_are_made_in_their_order(spark, threshold, sorted_, compared, monkeypatch):
    """The rows of the joins, once each and in their order, and beyond the smallest distances without a shuffle of pairs."""
    monkeypatch.setattr(neardup, "SORTED", sorted_)
    monkeypatch.setattr(neardup, "COMPARED", compared)
    rng = random.Random(4)
    rows = [(f"s{i}", "ab"[i % 3 == 0], rng.getrandbits(32), rng.getrandbits(32)) for i in range(150)]
    rows += [(f"t{i}", *rows[i % 9][1:]) for i in range(40)] + [("u", "a", None, None), ("v", None, 1, 1), ("s3", "a", 5, 5), ("only", "c", 1, 2)]
    rows += [(f"w{i}", "a", rows[i][2] ^ rng.getrandbits(32) & rng.getrandbits(32) & rng.getrandbits(32), rows[i][3]) for i in range(30)]
    hashes = spark.createDataFrame(rows, "id string, modality string, hi long, lo long")
    names = sorted({r[0] for r in rows})
    samples = spark.createDataFrame([(n, f"g{i % 5}" if i % 11 else None, i % 7 != 0) for i, n in enumerate(names)], "sample_id string, leakage_group_id string, usable boolean")
    members = spark.createDataFrame([(n, ("train", "val", "test")[i % 3]) for i, n in enumerate(names) if i % 13] + [(n, "train_pool") for n in names], "sample_id string, split string")
    got = neardup.duplicate_report(hashes, samples, members, threshold)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan or sorted_ > 0
    known = {n: (f"g{i % 5}" if i % 11 else None, ("train", "val", "test")[i % 3] if i % 13 else None) for i, n in enumerate(names) if i % 7}
    bits = lambda a, b: ((a[2] ^ b[2]) << 32 | (a[3] ^ b[3])).bit_count()
    own = [r for r in rows if r[1] and r[2] is not None and r[0] in known]
    want = [(bits(a, b), a[1], a[0], b[0], known[a[0]][0], known[b[0]][0], x := known[a[0]][1], y := known[b[0]][1], bool(x and y and x != y)) for a in own for b in own if a[1] == b[1] and a[0] < b[0] and bits(a, b) <= threshold]
    rows = [(r["distance"], r["modality"], r["id_a"], r["id_b"], r["group_a"], r["group_b"], r["split_a"], r["split_b"], r["cross_split"]) for r in got.collect()]
    assert [r[:4] for r in rows] == sorted(w[:4] for w in want)
    key = lambda r: tuple(map(str, r))
    assert sorted(rows, key=key) == sorted(want, key=key) and len(rows) > 0


# --- files ----------------------------------------------------------------------------------------------------------


def png(width, height):
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"\0" * (3 * width + 1) * height)) + part(b"IEND", b"")


def test_files_of_any_length_are_hashed(spark, tmp_path):
    """A sparse file of more than 2 GB, which no value could hold."""
    size = (1 << 31) + 5
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate(size)
    (tmp_path / "a").mkdir()
    (tmp_path / "a/b c.bin").write_bytes(b"x")
    (tmp_path / "a/_hidden.bin").write_bytes(b"y")
    got = {os.path.basename(r["path"]): (r["length"], r["sha256"]) for r in scans.scan_fingerprints(spark, str(tmp_path), "*.bin").collect()}
    h = hashlib.sha256()
    for _ in range(size >> 20):
        h.update(bytes(1 << 20))
    h.update(bytes(size & 0xFFFFF))
    assert got == {"large.bin": (size, h.hexdigest()), "b c.bin": (1, hashlib.sha256(b"x").hexdigest())}
    assert scans.scan_fingerprints(spark, f"file:{tmp_path}/a").count() == 1 and scans.scan_fingerprints(spark, str(tmp_path), "*.none").count() == 0


def test_headers_are_all_that_is_read(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.png").write_bytes(png(10 + i, 3))
    (tmp_path / "5.png").write_bytes(b"short")
    (tmp_path / "6.png").write_bytes(b"")
    heads = ranged.file_ranges(spark, str(tmp_path), read="head", bytes="33").collect()
    assert max(len(r["head"]) for r in heads) == 33 and all(r["sha256"] is None for r in heads)
    got = {r["path"][-5:]: (r["readable"], r["width"], r["height"], r["mode"]) for r in scans.read_png_headers(spark, str(tmp_path)).collect()}
    assert got == {f"{i}.png": (True, 10 + i, 3, "RGB") for i in range(5)} | {f"{i}.png": (False, None, None, None) for i in (5, 6)}
    with pytest.raises(Exception, match="hash or head"):
        ranged.file_ranges(spark, str(tmp_path), read="all").collect()


def test_tasks_hold_files_by_their_sizes(tmp_path):
    for i in range(9):
        with open(tmp_path / f"{i}", "wb") as f:
            f.truncate(100 << 20)
    parts = ranged.FileReader({"path": str(tmp_path)}).partitions()
    assert sorted(f[0] for p in parts for f in p.files) == [f"{tmp_path}/{i}" for i in range(9)] and max(len(p.files) for p in parts) <= 3 and len(parts) > 2


def test_rows_become_files_and_folders_travel_by_name(spark, tmp_path):
    """No process and no move by the driver for each file; what is planned are folders, not their files."""
    rows = spark.range(3000).select(F.format_string("%d/part-%d", F.expr("id div 1000"), F.col("id")).alias("name"), F.col("id").cast("string").alias("content"))
    sinks.write_files(rows.repartition(4), f"file://{tmp_path}/f")
    sinks.write_files(rows.where("id < 10"), f"{tmp_path}/f")  # run again
    parts = ranged.FileReader({"path": f"{tmp_path}/f"}).partitions()
    assert not any(p.files for p in parts) and sorted(f for p in parts for f in p.folders) == [f"{tmp_path}/f/{i}" for i in range(3)]
    got = scans.scan_fingerprints(spark, f"{tmp_path}/f", "part-*").collect()
    assert sorted(r["sha256"] for r in got) == sorted(hashlib.sha256(str(i).encode()).hexdigest() for i in range(3000))
    assert sum(len(files) for _, _, files in os.walk(tmp_path)) == 3000
    whole = ranged.file_ranges(spark, f"{tmp_path}/f", read="whole").collect()
    assert sorted(int(bytes(r["head"])) for r in whole) == list(range(3000))


# --- writers ----------------------------------------------------------------------------------------------------------


def test_of_two_writers_one_fails(spark, tmp_path):
    root = f"{tmp_path}/runs"
    first = sinks.replace_run(spark.range(3), root)
    second = []

    class Slow:
        """A frame whose writer is overtaken."""

        sparkSession = spark

        @property
        def write(self):
            second.append(sinks.replace_run(spark.range(5), root))
            return spark.range(7).write

    with pytest.raises(sinks.AnotherWriter):
        sinks.replace_run(Slow(), root)
    assert sinks.current_run(spark, root).count() == 5 and sinks.runs(spark, root) == [first, *second]
    assert sorted(os.listdir(root)) == sorted(f"run_id={r}" for r in (first, *second))
    sinks.restore_run(spark, root, first)
    assert sinks.current_run(spark, root).count() == 3 and sinks.runs(spark, root) == [first, *second, first]
    with pytest.raises(ValueError, match="never committed"):
        sinks.restore_run(spark, root, "x")


def test_a_failing_write_leaves_the_old_run(spark, tmp_path):
    root = f"{tmp_path}/runs"
    with pytest.raises(ValueError, match="no run"):
        sinks.current_run(spark, root)
    sinks.replace_run(spark.range(3), root)
    with pytest.raises(Exception, match="not today"):
        sinks.replace_run(spark.range(9).select(F.when(F.col("id") == 8, F.raise_error(F.lit("not today"))).otherwise(F.col("id")).alias("id")), root)
    assert sinks.current_run(spark, root).count() == 3 and len(os.listdir(root)) == 1
    (tmp_path / "runs_commits/0000000002").write_bytes(b"")  # a writer died before it named its run
    assert sinks.current_run(spark, root).count() == 3
    sinks.replace_run(spark.range(4), root)
    assert sinks.current_run(spark, root).count() == 4


# --- intake -----------------------------------------------------------------------------------------------------------


def test_batches_add_once_and_never_read_the_table(spark, tmp_path):
    at = lambda n: f"{tmp_path}/{n}"
    os.mkdir(at("in"))

    def batch(start, n):
        for i in range(start, start + n):
            with open(f"{at('in')}/{i}.bin", "wb") as f:
                f.write(str(i % 25).encode())
        query = start_intake(spark, at("in"), at("table"), at("cp"))
        query.awaitTermination(120)
        return query.lastProgress

    first = batch(0, 30)
    assert spark.read.parquet(at("table")).count() == 25 and first["numInputRows"] == 30
    for part in os.listdir(at("table")):  # nothing of the table can be read any more
        if part.endswith(".parquet"):
            os.rename(f"{at('table')}/{part}", at(f"away-{part}"))
    second = batch(30, 10)
    assert second["numInputRows"] == 10 and second["stateOperators"][0]["numRowsUpdated"] == 0
    for part in os.listdir(tmp_path):
        if part.startswith("away-"):
            os.rename(at(part), f"{at('table')}/{part.removeprefix('away-')}")
    assert spark.read.parquet(at("table")).count() == 25
    with open(f"{at('in')}/new.bin", "wb") as f:
        f.write(b"new")
    batch(40, 0)
    assert spark.read.parquet(at("table")).count() == 26
    last = max(int(n) for n in os.listdir(at("cp/commits")) if n.isdigit())  # the last batch is run again
    for n in (f"{last}", f".{last}.crc"):
        if os.path.exists(at(f"cp/commits/{n}")):
            os.remove(at(f"cp/commits/{n}"))
    batch(40, 0)
    rows = spark.read.parquet(at("table")).collect()
    assert len(rows) == 26 and len({r["sha256"] for r in rows}) == 26


def test_intake_lists_files_in_tasks(spark, tmp_path):
    at = lambda n: f"{tmp_path}/{n}"
    for i in range(140):
        os.makedirs(at(f"in/{i % 70}/deep"), exist_ok=True)
        for name in (f"{i % 70}/deep/{i}.bin", f"{i % 70}/{i}.dat", f"{i % 70}/.{i}.bin", f"{i % 70}/{i}.txt"):
            with open(at(f"in/{name}"), "w") as f:
                f.write(name)
    os.mkdir(at("in/_hidden"))
    with open(at("in/_hidden/x.bin"), "w") as f:
        f.write("x")
    run = lambda: start_intake(spark, at("in"), at("table"), at("cp"), "*.{bin,dat}").awaitTermination(120)
    run()
    rows = spark.read.parquet(at("table")).collect()
    assert {(r["path"], r["length"]) for r in rows} == {(f"file:{at('in')}/{n}", len(n)) for i in range(140) for n in (f"{i % 70}/deep/{i}.bin", f"{i % 70}/{i}.dat")}
    # what the stream's source keeps, in its log and in the driver, are listings
    assert not any(re.search(r"/in/", open(at(f"cp/sources/0/{n}"), errors="replace").read()) for n in os.listdir(at("cp/sources/0")))
    run()
    assert len(os.listdir(at("cp/listed"))) - ("_SUCCESS" in os.listdir(at("cp/listed"))) - ("._SUCCESS.crc" in os.listdir(at("cp/listed"))) == 1  # nothing new: no listing
    with open(at("in/late.bin"), "w") as f:
        f.write("late")
    intake._listed(spark, f"file:{at('in')}", "*.{bin,dat}", at("cp/listed"))  # a run that ended before its batch
    run()
    assert spark.read.parquet(at("table")).count() == 281


@pytest.mark.parametrize("glob", ["*", "part-*", "a?c*", "*.{png,j?g}", "{a,b}[0-9]", "[^a]*", "[!a]*", "a[]b]", r"a\*", "a+(b)|c", "{x,{y,z}}1"])
def test_names_are_matched_as_by_spark(spark, glob):
    theirs, own = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(glob), ranged.name_pattern(glob)
    names = ["", "a", "a*", "ab", "abc", "abcd", "part-1", "x.png", "x.jpg", "x.jxg", "xjpg", "a1", "b2", "c3", "a]", "a^", "a!", "^", "!", "a+(b)|c", "x1", "y1", "z1", "a\nb", "aac"]
    assert [n for n in names if theirs.matches(n)] == [n for n in names if own.fullmatch(n)]


def test_intake_refuses_tables_of_others(spark, tmp_path):
    spark.range(1).write.parquet(f"{tmp_path}/table")
    with pytest.raises(ValueError, match="wasn't written"):
        start_intake(spark, str(tmp_path), f"{tmp_path}/table", f"{tmp_path}/cp")
    assert not re.search("RocksDB", spark.conf.get("spark.sql.streaming.stateStore.providerClass"))
