"""Homographies between the two cameras from tables of corner points; matrices are arrays of nine numbers, row by row, the last 1."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..sources.steps import discard, written
from .series import error_metrics


def scale_homography(h: Column, sx_ir: Column, sy_ir: Column, sx_rgb: Column, sy_rgb: Column) -> Column:
    """S_rgb * H * S_ir, its last number 1 again: S scales from the runtime size to the calibrated one and back."""
    raw = [sx_rgb * h[0] * sx_ir, sx_rgb * h[1] * sy_ir, sx_rgb * h[2], sy_rgb * h[3] * sx_ir, sy_rgb * h[4] * sy_ir, sy_rgb * h[5], h[6] * sx_ir, h[7] * sy_ir, h[8]]
    return F.array(*(x / h[8] for x in raw))


def determinant(h: Column) -> Column:
    return h[0] * (h[4] * h[8] - h[5] * h[7]) - h[1] * (h[3] * h[8] - h[5] * h[6]) + h[2] * (h[3] * h[7] - h[4] * h[6])


def is_valid(h: Column) -> Column:
    """Nine finite numbers, and not singular."""
    finite = F.forall(h, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when((F.size(h) == 9) & finite, F.abs(determinant(h)) >= 1e-12).otherwise(False)


def project(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    d = h[6] * x + h[7] * y + h[8]
    return F.try_divide(h[0] * x + h[1] * y + h[2], d), F.try_divide(h[3] * x + h[4] * y + h[5], d)


def project_points(points: DataFrame, models: DataFrame, by: list[str]) -> DataFrame:
    """points (by, ir_x, ir_y, rgb_x, rgb_y) with px, py and the error e, by models (by, h); there are far fewer models than points, and Spark picks the join by their size."""
    rows = points.join(models, by)
    px, py = project(F.col("h"), F.col("ir_x"), F.col("ir_y"))
    return rows.withColumn("px", px).withColumn("py", py).withColumn("e", F.sqrt(F.pow(F.col("px") - F.col("rgb_x"), 2) + F.pow(F.col("py") - F.col("rgb_y"), 2)))



def normal_sums(points: DataFrame, by: list[str]) -> DataFrame:
    """by, n and s: the sums of the 36 + 8 products that the least-squares equations need, in one aggregation."""
    rows = {0: ["ir_x", "ir_y", "1", "0", "0", "0", "-rgb_x*ir_x", "-rgb_x*ir_y"], 1: ["0", "0", "0", "ir_x", "ir_y", "1", "-rgb_y*ir_x", "-rgb_y*ir_y"]}
    sums = []
    for i in range(8):
        for j in range(i, 8):
            parts = [f"({r[i]})*({r[j]})" for r in rows.values() if "0" not in (r[i], r[j])]
            sums.append(F.sum(F.expr(" + ".join(parts) or "0.0").cast("double")))
        parts = [f"({r[i]})*{t}" for r, t in zip(rows.values(), ("rgb_x", "rgb_y"), strict=True) if r[i] != "0"]
        sums.append(F.sum(F.expr(" + ".join(parts)).cast("double")))
    return points.groupBy(*by).agg(F.count("*").alias("n"), F.array(*sums).alias("s"))


def _solve(s) -> list[float] | None:
    a, b, k = np.zeros((8, 8)), np.zeros(8), 0
    for i in range(8):
        for j in range(i, 8):
            a[i, j] = a[j, i] = s[k]
            k += 1
        b[i] = s[k]
        k += 1
    scale = 1 / np.sqrt(np.maximum(np.diag(a), 1e-300))
    try:
        h = np.linalg.solve(a * scale[:, None] * scale[None], b * scale) * scale
    except np.linalg.LinAlgError:
        return None
    return [*h.tolist(), 1.0] if np.isfinite(h).all() else None


def solve_homographies(sums: DataFrame, by: list[str]) -> DataFrame:
    """sums (by, n, s) -> by, h; fewer than four points, or singular ones, give a null."""
    def run(frames):
        for f in frames:
            f["h"] = [_solve(s) if n >= 4 else None for s, n in zip(f["s"], f["n"], strict=True)]
            yield f[[*by, "h"]]

    kinds = dict(sums.dtypes)
    return sums.mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "h array<double>"]))


def fit_homography(points: DataFrame, by: list[str], refine: int = 0) -> DataFrame:
    """by, h: the linear least-squares fit, followed by at most refine steps of refine_homography()."""
    models = solve_homographies(normal_sums(points, by), by)
    return refine_homography(points, models, by, refine) if refine else models


def reprojection_sums(points: DataFrame, models: DataFrame, by: list[str]) -> DataFrame:
    """by, s: sums over the points of what a step on the reprojection error needs (36 products of derivatives, 8 of derivatives and errors, each row of the triangle followed by its error) and, last, of the squared error; one aggregation. models (by, h)."""
    px, py = project(F.col("h"), F.col("ir_x"), F.col("ir_y"))
    inverse = F.try_divide(F.lit(1.0), F.col("h")[6] * F.col("ir_x") + F.col("h")[7] * F.col("ir_y") + F.col("h")[8])
    rows = points.join(models, by).select(*by, "ir_x", "ir_y", px.alias("_px"), py.alias("_py"), (px - F.col("rgb_x")).alias("_ex"), (py - F.col("rgb_y")).alias("_ey"), inverse.alias("_d"))
    of = {"_ex": ["ir_x", "ir_y", "1", "0", "0", "0", "-_px*ir_x", "-_px*ir_y"], "_ey": ["0", "0", "0", "ir_x", "ir_y", "1", "-_py*ir_x", "-_py*ir_y"]}
    total = lambda parts: F.sum(F.expr(" + ".join(parts) or "0.0").cast("double"))
    sums = []
    for i in range(8):
        for j in range(i, 8):
            sums.append(total([f"_d*_d*({r[i]})*({r[j]})" for r in of.values() if "0" not in (r[i], r[j])]))
        sums.append(total([f"_d*({r[i]})*{e}" for e, r in of.items() if r[i] != "0"]))
    return rows.groupBy(*by).agg(F.array(*sums, total(["_ex*_ex + _ey*_ey"])).alias("s"))


def _system(s) -> tuple[np.ndarray, np.ndarray, float]:
    """Matrix, gradient and squared error of reprojection_sums()."""
    a, g, k = np.zeros((8, 8)), np.zeros(8), 0
    for i in range(8):
        a[i, i:] = a[i:, i] = s[k : k + 8 - i]
        g[i] = s[k + 8 - i]
        k += 9 - i
    return a, g, float(s[44])


def _step(h, s, damping: float) -> list[float] | None:
    """h after a damped Gauss-Newton step on its sums."""
    a, g, _ = _system(s)
    scale = 1 / np.sqrt(np.maximum(np.diag(a), 1e-300))
    try:
        move = np.linalg.solve(a * scale[:, None] * scale[None] + damping * np.eye(8), -g * scale) * scale
    except np.linalg.LinAlgError:
        return None
    out = np.asarray(h[:8]) + move
    return [*out.tolist(), 1.0] if np.isfinite(out).all() else None


_FITTING = "h array<double>, s array<double>, damping double, tried array<double>, open boolean"


def refine_homography(points: DataFrame, models: DataFrame, by: list[str], steps: int = 10, least_gain: float = 1e-12) -> DataFrame:
    """models (by, h) moved to where the sum of squared reprojection errors is lowest; never to where it is higher.

    Every step is one aggregation of the points at the models that are tried, for all groups at once, and a written table
    of a row for each group: a trial that lowers the error is kept and damping falls, another is given up and damping
    rises. A group is done when a step gains less than least_gain of its error, or damping has risen too far; groups without a model stay
    without one.
    """
    kinds = dict(models.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), _FITTING])

    def run(frames):
        for f in frames:
            out = {c: [] for c in ("h", "s", "damping", "tried", "open")}
            for h, s, damping, tried, new in zip(f["h"], f["s"], f["damping"], f["tried"], f["new"], strict=True):
                worse = new is None or any(x is None or not np.isfinite(x) for x in new) or (s is not None and new[44] >= s[44])
                gain = 1.0 if worse or s is None else (s[44] - new[44]) / max(s[44], 1e-300)
                if worse and s is None:  # not even the first model has errors
                    h, s, tried, go = tried, None, None, False
                else:
                    h, s, damping = (h, s, damping * 10) if worse else (tried, new, max(damping / 10, 1e-12))
                    tried = _step(h, s, damping)
                    go = tried is not None and gain > least_gain and damping < 1e6 and s[44] > 0
                for c, v in zip(out, (h, s, damping, tried, go), strict=True):
                    out[c].append(v)
            for c, v in out.items():
                f[c] = v
            yield f[[*by, *out]]

    none = F.lit(None).cast("array<double>")
    state = written(models.where("h is not null").select(*by, none.alias("h"), none.alias("s"), F.lit(1e-4).alias("damping"), F.col("h").alias("tried"), F.lit(True).alias("open")), "fits")
    done, used = None, [state]
    for _ in range(steps + 1):
        new = reprojection_sums(points.drop("h"), state.select(*by, F.col("tried").alias("h")), by).withColumnRenamed("s", "new")
        state = written(state.join(new, by, "left").mapInPandas(run, schema), "fits")
        used.append(state)
        over = state.where("not open").select(*by, "h")
        done = over if done is None else done.union(over)
        state = state.where("open")
        if not state.limit(1).count():
            break
    else:
        done = done.union(state.select(*by, "h"))
    out = written(models.select(*by).join(done, by, "left"), "refined")
    discard(*used)
    return out


def _solve_boards(x: pa.Array, y: pa.Array, u: pa.Array, v: pa.Array, lengths: np.ndarray) -> list:
    """Matrices of runs of points (lengths: how many are in each, none 0) by the sums of normal_sums(); terms with a null add nothing."""
    gaps = np.any([np.asarray(c.is_null()) for c in (x, y, u, v)], axis=0)
    x, y, u, v = (c.to_numpy(zero_copy_only=False).astype(np.float64) for c in (x, y, u, v))
    one, none = np.ones_like(x), None
    sides = [[x, y, one, none, none, none, -u * x, -u * y, u], [none, none, none, x, y, one, -v * x, -v * y, v]]
    starts, sums = np.cumsum(lengths) - lengths, []
    for i in range(8):
        for j in range(i, 9):
            terms = [r[i] * r[j] for r in sides if r[i] is not None and r[j] is not None]
            term = sum(terms[1:], terms[0]) if terms else np.zeros_like(x)
            sums.append(np.add.reduceat(np.where(gaps & np.isnan(term), 0.0, term), starts) if len(starts) else term)
    return [_solve(s) if n >= 4 else None for s, n in zip(np.stack(sums, axis=1), lengths, strict=True)]


def order_corners(points: DataFrame, by: list[str], columns: int, rows: int) -> DataFrame:
    """points (by, idx, ...) of a board: of the four orders of the IR corners, the one that isn't mirrored and turns least, then has the lowest error; by, turn, ordered points.

    A board is brought together once, as one row of its points; the four orders are tried inside the row, so that no join,
    whose sides Spark would judge by the table that the points came from, sends them anywhere.
    """
    n = columns * rows
    turned = {"same": "{}", "reversed": f"{n - 1} - {{}}", "rows_reversed": f"({rows - 1} - {{0}} div {columns}) * {columns} + {{0}} % {columns}", "columns_reversed": f"({{0}} div {columns}) * {columns} + {columns - 1} - {{0}} % {columns}"}
    own = ["idx", "rgb_x", "rgb_y", "ir_x", "ir_y"]
    known = points.where(" AND ".join(f"`{c}` IS NOT NULL" for c in by)) if by else points
    boards = known.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*own))).alias("_b"))
    pairs = lambda at: f"flatten(transform(_b, p -> transform(filter(_b, q -> q.idx = cast({at.format('p.idx')} as int)), q -> named_struct('idx', p.idx, 'rgb_x', p.rgb_x, 'rgb_y', p.rgb_y, 'ir_x', q.ir_x, 'ir_y', q.ir_y))))"
    tries = ", ".join(f"named_struct('turn', '{name}', 'p', {pairs(at)})" for name, at in turned.items())
    tried = boards.select(*by, F.expr(f"filter(array({tries}), t -> size(t.p) > 0)").alias("_t"))

    def solved(batches):
        for batch in batches:
            tries = batch.column("_t")
            parts = tries.flatten().field("p")
            points = parts.flatten()
            h = _solve_boards(*(points.field(c) for c in ("ir_x", "ir_y", "rgb_x", "rgb_y")), np.asarray(parts.value_lengths()))
            ends = np.concatenate([[0], np.cumsum(np.asarray(tries.value_lengths()))])
            yield batch.append_column("_h", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h, pa.list_(pa.float64()))))

    tried = tried.mapInArrow(solved, StructType([*tried.schema.fields, StructField("_h", ArrayType(ArrayType(DoubleType())))]))

    def scored(t, h):
        at = lambda p: project(h, p["ir_x"], p["ir_y"])
        error = lambda p: F.sqrt(F.pow(at(p)[0] - p["rgb_x"], 2) + F.pow(at(p)[1] - p["rgb_y"], 2))
        return F.struct((determinant(h) < 0).cast("int").alias("m"), (F.abs(F.atan2(h[3], h[0])) > math.pi / 2 + 1e-9).cast("int").alias("f"), F.sort_array(F.filter(F.transform(t["p"], error), lambda e: e.isNotNull())).alias("e"), t["turn"].alias("turn"), t["p"].alias("p"))

    # median and RMSE of the sorted errors, as error_metrics() has them
    rmse = lambda e: F.sqrt(F.try_divide(F.aggregate(e, F.lit(0.0), lambda a, x: a + x * x), F.size(e)))
    half = lambda e, at: 0.5 * F.get(e, F.floor((F.size(e) + at) / 2).cast("int"))
    rated = F.transform(F.zip_with("_t", "_h", scored), lambda x: F.struct(x["m"], x["f"], rmse(x["e"]).alias("rmse"), (half(x["e"], -1) + half(x["e"], 0)).alias("median"), x["turn"], x["p"]))
    best = tried.select(*by, F.array_min(rated).alias("_x"))
    return best.select(*by, F.col("_x.turn").alias("turn"), F.inline("_x.p"))


#: Draws are ranked by multiplication modulo this prime.
PRIME = (1 << 31) - 1


def draw_factors(trials: int, seed: int) -> list[tuple[int, int]]:
    """For each trial, the two numbers that rank its points: (a * x + b) modulo PRIME."""
    number = lambda t, salt: int.from_bytes(hashlib.sha256(f"{seed}:{t}:{salt}".encode()).digest()[:6], "big")
    return [(1 + number(t, "a") % (PRIME - 1), number(t, "b") % PRIME) for t in range(trials)]


def draw_points(points: DataFrame, by: list[str], trials: int = 64, seed: int = 7, size: int = 4, key: list[str] | None = None) -> DataFrame:
    """by, trial, and the columns of size points for each trial: those whose rank in the trial is lowest, ties by x; repeated rows are one point.

    x is a number from the SHA-256 of a point's key (its four coordinates, unless named). A task keeps the size lowest of a
    group and trial as it reads, and what is shuffled are those, not points times trials; a group may be of any size.
    """
    factors = np.array(draw_factors(trials, seed), np.int64)
    columns = [*by, *dict.fromkeys((*(key or []), "ir_x", "ir_y", "rgb_x", "rgb_y"))]
    x = F.conv(F.substring(F.sha2(F.concat_ws(":", *(F.col(c).cast("string") for c in key or columns[len(by):])), 256), 1, 15), 16, 10).cast("bigint") % PRIME
    kinds = dict(points.dtypes)
    rest = [c for c in columns if c not in by]

    def lowest(frames):
        kept = None
        for f in frames:
            f = (f if kept is None else pd.concat([kept.drop(columns=["trial", "rank"]), f])).drop_duplicates(ignore_index=True)
            ranks = (f["x"].to_numpy()[:, None] * factors[None, :, 0] + factors[None, :, 1]) % PRIME
            parts = []
            for own in (f.groupby(by, dropna=False, sort=False).indices.values() if by else [np.arange(len(f))]):
                order = np.lexsort((np.broadcast_to(f["x"].to_numpy()[own, None], ranks[own].shape), ranks[own]), axis=0)[:size]
                at = own[order]  # size x trials
                part = f.iloc[at.T.ravel()].copy()
                part["trial"], part["rank"] = np.repeat(np.arange(trials), len(at)), ranks[at.T, np.arange(trials)[:, None]].ravel()
                parts.append(part)
            kept = pd.concat(parts, ignore_index=True)
            if len(kept) > 200_000:  # many groups: those of this task so far go on
                yield kept
                kept = None
        if kept is not None:
            yield kept

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "x bigint", "trial int", "rank bigint"])
    few = points.select(*columns, x.alias("x")).mapInPandas(lowest, schema)
    packed = F.struct("rank", "x", *(F.col(c) for c in rest))
    best = few.groupBy(*by, "trial").agg(F.slice(F.sort_array(F.collect_set(packed)), 1, size).alias("p"))
    return best.select(*by, "trial", F.explode("p").alias("p")).select(*by, "trial", *(F.col(f"p.{c}").alias(c) for c in rest))


def trial_scores(points: DataFrame, models: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """by, trial, score, inliers of models (by, trial, h): a point counts 1 - (e / threshold)^2, the share of all noise levels up to the threshold, evenly likely in their squares, under which it is an inlier.

    A point meets its group's models one after another, and tasks add up before the shuffle; nothing but sums is held for it.
    """
    px, py = project(F.col("h"), F.col("ir_x"), F.col("ir_y"))
    dx, dy = px - F.col("rgb_x"), py - F.col("rgb_y")
    met = points.select(*by, "ir_x", "ir_y", "rgb_x", "rgb_y").join(models.select(*by, "trial", "h"), by).select(*by, "trial", (dx * dx + dy * dy).alias("_e"))
    within = F.coalesce(F.col("_e") <= threshold**2, F.lit(False))
    return met.groupBy(*by, "trial").agg(F.sum(F.when(within, 1 - F.col("_e") / threshold**2).otherwise(0.0)).alias("score"), F.count_if(within).alias("inliers"))


def fit_robust(points: DataFrame, by: list[str], trials: int = 64, threshold: float = 3.0, seed: int = 7, key: list[str] | None = None, refine: int = 0) -> DataFrame:
    """by, h, inliers: of seeded trials that fit four points each, the one of the highest score (trial_scores(), to nine places; the first of equals), fitted again on its points within threshold, with refine steps.

    Points aren't copied for each trial: draws are lowest ranks kept in tasks, scores are sums made there.
    """
    drawn = draw_points(points, by, trials, seed, 4, key)
    models = written(fit_homography(drawn, [*by, "trial"]).where("h is not null"), "trial_models")
    scores = trial_scores(points.drop("h"), models, by, threshold).where("inliers > 0")
    best = written(scores.groupBy(*by).agg(F.min_by(F.struct("trial", "inliers"), F.struct(-F.round("score", 9), F.col("trial"))).alias("b")).select(*by, "b.*"), "best_trials")
    kept = project_points(points.drop("h"), models.join(best, [*by, "trial"]).select(*by, "h"), by).where(F.col("e") <= threshold).drop("h", "px", "py", "e")
    return fit_homography(kept, by, refine).join(best.drop("trial"), by)


def passing_pairs(points: DataFrame, models: DataFrame, by: list[str], pair: str, most_rmse: float, most_p95: float, most_error: float) -> DataFrame:
    """by, pair: the pairs whose RMSE, 95th percentile and largest error under their group's model are all within the limits."""
    errors = error_metrics(project_points(points, models, by), [*by, pair])
    return errors.where((F.col("rmse") <= most_rmse) & (F.col("p95") <= most_p95) & (F.col("max_error") <= most_error)).select(*by, pair)


def filter_pairs(points: DataFrame, by: list[str], pair: str, most_rmse: float = 0.9, most_p95: float = 1.5, most_error: float = 2.25, trials: int = 64, threshold: float = 3.0, refine: int = 0) -> tuple[DataFrame, DataFrame]:
    """The points of the pairs that are kept, and by, pair, stage of those rejected; whole pairs, never single points.

    First all pairs that fail the limits under the group's robust fit go, then, again and again until none does, all
    that fail under the least-squares fit of what is left. Every pass is for all groups at once and drops a pair or
    more, so there are at most as many passes as a group has pairs. A group of which nothing fits has no rows.
    """
    gate = lambda df, models: df.join(passing_pairs(df, models, by, pair, most_rmse, most_p95, most_error), [*by, pair], "left_semi")
    pairs = lambda df: df.select(*by, pair).distinct()
    kept = written(gate(points, fit_robust(points, by, trials, threshold, refine=refine).select(*by, "h")), "robust_pairs")
    robust, first, before = kept, pairs(kept), pairs(kept).count()
    while True:
        before_it, kept = kept, written(gate(kept, fit_homography(kept, by, refine)), "kept_pairs")
        if before_it is not robust:  # the first tells which stage rejected a pair
            discard(before_it)
        if (now := pairs(kept).count()) == before:
            break
        before = now
    rejected = pairs(points).join(pairs(kept), [*by, pair], "left_anti").join(first.withColumn("f", F.lit(True)), [*by, pair], "left")
    return kept, rejected.select(*by, pair, F.when(F.col("f"), "final_global").otherwise("robust_global").alias("stage"))


def leave_one_out(points: DataFrame, by: list[str], pair: str, refine: int = 0) -> DataFrame:
    """by, pair, rmse of each pair under the fit of all others of its group.

    For the linear fit the points are added up once: a pair's others are the group's sums less its own. With refine steps,
    each pair's model is moved on the points of all other pairs, so a group's points meet every pair of the group, in a
    join whose rows are added up before they are shuffled.
    """
    own = normal_sums(points, [*by, pair])
    at = F.array(*(F.sum(F.col("s")[i]) for i in range(44)))
    whole = own.groupBy(*by).agg(F.sum("n").alias("tn"), at.alias("ts"))
    rest = own.join(whole, by).select(*by, pair, (F.col("tn") - F.col("n")).alias("n"), F.zip_with("ts", "s", lambda t, s: t - s).alias("s"))
    models = solve_homographies(rest, [*by, pair])
    if refine:
        models = written(models, "left_out_models")
        left = models.select(*by, F.col(pair).alias("_left"))
        others = points.withColumnRenamed(pair, "_own").join(left, by).where(F.col("_own") != F.col("_left")).drop("_own").withColumnRenamed("_left", pair)
        models = refine_homography(others, models, [*by, pair], refine)
    return error_metrics(project_points(points, models, [*by, pair]), [*by, pair]).select(*by, pair, "rmse")


def _seen(models: DataFrame, keep: list[str], width: float, height: float) -> DataFrame:
    """keep, and _seen: where each model sees the 3 x 3 grid of an image, an array of nine points."""
    grid = [((width - 1) * i / 2, (height - 1) * j / 2) for j in range(3) for i in range(3)]
    return models.select(*keep, F.array(*(F.struct(*(c.alias(n) for c, n in zip(project(F.col("h"), F.lit(x), F.lit(y)), "xy", strict=True))) for x, y in grid)).alias("_seen"))


def _apart(a: str, b: str) -> Column:
    """Median distance of the nine points of a and b: the fifth."""
    return F.array_sort(F.zip_with(a, b, lambda p, q: F.sqrt(F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2))))[4]


def select_medoid(models: DataFrame, by: list[str], name: str, width: float, height: float, reference: DataFrame | None = None) -> DataFrame:
    """by, medoid, spread, widest of each group's models (by, name, h): two models are as far apart as the median of the distances of where they see a 3 x 3 grid.

    With a reference (by, h), the model nearest to the group's reference, and the median and maximum of all models'
    distances to it: linear in the models, for groups of any size. Without, the model of the lowest median distance to all
    models of the group, itself (0) among them, and the median and maximum of its distances; all pairs of a group's models
    meet, which is for the few dozen boards of a calibration. Of equals, the smallest name.
    """
    rows = _seen(models, [*by, name], width, height)
    if reference is not None:
        far = rows.join(_seen(reference, by, width, height).withColumnRenamed("_seen", "_other"), by).withColumn("_d", _apart("_seen", "_other"))
        return far.groupBy(*by).agg(F.min_by(name, F.struct("_d", name)).alias("medoid"), F.percentile("_d", 0.5).alias("spread"), F.max("_d").alias("widest"))
    rows = written(rows, "seen_models")  # once: sums in another order would make d(a, b) differ from d(b, a), and so decide between equals
    pairs = rows.join(rows.select(*by, F.col(name).alias("_o"), F.col("_seen").alias("_other")), by).withColumn("_d", F.when(F.col(name) == F.col("_o"), 0.0).otherwise(_apart("_seen", "_other")))
    own = pairs.groupBy(*by, name).agg(F.percentile("_d", 0.5).alias("spread"), F.max("_d").alias("widest"))
    return own.groupBy(*by).agg(F.min_by(F.struct(F.col(name).alias("medoid"), "spread", "widest"), F.struct("spread", name)).alias("s")).select(*by, "s.*")


def hull_area(x: np.ndarray, y: np.ndarray) -> float:
    """Area of the convex hull of points."""
    pts, chain = sorted(set(zip(x.tolist(), y.tolist(), strict=True))), []
    for side in (pts, pts[::-1]):
        start = len(chain)
        for p in side:
            while len(chain) - start >= 2 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]):
                chain.pop()
            chain.append(p)
        chain.pop()
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(chain, chain[1:] + chain[:1], strict=True))) / 2 if len(chain) > 2 else 0.0


def diversity(points: DataFrame, by: list[str], pair: str, width: float, height: float, least_span: float = 0.05, least_ratio: float = 1.05) -> DataFrame:
    """How far the boards' RGB centres span, as shares of the image, and the largest board's area over the smallest; a warning if both are small. One board's points are a group."""
    @F.pandas_udf("double")
    def area(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([hull_area(np.asarray(a), np.asarray(b)) for a, b in zip(x, y, strict=True)])

    boards = points.groupBy(*by, pair).agg(F.collect_list("rgb_x").alias("xs"), F.collect_list("rgb_y").alias("ys"), F.avg("rgb_x").alias("cx"), F.avg("rgb_y").alias("cy"))
    boards = boards.withColumn("area", area("xs", "ys"))
    span = lambda c, size: ((F.max(c) - F.min(c)) / size)
    out = boards.groupBy(*by).agg(span("cx", width).alias("span_x"), span("cy", height).alias("span_y"), F.when(F.min("area") > 0, F.max("area") / F.min("area")).alias("area_ratio"))
    return out.withColumn("warning", (F.greatest("span_x", "span_y") < least_span) & F.coalesce(F.col("area_ratio") < least_ratio, F.lit(False)))


def quality_status(df: DataFrame, formal: int = 18, provisional: int = 4, most_rmse: float = 0.75, most_p95: float = 1.2, most_error: float = 2.25, most_left_out: float = 1.2) -> DataFrame:
    """df (pairs, rmse, p95, max_error, left_out: the worst RMSE of leaving a pair out, warning: of diversity) with status; only too few pairs fail."""
    fits = (F.col("rmse") <= most_rmse) & (F.col("p95") <= most_p95) & (F.col("max_error") <= most_error) & (F.col("left_out") <= most_left_out)
    fits = F.coalesce(fits, F.lit(False))
    return df.withColumn("status", F.when(F.col("pairs") < provisional, "failed").when(F.col("warning") | ~fits, "provisional_warning").when(F.col("pairs") >= formal, "formal").otherwise("provisional"))


def refine_gate(df: DataFrame, inliers: int = 20, ratio: float = 0.4, coverage: float = 0.15, median: float = 2.0, area: tuple[float, float] = (0.7, 1.4)) -> DataFrame:
    """df (inliers, matches, coverage, median_error, area_ratio) with accepted."""
    ok = (F.col("inliers") >= inliers) & (F.try_divide("inliers", "matches") >= ratio) & (F.col("coverage") >= coverage) & (F.col("median_error") <= median) & F.col("area_ratio").between(*area)
    return df.withColumn("accepted", F.coalesce(ok, F.lit(False)))


def geometric_rating(df: DataFrame) -> DataFrame:
    """df (board_accepted, board_rmse, refined, median_error, coverage, calibration_good) with one rating: by the board's corners if they were found, else by the pair's refinement, else by the calibration."""
    by_board = F.when(F.col("board_rmse") <= 1.0, "excellent").when(F.col("board_rmse") <= 2.0, "good").otherwise("review_required")
    excellent = F.col("refined") & (F.col("median_error") <= 0.5) & (F.col("coverage") >= 0.5)
    return df.withColumn("rating", F.when(F.col("board_accepted"), by_board).when(excellent, "excellent").when(F.col("refined"), "good").when(F.col("calibration_good"), "calibration_model_passed").otherwise("calibration_fallback_review_required"))
