"""Pixel work on frames (frame_id, height, width, v array<double>: its pixels row by row).

A frame is one row, so what happens inside a frame needs no shuffle: element-wise work is in Spark's array functions,
neighbourhoods are numpy inside Arrow-batched functions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import _each, image
from .resample import resampled

LAPLACIAN = {(0, 0): -4.0, (0, 1): 1.0, (0, -1): 1.0, (1, 0): 1.0, (-1, 0): 1.0}


def from_pixels(pixels: DataFrame) -> DataFrame:
    """Rows (frame_id, y, x, v) of whole frames as frames."""
    own = F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "v"))), lambda p: p["v"].cast("double"))
    return pixels.groupBy("frame_id").agg((F.max("y") + 1).cast("int").alias("height"), (F.max("x") + 1).cast("int").alias("width"), own.alias("v"))


def to_pixels(frames: DataFrame, *also: str) -> DataFrame:
    """frame_id, y, x, v of frames; null pixels have no row."""
    # outer: else Spark first drops rows without pixels by a filter of its own, for which it makes the frames a second time
    rows = frames.select("frame_id", "width", *also, F.posexplode_outer("v").alias("i", "v")).where("v is not null")
    return rows.select("frame_id", F.expr("cast(i div width as int)").alias("y"), F.expr("cast(i % width as int)").alias("x"), "v", *also)


def convolved(a: np.ndarray, weights: dict[tuple[int, int], float], border: str = "zero") -> np.ndarray:
    """Sum of w * a(y + dy, x + dx). Beyond the border are zeros, the nearest pixel for border='replicate', or, for 'mirror', the frame turned over at its outermost pixels, which aren't repeated."""
    reach = max(max(abs(dy), abs(dx)) for dy, dx in weights)
    wide = np.pad(a, reach, mode={"replicate": "edge", "mirror": "reflect"}.get(border, "constant"))
    h, w = a.shape
    return sum(k * wide[reach + dy : reach + dy + h, reach + dx : reach + dx + w] for (dy, dx), k in weights.items())


def gradient_length(a: np.ndarray) -> np.ndarray:
    """Length of the gradient: central differences, one-sided at borders, none along an axis of one pixel."""
    slope = lambda axis: np.gradient(a, axis=axis) if a.shape[axis] > 1 else np.zeros_like(a)
    return np.hypot(slope(0), slope(1))


def forward_gradient(a: np.ndarray) -> np.ndarray:
    """Length of the steps to the next pixel right and below, none beyond the border, and never quite zero."""
    step = lambda axis: np.diff(a, axis=axis, append=np.take(a, [-1], axis=axis))
    return np.sqrt(step(0) ** 2 + step(1) ** 2 + 1e-8)


def gaussian(window: int = 11, sigma: float = 1.5) -> list[float]:
    raw = [math.exp(-((i - window // 2) ** 2) / (2 * sigma * sigma)) for i in range(window)]
    return [x / sum(raw) for x in raw]


def similarity(a: np.ndarray, b: np.ndarray, window: int = 11, sigma: float = 1.5) -> float:
    """Mean structural similarity: Gaussian means of a, b, aa, bb and ab, two one-dimensional passes each, zeros outside."""
    half, g = window // 2, gaussian(window, sigma)

    def blurred(x: np.ndarray) -> np.ndarray:
        for axis in (0, 1):
            wide = np.pad(x, [(half, half) if k == axis else (0, 0) for k in (0, 1)])
            x = sum(w * np.take(wide, range(i, i + x.shape[axis]), axis=axis) for i, w in enumerate(g))
        return x

    ma, mb, aa, bb, ab = (blurred(x) for x in (a, b, a * a, b * b, a * b))
    c1, c2 = 1e-4, 9e-4  # fixed values of the measure
    return float(np.mean(((2 * ma * mb + c1) * (2 * (ab - ma * mb) + c2)) / ((ma * ma + mb * mb + c1) * ((aa - ma * ma) + (bb - mb * mb) + c2))))


def convolve(v: Column, height: Column, width: Column, weights: dict[tuple[int, int], float], border: str = "zero") -> Column:
    return _each("array<double>", lambda *f: convolved(image(*f), weights, border).ravel(), v, height, width)


def sharpness(v: Column, height: Column, width: Column, widest: int = 480) -> Column:
    """Population variance of the Laplacian, mirrored at the borders, of the frame, which is shrunk by areas first if it is wider than widest."""
    def of(x, h, w) -> float:
        a = image(x, h, w)
        if a.shape[1] > widest:
            a = resampled(a, max(1, int(a.shape[0] * widest / a.shape[1])), widest, "area")
        return float(convolved(a, LAPLACIAN, "mirror").var())

    return _each("double", of, v, height, width)


def edge_correlation(ir: Column, rgb: Column, height: Column, width: Column, to_width: int = 256) -> Column:
    """Correlation of the gradient lengths of two modalities, both brought to one width first; null where one is flat or sizes differ."""
    def r(a, b, h, w) -> float | None:
        if len(a) != len(b):
            return None
        size = max(1, round(int(h) * to_width / int(w))), to_width
        x, y = (gradient_length(resampled(image(m, h, w), *size, "bilinear")).ravel() for m in (a, b))
        sx, sy = x.std(), y.std()
        return float(np.mean((x - x.mean()) * (y - y.mean())) / (sx * sy)) if sx >= 1e-8 and sy >= 1e-8 else None

    return _each("double", r, ir, rgb, height, width)


def ssim(a: Column, b: Column, height: Column, width: Column) -> Column:
    return _each("double", lambda x, y, h, w: similarity(image(x, h, w), image(y, h, w)), a, b, height, width)


def fusion_quality(fused: Column, ir: Column, vis: Column, height: Column, width: Column, weights: tuple[float, float, float, float] = (1.0, 10.0, 5.0, 2.0)) -> Column:
    """intensity and gradient: errors against the larger of the two modalities; structure: 1 - SSIM against the better one; edge: the error against the stronger Laplacian; and their weighted total."""
    def scores(f, i, r, h, w) -> list[float]:
        f, i, r = (image(x, h, w) for x in (f, i, r))
        error = lambda of: float(np.mean(np.abs(of(f) - np.maximum(of(i), of(r)))))
        parts = [error(lambda x: x), error(forward_gradient), 1 - max(similarity(f, i), similarity(f, r)), error(lambda x: np.abs(convolved(x, LAPLACIAN)))]
        return [*parts, sum(k * p for k, p in zip(weights, parts, strict=True))]

    return _each("struct<intensity: double, gradient: double, structure: double, edge: double, total: double>", scores, fused, ir, vis, height, width)


def normalise_8bit(v: Column) -> Column:
    """Values from the frame's minimum to its maximum as 0 to 255; not finite counts as 0, flat frames are 0."""
    finite = F.transform(v, lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x))
    lo, hi = F.array_min(finite), F.array_max(finite)
    return F.transform(finite, lambda x: F.when(hi > lo, F.floor((x - lo) / (hi - lo) * 255)).otherwise(0).cast("int"))


def check_unit_range(v: Column) -> Column:
    return F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (x >= 0) & (x <= 1), F.lit(False)))


def luma(r: Column, g: Column, b: Column) -> Column:
    """Grey pixels, ITU-R BT.601."""
    return F.zip_with(F.zip_with(r, g, lambda x, y: 0.299 * x + 0.587 * y), b, lambda x, y: x + 0.114 * y)


def mean(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)


def motion_signal(frames: DataFrame, clip: str, t: str) -> DataFrame:
    """clip, i, motion: mean absolute difference of each frame to the one before in its clip, from the second on; frames that are missing are skipped, not gaps."""
    w = W.partitionBy(clip).orderBy(t)
    rows = frames.withColumn("i", F.row_number().over(w)).withColumn("p", F.lag("v").over(w)).where("p is not null")
    return rows.select(clip, "i", mean(F.zip_with("v", "p", lambda x, y: F.abs(x - y))).alias("motion"))


def warp(v: Column, height: Column, width: Column, h: Column) -> Column:
    """The frame seen through h (nine numbers, target to source): v, bilinear values, null where no source pixel is near; overlap, the share of targets whose nearest source pixel exists."""
    def warped(v, height, width, h) -> list:
        a = image(v, height, width)
        y, x = np.indices(a.shape, dtype=np.float64)
        d = h[6] * x + h[7] * y + h[8]
        with np.errstate(divide="ignore", invalid="ignore"):
            sx, sy = (h[0] * x + h[1] * y + h[2]) / d, (h[3] * x + h[4] * y + h[5]) / d
        far = ~(np.isfinite(sx) & np.isfinite(sy))
        sx[far] = sy[far] = -9.0
        total, known = np.zeros_like(a), np.zeros(a.shape, bool)
        for dy in (0, 1):
            for dx in (0, 1):
                iy, ix = np.floor(sy) + dy, np.floor(sx) + dx
                inside = (iy >= 0) & (iy < a.shape[0]) & (ix >= 0) & (ix < a.shape[1])
                w = (1 - np.abs(sx - ix)) * (1 - np.abs(sy - iy))
                total[inside] += (w[inside]) * a[iy[inside].astype(int), ix[inside].astype(int)]
                known |= inside
        near = lambda c, n: (np.floor(c + 0.5) >= 0) & (np.floor(c + 0.5) <= n - 1)
        return [[float(t) if k else None for t, k in zip(total.ravel(), known.ravel(), strict=True)], float(np.mean(near(sx, a.shape[1]) & near(sy, a.shape[0])))]

    return _each("struct<v: array<double>, overlap: double>", warped, v, height, width, h)


def temporal_consensus(points: DataFrame, least: int = 2) -> DataFrame:
    """points (clip, frame, y, x): edge points that stand in at least so many frames."""
    return points.groupBy("clip", "y", "x").agg(F.countDistinct("frame").alias("frames")).where(F.col("frames") >= least)


def median_background(frames: DataFrame, clip: str) -> DataFrame:
    """clip, height, width, v: the median of each pixel over the frames of a clip, which are few (its representatives) and of one size."""
    def median(f: pd.DataFrame) -> pd.DataFrame:
        out = f[[clip, "height", "width"]].head(1).copy()
        out["v"] = [np.median(np.stack(f["v"].to_list()), axis=0).tolist()]
        return out

    kind = dict(frames.dtypes)[clip]
    return frames.select(clip, "height", "width", "v").groupBy(clip).applyInPandas(median, f"`{clip}` {kind}, height int, width int, v array<double>")


def _envelope(f: np.ndarray) -> np.ndarray:
    """min over q of f[:, q] + (x - q)^2 for every x: the lower envelope of each row's parabolas, all rows at once."""
    rows, n = f.shape
    at = np.arange(rows)
    apex, edge, k = np.zeros((rows, n), int), np.full((rows, n + 1), np.inf), np.zeros(rows, int)
    edge[:, 0] = -np.inf
    for q in range(1, n):
        while True:  # parabolas that the new one covers go
            p = apex[at, k]
            meet = ((f[:, q] + q * q) - (f[at, p] + p * p)) / (2 * (q - p))
            covered = (meet <= edge[at, k]) & (k > 0)
            if not covered.any():
                break
            k[covered] -= 1
        k += 1
        apex[at, k], edge[at, k] = q, meet
        edge[at, k + 1] = np.inf
    out, k = np.empty((rows, n)), np.zeros(rows, int)
    for x in range(n):
        while (later := edge[at, k + 1] < x).any():
            k[later] += 1
        p = apex[at, k]
        out[:, x] = f[at, p] + (x - p) ** 2
    return out


def distances(marks: np.ndarray) -> np.ndarray:
    """From every pixel to the nearest mark, exact, at any distance: down the columns, then along the rows; infinite without a mark."""
    if not marks.any():
        return np.full(marks.shape, np.inf)
    far = float(marks.shape[0] ** 2 + marks.shape[1] ** 2)  # more than any distance in the frame
    return np.sqrt(_envelope(_envelope(np.where(marks, 0.0, far).T).T))


def edge_distances(a: np.ndarray, b: np.ndarray, valid: np.ndarray | None = None) -> list:
    """median, p75, p90 and the share within 1.5 of the distances from marks of a to b and from b to a, within the valid region; all null, and a share of 0, where a side has no mark."""
    a, b = (a, b) if valid is None else (a & valid, b & valid)
    if not (a.any() and b.any()):
        return [None, None, None, 0.0]
    d = np.concatenate([distances(b)[a], distances(a)[b]])
    return [*np.percentile(d, [50, 75, 90]).tolist(), float(np.mean(d <= 1.5))]


_DISTANCES = "struct<median: double, p75: double, p90: double, within: double>"


def edge_agreement(a: Column, b: Column, valid: Column, height: Column, width: Column) -> Column:
    """edge_distances() of two frames of edges, marked by values above zero, where valid is above zero."""
    return _each(_DISTANCES, lambda x, y, m, h, w: edge_distances(image(x, h, w) > 0, image(y, h, w) > 0, image(m, h, w) > 0), a, b, valid, height, width)


def chamfer(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """a, b (by, y, x: whole numbers): edge_distances() of the points of each frame, one that has points on one side alone among them; a frame's points are a group."""
    def of(ay, ax, by_, bx) -> list:
        if not (len(ay) and len(by_)):
            return [None, None, None, 0.0]
        y, x = np.concatenate([ay, by_]), np.concatenate([ax, bx])
        sides = []
        for py, px in ((ay, ax), (by_, bx)):
            marks = np.zeros((y.max() - y.min() + 1, x.max() - x.min() + 1), bool)
            marks[py - y.min(), px - x.min()] = True
            sides.append(marks)
        return edge_distances(*sides)

    names = ["_ay", "_ax", "_by", "_bx"]
    side = lambda df, s: df.where("y is not null and x is not null").select(by, *(F.when(F.lit(n[1] == s), F.col(n[2]).cast("int")).alias(n) for n in names))
    rows = side(a, "a").union(side(b, "b")).groupBy(by).agg(*(F.collect_list(n).alias(n) for n in names))
    return rows.select(by, _each(_DISTANCES, of, *(F.col(n) for n in names)).alias("d")).select(by, "d.*")


def chamfer_rating(scores: DataFrame) -> DataFrame:
    """scores (median, p75) with rating; moving content weighs on the highest distances, so they don't count."""
    return scores.withColumn("rating", F.expr("case when median is null then 'unavailable' when median <= 1 and p75 <= 4 then 'excellent' when median <= 2 and p75 <= 8 then 'good' when median <= 4 then 'fair' else 'poor' end"))


def tile_starts(size: Column, tile: int, overlap: int) -> Column:
    """Positions a stride apart, and a last one flush to the edge."""
    last = F.greatest(size - tile, F.lit(0))
    return F.array_union(F.sequence(F.lit(0), last, F.lit(tile - overlap)), F.array(last))


def plan_tiles(frames: DataFrame, tile: int, overlap: int) -> DataFrame:
    """frames (frame_id, height, width) -> frame_id, y0, x0."""
    rows = frames.select("frame_id", F.explode(tile_starts(F.col("height"), tile, overlap)).alias("y0"), "width")
    return rows.select("frame_id", "y0", F.explode(tile_starts(F.col("width"), tile, overlap)).alias("x0"))


def hann(tile: int, other: int | None = None, least: float = 1e-3) -> np.ndarray:
    """Weights of a tile: the product of two raised cosines that are 0 at both ends, kept above zero."""
    one = lambda n: 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1)) if n > 1 else np.ones(1)
    return np.maximum(least, np.outer(one(tile), one(tile if other is None else other)))


def starts(size: int, tile: int, overlap: int) -> list[int]:
    last = max(size - tile, 0)
    return sorted({*range(0, last, tile - overlap), last})


def checked(values: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """values, if they have the shape and are all finite."""
    values = np.asarray(values, np.float64)
    if values.shape != shape:
        raise ValueError(f"a score has the shape {values.shape}, not {shape}")
    if not np.isfinite(values).all():
        raise ValueError("a score isn't finite")
    return values


def blended(scored: list[tuple[int, int, np.ndarray]], shape: tuple[int, int]) -> np.ndarray:
    """Tiles (y0, x0, values) averaged by raised cosines; a pixel without a tile is an error."""
    total, weight = np.zeros(shape), np.zeros(shape)
    for y0, x0, values in scored:
        h, w = values.shape
        k = hann(h, w)
        total[y0 : y0 + h, x0 : x0 + w] += k * values
        weight[y0 : y0 + h, x0 : x0 + w] += k
    if not weight.all():
        raise ValueError("a pixel has no tile")
    return total / weight


def score_tiled(frames: DataFrame, fn: Callable[[np.ndarray], np.ndarray], tile: int, overlap: int, factor: int = 1, mode: str = "reflect") -> DataFrame:
    """frames with v as fn makes it, applied to overlapping tiles (n x tile x tile) whose results, of the same shape and finite, are blended; a frame's tiles stay in its task.

    A frame smaller than a tile is padded right and below first, and cut back at the end. The tile has to be a multiple of
    the factor by which fn halves its input.
    """
    if tile <= 0 or tile % factor:
        raise ValueError(f"a tile of {tile} is no multiple of {factor}")
    if not 0 <= overlap < tile:
        raise ValueError("tiles overlap by less than a tile")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            out = []
            for v, height, width in zip(f["v"], f["height"], f["width"], strict=True):
                own = image(v, height, width)
                sides = [(0, max(0, tile - n)) for n in own.shape]
                narrow = any(s[1] >= n for s, n in zip(sides, own.shape, strict=True))
                a = np.pad(own, sides, mode="edge" if narrow or mode == "replicate" else "reflect")
                at = [(y, x) for y in starts(a.shape[0], tile, overlap) for x in starts(a.shape[1], tile, overlap)]
                tiles = np.stack([a[y : y + tile, x : x + tile] for y, x in at])
                scored = checked(fn(tiles), tiles.shape)
                out.append(blended([(y, x, t) for (y, x), t in zip(at, scored, strict=True)], a.shape)[: own.shape[0], : own.shape[1]].ravel())
            f["v"] = out
            yield f

    return frames.mapInPandas(run, frames.schema)


def score(frames: DataFrame, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """frames with v as fn makes it of a whole frame; another shape or values that aren't finite are an error."""
    return frames.withColumn("v", _each("array<double>", lambda v, h, w: checked(fn(image(v, h, w)), (int(h), int(w))).ravel(), F.col("v"), F.col("height"), F.col("width")))


def baseline(a: Column, b: Column, how: str = "mean") -> Column:
    """The mean or the maximum of two modalities, pixel by pixel."""
    return F.zip_with(a, b, (lambda x, y: (x + y) / 2) if how == "mean" else F.greatest)


def blend_masked(a: Column, b: Column, weight: float = 0.5) -> Column:
    """a, blended with b where b has a pixel; all of a where there is no b."""
    return F.when(b.isNull(), a).otherwise(F.zip_with(a, b, lambda x, y: F.when(y.isNull(), x).otherwise(weight * x + (1 - weight) * y)))
