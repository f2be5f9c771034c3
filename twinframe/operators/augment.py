"""Augmentation of paired frames: every change is drawn by seed, epoch and id, so that an epoch can be made again on any cluster."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import _each, image

#: What luma weighs in colour changes.
GREY = (0.2989, 0.587, 0.114)


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that the parts fix."""
    h = F.sha2(F.concat_ws(":", *(p.cast("string") for p in parts)), 256)
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / float(1 << 48)


def augment_params(samples: DataFrame, seed: int, epoch: int, crop: int, training: bool = True, flip: float = 0.5, flip_v: float = 0.0, rotate: float = 0.0, degrees: float = 5.0, colour: float = 0.5, brightness: float = 0.1, contrast: float = 0.1, saturation: float = 0.1, hue: float = 0.02) -> DataFrame:
    """samples (sample_id, height, width) -> crop_y, crop_x, angle, flip, flip_v, brightness, contrast, saturation, hue.

    flip, flip_v, rotate and colour are probabilities; what isn't drawn changes nothing (angle and hue 0, factors 1). Angles
    are within degrees either way, factors within brightness, contrast and saturation of 1, hue within a share of the
    circle. Evaluation takes the centre and no change. Frames smaller than the crop have only one place.
    """
    for p in (flip, flip_v, rotate, colour):
        if not 0 <= p <= 1:
            raise ValueError(f"{p} is no probability")
    draw = lambda salt: uniform(F.lit(seed), F.lit(epoch), F.col("sample_id"), F.lit(salt))
    room = lambda c: F.greatest(F.col(c) - crop, F.lit(0))
    names = ("crop_y", "crop_x", "angle", "flip", "flip_v", "brightness", "contrast", "saturation", "hue")
    if not training:
        values = [F.floor(room("height") / 2).cast("int"), F.floor(room("width") / 2).cast("int"), F.lit(0.0), F.lit(False), F.lit(False), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(0.0)]
        return samples.select("sample_id", *(v.alias(n) for n, v in zip(names, values, strict=True)))
    either = lambda salt, size: size * (2 * draw(salt) - 1)
    if_drawn = lambda salt, p, value, none: F.when(draw(salt) < p, value).otherwise(none)
    factor = lambda salt, size: if_drawn("colour", colour, 1 + either(salt, size), 1.0)
    values = [
        F.floor(draw("y") * (room("height") + 1)).cast("int"), F.floor(draw("x") * (room("width") + 1)).cast("int"), if_drawn("rotate", rotate, either("angle", degrees), 0.0), draw("flip") < flip, draw("flip_v") < flip_v,
        factor("brightness", brightness), factor("contrast", contrast), factor("saturation", saturation), if_drawn("colour", colour, either("hue", hue), 0.0),
    ]
    return samples.select("sample_id", *(v.alias(n) for n, v in zip(names, values, strict=True)))


def padded(a: np.ndarray, sides: list[tuple[int, int]], mode: str) -> np.ndarray:
    """a with so many more pixels on each side: mirrored, or, where the padding is as wide as the frame, with its border."""
    narrow = any(max(s) >= n for s, n in zip(sides, a.shape, strict=True))
    return np.pad(a, sides, mode="edge" if narrow or mode == "replicate" else "reflect")


def rotated(a: np.ndarray, angle: float, mode: str = "reflect") -> np.ndarray:
    """a turned about its middle by angle degrees, against the clock, in its own size.

    Pixels are bilinear values of a with a padding wide enough for the angle; what lies beyond even that counts as 0.
    """
    if not angle:
        return a
    h, w = a.shape
    rim = max(1, math.ceil(max(h, w) * math.sin(math.radians(abs(angle)))))
    wide = np.pad(padded(a, [(rim, rim), (rim, rim)], mode), 1)  # and a ring of zeros
    y, x = np.indices(a.shape, dtype=np.float64)
    y, x = y - (h - 1) / 2, x - (w - 1) / 2
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    sy = np.clip(s * x + c * y + (h - 1) / 2 + rim + 1, 0, wide.shape[0] - 1.001)
    sx = np.clip(c * x - s * y + (w - 1) / 2 + rim + 1, 0, wide.shape[1] - 1.001)
    iy, ix = np.floor(sy).astype(int), np.floor(sx).astype(int)
    fy, fx = sy - iy, sx - ix
    row = lambda k: wide[iy + k, ix] * (1 - fx) + wide[iy + k, ix + 1] * fx
    return row(0) * (1 - fy) + row(1) * fy


def cropped(a: np.ndarray, y: int, x: int, flip: bool, crop: int, mode: str = "reflect", angle: float = 0.0, flip_v: bool = False) -> np.ndarray:
    """A crop x crop part of a, which is padded evenly on both sides first where it is smaller; then turned, then flipped."""
    high, wide = max(0, crop - a.shape[0]), max(0, crop - a.shape[1])
    if high or wide:
        a = padded(a, [(high // 2, high - high // 2), (wide // 2, wide - wide // 2)], mode)
    part = rotated(a[y : y + crop, x : x + crop], angle, mode)
    part = part[:, ::-1] if flip else part
    return part[::-1] if flip_v else part


def apply_geometry(frames: DataFrame, params: DataFrame, crop: int, values: tuple[str, ...] = ("v",), mode: str = "reflect") -> DataFrame:
    """Pad, crop, turn and flip all modalities (values) of a frame by its parameters (frame_id, crop_y, crop_x, flip, and, if there, angle and flip_v), which they share."""
    have = {"angle": F.lit(0.0), "flip_v": F.lit(False)} | {c: F.col(c) for c in params.columns}
    own = ["crop_y", "crop_x", "flip", "angle", "flip_v"]
    rows = frames.join(params.select("frame_id", *(have[c].alias(f"_{c}") for c in own)), "frame_id")
    at = [F.col(c) for c in ("height", "width", *(f"_{c}" for c in own))]
    made = {c: _each("array<double>", lambda v, h, w, y, x, f, a, f_v: cropped(image(v, h, w), y, x, f, crop, mode, a, f_v).ravel(), F.col(c), *at) for c in values}
    return rows.withColumns(made).withColumns({"height": F.lit(crop), "width": F.lit(crop)}).drop(*(f"_{c}" for c in own))


def _hue_turned(rgb: np.ndarray, turn: float) -> np.ndarray:
    """Colours (3 x pixels) whose hue is moved by a share of the circle, through hue, saturation and value."""
    top, low = rgb.max(axis=0), rgb.min(axis=0)
    span = top - low
    safe = np.where(span > 0, span, 1)
    first = rgb.argmax(axis=0)
    after, before = np.take_along_axis(rgb, ((first + 1) % 3)[None], 0)[0], np.take_along_axis(rgb, ((first + 2) % 3)[None], 0)[0]
    hue = np.where(span > 0, (2 * first + (after - before) / safe) / 6, 0) + turn
    k = (np.array([5, 3, 1])[:, None] + 6 * (hue % 1)[None]) % 6
    return top - span * np.clip(np.minimum(k, 4 - k), 0, 1)


def coloured(rgb: np.ndarray, brightness: float, contrast: float, saturation: float, hue: float) -> np.ndarray:
    """Three channels (3 x pixels) in [0, 1] after brightness, contrast (against the frame's mean grey), saturation (against each pixel's grey) and hue, each cut to [0, 1]."""
    mixed = lambda a, b, k: np.clip(k * a + (1 - k) * b, 0, 1)
    grey = lambda a: np.tensordot(GREY, a, 1)
    rgb = mixed(rgb, 0.0, brightness)
    rgb = mixed(rgb, grey(rgb).mean(), contrast)
    rgb = mixed(rgb, grey(rgb)[None], saturation)
    return np.clip(_hue_turned(rgb, hue) if hue else rgb, 0, 1)


def apply_colour(frames: DataFrame, params: DataFrame, channels: tuple[str, str, str] = ("r", "g", "b")) -> DataFrame:
    """The three channels of the visible modality changed by a frame's parameters (frame_id, brightness, contrast, saturation, hue); the other modality has no colour to change."""
    own = ["brightness", "contrast", "saturation", "hue"]
    rows = frames.join(params.select("frame_id", *(F.col(c).alias(f"_{c}") for c in own)), "frame_id")
    fn = lambda r, g, b, *k: list(coloured(np.array([r, g, b], np.float64), *k))
    made = _each("struct<r: array<double>, g: array<double>, b: array<double>>", fn, *(F.col(c) for c in channels), *(F.col(f"_{c}") for c in own))
    rows = rows.withColumn("_c", made)
    return rows.withColumns({c: F.col(f"_c.{n}") for c, n in zip(channels, "rgb", strict=True)}).drop("_c", *(f"_{c}" for c in own))
