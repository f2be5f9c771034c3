"""Resampling of frames: one matrix of weights for each axis, so that a frame is two matrix products."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column

from .frames import _each, image


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


def _triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1 - np.abs(x))


#: Kernels over distances in source pixels, and how far they reach.
KERNELS = {"lanczos": (_lanczos, 3.0), "bilinear": (_triangle, 1.0)}


@lru_cache(256)
def weights(size: int, out: int, how: str) -> np.ndarray:
    """out x size: what each source pixel adds to each target pixel; rows add up to 1.

    lanczos and bilinear widen their kernels where they shrink, and see no further than the pixels whose middles lie within
    reach. area takes each source pixel by the share of the target that it covers; to enlarge, take another.
    """
    scale = size / out
    if how == "area":
        if scale < 1:
            raise ValueError("areas only shrink")
        edge = np.arange(out)[:, None] * scale
        w = np.clip(np.minimum(edge + scale, np.arange(1, size + 1)) - np.maximum(edge, np.arange(size)), 0, None)
    else:
        kernel, reach = KERNELS[how]
        wide = max(1.0, scale)
        middle = (np.arange(out) + 0.5)[:, None] * scale
        first, last = np.maximum(0, np.floor(middle - reach * wide + 0.5)), np.minimum(size, np.floor(middle + reach * wide + 0.5))
        at = np.arange(size)[None]
        w = np.where((at >= first) & (at < last), kernel((at + 0.5 - middle) / wide), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resampled(a: np.ndarray, height: int, width: int, how: str, levels: int = 0) -> np.ndarray:
    """a in another size: rows first, then columns; with levels (255 for bytes), each pass is rounded and cut to 0..levels, as it is for images of whole numbers."""
    whole = (lambda x: np.clip(np.floor(x + 0.5), 0, levels)) if levels else (lambda x: x)
    return whole(weights(a.shape[0], height, how) @ whole(a @ weights(a.shape[1], width, how).T))


def fitted(height: int, width: int, longest: int) -> tuple[int, int]:
    """The size of a frame that is shrunk, if it has to be, to longest on its longer side."""
    ratio = min(1.0, longest / max(height, width))
    return max(1, round(height * ratio)), max(1, round(width * ratio))


def resample(v: Column, height: Column, width: Column, to_height: Column, to_width: Column, how: str = "lanczos", levels: int = 0) -> Column:
    """Pixels of the frame in another size."""
    return _each("array<double>", lambda x, h, w, th, tw: resampled(image(x, h, w), int(th), int(tw), how, levels).ravel(), v, height, width, to_height, to_width)
