"""Functions of a frame's pixels as columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def image(v, height, width) -> np.ndarray:
    return np.asarray(v, np.float64).reshape(int(height), int(width))


def _each(returns: str, fn: Callable, *columns: Column) -> Column:
    """fn of the columns' values, row by row in Arrow batches; null where one of them is null."""
    names = [n.split()[0] for n in returns.removeprefix("struct<").removesuffix(">").replace(":", " ").split(", ")] if returns.startswith("struct<") else None

    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series | pd.DataFrame]:
        for batch in parts:
            out = [None if any(x is None or x is pd.NA or (isinstance(x, float) and x != x) for x in row) else fn(*row) for row in zip(*batch, strict=True)]
            yield pd.Series(out, dtype=object) if names is None else pd.DataFrame([r or [None] * len(names) for r in out], columns=names)

    run.__annotations__ = {"parts": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series] if names is None else Iterator[pd.DataFrame]}
    return F.pandas_udf(run, returns)(*columns)
