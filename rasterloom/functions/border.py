"""Border modes as functions on coordinates: where a coordinate outside 0..n-1 reads from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def border_coordinate(v: Column, n: Column | int, mode: str) -> Column:
    """The coordinate inside 0..n-1 that v reads, null where it reads zero."""
    n = F.lit(n) if isinstance(n, int) else n
    if mode == "zero":
        return F.when((v >= 0) & (v < n), v)
    if mode == "clamp":
        return F.least(F.greatest(v, F.lit(0)), n - 1)
    if mode == "reflect":  # mirrored without repeating the edge sample
        period = (n - 1) * 2
        m = F.abs(v) % F.greatest(period, F.lit(1))
        return F.when(n == 1, F.lit(0)).otherwise(F.when(m >= n, period - m).otherwise(m)).cast("int")
    raise ValueError(f"unknown border mode {mode!r}")


def border_index(v: np.ndarray, n: int, mode: str) -> np.ndarray:
    """border_coordinate on arrays; -1 where it reads zero."""
    if mode == "zero":
        return np.where((v >= 0) & (v < n), v, -1)
    if mode == "clamp":
        return np.clip(v, 0, n - 1)
    if mode == "reflect":
        if n == 1:
            return np.zeros_like(v)
        m = np.abs(v) % (2 * (n - 1))
        return np.where(m >= n, 2 * (n - 1) - m, m)
    raise ValueError(f"unknown border mode {mode!r}")
