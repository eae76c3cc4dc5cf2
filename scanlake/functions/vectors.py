"""Array expressions for descriptors: metrics, circular shifts, column-wise similarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from scanlake.functions.angles import wrap_angle


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def as_double(a: Column) -> Column:
    return a.cast("array<double>")


def l1(a: Column, b: Column) -> Column:
    return _total(F.zip_with(as_double(a), as_double(b), lambda x, y: F.abs(x - y)))


def l2_squared(a: Column, b: Column) -> Column:
    return _total(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)))


def so2(a: Column, b: Column) -> Column:
    """Wrapped difference, with its sign, of the last components."""
    return wrap_angle(F.element_at(as_double(b), -1) - F.element_at(as_double(a), -1))


def so3(a: Column, b: Column) -> Column:
    """Squared Euclidean distance, as used for rotations kept as quaternions."""
    return l2_squared(a, b)


def circular_shift(a: Column, n: Column | int) -> Column:
    """``a`` moved right by ``n`` places, the tail wrapping to the front."""
    size = F.size(a)
    n = F.pmod((F.lit(n) if isinstance(n, int) else n).cast("int"), size)
    return F.concat(F.slice(a, size - n + 1, n), F.slice(a, F.lit(1), size - n))


def best_shift(a: Column, b: Column) -> Column:
    """The right shift of ``b`` that is nearest to ``a``; the smallest one on ties."""
    shifts = F.sequence(F.lit(0), F.size(b) - 1)
    scored = F.transform(
        shifts,
        lambda s: F.struct(l2_squared(a, circular_shift(b, s)).alias("d"), s.alias("s")),
    )
    return F.array_min(scored)["s"]


def _best_shifts(a: pd.Series, b: pd.Series) -> pd.Series:
    out = np.zeros(len(a), np.int32)
    sizes = np.fromiter(map(len, b), np.int64, len(b))
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        for some in np.array_split(rows, len(rows) // 4096 + 1):
            out[some] = nearest_shifts(*(np.stack([np.asarray(x, float) for x in side.iloc[some]]) for side in (a, b)))
    return pd.Series(out)


def nearest_shifts(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``best_shift`` of rows of two matrices."""
    n = u.shape[1]
    if not n:
        return np.zeros(len(u), np.int32)
    twice = np.concatenate([v, v], axis=1)
    total = np.zeros((len(u), n))
    for i in range(n):
        off = u[:, i, None] - twice[:, i + n : i : -1]
        off *= off
        total += off
    return np.where(np.isnan(total), np.inf, total).argmin(axis=1).astype(np.int32)


def best_shifts(a: Column, b: Column) -> Column:
    """``best_shift`` of arrays of equal lengths, many rows at a time; terms are added in the same order."""
    return F.pandas_udf(_best_shifts, "int")(a, b)


def permute_covariance(c: Column, order: list[int]) -> Column:
    """A row-major square covariance with rows and columns taken in ``order``."""
    n = len(order)
    places = [order[i] * n + order[j] for i in range(n) for j in range(n)]
    return F.transform(F.array(*[F.lit(p) for p in places]), lambda p: F.get(c, p))


def covariance_block(c: Column, n: int, rows: list[int], cols: list[int]) -> Column:
    """A row-major block of a row-major ``n`` x ``n`` covariance."""
    places = [i * n + j for i in rows for j in cols]
    return F.transform(F.array(*[F.lit(p) for p in places]), lambda p: F.get(c, p))
