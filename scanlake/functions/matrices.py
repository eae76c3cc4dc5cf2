"""Small dense solves on rows of flattened matrices, batched through Arrow."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def stack(values: pd.Series, *shape: int) -> np.ndarray:
    if len(values) == 0:
        return np.zeros((0, *shape))
    return np.stack([np.asarray(v, dtype=float) for v in values]).reshape(-1, *shape)


def symmetric3(values: pd.Series) -> np.ndarray:
    """Batch of 3x3 matrices from upper triangles xx, xy, xz, yy, yz, zz."""
    flat = stack(values, 6)
    return flat[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)


def _eigen3(cov: pd.Series) -> pd.DataFrame:
    values, vectors = np.linalg.eigh(symmetric3(cov))
    return pd.DataFrame(
        {"values": list(values), "vectors": list(vectors.transpose(0, 2, 1).reshape(-1, 9))}
    )


def eigen3(cov: Column) -> Column:
    """Ascending eigenvalues and, row by row, unit eigenvectors of a 3x3 covariance."""
    return F.pandas_udf(_eigen3, "struct<values:array<double>,vectors:array<double>>")(cov)


def nearest_psd(n: int, floor: float = 1e-9):
    """A column function: the symmetric matrix with eigenvalues raised to ``floor``."""

    @F.pandas_udf("array<double>")
    def project(cov: pd.Series) -> pd.Series:
        m = stack(cov, n, n)
        m = 0.5 * (m + m.transpose(0, 2, 1))
        values, vectors = np.linalg.eigh(m)
        m = (vectors * np.maximum(values, floor)[:, None, :]) @ vectors.transpose(0, 2, 1)
        m = 0.5 * (m + m.transpose(0, 2, 1))
        return pd.Series(list(m.reshape(-1, n * n)))

    return project


REGULARISATIONS = ("none", "frobenius", "plane", "min_eig", "normalized_min_eig", "plane_s")


def regularise3(method: str):
    """A column function on upper triangles: the regularised 3x3 covariance."""
    if method not in REGULARISATIONS:
        raise ValueError(f"unknown regularisation {method!r}, use one of {REGULARISATIONS}")

    @F.pandas_udf("array<double>")
    def apply(cov: pd.Series) -> pd.Series:
        m = symmetric3(cov)
        if method == "frobenius":
            inv = np.linalg.inv(m + 1e-3 * np.eye(3))
            m = np.linalg.inv(inv / np.linalg.norm(inv, axis=(1, 2))[:, None, None])
        elif method != "none":
            values, vectors = np.linalg.eigh(m)
            values, vectors = values[:, ::-1], vectors[:, :, ::-1]
            if method == "plane":
                values = np.broadcast_to([1.0, 1.0, 1e-3], values.shape)
            elif method == "min_eig":
                values = np.maximum(values, 1e-3)
            elif method == "normalized_min_eig":
                values = np.maximum(values / values[:, :1], 1e-3)
            else:
                values = values / values.sum(axis=1, keepdims=True)
                values[:, 2] = 1e-3
            m = (vectors * values[:, None, :]) @ vectors.transpose(0, 2, 1)
        return pd.Series(list(m.reshape(-1, 9)[:, [0, 1, 2, 4, 5, 8]]))

    return apply


def _rigid_from_cross(cross: pd.Series) -> pd.Series:
    h = stack(cross, 3, 3)
    u, size, vt = np.linalg.svd(h)
    v = vt.transpose(0, 2, 1)
    sign = np.sign(np.linalg.det(v @ u.transpose(0, 2, 1)))
    v[:, :, 2] *= np.where(sign < 0, -1.0, 1.0)[:, None]
    found = list((v @ u.transpose(0, 2, 1)).reshape(-1, 9))
    return pd.Series([None if flat else r for r, flat in zip(found, size[:, 1] <= 1e-9 * size[:, 0])], dtype=object)


def rotation_from_cross(cross: Column) -> Column:
    """Row-major rotation that best turns the source onto the target, from their 3x3
    cross-covariance (source rows, target columns), reflections excluded. Null where all points lie on
    a line, which leaves the turn about it open."""
    return F.pandas_udf(_rigid_from_cross, "array<double>")(cross)


def rpy_matrices(angles: np.ndarray) -> np.ndarray:
    """Rotations ``[row, 3, 3]`` of rows of roll, pitch, yaw."""
    (cr, cp, cy), (sr, sp, sy) = np.cos(angles.T), np.sin(angles.T)
    return np.stack(
        [
            np.stack([cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr], axis=1),
            np.stack([sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr], axis=1),
            np.stack([-sp, cp * sr, cp * cr], axis=1),
        ],
        axis=1,
    )


def rotation_exps(w: np.ndarray) -> np.ndarray:
    """Rotations ``[row, 3, 3]`` of rows of rotation vectors."""
    angle = np.sqrt((w * w).sum(axis=1))
    safe = np.where(angle < 1e-10, 1.0, angle)
    first = np.where(angle < 1e-10, 1.0, np.sin(safe) / safe)[:, None, None]
    second = np.where(angle < 1e-10, 0.5, (1 - np.cos(safe)) / (safe * safe))[:, None, None]
    cross = np.zeros((len(w), 3, 3))
    cross[:, 2, 1], cross[:, 0, 2], cross[:, 1, 0] = w.T
    cross -= cross.transpose(0, 2, 1)
    return np.eye(3) + first * cross + second * (cross @ cross)
