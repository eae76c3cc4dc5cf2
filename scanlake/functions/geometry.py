"""Distances, 3x3 linear algebra and voxel keys as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = Sequence[Column]
Mat = Sequence[Sequence[Column]]


def norm3(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def dist3(a: Vec, b: Vec) -> Column:
    return norm3(*(p - q for p, q in zip(a, b)))


def dot3(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross3(a: Vec, b: Vec) -> list[Column]:
    return [
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    ]


def matvec(m: Mat, v: Vec) -> list[Column]:
    return [dot3(row, v) for row in m]


def matmul(a: Mat, b: Mat) -> list[list[Column]]:
    cols = list(zip(*b))
    return [[dot3(row, col) for col in cols] for row in a]


def transpose(m: Mat) -> list[list[Column]]:
    return [list(row) for row in zip(*m)]


def symmetric(c: Vec) -> list[list[Column]]:
    """A symmetric matrix from its upper triangle xx, xy, xz, yy, yz, zz."""
    return [[c[0], c[1], c[2]], [c[1], c[3], c[4]], [c[2], c[4], c[5]]]


def upper(m: Mat) -> list[Column]:
    return [m[0][0], m[0][1], m[0][2], m[1][1], m[1][2], m[2][2]]


def det3(m: Mat) -> Column:
    return dot3(m[0], cross3(m[1], m[2]))


def inv3(m: Mat) -> list[list[Column]]:
    """Inverse by cofactors; null where the determinant is zero."""
    det = det3(m)
    safe = F.when(det != 0, det)
    columns = [cross3(m[1], m[2]), cross3(m[2], m[0]), cross3(m[0], m[1])]
    return [[columns[j][i] / safe for j in range(3)] for i in range(3)]


def solve3(m: Mat, b: Vec, tiny: float = 1e-12) -> list[Column]:
    """Cramer's rule; null where the matrix is singular."""
    det = det3(m)
    safe = F.when(F.abs(det) > tiny, det)

    def replaced(i: int) -> list[list[Column]]:
        return [[b[r] if c == i else m[r][c] for c in range(3)] for r in range(3)]

    return [det3(replaced(i)) / safe for i in range(3)]


def point_line_distance(p: Vec, centre: Vec, direction: Vec) -> Column:
    """Distance from ``p`` to the line through ``centre`` along the unit vector ``direction``."""
    return norm3(*cross3([a - b for a, b in zip(p, centre)], direction))


def point_line_normal(p: Vec, centre: Vec, direction: Vec) -> list[Column]:
    """Unit vector from the line to ``p``; null on the line."""
    rel = [a - b for a, b in zip(p, centre)]
    along = dot3(rel, direction)
    away = [r - along * d for r, d in zip(rel, direction)]
    length = norm3(*away)
    safe = F.when(length > 0, length)
    return [a / safe for a in away]


def point_plane_distance(p: Vec, normal: Vec, offset: Column) -> Column:
    """Signed distance to the plane ``normal . p + offset = 0`` with a unit normal."""
    return dot3(p, normal) + offset


def grid_cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(float(size)))


def voxel_key(p: Vec, size: float) -> list[Column]:
    """Cartesian voxel index, offset by half a voxel."""
    return [F.floor(c / F.lit(float(size)) - F.lit(0.5)) for c in p]


def voxel_centre(key: Vec, size: float) -> list[Column]:
    return [(k.cast("double") + 0.5) * float(size) for k in key]


def polar_key(p: Vec, size: Sequence[float]) -> list[Column]:
    """Polar voxel index over azimuth + pi, inclination and range."""
    r = norm3(*p)
    polar = [F.atan2(p[1], p[0]) + math.pi, F.acos(p[2] / F.when(r > 0, r)), r]
    return [F.floor(c / F.lit(float(s))) for c, s in zip(polar, size)]


def polar_centre(key: Vec, size: Sequence[float]) -> list[Column]:
    azimuth, inclination, r = ((k.cast("double") + 0.5) * float(s) for k, s in zip(key, size))
    theta = azimuth - math.pi
    flat = r * F.sin(inclination)
    return [flat * F.cos(theta), flat * F.sin(theta), r * F.cos(inclination)]


def concentration(r_bar: Column) -> Column:
    """Directional concentration of a voxel from its mean resultant length."""
    r2 = r_bar * r_bar
    return (
        F.when(r_bar < 1e-8, F.lit(0.0))
        .when(r_bar < 0.6, 3.0 * r_bar * (1.0 + 0.6 * r2 + (99.0 / 175.0) * r2 * r2))
        .when(r2 == 1.0, F.lit(math.inf))
        .otherwise(r_bar * (3.0 - r2) / (1.0 - r2))
    )
