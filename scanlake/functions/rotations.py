"""Rotations as column expressions: matrices, Euler angles, quaternions and exponentials.

Matrices are 3x3 nested lists of columns, quaternions are ``[x, y, z, w]``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanlake.functions.angles import clamp
from scanlake.functions.geometry import dot3, matmul, matvec, norm3

Vec = Sequence[Column]


def rot_x(a: Column) -> list[list[Column]]:
    c, s, o, i = F.cos(a), F.sin(a), F.lit(0.0), F.lit(1.0)
    return [[i, o, o], [o, c, -s], [o, s, c]]


def rot_y(a: Column) -> list[list[Column]]:
    c, s, o, i = F.cos(a), F.sin(a), F.lit(0.0), F.lit(1.0)
    return [[c, o, s], [o, i, o], [-s, o, c]]


def rot_z(a: Column) -> list[list[Column]]:
    c, s, o, i = F.cos(a), F.sin(a), F.lit(0.0), F.lit(1.0)
    return [[c, -s, o], [s, c, o], [o, o, i]]


def rpy_matrix(roll: Column, pitch: Column, yaw: Column) -> list[list[Column]]:
    """Rz(yaw) Ry(pitch) Rx(roll), written out."""
    cr, sr, cp, sp, cy, sy = (
        F.cos(roll), F.sin(roll), F.cos(pitch), F.sin(pitch), F.cos(yaw), F.sin(yaw),
    )
    return [
        [cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr],
        [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr],
        [-sp, cp * sr, cp * cr],
    ]


def matrix_rpy(m) -> list[Column]:
    sin_pitch = clamp(-m[2][0], 1.0)
    return [F.atan2(m[2][1], m[2][2]), F.asin(sin_pitch), F.atan2(m[1][0], m[0][0])]


def rpy_quat(roll: Column, pitch: Column, yaw: Column) -> list[Column]:
    cr, sr = F.cos(roll / 2), F.sin(roll / 2)
    cp, sp = F.cos(pitch / 2), F.sin(pitch / 2)
    cy, sy = F.cos(yaw / 2), F.sin(yaw / 2)
    return [
        sr * cp * cy - cr * sp * sy,
        cr * sp * cy + sr * cp * sy,
        cr * cp * sy - sr * sp * cy,
        cr * cp * cy + sr * sp * sy,
    ]


def quat_matrix(q: Vec) -> list[list[Column]]:
    x, y, z, w = q
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def quat_rpy(q: Vec) -> list[Column]:
    return matrix_rpy(quat_matrix(q))


def quat_multiply(a: Vec, b: Vec) -> list[Column]:
    ax, ay, az, aw = a
    bx, by, bz, bw = b
    return [
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx,
        aw * bz + ax * by - ay * bx + az * bw,
        aw * bw - ax * bx - ay * by - az * bz,
    ]


def quat_inverse(q: Vec) -> list[Column]:
    """Inverse of a unit quaternion."""
    return [-q[0], -q[1], -q[2], q[3]]


def quat_normalise(q: Vec, tiny: float = 1e-12) -> list[Column]:
    """Unit quaternion; identity when the norm is tiny, null or not a number."""
    n = F.sqrt(sum((c * c for c in q[1:]), q[0] * q[0]))
    usable = F.coalesce(n, F.lit(0.0)) >= tiny
    usable = usable & ~F.isnan(F.coalesce(n, F.lit(0.0)))
    return [
        F.when(usable, c / n).otherwise(F.lit(1.0 if i == 3 else 0.0)) for i, c in enumerate(q)
    ]


def slerp(a: Vec, b: Vec, t: float) -> list[Column]:
    """Spherical blend from ``a`` to ``b`` along the shorter arc."""
    d = sum((p * q for p, q in zip(a[1:], b[1:])), a[0] * b[0])
    size = F.least(F.abs(d), F.lit(1.0))
    theta = F.acos(size)
    near = size > 1 - 1e-12
    wa = F.when(near, F.lit(1.0 - t)).otherwise(F.sin((1 - t) * theta) / F.sin(theta))
    wb = F.when(near, F.lit(float(t))).otherwise(F.sin(t * theta) / F.sin(theta))
    wb = F.when(d < 0, -wb).otherwise(wb)
    return [wa * p + wb * q for p, q in zip(a, b)]


def skew(v: Vec) -> list[list[Column]]:
    o = F.lit(0.0)
    return [[o, -v[2], v[1]], [v[2], o, -v[0]], [-v[1], v[0], o]]


def so3_exp(w: Vec) -> list[Column]:
    """Quaternion of a rotation vector, with a series below 1e-5 rad."""
    theta_sq = dot3(w, w)
    theta = F.sqrt(theta_sq)
    small = theta_sq < 1e-10
    quad = theta_sq * theta_sq
    imag = F.when(small, 0.5 - theta_sq / 48.0 + quad / 3840.0).otherwise(
        F.sin(theta / 2) / F.when(small, F.lit(1.0)).otherwise(theta)
    )
    real = F.when(small, 1.0 - theta_sq / 8.0 + quad / 384.0).otherwise(F.cos(theta / 2))
    return [imag * w[0], imag * w[1], imag * w[2], real]


def so3_log(q: Vec) -> list[Column]:
    """Rotation vector of a unit quaternion, along the shorter arc."""
    n = norm3(q[0], q[1], q[2])
    small = n < 1e-12
    angle = 2 * F.atan(n / F.when(q[3] != 0, q[3]))
    angle = F.when(q[3] == 0, F.lit(3.141592653589793)).otherwise(angle)
    scale = F.when(small, F.lit(2.0)).otherwise(angle / F.when(small, F.lit(1.0)).otherwise(n))
    return [scale * q[0], scale * q[1], scale * q[2]]


def boxplus(q: Vec, w: Vec) -> list[Column]:
    """``q`` turned by the rotation vector ``w`` on its right."""
    return quat_multiply(q, so3_exp(w))


def boxminus(a: Vec, b: Vec) -> list[Column]:
    """Rotation vector that leads from ``b`` to ``a``."""
    return so3_log(quat_multiply(quat_inverse(b), a))


def se3_exp(w: Vec, v: Vec) -> tuple[list[list[Column]], list[Column]]:
    """Rotation matrix and translation of the twist (``w``, ``v``)."""
    theta_sq = dot3(w, w)
    theta = F.sqrt(theta_sq)
    small = theta < 1e-10
    safe = F.when(small, F.lit(1.0)).otherwise(theta)
    omega = skew(w)
    omega_sq = matmul(omega, omega)
    rotation = quat_matrix(so3_exp(w))
    a = F.when(small, F.lit(0.5)).otherwise((1 - F.cos(theta)) / (safe * safe))
    b = F.when(small, F.lit(1.0 / 6)).otherwise((theta - F.sin(theta)) / (safe * safe * safe))
    jac = [
        [(F.lit(1.0) if i == j else F.lit(0.0)) + a * omega[i][j] + b * omega_sq[i][j] for j in range(3)]
        for i in range(3)
    ]
    return rotation, matvec(jac, v)
