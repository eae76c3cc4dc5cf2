"""Pose algebra. A pose is six columns ``x, y, z, roll, pitch, yaw`` with an optional prefix."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanlake.functions.geometry import matmul, matvec, transpose
from scanlake.functions.rotations import matrix_rpy, rpy_matrix

FIELDS = ("x", "y", "z", "roll", "pitch", "yaw")


@dataclass(frozen=True)
class Pose:
    """A rigid transform as a rotation matrix and a translation, both of columns."""

    rotation: list
    translation: list

    def columns(self, prefix: str = "") -> list[Column]:
        values = [*self.translation, *matrix_rpy(self.rotation)]
        return [v.alias(prefix + f) for v, f in zip(values, FIELDS)]

    def fields(self) -> dict[str, Column]:
        return dict(zip(FIELDS, [*self.translation, *matrix_rpy(self.rotation)]))


def pose(prefix: str = "", source: str = "") -> Pose:
    """The pose in columns named ``prefix + field`` (``source`` is a struct or an alias)."""
    c = {f: F.col(f"{source}.{prefix}{f}" if source else prefix + f) for f in FIELDS}
    return Pose(rpy_matrix(c["roll"], c["pitch"], c["yaw"]), [c["x"], c["y"], c["z"]])


def from_columns(*columns: Column) -> Pose:
    x, y, z, roll, pitch, yaw = columns
    return Pose(rpy_matrix(roll, pitch, yaw), [x, y, z])


def compose(a: Pose, b: Pose) -> Pose:
    moved = matvec(a.rotation, b.translation)
    return Pose(matmul(a.rotation, b.rotation), [m + t for m, t in zip(moved, a.translation)])


def inverse(a: Pose) -> Pose:
    back = transpose(a.rotation)
    return Pose(back, [-c for c in matvec(back, a.translation)])


def between(a: Pose, b: Pose) -> Pose:
    """``b`` seen from ``a``."""
    back = transpose(a.rotation)
    step = [q - p for p, q in zip(a.translation, b.translation)]
    return Pose(matmul(back, b.rotation), matvec(back, step))


def apply(a: Pose, p: list[Column]) -> list[Column]:
    return [m + t for m, t in zip(matvec(a.rotation, p), a.translation)]
