"""Angle expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def deg2rad(angle: Column) -> Column:
    return F.radians(angle)


def rad2deg(angle: Column) -> Column:
    return F.degrees(angle)


def wrap_angle(angle: Column) -> Column:
    """The same angle in (-pi, pi]."""
    return F.atan2(F.sin(angle), F.cos(angle))


def azimuth360(x: Column, y: Column) -> Column:
    """Azimuth in degrees from 0 up to 360, counter-clockwise from the x axis."""
    angle = F.atan2(y, x)
    return F.degrees(F.when(angle < 0, angle + 2 * math.pi).otherwise(angle))


def clamp(value: Column, limit) -> Column:
    """``value`` limited to plus and minus ``limit``; null stays null."""
    limit = limit if isinstance(limit, Column) else F.lit(float(limit))
    return F.when(value > limit, limit).when(value < -limit, -limit).otherwise(value)
