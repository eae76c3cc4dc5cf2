"""Registry of queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.sources.shapes import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query and, where SQL can say the same on the whole tables, its oracle."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            if not views:
                ORACLES[name] = sql
            elif sql.lstrip().upper().startswith("WITH RECURSIVE "):
                prefix = with_views(*views).replace("WITH ", "WITH RECURSIVE ", 1)
                ORACLES[name] = prefix + ",\n" + sql.lstrip()[15:]
            elif sql.lstrip().upper().startswith("WITH "):
                ORACLES[name] = with_views(*views) + ",\n" + sql.lstrip()[5:]
            else:
                ORACLES[name] = with_views(*views) + "\n" + sql
        return fn

    return register


def r6(value: str | Column) -> Column:
    """Six decimals, without negative zero."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value, 6) + F.lit(0.0)


def q6(sql: str) -> str:
    """The same in SQL."""
    return f"(round({sql}, 6) + CAST(0 AS DOUBLE))"


def rounded(df: DataFrame, keep: list[str], values: list[str]) -> DataFrame:
    return df.select(*keep, *[r6(c).alias(c) for c in values])


def q6s(columns: list[str]) -> str:
    return ", ".join(f"{q6(c)} AS {c}" for c in columns)


def sql_rotation(roll: str, pitch: str, yaw: str) -> list[str]:
    """Row-major Rz Ry Rx in SQL."""
    cr, sr, cp, sp, cy, sy = (
        f"cos({roll})", f"sin({roll})", f"cos({pitch})", f"sin({pitch})", f"cos({yaw})", f"sin({yaw})",
    )
    return [
        f"({cy}*{cp})", f"({cy}*{sp}*{sr} - {sy}*{cr})", f"({cy}*{sp}*{cr} + {sy}*{sr})",
        f"({sy}*{cp})", f"({sy}*{sp}*{sr} + {cy}*{cr})", f"({sy}*{sp}*{cr} - {cy}*{sr})",
        f"(-{sp})", f"({cp}*{sr})", f"({cp}*{cr})",
    ]


def sql_matmul(a: list[str], b: list[str]) -> list[str]:
    return [
        "(" + " + ".join(f"{a[3 * i + k]}*{b[3 * k + j]}" for k in range(3)) + ")"
        for i in range(3) for j in range(3)
    ]


def sql_transpose(a: list[str]) -> list[str]:
    return [a[3 * j + i] for i in range(3) for j in range(3)]


def sql_matvec(a: list[str], v: list[str]) -> list[str]:
    return ["(" + " + ".join(f"{a[3 * i + k]}*{v[k]}" for k in range(3)) + ")" for i in range(3)]


def sql_rpy(a: list[str]) -> list[str]:
    return [
        f"atan2({a[7]}, {a[8]})",
        f"asin(CASE WHEN -{a[6]} > 1 THEN 1 WHEN -{a[6]} < -1 THEN -1 ELSE -{a[6]} END)",
        f"atan2({a[3]}, {a[0]})",
    ]


def sql_between(a: str, b: str) -> dict[str, str]:
    """Pose ``b`` seen from pose ``a`` (column prefixes), as SQL per field."""
    ra = sql_rotation(f"{a}roll", f"{a}pitch", f"{a}yaw")
    rb = sql_rotation(f"{b}roll", f"{b}pitch", f"{b}yaw")
    back = sql_transpose(ra)
    t = sql_matvec(back, [f"({b}{c} - {a}{c})" for c in "xyz"])
    return dict(zip(("x", "y", "z", "roll", "pitch", "yaw"), [*t, *sql_rpy(sql_matmul(back, rb))]))
