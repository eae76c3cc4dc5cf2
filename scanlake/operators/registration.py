"""Scan pair registration against voxels: correspondences, normal equations, moments, solves.

A round of a registration needs the error of many trial transforms with the correspondences
fixed. That error is a quadratic form in the twelve entries of the transform, so one aggregate per
pair (60 + 12 + 2 sums with map-side partials) is enough to build the normal equations and to try
as many steps as wanted without touching the points again.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.functions.geometry import dot3, inv3, matmul, matvec, polar_key, symmetric, transpose, upper, voxel_key
from scanlake.functions.rotations import skew
from scanlake.operators.voxels import COV, voxel_join

XYZ = ("x", "y", "z")
MOMENTS = [
    f"q{i}{j}_{k}{l}" for i in range(4) for j in range(i, 4) for k in range(3) for l in range(k, 3)
] + [f"l{i}_{k}" for i in range(4) for k in range(3)] + ["c0"]


def correspondences(
    source: DataFrame, voxels: DataFrame, transforms: DataFrame, keys: Sequence[str],
    size: Sequence[float] | float = (0.175, 0.175, 2.0), offsets: int = 1,
) -> DataFrame:
    """Source points with the target voxels they fall into after their pair's transform.

    ``transforms`` has ``r00..r22, t0..t2`` per key, a row per pair. The result carries the point
    ``x..``, the moved point ``p..``, the error ``e..``, the inverse combined covariance ``m..``
    and the weight ``w``.
    """
    keys = list(keys)
    names = [f"r{i}{j}" for i in range(3) for j in range(3)] + ["t0", "t1", "t2"]
    r = [[F.col(f"r{i}{j}") for j in range(3)] for i in range(3)]
    moved = [v + F.col(f"t{i}") for i, v in enumerate(matvec(r, [F.col(c) for c in XYZ]))]
    placed = source.join(transforms.select(*keys, *names), keys).withColumns(
        {f"p{c}": v for c, v in zip(XYZ, moved)}
    )
    p = [F.col(f"p{c}") for c in XYZ]
    cells = voxel_key(p, size) if isinstance(size, (int, float)) else polar_key(p, size)
    found = voxel_join(placed, voxels, keys, cells, offsets)
    turned = matmul(matmul(r, symmetric([F.col(c) for c in COV])), transpose(r))
    total = [F.col(f"v_{c}") + t for c, t in zip(COV, upper(turned))]
    staged = found.select(
        *keys, *XYZ, *[f"p{c}" for c in XYZ],
        *[(F.col(f"v_m{c}") - F.col(f"p{c}")).alias(f"e{c}") for c in XYZ],
        *[F.col(f"v_m{c}").alias(f"b{c}") for c in XYZ],
        F.sqrt(F.col("v_n").cast("double")).alias("w"),
        *[v.alias(f"s{i}") for i, v in enumerate(total)],
    )
    inverse = upper(inv3(symmetric([F.col(f"s{i}") for i in range(6)])))
    return staged.select(
        *[c for c in staged.columns if not (c[0] == "s" and c[1:].isdigit())],
        *[v.alias(f"m{i}") for i, v in enumerate(inverse)],
    ).where(F.col("m0").isNotNull())


def _weighting() -> list[list[Column]]:
    return symmetric([F.col(f"m{i}") for i in range(6)])


def normal_eq_pair(
    matches: DataFrame, keys: Sequence[str], mode: str = "rotation", velocity: Sequence[str] | None = None,
    interval: str | None = None, strength: float = 1.0,
) -> DataFrame:
    """Normal equations ``h..``, ``g..`` of a registration step per pair.

    ``rotation`` has 3 unknowns, ``full`` 6 (rotation, translation), ``translation`` the same 6
    with a velocity term: columns ``velocity`` hold the change of velocity between the pair's
    steps and ``interval`` its time step.
    """
    p = [F.col(f"p{c}") for c in XYZ]
    rows = skew(p)
    if mode == "rotation":
        size = 3
    elif mode in ("full", "translation"):
        size = 6
        rows = [[*row, *[F.lit(-1.0 if i == j else 0.0) for j in range(3)]] for i, row in enumerate(rows)]
    else:
        raise ValueError("mode must be 'rotation', 'full' or 'translation'")
    m = _weighting()
    cols = [[row[c] for row in rows] for c in range(size)]
    weighted = [matvec(m, col) for col in cols]
    e = [F.col(f"e{c}") for c in XYZ]
    w = F.col("w")
    aggs = [
        F.sum(w * dot3(cols[i], weighted[j])).alias(f"h{i}{j}") for i in range(size) for j in range(i, size)
    ] + [F.sum(w * dot3(weighted[i], e)).alias(f"g{i}") for i in range(size)]
    if mode != "translation":
        return matches.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("n"))
    drift = [F.col(c) for c in velocity]
    aggs += [F.sum(w * dot3(weighted[i], drift)).alias(f"_v{i}") for i in range(size)]
    sums = matches.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("n"), F.first(interval).alias("_dt"))
    share = float(strength) / F.col("n")
    return sums.select(
        *keys, "n",
        *[
            (F.col(f"h{i}{j}") * (1 + share / (F.col("_dt") * F.col("_dt")))).alias(f"h{i}{j}")
            for i in range(6) for j in range(i, 6)
        ],
        *[(F.col(f"g{i}") + share / F.col("_dt") * F.col(f"_v{i}")).alias(f"g{i}") for i in range(6)],
    )


def pair_error(matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted squared error per pair."""
    e = [F.col(f"e{c}") for c in XYZ]
    return matches.groupBy(*keys).agg(
        F.sum(F.col("w") * dot3(e, matvec(_weighting(), e))).alias("error"), F.count(F.lit(1)).alias("n")
    )


def pair_moments(matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The sums of the quadratic form of the error in the transform, as one array per pair."""
    a = [F.col(c) for c in XYZ] + [F.lit(1.0)]
    b = [F.col(f"b{c}") for c in XYZ]
    m, w = _weighting(), F.col("w")
    mb = matvec(m, b)
    sums = [
        F.sum(w * a[i] * a[j] * m[k][l]).alias(f"q{i}{j}_{k}{l}")
        for i in range(4) for j in range(i, 4) for k in range(3) for l in range(k, 3)
    ]
    sums += [F.sum(w * a[i] * mb[k]).alias(f"l{i}_{k}") for i in range(4) for k in range(3)]
    sums += [F.sum(w * dot3(b, mb)).alias("c0"), F.count(F.lit(1)).alias("n")]
    return matches.groupBy(*keys).agg(*sums).select(*keys, "n", F.array(*MOMENTS).alias("moments"))


class PairForm:
    """Error, gradient and Hessian of one pair from its moments."""

    def __init__(self, moments: np.ndarray):
        q = np.zeros((4, 3, 4, 3))
        at = 0
        for i in range(4):
            for j in range(i, 4):
                block = np.zeros((3, 3))
                block[np.triu_indices(3)] = moments[at : at + 6]
                block = block + np.triu(block, 1).T
                q[i, :, j, :] = q[j, :, i, :] = block
                at += 6
        self.q, self.l, self.c = q, moments[at : at + 12].reshape(4, 3), moments[-1]

    def error(self, v: np.ndarray) -> float:
        t = v.T
        return float(self.c - 2 * (t * self.l).sum() + np.einsum("ik,ikjl,jl", t, self.q, t))

    def normal(self, moves: list[np.ndarray], v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Normal equations for small ``moves`` of the transform ``v`` (3x4)."""
        d = np.stack([m.T for m in moves])
        dq = np.einsum("rik,ikjl->rjl", d, self.q)
        h = np.einsum("rjl,sjl->rs", dq, d)
        g = np.einsum("rjl,jl->r", dq, v.T) - np.einsum("rik,ik->r", d, self.l)
        return h, g


GENERATORS = np.array(
    [[[0, 0, 0], [0, 0, -1], [0, 1, 0]], [[0, 0, 1], [0, 0, 0], [-1, 0, 0]], [[0, -1, 0], [1, 0, 0], [0, 0, 0]]],
    dtype=float,
)


def rotation_exp(w: np.ndarray) -> np.ndarray:
    theta = float(np.linalg.norm(w))
    k = np.einsum("i,ijk->jk", w, GENERATORS)
    if theta < 1e-12:
        return np.eye(3) + k
    return np.eye(3) + np.sin(theta) / theta * k + (1 - np.cos(theta)) / theta**2 * (k @ k)


def damped_step(h, g, lam, trial, current, inner):
    """One damped step: returns the accepted move or None, and the new damping.

    ``trial(d)`` gives the error after step ``d``; damping grows while the error does.
    """
    if lam < 0:
        lam = 1e-9 * float(np.abs(np.diag(h)).max())
    grow = 2.0
    for _ in range(inner):
        d = np.linalg.lstsq(h + lam * np.eye(len(h)), -g, rcond=None)[0]
        gain = float(d @ (lam * d - g))
        ratio = (current - trial(d)) / gain if gain else 0.0
        if ratio >= 0:
            return d, lam * max(1.0 / 3.0, 1 - (2 * ratio - 1) ** 3)
        lam, grow = lam * grow, grow * 2
    return None, lam


def rotation_step(moments: np.ndarray, transform: np.ndarray, lam: float, eps: float, inner: int = 10):
    """One outer rotation round of a pair: new transform, damping, and whether it has settled."""
    form, v = PairForm(moments), transform.reshape(3, 4)
    h, g = form.normal([gen @ v for gen in GENERATORS], v)
    d, lam = damped_step(h, g, lam, lambda s: form.error(rotation_exp(s) @ v), form.error(v), inner)
    if d is None:
        return v.reshape(-1), lam, True
    turn = rotation_exp(d)
    return (turn @ v).reshape(-1), lam, bool(np.abs(turn - np.eye(3)).max() < eps)


def translation_solve(
    moments: np.ndarray, n: float, transform: np.ndarray, guess: np.ndarray, last: np.ndarray, dt: float,
    last_dt: float, strength: float, eps: float, rounds: int = 64, inner: int = 10,
) -> np.ndarray:
    """Translation of a rotated pair with the velocity term, correspondences fixed."""
    form, v = PairForm(moments), transform.reshape(3, 4).copy()
    start = v[:, 3].copy()
    weight = form.q[3, :, 3, :]
    share = strength / max(n, 1.0)

    def drift(t):
        return -(guess + t) / dt - last / last_dt

    def total(t):
        u = v.copy()
        u[:, 3] = start + t
        c = drift(t)
        return form.error(u) + share * float(c @ weight @ c)

    t, lam = np.zeros(3), -1.0
    moves = [np.outer(np.eye(3)[i], [0, 0, 0, 1.0]) for i in range(3)]
    for _ in range(rounds):
        u = v.copy()
        u[:, 3] = start + t
        h, g = form.normal(moves, u)
        h = h + share / dt**2 * weight
        g = g - share / dt * (weight @ drift(t))
        d, lam = damped_step(h, g, lam, lambda s, t=t: total(t + s), total(t), inner)
        if d is None:
            break
        t = t + d
        if np.abs(d).max() < eps:
            break
    return t


def degeneracy(sums: DataFrame, keys: Sequence[str], threshold: float = 100.0) -> DataFrame:
    """Eigenvalues of 6x6 normal equations below ``threshold``: flag and projection matrix.

    Directions are tested from the weakest on and the first strong one ends the test.
    """
    cells = [F.col(f"h{min(i, j)}{max(i, j)}") for i in range(6) for j in range(6)]

    def project(h: pd.Series) -> pd.DataFrame:
        m = np.stack([np.asarray(v, dtype=float).reshape(6, 6) for v in h]) if len(h) else np.zeros((0, 6, 6))
        values, vectors = np.linalg.eigh(m)
        strong = np.logical_or.accumulate(values >= threshold, axis=1)
        p = (vectors * strong[:, None, :]) @ vectors.transpose(0, 2, 1)
        return pd.DataFrame({"degenerate": ~strong.all(axis=1), "projection": list(p.reshape(-1, 36)), "values": list(values)})

    udf = F.pandas_udf(project, "struct<degenerate:boolean,projection:array<double>,values:array<double>>")
    return sums.withColumn("_d", udf(F.array(*cells))).select(
        *keys, F.col("_d.degenerate").alias("degenerate"), F.col("_d.projection").alias("projection"),
        F.col("_d.values").alias("eigenvalues"),
    )


