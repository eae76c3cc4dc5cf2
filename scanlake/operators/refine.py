"""Scan-to-map refinement of one bounded scan: matches, normal equations and steps on arrays.

The same formulas as the column expressions in ``operators.fits``, for scans whose maps fit a tile.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from scanlake.operators.tiles import AT_ONCE, nearest_of

NEIGHBOURS = 5


@dataclass(frozen=True)
class Limits:
    max_d: float
    tolerance: float
    rounds: int
    min_matches: int
    threshold: float
    rot_eps: float
    trans_eps: float


def advance(h: np.ndarray, g: np.ndarray, projection: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Steps of stacked 6x6 systems, what each projects a step by, and which are degenerate.

    A projection is made where none came in (NaN) and kept from then on.
    """
    x = (np.linalg.pinv(h, rcond=6 * np.finfo(float).eps, hermitian=True) @ g[..., None])[..., 0]
    values, vectors = np.linalg.eigh(h)
    strong = np.logical_or.accumulate(values >= threshold, axis=1)
    fresh = np.isnan(projection[:, 0])
    p = np.where(fresh[:, None, None], (vectors * strong[:, None, :]) @ vectors.transpose(0, 2, 1), projection.reshape(-1, 6, 6))
    return (p @ x[..., None])[..., 0], p.reshape(-1, 36), fresh & ~strong.all(axis=1)


def small_step(x: np.ndarray, rot_eps: float, trans_eps: float) -> np.ndarray:
    return (np.degrees(np.linalg.norm(x[:, :3], axis=1)) < rot_eps) & (100 * np.linalg.norm(x[:, 3:], axis=1) < trans_eps)


def rotation(pose: np.ndarray) -> np.ndarray:
    (cr, cp, cy), (sr, sp, sy) = np.cos(pose[3:]), np.sin(pose[3:])
    return np.array(
        [[cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr], [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr], [-sp, cp * sr, cp * cr]]
    )


def near(moved: np.ndarray, goal: np.ndarray, max_d: float) -> tuple[np.ndarray, np.ndarray]:
    """Queries with enough points of ``goal`` nearer than ``max_d``, and the places of the nearest; ties go to the first.

    Queries are taken in order of their longest side, so each few meet only the stretch of points in their reach.
    """
    rows, places = [np.zeros(0, np.int64)], [np.zeros((0, NEIGHBOURS), np.int64)]
    known = np.flatnonzero(np.isfinite(moved).all(axis=1))
    if len(goal) < NEIGHBOURS or not len(known):
        return rows[0], places[0]
    side = int(np.argmax(np.ptp(goal, axis=0)))
    known = known[np.argsort(moved[known, side], kind="stable")]
    along = np.argsort(goal[:, side], kind="stable")
    sorted_goal = goal[along, side]
    step = max(1, min(64, AT_ONCE // len(goal)))
    for begin in range(0, len(known), step):
        some = known[begin : begin + step]
        low = np.searchsorted(sorted_goal, moved[some[0], side] - max_d * (1 + 1e-9), "left")
        high = np.searchsorted(sorted_goal, moved[some[-1], side] + max_d * (1 + 1e-9), "right")
        if high - low < NEIGHBOURS:
            continue
        met = np.sort(along[low:high])
        d2 = np.zeros((len(some), len(met)))
        for c in range(3):
            off = moved[some, c][:, None] - goal[met, c][None, :]
            off *= off
            d2 += off
        d2[~(d2 < max_d * max_d)] = np.inf
        row, col, _ = nearest_of(d2, NEIGHBOURS)
        full = np.bincount(row, minlength=len(some)) == NEIGHBOURS
        rows.append(some[full])
        places.append(met[col[full[row]]].reshape(-1, NEIGHBOURS))
    return np.concatenate(rows), np.concatenate(places)


def lines(cloud: np.ndarray, moved: np.ndarray, goal: np.ndarray, limits: Limits) -> tuple[np.ndarray, ...]:
    """``operators.fits.edge_matches``: places in the cloud, weighted directions and distances."""
    rows, places = near(moved, goal, limits.max_d)
    found = goal[places]
    centre = found.mean(axis=1)
    off = found - centre[:, None, :]
    values, vectors = np.linalg.eigh(off.transpose(0, 2, 1) @ off / NEIGHBOURS)
    long = values[:, 2] > 3 * values[:, 1]
    rows, along = rows[long], vectors[long][:, :, 2]
    rel = moved[rows] - centre[long]
    away = rel - (rel * along).sum(axis=1, keepdims=True) * along
    length = np.linalg.norm(away, axis=1)
    normal = away / np.where(length > 0, length, 1.0)[:, None]
    return _weighted(rows, normal, np.linalg.norm(np.cross(rel, along), axis=1), np.ones(len(rows)))


def planes(cloud: np.ndarray, moved: np.ndarray, goal: np.ndarray, limits: Limits) -> tuple[np.ndarray, ...]:
    """``operators.fits.plane_matches`` with ranges in the sensor frame, in the same form."""
    rows, places = near(moved, goal, limits.max_d)
    found = goal[places]
    m = found.transpose(0, 2, 1) @ found
    b = -found.sum(axis=1)

    def det(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (a * np.cross(b, c)).sum(axis=1)

    columns = [m[:, :, i] for i in range(3)]
    whole = det(*columns)
    safe = np.abs(whole) > 1e-12
    whole = np.where(safe, whole, 1.0)
    plane = np.stack([det(*[b if i == j else c for j, c in enumerate(columns)]) / whole for i in range(3)], axis=1)
    size = np.linalg.norm(plane, axis=1)
    safe &= size > 0
    size = np.where(safe, size, 1.0)
    normal, offset = plane / size[:, None], 1 / size
    safe &= (np.abs(np.einsum("nkc,nc->nk", found, normal) + offset[:, None]) <= limits.tolerance).all(axis=1)
    rows, normal, offset = rows[safe], normal[safe], offset[safe]
    return _weighted(rows, normal, (moved[rows] * normal).sum(axis=1) + offset, np.sqrt(np.linalg.norm(cloud[rows], axis=1)))


def _weighted(rows: np.ndarray, normal: np.ndarray, d: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, ...]:
    w = 1 - 0.9 * np.abs(d) / np.where(scale > 0, scale, 1.0)
    kept = (scale > 0) & (w > 0.1)
    return rows[kept], w[kept, None] * normal[kept], w[kept] * d[kept]


def jacobian(pose: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Derivatives of the rotated points by roll, pitch and yaw: (points, angles, 3)."""
    (cr, cp, cy), (sr, sp, sy) = np.cos(pose[3:]), np.sin(pose[3:])
    x, y, z = p.T
    ya, za = -sr * y - cr * z, cr * y - sr * z
    depth = sr * y + cr * z
    flat = -sp * x + cp * depth
    px = cy * (cp * x + sp * depth) - sy * (cr * y - sr * z)
    py = sy * (cp * x + sp * depth) + cy * (cr * y - sr * z)
    by_roll = [cy * sp * za - sy * ya, sy * sp * za + cy * ya, cp * za]
    by_pitch = [cy * flat, sy * flat, -cp * x - sp * depth]
    return np.stack([np.stack(by_roll, axis=1), np.stack(by_pitch, axis=1), np.stack([-py, px, np.zeros(len(p))], axis=1)], axis=1)


Side = tuple[Callable[..., tuple[np.ndarray, ...]], np.ndarray, np.ndarray]


def refine_scan(pose: np.ndarray, sides: list[Side], limits: Limits) -> tuple[np.ndarray, bool, int, bool]:
    """Pose x, y, z, roll, pitch, yaw of one scan after its rounds, whether it settled, the rounds, whether it is degenerate.

    ``sides`` are (``lines`` or ``planes``, points in the sensor frame, their map, sorted by id).
    """
    pose, projection, degenerate, settled = pose.copy(), np.full((1, 36), np.nan), False, False
    done = 0
    while done < limits.rounds and not settled:
        done += 1
        turn = rotation(pose)
        h, g, n = np.zeros((6, 6)), np.zeros(6), 0
        for match, cloud, goal in sides:
            rows, normal, d = match(cloud, cloud @ turn.T + pose[:3], goal, limits)
            j = np.concatenate([np.einsum("nc,nac->na", normal, jacobian(pose, cloud[rows])), normal], axis=1)
            h, g, n = h + j.T @ j, g - j.T @ d, n + len(rows)
        if n == 0 or n < limits.min_matches:
            return pose, True, done, degenerate
        x, projection, weak = advance(h[None], g[None], projection, limits.threshold)
        degenerate |= bool(weak[0])
        pose[3:] += x[0, :3]
        pose[:3] += x[0, 3:]
        settled = bool(small_step(x, limits.rot_eps, limits.trans_eps)[0])
    return pose, settled, done, degenerate
