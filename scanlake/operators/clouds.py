"""Nearest points of many clouds at once, and rigid steps between paired points.

Clouds lie behind each other in flat arrays. Each is searched through grids of growing cell size that are made
when first asked for and kept, so an index serves every round of a job.
"""

from __future__ import annotations

import numpy as np

AT_ONCE = 2_000_000
"""Candidates compared at once."""


class CloudIndex:
    """Points of clouds numbered ``cloud``; equal distances go to the point that comes first."""

    def __init__(self, cloud: np.ndarray, xyz: np.ndarray, size: float):
        self.cloud, self.xyz, self.size = cloud, xyz, float(size)
        self.low = xyz.min(axis=0) if len(xyz) else np.zeros(3)
        self.span = float((xyz.max(axis=0) - self.low).max()) if len(xyz) else 0.0
        self.bare = np.bincount(cloud, minlength=1) == 0
        self.first = self._finest()
        self.grids: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _finest(self) -> int:
        """The first level whose cells can be numbered."""
        level = 0
        while float(self.cloud.max(initial=0) + 1) * (self.span / (self.size * 2.0**level) + 2.0) ** 3 > 2.0**61:
            level += 1
        return level

    def _cells(self, xyz: np.ndarray, level: int) -> np.ndarray:
        return np.floor(np.clip((xyz - self.low) / (self.size * 2.0**level), -2.0**40, 2.0**40)).astype(np.int64)

    def _grid(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted cell numbers, the points in that order, and how many cells there are each way."""
        if level not in self.grids:
            cells = self._cells(self.xyz, level)
            shape = cells.max(axis=0) + 1
            numbers = ((self.cloud * shape[0] + cells[:, 0]) * shape[1] + cells[:, 1]) * shape[2] + cells[:, 2]
            order = np.argsort(numbers, kind="stable")
            self.grids[level] = numbers[order], order, shape
        return self.grids[level]

    def nearest(self, cloud: np.ndarray, xyz: np.ndarray, hint: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Place and squared distance of the nearest point to each query of its cloud; infinite where there is none.

        A query starts at the first level whose cells are as wide as its ``hint``. It is done when what it finds lies within a
        cell's width, for all nearer points are in the cells around its own; else it goes up.
        """
        place, d2 = np.full(len(xyz), -1, np.int64), np.full(len(xyz), np.inf)
        if not len(self.xyz):
            return place, d2
        level = np.full(len(xyz), self.first, np.int64)
        if hint is not None:
            wide = np.ceil(np.log2(np.maximum(hint, 1e-300) / self.size))
            level = np.maximum(level, np.where(np.isfinite(wide), wide, self.first).astype(np.int64))
        left = np.flatnonzero(~self.bare[np.minimum(cloud, len(self.bare) - 1)] & (cloud < len(self.bare)))
        while len(left):
            lowest = int(level[left].min())
            lower = level[left] == lowest
            now, others = left[lower], left[~lower]
            found, near = self._probe(cloud[now], xyz[now], lowest)
            place[now], d2[now] = found, near
            width = self.size * 2.0**lowest
            distance = np.sqrt(near)
            up = distance > width
            enough = np.ceil(np.log2(np.where(np.isfinite(distance), np.maximum(distance, 1e-300), width * 2) / self.size))
            level[now] = np.maximum(lowest + 1, enough.astype(np.int64))
            left = np.concatenate([others, now[up]])
        return place, d2

    def _probe(self, cloud: np.ndarray, xyz: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest point in the 27 cells around each query: nine rows of three cells, each one stretch of the order."""
        numbers, order, shape = self._grid(level)
        cells = self._cells(xyz, level)
        bottom, top = np.maximum(cells[:, 2] - 1, 0), np.minimum(cells[:, 2] + 1, shape[2] - 1)
        begin, end = np.zeros((len(xyz), 9), np.int64), np.zeros((len(xyz), 9), np.int64)
        for k in range(9):
            x, y = cells[:, 0] + k // 3 - 1, cells[:, 1] + k % 3 - 1
            inside = (x >= 0) & (x < shape[0]) & (y >= 0) & (y < shape[1]) & (bottom <= top)
            row = ((cloud * shape[0] + x) * shape[1] + y) * shape[2]
            begin[inside, k] = np.searchsorted(numbers, (row + bottom)[inside], "left")
            end[inside, k] = np.searchsorted(numbers, (row + top)[inside], "right")
        sizes = (end - begin).sum(axis=1)
        place, d2 = np.full(len(xyz), -1, np.int64), np.full(len(xyz), np.inf)
        upto = np.cumsum(sizes)
        at = 0
        while at < len(xyz):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, "right")))
            some = slice(at, stop)
            at = stop
            counts = (end[some] - begin[some]).ravel()
            if not counts.sum():
                continue
            gaps = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            points = order[np.repeat(begin[some].ravel(), counts) + gaps]
            some_sizes = sizes[some]
            query = np.repeat(np.arange(len(some_sizes)), some_sizes)
            off = self.xyz[points] - xyz[some][query]
            near = off[:, 0] ** 2 + off[:, 1] ** 2 + off[:, 2] ** 2
            have = np.flatnonzero(some_sizes)
            starts = (np.cumsum(some_sizes) - some_sizes)[have]
            least = np.full(len(some_sizes), np.inf)
            least[have] = np.minimum.reduceat(near, starts)
            first = np.where(near == least[query], points, len(self.xyz))
            d2[some] = least
            found = np.full(len(some_sizes), -1, np.int64)
            found[have] = np.minimum.reduceat(first, starts)
            place[some] = found
        return place, d2


def rigid_steps(source: np.ndarray, target: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotations and shifts that bring paired points onto each other best, for runs of pairs; reflections excluded."""
    sizes = np.diff(starts, append=len(source))
    run = np.repeat(np.arange(len(starts)), sizes)
    total = np.maximum(np.add.reduceat(weight, starts), 1e-300)[:, None]
    middle = [np.add.reduceat(weight[:, None] * p, starts, axis=0) / total for p in (source, target)]
    a, b = source - middle[0][run], target - middle[1][run]
    cross = np.add.reduceat((weight[:, None] * a)[:, :, None] * b[:, None, :], starts, axis=0)
    u, _, vt = np.linalg.svd(cross)
    v = vt.transpose(0, 2, 1)
    sign = np.sign(np.linalg.det(v @ u.transpose(0, 2, 1)))
    v[:, :, 2] *= np.where(sign < 0, -1.0, 1.0)[:, None]
    rotation = v @ u.transpose(0, 2, 1)
    return rotation, middle[1] - np.einsum("rij,rj->ri", rotation, middle[0])


def align(
    index: CloudIndex, cloud: np.ndarray, source: np.ndarray, starts: np.ndarray, max_d: float | None, rounds: int, eps: float,
    rotation: np.ndarray | None = None,
) -> dict[str, np.ndarray]:
    """Point-to-point alignment of runs of source points with the clouds numbered ``cloud``, all runs together.

    A run whose mean squared distance changes by less than ``eps`` leaves; one with fewer than three points within
    ``max_d`` of its cloud fails. ``fitness`` is the mean squared distance of all its points at the end, near or far.
    """
    n = len(starts)
    sizes = np.diff(starts, append=len(source))
    rotation = np.broadcast_to(np.eye(3), (n, 3, 3)).copy() if rotation is None else rotation.copy()
    shift = np.zeros((n, 3))
    before, done = np.full(n, np.nan), np.zeros(n, np.int32)
    failed, hint = np.zeros(n, bool), np.zeros(len(source))
    settled = np.zeros(n, bool)
    left = np.arange(n)

    def rows_of(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        begin = np.cumsum(sizes[runs]) - sizes[runs]
        return np.arange(sizes[runs].sum()) + np.repeat(starts[runs] - begin, sizes[runs]), begin, np.repeat(runs, sizes[runs])

    def moved(rows: np.ndarray, run: np.ndarray) -> np.ndarray:
        return np.einsum("rij,rj->ri", rotation[run], source[rows]) + shift[run]

    for _ in range(rounds):
        if not len(left):
            break
        rows, begin, run = rows_of(left)
        here = moved(rows, run)
        place, d2 = index.nearest(cloud[run], here, hint[rows])
        hint[rows] = np.sqrt(d2)
        near = np.isfinite(d2) if max_d is None else d2 <= max_d * max_d
        weight = near.astype(float)
        count = np.add.reduceat(weight, begin)
        error = np.add.reduceat(np.where(near, d2, 0.0), begin) / np.maximum(count, 1.0)
        few = count < 3
        failed[left[few]] = True
        step, move = rigid_steps(here, np.where(near[:, None], index.xyz[place], 0.0), weight, begin)
        good = left[~few]
        rotation[good] = step[~few] @ rotation[good]
        shift[good] = np.einsum("rij,rj->ri", step[~few], shift[good]) + move[~few]
        done[left] += 1
        settled[good] = np.abs(before[good] - error[~few]) < eps
        before[good] = error[~few]
        left = good[~settled[good]]
    rows, begin, run = rows_of(np.arange(n))
    d2 = index.nearest(cloud[run], moved(rows, run), hint)[1]
    fitness = np.add.reduceat(d2, begin) / sizes
    return {"rotation": rotation, "shift": shift, "fitness": fitness, "rounds": done, "converged": ~failed}
