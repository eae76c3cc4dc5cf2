"""Wheels on patches of ground: lookups and spring forces of many vehicles at once.

A patch holds all ground points that any pose of a vehicle can ask for, so that nothing is looked up in a
table while poses are tried. Patches lie behind each other in flat arrays; each lookup is one pass over the
points of all patches that are still at work.
"""

from __future__ import annotations

import numpy as np


class Patches:
    """Ground points of many patches, by point id within each, with the number of equal points that one stands for."""

    def __init__(self, starts: np.ndarray, xyz: np.ndarray, weight: np.ndarray):
        self.starts, self.xyz, self.weight = starts, xyz, weight
        self.sizes = np.diff(starts, append=len(xyz))
        self.patch = np.repeat(np.arange(len(starts)), self.sizes)

    def only(self, patches: np.ndarray) -> Patches:
        """The named patches."""
        sizes = self.sizes[patches]
        starts = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) + np.repeat(self.starts[patches] - starts, sizes)
        return Patches(starts, self.xyz[at], self.weight[at])

    def _sum(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts, axis=0)

    def distances(self, at: np.ndarray) -> np.ndarray:
        """``[point, place]``: distance in the plane to each of its patch's places ``at[patch, place, 2]``."""
        gap = self.xyz[:, None, :2] - at[self.patch]
        return np.sqrt(gap[..., 0] ** 2 + gap[..., 1] ** 2)

    def nearest(self, distance: np.ndarray) -> np.ndarray:
        """``[patch, place, 3]``: the nearest point, of equal ones that with the smallest id; not a number without points."""
        usable = np.where(self.weight[:, None] > 0, distance, np.inf)
        least = np.minimum.reduceat(usable, self.starts, axis=0)
        first = np.where(usable == least[self.patch], np.arange(len(usable))[:, None], len(usable))
        return np.where(np.isfinite(least)[..., None], self.xyz[np.minimum.reduceat(first, self.starts, axis=0)], np.nan)

    def mean_height(self, distance: np.ndarray, radius: float, least: int) -> np.ndarray:
        """Mean height within ``radius``, or not a number where fewer than ``least`` points are."""
        near = np.where(distance <= radius, self.weight[:, None], 0.0)
        count = self._sum(near)
        return np.divide(self._sum(near * self.xyz[:, 2:]), count, out=np.full(count.shape, np.nan), where=(count > 0) & (count >= least))

    def plane_height(self, at: np.ndarray, distance: np.ndarray, radius: float, outliers: float, least: int) -> np.ndarray:
        """Height at each place of the plane through the points within ``radius``, without outliers in height.

        Not a number where there are too few points, before or after the cut, or the plane is upright.
        """
        z = self.xyz[:, 2:]
        near = np.where(distance <= radius, self.weight[:, None], 0.0)
        count = self._sum(near)
        enough = (count >= least) & (count > 0)
        count = np.maximum(count, 1e-300)
        mean = self._sum(near * z) / count
        spread = np.sqrt(self._sum(near * (z - mean[self.patch]) ** 2) / count)
        cut = outliers * spread + 1e-12 * (1.0 + np.abs(mean))
        near = np.where(np.abs(z - mean[self.patch]) <= cut[self.patch], near, 0.0)
        count = self._sum(near)
        enough &= (count >= least) & (count > 0)
        count = np.maximum(count, 1e-300)
        centre = np.stack([self._sum(near * self.xyz[:, k : k + 1]) / count for k in range(3)], axis=-1)
        off = self.xyz[:, None, :] - centre[self.patch]
        cov = np.empty((*count.shape, 3, 3))
        for i in range(3):
            for k in range(i, 3):
                cov[..., i, k] = cov[..., k, i] = self._sum(near * off[..., i] * off[..., k]) / count
        cov[~enough] = np.eye(3)
        normal = np.linalg.eigh(cov)[1][..., 0]
        enough &= np.abs(normal[..., 2]) >= 1e-6
        slope = normal[..., 0] * (at[..., 0] - centre[..., 0]) + normal[..., 1] * (at[..., 1] - centre[..., 1])
        return np.where(enough, centre[..., 2] - slope / np.where(enough, normal[..., 2], 1.0), np.nan)


def turns(axis: int, angle: np.ndarray) -> np.ndarray:
    """Rotations about a coordinate axis."""
    i, k = [(1, 2), (2, 0), (0, 1)][axis]
    out = np.zeros((len(angle), 3, 3))
    out[:, axis, axis] = 1.0
    out[:, i, i] = out[:, k, k] = np.cos(angle)
    out[:, k, i] = np.sin(angle)
    out[:, i, k] = -out[:, k, i]
    return out


def keep_yaw(rotation: np.ndarray, yaw: np.ndarray) -> np.ndarray:
    """The rotations turned about the vertical until their heading is ``yaw``."""
    return turns(2, yaw - np.arctan2(rotation[:, 1, 0], rotation[:, 0, 0])) @ rotation


def wheel_places(rotation: np.ndarray, centre: np.ndarray, wheels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Arms from the centre and places of the wheels: ``[vehicle, wheel, 3]`` each."""
    arm = np.einsum("vij,wj->vwi", rotation, wheels)
    return arm, arm + centre[:, None, :]


def spring_forces(
    patches: Patches, rotation: np.ndarray, centre: np.ndarray, wheels: np.ndarray, k_spring: float, g: float, fit: tuple[float, float, int]
) -> tuple[np.ndarray, np.ndarray]:
    """Residual ``[vehicle, 3]`` and Jacobian ``[vehicle, 3, 3]`` of height, roll and pitch.

    A wheel below the ground presses with a spring along the body's normal. The ground below it is the local plane, or
    the nearest point where there is none, or the origin where there are no points.
    """
    arm, place = wheel_places(rotation, centre, wheels)
    distance = patches.distances(place[..., :2])
    plane = patches.plane_height(place[..., :2], distance, *fit)
    nearest = np.nan_to_num(patches.nearest(distance))
    gap = place - nearest
    on_plane = ~np.isnan(plane)
    gap[on_plane] = 0.0
    gap[on_plane, 2] = (place[..., 2] - plane)[on_plane]
    normal = rotation[:, None, :, 2]
    depth = (gap * normal).sum(axis=-1)
    slopes = [np.broadcast_to(normal[..., 2], depth.shape)]
    for axis in np.eye(3)[:2]:
        slopes.append((np.cross(axis, arm) * normal).sum(axis=-1) + (gap * np.cross(axis, normal)).sum(axis=-1))
    pressed = depth < 0
    force = np.where(pressed, k_spring * depth, 0.0)
    levers = [np.ones(len(wheels)), wheels[:, 1], -wheels[:, 0]]
    residual = np.stack([(lever * force).sum(axis=1) for lever in levers], axis=1)
    jacobian = np.stack(
        [np.stack([(lever * np.where(pressed, k_spring * s, 0.0)).sum(axis=1) for s in slopes], axis=1) for lever in levers], axis=1
    )
    up = rotation[:, :, 2]
    residual[:, 0] += g * up[:, 2]
    for k, axis in enumerate(np.eye(3)[:2], 1):
        jacobian[:, 0, k] += g * np.cross(axis, up)[:, 2]
    return residual, jacobian


def rest(
    patches: Patches, xy: np.ndarray, yaw: np.ndarray, height: np.ndarray, wheels: np.ndarray, k_spring: float, g: float,
    fit: tuple[float, float, int], max_iters: int, damping: float, tol_cost: float, tol_step: float,
) -> dict[str, np.ndarray]:
    """Damped least-squares steps of all vehicles together until each is at rest; the pose of the lowest cost of each.

    A step that lowers the cost is taken and halves the damping, another is undone and multiplies it by five. Vehicles that
    are done leave, and with them their patches.
    """
    n = len(xy)
    z, rotation = height.copy(), turns(2, yaw)
    best = {"z": z.copy(), "rotation": rotation.copy(), "cost": np.full(n, np.inf)}
    settled = np.zeros(n, bool)
    cost, before = np.full(n, np.inf), np.full(n, np.inf)
    lam, step = np.full(n, float(damping)), np.zeros(n)
    at_z, at_rotation = z.copy(), rotation.copy()
    residual, jacobian = np.zeros((n, 3)), np.zeros((n, 3, 3))
    rounds = np.zeros(n, np.int32)
    left, here = np.arange(n), patches
    for round_ in range(max_iters + 1):
        if not len(left):
            break
        centre = np.column_stack([xy[left], z[left]])
        f, j = spring_forces(here, rotation[left], centre, wheels, k_spring, g, fit)
        new = (f * f).sum(axis=1)
        better = new < best["cost"][left]
        for name, value in (("z", z), ("rotation", rotation)):
            best[name][left[better]] = value[left[better]]
        best["cost"][left[better]] = new[better]
        taken = (new < cost[left]) | (round_ == 0)
        yes, no = left[taken], left[~taken]
        done = (np.abs(before[yes] - new[taken]) < tol_cost) & (step[yes] < tol_step) & (round_ > 0)
        settled[yes[done]] = True
        if round_:
            lam[yes] = np.maximum(lam[yes] / 2, 1e-8)
            before[yes] = new[taken]
        cost[yes] = new[taken]
        at_z[yes], at_rotation[yes], residual[yes], jacobian[yes] = z[yes], rotation[yes], f[taken], j[taken]
        lam[no] *= 5
        before[no] = cost[no]
        rounds[left] += 1
        if settled[left].any():
            left = left[~settled[left]]
            here = patches.only(left)
        turned = np.swapaxes(jacobian[left], 1, 2)
        normal = turned @ jacobian[left] + lam[left, None, None] * np.eye(3)
        d = np.linalg.solve(normal, -(turned @ residual[left][..., None]))[..., 0]
        z[left] = at_z[left] + d[:, 0]
        rotation[left] = keep_yaw(turns(0, d[:, 1]) @ turns(1, d[:, 2]) @ at_rotation[left], yaw[left])
        step[left] = np.sqrt((d * d).sum(axis=1))
    return {**best, "settled": settled, "rounds": rounds}
