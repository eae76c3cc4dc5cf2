"""Filters along a drive: pose smoothing and fusion of two odometry feeds.

The ordered joins and steps (segments, relative poses, as-of sync) run in Spark; what is left is a
short recursion per row, run as a ``chained_fold``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.functions.matrices import rotation_exps
from scanlake.functions.poses import FIELDS
from scanlake.operators import trajectory as tr
from scanlake.operators.folds import Fold, chained_fold
from scanlake.operators.registration import rotation_exp
from scanlake.operators.selection import _matrices
from scanlake.operators.timeline import HOUR

ANGLES = slice(3, 6)


@dataclass(frozen=True)
class SmoothOptions:
    """Noise of the constant-acceleration filter (standard deviations) and its limits."""

    max_dt: float = 1.0
    linear_jerk: float = 0.5
    angular_jerk: float = 0.5
    position: float = 0.20
    rotation: float = 0.10
    start: tuple[float, ...] = (0.05, 0.05, 5.0, 2.0, 5.0, 2.0)
    iterations: int = 3
    limit: float = 1e-4


def rotation_log(r: np.ndarray) -> np.ndarray:
    cos = np.clip((np.trace(r) - 1) / 2, -1.0, 1.0)
    axis = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]])
    sin = np.linalg.norm(axis) / 2
    angle = np.arctan2(sin, cos)
    if sin > 1e-9:
        return axis / (2 * sin) * angle
    if cos > 0:
        return axis / 2
    values, vectors = np.linalg.eigh(r)
    return vectors[:, np.argmax(values)] * np.pi


def _right_jacobian(w: np.ndarray) -> np.ndarray:
    theta = float(np.linalg.norm(w))
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0.0]])
    if theta < 1e-8:
        return np.eye(3) - k / 2
    return np.eye(3) - (1 - np.cos(theta)) / theta**2 * k + (theta - np.sin(theta)) / theta**3 * (k @ k)


class PoseFilter:
    """Error-state filter over position, rotation, velocity, turn rate and their rates."""

    SIZE = 1 + 3 + 9 + 12 + 324

    def __init__(self, options: SmoothOptions, state: np.ndarray | None = None):
        self.o = options
        if state is None:
            self.t = None
            return
        self.t, self.p, self.r = state[0], state[1:4].copy(), state[4:13].reshape(3, 3).copy()
        self.x = state[13:25].reshape(4, 3).copy()
        self.cov = state[25:].reshape(18, 18).copy()

    def packed(self) -> np.ndarray:
        return np.concatenate([[self.t], self.p, self.r.reshape(-1), self.x.reshape(-1), self.cov.reshape(-1)])

    def start(self, t: float, p: np.ndarray, r: np.ndarray) -> None:
        self.t, self.p, self.r = t, p.copy(), r.copy()
        self.x = np.zeros((4, 3))
        self.cov = np.diag(np.repeat(np.square(self.o.start), 3))

    def predict(self, dt: float) -> None:
        v, w, a, b = self.x
        turn = (w + 0.5 * dt * b) * dt
        f, i3 = np.eye(18), np.eye(3)
        jac = _right_jacobian(turn)
        f[0:3, 6:9], f[0:3, 12:15] = dt * i3, 0.5 * dt * dt * i3
        f[3:6, 3:6], f[3:6, 9:12], f[3:6, 15:18] = rotation_exp(-turn), dt * jac, 0.5 * dt * dt * jac
        f[6:9, 12:15] = f[9:12, 15:18] = dt * i3
        self.p = self.p + (v + 0.5 * dt * a) * dt
        self.r = self.r @ rotation_exp(turn)
        self.x = self.x + np.stack([a, b, np.zeros(3), np.zeros(3)]) * dt
        noise = np.zeros(18)
        noise[12:15], noise[15:18] = (dt * self.o.linear_jerk) ** 2, (dt * self.o.angular_jerk) ** 2
        self.cov = f @ self.cov @ f.T + np.diag(noise)

    def update(self, p: np.ndarray, r: np.ndarray) -> None:
        noise = np.diag(np.repeat(np.square([self.o.position, self.o.rotation]), 3))
        gain = np.linalg.solve(self.cov[:6, :6] + noise, self.cov[:6, :]).T
        prior_p, prior_r, prior_x = self.p, self.r, self.x
        moved = np.zeros(18)
        for _ in range(self.o.iterations):
            here_p, here_r = prior_p + moved[:3], prior_r @ rotation_exp(moved[3:6])
            gap = np.concatenate([p - here_p, rotation_log(here_r.T @ r)])
            new = gain @ (gap + moved[:6])
            change, moved = np.abs(new - moved).max(), new
            if change < self.o.limit:
                break
        self.p, self.r = prior_p + moved[:3], prior_r @ rotation_exp(moved[3:6])
        self.x = prior_x + moved[6:].reshape(4, 3)
        keep = np.eye(18)
        keep[:, :6] -= gain
        self.cov = keep @ self.cov @ keep.T + gain @ noise @ gain.T
        self.cov = 0.5 * (self.cov + self.cov.T)

    def take(self, t: float, p: np.ndarray, r: np.ndarray) -> bool:
        """Feeds one sample; False when it is not later than the last one."""
        if self.t is None or t - self.t > self.o.max_dt:
            self.start(t, p, r)
            return True
        if t <= self.t:
            return False
        self.predict(t - self.t)
        self.update(p, r)
        self.t = t
        return True


def _logs(r: np.ndarray) -> np.ndarray:
    """``rotation_log`` of a stack; the few near half a turn go one by one."""
    cos = np.clip((np.trace(r, axis1=1, axis2=2) - 1) / 2, -1.0, 1.0)
    axis = np.stack([r[:, 2, 1] - r[:, 1, 2], r[:, 0, 2] - r[:, 2, 0], r[:, 1, 0] - r[:, 0, 1]], axis=1)
    sin = np.linalg.norm(axis, axis=1) / 2
    scale = np.where(sin > 1e-9, np.arctan2(sin, cos) / np.maximum(2 * sin, 1e-300), 0.5)
    out = axis * scale[:, None]
    for i in np.flatnonzero((sin <= 1e-9) & (cos <= 0)):
        out[i] = rotation_log(r[i])
    return out


def _right_jacobians(w: np.ndarray) -> np.ndarray:
    """``_right_jacobian`` of a stack."""
    theta = np.linalg.norm(w, axis=1)
    k = np.zeros((len(w), 3, 3))
    k[:, 0, 1], k[:, 0, 2], k[:, 1, 2] = -w[:, 2], w[:, 1], -w[:, 0]
    k -= k.transpose(0, 2, 1)
    small = theta < 1e-8
    safe = np.where(small, 1.0, theta)
    first = np.where(small, 0.5, (1 - np.cos(safe)) / safe**2)
    second = np.where(small, 0.0, (safe - np.sin(safe)) / safe**3)
    return np.eye(3) - first[:, None, None] * k + second[:, None, None] * (k @ k)


class PoseFilters:
    """Many pose filters, each as ``PoseFilter``, that take a sample each at once."""

    def __init__(self, options: SmoothOptions, states: Sequence[np.ndarray | None]):
        self.o, n = options, len(states)
        self.t = np.full(n, np.nan)
        self.p, self.r, self.x, self.cov = np.zeros((n, 3)), np.zeros((n, 3, 3)), np.zeros((n, 4, 3)), np.zeros((n, 18, 18))
        known = [i for i, s in enumerate(states) if s is not None]
        if known:
            s = np.array([states[i] for i in known], float)
            self.t[known], self.p[known], self.r[known] = s[:, 0], s[:, 1:4], s[:, 4:13].reshape(-1, 3, 3)
            self.x[known], self.cov[known] = s[:, 13:25].reshape(-1, 4, 3), s[:, 25:].reshape(-1, 18, 18)

    def packed(self) -> np.ndarray:
        return np.concatenate([self.t[:, None], self.p, *(v.reshape(len(self.t), -1) for v in (self.r, self.x, self.cov))], axis=1)

    def take(self, at: np.ndarray, t: np.ndarray, p: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Feeds one sample to each of the filters ``at``; whether each was later than its last one."""
        with np.errstate(invalid="ignore"):
            gap = t - self.t[at]
            new = np.isnan(self.t[at]) | (gap > self.o.max_dt)
            on = ~new & (gap > 0)
        begun = at[new]
        self.t[begun], self.p[begun], self.r[begun], self.x[begun] = t[new], p[new], r[new], 0.0
        self.cov[begun] = np.diag(np.repeat(np.square(self.o.start), 3))
        if on.any():
            self._step(at[on], gap[on], p[on], r[on])
            self.t[at[on]] = t[on]
        return new | on

    def _step(self, at: np.ndarray, dt: np.ndarray, p: np.ndarray, r: np.ndarray) -> None:
        o, n, i3 = self.o, len(at), np.eye(3)
        x, d, dd = self.x[at], dt[:, None], dt[:, None, None]
        v, w, a, b = (x[:, i] for i in range(4))
        turn = (w + 0.5 * d * b) * d
        jac = _right_jacobians(turn)
        f = np.broadcast_to(np.eye(18), (n, 18, 18)).copy()
        f[:, 0:3, 6:9], f[:, 0:3, 12:15] = dd * i3, 0.5 * dd * dd * i3
        f[:, 3:6, 3:6], f[:, 3:6, 9:12], f[:, 3:6, 15:18] = rotation_exps(-turn), dd * jac, 0.5 * dd * dd * jac
        f[:, 6:9, 12:15] = f[:, 9:12, 15:18] = dd * i3
        prior_p = self.p[at] + (v + 0.5 * d * a) * d
        prior_r = self.r[at] @ rotation_exps(turn)
        prior_x = x + np.stack([a, b, np.zeros((n, 3)), np.zeros((n, 3))], axis=1) * dd
        cov = f @ self.cov[at] @ f.transpose(0, 2, 1)
        some = np.arange(12, 18)
        cov[:, some, some] += np.square(d * np.repeat([o.linear_jerk, o.angular_jerk], 3))
        noise = np.diag(np.repeat(np.square([o.position, o.rotation]), 3))
        gain = np.linalg.solve(cov[:, :6, :6] + noise, cov[:, :6, :]).transpose(0, 2, 1)
        moved, left = np.zeros((n, 18)), np.arange(n)
        for _ in range(o.iterations):
            here_p, here_r = prior_p[left] + moved[left, :3], prior_r[left] @ rotation_exps(moved[left, 3:6])
            off = np.concatenate([p[left] - here_p, _logs(here_r.transpose(0, 2, 1) @ r[left])], axis=1)
            after = np.einsum("nij,nj->ni", gain[left], off + moved[left, :6])
            change = np.abs(after - moved[left]).max(axis=1)
            moved[left] = after
            left = left[~(change < o.limit)]
            if not len(left):
                break
        self.p[at], self.r[at] = prior_p + moved[:, :3], prior_r @ rotation_exps(moved[:, 3:6])
        self.x[at] = prior_x + moved[:, 6:].reshape(-1, 4, 3)
        keep = np.broadcast_to(np.eye(18), (n, 18, 18)).copy()
        keep[:, :, :6] -= gain
        cov = keep @ cov @ keep.transpose(0, 2, 1) + gain @ noise @ gain.transpose(0, 2, 1)
        self.cov[at] = 0.5 * (cov + cov.transpose(0, 2, 1))


SEGMENTS_PER_GROUP = 8

SMOOTH_FIELDS = [f"s_{f} double" for f in (*FIELDS, "vx", "vy", "vz", "wx", "wy", "wz")] + ["used boolean"]


def _rpy(r: np.ndarray) -> list[float]:
    return [np.arctan2(r[2, 1], r[2, 2]), np.arcsin(np.clip(-r[2, 0], -1, 1)), np.arctan2(r[1, 0], r[0, 0])]


def smooth_fold(options: SmoothOptions):
    def run(times: np.ndarray, rows: np.ndarray, state: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        r, p = _matrices(rows)
        kf = PoseFilter(options, state)
        out = np.full((len(rows), 13), np.nan)
        for i, t in enumerate(times.tolist()):
            out[i, 12] = kf.take(t, p[i], r[i])
            if out[i, 12]:
                out[i, :12] = [*kf.p, *_rpy(kf.r), *kf.x[0], *kf.x[1]]
        return out, kf.packed()

    def many(times: np.ndarray, rows: np.ndarray, starts: np.ndarray, states: list[np.ndarray | None]) -> tuple[np.ndarray, list[np.ndarray]]:
        r, p = _matrices(rows)
        filters = PoseFilters(options, states)
        out = np.full((len(rows), 13), np.nan)
        sizes = np.diff(starts, append=len(rows))
        for i in range(int(sizes.max(initial=0))):
            runs = np.flatnonzero(sizes > i)
            at = starts[runs] + i
            used = filters.take(runs, times[at], p[at], r[at])
            out[at, 12] = used
            at, runs = at[used], runs[used]
            turned = filters.r[runs]
            attitude = np.stack(
                [np.arctan2(turned[:, 2, 1], turned[:, 2, 2]), np.arcsin(np.clip(-turned[:, 2, 0], -1, 1)), np.arctan2(turned[:, 1, 0], turned[:, 0, 0])], axis=1
            )
            out[at, :12] = np.concatenate([filters.p[runs], attitude, filters.x[runs, 0], filters.x[runs, 1]], axis=1)
        return out, list(filters.packed())

    return Fold(FIELDS, SMOOTH_FIELDS, run, many)


def smooth(
    poses: DataFrame, keys: Sequence[str], options: SmoothOptions = SmoothOptions(), ts: str = "ts", width: float = HOUR
) -> DataFrame:
    """Smoothed pose ``s_x..s_yaw`` with velocity and turn rate per sample.

    The filter starts anew after a gap above ``max_dt``, so the gap segments of a drive are
    independent and run in parallel, a few short ones per task group.
    """
    cut = tr.segments(poses, keys, options.max_dt, ts, width)
    grouped = cut.withColumn("_group", F.floor(F.col("segment") / SEGMENTS_PER_GROUP))
    out = chained_fold(grouped, [*keys, "_group"], ts, width, smooth_fold(options))
    return out.where("used").drop("used", "_group")


@dataclass(frozen=True)
class FuseOptions:
    """Noise of the increment filter. Pairs are (position, angle) standard deviations."""

    control: float = 0.99
    max_age: float = 0.9
    back_scale: float = 1.5
    age_scale: float = 1.0
    max_pair_dt: float = 2.0
    floor: float = 1e-9
    step_noise: tuple[float, float] = (0.02, 0.02)
    rate_noise: tuple[float, float] = (0.10, 0.05)
    front_noise: tuple[float, float] = (0.20, 0.10)
    back_noise: tuple[float, float] = (0.08, 0.05)
    start_step: tuple[float, float] = (0.05, 0.05)
    start_rate: tuple[float, float] = (0.50, 0.30)
    reset_step: tuple[float, float] = (0.01, 0.01)
    reset_rate: tuple[float, float] = (0.02, 0.02)
    start_pose: tuple[float, float] = (0.50, 0.30)
    deadband: tuple[float, float] = (0.0, 0.0)


def _diag(*pairs: tuple[float, float]) -> np.ndarray:
    return np.diag(np.concatenate([np.repeat(np.square(p), 3) for p in pairs]))


def _positive(m: np.ndarray, floor: float) -> np.ndarray:
    """``m``, or each of its matrices, with eigenvalues raised to ``floor``."""
    values, vectors = np.linalg.eigh(0.5 * (m + np.swapaxes(m, -1, -2)))
    return (vectors * np.maximum(values, floor)[..., None, :]) @ np.swapaxes(vectors, -1, -2)


def _wrapped(v: np.ndarray) -> np.ndarray:
    v = v.copy()
    v[..., ANGLES] = np.arctan2(np.sin(v[..., ANGLES]), np.cos(v[..., ANGLES]))
    return v


STEP = [f"d{f}" for f in FIELDS]
SYNC = ["svx", "svy", "svz", "swroll", "swpitch", "swyaw"]
FUSE_FIELDS = [f"f_{f} double" for f in FIELDS] + ["f_trace double"]


def fuse_fold(options: FuseOptions):
    """Predict with the front rate, correct with the front step, then with the synced back step."""
    o = options
    noise, front, back = _diag(o.step_noise, o.rate_noise), _diag(o.front_noise), _diag(o.back_noise)
    reset_step, reset_rate, start = _diag(o.reset_step), _diag(o.reset_rate), _diag(o.start_step, o.start_rate)

    def correct(x, cov, z, r):
        r = _positive(r, o.floor)
        gain = np.linalg.solve(_positive(cov[:6, :6] + r, o.floor), cov[:6, :]).T
        x = x + gain @ _wrapped(z - x[:6])
        x[:6] = _wrapped(x[:6])
        keep = np.eye(12)
        keep[:, :6] -= gain
        return x, _positive(keep @ cov @ keep.T + gain @ r @ gain.T, o.floor)

    def run(times: np.ndarray, rows: np.ndarray, state: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        rot, pos = _matrices(rows[:, :6])
        steps, sync, dts, ages = rows[:, 6:12], rows[:, 12:18], rows[:, 18], rows[:, 19]
        if state is None:
            p, r, x, cov, pose = pos[0], rot[0], np.zeros(12), start, _diag(o.start_pose)
        else:
            p, r, x = state[:3], state[3:12].reshape(3, 3), state[12:24]
            cov, pose = state[24:168].reshape(12, 12), state[168:].reshape(6, 6)
        out = np.empty((len(rows), 7))
        for i, dt in enumerate(dts):
            if np.isfinite(dt) and np.isfinite(steps[i]).all():
                a = o.control
                f = np.zeros((12, 12))
                f[:6, :6] = np.eye(6)
                f[:6, 6:], f[6:, 6:] = (1 - a) * dt * np.eye(6), (1 - a) * np.eye(6)
                rate = steps[i] / dt
                x = f @ x + np.concatenate([a * dt * rate, a * rate])
                x[:6] = _wrapped(x[:6])
                scaled = noise.copy()
                span = max(dt, 1e-3)
                scaled[:6, :6] *= span * span
                scaled[6:, 6:] *= span
                cov = _positive(f @ _positive(cov, o.floor) @ f.T + _positive(scaled, o.floor), o.floor)
                x, cov = correct(x, cov, steps[i], front)
                if np.isfinite(sync[i]).all():
                    x, cov = correct(x, cov, sync[i], back * ages[i])
                move, turn = _matrices(x[None, :6])[1][0], _matrices(x[None, :6])[0][0]
                p, r = p + r @ move, r @ turn
                pose = _positive(pose + cov[:6, :6], o.floor)
                rate_cov = _positive(cov[6:, 6:] + reset_rate, o.floor)
                x = np.concatenate([np.zeros(6), x[6:]])
                cov = np.zeros((12, 12))
                cov[:6, :6], cov[6:, 6:] = reset_step, rate_cov
                cov = _positive(cov, o.floor)
            out[i] = [*p, *_rpy(r), np.trace(pose)]
        return out, np.concatenate([p, r.reshape(-1), x, cov.reshape(-1), pose.reshape(-1)])

    def correct_many(x, cov, z, r):
        r = _positive(r, o.floor)
        gain = np.linalg.solve(_positive(cov[:, :6, :6] + r, o.floor), cov[:, :6, :]).transpose(0, 2, 1)
        x = x + (gain @ _wrapped(z - x[:, :6])[..., None])[..., 0]
        x[:, :6] = _wrapped(x[:, :6])
        keep = np.broadcast_to(np.eye(12), (len(x), 12, 12)).copy()
        keep[:, :, :6] -= gain
        return x, _positive(keep @ cov @ keep.transpose(0, 2, 1) + gain @ r @ gain.transpose(0, 2, 1), o.floor)

    def many(times: np.ndarray, rows: np.ndarray, starts: np.ndarray, states: list[np.ndarray | None]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The j-th rows of all runs at once."""
        rot, pos = _matrices(rows[:, :6])
        steps, sync, dts, ages = rows[:, 6:12], rows[:, 12:18], rows[:, 18], rows[:, 19]
        fresh = np.concatenate([np.zeros(24), start.reshape(-1), _diag(o.start_pose).reshape(-1)])
        held = np.array([fresh if s is None else s for s in states], float).reshape(-1, len(fresh))
        new = np.array([s is None for s in states], bool)
        p, r, x = held[:, :3], held[:, 3:12].reshape(-1, 3, 3), held[:, 12:24]
        cov, pose = held[:, 24:168].reshape(-1, 12, 12), held[:, 168:].reshape(-1, 6, 6)
        p[new], r[new] = pos[starts[new]], rot[starts[new]]
        sizes = np.diff(starts, append=len(rows))
        out = np.empty((len(rows), 7))
        a = o.control
        for j in range(int(sizes.max(initial=0))):
            runs = np.flatnonzero(sizes > j)
            at = starts[runs] + j
            moved = np.isfinite(dts[at]) & np.isfinite(steps[at]).all(axis=1)
            now, i = runs[moved], at[moved]
            if len(now):
                dt = dts[i]
                f = np.zeros((len(now), 12, 12))
                f[:, :6, :6], f[:, 6:, 6:] = np.eye(6), (1 - a) * np.eye(6)
                f[:, :6, 6:] = ((1 - a) * dt)[:, None, None] * np.eye(6)
                rate = steps[i] / dt[:, None]
                here = (f @ x[now][..., None])[..., 0] + np.concatenate([(a * dt)[:, None] * rate, a * rate], axis=1)
                here[:, :6] = _wrapped(here[:, :6])
                scaled = np.broadcast_to(noise, (len(now), 12, 12)).copy()
                span = np.maximum(dt, 1e-3)[:, None, None]
                scaled[:, :6, :6] *= span * span
                scaled[:, 6:, 6:] *= span
                c = _positive(f @ _positive(cov[now], o.floor) @ f.transpose(0, 2, 1) + _positive(scaled, o.floor), o.floor)
                here, c = correct_many(here, c, steps[i], front)
                both = np.flatnonzero(np.isfinite(sync[i]).all(axis=1))
                if len(both):
                    here[both], c[both] = correct_many(here[both], c[both], sync[i[both]], back * ages[i[both], None, None])
                turn, move = _matrices(here[:, :6])
                p[now] += (r[now] @ move[..., None])[..., 0]
                r[now] = r[now] @ turn
                pose[now] = _positive(pose[now] + c[:, :6, :6], o.floor)
                rate_cov = _positive(c[:, 6:, 6:] + reset_rate, o.floor)
                here[:, :6] = 0.0
                x[now] = here
                c = np.zeros((len(now), 12, 12))
                c[:, :6, :6], c[:, 6:, 6:] = reset_step, rate_cov
                cov[now] = _positive(c, o.floor)
            q = r[runs]
            attitude = np.stack([np.arctan2(q[:, 2, 1], q[:, 2, 2]), np.arcsin(np.clip(-q[:, 2, 0], -1, 1)), np.arctan2(q[:, 1, 0], q[:, 0, 0])], axis=1)
            out[at] = np.concatenate([p[runs], attitude, np.trace(pose[runs], axis1=1, axis2=2)[:, None]], axis=1)
        return out, list(np.concatenate([p, *(v.reshape(len(p), -1) for v in (r, x, cov, pose))], axis=1))

    return Fold([*FIELDS, *STEP, *SYNC, "dt", "noise"], FUSE_FIELDS, run, many)


def fuse(
    poses: DataFrame, keys: Sequence[str], options: FuseOptions = FuseOptions(), ts: str = "ts", width: float = HOUR
) -> DataFrame:
    """Fused pose ``f_x..f_yaw`` at every front sample from the increments of both feeds.

    ``poses`` has ``source`` ('front' or 'back'). Steps, checks and the as-of match of the back
    rates are joins and windows; only the filter recursion runs as a fold.
    """
    from scanlake.operators.scans import deadband

    both = [*keys, "source"]
    steps = tr.pair_dt(tr.relative_pose(poses, both, ts, width), options.max_pair_dt)
    steps = tr.rates(deadband(steps, *options.deadband))
    front = steps.where("source = 'front'").drop("vx", "vy", "vz", "wroll", "wpitch", "wyaw", "speed")
    back = steps.where("source = 'back'")
    synced = tr.sync_back(
        front.where("dt is not null").select(*keys, ts, "dt"), back, keys, options.max_age, options.back_scale,
        options.age_scale, ts, width,
    ).select(*keys, ts, *SYNC, "noise")
    rows = front.join(synced, [*keys, ts], "left")
    return chained_fold(rows, keys, ts, width, fuse_fold(options)).drop(*SYNC, "noise", *STEP, "dt")
