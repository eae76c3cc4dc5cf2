"""The index of many clouds against all distances, and alignments against known moves."""

import numpy as np
import pandas as pd
import pytest

from scanlake.operators import clouds
from scanlake.operators.selection import _matrices
from scanlake.plans.alignment import NAMES, align_clouds
from scanlake.plans.loops import verify_loops


@pytest.mark.parametrize("size", [0.05, 1.0, 300.0])
def test_nearest_equals_all_distances(size):
    """Copies, clouds of one point, a cloud without points, queries far away, with and without hints."""
    rng = np.random.default_rng(0)
    cloud = np.sort(rng.choice([0, 1, 2, 4, 5], 700, p=[0.5, 0.2, 0.2, 0.098, 0.002]))
    cloud = np.concatenate([cloud[cloud < 5], [5]])
    xyz = rng.integers(0, 30, (len(cloud), 3)) / 2.0
    index = clouds.CloudIndex(cloud, xyz, size)
    query = np.concatenate([rng.random((300, 3)) * 15, rng.random((5, 3)) * 1e6])
    which = rng.choice([0, 1, 2, 3, 4, 5, 9], len(query))
    for hint in (None, rng.random(len(query)) * 50):
        place, d2 = index.nearest(which, query, hint)
        for k, (c, q) in enumerate(zip(which, query)):
            at = np.flatnonzero(cloud == c)
            if not len(at):
                assert place[k] == -1 and np.isinf(d2[k])
                continue
            want = ((xyz[at] - q) ** 2).sum(axis=1)
            assert np.isclose(d2[k], want.min()) and place[k] == at[np.argmin(np.round(want, 6))]


def move(pose, xyz):
    r, t = (m[0] for m in _matrices(np.array([pose], float)))
    return xyz @ r.T + t, r, t


def test_rigid_steps_find_the_move():
    rng = np.random.default_rng(1)
    runs = [rng.random((n, 3)) * 4 for n in (5, 40, 3)]
    moved, rotations, shifts = zip(*(move([1, 2, 3, 0.1 * k, -0.2, 2.0], p) for k, p in enumerate(runs)))
    source, target = np.concatenate(runs), np.concatenate(moved)
    weight = np.ones(len(source))
    target[6], weight[6] = 99.0, 0.0
    r, t = clouds.rigid_steps(source, target, weight, np.array([0, 5, 45]))
    assert np.allclose(r, rotations) and np.allclose(t, shifts)


def frame(spark, xyz, **more):
    return spark.createDataFrame(pd.DataFrame(xyz, columns=list("xyz")).assign(point_id=np.arange(len(xyz)), **more))


def test_pairs_of_one_hot_target(spark):
    """200 sources on one target, dealt over tasks; a source far off stays out by its limit; sources without points."""
    rng = np.random.default_rng(2)
    world = rng.random((80, 3)) * 20
    back = {}
    sources = []
    for k in range(200):
        xyz, r, t = move([0.1, -0.1, 0.05, 0.0, 0.0, 0.002 * (k % 7)], world)
        back[k] = (r.T, -r.T @ t)
        sources.append(pd.DataFrame(xyz, columns=list("xyz")).assign(point_id=np.arange(80), cur=k))
    sources.append(pd.DataFrame(world + 500, columns=list("xyz")).assign(point_id=np.arange(80), cur=777))
    source = spark.createDataFrame(pd.concat(sources))
    pairs = spark.createDataFrame([(k, 5) for k in [*range(200), 777, 888]] + [(0, 6)], "cur long, goal long")
    out = align_clouds(pairs, source, ["cur"], frame(spark, world, goal=5), ["goal"], 1.0, max_d=30.0, together=16).collect()
    assert sorted(r.cur for r in out) == [*range(200), 777]
    for row in out:
        if row.cur == 777:
            assert not row.converged and row.fitness > 500**2
            continue
        r, t = back[row.cur]
        assert row.converged and row.fitness < 1e-9
        assert np.allclose([row[n] for n in NAMES], [*r.reshape(-1), *t], atol=1e-6)
    none = align_clouds(pairs, source.where("false"), ["cur"], frame(spark, world, goal=5), ["goal"])
    assert none.count() == 0


def test_first_turn_leads_where_nearest_points_mislead(spark):
    rng = np.random.default_rng(3)
    world = rng.random((60, 3)) * [30, 8, 3] - [15, 4, 0]
    turned, r, t = move([0, 0, 0, 0, 0, 2.5], world)
    pairs = spark.createDataFrame([(1, 1, -2.5), (2, 1, 0.0)], "cur long, goal long, yaw double")
    source = frame(spark, turned, cur=1).unionByName(frame(spark, turned, cur=2))
    out = {r.cur: r for r in align_clouds(pairs, source, ["cur"], frame(spark, world, goal=1), ["goal"], yaw="yaw").collect()}
    assert out[1].fitness < 1e-9 and np.isclose(out[1].r00, np.cos(2.5)) and out[2].fitness > 0.01


def test_loops_by_descriptor_are_checked_in_the_first_frame(spark):
    """All clouds placed by the first pose; the edge is the correction undone, and robust."""
    rng = np.random.default_rng(4)
    world = rng.random((400, 3)) * [20, 20, 4]
    first = [3.0, -2.0, 0.5, 0.0, 0.0, 0.7]
    seen, r, t = move([0.1, -0.05, 0.02, 0.0, 0.0, 0.01], world)
    rows = [(1, 0, *first), (1, 1, *[9.0] * 3, 0.0, 0.0, 0.0), (1, 2, *[50.0] * 3, 0.0, 0.0, 1.0)]
    kf = spark.createDataFrame(rows, "vehicle_id long, kf_id long, x double, y double, z double, roll double, pitch double, yaw double")
    clouds_ = [pd.DataFrame(xyz, columns=list("xyz")).assign(vehicle_id=1, kf_id=k, point_idx=np.arange(400)) for k, xyz in ((1, world), (2, seen))]
    cand = spark.createDataFrame([(1, 2, 1)], "vehicle_id long, kf_id long, loop_id long")
    out = verify_loops(cand, kf, spark.createDataFrame(pd.concat(clouds_)), neighbours=0, leaf=0.001, frame="base", min_target=100).collect()
    assert len(out) == 1 and out[0].robust and out[0].from_id == 2 and out[0].to_id == 1
    _, fr, ft = move(first, world)
    want_r = fr @ r @ fr.T
    want_t = fr @ t + ft - want_r @ ft
    assert np.allclose([out[0].x, out[0].y, out[0].z], want_t, atol=1e-6) and np.isclose(out[0].yaw, 0.01)
