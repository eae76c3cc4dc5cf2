"""Ground lookups in patches against plain loops, and patches against whole maps."""

import numpy as np
import pandas as pd

from scanlake.operators import contact
from scanlake.operators.neighbours import patches_xy
from scanlake.operators.runs import map_runs
from scanlake.plans.terrain import settle

WHEELS = [(0.8, 0.5), (0.8, -0.5), (-0.8, -0.5), (-0.8, 0.5)]


def one_by_one(xyz, weight, place, radius, outliers, least):
    """Nearest point, mean height and plane height for one place."""
    d = np.sqrt(((xyz[:, :2] - place) ** 2).sum(axis=1))
    nearest = xyz[np.lexsort((np.arange(len(xyz)), d))[0]]
    near = np.repeat(xyz[d <= radius], weight[d <= radius].astype(int), axis=0)
    mean = near[:, 2].mean() if len(near) >= max(least, 1) else np.nan
    plane = np.nan
    if len(near) >= least:
        z = near[:, 2]
        kept = near[np.abs(z - z.mean()) <= outliers * z.std() + 1e-12]
        if len(kept) >= least:
            centre = kept.mean(axis=0)
            normal = np.linalg.eigh((kept - centre).T @ (kept - centre))[1][:, 0]
            if abs(normal[2]) >= 1e-6:
                plane = centre[2] - (normal[:2] @ (place - centre[:2])) / normal[2]
    return nearest, mean, plane


def test_lookups_equal_loops():
    rng = np.random.default_rng(0)
    sizes = [40, 1, 200, 3]
    clouds = [rng.random((n, 3)) * [6, 6, 1] for n in sizes]
    clouds[2][::20, 2] += 9
    weights = [rng.integers(1, 4, n).astype(float) for n in sizes]
    held = contact.Patches(np.cumsum([0, *sizes[:-1]]), np.concatenate(clouds), np.concatenate(weights))
    at = rng.random((4, 5, 2)) * 6
    for chosen in (np.arange(4), np.array([2, 0])):
        some, places = held.only(chosen), at[chosen]
        d = some.distances(places)
        nearest, mean, plane = some.nearest(d), some.mean_height(d, 1.5, 4), some.plane_height(places, d, 1.5, 2.0, 5)
        for i, k in enumerate(chosen):
            for w in range(5):
                want = one_by_one(clouds[k], weights[k], places[i, w], 1.5, 2.0, 4)
                assert np.allclose(nearest[i, w], want[0]) and np.allclose(mean[i, w], want[1], equal_nan=True)
                want = one_by_one(clouds[k], weights[k], places[i, w], 1.5, 2.0, 5)
                assert np.allclose(plane[i, w], want[2], equal_nan=True)


def test_jacobian_is_the_slope_of_the_residual():
    """Against small steps of height, roll and pitch, on a slope that all wheels press into."""
    g = np.stack(np.meshgrid(np.arange(-3, 3, 0.2), np.arange(-3, 3, 0.2)), -1).reshape(-1, 2)
    xyz = np.column_stack([g, 0.1 * g[:, 0] - 0.05 * g[:, 1]])
    held = contact.Patches(np.array([0]), xyz, np.ones(len(xyz)))
    wheels = np.array([(x, y, -0.5) for x, y in WHEELS])
    rotation, centre = contact.turns(1, np.array([-0.08])), np.array([[0.1, 0.2, 0.3]])

    def residual(z, roll, pitch):
        turned = contact.turns(0, np.array([roll])) @ contact.turns(1, np.array([pitch])) @ rotation
        return contact.spring_forces(held, turned, centre + [0, 0, z], wheels, 20.0, 1.0, (0.9, 3.0, 5))

    f, j = residual(0, 0, 0)
    assert (f != 0).all()
    z_slope = (residual(1e-6, 0, 0)[0] - f) / 1e-6
    assert np.allclose(j[0][:, 0], z_slope[0], rtol=1e-4, atol=1e-4)


def test_patches_hold_each_querys_own_radius(spark):
    rng = np.random.default_rng(1)
    points = pd.DataFrame({"tile": rng.integers(0, 3, 600), "pid": np.arange(600)})
    for c in "xyz":
        points[c] = rng.integers(-40, 40, 600) / 4.0
    queries = pd.DataFrame({"tile": rng.integers(0, 4, 60), "q": np.arange(60), "x": rng.random(60) * 20 - 10, "y": rng.random(60) * 20 - 10, "reach": 2.0 ** rng.integers(-2, 5, 60) * 0.9})
    got = patches_xy(spark.createDataFrame(queries), spark.createDataFrame(points), ["tile"], "q", "pid").toPandas()
    want = queries.merge(points, on="tile", suffixes=("_q", ""))
    want = want[np.hypot(want.x_q - want.x, want.y_q - want.y) <= want.reach]
    want = want.groupby(["q", "x", "y", "z"], as_index=False).agg(pid=("pid", "min"), n=("pid", "size"))
    order = ["q", "pid"]
    assert got[["q", "pid", "x", "y", "z", "n"]].sort_values(order).to_numpy().tolist() == want[["q", "pid", "x", "y", "z", "n"]].sort_values(order).to_numpy().tolist()


def test_runs_are_whole(spark):
    df = spark.range(5000).selectExpr("id % 37 AS k", "id % 37 % 5 AS j", "id AS v")

    def total(pdf, starts):
        return pdf.iloc[starts][["k", "j"]].assign(n=np.diff(starts, append=len(pdf)), low=np.minimum.reduceat(pdf["v"].to_numpy(), starts))

    out = map_runs(df, ["k", "j"], ["v"], total, "k long, j long, n long, low long", rows=150).collect()
    assert sorted((r.k, r.low) for r in out) == [(k, k) for k in range(37)] and sum(r.n for r in out) == 5000


def test_far_queries_and_bare_tiles(spark):
    """A query ten times the tile away rests on its nearest point; one on a tile without ground says so."""
    g = np.stack(np.meshgrid(np.arange(-3, 3, 0.2), np.arange(-3, 3, 0.2)), -1).reshape(-1, 2)
    ground = pd.DataFrame({"tile_id": 0, "point_idx": np.arange(len(g)), "x": g[:, 0], "y": g[:, 1], "z": 2.0})
    ground = pd.concat([ground, ground.assign(point_idx=ground.point_idx + 5000)])
    rows = [(0, 0, 0.0, 0.0, 0.5), (1, 0, 60.0, 1.0, 0.0), (2, 9, 0.0, 0.0, 0.0)]
    queries = spark.createDataFrame(rows, "query_id bigint, tile_id bigint, qx double, qy double, qyaw double")
    out = {r.query_id: r for r in settle(queries, spark.createDataFrame(ground), WHEELS, com_z=0.5, fit=(0.6, 3.0, 10), cells=[0.5, 1.0, 2.0]).collect()}
    assert len(out) == 3
    assert out[0].ok and abs(out[0].z - (2.5 - 1 / 80)) < 1e-6 and abs(out[0].roll) < 1e-6 and abs(out[0].pitch) < 1e-6
    assert out[0].distances is not None and np.allclose(out[0].distances, -1 / 80, atol=1e-6)
    whole = contact.Patches(np.array([0]), ground[["x", "y", "z"]].to_numpy(float)[:900], np.full(900, 2.0))
    local = np.array([(x, y, -0.5) for x, y in WHEELS])
    alone = contact.rest(whole, np.array([[60.0, 1.0]]), np.zeros(1), np.array([1.5]), local, 20.0, 1.0, (0.6, 3.0, 10), 50, 0.01, 1e-12, 1e-10)
    assert out[1].reason != "ground" and abs(out[1].z - alone["z"][0]) < 1e-9 and abs(np.sin(out[1].pitch) + alone["rotation"][0, 2, 0]) < 1e-9
    assert not out[2].ok and out[2].reason == "ground" and out[2].distances is None
