"""Scan-to-map refinement inside a task, against the rounds over tables."""

import numpy as np
import pandas as pd

from scanlake.plans.mapping import refine_to_map


def test_both_ways_give_the_same_poses(spark):
    rng = np.random.default_rng(3)
    scans, n = 4, 120
    u, v = rng.random(scans * n) * 8, rng.random(scans * n) * 8
    walls = np.where((np.arange(scans * n) % 3 == 0)[:, None], np.stack([u, v, 0.02 * u - 1.5], 1), np.stack([u, np.full_like(u, 4.0), v - 2], 1))
    poles = np.stack([np.round(u), np.round(v), rng.random(scans * n) * 3], 1)

    def table(xyz):
        rows = pd.DataFrame(xyz, columns=["x", "y", "z"])
        return rows.assign(scan_id=np.arange(len(rows)) % scans, point_id=np.arange(len(rows)))

    edges, surfaces = table(poles), table(walls)
    surfaces.loc[5, "z"] = np.nan
    guess = pd.DataFrame([[s, 0.05, -0.03, 0.02, 0.002, -0.001, 0.004] for s in range(scans + 1)],
                         columns=["scan_id", "x", "y", "z", "roll", "pitch", "yaw"])
    maps = [spark.createDataFrame(p) for p in (edges, surfaces, edges.iloc[::-1], surfaces.iloc[::-1])]
    got = [
        refine_to_map(*maps, spark.createDataFrame(guess), ["scan_id"], max_d=1.5, rounds=2, min_matches=20, at_once=at_once)
        .toPandas().sort_values("scan_id").reset_index(drop=True)
        for at_once in (2048, 0)
    ]
    assert got[0]["scan_id"].tolist() == list(range(scans + 1))
    assert (got[0].iloc[:scans]["x"] != 0.05).all() and got[0].iloc[scans]["x"] == 0.05
    pd.testing.assert_frame_equal(got[0], got[1][got[0].columns], rtol=0, atol=1e-9)
