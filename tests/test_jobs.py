"""Whole jobs recover geometry that is put in."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from scanlake.operators import graph
from scanlake.operators.selection import _matrices
from scanlake.plans.alignment import align_clouds
from scanlake.plans.loops import verify_loops
from scanlake.plans.mapping import refine_to_map
from scanlake.plans.registration import register_pairs
from scanlake.plans.terrain import settle
from scanlake.sources import sinks


def room(rng, n=260):
    """Points on a floor and four walls of an asymmetric room."""
    u, v = rng.random(n), rng.random(n)
    faces = [
        np.stack([u * 12 - 5, v * 9 - 4, np.full(n, -1.5)], 1), np.stack([np.full(n, 7.0), v * 9 - 4, u * 4 - 1.5], 1),
        np.stack([np.full(n, -5.0), v * 9 - 4, u * 4 - 1.5], 1), np.stack([u * 12 - 5, np.full(n, 5.0), v * 4 - 1.5], 1),
        np.stack([u * 12 - 5, np.full(n, -4.0), v * 4 - 1.5], 1),
    ]
    return np.concatenate(faces)


def transform(pose):
    r, t = _matrices(np.array([pose], dtype=float))
    return r[0], t[0]


def cloud(spark, xyz, **extra):
    pdf = pd.DataFrame(xyz, columns=["x", "y", "z"])
    for k, v in extra.items():
        pdf[k] = v
    return spark.createDataFrame(pdf)


def test_alignment_recovers_a_motion(spark):
    xyz = room(np.random.default_rng(0), 120)
    r, t = transform([0.1, -0.08, 0.05, 0.01, -0.01, 0.02])
    ids = np.arange(len(xyz))
    source = cloud(spark, (xyz - t) @ r, key=1, point_id=ids)
    pairs = spark.createDataFrame([(1, 1)], "key long, other long")
    target = cloud(spark, xyz, key=1, point_id=ids)
    out = align_clouds(pairs, source.withColumnRenamed("key", "other"), ["other"], target, ["key"], 0.5, rounds=12).first()
    got = np.array([[out[f"r{i}{j}"] for j in range(3)] for i in range(3)])
    assert np.allclose(got, r, atol=0.01)
    assert np.allclose([out["tx"], out["ty"], out["tz"]], t, atol=0.03)
    assert out["fitness"] < 0.01


def test_registration_recovers_a_rotation(spark):
    xyz = room(np.random.default_rng(1))
    r, _ = transform([0, 0, 0, 0.0, 0.0, 0.03])
    ids = np.arange(len(xyz))
    pts = cloud(spark, xyz, scan_id=2, point_idx=ids).unionByName(cloud(spark, xyz @ r, scan_id=1, point_idx=ids))
    pairs = spark.createDataFrame([(0, 1, 2)], "pair_id bigint, source_id bigint, target_id bigint")
    out = register_pairs(pts, pairs, k=10, cells=[0.5, 1.0, 2.0, 4.0], size=1.0, rounds=8, strength=0.0).first()
    yaw = np.arctan2(out["r10"], out["r00"])
    assert abs(yaw - 0.03) < 0.006
    assert np.linalg.norm([out["t0"], out["t1"], out["t2"]]) < 0.1


def test_refinement_returns_to_the_pose(spark):
    xyz = room(np.random.default_rng(2), 500)
    true = [0.05, -0.06, 0.04, 0.004, -0.006, 0.01]
    r, t = transform(true)
    ids = np.arange(len(xyz))
    surfaces = cloud(spark, (xyz - t) @ r, scan_id=1, point_id=ids)
    surface_map = cloud(spark, xyz, scan_id=1, point_id=ids)
    guess = spark.createDataFrame([(1, *[0.0] * 6)], "scan_id bigint, x double, y double, z double, roll double, pitch double, yaw double")
    none = surfaces.where("false")
    out = refine_to_map(none, surfaces, none, surface_map, guess, ["scan_id"], max_d=1.5, rounds=6).first()
    got = [out[f] for f in ("x", "y", "z", "roll", "pitch", "yaw")]
    assert np.allclose(got[:3], true[:3], atol=0.02)
    assert np.allclose(got[3:], true[3:], atol=0.005)


def test_vehicle_settles_on_a_slope(spark):
    g = np.stack(np.meshgrid(np.arange(-3, 3, 0.2), np.arange(-3, 3, 0.2)), -1).reshape(-1, 2)
    slope = 0.1
    ground = cloud(spark, np.column_stack([g, slope * g[:, 0]]), tile_id=0, point_idx=np.arange(len(g)))
    queries = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0)], "query_id bigint, tile_id bigint, qx double, qy double, qyaw double")
    wheels = [(0.8, 0.5), (0.8, -0.5), (-0.8, -0.5), (-0.8, 0.5)]
    out = settle(queries, ground, wheels, com_z=0.5, max_iters=25, fit=(0.6, 3.0, 10), cells=[0.5, 1.0, 2.0]).first()
    assert abs(out["pitch"] + np.arctan(slope)) < 0.01
    assert abs(out["roll"]) < 0.01
    assert abs(out["cost"]) < 1e-6


def test_a_true_loop_is_verified(spark):
    rng = np.random.default_rng(4)
    world = room(rng, 400)
    poses = {0: [0, 0, 0, 0, 0, 0], 1: [0.5, 0, 0, 0, 0, 0.05], 2: [0.1, 0.05, 0, 0, 0, 0.02]}
    drift = [0.08, -0.06, 0.02, 0, 0, 0.01]
    frames, clouds = [], []
    for k, pose in poses.items():
        r, t = transform(pose)
        clouds.append(pd.DataFrame((world - t) @ r, columns=["x", "y", "z"]).assign(vehicle_id=1, kf_id=k, point_idx=np.arange(len(world))))
        shown = np.add(pose, drift) if k == 2 else pose
        frames.append((1, k, *map(float, shown)))
    kf = spark.createDataFrame(frames, "vehicle_id bigint, kf_id bigint, x double, y double, z double, roll double, pitch double, yaw double")
    kp = spark.createDataFrame(pd.concat(clouds))
    cand = spark.createDataFrame([(1, 2, 0)], "vehicle_id bigint, kf_id bigint, loop_id bigint")
    out = verify_loops(cand, kf, kp, neighbours=1, leaf=0.2, min_source=100, min_target=100, size=0.5).collect()
    assert len(out) == 1
    r2, t2 = transform(poses[2])
    assert np.allclose([out[0]["x"], out[0]["y"], out[0]["z"]], -r2.T @ t2, atol=0.05)
    assert abs(out[0]["yaw"] + 0.02) < 0.01


def test_exports_can_be_read_back(spark, tmp_path):
    from scanlake.sources import shapes as fx

    d = "/root/testdata/sf0.001"
    kf, kp = fx.keyframes(spark, d), fx.keyframe_points(spark, d)
    sinks.write_keyframes(kp, kf, str(tmp_path / "clouds"))
    assert spark.read.parquet(str(tmp_path / "clouds/keyframes")).count() == kp.count()
    assert spark.read.parquet(str(tmp_path / "clouds/global")).count() == kp.count()
    sinks.write_trajectory(kf, str(tmp_path / "path"))
    one = spark.read.text(str(tmp_path / "path/vehicle_id=3")).collect()
    times = [float(r[0].split()[0]) for r in one]
    assert len(one) == kf.where("vehicle_id = 3").count() and all(len(r[0].split()) == 8 for r in one)
    assert len(set(times)) == len(times)
    edges = graph.odometry_edges(kf, ["vehicle_id"], width=fx.BLOCK)
    sinks.write_graph(kf, edges, str(tmp_path / "graph"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "graph/vehicle_id=3")).collect()]
    assert sum(v.startswith("VERTEX_SE3:QUAT ") for v in lines) == len(one)
    assert sum(v.startswith("EDGE_SE3:QUAT ") for v in lines) == len(one) - 1
    sinks.write_snapshot(kf, str(tmp_path / "snapshot"))
    assert spark.read.parquet(str(tmp_path / "snapshot/poses")).count() == kf.count()


def test_regularised_covariances(spark):
    from scanlake.functions.matrices import REGULARISATIONS, regularise3

    df = spark.createDataFrame([([4.0, 0.0, 0.0, 2.0, 0.0, 1e-6],)], "c array<double>")
    got = {m: df.select(regularise3(m)(F.col("c"))).first()[0] for m in REGULARISATIONS}
    assert np.allclose(got["plane"], [1, 0, 0, 1, 0, 1e-3])
    assert np.allclose(got["min_eig"], [4, 0, 0, 2, 0, 1e-3])
    assert np.allclose(got["normalized_min_eig"], [1, 0, 0, 0.5, 0, 1e-3])
    assert np.allclose(got["plane_s"], [4 / 6.000001, 0, 0, 2 / 6.000001, 0, 1e-3])
    assert np.allclose(got["none"], [4, 0, 0, 2, 0, 1e-6])
