"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from scanlake.catalog import QUERIES  # noqa: E402
from scanlake.session import local_session  # noqa: E402

HEADLINE = [
    "flagship_range_image_voxels", "first_hit", "curvature", "occlusion_mask", "voxel_map", "polar_voxel_map",
    "azimuth_time", "transform_points", "radius_join", "weighted_neighbours", "knn_join", "nearest_xy",
    "relative_pose", "segments", "asof_join", "nearest_time_join", "correct_drift", "resample", "recent_path",
    "sample_interval", "select_keyframes", "loop_by_radius", "graph_edges", "scan_descriptor", "descriptor_knn",
    "feature_job", "build_map",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, 2 * int(cores) if cores.isdigit() else 16)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").count().write.format("noop").mode(
        "overwrite"
    ).save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
             "sf": os.path.basename(sf_dir.rstrip("/"))}
        )
    )


if __name__ == "__main__":
    main()
