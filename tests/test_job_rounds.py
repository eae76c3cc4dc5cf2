"""The registered jobs run to their end on the smallest tables, by the library's own limits of rounds."""

import pytest

from scanlake.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def test_attitudes_come_to_rest(spark):
    out = QUERIES["settle"](spark, SF).toPandas()
    queries = spark.read.parquet(f"{SF}/customer.parquet").count()
    assert len(out) == queries and set(out.reason) <= {"none", "z", "tilt", "wheels", "max_iters", "ground"}
    assert (out.reason == "none").sum() > queries / 4


def test_loops_are_verified_in_both_frames(spark):
    out = QUERIES["verify_loops"](spark, SF).toPandas()
    assert set(out.robust) == {True, False} and (out.fitness <= 0.3).all() and (out.from_id != out.to_id).all()
    assert not out.duplicated(["vehicle_id", "from_id", "to_id", "robust"]).any()


@pytest.mark.parametrize("name", ["associate_priors", "smooth", "fuse"])
def test_runs_to_the_end(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
