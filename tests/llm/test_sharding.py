"""Shards against a plain ranking."""

import zlib
from collections import Counter

import pytest
from helpers import awkward, empty

from scanlake.llm import sharding
from scanlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_query_covers_every_document(spark):
    out = QUERIES["op1_sharding"](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")
    assert sorted(out.doc_id) == sorted(docs.index)
    for row in out.itertuples():
        raw = (docs.text[row.doc_id] or "").encode()
        assert (row.size, row.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    counts = out.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert sorted(counts.index) == list(range(16)) and counts["count"].max() - counts["count"].min() <= 1
    assert (counts["min"] == 0).all() and (counts["max"] == counts["count"] - 1).all() and (counts["nunique"] == counts["count"]).all()


@pytest.mark.parametrize("bucket_rows", [7, 20_000])
def test_shards_match_the_mixture(spark, bucket_rows):
    rows = spark.range(1200).selectExpr("id", "if(id < 800, 'hot', concat('s', id % 4)) AS source", "id AS shard")
    out = sharding.interleave(rows, 8, "source", ["id"], bucket_rows=bucket_rows).toPandas()
    for source, n in Counter(out.source).items():
        per_shard = out[out.source == source].groupby("shard").size().reindex(range(8), fill_value=0)
        assert per_shard.max() - n / 8 < 2 and n / 8 - per_shard.min() < 2
    assert out.groupby("shard").size().tolist() == [150] * 8


def test_same_places_whatever_the_partitions_and_buckets(spark):
    rows = spark.range(500).selectExpr("id", "concat('s', id % 3) AS source")
    a = sharding.interleave(rows, 5, "source", ["id"], seed=3).toPandas().sort_values("id")
    b = sharding.interleave(rows.repartition(9), 5, "source", ["id"], seed=3, bucket_rows=40).toPandas().sort_values("id")
    assert (a[["shard", "slot"]].values == b[["shard", "slot"]].values).all()


def test_awkward_rows(spark):
    rows = awkward(spark)
    out = sharding.interleave(rows, 4, "source", ["doc_id", "text"]).toPandas()
    assert len(out) == rows.count() and sorted(out.groupby("shard").size()) == [3, 3, 3, 4]
    assert sharding.interleave(empty(spark), 4, "source", ["doc_id"]).count() == 0


def test_written_shards(spark, tmp_path):
    rows = spark.range(100).selectExpr("id", "'s' AS source")
    sharding.write_shards(sharding.interleave(rows, 4, "source", ["id"]), str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and back.select("shard").distinct().count() == 4
