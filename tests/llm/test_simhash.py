"""Fingerprints bit by bit, and the trie join against all pairs."""

import numpy as np
import pytest
import xxhash
from helpers import awkward, empty, prose

from scanlake.llm import simhash
from scanlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def grouped(fps, budget=3):
    fps = np.array(fps, np.uint64)
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= budget):
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_query_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().sort_values("doc_id")
    out = QUERIES["op8_simhash"](spark, SF).toPandas().sort_values("doc_id")
    assert out.doc_id.tolist() == docs.doc_id.tolist()
    fps = [fingerprint(t) for t in docs.text]
    assert out.fingerprint.tolist() == [f"{x:016x}" for x in fps]
    assert out.component_id.tolist() == [docs.doc_id.iloc[k] for k in grouped(fps)]


@pytest.mark.parametrize("node_rows", [4, 50, 8192])
def test_trie_join_against_all_pairs(spark, node_rows):
    """Clouds of near fingerprints, at every size of node that a task may take."""
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 40, np.int64).astype(np.uint64) * np.uint64(2)
    fps = {0, 1, 2**64 - 1, 2**63}
    for c in centres:
        for _ in range(int(rng.integers(1, 30))):
            flips = rng.choice(64, int(rng.integers(0, 5)), replace=False)
            fps.add(int(c) ^ sum(1 << int(b) for b in flips))
    fps = sorted(fps)
    frame = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    links = simhash.near_links(frame, node_rows=node_rows).toPandas()
    place = {int(np.uint64(x).astype(np.int64)): k for k, x in enumerate(fps)}
    label = simhash.forest(len(fps), links.a.map(place).to_numpy(), links.b.map(place).to_numpy())
    assert label.tolist() == grouped(fps)
    assert all(bin(fps[place[a]] ^ fps[place[b]]).count("1") >= 1 for a, b in zip(links.a, links.b))


def test_node_join_in_small_chunks(monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 64)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**62, 60, np.int64).astype(np.uint64)
    fps = np.unique(np.concatenate([base, base ^ np.uint64(5), base ^ np.uint64(1 << 40)]))
    a, b = simhash.node_join(fps, fps, 0, 0, 3, True)
    label = simhash.forest(len(fps), np.searchsorted(fps, a), np.searchsorted(fps, b))
    assert label.tolist() == grouped(fps)


def test_awkward_rows(spark):
    rows = awkward(spark).selectExpr("*", "'x' AS fp")
    groups = {r.doc_id: r for r in simhash.group_near_duplicates(rows).collect()}
    assert groups[3].fp == groups[4].fp == groups[5].fp == 0 and groups[5].component_id == 3
    assert groups[2].component_id == 1 and groups[None].component_id is None
    assert simhash.group_near_duplicates(rows).count() == rows.count()
    left = simhash.drop_near_duplicates(rows)
    ids = sorted((r.doc_id for r in left.collect()), key=repr)
    assert left.columns == rows.columns and ids.count(None) == 1 and 2 not in ids and ids.count(1) == 1
    assert simhash.drop_near_duplicates(empty(spark)).count() == 0


def test_few_words():
    assert simhash.fingerprint_of(b"") == simhash.fingerprint_of(b" \n") == 0
    assert simhash.fingerprint_of(b"One two") == xxhash.xxh64_intdigest(b"one two", 42)
    assert simhash.fingerprint_of(prose(1, 40).encode()) == fingerprint(prose(1, 40))
