"""Nodes of the trie against plain loops over all prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from scanlake.llm import conversation_trie as ct
from scanlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
ROW = "conv_id long, turn long, role string, text string, pos string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def read(rows):
    """Turns of each conversation, in order."""
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        base = c - int(np.fmod(c, 20))
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    """The rows of the nodes, by walking every prefix."""
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in children[node]) if children[node] else 1
        saved[node] = sum(saved[k] for k in children[node]) + (len(members[node]) - 1) * words
    return sorted(
        (
            min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(children[n]), leaves[n], saved[n],
            hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest(),
        )
        for n in members
    )


def rows(frame):
    return sorted(tuple(r[c] for c in NAMES) for r in frame.collect())


@pytest.fixture()
def many_tasks(spark):
    """Small tables are dealt over several tasks too."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_query_equals_loops(spark, many_tasks):
    table = spark.read.parquet(f"{SF}/conversations.parquet").toPandas()
    got = rows(QUERIES["op12_conversation_trie"](spark, SF))
    assert got == brute(rebuilt(read(table.itertuples(index=False))))


def test_shards_meet_and_segments_go_on(spark, many_tasks):
    """Few different turns, so that paths are shared by many shards; copies; conversations longer than a segment."""
    rng = random.Random(3)
    told = {}
    for c in range(400):
        if c % 5 == 4:
            told[c] = told[rng.randrange(c)][: rng.randrange(1, 40)] + [rng.choice("abc")]
        else:
            told[c] = [rng.choice("ab" if rng.random() < 0.8 else "cde f") for _ in range(rng.choice([0, 1, 2, 3, 4, 8, 9, 30]))]
    told[7] = ["a"] * 333
    told[8] = ["a"] * 333 + ["b"]
    told[9] = ["a"] * 40
    table = [(c, t, "user", text, "x") for c, ts in told.items() for t, text in enumerate(ts)]
    turns = ct.read_turns(spark.createDataFrame(table, ROW))
    sizes = spark.createDataFrame([(c, len(ts)) for c, ts in told.items()], "conv long, size long")
    want = brute({c: [("user", t) for t in ts] for c, ts in told.items()})
    for segment, units in ((ct.SEGMENT, ct.UNITS), (8, 3)):
        assert rows(ct.build(turns, sizes, segment, units)) == want, (segment, units)


def test_awkward_rows(spark):
    """Null columns, ties, repeated rows, negative ids, conversations without a base or with fewer turns than borrowed."""
    table = [
        (1, 0, "u", "hello  there", "x"), (1, 0, "u", "hello  there", "x"), (1, None, None, None, "x"), (1, None, "u", None, "x"),
        (0, 1, "u", "a b", "x"), (0, 1, "a", "a b", "x"), (None, 1, "u", "lost", "x"), (-3, 5, "u", "", "x"), (-23, 5, "u", "x" * 100_000, "x"),
        (-20, 1, "u", "q", "x"), (45, 1, "u", "only", "x"), (46, 1, "u", "one", "x"), (46, 2, "u", "two", "x"), (47, None, "u", "é ü\tz", "x"),
    ] + [(k, t, "u", f"t{t}", "x") for k in range(100, 125) for t in range(4)]
    frame = spark.createDataFrame(table, ROW)
    got = rows(ct.build(*ct.borrow_heads(ct.read_turns(frame))))
    convs = read(table)
    tied = {c: {i for i, t in enumerate(ts) if ts.count(t) > 1 or c in (0, 1)} for c, ts in convs.items()}
    assert tied[0]
    order = {r.conv: [] for r in ct.read_turns(frame).collect()}
    for r in ct.read_turns(frame).orderBy("conv", "pos").collect():
        order[r.conv].append(r.sym)
    digest = {}
    for c, ts in convs.items():
        for role, text in ts:
            a, b = role.encode(), text.encode()
            digest[hashlib.md5(b"%d:%s%d:%s" % (len(a), a, len(b), b)).digest()] = (role, text)
    placed = {c: [digest[bytes(s)] for s in syms] for c, syms in order.items()}
    assert {c: sorted(ts) for c, ts in placed.items()} == {c: sorted(ts) for c, ts in convs.items()}
    assert got == brute(rebuilt(placed))
    assert ct.build(*ct.borrow_heads(ct.read_turns(frame.limit(0)))).count() == 0


def test_closing_parentheses():
    rng = np.random.default_rng(0)
    for n in (1, 5, 100, 3000):
        bits, open_ = [], 0
        for _ in range(n):
            if open_ == 0 or rng.random() < 0.6:
                bits.append(1)
                open_ += 1
            else:
                bits.append(-1)
                open_ -= 1
        bits = np.array(bits + [-1] * open_)
        stack, want = [], {}
        for at, b in enumerate(bits):
            if b > 0:
                stack.append(at)
            else:
                want[stack.pop()] = at
        opens = np.flatnonzero(bits > 0)
        assert ct.find_close(np.cumsum(bits), opens).tolist() == [want[o] for o in opens]
