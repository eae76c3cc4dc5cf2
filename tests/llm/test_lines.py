"""Components of lines against all pairs."""

from helpers import awkward, empty, prose

from scanlake.llm import lines
from scanlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows, threshold=0.8):
    """Where each line's kept line is, by comparing all distinct lines."""
    met = {}
    for doc, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            if lines.compared(line):
                met.setdefault(lines.compared(line), []).append((doc, k))
    names = list(met)
    sets, parent = [lines.shingles(x) for x in names], list(range(len(names)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(names)):
        for j in range(i):
            small, large = sorted((len(sets[i]), len(sets[j])))
            if small >= threshold * large and lines.jaccard(names[i], names[j]) >= threshold:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    first = {}
    for i, name in enumerate(names):
        first[root(i)] = min(first.get(root(i), (float("inf"), 0)), min(met[name]))
    return {place: first[root(i)] for i, name in enumerate(names) for place in met[name]}


def test_query_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = brute(docs)
    got = {(r.doc_id, r.line_no): (r.kept_doc_id, r.kept_line_no) for r in QUERIES["op4_line_dedup"](spark, SF).collect()}
    assert set(got) == set(want)
    assert sum(got[k] != want[k] for k in want) <= 0.002 * len(want)


def test_chains_and_hot_variants(spark):
    """A chain of small edits is one component though its ends differ; variants of a line leave one."""
    base = prose(4, 40)
    chain = [base[: len(base) - 6 * k] + prose(50 + k, 6 * k // 4)[: 6 * k] for k in range(12)]
    variants = [f"{prose(8, 30)} number {k:04d} {prose(7, 30)}" for k in range(120)]
    rows = [(k, line) for k, line in enumerate(chain + variants)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    got = {(r.doc, r.line_no): (r.kept_doc, r.kept_no) for r in lines.judge_lines(docs).collect()}
    assert got == want
    assert sum(r.kept for r in lines.judge_lines(docs).collect()) == len(set(want.values()))


def test_dropping_lines(spark):
    rows = [(1, "Alpha beta gamma.\n\nOwn line here", "x"), (2, "alpha  BETA gamma.\nAnother of its own", "x"), (3, "Alpha beta gamma.", "x"), (4, None, "x"), (5, " \n", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, line string")
    out = {r.doc_id: r.text for r in lines.drop_repeated_lines(docs).collect()}
    assert out == {1: "Alpha beta gamma.\n\nOwn line here", 2: "Another of its own", 4: None, 5: " \n"}


def test_awkward_rows(spark):
    rows = awkward(spark)
    judged = lines.judge_lines(rows).collect()
    assert {r.doc for r in judged} == {1, 2, 6, 7, 8, 9, 10, None}
    assert all(r.kept_doc == 1 for r in judged if r.doc in (1, 2))
    left = lines.drop_repeated_lines(rows)
    assert left.columns == rows.columns and 2 not in {r.doc_id for r in left.collect()}
    assert lines.drop_repeated_lines(empty(spark)).count() == 0


def test_long_line_in_pieces(monkeypatch):
    line = prose(3, 500)
    whole = lines.signatures([line, "short", ""])
    monkeypatch.setattr(lines, "PIECE", 100)
    assert (lines.signatures([line, "short", ""]) == whole).all()
