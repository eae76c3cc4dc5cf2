"""Windows against plain loops; the query's SQL runs with all oracles."""

import pytest
from helpers import awkward, empty, prose

from scanlake.llm import decontamination as d

ITEM = "item_id long, text string"


def brute(text, items, width=13):
    words = d.words_of((text or "").encode())
    hit, names = set(), set()
    for item, body in items:
        own = d.words_of((body or "").encode())
        size = min(width, len(own))
        for k in range(len(own) - size + 1 if own else 0):
            for at in range(len(words) - size + 1):
                if words[at : at + size] == own[k : k + size]:
                    hit |= set(range(at, at + size))
                    names.add("" if item is None else str(item))
    return len(words), sorted(hit), sorted(names)


@pytest.mark.parametrize("part_windows", [3, 500_000])
def test_against_loops(spark, part_windows):
    items = [(1, prose(1, 30)), (2, prose(2, 13)), (3, "Short one"), (10, prose(1, 20)), (4, None), (5, ""), (6, "!!"), (None, prose(7, 15)), (3, "Short one")]
    texts = [
        prose(20, 10) + " " + prose(1, 30).upper() + ", " + prose(21, 30), "short, ONE more", prose(2, 12), prose(2, 13).replace(" ", "--"), None, "", "é short one é",
        prose(7, 15) * 2, prose(1, 14) + " x " + prose(1, 30), prose(40, 2000) + " " + prose(2, 13),
    ]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, item_ids string")
    marked = d.mark_contaminated(docs, spark.createDataFrame(items, ITEM), part_windows=part_windows).collect()
    assert len(marked) == len(texts)
    for r in marked:
        assert (r.n_words, r.hit_words, r.item_ids) == brute(r.text, items)


def test_documents_and_spans(spark):
    items = spark.createDataFrame([(1, prose(1, 20))], ITEM)
    whole, little = prose(9, 10) + ", " + prose(1, 20) + ". " + prose(8, 10), prose(30, 400) + " " + prose(1, 13)
    docs = spark.createDataFrame([(1, whole), (2, little), (3, None), (3, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in d.decontaminate(docs, items).collect()) == [2, 3, 3]
    spans = {r.doc_id: r.text for r in d.decontaminate(docs, items, "spans").collect()}
    assert spans == {1: prose(9, 10) + ", . " + prose(8, 10), 2: prose(30, 400) + " ", 3: None}
    with pytest.raises(ValueError):
        d.decontaminate(docs, items, "lines")


def test_awkward_rows(spark):
    items = spark.createDataFrame([(1, prose(1, 60))], ITEM)
    rows = awkward(spark)
    left = d.decontaminate(rows, items)
    assert left.columns == rows.columns and {1, 2, 9}.isdisjoint({r.doc_id for r in left.collect()}) and left.count() == rows.count() - 4
    assert d.decontaminate(rows, items.limit(0)).count() == rows.count()
    assert d.decontaminate(empty(spark), items).count() == 0
