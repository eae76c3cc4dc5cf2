"""The whole pipeline against the same steps by brute force, and every query with an oracle."""

import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from compare import difference, oracle
from helpers import awkward, empty
from test_decontamination import brute as hits
from test_lines import brute as kept_lines
from test_simhash import fingerprint, grouped

from scanlake.llm import bpe, lines
from scanlake.llm.queries import ORACLES, QUERIES
from scanlake.session import cut

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, name):
    assert difference(QUERIES[name](spark, SF).toPandas(), oracle(ORACLES[name], SF)) is None


def test_pipeline_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    texts = {r.doc_id: r.text for r in docs if any(c.isalpha() for c in r.text or "")}
    first = kept_lines(sorted(texts.items()))
    for doc, text in list(texts.items()):
        left = [x for k, x in enumerate(text.split("\n")) if not lines.compared(x) or first[doc, k] == (doc, k)]
        if any(map(lines.compared, left)):
            texts[doc] = "\n".join(left)
        else:
            del texts[doc]
    ids = sorted(texts)
    roots = grouped([fingerprint(texts[i]) for i in ids])
    texts = {i: texts[i] for k, i in enumerate(ids) if roots[k] == k}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {}
    for doc, text in texts.items():
        n, hit, _ = hits(text, items)
        if not hit or 20 * len(hit) < n:
            clean[doc] = text
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(clean)
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, special_tokens={},
        mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")),
    )
    for doc, text in clean.items():
        assert got[doc].text == text and got[doc].n_chars == len(text)
        assert np.frombuffer(bytes(got[doc].token_ids), "<u4").tolist() == library.encode_ordinary(text)
        assert got[doc].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_stages_take_awkward_and_no_rows(spark):
    docs = awkward(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, SF))
        assert docs.columns == awkward(spark).columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), SF).count() == 0
