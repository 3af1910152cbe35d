"""The corpus pipeline against its stages' brute force, and the contract of the registered queries."""

import hashlib

import corpus_pipeline
import numpy as np
import pytest
from brute import cut, leaks, near_roots, sha
from tokenizers import Tokenizer

import __spark_entry__
from orrery.llm import quality
from orrery.llm.common import table, vocabulary


@pytest.fixture(scope="module")
def documents(spark, sf):
    return table(spark, sf, "documents")


def test_run_equals_brute_force(spark, sf, documents):
    scores = {r.doc_id: r.predicted for r in quality.scores(documents, table(spark, sf, "labels")).collect()}
    rows = [(r.doc_id, r.text) for r in documents.collect() if scores[r.doc_id] == 1]
    roots = near_roots(rows)
    rows = [x for x in rows if x[0] in roots]
    kept = cut(rows)
    rows = [(i, t if not kept[i][1] else b" ".join(kept[i][2]).decode()) for i, t in rows]
    found = leaks(rows, [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()])
    rows = [x for x in rows if not found[x[0]][4]]
    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = {}
    for i, text in rows:
        ids = t.encode(text, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(text))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and 0 < len(got) < documents.count()


def test_stages_return_documents(spark, sf, documents):
    assert len(corpus_pipeline.STAGES) == 5
    small = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, small, sf).columns == documents.columns


def test_registered_queries():
    names = list(__spark_entry__.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
