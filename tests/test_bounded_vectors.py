"""Vector search holds a bounded number of cosines at a time, and ties go to the lesser id."""

import tracemalloc

import numpy as np
import pytest

from orrery.operators import retrieval as R


@pytest.mark.parametrize("k", [1, 3, 40])
def test_merged_equals_a_sort_of_all(k):
    rng = np.random.default_rng(k)
    all_, names = np.round(rng.random((7, 90)), 1), rng.permutation(90)
    all_[rng.random(all_.shape) < 0.1] = -np.inf
    score, found = np.full((7, k), -np.inf), np.zeros((7, k), np.int64)
    for lo in range(0, 90, 25):
        score, found = R.merged(score, found, all_[:, lo : lo + 25], names[lo : lo + 25])
    for row, s, n in zip(all_, score, found, strict=True):
        want = sorted((-x, m) for x, m in zip(row, names, strict=True) if np.isfinite(x))[:k]
        assert [(-x, m) for x, m in zip(s, n, strict=True) if np.isfinite(x)] == want


def test_a_cell_holds_few_cosines(spark, monkeypatch):
    """The cell's function, run here: it took more than 100 bytes a pair of a query and 2,048 rows."""
    taken = {}
    cogroup = type(spark.range(1).groupBy("id").cogroup(spark.range(1).groupBy("id")))
    monkeypatch.setattr(cogroup, "applyInArrow", lambda self, f, schema: taken.setdefault("f", f) and None or spark.createDataFrame([], schema))
    rows = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    R.vector_topk(rows, rows, 10)
    import pyarrow as pa

    x = np.random.default_rng(1).random((4096, 8)).astype(np.float32)
    vectors = pa.array(x.tolist(), pa.list_(pa.float32()))
    own, asking = pa.table({"vec_id": np.arange(4096), "embedding": vectors}), pa.table({"asker": np.arange(4096), "asked": vectors})
    tracemalloc.start()
    got = taken["f"](own, asking)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.num_rows == 40960 and peak < 100 << 20
