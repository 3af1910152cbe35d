"""Sinks that may run twice, state that grows with what is new, exact searches with bounds, fitted grids."""

import glob
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orrery.operators import learner, products, retrieval, validation
from orrery.sources import tables
from orrery.streaming import streams

DERBY = {"url": "jdbc:derby:memory:trips;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}


def read(spark, name):
    return sorted(tuple(r) for r in spark.read.format("jdbc").options(dbtable=name, **DERBY).load().collect())


def test_a_repeated_task_adds_no_row(spark):
    rows = [(i, f"n{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "id int, label string")
    put = lambda x: tables.put_jdbc(x, DERBY["url"], "puts", ["id"], 3, DERBY["driver"], "label VARCHAR(20)")
    put(df.union(df.where("id < 20")))  # as if some tasks had written twice
    assert read(spark, "puts") == rows
    put(df.where("id >= 40").withColumn("label", F.lit("new")))
    put(df.where("id >= 40").withColumn("label", F.lit("new")))
    assert read(spark, "puts") == rows[:40] + [(i, "new") for i in range(40, 50)]


def test_a_failed_move_changes_nothing(spark):
    df = spark.createDataFrame([(1, "a")], "id int, label string")
    tables.put_jdbc(df, DERBY["url"], "kept", ["id"], 1, DERBY["driver"], "label VARCHAR(20)")
    with pytest.raises(Exception):
        tables.in_transaction(spark, DERBY["url"], ["delete from kept", "insert into kept values (no_such_column)"], DERBY["driver"])
    assert read(spark, "kept") == [(1, "a")]


def test_upsert_leaves_other_partitions_alone(spark, tmp_path):
    path, kind = f"{tmp_path}/store", "k long, part int, ts int, v string"
    tables.store(spark.createDataFrame([(k, k % 4, 1, "old") for k in range(40)], kind), path, ["part"])
    files = lambda p: sorted(glob.glob(f"{path}/part={p}/*.parquet"))
    before = {p: files(p) for p in range(4)}
    batch = spark.createDataFrame([(2, 2, 5, "new"), (6, 2, 0, "late"), (98, 2, 1, "new")], kind)
    for _ in range(2):
        got = {r.k: r.v for r in tables.upsert_store(batch, path, ["k", "part"], "ts", ["part"]).collect()}
        assert got == {k: "old" for k in range(40)} | {2: "new", 98: "new"}
    assert [files(p) == before[p] for p in range(4)] == [True, True, False, True]
    with pytest.raises(ValueError):
        tables.upsert_store(batch, path, ["k"], "ts", ["part"])


def test_one_row_of_each_key(spark):
    df = spark.createDataFrame([(1, 1, "b"), (1, 1, "a"), (1, 1, "a"), (None, 2, None), (None, 1, "z"), (2, None, "q")], "k int, o int, v string")
    got = sorted(map(tuple, products.dedup_exact(df, ["k"], ["o"]).collect()), key=str)
    assert got == sorted([(1, 1, "a", 3), (None, 1, "z", 2), (2, None, "q", 1)], key=str)


class Stored:
    """What a processor asks of Spark, with counts of what is written."""

    def __init__(self):
        self.rows, self.value, self.timers, self.written = [], None, set(), 0

    def getListState(self, name, schema):
        return self

    def getValueState(self, name, schema):
        outer = self

        class Value:
            def exists(self):
                return outer.value is not None

            def get(self):
                return outer.value

            def update(self, v):
                outer.value = v

        return Value()

    def appendList(self, rows):
        self.rows += rows
        self.written += len(rows)

    def put(self, rows):
        self.rows, self.written = list(rows), self.written + len(rows)

    def get(self):
        return iter(self.rows)

    def clear(self):
        self.rows = []

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_state_written_grows_with_the_ticks():
    rng, stored, rules = random.Random(5), Stored(), streams.AlertRules(60.0, 2.0, 3, 3600)
    rules.init(stored)
    ticks = [(t * 60_000_000 + rng.randrange(50_000_000), t, rng.uniform(1, 120)) for t in range(3000)]
    out = []
    for lo in range(0, 3000, 25):  # a thousand ticks wait behind the watermark
        part = ticks[lo : lo + 25]
        frame = pd.DataFrame({"ts": pd.to_datetime([x[0] for x in part], unit="us"), "id": [x[1] for x in part], "price": [x[2] for x in part]})
        list(rules.handleInputRows(("s",), iter([frame]), Mark(0)))
        mark = max(0, (lo - 1000) * 60_000)
        while stored.timers and min(stored.timers) <= mark:
            stored.timers.remove(min(stored.timers))
            out += [tuple(r) for f in rules.handleExpiredTimer(("s",), Mark(mark), None) for r in f.itertuples(index=False)]
    stored.timers.clear()
    out += [tuple(r) for f in rules.handleExpiredTimer(("s",), Mark(10**9), None) for r in f.itertuples(index=False)]
    want, prices, last = [], [], {}
    for us, i, price in sorted(ticks):
        far = prices[-3] if len(prices) >= 3 else None
        for name, hit in (("cross", bool(prices) and prices[-1] < 60 <= price), ("move", far is not None and abs((price - far) / far) >= 2)):
            if hit and (name not in last or us - last[name] >= 3600 * 1_000_000):
                last[name] = us
                want.append(("s", name, i, us, price))
        prices.append(price)
    assert out == want and len(out) > 20
    assert stored.written <= 2 * len(ticks)


def test_ridge_models_equal_direct_fits(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3)) * [1, 10, 0.1] + 3
    y = x @ [2.0, -1.0, 5.0] + 7 + rng.normal(size=300)
    fold = rng.integers(0, 4, 300)
    rows = [(*map(float, a), float(b), int(f) if f else None) for a, b, f in zip(x, y, fold, strict=True)] + [(None, 1.0, 1.0, 1.0, 1), (1.0, 1.0, 1.0, None, 2)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double, fold int")
    got = {(r.ridge, r.fold, r.metric): r.value for r in learner.ridge_grid(df, ["a", "b", "c"], "y", "fold", [0.0, 5.0]).collect()}
    assert len(got) == 2 * 4 * 2
    for ridge in (0.0, 5.0):
        for f in range(4):
            u, v = x[fold != f], y[fold != f]
            slope = np.linalg.solve((u - u.mean(0)).T @ (u - u.mean(0)) + ridge * np.eye(3), (u - u.mean(0)).T @ (v - v.mean()))
            e = y[fold == f] - (v.mean() + (x[fold == f] - u.mean(0)) @ slope)
            assert got[ridge, f or None, "rmse"] == pytest.approx(np.sqrt((e * e).mean()), rel=1e-9)
            assert got[ridge, f or None, "mae"] == pytest.approx(np.abs(e).mean(), rel=1e-9)


def test_few_pairs_are_scored_and_none_is_lost(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    queries = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    stages = retrieval.bm25_stages(queries, docs, "doc_id", 10)
    words = retrieval.word_counts(docs, "doc_id", retrieval.norm_text(F.col("text")))
    asked = queries.select("query_id", F.explode(F.array_distinct(F.split(retrieval.norm_text(F.col("text")), " "))).alias("term"))
    pairs = asked.join(words.select("unit", "term"), "term").select("query_id", "unit").distinct().count()
    sizes = [s.count() for s in stages]
    assert sizes[0] < pairs / 2 and sizes[1] == sizes[2] < pairs / 8
    one = queries.limit(1).select("query_id", F.lit("the a zzzunknown").alias("text"))
    hits = retrieval.bm25_topk(one, docs, "doc_id", 3).collect()
    assert sorted(r["rank"] for r in hits) == list(range(1, len(hits) + 1))
    assert retrieval.bm25_topk(queries.limit(0), docs, "doc_id", 3).count() == 0


def test_codes_with_all_lists_are_exact(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 12))
    x[50:60], x[7] = x[50], 0
    vectors = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<float>")
    queries = vectors.where("vec_id % 20 = 0")
    rows = lambda df: sorted(map(tuple, df.select("query_id", "vec_id", "score", "rank").collect()))
    assert rows(retrieval.vector_topk_lists(queries, vectors, 5, lists=7, probe=7, rows=50, held=6)) == rows(retrieval.vector_topk(queries, vectors, 5))


@pytest.mark.parametrize("bits", [64, 8])
def test_shared_runs_with_colliding_hashes(spark, bits):
    rng = random.Random(bits)
    text = lambda n: " ".join(f"w{rng.randrange(40)}" for _ in range(n))
    docs, items = [(i, text(60)) for i in range(30)] + [(30, None), (31, ""), (32, "one two")], [(i, text(8)) for i in range(30)] + [(30, "one two")]
    items += [(40, " ".join(docs[3][1].split()[5:15]))]
    runs = lambda t: {tuple(w[i : i + 4]) for w in [(t or "").split()] for i in range(max(1, len(w) - 3)) if w}
    want = sorted((j, i, len(runs(a) & runs(b))) for i, a in docs for j, b in items if runs(a) & runs(b))
    train, evals = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert sorted(map(tuple, validation.ngram_leak(train, evals, 4, bits).collect())) == want and len(want) >= 2
    base = text(120).split()
    near = [(i, " ".join(base[: 115 - i] + ["x"] * i + base[115 - i :])) for i in range(6)] + docs
    got = sorted(map(tuple, products.near_dup_pairs(spark.createDataFrame(near[:6] + [(i + 100, t) for i, t in docs], "doc_id bigint, text string"), "doc_id", "text", bits=bits).collect()))
    five = lambda t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(max(1, len(w) - 4))}
    pairs = [(a, b, len(five(s) & five(t)) / len(five(s) | five(t))) for a, s in near[:6] for b, t in near[:6] if a < b]
    assert [(a, b) for a, b, _ in got] == sorted((a, b) for a, b, j in pairs if j >= 0.8) and len(got) > 3
