"""Hand-made cases: gaps, ties, nulls, empty tables, and the future that must not matter."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from orrery.functions.columns import norm_text, norm_url, shingle_set
from orrery.operators import checks, graph, learner, products, ranks, retrieval, series, validation
from orrery.sources import tables


def at(hour, minute=0, day=1):
    return dt.datetime(2024, 1, day, hour, minute)


def test_slots(spark):
    df = spark.createDataFrame([(1, "looking for a red hat by Brand#12 under 30"), (2, "under 7"), (3, "nothing"), (4, None), (5, "under 99999999999999999999999")], "pref_id long, text string")
    got = {r.pref_id: (r.name, r.brand, r.max_price_e4) for r in products.extract_slots(df, "text").collect()}
    assert got == {1: ("red hat", "Brand#12", 300000), 2: (None, None, 70000), 3: (None, None, None), 4: (None, None, None), 5: (None, None, None)}


def test_search_with_missing_slots(spark):
    prefs = spark.createDataFrame([(1, "hat", "B", 50), (2, "hat", None, None), (3, None, "B", None), (4, None, None, 10)], "pref_id long, name string, brand string, max_price_e4 long")
    parts = spark.createDataFrame([(1, "hat", "B"), (2, "hat", "C"), (3, "cap", "B")], "product_id long, name string, brand string")
    offers = spark.createDataFrame([(1, 60), (1, 40), (2, 5), (3, 9)], "product_id long, unit_price_e4 long")
    got = sorted((r.pref_id, r.product_id, r.unit_price_e4) for r in products.search(prefs, parts, offers).collect())
    assert got == [(1, 1, 40), (2, 1, 40), (2, 1, 60), (2, 2, 5), (3, 1, 40), (3, 1, 60), (3, 3, 9), (4, 2, 5), (4, 3, 9)]


def test_text_and_url(spark):
    df = spark.createDataFrame([("  Ünï--Code, 12! ", "http://m.a.org/x/?ref=x#top"), ("!!", "https://www.a.org/?p=1&ref=x&utm_source=f"), (None, None)], "t string, u string")
    got = [tuple(r) for r in df.select(norm_text(F.col("t")), norm_url(F.col("u"))).collect()]
    assert got == [("ünï code 12", "https://a.org/x"), ("", "https://a.org/?p=1"), (None, None)]


def test_shingle_set_sizes(spark):
    df = spark.createDataFrame([("",), ("a b",), ("a b c d",), ("a b a b a b",)], "t string")
    assert [len(r[0]) for r in df.select(shingle_set(F.col("t"), 3)).collect()] == [0, 1, 2, 2]


def test_near_duplicates_and_clusters(spark):
    words = [f"w{i}" for i in range(60)]
    texts = {1: " ".join(words), 2: " ".join(words), 3: " ".join(words[:58]), 4: " ".join(words[2:58]), 5: "quite another text of a few words", 6: "", 7: None}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    pairs = products.near_dup_pairs(df, "id", "text")
    got = {(r.a, r.b) for r in pairs.collect()}
    assert got == {(1, 2), (1, 3), (1, 4), (3, 4)}
    clusters = {r.id: r.cluster for r in products.dup_clusters(pairs).collect()}
    assert clusters == {1: 1, 2: 1, 3: 1, 4: 1}


@pytest.mark.parametrize("many", [1, 1_000_000])
def test_components_of_chain_star_and_nothing(spark, monkeypatch, many):
    monkeypatch.setattr(graph, "MANY", many)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(8, 40)]
    df = spark.createDataFrame([*chain, *star, (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in graph.connected_components(df).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in range(7, 40)}
    assert graph.connected_components(df.where("a < 0")).count() == 0


def test_dedup_exact_with_nulls(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None)], "id long, k string")
    assert sorted((r.id, r.group_size) for r in products.dedup_exact(df, ["k"], ["id"]).collect()) == [(1, 2), (3, 2)]


def test_upsert_is_idempotent(spark):
    schema = "k long, v string, ts timestamp"
    old = spark.createDataFrame([(1, "a", at(1)), (2, "b", at(5)), (3, "c", at(1))], schema)
    new = spark.createDataFrame([(1, "A", at(2)), (2, "B", at(4)), (3, "C", at(1)), (4, "D", at(1))], schema)
    once = tables.upsert(old, new, ["k"], "ts")
    rows = sorted((r.k, r.v) for r in once.collect())
    assert rows == [(1, "A"), (2, "b"), (3, "C"), (4, "D")]
    assert sorted((r.k, r.v) for r in tables.upsert(once, new, ["k"], "ts").collect()) == rows


def test_jdbc_options(spark):
    options = tables.jdbc_options("jdbc:postgresql://host/db", "supplier", "org.postgresql.Driver")
    assert options["dbtable"] == "supplier" and options["driver"] == "org.postgresql.Driver"
    url, driver = "jdbc:derby:memory:orrery;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    tables.to_jdbc(df, url, "numbers", 2, driver).save()
    back = tables.from_jdbc(spark, url, "numbers", "id", 0, 100, 4, driver).load()
    assert back.rdd.getNumPartitions() == 4
    assert back.agg(F.sum("v")).first()[0] == 9900


def test_gap_fill(spark):
    bars = spark.createDataFrame([("a", at(1), 1.0, 2), ("a", at(4), 4.0, 1), ("b", at(2), 9.0, 1)], "series string, ts timestamp_ntz, close double, n long")
    got = sorted((r.series, r.ts.hour, r.close, r.n) for r in series.gap_fill(bars, "1 hour").collect())
    assert got == [("a", 1, 1.0, 2), ("a", 2, 1.0, 0), ("a", 3, 1.0, 0), ("a", 4, 4.0, 1), ("b", 2, 9.0, 1)]


def test_asof_edges(spark):
    left = spark.createDataFrame([(1, "k", at(0)), (2, "k", at(2)), (3, "k", at(3)), (4, "k", at(20)), (5, "z", at(2))], "id long, k string, ts timestamp_ntz")
    right = spark.createDataFrame([("k", at(2), 5.0), ("k", at(3), None)], "k string, ts timestamp_ntz, v double")
    got = {r.id: (r.right_ts and r.right_ts.hour, r.v) for r in series.asof(left, right, "k", "ts", "v", "4 hours").collect()}
    assert got == {1: (None, None), 2: (2, 5.0), 3: (3, None), 4: (None, None), 5: (None, None)}


def test_future_does_not_matter(spark, sf):
    from orrery.plans.series import hours

    full = hours(spark, sf)
    cut = full.where("ts < '2024-01-25'")
    for make in (lambda d: series.regimes(d), lambda d: series.rolling(d, 24, 3600), lambda d: series.context_windows(d, 12, 0)):
        a = sorted(map(str, make(full).where("ts < '2024-01-25'").collect()))
        assert a == sorted(map(str, make(cut).collect())) and a


def test_metrics_of_perfect_and_zero(spark):
    df = spark.createDataFrame([("m", 0.0, 0.0), ("m", 2.0, 2.0), ("z", 0.0, 1.0)], "model string, y double, yhat double")
    got = {r.model: r for r in series.forecast_metrics(df, ["model"]).collect()}
    assert (got["m"].mae, got["m"].smape, got["m"].mape, got["m"].hit_rate) == (0, 0, 0, 1)
    assert got["z"].mape is None and got["z"].smape == 2


def test_alert_cool_down(spark):
    ticks = [(1, at(0), 70.0), (2, at(1), 10.0), (3, at(2), 80.0), (4, at(3), 10.0), (5, at(7), 90.0), (6, at(8), 10.0), (7, at(8), 95.0)]
    df = spark.createDataFrame([("s", t, i, p) for i, t, p in ticks], "series string, ts timestamp_ntz, id long, price double")
    got = sorted(r.id for r in series.price_alerts(df, 60.0, 1e9, 3, 5 * 3600).collect())
    assert got == [3, 5]


def test_families_never_split(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = validation.family_holdout(docs, "source", 0.3, "x")
    assert out.groupBy("source").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    null = validation.group_kfold(spark.createDataFrame([(None,), (None,)], "f string"), "f", 3, "s")
    assert null.select("fold").distinct().count() == 1


def test_walk_forward_folds_partition_rows(spark):
    df = spark.createDataFrame([("a", at(i % 24, day=1 + i // 24), float(i)) for i in range(60)], "series string, ts timestamp_ntz, close double")
    rows = series.walk_forward(df, 20, 10, 15, 5, 3).collect()
    want = {(o, i, "train") for o in (20, 30, 40, 50) for i in range(o - 15, o - 3)} | {(o, i, "test") for o in (20, 30, 40, 50) for i in range(o, o + 5)}
    assert {(r.origin, r.i, r.part) for r in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize("scores,labels,want", [([1, 1, 1, 1], [0, 1, 0, 1], 0.5), ([1, 2, 3, 4], [0, 0, 1, 1], 1.0), ([4, 3, 2, 1], [0, 0, 1, 1], 0.0), ([1, 2], [1, 1], None)])
def test_auc_ties_and_one_class(spark, scores, labels, want):
    df = spark.createDataFrame([(float(s), y) for s, y in zip(scores, labels, strict=True)], "s double, y int")
    assert validation.auc(df, "s", "y").first().auc == want


def test_verdicts(spark):
    df = spark.createDataFrame([(-1.0, 1.0), (2.0, 5.0), (-9.0, -4.0), (-3.0, 9.0)], "lo double, hi double")
    assert [r.verdict for r in validation.verdict(df, 1.5).collect()] == ["equivalent", "supported", "refuted", "inconclusive"]


def test_bh_with_ties_and_ends(spark):
    df = spark.createDataFrame([("f", 1, 0.0), ("f", 2, 0.04), ("f", 3, 0.04), ("f", 4, 1.0)], "family string, id long, p double")
    got = {r.id: round(r.p_adjusted, 6) for r in validation.bh_adjust(df, "family", "id").collect()}
    assert got == {1: 0.0, 2: 0.053333, 3: 0.053333, 4: 1.0}


def test_pack_context_budget(spark):
    hits = spark.createDataFrame([(1, 1, "a", 5), (1, 2, "b", 5), (1, 3, "c", 1), (2, 1, "d", 99)], "query_id long, rank int, text string, words int")
    got = [(r.query_id, r.n, r.context) for r in retrieval.pack_context(hits, 10).collect()]
    assert got == [(1, 2, "a\nb")]


def test_session_gap_edge(spark):
    df = spark.createDataFrame([(1, at(0), 1.0), (1, at(3, 59), 1.0), (1, at(7, 59), 1.0), (1, at(12), 1.0)], "user_id long, ts timestamp_ntz, value double")
    assert sorted(r.n for r in learner.sessions(df, "4 hours").collect()) == [1, 3]


def test_vector_lists_recall_and_blocks(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    queries = vectors.where("vec_id % 20 = 0")
    exact = retrieval.vector_topk(queries, vectors, 10)
    assert sorted(map(tuple, exact.collect())) == sorted(map(tuple, retrieval.vector_topk(queries, vectors, 10, rows=90, held=7).collect()))
    found = retrieval.vector_topk_lists(queries, vectors, 10)
    assert retrieval.recall(found, exact).first().recall >= 0.9


def test_checks(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 50, "z"), (None, 5, "a"), (2, None, None)], "k long, x int, s string")
    rules = [checks.not_null("k"), checks.between("x", 0, 10), checks.allowed("s", ["a"])]
    got = {r.rule: r.failed for r in checks.check(df, rules, [["k"]]).collect()}
    assert got == {"not_null(k)": 1, "between(x)": 1, "allowed(s)": 1, "unique(k)": 2}
    good, bad = checks.quarantine(df, rules)
    assert good.count() == 2 and sorted(len(r.reasons) for r in bad.collect()) == [1, 2]
    diff = checks.diff(df.where("k = 1 and x = 5").drop("s"), spark.createDataFrame([(1, 6), (9, None)], "k long, x int"), ["k"])
    assert sorted((r.k, r.change) for r in diff.collect()) == [(1, "changed"), (9, "added")]


def test_vector_lists_score_half_of_the_pairs(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    queries = vectors.where("vec_id % 20 = 0")
    found = retrieval.vector_topk_lists(queries, vectors, 10)
    assert retrieval.recall(found, retrieval.vector_topk(queries, vectors, 10)).first().recall >= 0.9
    found = retrieval.index_quality(queries, vectors, 10).first()
    assert found.recall >= 0.9 and found.code_share < 0.55 and found.whole_share < 0.25


def test_alerts_over_many_ranges(spark):
    rng = random.Random(4)
    ticks = [("ab"[rng.randrange(2)] if i % 7 else "c", at(0) + dt.timedelta(minutes=rng.randrange(3000)), i, float(rng.randrange(100))) for i in range(600)]
    df = spark.createDataFrame(ticks, "series string, ts timestamp_ntz, id long, price double")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = sorted((r.series, r.rule, r.id) for r in series.price_alerts(df, 60.0, 2.0, 3, 3600).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = []
    for s in "abc":
        own, last = sorted((t, i, p) for x, t, i, p in ticks if x == s), {}
        for k, (t, i, p) in enumerate(own):
            rules = [("cross", k > 0 and own[k - 1][2] < 60 <= p), ("move", k > 2 and own[k - 3][2] != 0 and abs((p - own[k - 3][2]) / own[k - 3][2]) >= 2)]
            for rule, hit in rules:
                if hit and (rule not in last or t - last[rule] >= dt.timedelta(hours=1)):
                    last[rule] = t
                    want.append((s, rule, i))
    assert got == sorted(want) and len(want) > 30


def test_quantiles_and_running_counts(spark):
    import numpy as np

    rng = random.Random(2)
    values = [("x", float(rng.randrange(40))) for _ in range(500)] + [("y", 3.0)] + [("z", None), ("z", 1.0), ("z", 2.0)]
    df = spark.createDataFrame(values, "name string, value double")
    counts = df.groupBy("name", "value").agg(F.count("*").alias("n"))
    got = {r.name: r.q for r in ranks.quantiles(counts, "name", "value", "n", [0.0, 0.1, 0.33, 0.5, 1.0]).collect()}
    for name in "xyz":
        own = [v for k, v in values if k == name and v is not None]
        assert got[name] == pytest.approx(np.quantile(own, [0.0, 0.1, 0.33, 0.5, 1.0]))


def test_pooled_forecaster_equals_least_squares(spark):
    import numpy as np

    rng = random.Random(6)
    close = {s: [10 + 5 * rng.random() + (i % 6) for i in range(90)] for s in "ab"}
    df = spark.createDataFrame([(s, at(i % 24, day=1 + i // 24), x[i]) for s, x in close.items() for i in range(90)], "series string, ts timestamp_ntz, close double")
    got = {(r.series, r.origin, r.ts): r.yhat for r in series.fit_pooled(df, 4, 40, 20, 30, 5, 3).collect()}
    n = 0
    for o in (40, 60, 80):
        rows = [(x[i - 4 : i] + [1.0], x[i]) for x in close.values() for i in range(o - 30, o - 3) if i - 4 >= o - 30]
        a, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        damp = 1e-3 * np.eye(5)
        damp[4, 4] = 0
        w = np.linalg.solve(a.T @ a + damp, a.T @ y)
        for s, x in close.items():
            for i in range(o, min(90, o + 5)):
                assert got[s, o, at(i % 24, day=1 + i // 24)] == pytest.approx(np.dot(x[i - 4 : i] + [1.0], w))
                n += 1
    assert n == len(got) == 30


def test_near_texts_find_all_within_k_edits(spark):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(out[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        return out

    rng = random.Random(9)
    names = {"", "a", "ab"} | {"".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(90)}
    df = spark.createDataFrame([(i, "k" if i % 2 else "m", t) for i, t in enumerate(sorted(names) * 2)] + [(999, "k", None)], "id long, block string, t string")
    rows = [(r.id, r.block, r.t) for r in df.collect() if r.t is not None]
    for k in (1, 3):
        want = {(a, b, edits(x, y)) for a, p, x in rows for b, q, y in rows if a < b and p == q and edits(x, y) <= k}
        got = [(r.a_id, r.b_id, r.edits) for r in products.fuzzy_pairs(df, "block", "t", k).collect()]
        assert set(got) == want and len(got) == len(want)


def test_near_dup_pairs_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", F.array_sort(shingle_set(norm_text(F.col("text")), 5)).alias("s")).collect()
    groups = {}
    for r in rows:
        if r.s:
            groups.setdefault(tuple(r.s), []).append(r.doc_id)
    reps = [(min(v), set(k)) for k, v in groups.items()]
    want = {(min(v), i) for v in groups.values() for i in v if i != min(v)}
    want |= {(min(a, b), max(a, b)) for a, x in reps for b, y in reps if a < b and len(x & y) >= 0.8 * len(x | y)}
    assert {(r.a, r.b) for r in products.near_dup_pairs(docs, "doc_id", "text").collect()} == want and want


def test_permutation_of_one_label_and_null(spark):
    df = spark.createDataFrame([(i, 0, float(i), "s") for i in range(5)], "id long, y int, v double, s string")
    got = validation.permutation_test(df, "id", "y", "v", "s", 7, "p").first()
    assert (got.effect, got.reps) == (None, 7)


def test_replay_of_several_files_a_batch(spark, sf, monkeypatch):
    from orrery.plans import streams

    monkeypatch.setattr(streams, "FILE_ROWS", 130)
    monkeypatch.setattr(streams, "BATCH_ROWS", 300)
    rows = streams.t25(spark, sf)
    assert rows.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    from types import SimpleNamespace as Plain

    from orrery.sources.shared import shared_dir

    session = Plain(conf=Plain(get=lambda *a: None), sparkContext=Plain(getCheckpointDir=lambda: None, master=master))
    with pytest.raises(RuntimeError):
        shared_dir(session)
