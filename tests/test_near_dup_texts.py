"""Near-copy search deals the texts to tasks, and normalizes them, once."""

from orrery.operators import products


def test_texts_are_dealt_once(spark, monkeypatch):
    plans, kept = [], products.kept
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(products, "kept", lambda df, name: plans.append(plan(df)) or kept(df, name))
    monkeypatch.setattr(products, "spread", lambda df: df.repartition(2))  # whatever Spark's estimate of the size
    texts = [" ".join(f"w{i}x{j}" for j in range(50)) for i in range(5)]
    df = spark.createDataFrame(list(enumerate(texts + [texts[0] + " end"])), "id long, text string")
    found = products.near_dup_pairs(df, "id", "text")
    assert [(r.a, r.b) for r in found.collect()] == [(0, 5)]
    assert sum("Repartition" in p for p in [*plans, plan(found)]) == 1
