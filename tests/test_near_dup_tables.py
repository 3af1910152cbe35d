"""Near-copy search writes no table with a row for every run of words."""

from pyspark.sql import functions as F

from orrery.operators import products


def test_no_written_table_has_all_runs(spark, monkeypatch):
    written, kept = {}, products.kept
    monkeypatch.setattr(products, "kept", lambda df, name: written.setdefault(name, kept(df, name)))
    own = [" ".join(f"w{i}x{j}" for j in range(200)) for i in range(20)]
    near = [t + " end" for t in own[:3]]
    df = spark.createDataFrame(list(enumerate(own + near)), "id long, text string").repartition(3)
    got = sorted((r.a, r.b) for r in products.near_dup_pairs(df, "id", "text").collect())
    assert got == [(0, 20), (1, 21), (2, 22)]
    assert sum(x.agg(F.count("*")).first()[0] for x in written.values()) < 2000
