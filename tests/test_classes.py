"""Classes of equal rows in joins and searches: small results for many copies, and no link lost."""

import pytest

from orrery.operators import products

PREFS = "pref_id long, name string, brand string, max_price_e4 long"


@pytest.fixture
def tables(spark):
    prefs = [(i, "hat", None, 50) for i in (4, 2, 9)] + [(5, "hat", "B", None), (7, None, None, 10), (8, None, None, 10), (6, "cap", None, 1)]
    parts = [(1, "hat", "B"), (2, "hat", "C"), (3, "cap", "B")]
    offers = [(1, 60, "2024-01-03"), (1, 40, "2024-01-02"), (2, 5, "2024-01-01"), (3, 9, "2024-01-05")]
    offers = spark.createDataFrame(offers, "product_id long, unit_price_e4 long, day string").selectExpr("product_id", "unit_price_e4", "cast(day as date) as observed_at")
    return spark.createDataFrame(prefs, PREFS), spark.createDataFrame(parts, "product_id long, name string, brand string"), offers


def test_search_by_classes_expands_to_all_matches(tables):
    prefs, parts, offers = tables
    rows = products.search_classes(prefs, parts, offers).collect()
    assert sorted((r.pref_id, r.class_id) for r in rows if r.pref_id != r.class_id) == [(4, 2), (8, 7), (9, 2)]
    members = {r.pref_id: r.class_id for r in rows}
    found = [(p, r.product_id, r.unit_price_e4) for p, c in members.items() for r in rows if r.pref_id == r.class_id == c]
    assert sorted(found) == sorted((r.pref_id, r.product_id, r.unit_price_e4) for r in products.search(prefs, parts, offers).collect())


def test_ranks_of_classes_are_those_of_all_preferences(tables):
    prefs, parts, offers = tables
    weights = {"price": 0.5, "recency": 0.3, "matches": 0.2}
    twice = prefs.union(prefs.where("pref_id = 5")).union(prefs.sparkSession.createDataFrame([(9, "cap", None, None)], PREFS))
    for asked in (prefs, twice):
        want = products.rank_matches(products.search(asked, parts, offers), weights, 2)
        assert sorted(products.rank_searches(asked, parts, offers, weights, 2).select(want.columns).collect()) == sorted(want.collect())


def test_fuzzy_classes_are_as_many_as_rows(spark):
    rows = [(i, "b", ("red ring", "red rung", "old hat")[i % 3]) for i in range(300)] + [(900, "c", "red ring"), (901, "b", None), (902, None, "red ring")]
    got = sorted(tuple(r) for r in products.fuzzy_classes(spark.createDataFrame(rows, "id long, block string, t string"), "block", "t", 4).collect())
    assert got == sorted([(0, 1, 1)] + [(i % 3, i, 0) for i in range(3, 300)])
