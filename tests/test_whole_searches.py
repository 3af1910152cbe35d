"""Searches and fuzzy matches give every match of every row, and their joins shuffle no pairs."""

from itertools import product

from orrery.operators import products
from orrery.plans import catalog


def brute(prefs, parts, offers):
    out = []
    for (pref, name, brand, cap), (part, *own), (of, price) in product(prefs, parts, offers):
        if part == of and all(a is None or a == b for a, b in zip((name, brand), own, strict=True)) and (cap is None or (price is not None and price <= cap)):
            out.append((pref, of, -1 if price is None else price))
    return sorted(out)


def test_search_finds_all_for_missing_slots_and_repeated_rows(spark):
    slots = list(product(("hat", "cap", None), ("B", "C", None), (0, 7, 50, None)))
    prefs = [(i % 30, *s) for i, s in enumerate(slots)]  # six ids have two rows
    parts = [(1, "hat", "B"), (2, "hat", "C"), (3, "cap", None), (4, None, "B"), (5, None, None), (1, "hat", "B"), (2, "cap", "C"), (6, "wig", "D")]
    offers = [(i % 7, p) for i, p in enumerate((0, 1, 2, 7, 8, 9, 49, 50, 51, 63, 64, 1 << 40, None, -3) * 4)]
    asked, catalog_, offered = spark.createDataFrame(prefs, "pref_id long, name string, brand string, max_price_e4 long"), spark.createDataFrame(parts, "product_id long, name string, brand string"), spark.createDataFrame(offers, "product_id long, unit_price_e4 long")
    got = sorted((r.pref_id, r.product_id, -1 if r.unit_price_e4 is None else r.unit_price_e4) for r in products.search(asked, catalog_, offered).collect())
    assert got == brute(prefs, parts, offers)


def test_search_query_asks_for_all_preferences(spark, sf):
    found = {r.pref_id for r in catalog.queries()["p2_search"](spark, sf).select("pref_id").distinct().collect()}
    customers, parts = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("customer", "part"))
    assert found == {r.c_custkey for r in customers.join(parts, customers.c_custkey == parts.p_partkey).collect()}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(last + (x != y), row[j] + 1, row[j + 1] + 1)
    return row[-1]


def test_fuzzy_pairs_of_large_classes_are_whole(spark, monkeypatch):
    monkeypatch.setattr(products, "SIDE", 4)
    texts = ("red ring", "red rung", "old hat", "", None, "rd ringg")
    rows = [(i, ("b", "c", None)[i % 3], texts[i * i % 7 % 6]) for i in range(90)] + [(5, "b", "red ring"), (5, "b", "red rung"), (None, "b", "red ring")]
    got = sorted(tuple(r) for r in products.fuzzy_pairs(spark.createDataFrame(rows, "id long, block string, t string"), "block", "t", 4).collect())
    want = [(i, j, edits(s, t)) for i, b, s in rows for j, c, t in rows if None not in (i, j, b, s, t) and b == c and i < j]
    assert got == sorted(p for p in want if p[2] <= 4)


def test_fuzzy_query_pairs_copies(spark, tmp_path):
    spark.createDataFrame([(i, "red ring", "Brand#1") for i in range(4)], "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(tuple(r) for r in catalog.queries()["p12_fuzzy_match"](spark, str(tmp_path)).collect())
    assert got == [(a, b, 0) for a in range(4) for b in range(a + 1, 4)]


def test_few_rows_with_many_pairs_are_many_tasks(spark):
    rows = spark.range(2000).selectExpr("id", "'b' as block", "'red ring' as t")
    found = products.fuzzy_pairs(rows, "block", "t", 4)
    assert found.count() == 2000 * 1999 // 2
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


WEIGHTS = {"price": 0.5, "recency": 0.3, "matches": 0.2}


def ranking_tables(spark, caps, n_parts=60, n_offers=900):
    names, brands = ("hat", "cap", None), ("B", "C", None)
    prefs = [(i, names[i % 3], brands[i // 3 % 3], caps[i % len(caps)]) for i in range(200)] + [(7, "cap", None, 3), (3, "wig", None, 5)]
    parts = [(i, names[i * i % 5 % 3], brands[i % 7 % 3]) for i in range(n_parts)] + [(4, "hat", "B"), (4, "hat", "B")]
    offers = [(i * 7 % (n_parts + 3), None if i % 90 == 0 else i * i % 131 - 2, f"2024-01-{1 + i * i % 29:02}") for i in range(n_offers)]
    offers = spark.createDataFrame(offers, "product_id long, unit_price_e4 long, day string").selectExpr("product_id", "unit_price_e4", "cast(day as date) as observed_at")
    return spark.createDataFrame(prefs, "pref_id long, name string, brand string, max_price_e4 long"), spark.createDataFrame(parts, "product_id long, name string, brand string"), offers


def test_ranks_by_steps_of_the_price_are_those_of_all_matches(spark):
    for caps in ((40, 0, 40, 100, 77, 3, -1), (50, None, 5, 129)):
        prefs, parts, offers = ranking_tables(spark, caps)
        want = products.rank_matches(products.search(prefs, parts, offers), WEIGHTS, 3)
        assert sorted(products.rank_searches(prefs, parts, offers, WEIGHTS, 3).select(want.columns).collect()) == sorted(want.collect())


def test_ranking_shuffles_no_pairs_of_preferences_and_products(spark):
    """800 products and 400 highest prices of one name make 320,000 pairs; no shuffle has many rows."""
    prefs = spark.range(400).selectExpr("id as pref_id", "'hat' as name", "cast(null as string) as brand", "id + 1000 as max_price_e4")
    parts = spark.range(800).selectExpr("id as product_id", "'hat' as name", "'B' as brand")
    offers = spark.range(1600).selectExpr("id div 2 as product_id", "id * 37 % 900 as unit_price_e4", "date_add(date '2024-01-01', cast(id % 300 as int)) as observed_at")
    context = spark.sparkContext
    store, lists, none = context._jsc.sc().statusStore(), context._jvm.java.util.ArrayList, context._gateway.new_array(context._jvm.double, 0)
    written = lambda: sum(s.shuffleWriteRecords() for s in (lambda x: [x.apply(i) for i in range(x.size())])(store.stageList(lists(), False, False, none, lists())))
    before = written()
    assert products.rank_searches(prefs, parts, offers, WEIGHTS, 5).count() == 2000
    assert written() - before < 60_000
