"""Items of fewer words than a run are found inside longer documents."""

from orrery.operators import validation as V


def test_short_items_in_long_documents(spark):
    docs = [(1, "one two three four five six seven eight"), (2, "Two, three!"), (3, "three two"), (4, ""), (5, "x " * 50 + "two three"), (6, "twothree four five six seven")]
    items = [(10, "two three"), (11, "three"), (12, "two three four"), (13, "two three four five"), (14, "two three four five six"), (15, "three four five six seven eight"), (16, "")]
    found = V.contains_leak(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")).collect()
    assert sorted((r.item_id, r.doc_id) for r in found) == [(10, 1), (10, 2), (10, 5), (11, 1), (11, 2), (11, 3), (11, 5), (12, 1), (13, 1), (14, 1), (15, 1)]
    none = V.contains_leak(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([], "item_id int, text string"))
    assert none.count() == 0
