"""Rows that share a doc_id with different texts lose nothing; columns of any name pass through."""

import random

import pytest
from brute import cut, leaks, near_roots
from pyspark.sql import functions as F

from orrery.llm import decontaminate, quality, simhash, substring

ODD = "doc_id bigint, text string, `my-col` int, `a.b` int, `a b` string, mark string, `row` int, `key` int"


def odd(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "x", "m", 3, 4) for i, t in rows], ODD)


def words(prefix, n=60):
    return " ".join(f"{prefix}{i}" for i in range(n))


P, Q, R = (words(x) for x in "pqr")
ROWS = [(1, P), (2, P), (2, Q), (3, Q), (3, R), (3, R), (None, P), (None, R), (4, None)]


@pytest.mark.parametrize("drop", [simhash.drop_near_duplicates, simhash.drop_near_copies])
def test_one_row_of_each_group(spark, drop):
    got = drop(odd(spark, ROWS))
    assert got.columns == ["doc_id", "text", "my-col", "a.b", "a b", "mark", "row", "key"]
    rows = [(r[0], r[1]) for r in got.collect()]
    assert sorted(r for r in rows if r[0]) == sorted([(1, P), (2, Q), (3, R), (4, None)], key=str) and sorted(r[1] for r in rows if not r[0]) == sorted([P, R])


def test_repeats_go_from_later_ids_only(spark):
    got = substring.cut_texts(odd(spark, ROWS))
    assert got.columns == ["doc_id", "text", "my-col", "a.b", "a b", "mark", "row", "key"]
    assert sorted(((r[0], r[1]) for r in got.collect()), key=str) == sorted([(1, P), (2, ""), (2, Q), (3, ""), (3, R), (3, R), (None, P), (None, R), (4, None)], key=str)


def test_hits_of_one_text_only(spark):
    bench = spark.createDataFrame([(1, words("p", 12))], "item_id bigint, text string")
    docs = odd(spark, ROWS)
    found = decontaminate.contamination(docs, bench).collect()
    assert sorted(str(r.doc_id) for r in found if r.contaminated) == ["1", "2", "None"] and len(found) == len(ROWS)
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns and sorted(((r[0], r[1]) for r in left.collect()), key=str) == sorted([r for r in ROWS if r[1] != P], key=str)


@pytest.mark.parametrize("bits", [64, 8, 3])
def test_colliding_hashes_change_nothing(spark, bits):
    rng = random.Random(bits)
    text = lambda n: " ".join(f"w{rng.randrange(30)}" for _ in range(n))
    shared = [text(n) for n in (50, 70, 120, 200)]
    rows = [(i, " ".join(rng.choice(shared) if rng.random() < 0.5 else text(rng.randint(1, 40)) for _ in range(4))) for i in range(60)]
    want = cut(rows)
    got = {r.row.doc_id: (r.n_words, r.n_removed, r.text) for r in substring.remove_repeats(odd(spark, rows), bits=bits).collect()}
    assert got == {i: (n, k, b" ".join(w).decode()) for i, (n, k, w) in want.items()} and sum(k for _, k, _ in want.values()) > 1000
    items = [(i, text(rng.randint(1, 14))) for i in range(40)] + [(100 + i, t[:90]) for i, t in enumerate(shared)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = {r[0]: tuple(r[1:]) for r in decontaminate.contamination(odd(spark, rows), bench, bits=bits).collect()}
    assert found == leaks(rows, items)


def test_a_run_that_very_many_documents_share(spark):
    """A frequent passage comes last in the order of runs; all pairs above the line are still found."""
    rng = random.Random(11)
    line = " ".join(f"licence{i}" for i in range(40))
    rows = []
    for i in range(400):
        own = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([5, 60, 120]))]
        rows.append((i, " ".join(own) + " " + line))
    for i in range(40):
        own = rows[i][1].split()
        own[rng.randrange(len(own) - 45 + 5) if len(own) > 60 else 0] = "changed"
        rows.append((1000 + i, " ".join(own)))
    got = {r.doc_id for r in simhash.drop_near_copies(odd(spark, rows)).collect()}
    assert got == near_roots(rows)
    runs, count = simhash.frequent_runs(odd(spark, rows).withColumn("mark", F.lit(0)), 5)
    assert count.max() == 440 and (count == 440).sum() >= 36


def test_good_texts_stay_beside_bad_ones(spark, sf):
    """Rows are judged by their texts: sharing a doc_id, or having none, with a bad text loses nothing."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.scores(docs, labels).join(docs, "doc_id").collect()
    good, bad = ([r for r in found if r.predicted == p] for p in (1, 0))
    assert len(good) > 3 and len(bad) > 3
    rows = [(r.doc_id, r.text) for r in good + bad]
    rows += [(good[0].doc_id, bad[0].text), (bad[1].doc_id, good[1].text), (None, good[2].text), (None, bad[2].text), (None, None)]
    want = {t for _, t in rows} - {r.text for r in bad}
    kept = quality.keep_good(odd(spark, rows), labels)
    assert kept.columns == ["doc_id", "text", "my-col", "a.b", "a b", "mark", "row", "key"]
    got = [(r[0], r[1]) for r in kept.collect()]
    assert (bad[1].doc_id, good[1].text) in got and (None, good[2].text) in got and (good[0].doc_id, bad[0].text) not in got
    assert {t for _, t in got if t is not None} == want - {None}
