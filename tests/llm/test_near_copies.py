"""The pipeline's near-copy stage against the exact Jaccard of planted pairs."""

import random

import corpus_pipeline
from brute import frame


def five_runs(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_near_copies_from_four_fifths_on(spark, sf):
    rng = random.Random(7)
    rows, gone = [(900, None), (901, ""), (902, "one two"), (903, "one two")], {901, 903}
    for n in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 400))]
        copy, last = list(base), list(base)
        aim = 0.8 + 0.15 * n / 60 if n % 3 else 0.7  # a third lies below the line
        while jaccard(five_runs(" ".join(base)), five_runs(" ".join(copy))) >= aim:
            last = list(copy)
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        copy = copy if aim < 0.8 else last
        rows += [(2 * n, " ".join(base)), (2 * n + 1, " ".join(copy))]
        if jaccard(five_runs(rows[-2][1]), five_runs(rows[-1][1])) >= 0.8:
            gone.add(2 * n + 1)
    base = [f"h{i}" for i in range(200)]
    for i in range(300):  # a large group of near copies
        text = list(base)
        text[rng.randrange(200)] = f"y{i}"
        rows.append((1000 + i, " ".join(text)))
    gone |= {1000 + i for i in range(1, 300)}
    kept = {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, frame(spark, rows), sf).collect()}
    assert len(gone) > 340 and kept == {i for i, _ in rows} - gone
