"""Sets that are alike, but not enough, don't meet in pairs; those that are alike enough all do."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from orrery.llm import simhash


def met(spark, sets, least=0.8):
    rows = [(i, len(s), sorted(s)[: len(s) - math.ceil(least * len(s) - 1e-6) + 1]) for i, s in enumerate(sets)]
    groups = simhash.bundled(spark.createDataFrame(rows, "id long, size int, prefix array<bigint>")).withColumn("root", F.col("id"))
    return [(r.id, r.other) for r in simhash.meetings(groups, least).collect()]


def test_a_family_below_the_line_makes_no_pairs(spark):
    family = [{*range(i * 1000, i * 1000 + 20), *range(10**6, 10**6 + 80)} for i in range(60)]
    assert met(spark, family) == []


def test_all_pairs_from_the_line_on_meet(spark):
    rng = random.Random(3)
    base, sets = rng.sample(range(10**6), 60), []
    for _ in range(120):
        own = set(base[: rng.randint(40, 60)])
        sets.append(own - set(rng.sample(sorted(own), rng.randint(0, 6))) | {rng.randrange(10**6) for _ in range(rng.randint(0, 8))})
    alike = {(a, b) for a in range(120) for b in range(a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert len(alike) > 300 and alike <= {(max(p), min(p)) for p in met(spark, sets)}


def sketched(spark, sets, least=0.8):
    rows = [(i, len(s), sorted(s)[: len(s) - math.ceil(least * len(s) - 1e-6) + 1]) for i, s in enumerate(sets)]
    groups = simhash.bundled(spark.createDataFrame(rows, "id long, size int, prefix array<bigint>")).withColumn("root", F.col("id"))
    marks = [(i, simhash.sketch(np.array(sorted(s), np.int64).view(np.uint64)).tolist()) for i, s in enumerate(sets)]
    return {(r.id, r.other) for r in simhash.meetings(groups, least, spark.createDataFrame(marks, "id long, sketch array<bigint>")).collect()}


def copies(seed, count, size, lost):
    """A family whose members each lack some of its runs and have as many of their own."""
    rng = random.Random(seed)
    run = lambda: rng.randrange(-(2**63), 2**63)
    base = [run() for _ in range(size)]
    return [{*base} - {*rng.sample(base, k)} | {run() for _ in range(k)} for k in (rng.randint(*lost) for _ in range(count))]


def test_members_that_lack_other_runs_of_a_family_make_no_pairs(spark):
    family = copies(5, 60, 400, (44, 60))
    assert all(len(a & b) / len(a | b) < 0.8 for i, a in enumerate(family) for b in family[:i])
    assert len({*met(spark, family)}) > 200 and len(sketched(spark, family)) < 20


def test_sketches_lose_no_pair(spark):
    sets = copies(6, 60, 400, (10, 30)) + copies(7, 40, 60, (0, 5)) + copies(8, 40, 2000, (80, 130))
    alike = {frozenset((i, j)) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(a & b) / len(a | b) >= 0.8}
    assert len(alike) > 1000 and alike <= {frozenset(p) for p in sketched(spark, sets)}
