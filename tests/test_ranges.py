"""Windows by ranges give the rows of plain windows, and spread one long series over tasks."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.operators import ranges, series, validation

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module", autouse=True)
def always_dealt():
    whole, ranges.WHOLE = ranges.WHOLE, 0
    yield
    ranges.WHOLE = whole


@pytest.fixture(scope="module")
def long(spark):
    """One series of many rows, one of two, one of one, and rows without a series; some closes are null."""
    rng = random.Random(7)
    rows = [("a", i, None if i % 37 == 0 else round(rng.uniform(-5, 5), 3)) for i in range(900)]
    rows += [("b", 0, 1.0), ("b", 5, 2.0), ("c", 3, 4.0)] + [(None, i, float(i)) for i in range(40)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(s, START + timedelta(hours=i), c, i) for s, i, c in rows], "series string, ts timestamp, close double, k int")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    spark.conf.set("spark.sql.shuffle.partitions", old)


def same(a, b):
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    rows = lambda df: sorted((tuple(plain(v) for v in r) for r in df.select(*sorted(df.columns)).collect()), key=str)
    return rows(a) == rows(b)


def test_one_series_lies_in_many_ranges(long):
    dealt = ranges.dealt(long, "series", ["ts"])
    sizes = {r._range: r["count"] for r in dealt.where("series = 'a'").groupBy("_range").count().collect()}
    assert len(sizes) >= 12 and max(sizes.values()) < 200


@pytest.mark.parametrize("before, after", [(0, 1), (3, 0), (170, 5)])
def test_frames(long, before, after):
    w = W.partitionBy("series").orderBy("ts")

    def compute(df, keys):
        v = W.partitionBy(*keys).orderBy("ts").rowsBetween(-before, after)
        return df.withColumns({"n": F.count("*").over(v), "total": F.sum("close").over(v), "top": F.max("k").over(v)})

    got = ranges.framed(ranges.dealt(long, "series", ["ts"]), "series", ["ts"], before, after, compute).drop("_range")
    v = w.rowsBetween(-before, after)
    assert same(got, long.withColumns({"n": F.count("*").over(v), "total": F.sum("close").over(v), "top": F.max("k").over(v)}))


@pytest.mark.parametrize("down", [False, True])
def test_scans(long, down):
    scans = {"s": ("sum", F.col("close")), "hi": ("max", F.col("close")), "lo": ("min", F.col("close")), "seen": ("last", F.col("close"))}
    got = ranges.scanned(ranges.dealt(long, "series", ["ts"]), "series", ["ts"], scans, down).drop("_range")
    w = W.partitionBy("series").orderBy(F.col("ts").desc() if down else F.col("ts")).rowsBetween(W.unboundedPreceding, 0)
    assert same(got, long.withColumns({"s": F.sum("close").over(w), "hi": F.max("close").over(w), "lo": F.min("close").over(w), "seen": F.last("close", ignorenulls=True).over(w)}))


@pytest.mark.parametrize("hours", [1, 6, 300])
def test_frames_of_time(long, hours):
    def compute(df, keys):
        return df.withColumn("n", F.sum("k").over(W.partitionBy(*keys).orderBy("sec").rangeBetween(-(hours * 3600 - 1), 0)))

    timed = ranges.dealt(long, "series", ["ts"]).withColumn("sec", F.unix_seconds(F.col("ts").cast("timestamp")))
    got = ranges.within_time(timed, "series", "sec", hours * 3600, compute)
    assert same(got.drop("_range"), compute(timed.drop("_range"), ["series"]))


def test_series_features_of_a_long_series(long):
    w = W.partitionBy("series").orderBy("ts")
    v = w.rowsBetween(-23, 0)
    plain = long.withColumn("i", F.row_number().over(w).cast("double")).select("series", "ts", F.stddev_samp("close").over(v).alias("sd"), F.regr_slope("close", "i").over(v).alias("slope"))
    assert same(series.rolling(long, 24, 3600).select("series", "ts", "sd", "slope"), plain)
    flags = long.select("series", "ts", F.when(F.col("close") > 0, "up").when(F.col("close") <= 0, "down").alias("label"))
    new = F.when(F.col("label").eqNullSafe(F.lag("label").over(w)) & F.lag("ts").over(w).isNotNull(), 0).otherwise(1)
    runs = flags.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.groupBy("series", "run", "label").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"))
    assert same(series.regime_runs(flags, "label"), runs)


def test_asof_with_one_hot_key(long):
    left = long.where("series = 'a'").select("series", F.col("ts").alias("ts"), "k")
    right = long.where("series = 'a' and k % 50 = 3").select("series", "ts", F.col("k").cast("string").alias("v"))
    got = {r.k: r.v for r in series.asof(left, right, "series", "ts", "v").collect()}
    assert got == {k: (str((k - 3) // 50 * 50 + 3) if k >= 3 else None) for k in range(900)}


def test_adjusted_p_of_a_large_family(long):
    rng = random.Random(3)
    p = {i: rng.choice([None, 0.5, round(rng.random() ** 3, 4)]) for i in range(500)}
    df = long.sparkSession.createDataFrame([("f", i, v) for i, v in p.items()] + [("g", 900, 0.04)], "family string, id int, p double")
    known = sorted((v, i) for i, v in p.items() if v is not None)
    want, least = {i: None for i in p}, 1.0
    for place in range(len(known), 0, -1):
        v, i = known[place - 1]
        least = min(least, v * len(known) / place)
        want[i] = round(least, 9)
    got = {r.id: r.p_adjusted and round(r.p_adjusted, 9) for r in validation.bh_adjust(df, "family", "id").collect()}
    assert got.pop(900) == 0.04 and got == want


def test_small_tables_are_not_dealt(long, monkeypatch):
    w = W.partitionBy("series").orderBy("ts")
    dealt = series.regime_runs(long.withColumn("label", F.signum("close")), "label")
    monkeypatch.setattr(ranges, "WHOLE", 10_000)
    assert "_range" not in ranges.dealt(long, "series", ["ts"]).columns
    assert same(series.regime_runs(long.withColumn("label", F.signum("close")), "label"), dealt)
    assert same(series.rolling(long, 5, 7200).select("series", "ts", "low"), long.select("series", "ts", F.min("close").over(w.rowsBetween(-4, 0)).alias("low")))
