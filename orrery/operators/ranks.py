"""Running counts and quantiles over a whole table, without a task or buffer that holds all values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.sources.shared import kept


def running_counts(counts: DataFrame, by: str, value: str, sums: list[str]) -> DataFrame:
    """`counts(by, value, sums...)`, a row per distinct value -> the same with `<sum>_upto`, the sum
    over all values of the group up to this one. Rows are dealt by ranges of (by, value) and summed
    within a range; the ranges' own sums, a row each, give what lies before."""
    ranges = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = counts.repartitionByRange(ranges, by, value).withColumn("_range", F.spark_partition_id())
    dealt = kept(dealt, "ranges")  # ranges come from a sample, so they are drawn once
    own = W.partitionBy(by, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = dealt.groupBy(by, "_range").agg(*[F.sum(s).alias(s) for s in sums])
    base = totals.select(by, "_range", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_{s}") for s in sums])
    run = dealt.withColumns({f"{s}_upto": F.sum(s).over(own) for s in sums}).join(base, [by, "_range"])
    return run.withColumns({f"{s}_upto": F.col(f"{s}_upto") + F.col(f"_{s}") for s in sums}).drop("_range", *[f"_{s}" for s in sums])


def quantiles(counts: DataFrame, by: str, value: str, n: str, shares: list[float]) -> DataFrame:
    """`counts(by, value, n)`, a row per distinct value -> `(by, q ARRAY<DOUBLE>)`: exact quantiles
    with linear interpolation between neighbours, one for each of `shares`. Null values are left out."""
    run = running_counts(counts.where(F.col(value).isNotNull()), by, value, [n])
    total = run.groupBy(by).agg(F.max(f"{n}_upto").alias("_all"))
    placed = run.join(F.broadcast(total), by)  # a row per group
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(shares)]))
    at = F.col("w.p") * (F.col("_all") - 1)
    low, high = F.floor(at), F.ceil(at)
    first, last = F.col(f"{n}_upto") - F.col(n), F.col(f"{n}_upto") - 1
    inside = lambda k: (k >= first) & (k <= last)
    ends = placed.withColumn("w", wanted).where(inside(low) | inside(high))
    pick = lambda k: F.max(F.when(inside(k), F.col(value)))
    cut = ends.groupBy(by, F.col("w.i").alias("i")).agg(pick(low).alias("a"), pick(high).alias("b"), F.max(at - low).alias("f"))
    one = cut.withColumn("q", F.col("a") + (F.col("b") - F.col("a")) * F.col("f"))
    listed = F.array_sort(F.collect_list(F.struct("i", "q")))  # a value per share
    return one.groupBy(by).agg(F.transform(listed, lambda x: x["q"]).alias("q"))
