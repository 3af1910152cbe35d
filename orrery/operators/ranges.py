"""Windows over groups of any length: rows are dealt by ranges of (group, order), so one group is
spread over tasks. Frames of rows borrow the rows next to a range's edges; running aggregates take
what lies before a range from a table with one row per range and group.

Rows are told apart by (group, order); rows that agree in both may come in any order, as in a window.

A table of at most WHOLE rows isn't dealt: it has no column `_range`, and a group is one window
partition. Results are the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.sources.shared import forget, kept


#: Rows that one task sorts with ease.
WHOLE = 1_000_000


def dealt(df: DataFrame, by: str, order: list[str], name: str = "dealt") -> DataFrame:
    """The rows, written, and where they are more than WHOLE written again with `_range`: which of as
    many ranges of (by, order) as there are shuffle partitions they lie in. Ranges come from a sample of
    the written rows, and are drawn once."""
    if "_range" in df.columns:
        return df
    rows = kept(df, name)
    if rows.count() <= WHOLE:
        return rows
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = kept(rows.repartitionByRange(ranges, by, *order).withColumn("_range", F.spark_partition_id()), name)
    forget(rows)
    return out


def framed(df: DataFrame, by: str, order: list[str], before: int, after: int, compute: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """`compute(rows, keys)` adds columns by windows over partitions of `keys`, ordered by `order`, whose
    frames reach at most `before` rows back and `after` rows ahead. Rows at the edges of a dealt
    table's ranges, where a frame leaves the range, are computed again among the edges of all
    ranges: for each group, twice `before + after` rows a range."""
    if "_range" not in df.columns:
        return compute(df, [by])
    reach = before + after
    own = W.partitionBy(by, "_range")
    placed = df.withColumn("_first", F.row_number().over(own.orderBy(*order))).withColumn("_last", F.count("*").over(own) - F.col("_first") + 1)
    at_edge = (F.col("_first") <= before) | (F.col("_last") <= after)
    inner = compute(placed, [by, "_range"]).where(~at_edge)
    edges = compute(placed.where((F.col("_first") <= reach) | (F.col("_last") <= reach)), [by]).where(at_edge)
    return inner.unionByName(edges).drop("_first", "_last")


def scanned(df: DataFrame, by: str, order: list[str], scans: dict[str, tuple[str, Column]], down: bool = False) -> DataFrame:
    """A dealt table with running aggregates `name: (kind, value)` from each group's first row to this
    one (its last row, if `down`); kinds are sum, min, max, and last: the latest value that isn't
    null."""
    kinds = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    way = [F.col(c).desc() for c in order] if down else [F.col(c) for c in order]
    own = W.partitionBy(*[c for c in (by, "_range") if c in df.columns]).orderBy(*way).rowsBetween(W.unboundedPreceding, 0)
    run = df.withColumns({name: kinds[kind](value).over(own) for name, (kind, value) in scans.items()})
    if "_range" not in df.columns:
        return run

    def whole(kind: str, value: Column) -> Column:
        if kind != "last":
            return kinds[kind](value)
        return (F.min_by if down else F.max_by)(value, F.when(value.isNotNull(), F.struct(*order)))

    totals = df.groupBy(F.col(by).alias("_by"), F.col("_range").alias("_r")).agg(*[whole(*s).alias(f"_{name}") for name, s in scans.items()])
    earlier = W.partitionBy("_by").orderBy(F.col("_r").desc() if down else F.col("_r")).rowsBetween(W.unboundedPreceding, -1)
    base = totals.select("_by", "_r", *[kinds[kind](F.col(f"_{name}")).over(earlier).alias(f"_{name}") for name, (kind, _) in scans.items()])
    joined = run.join(base, run[by].eqNullSafe(base["_by"]) & (run["_range"] == base["_r"]))
    both = {"sum": lambda a, b: F.coalesce(a + b, a, b), "min": F.least, "max": F.greatest, "last": F.coalesce}
    return joined.withColumns({name: both[kind](F.col(name), F.col(f"_{name}")) for name, (kind, _) in scans.items()}).drop("_by", "_r", *[f"_{name}" for name in scans])


def within_time(df: DataFrame, by: str, at: str, span: int, compute: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """As framed, for windows over `at`, a whole number that `order` rises with, whose frames reach
    less than `span` back. Each range borrows the rows of earlier ones that lie less than `span`
    before its first: those behind the next range's first less `span` are the only ones asked."""
    if "_range" not in df.columns:
        return compute(df, [by])
    starts = df.groupBy(F.col(by).alias("_by"), F.col("_range").alias("_r")).agg(F.min(at).alias("_start"))
    nexts = starts.withColumn("_next", F.lead("_start").over(W.partitionBy("_by").orderBy("_r"))).where("_next is not null")
    late = df.join(nexts, df[by].eqNullSafe(nexts["_by"]) & (df["_range"] == nexts["_r"])).where(F.col(at) > F.col("_next") - span).drop("_by", "_r", "_start", "_next")
    lent = late.join(starts, late[by].eqNullSafe(starts["_by"]) & (late["_range"] < starts["_r"]) & (late[at] > starts["_start"] - span))
    lent = lent.withColumn("_range", F.col("_r")).drop("_by", "_r", "_start").withColumn("_own", F.lit(False))
    return compute(df.withColumn("_own", F.lit(True)).unionByName(lent), [by, "_range"]).where("_own").drop("_own")
