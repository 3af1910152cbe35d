"""Data tests: rules, keys, quarantine, profiles and differences of tables."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators.ranks import quantiles
from orrery.sources.shared import kept

#: A rule's name, and what is true of a row that breaks it (null counts as kept, but for not_null).
Rule = tuple[str, Column]


def not_null(col: str) -> Rule:
    return f"not_null({col})", F.col(col).isNull()


def between(col: str, low: float, high: float) -> Rule:
    return f"between({col})", ~F.col(col).between(low, high)


def allowed(col: str, values: list) -> Rule:
    return f"allowed({col})", ~F.col(col).isin(values)


def check(df: DataFrame, rules: list[Rule], unique: list[list[str]] = ()) -> DataFrame:
    """Q2: `(rule, failed, n_rows)`. All row rules take one pass; each uniqueness rule one grouping
    (failed: rows whose key is not unique, null keys included)."""
    one = df.agg(F.count("*").alias("n_rows"), *[F.count_if(broken).alias(f"r{i}") for i, (_, broken) in enumerate(rules)])
    entries = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("failed")) for i, (name, _) in enumerate(rules)])
    out = one.select(F.explode(entries).alias("x"), "n_rows").select("x.rule", "x.failed", "n_rows")
    for keys in unique:
        counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
        sums = counts.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("failed"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
        out = out.unionByName(sums.select(F.lit(f"unique({','.join(keys)})").alias("rule"), "failed", "n_rows"))
    return out


def check_fk(child: DataFrame, parent: DataFrame, key: list[str]) -> DataFrame:
    """Q3: child rows whose key no parent has; null keys count as such."""
    return child.join(parent.select(*key), key, "left_anti")


def quarantine(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """Q4: good rows, and bad rows with the names of all rules that they break."""
    reasons = F.filter(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]), lambda x: x.isNotNull())
    marked = df.withColumn("reasons", reasons)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def profile_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """Q5: nulls, distinct values, range, mean and quartiles of numeric columns, a row each. Values
    are counted first; quartiles come from running counts of distinct values, dealt by ranges."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "name", "value")
    counts = kept(long.groupBy("name", "value").agg(F.count("*").alias("n")), "counts")
    mean = F.round(F.sum(F.col("value") * F.col("n")) / F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), 4)
    cuts = quantiles(counts, "name", "value", "n", [0.25, 0.5, 0.75])
    shape = counts.groupBy("name").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_null"), F.count("value").alias("n_distinct"),
        F.min("value").alias("least"), F.max("value").alias("most"), mean.alias("mean"),
    )
    return shape.join(cuts, "name", "left").select(*shape.columns, *[F.round(F.col("q")[i], 6).alias(c) for i, c in enumerate(("q25", "q50", "q75"))])


def diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Q6: keys that were added, removed or changed from `a` to `b`, which have the same columns
    and a row per key."""
    rest = [c for c in a.columns if c not in keys]
    left = a.select(*keys, F.struct(F.lit(True), *rest).alias("_a"))
    right = b.select(*keys, F.struct(F.lit(True), *rest).alias("_b"))
    joined = left.join(right, keys, "full")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return joined.select(*keys, change.alias("change")).where("change is not null")


