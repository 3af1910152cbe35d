"""Validation and evaluation: holdouts by family, leakage, resampling, verdicts, metrics.

Random draws come from hashes of a seed and of ids, so they repeat on any cluster and in any
engine. Where a method draws per row and replicate, rows are counted by value first or expanded
inside one stage, with partial sums before the shuffle.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions.columns import DRAWS, bucket32, correlation, norm_text, poisson_weight, run_rows, shingle_set, with_draw
from orrery.operators.ranges import dealt, scanned
from orrery.sources.shared import evenly, kept, spread

# ---------------------------------------------------------------- holdouts


def family_holdout(df: DataFrame, family: str, frac: float, seed: str) -> DataFrame:
    """V1: whole families go to train or test by a hash; rows without a family are one family."""
    key = F.coalesce(F.col(family).cast("string"), F.lit("(none)"))
    return df.withColumn("split", F.when(bucket32(F.lit(seed), key) < int(frac * 2**32), "test").otherwise("train"))


def group_kfold(df: DataFrame, family: str, k: int, seed: str) -> DataFrame:
    """V2: a fold for each family, by the same hash."""
    key = F.coalesce(F.col(family).cast("string"), F.lit("(none)"))
    return df.withColumn("fold", (bucket32(F.lit(seed), key) % k).cast("int"))


def leave_one_family_out(df: DataFrame, family: str) -> DataFrame:
    """V3: every row in every fold, as test in its own family's. The result is rows x families by
    definition; the families, which are few, come as one array to each row."""
    families = df.select(F.coalesce(F.col(family).cast("string"), F.lit("(none)")).alias("f")).distinct().agg(F.array_sort(F.collect_list("f")).alias("families"))
    out = df.crossJoin(F.broadcast(families)).withColumn("held_out", F.explode("families")).drop("families")  # one row
    return out.withColumn("split", F.when(F.coalesce(F.col(family).cast("string"), F.lit("(none)")) == F.col("held_out"), "test").otherwise("train"))


def split_report(df: DataFrame, family: str, label: str) -> DataFrame:
    """V4: rows, families and label rate of each split, and how far its rate is from the whole's."""
    one = df.groupBy("split", family).agg(F.count("*").alias("n"), F.sum(label).alias("k")).groupBy("split").agg(F.sum("n").alias("n"), F.count("*").alias("families"), F.sum("k").alias("k"))
    all_ = one.agg(F.sum("n").alias("an"), F.sum("k").alias("ak"))
    rate = F.col("k") / F.col("n")
    return one.crossJoin(F.broadcast(all_)).select("split", "n", "families", rate.alias("rate"), F.abs(rate - F.col("ak") / F.col("an")).alias("gap"))


# ---------------------------------------------------------------- leakage


def key_overlap(train: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """V5: keys that are in both."""
    return train.select(*keys).intersect(test.select(*keys))


def ngram_leak(train: DataFrame, evals: DataFrame, n: int, bits: int = 64) -> DataFrame:
    """V6: `(item_id, doc_id, shared)`: how many of an item's word runs a document has. The items'
    distinct runs are written first, so that Spark knows their size: small ones are broadcast and
    the documents' runs, most of which no item has, go before any shuffle. A run that an item
    or a document has several times counts once. Runs are found by a hash of `bits` bits and
    compared by a second one, so that a number of bits changes the work and not the result."""
    wanted = kept(run_rows(evals, "item_id", norm_text(F.col("text")), n, bits).drop("size"), "wanted")
    docs = run_rows(spread(train.select("doc_id", "text")), "doc_id", norm_text(F.col("text")), n, bits).drop("size")
    met = docs.join(kept(wanted.select("run").distinct(), "runs"), "run", "left_semi")
    return met.join(wanted, ["run", "checked"]).groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"))


def contains_leak(train: DataFrame, evals: DataFrame, n: int = 5) -> DataFrame:
    """V7: `(item_id, doc_id)` where a document's normalized text holds the whole item's. Only pairs
    that share the item's first word run are compared; `n` is its length, or the item's where that
    is shorter. Documents are cut into runs of each length that items need, `n` at most."""
    items = evals.select("item_id", norm_text(F.col("text")).alias("item")).where("item <> ''")
    items = items.withColumn("long", F.least(F.lit(n), F.size(F.split("item", " "))))
    needed = [x["long"] for x in items.select("long").distinct().collect()] or [n]
    docs = train.select("doc_id", norm_text(F.col("text")).alias("body"))

    def candidates(m: int) -> DataFrame:
        first = items.where(F.col("long") == m).select("item_id", "item", F.element_at(shingle_set(F.col("item"), m), 1).alias("run"))
        return first.join(docs.select("doc_id", F.explode(shingle_set(F.col("body"), m)).alias("run")), "run").select("item_id", "item", "doc_id")

    pairs = reduce(DataFrame.unionByName, map(candidates, needed))
    whole = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    return pairs.join(docs, "doc_id").where(F.contains(whole("body"), whole("item"))).select("item_id", "doc_id")


def neardup_leak(pairs: DataFrame, splits: DataFrame) -> DataFrame:
    """V8: near copies `(a, b)` that lie on both sides of a split `(id, split)`."""
    left, right = splits.select(F.col("id").alias("a"), F.col("split").alias("split_a")), splits.select(F.col("id").alias("b"), F.col("split").alias("split_b"))
    return pairs.join(left, "a").join(right, "b").where("split_a <> split_b").select("a", "b", "split_a", "split_b")


def time_leak(features: DataFrame, labels: DataFrame, key: str, known: str, at: str) -> DataFrame:
    """V9: features that became known only after the label's time: `(key, n_late, n)`."""
    joined = features.join(labels, key)
    return joined.groupBy(key).agg(F.count_if(F.col(known) > F.col(at)).alias("n_late"), F.count("*").alias("n")).where("n_late > 0")


def decontaminate(train: DataFrame, leaked: DataFrame, key: str) -> DataFrame:
    """Training rows whose key doesn't leak."""
    return train.join(leaked.select(key).distinct(), key, "left_anti")


# ---------------------------------------------------------------- resampling


def replicates(n: int) -> Column:
    return F.explode(F.sequence(F.lit(1), F.lit(n)))


def interval(reps: DataFrame, by: list[str], alpha: float) -> DataFrame:
    """Percentile interval over the replicates above 0; replicate 0 is the estimate."""
    cut = lambda p: F.percentile(F.when(F.col("rep") > 0, F.col("stat")), p)
    return reps.groupBy(*by).agg(F.max(F.when(F.col("rep") == 0, F.col("stat"))).alias("est"), cut(alpha / 2).alias("lo"), cut(1 - alpha / 2).alias("hi"), F.count_if(F.col("rep") > 0).alias("reps"))


def bootstrap_ci(df: DataFrame, group: str, id_col: str, num: Column, den: Column, b: int, alpha: float, seed: str) -> DataFrame:
    """Interval of sum(num) / sum(den) per group (a mean has den 1), each row weighted by a
    Poisson(1) draw per replicate. A row's id is hashed once; its draws follow by arithmetic."""
    rows = evenly(df.select(group, bucket32(F.lit(seed), F.col(id_col)).alias("_base"), num.cast("double").alias("num"), den.cast("double").alias("den")))
    drawn = with_draw(rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(b)))), "_u", F.col("_base"), F.col("rep"))
    weight = F.when(F.col("rep") == 0, 1).otherwise(poisson_weight(F.col("_u")))
    sums = drawn.withColumn("w", weight).groupBy(group, "rep").agg(F.try_divide(F.sum(F.col("w") * F.col("num")), F.sum(F.col("w") * F.col("den"))).alias("stat"))
    return interval(sums, [group], alpha)


def cluster_bootstrap_ci(df: DataFrame, family: str, num: Column, den: Column, b: int, alpha: float, seed: str) -> DataFrame:
    """As V11 over the whole table, with one weight for all rows of a family."""
    families = df.groupBy(F.col(family).alias("_id")).agg(F.sum(num.cast("double")).alias("num"), F.sum(den.cast("double")).alias("den"))
    return bootstrap_ci(families.withColumn("all", F.lit("all")), "all", "_id", F.col("num"), F.col("den"), b, alpha, seed).drop("all")


def permutation_test(df: DataFrame, id_col: str, label: str, value: str, strata: str, b: int, seed: str, cells: int | None = None) -> DataFrame:
    """Difference of mean `value` between labels 1 and 0, against labels shuffled inside the
    strata: in each replicate the stratum's rows with the least draws get its ones. p counts
    replicates at least as far from 0.

    Draws are counted and summed in `cells` equal cells per replicate and stratum before any
    shuffle. The running counts tell in which cell the last of the ones lies; cells below it count
    whole, and only that cell's rows, one in `cells`, are sorted. Cells are as many as the root of
    the largest stratum's rows, so that both sides grow with that root only; any number gives the
    same result."""
    rows = kept(evenly(df.select(bucket32(F.lit(seed), F.col(id_col)).alias("_base"), F.col(id_col).alias("_id"), F.col(strata).alias("_s"), F.col(label).alias("_y"), F.col(value).cast("double").alias("_v")).where("_y is not null")), "rows")
    if cells is None:
        largest = rows.groupBy("_s").count().agg(F.max("count")).first()[0] or 0
        cells = 1 << max(4, min(16, math.isqrt(largest).bit_length()))
    known = F.when(F.col("_v").isNotNull(), 1).otherwise(0)
    drawn = with_draw(rows.withColumn("rep", replicates(b)), "_u", F.col("_base"), F.col("rep")).withColumn("_cell", F.floor(F.col("_u") * cells / DRAWS).cast("int"))
    ones = rows.groupBy(F.col("_s").alias("_o")).agg(F.sum("_y").alias("_k"))
    parts = kept(drawn.groupBy("rep", "_s", "_cell").agg(F.count("*").alias("n"), F.sum(known).alias("m"), F.sum("_v").alias("v")), "cells")
    before = F.coalesce(F.sum("n").over(W.partitionBy("rep", "_s").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = parts.withColumn("before", before).join(ones, F.col("_s").eqNullSafe(F.col("_o"))).drop("_o")
    below = placed.where("before + n <= _k").select("rep", "m", "v")
    edge = placed.where("before < _k and before + n > _k").select("rep", F.col("_s").alias("s"), F.col("_cell").alias("cell"), (F.col("_k") - F.col("before")).alias("need"))
    inside = drawn.join(kept(edge, "edges").withColumnRenamed("rep", "r"), (F.col("rep") == F.col("r")) & F.col("_s").eqNullSafe(F.col("s")) & (F.col("_cell") == F.col("cell")))
    place = F.row_number().over(W.partitionBy("rep", "_s").orderBy("_u", "_id"))
    last = inside.withColumn("place", place).where("place <= need").select("rep", known.alias("m"), F.col("_v").alias("v"))
    none = df.sparkSession.range(1, b + 1).select(F.col("id").cast("int").alias("rep"), F.lit(0).alias("m"), F.lit(0.0).alias("v"))
    chosen = below.unionByName(last).unionByName(none).groupBy("rep").agg(F.sum("m").alias("m1"), F.sum("v").alias("v1"))
    whole = rows.agg(F.sum(known).alias("m"), F.sum("_v").alias("v"))
    real = rows.where("_y = 1").agg(F.sum(known).alias("m1"), F.sum("_v").alias("v1")).select(F.lit(0).alias("rep"), "m1", "v1")
    gap = F.try_divide(F.col("v1"), F.col("m1")) - F.try_divide(F.col("v") - F.col("v1"), F.col("m") - F.col("m1"))
    stats = kept(chosen.unionByName(real).crossJoin(F.broadcast(whole)).select("rep", F.round(gap, 6).alias("stat")), "stats")  # whole is one row
    effect = stats.where("rep = 0").select(F.col("stat").alias("effect"))
    far = F.count_if(F.abs("stat") >= F.abs("effect"))
    return stats.where("rep > 0").crossJoin(F.broadcast(effect)).groupBy("effect").agg(((1 + far) / (1 + F.count("*"))).alias("p"), F.count("*").alias("reps"))


def sign_flip_test(df: DataFrame, by: str, id_col: str, diff: str, b: int, seed: str) -> DataFrame:
    """Mean paired difference per `by`, against signs flipped by hash bits."""
    rows = evenly(df.select(by, bucket32(F.lit(seed), F.col(id_col)).alias("_base"), F.col(diff).cast("double").alias("_d")))
    drawn = with_draw(rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(b)))), "_u", F.col("_base"), F.col("rep"))
    sign = F.when(F.col("rep") == 0, 1).when(F.col("_u") % 2 == 0, 1).otherwise(-1)
    stats = drawn.groupBy(by, "rep").agg(F.round(F.avg(sign * F.col("_d")), 6).alias("stat"))
    effect = stats.where("rep = 0").select(by, F.col("stat").alias("effect"))
    far = F.count_if(F.abs("stat") >= F.abs("effect"))
    return stats.where("rep > 0").join(effect, by).groupBy(by, "effect").agg(((1 + far) / (1 + F.count("*"))).alias("p"))


def negative_control(df: DataFrame, group: str, id_col: str, placebo: Column, expected: float, b: int, alpha: float, seed: str) -> DataFrame:
    """The interval of an outcome that must show nothing; fails where it leaves `expected` out."""
    found = bootstrap_ci(df, group, id_col, placebo, F.lit(1), b, alpha, seed)
    return found.withColumn("fails", (F.col("lo") > expected) | (F.col("hi") < expected))


def replicate(df: DataFrame, by: str, id_col: str, effect: Column, b: int, alpha: float, seed: str) -> DataFrame:
    """The effect in each part of the data, with its interval and whether it leaves 0 out."""
    found = bootstrap_ci(df, by, id_col, effect, F.lit(1), b, alpha, seed)
    return found.withColumn("significant", (F.col("lo") > 0) | (F.col("hi") < 0))


def replication_summary(table: DataFrame) -> DataFrame:
    """How many parts agree in sign with the median effect, and the share that is significant."""
    middle = table.agg(F.percentile("est", 0.5).alias("median"))
    return table.crossJoin(F.broadcast(middle)).groupBy("median").agg(F.count("*").alias("parts"), F.avg(F.when(F.signum("est") == F.signum("median"), 1.0).otherwise(0.0)).alias("agree"), F.avg(F.col("significant").cast("double")).alias("share_significant"))


def pool(effects: DataFrame) -> DataFrame:
    """Inverse-variance mean of effects `(est, lo, hi)` of 95 % intervals, Q and I squared."""
    se = (F.col("hi") - F.col("lo")) / (2 * 1.959963984540054)
    weighted = effects.where("hi > lo").select("est", (1 / (se * se)).alias("w"))
    sums = weighted.agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("est")).alias("we"), F.sum(F.col("w") * F.col("est") * F.col("est")).alias("wee"), F.count("*").alias("parts"))
    q = F.greatest(F.lit(0.0), F.col("wee") - F.col("we") * F.col("we") / F.col("w"))
    out = sums.select((F.col("we") / F.col("w")).alias("est"), F.sqrt(1 / F.col("w")).alias("se"), q.alias("q"), "parts")
    return out.withColumn("i2", F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("q") - (F.col("parts") - 1), F.col("q")), F.lit(0.0))))


def verdict(effects: DataFrame, margin: float) -> DataFrame:
    """An interval inside +-margin: equivalent to nothing; above 0: supported; below: refuted;
    else inconclusive. In this order; the claim is an effect above 0."""
    inside = (F.col("lo") >= -margin) & (F.col("hi") <= margin)
    return effects.withColumn("verdict", F.when(inside, "equivalent").when(F.col("lo") > 0, "supported").when(F.col("hi") < 0, "refuted").otherwise("inconclusive"))


def bh_adjust(tests: DataFrame, family: str, id_col: str) -> DataFrame:
    """Benjamini-Hochberg adjusted p within each family of tests. Tests are dealt by ranges of
    (family, p): a place is a running count, the adjusted p the least of p * m / place from here to
    the family's end, both taken within ranges and carried from one to the next. So a family of any
    size is spread over tasks. Tests without a p don't count and stay without."""
    order = ["p", id_col]
    placed = kept(scanned(dealt(tests, family, order, "tests"), family, order, {"_place": ("sum", F.when(F.col("p").isNotNull(), 1).otherwise(0).cast("bigint"))}), "places")
    sizes = placed.groupBy(F.col(family).alias("_family")).agg(F.count("p").alias("_m"))
    raw = placed.join(sizes, placed[family].eqNullSafe(sizes["_family"])).withColumn("_raw", F.try_divide(F.col("p") * F.col("_m"), F.col("_place").cast("double"))).drop("_family", "_m", "_place")
    least = scanned(kept(raw, "raw"), family, order, {"_least": ("min", F.col("_raw"))}, down=True)
    return least.withColumn("p_adjusted", F.when(F.col("p").isNotNull(), F.least(F.lit(1.0), F.col("_least")))).drop("_raw", "_least", "_range")


# ---------------------------------------------------------------- metrics


def classification_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Confusion counts, precision, recall, F1, accuracy and Matthews' correlation."""
    hit = lambda y, p: F.count_if((F.col(label) == y) & (F.col(predicted) == p)).cast("double")
    c = df.agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(
        *[F.col(x).cast("bigint").alias(x) for x in ("tp", "fp", "fn", "tn")], F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"), F.try_divide(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        F.try_divide(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)).alias("mcc"),
    )


def auc(df: DataFrame, score: str, label: str, slices: int = 64) -> DataFrame:
    """Area under the ROC curve with ties counted half, and average precision. Rows are counted
    by distinct score; running sums are taken within slices of the scores' range and joined, so
    no task has all distinct scores."""
    counts = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(label).alias("k"), F.count("*").alias("n"))
    ends = counts.agg(F.min("s").alias("a"), F.max("s").alias("b"))
    cut = F.least(F.lit(slices - 1), F.coalesce(F.floor(F.try_divide(F.col("s") - F.col("a"), F.col("b") - F.col("a")) * slices), F.lit(0)))
    placed = counts.crossJoin(F.broadcast(ends)).select("s", "k", (F.col("n") - F.col("k")).alias("m"), cut.alias("slice"))
    sums = placed.groupBy("slice").agg(F.sum("k").alias("k"), F.sum("m").alias("m"))
    below, above = W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1), W.orderBy("slice").rowsBetween(1, W.unboundedFollowing)  # a row per slice
    zero = lambda c: F.coalesce(c, F.lit(0))
    base = sums.select("slice", zero(F.sum("m").over(below)).alias("m_below"), zero(F.sum("k").over(above)).alias("k_above"), zero(F.sum("m").over(above)).alias("m_above"))
    own = W.partitionBy("slice").orderBy("s")
    up, down = own.rowsBetween(W.unboundedPreceding, -1), own.rowsBetween(0, W.unboundedFollowing)
    run = placed.join(F.broadcast(base), "slice").select(
        "k", "m", (F.col("m_below") + zero(F.sum("m").over(up))).alias("lower"), (F.col("k_above") + F.sum("k").over(down)).alias("tp"), (F.col("m_above") + F.sum("m").over(down)).alias("fp")
    )
    area = F.try_divide(F.sum(F.col("k") * (F.col("lower") + F.col("m") / 2)), (F.sum("k") * F.sum("m")).cast("double"))
    precision = F.try_divide(F.sum(F.col("k") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.sum("k").cast("double"))
    return run.agg(area.alias("auc"), precision.alias("average_precision"))


def calibration(df: DataFrame, p: str, y: str, bins: int) -> DataFrame:
    """Mean prediction, rate and number in each of equal bins, with the Brier score's sum."""
    cell = F.least(F.lit(bins - 1), F.floor(F.col(p) * bins)).cast("int")
    return df.groupBy(cell.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"), F.sum((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("squares"))


def calibration_errors(bins: DataFrame) -> DataFrame:
    """Brier score and expected calibration error from the bins."""
    n = F.sum("n")
    return bins.agg((F.sum("squares") / n).alias("brier"), (F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / n).alias("ece"))


def feature_screen(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """Each feature's correlation with the label, standardized difference of means, and area
    under its own ROC curve; far from 0.5 hints at a leak."""
    long = df.select(label, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot([label], cols, "feature", "x")
    of = lambda y: F.when(F.col(label) == y, F.col("x"))
    spread = F.sqrt((F.var_samp(of(1)) + F.var_samp(of(0))) / 2)
    shape = long.groupBy("feature").agg(correlation(F.col("x"), F.col(label)).alias("corr"), F.try_divide(F.avg(of(1)) - F.avg(of(0)), spread).alias("difference"))
    areas = reduce(DataFrame.unionByName, [auc(df, c, label).select(F.lit(c).alias("feature"), "auc") for c in cols])
    return shape.join(areas, "feature")
