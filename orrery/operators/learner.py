"""Learner and user data: scope, sessions, assessment, mastery, experiments."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions.columns import correlation
from orrery.sources.shared import kept


def user_scope(df: DataFrame, users: DataFrame) -> DataFrame:
    """Rows of allowed users."""
    return df.join(users.select("user_id"), "user_id", "left_semi")


def profile(df: DataFrame) -> DataFrame:
    """A user's event counts by type, as a map with sorted keys."""
    counts = df.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("event_type", "n")))
    return counts.groupBy("user_id").agg(F.sum("n").alias("n_events"), F.map_from_entries(entries).alias("by_type"))


def sessions(df: DataFrame, gap: str) -> DataFrame:
    """A user's activity between gaps of `gap` or more; the end is the last event's time plus
    the gap. Batch or stream."""
    return df.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def score(responses: DataFrame) -> DataFrame:
    """Each user's number right, percent, and percentile rank. Ranks come from counts per
    percent (two places, so ten thousand rows at most), not from a sort of all users."""
    users = responses.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("correct").alias("right")).withColumn("percent", F.round(100 * F.col("right") / F.col("n"), 2))
    counts = users.groupBy("percent").agg(F.count("*").alias("m"))
    ranks = counts.select("percent", F.coalesce(F.sum("m").over(W.orderBy("percent").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("lower"), F.sum("m").over(W.orderBy("percent").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("all"))
    share = F.when(F.col("all") > 1, F.col("lower") / (F.col("all") - 1)).otherwise(F.lit(0.0))
    return users.join(F.broadcast(ranks), "percent").select("user_id", "n", "right", "percent", share.alias("percent_rank"))


def item_analysis(responses: DataFrame) -> DataFrame:
    """Share right of each item, and its correlation with the rest of the users' scores."""
    totals = responses.groupBy("user_id").agg(F.sum("correct").alias("total"))
    rows = responses.join(totals, "user_id").withColumn("rest", F.col("total") - F.col("correct"))
    return rows.groupBy("item_id").agg(F.count("*").alias("n"), F.avg("correct").alias("difficulty"), correlation(F.col("correct"), F.col("rest")).alias("discrimination"))


def mastery(responses: DataFrame, groups: int, n: int) -> DataFrame:
    """Accuracy so far and over the last n answers, per user and item group."""
    order = W.partitionBy("user_id", "item_group").orderBy("ts", "event_id")
    rows = responses.withColumn("item_group", F.col("item_id") % groups)
    return rows.select(
        "event_id", "user_id", "item_group", "ts", F.avg("correct").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("so_far"), F.avg("correct").over(order.rowsBetween(-(n - 1), 0)).alias("lately")
    )


def next_lesson(mastery: DataFrame, enough: float) -> DataFrame:
    """Each user's weakest group among those not mastered yet, ties to the lesser group."""
    now = mastery.groupBy("user_id", "item_group").agg(F.max_by("lately", F.struct("ts", "event_id")).alias("lately"))
    weak = now.where(F.col("lately") < enough)
    return weak.groupBy("user_id").agg(F.min(F.struct("lately", "item_group")).alias("x")).select("user_id", "x.item_group", "x.lately")


def grid(configs: DataFrame, folds: DataFrame) -> DataFrame:
    """Every configuration with every fold; both are small tables."""
    return configs.crossJoin(folds)


def run_grid(df: DataFrame, thresholds: list[float], score: str, label: str) -> DataFrame:
    """Accuracy and recall of "score above the threshold" for each threshold and fold, in one
    pass over the rows."""
    rows = df.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    predicted = (F.col(score) > F.col("threshold")).cast("int")
    hit = F.avg((predicted == F.col(label)).cast("double"))
    recall = F.avg(F.when(F.col(label) == 1, predicted.cast("double")))
    one = rows.groupBy("threshold", "fold").agg(hit.alias("accuracy"), recall.alias("recall"))
    return one.unpivot(["threshold", "fold"], ["accuracy", "recall"], "metric", "value")


def ridge_grid(df: DataFrame, features: list[str], label: str, fold: str, ridges: list[float]) -> DataFrame:
    """`(ridge, fold, metric, value)`: root mean square and mean absolute error, on each fold's rows,
    of a line in `features` that is fitted with each ridge on all other folds' rows.

    One pass sums the normal equations of every fold, a row per fold; the sums without a fold are
    the total less its own, so no row is read for a configuration. Each fold's models are solved in
    one task and go to the fold's rows, which are read a second time. The intercept isn't damped. Rows
    with a null in a feature or the label are left out; rows without a fold are a fold."""
    names = [*features, label]
    rows = df.select(F.col(fold).alias("fold"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)]).dropna(subset=[f"x{i}" for i in range(len(names))])
    d = len(features)
    pairs = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]
    parts = [F.sum(F.lit(1.0)), *[F.sum(f"x{i}") for i in range(d + 1)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs]]
    sums = kept(rows.groupBy("fold").agg(F.array(*parts).alias("own")), "sums")
    total = sums.agg(F.array(*[F.sum(F.col("own")[i]) for i in range(len(parts))]).alias("all"))
    others = sums.crossJoin(F.broadcast(total)).select("fold", F.zip_with("all", "own", lambda a, b: a - b).alias("s"))  # total is one row

    def solved(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds, weights = [], []
            for k, s in enumerate(batch.column("s").to_pylist()):
                n, mean, square = max(s[0], 1e-300), np.array(s[1 : d + 2]), np.zeros((d + 1, d + 1))
                for (i, j), v in zip(pairs, s[d + 2 :], strict=True):
                    square[i, j] = square[j, i] = v
                centred, mean = square - np.outer(mean, mean) / n, mean / n
                for ridge in ridges:
                    slope = np.linalg.lstsq(centred[:d, :d] + ridge * np.eye(d), centred[:d, d], rcond=None)[0]
                    folds.append(k)
                    weights.append([*slope.tolist(), float(mean[d] - slope @ mean[:d])])
            yield pa.RecordBatch.from_arrays([batch.column("fold").take(pa.array(folds, pa.int64())), pa.array(list(ridges) * batch.num_rows, pa.float64()), pa.array(weights, pa.list_(pa.float64()))], names=["own_fold", "ridge", "w"])

    kind = rows.schema["fold"].dataType.simpleString()
    models = others.mapInArrow(solved, f"own_fold {kind}, ridge double, w array<double>").groupBy("own_fold").agg(F.collect_list(F.struct("ridge", "w")).alias("models"))
    fitted = rows.join(kept(models, "models"), F.col("fold").eqNullSafe(F.col("own_fold"))).withColumn("m", F.explode("models"))  # a row per fold
    predicted = F.col("m.w")[d]
    for i in range(d):
        predicted = predicted + F.col("m.w")[i] * F.col(f"x{i}")
    error = F.col(f"x{d}") - predicted
    one = fitted.select(F.col("m.ridge").alias("ridge"), "fold", error.alias("e")).groupBy("ridge", "fold").agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg(F.abs("e")).alias("mae"))
    return one.unpivot(["ridge", "fold"], ["rmse", "mae"], "metric", "value")


def leaderboard(runs: DataFrame, metrics: list[str], by: str, config: str = "threshold", up: bool = False) -> DataFrame:
    """Mean and deviation of each metric over the folds, wide, ranked by the mean of `by`, greatest
    first (least first if `up`). Configurations are a small table."""
    wide = runs.groupBy(config).pivot("metric", metrics).agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"))
    return wide.withColumn("rank", F.rank().over(W.orderBy(F.col(f"{by}_mean").asc() if up else F.col(f"{by}_mean").desc())))
