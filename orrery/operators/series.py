"""Time series in long form `(series, ts, ...)`: bars, features, backtests, regimes, monitoring.

Windows over a series are dealt by ranges of time (see operators.ranges): one series of any length is
spread over tasks. Features of a row use rows up to it only, so deleting the future changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orrery.operators.ranges import dealt, framed, scanned, within_time
from orrery.operators.ranks import quantiles, running_counts
from orrery.sources.shared import kept


#: Steps of a grid that one row stands for before they are spread.
STEPS = 4096


def by_range(df: DataFrame) -> DataFrame:
    return dealt(df, "series", ["ts"])


def looked(df: DataFrame, before: int, after: int, columns: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """The rows of a dealt table with columns over windows in time (see framed)."""
    return framed(df, "series", ["ts"], before, after, lambda rows, keys: rows.withColumns(columns(W.partitionBy(*keys).orderBy("ts"))))


def summed(df: DataFrame, scans: dict[str, tuple[str, Column]]) -> DataFrame:
    """The rows of a dealt table with running aggregates in time (see scanned)."""
    return scanned(df, "series", ["ts"], scans)


def bars(df: DataFrame, series: str, ts: str, val: str, width: str, tie: str) -> DataFrame:
    """First, highest, lowest and last value, and count, of each series in each window."""
    at = F.struct(ts, tie)
    return (
        df.groupBy(F.col(series).alias("series"), F.window(ts, width).alias("w"))
        .agg(F.min_by(val, at).alias("open"), F.max(val).alias("high"), F.min(val).alias("low"), F.max_by(val, at).alias("close"), F.count("*").alias("n"))
        .select("series", F.col("w.start").alias("ts"), "open", "high", "low", "close", "n")
    )


def gap_fill(bars: DataFrame, width: str) -> DataFrame:
    """A row for every step from a series' first bar to its last; in a gap the close is the
    last one before it and n is 0."""
    span = bars.groupBy("series").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    step = F.expr(f"interval {width}")
    parts = span.select("series", "b", F.explode(F.sequence("a", "b", step * STEPS)).alias("a"))
    grid = parts.select("series", F.explode(F.sequence("a", F.least(F.col("b"), F.col("a") + step * (STEPS - 1)), step)).alias("ts"))
    joined = grid.join(bars.select("series", "ts", "close", "n"), ["series", "ts"], "left")
    filled = summed(by_range(joined), {"close": ("last", F.col("close"))})
    return filled.select("series", "ts", "close", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def returns(df: DataFrame, lags: list[int]) -> DataFrame:
    """Past closes, simple and log returns at each lag, and the next close."""
    out = looked(by_range(df), max(lags), 1, lambda w: {"next_close": F.lead("close").over(w)} | {f"lag_{k}": F.lag("close", k).over(w) for k in lags})
    for k in lags:
        past = F.col(f"lag_{k}")
        out = out.withColumns({f"ret_{k}": F.try_divide(F.col("close") - past, past), f"log_ret_{k}": F.when((past > 0) & (F.col("close") > 0), F.log(F.col("close") / past))})
    return out.drop("_range")


def slope(rows: int, of: str) -> Callable[[DataFrame, list[str]], DataFrame]:
    """The slope of `of` over the last `rows` rows; only distances of places count, so a place may be
    counted from anywhere."""

    def compute(df: DataFrame, keys: list[str]) -> DataFrame:
        w = W.partitionBy(*keys).orderBy("ts")
        placed = df.withColumn("_i", F.row_number().over(w).cast("double"))
        return placed.withColumn("slope", F.regr_slope(F.col(of), F.col("_i")).over(w.rowsBetween(-(rows - 1), 0))).drop("_i")

    return compute


def rolling(df: DataFrame, rows: int, seconds: int) -> DataFrame:
    """T4: mean, deviation, range, z-score and slope over the last `rows` rows; mean over the last
    `seconds`. Deviations and slopes need two rows."""

    def frames(step: DataFrame, keys: list[str]) -> DataFrame:
        w = W.partitionBy(*keys).orderBy("ts").rowsBetween(-(rows - 1), 0)
        close = F.col("close")
        return slope(rows, "close")(step.withColumns({"mean": F.avg(close).over(w), "sd": F.stddev_samp(close).over(w), "low": F.min(close).over(w), "high": F.max(close).over(w)}), keys)

    def times(step: DataFrame, keys: list[str]) -> DataFrame:
        return step.withColumn("time_mean", F.avg("close").over(W.partitionBy(*keys).orderBy("sec").rangeBetween(-(seconds - 1), 0)))

    step = by_range(df.select("series", "ts", "close")).withColumn("sec", F.unix_seconds(F.col("ts").cast("timestamp")))
    out = framed(within_time(step, "series", "sec", seconds, times), "series", ["ts"], rows - 1, 0, frames)
    return out.select("series", "ts", "close", "mean", "sd", "low", "high", F.try_divide(F.col("close") - F.col("mean"), F.col("sd")).alias("z"), "slope", "time_mean")


def calendar(df: DataFrame, ts: str) -> DataFrame:
    """T5: hour, weekday (1 is Sunday), month, and the hour and weekday on circles."""
    turn = lambda part, n: (F.sin(2 * F.pi() * part / n), F.cos(2 * F.pi() * part / n))
    hour, day = F.hour(ts), F.dayofweek(ts)
    return df.withColumns({"hour": hour, "weekday": day, "month": F.month(ts), "hour_sin": turn(hour, 24)[0], "hour_cos": turn(hour, 24)[1], "day_sin": turn(day, 7)[0], "day_cos": turn(day, 7)[1]})


def asof(left: DataFrame, right: DataFrame, by: str, ts: str, value: str, max_age: str | None = None) -> DataFrame:
    """Each left row with the right side's last row at or before it, per key: `value` and its
    time as `right_ts`. Right rows are unique by key and time. Both sides are dealt together by
    ranges of (key, time), in the place of a join over all pairs: the last right row of the ranges
    before is carried into each, so a hot key is spread over tasks."""
    a = left.select("*", F.lit(1).alias("_side"), F.lit(None).cast(right.schema[ts].dataType).alias("_at"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    b = right.select(by, ts, F.lit(0).alias("_side"), F.col(ts).alias("_at"), F.col(value).alias("_v"))
    both = dealt(a.unionByName(b, allowMissingColumns=True), by, [ts, "_side"], "both")
    seen = F.when(F.col("_side") == 0, F.struct("_at", "_v"))
    out = scanned(both, by, [ts, "_side"], {"_hit": ("last", seen)}).where("_side = 1")
    fresh = F.lit(True) if max_age is None else F.col("_hit._at") >= F.col(ts) - F.expr(f"interval {max_age}")
    return out.select(*left.columns, F.when(fresh, F.col("_hit._at")).alias("right_ts"), F.when(fresh, F.col("_hit._v")).alias(value))


def context_windows(df: DataFrame, length: int, horizons: int) -> DataFrame:
    """The last `length` closes of each row as an array, and the next ones as targets; rows with
    a shorter past are left out."""
    targets = [f"target_{h}" for h in range(1, horizons + 1)]
    context = lambda w: {"context": F.collect_list("close").over(w.rowsBetween(-(length - 1), 0))} | {t: F.lead("close", h).over(w) for h, t in enumerate(targets, 1)}
    return looked(by_range(df.select("series", "ts", "close")), length - 1, horizons, context).select("series", "ts", "context", *targets).where(F.size("context") == length)


def origins(df: DataFrame, start: int, step: int) -> DataFrame:
    """Origins of a walk forward: every `step`-th place of each series from `start` on."""
    return df.where((F.col("i") >= start) & ((F.col("i") - start) % step == 0)).select("series", F.col("i").alias("origin"))


def walk_forward(df: DataFrame, start: int, step: int, train: int, h: int, embargo: int) -> DataFrame:
    """Rows of each fold. Origin o trains on places [o - train, o - embargo) and tests on
    [o, o + h). A row knows the origins it belongs to from its own place, so no join over ranges
    is needed; places count from 0 within a series."""
    placed = kept(summed(by_range(df), {"i": ("sum", F.lit(1).cast("bigint"))}).withColumn("i", F.col("i") - 1).drop("_range"), "placed")
    last = placed.groupBy("series").agg(F.max("i").alias("last"))
    low = F.greatest(F.lit(start), F.lit(start) + F.ceil((F.col("i") - h + 1 - start) / step) * step)
    high = F.least(F.lit(start) + F.floor((F.col("i") + train - start) / step) * step, F.lit(start) + F.floor((F.col("last") - start) / step) * step)
    spread = placed.join(last, "series").where(low <= high).withColumn("origin", F.explode(F.sequence(low, high, F.lit(step).cast("bigint"))))
    part = F.when(F.col("i") >= F.col("origin"), "test").when(F.col("i") < F.col("origin") - embargo, "train")
    return spread.withColumn("part", part).where("part is not null").drop("last")


def scale_by_fold(folds: DataFrame) -> DataFrame:
    """Closes scaled by the mean and deviation of the fold's own training rows."""
    stats = folds.where("part = 'train'").groupBy("series", "origin").agg(F.avg("close").alias("mean"), F.stddev_samp("close").alias("sd"))
    return folds.join(stats, ["series", "origin"]).withColumn("scaled", F.try_divide(F.col("close") - F.col("mean"), F.col("sd")))


def tests_of(folds: DataFrame) -> DataFrame:
    return folds.where("part = 'test'").select("series", "origin", "ts", (F.col("i") - F.col("origin") + 1).alias("horizon"), F.col("close").alias("y"))


def baselines(folds: DataFrame, season: int) -> DataFrame:
    """`(series, origin, ts, horizon, y, model, yhat)` from the fold's training rows: the last
    close, the last one of the same season, the mean, and the line from first to last."""
    train = folds.where("part = 'train'")
    seasonal = F.map_from_entries(F.collect_list(F.when(F.col("i") >= F.col("top") - season + 1, F.struct((F.col("i") % season).alias("k"), "close"))))
    top = F.max("i").over(W.partitionBy("series", "origin")).alias("top")
    one = train.select("series", "origin", "i", "close", top).groupBy("series", "origin").agg(
        F.max_by("close", "i").alias("last"), F.min_by("close", "i").alias("first"), F.max("i").alias("b"), F.min("i").alias("a"), F.avg("close").alias("mean"), seasonal.alias("seasons"),
    )
    joined = tests_of(folds).withColumn("i", F.col("origin") + F.col("horizon") - 1).join(one, ["series", "origin"])
    slope = F.coalesce(F.try_divide(F.col("last") - F.col("first"), (F.col("b") - F.col("a")).cast("double")), F.lit(0.0))
    models = {"last": F.col("last"), "seasonal": F.coalesce(F.try_element_at("seasons", F.col("i") % season), F.col("last")), "mean": F.col("mean"), "drift": F.col("last") + slope * (F.col("i") - F.col("b"))}
    entries = F.array(*[F.struct(F.lit(k).alias("model"), v.alias("yhat")) for k, v in models.items()])
    return joined.select("series", "origin", "ts", "horizon", "y", F.explode(entries).alias("m")).select("series", "origin", "ts", "horizon", "y", "m.model", "m.yhat")


def ar1(folds: DataFrame) -> DataFrame:
    """A line from each close to the next, fitted on the fold's training rows, applied once
    per step from the last of them."""
    own = W.partitionBy("series", "origin").orderBy("i")
    pairs = folds.where("part = 'train'").withColumn("past", F.lag("close").over(own))
    fit = pairs.groupBy("series", "origin").agg(F.regr_slope("close", "past").alias("b"), F.regr_intercept("close", "past").alias("a"), F.max_by("close", "i").alias("last"), F.max("i").alias("top"))
    joined = tests_of(folds).join(fit, ["series", "origin"])
    steps = (F.col("origin") + F.col("horizon") - 1 - F.col("top")).cast("int")
    yhat = F.aggregate(F.sequence(F.lit(1), steps), F.col("last"), lambda x, _: F.col("a") + F.col("b") * x)
    return joined.select("series", "origin", "ts", "horizon", "y", F.lit("ar1").alias("model"), yhat.alias("yhat")).where("yhat is not null")


def fit_pooled(df: DataFrame, length: int, start: int, step: int, train: int, h: int, embargo: int, ridge: float = 1e-3) -> DataFrame:
    """One learned forecaster over all series for each origin of a walk forward: a ridge line
    from the `length` closes before a row to its close. `(series, origin, ts, y, model, yhat)`.

    An origin's model learns from rows whose close and whole past lie in its training places, and
    predicts its test rows from the closes before them. Each task adds up the normal equations of
    the origins it sees; Spark adds the parts, a row per origin, which is solved in its task.
    """
    past = looked(by_range(df.select("series", "ts", "close")), length, 0, lambda w: {"past": F.collect_list("close").over(w.rowsBetween(-length, -1))})
    rows = walk_forward(past, start, step, train, h, embargo)
    rows = rows.where((F.size("past") == length) & F.col("close").isNotNull())
    usable = rows.where((F.col("part") == "train") & (F.col("i") - length >= F.col("origin") - train)).select("origin", "past", F.col("close").alias("y"))
    d = length + 1

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            origin, y = np.asarray(batch.column("origin")), np.asarray(batch.column("y"), np.float64)
            x = np.column_stack([np.asarray(batch.column("past").flatten(), np.float64).reshape(-1, length), np.ones(len(y)), y])
            for o in np.unique(origin).tolist():
                own = x[origin == o]
                total[o] = total.get(o, 0) + own[:, :d].T @ own
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([t.ravel() for t in total.values()], pa.list_(pa.float64()))], names=["origin", "sums"])

    def solved(group: pa.Table) -> pa.Table:
        total = np.sum([np.asarray(x.values) for x in group.column("sums")], axis=0).reshape(d, d + 1)
        damp = ridge * np.eye(d)
        damp[-1, -1] = 0
        weights = np.linalg.lstsq(total[:, :d] + damp, total[:, d], rcond=None)[0]
        return pa.table({"origin": group.column("origin").slice(0, 1), "weights": pa.array([weights], pa.list_(pa.float64()))})

    models = usable.mapInArrow(sums, "origin bigint, sums array<double>").groupBy("origin").applyInArrow(solved, "origin bigint, weights array<double>")
    tests = rows.where("part = 'test'").join(models, "origin")
    products = F.zip_with(F.concat("past", F.array(F.lit(1.0))), "weights", lambda a, b: a * b)
    return tests.select("series", "origin", "ts", F.col("close").alias("y"), F.lit("pooled").alias("model"), F.aggregate(products, F.lit(0.0), lambda s, v: s + v).alias("yhat"))


def apply_forecaster(df: DataFrame, fn: Callable, schema: StructType | str) -> DataFrame:
    """A caller's function from one series' pandas frame to rows of a fixed schema."""
    return df.groupBy("series").applyInPandas(fn, schema)


def forecast_metrics(pred: DataFrame, by: list[str]) -> DataFrame:
    """Errors of predictions `(y, yhat)`: mean absolute, root mean square, percentage (y = 0
    left out), symmetric percentage (0 where both are 0), bias; and how often the sign was hit."""
    e = F.col("yhat") - F.col("y")
    symmetric = F.when((F.col("y") == 0) & (F.col("yhat") == 0), 0.0).otherwise(2 * F.abs(e) / (F.abs("y") + F.abs("yhat")))
    return pred.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.when(F.col("y") != 0, F.abs(e / F.col("y")))).alias("mape"),
        F.avg(symmetric).alias("smape"), F.avg(e).alias("bias"), F.avg(F.when(F.signum("yhat") == F.signum("y"), 1.0).otherwise(0.0)).alias("hit_rate"),
    )


def skill(pred: DataFrame, base: str = "mean") -> DataFrame:
    """1 - error / error of the base model, over the targets that both have."""
    keys = ["series", "origin", "horizon", "ts"]
    ref = pred.where(F.col("model") == base).select(*keys, F.abs(F.col("yhat") - F.col("y")).alias("base_error"))
    both = pred.where(F.col("model") != base).join(ref, keys)
    error = F.sum(F.abs(F.col("yhat") - F.col("y")))
    return both.groupBy("model", "horizon").agg(F.count("*").alias("n"), (1 - F.try_divide(error, F.sum("base_error"))).alias("skill"))


def equity(pred: DataFrame, cost: float) -> DataFrame:
    """`(series, ts, ret, yhat)` -> the path of a strategy that holds the forecast's sign:
    position, net return, cumulative return and drawdown."""
    moved = looked(by_range(pred.withColumn("position", F.signum("yhat"))), 1, 0, lambda w: {"turn": F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0.0)))})
    net = kept(moved.withColumn("net", F.col("position") * F.col("ret") - cost * F.col("turn")), "net")
    total = kept(summed(net, {"total": ("sum", F.col("net"))}), "total")
    top = summed(total, {"top": ("max", F.col("total"))})
    return top.withColumn("drawdown", F.greatest(F.lit(0.0), F.col("top")) - F.col("total")).drop("top", "_range")


def sharpe(path: DataFrame) -> DataFrame:
    """One row per series: total, worst drawdown, mean over deviation of net returns."""
    return path.groupBy("series").agg(F.count("*").alias("n"), F.max_by("total", "ts").alias("total"), F.max("drawdown").alias("worst"), F.try_divide(F.avg("net"), F.stddev_samp("net")).alias("sharpe"))


def regimes(df: DataFrame, rows: int = 24, past: int = 168) -> DataFrame:
    """Volatility (rolling deviation against its own mean over the `past` rows before) and
    trend (rolling slope against a tenth of the deviation), from trailing rows only."""

    def frames(step: DataFrame, keys: list[str]) -> DataFrame:
        w = W.partitionBy(*keys).orderBy("ts").rowsBetween(-(rows - 1), 0)
        return slope(rows, "close")(step.withColumns({"vol": F.stddev_samp("close").over(w), "full": F.count("*").over(w) == rows}), keys)

    vol = kept(framed(by_range(df.select("series", "ts", "close")), "series", ["ts"], rows - 1, 0, frames).where("full"), "vol")
    named = looked(vol, past, 0, lambda w: {"usual": F.avg("vol").over(w.rowsBetween(-past, -1))}).where("usual is not null")
    v = F.when(F.col("vol") > 1.25 * F.col("usual"), "high").when(F.col("vol") < 0.8 * F.col("usual"), "low").otherwise("mid")
    t = F.when(F.abs("slope") <= 0.1 * F.col("vol"), "flat").when(F.col("slope") > 0, "up").otherwise("down")
    return named.select("series", "ts", v.alias("volatility"), t.alias("trend"))


def regime_runs(df: DataFrame, label: str) -> DataFrame:
    """Runs of equal labels: first and last time, and number of rows."""
    new = lambda w: {"new": F.when(F.col(label).eqNullSafe(F.lag(label).over(w)) & F.lag("ts").over(w).isNotNull(), 0).otherwise(1).cast("bigint")}
    marked = kept(looked(by_range(df.select("series", "ts", label)), 1, 0, new), "marked")
    return summed(marked, {"run": ("sum", F.col("new"))}).groupBy("series", "run", label).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"))


def transitions(df: DataFrame, label: str, values: list[str]) -> DataFrame:
    """How often each label is followed by each, wide by the next."""
    pairs = looked(by_range(df.select("series", "ts", F.col(label).alias("now"))), 0, 1, lambda w: {"next": F.lead("now").over(w)}).where("next is not null")
    return pairs.groupBy("now").pivot("next", values).count().na.fill(0)


def metrics_by_regime(pred: DataFrame, regimes: DataFrame) -> DataFrame:
    """Forecast errors by model and regime, with subtotals over either."""
    joined = pred.join(regimes.select("series", "ts", "volatility"), ["series", "ts"])
    e = F.abs(F.col("yhat") - F.col("y"))
    return joined.cube("model", "volatility").agg(F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("n"), F.avg(e).alias("mae"))


def drift(reference: DataFrame, current: DataFrame, cols: list[str], bins: int = 10) -> DataFrame:
    """Population stability index over bins at the reference's quantiles, and the two-sample
    Kolmogorov-Smirnov distance, per column. Both come from counts of distinct values and their
    running sums, dealt by ranges of the values."""
    long = lambda df, side: df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "name", "x").where("x is not null").withColumn("side", F.lit(side))
    n = lambda s: F.count_if(F.col("side") == s).alias(s)
    values = kept(long(reference, "r").unionByName(long(current, "c")).groupBy("name", "x").agg(n("r"), n("c")), "values")
    totals = values.groupBy("name").agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"))
    cuts = quantiles(values.where("r > 0"), "name", "x", "r", [i / bins for i in range(1, bins)])
    place = F.aggregate("q", F.lit(0), lambda n, c: n + F.when(F.col("x") > c, 1).otherwise(0)).alias("bin")
    placed = values.join(F.broadcast(cuts), "name").select("name", place, "r", "c")  # a row per column
    shares = placed.groupBy("name", "bin").agg(F.sum("r").alias("r"), F.sum("c").alias("c")).join(totals, "name")
    r, c = (F.greatest(F.lit(1e-6), F.col(a) / F.col(b)) for a, b in (("r", "nr"), ("c", "nc")))
    psi = shares.groupBy("name").agg(F.sum((c - r) * F.log(c / r)).alias("psi"))
    run = running_counts(values, "name", "x", ["r", "c"]).join(F.broadcast(totals), "name")
    gap = F.abs(F.col("r_upto") / F.col("nr") - F.col("c_upto") / F.col("nc"))
    return psi.join(run.groupBy("name").agg(F.max(gap).alias("ks")), "name")


def control_chart(df: DataFrame, k: float, past: int, recent: int) -> DataFrame:
    """Flags where the mean of the last `recent` errors is above the mean + k deviations of
    the `past` errors before the current row."""

    def frames(w: WindowSpec) -> dict[str, Column]:
        before = w.rowsBetween(-past, -1)
        return {"now": F.avg("error").over(w.rowsBetween(-(recent - 1), 0)), "limit": F.avg("error").over(before) + k * F.stddev_samp("error").over(before)}

    out = looked(by_range(df.select("series", "ts", "error")), max(past, recent - 1), 0, frames)
    return out.select("series", "ts", "error", "now", "limit", F.coalesce(F.col("now") > F.col("limit"), F.lit(False)).alias("flag"))


def alert_candidates(df: DataFrame, level: float, move: float, lookback: int) -> DataFrame:
    """Rows that set off a rule: the price crosses `level` upwards, or has moved by the share `move`
    over `lookback` rows. Ticks are dealt by ranges of (series, ts, id), so a long series is spread;
    the first rows of a range look back to the last rows of those before, which alone are
    brought together."""
    columns = df.columns
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(df.repartitionByRange(ranges, "series", "ts", "id").withColumn("_range", F.spark_partition_id()), "ticks")
    own, up, down = (W.partitionBy("series", "_range").orderBy(*o) for o in (["ts", "id"], ["ts", "id"], [F.col("ts").desc(), F.col("id").desc()]))
    look = lambda w: {"_past": F.lag("price").over(w), "_far": F.lag("price", lookback).over(w)}
    placed = dealt.withColumns({"_first": F.row_number().over(up), "_last": F.row_number().over(down), **look(own)})
    edges = placed.where((F.col("_first") <= lookback) | (F.col("_last") <= lookback))
    edges = edges.withColumns(look(W.partitionBy("series").orderBy("ts", "id"))).where(F.col("_first") <= lookback)
    seen = placed.where(F.col("_first") > lookback).unionByName(edges)
    cross = (F.col("_past") < level) & (F.col("price") >= level)
    moved = F.abs(F.try_divide(F.col("price") - F.col("_far"), F.col("_far"))) >= move
    rules = F.array(F.when(cross, F.lit("cross")), F.when(moved, F.lit("move")))
    return seen.select(*columns, F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))


def cool_down(candidates: DataFrame, seconds: int) -> DataFrame:
    """Of each series' and rule's candidates, in (ts, id) order, those that come `seconds` or more
    after the last one emitted. Where two candidates lie so far apart, the second is emitted
    whatever came before; so each stretch between such gaps is a group of its own, in which a
    binary search leads from one emitted candidate to the next."""
    columns = ["series", "rule", "id", "ts", "price"]
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    order = W.partitionBy("series", "rule").orderBy("ts", "id")
    gap = F.when(us - F.lag(us).over(order) < seconds * 1_000_000, 0).otherwise(1)
    marked = candidates.select(*columns, us.alias("us"), gap.alias("new"))
    stretches = marked.withColumn("stretch", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("new")

    def emitted(group: pa.Table) -> pa.Table:
        group = group.sort_by([("ts", "ascending"), ("id", "ascending")])
        at, rows, i = group.column("us").to_numpy(), [], 0
        while i < len(at):
            rows.append(i)
            i = int(np.searchsorted(at, at[i] + seconds * 1_000_000))
        return group.take(pa.array(rows, pa.int64())).select(columns)

    return stretches.groupBy("series", "rule", "stretch").applyInArrow(emitted, StructType([candidates.schema[c] for c in columns]))


def price_alerts(df: DataFrame, level: float, move: float, lookback: int, seconds: int) -> DataFrame:
    """`(series, ts, id, price)` -> alerts `(series, rule, id, ts, price)`."""
    return cool_down(alert_candidates(df, level, move, lookback), seconds)
