"""Registered queries of time series, forecasting and monitoring (T), batch part."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import series as T
from orrery.plans.registry import register
from orrery.plans.views import sql
from orrery.sources.tables import table

BARS = """
bars as (
  select event_type as series, time_bucket(interval '1 hour', ts) as ts, arg_min(value, struct_pack(a := ts, b := event_id)) as open, max(value) as high, min(value) as low,
         arg_max(value, struct_pack(a := ts, b := event_id)) as close, count(*) as n
  from events group by 1, 2)"""

HOURS = """
grid as (select series, unnest(generate_series(min(ts), max(ts), interval '1 hour')) as ts from bars group by series),
hours as (
  select series, ts, last_value(close ignore nulls) over (partition by series order by ts rows between unbounded preceding and current row) as close, coalesce(n, 0) as n
  from grid left join bars using (series, ts))"""

FOLDS = """
placed as (select *, row_number() over (partition by series order by ts) - 1 as i from hours),
origins as (select series, i as origin from placed where i >= 240 and (i - 240) % 120 = 0),
folds as (
  select p.*, origin, case when i >= origin then 'test' else 'train' end as part
  from placed p join origins using (series) where i >= origin - 240 and i < origin + 24 and (i >= origin or i < origin - 24))"""

BASE = """
train as (
  select series, origin, arg_max(close, i) as last, arg_min(close, i) as first, max(i) as b, min(i) as a, avg(close) as mean,
         regr_slope(close, past) as slope, regr_intercept(close, past) as inter
  from (select *, lag(close) over (partition by series, origin order by i) as past from folds where part = 'train') group by 1, 2),
tests as (select series, origin, ts, i, i - origin + 1 as horizon, close as y from folds where part = 'test'),
seasons as (
  select t.series, t.origin, t.i, f.close from tests t join train using (series, origin)
  join folds f on f.series = t.series and f.origin = t.origin and f.part = 'train' and f.i >= b - 23 and f.i % 24 = t.i % 24),
pred as (
  select series, origin, ts, horizon, y, 'last' as model, last as yhat from tests join train using (series, origin)
  union all select t.series, t.origin, t.ts, horizon, y, 'seasonal', coalesce(s.close, last) from tests t join train using (series, origin) left join seasons s on s.series = t.series and s.origin = t.origin and s.i = t.i
  union all select series, origin, ts, horizon, y, 'mean', mean from tests join train using (series, origin)
  union all select series, origin, ts, horizon, y, 'drift', last + (last - first) / (b - a) * (i - b) from tests join train using (series, origin)),
ar as (
  select series, origin, ts, horizon, y, 'ar1' as model, pow(slope, i - b) * last + inter * (pow(slope, i - b) - 1) / (slope - 1) as yhat from tests join train using (series, origin)),
preds as (select * from pred union all select * from ar)"""


def r(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols})


def bars(spark: SparkSession, sf: str) -> DataFrame:
    return T.bars(table(spark, sf, "events"), "event_type", "ts", "value", "1 hour", "event_id")


def hours(spark: SparkSession, sf: str) -> DataFrame:
    return T.gap_fill(bars(spark, sf), "1 hour")


def folds(spark: SparkSession, sf: str) -> DataFrame:
    return T.walk_forward(hours(spark, sf), 240, 120, 240, 24, 24)


def preds(spark: SparkSession, sf: str) -> DataFrame:
    f = folds(spark, sf)
    return T.baselines(f, 24).unionByName(T.ar1(f))


@register("t1_bars", sql(BARS, "select * from bars"))
def t1(spark, sf):
    return bars(spark, sf)


@register("t2_gap_fill", sql(BARS, HOURS, "select * from hours"))
def t2(spark, sf):
    return hours(spark, sf)


@register("t3_returns", sql(BARS, HOURS, "select series, ts, close, n, lead(close) over w as next_close, " + ", ".join(
    f"lag(close, {k}) over w as lag_{k}, round((close - lag(close, {k}) over w) / nullif(lag(close, {k}) over w, 0), 6) as ret_{k}, "
    f"case when close > 0 and lag(close, {k}) over w > 0 then round(ln(close / lag(close, {k}) over w), 6) end as log_ret_{k}" for k in (1, 24))
    + " from hours window w as (partition by series order by ts)"))
def t3(spark, sf):
    return r(T.returns(hours(spark, sf), [1, 24]), "ret_1", "log_ret_1", "ret_24", "log_ret_24")


ROLL = """
roll as (
  select series, ts, close, avg(close) over w as mean, stddev_samp(close) over w as sd, min(close) over w as low, max(close) over w as high,
    regr_slope(close, i::double) over w as slope, avg(close) over (partition by series order by ts range between interval '21599 seconds' preceding and current row) as time_mean
  from (select *, row_number() over (partition by series order by ts) as i from hours) window w as (partition by series order by ts rows between 23 preceding and current row))"""


@register("t4_rolling", sql(BARS, HOURS, ROLL, """
select series, ts, close, round(mean, 6) as mean, round(sd, 6) as sd, low, high, round((close - mean) / nullif(sd, 0), 6) as z, round(slope, 6) as slope, round(time_mean, 6) as time_mean from roll"""))
def t4(spark, sf):
    return r(T.rolling(hours(spark, sf), 24, 6 * 3600), "mean", "sd", "z", "slope", "time_mean")


@register("t5_calendar", sql(BARS, HOURS, """
select series, ts, close, n, hour(ts)::int as hour, (dayofweek(ts) + 1)::int as weekday, month(ts)::int as month, round(sin(2 * pi() * hour(ts) / 24), 6) as hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) as hour_cos,
  round(sin(2 * pi() * (dayofweek(ts) + 1) / 7), 6) as day_sin, round(cos(2 * pi() * (dayofweek(ts) + 1) / 7), 6) as day_cos from hours"""))
def t5(spark, sf):
    return r(T.calendar(hours(spark, sf), "ts"), "hour_sin", "hour_cos", "day_sin", "day_cos")


@register("t6_asof", """
select l.event_id, l.user_id, l.ts, case when r.ts >= l.ts - interval '6 hours' then r.ts end as right_ts, case when r.ts >= l.ts - interval '6 hours' then r.value end as value
from (select * from events where event_id % 2 = 0) l asof left join (select * from events where event_id % 2 = 1) r on l.user_id = r.user_id and l.ts >= r.ts""")
def t6(spark, sf):
    events = table(spark, sf, "events")
    return T.asof(events.where("event_id % 2 = 0").select("event_id", "user_id", "ts"), events.where("event_id % 2 = 1").select("user_id", "ts", "value"), "user_id", "ts", "value", "6 hours")


@register("t7_context_windows", sql(BARS, HOURS, """
select * from (select series, ts, list(close) over (partition by series order by ts rows between 23 preceding and current row) as context,
  lead(close, 1) over w as target_1, lead(close, 2) over w as target_2, lead(close, 3) over w as target_3
from hours window w as (partition by series order by ts)) where len(context) = 24"""))  # fmt: skip
def t7(spark, sf):
    return T.context_windows(hours(spark, sf), 24, 3)


@register("t8_scale_by_fold", sql(BARS, HOURS, FOLDS, """
select series, origin, ts, i, part, close, round((close - mean) / nullif(sd, 0), 6) as scaled
from folds join (select series, origin, avg(close) as mean, stddev_samp(close) as sd from folds where part = 'train' group by 1, 2) using (series, origin)"""))  # fmt: skip
def t8(spark, sf):
    return r(T.scale_by_fold(folds(spark, sf)), "scaled").select("series", "origin", "ts", "i", "part", "close", "scaled")


@register("t9_walk_forward", sql(BARS, HOURS, FOLDS, "select series, ts, close, n, i, origin, part from folds"))
def t9(spark, sf):
    return folds(spark, sf)


PRED_COLUMNS = "select series, origin, ts, horizon, y, model, round(yhat, 6) as yhat from "


@register("t10_baselines", sql(BARS, HOURS, FOLDS, BASE, PRED_COLUMNS + "pred"))
def t10(spark, sf):
    return r(T.baselines(folds(spark, sf), 24), "yhat")


@register("t11_ar1", sql(BARS, HOURS, FOLDS, BASE, PRED_COLUMNS + "ar"))
def t11(spark, sf):
    return r(T.ar1(folds(spark, sf)), "yhat")


@register("t12_fit_pooled")
def t12(spark, sf):
    return r(T.fit_pooled(hours(spark, sf), 12, 240, 120, 240, 24, 24), "yhat")


def last_day(frame: pd.DataFrame) -> pd.DataFrame:
    """A forecaster of the simplest kind: the mean of the last 24 closes, for six steps."""
    frame = frame.sort_values("ts")
    return pd.DataFrame({"series": frame["series"].iloc[0], "horizon": range(1, 7), "yhat": round(float(frame["close"].tail(24).mean()), 6)})


@register("t13_apply_forecaster", sql(BARS, HOURS, """
select series, h as horizon, yhat from (
  select series, round(avg(close), 6) as yhat from (select *, row_number() over (partition by series order by ts desc) as k from hours) where k <= 24 group by series), range(1, 7) as t(h)"""))  # fmt: skip
def t13(spark, sf):
    return T.apply_forecaster(hours(spark, sf), last_day, "series string, horizon bigint, yhat double")


METRICS = """
select model, horizon, origin, count(*) as n, round(avg(abs(yhat - y)), 6) as mae, round(sqrt(avg((yhat - y) * (yhat - y))), 6) as rmse,
  round(avg(case when y <> 0 then abs((yhat - y) / y) end), 6) as mape, round(avg(case when y = 0 and yhat = 0 then 0 else 2 * abs(yhat - y) / (abs(y) + abs(yhat)) end), 6) as smape,
  round(avg(yhat - y), 6) as bias, round(avg(case when sign(yhat) = sign(y) then 1.0 else 0.0 end), 6) as hit_rate
from preds group by model, horizon, origin"""


@register("t14_forecast_metrics", sql(BARS, HOURS, FOLDS, BASE, METRICS))
def t14(spark, sf):
    return r(T.forecast_metrics(preds(spark, sf), ["model", "horizon", "origin"]), "mae", "rmse", "mape", "smape", "bias", "hit_rate")


@register("t15_skill", sql(BARS, HOURS, FOLDS, BASE, """
select p.model, p.horizon, count(*) as n, round(1 - sum(abs(p.yhat - p.y)) / nullif(sum(abs(b.yhat - b.y)), 0), 6) as skill
from preds p join preds b on b.model = 'mean' and b.series = p.series and b.origin = p.origin and b.horizon = p.horizon and b.ts = p.ts
where p.model <> 'mean' group by 1, 2"""))  # fmt: skip
def t15(spark, sf):
    return r(T.skill(preds(spark, sf)), "skill")


EQUITY = """
signal as (
  select series, ts, coalesce((close - lag(close) over w) / nullif(lag(close) over w, 0), 0) as ret, coalesce(lag(mean - close) over w, 0) as yhat
  from roll window w as (partition by series order by ts)),
held as (select *, sign(yhat)::double as position from signal),
turned as (select *, abs(position - coalesce(lag(position) over (partition by series order by ts), 0)) as turn from held),
net as (select *, position * ret - 0.001 * turn as net from turned),
total as (select *, sum(net) over (partition by series order by ts rows unbounded preceding) as total from net),
path as (select *, greatest(0, max(total) over (partition by series order by ts rows unbounded preceding)) - total as drawdown from total)"""


def equity(spark, sf):
    from pyspark.sql import Window as W

    w = W.partitionBy("series").orderBy("ts")
    roll = T.rolling(hours(spark, sf), 24, 3600)
    past = F.lag("close").over(w)
    signal = roll.select("series", "ts", F.coalesce(F.try_divide(F.col("close") - past, past), F.lit(0.0)).alias("ret"), F.coalesce(F.lag(F.col("mean") - F.col("close")).over(w), F.lit(0.0)).alias("yhat"))
    # a mean that equals the close but for its last digits is no signal
    return T.equity(signal.withColumn("yhat", F.round("yhat", 9)), 0.001)


@register("t16_equity", sql(BARS, HOURS, ROLL, EQUITY.replace("lag(mean - close) over w, 0)", "round(lag(mean - close) over w, 9), 0)"), """
select series, ts, position, round(net, 6) as net, round(total, 4) as total, round(drawdown, 4) as drawdown from path"""))  # fmt: skip
def t16(spark, sf):
    return r(r(equity(spark, sf), "net"), "total", "drawdown", places=4).select("series", "ts", "position", "net", "total", "drawdown")


@register("t16_sharpe", sql(BARS, HOURS, ROLL, EQUITY.replace("lag(mean - close) over w, 0)", "round(lag(mean - close) over w, 9), 0)"), """
select series, count(*) as n, round(arg_max(total, ts), 4) as total, round(max(drawdown), 4) as worst, round(avg(net) / stddev_samp(net), 4) as sharpe from path group by series"""))  # fmt: skip
def t16_sharpe(spark, sf):
    return r(T.sharpe(equity(spark, sf)), "total", "worst", "sharpe", places=4)


REGIMES = """
vol as (
  select * from (select series, ts, close, i, stddev_samp(close) over w as vol, regr_slope(close, i::double) over w as slope
  from (select *, row_number() over (partition by series order by ts) as i from hours) window w as (partition by series order by ts rows between 23 preceding and current row)) where i >= 24),
usual as (select *, avg(vol) over (partition by series order by ts rows between 168 preceding and 1 preceding) as usual from vol),
regime as (
  select series, ts, case when vol > 1.25 * usual then 'high' when vol < 0.8 * usual then 'low' else 'mid' end as volatility,
    case when abs(slope) <= 0.1 * vol then 'flat' when slope > 0 then 'up' else 'down' end as trend
  from usual where usual is not null)"""


def regimes(spark, sf):
    return T.regimes(hours(spark, sf))


@register("t17_regimes", sql(BARS, HOURS, REGIMES, "select * from regime"))
def t17(spark, sf):
    return regimes(spark, sf)


@register("t18_regime_runs", sql(BARS, HOURS, REGIMES, """
select series, run, volatility, min(ts) as start, max(ts) as end, count(*) as n from (
  select *, sum(new) over (partition by series order by ts rows unbounded preceding)::bigint as run from (
    select *, case when volatility = lag(volatility) over (partition by series order by ts) then 0 else 1 end as new from regime))
group by series, run, volatility""".replace("as end", 'as "end"')))  # fmt: skip
def t18(spark, sf):
    return T.regime_runs(regimes(spark, sf), "volatility")


@register("t19_transitions", sql(BARS, HOURS, REGIMES, """
select now, count(*) filter (next = 'low') as low, count(*) filter (next = 'mid') as mid, count(*) filter (next = 'high') as high
from (select volatility as now, lead(volatility) over (partition by series order by ts) as next from regime) where next is not null group by now"""))  # fmt: skip
def t19(spark, sf):
    return T.transitions(regimes(spark, sf), "volatility", ["low", "mid", "high"])


@register("t20_metrics_by_regime", sql(BARS, HOURS, FOLDS, BASE, REGIMES, """
select model, volatility, grouping(model, volatility)::bigint as level, count(*) as n, round(avg(abs(yhat - y)), 6) as mae
from preds join regime using (series, ts) group by cube (model, volatility)"""))  # fmt: skip
def t20(spark, sf):
    return r(T.metrics_by_regime(preds(spark, sf), regimes(spark, sf)), "mae")


@register("t21_drift", """
with long as (
  select 'value' as name, value as x, case when ts < '2024-01-16' then 'r' else 'c' end as side from events
  union all select 'k', json_extract_string(props, '$.k')::double, case when ts < '2024-01-16' then 'r' else 'c' end from events),
cuts as (select name, """ + ", ".join(f"quantile_cont(x, {i / 10}) as c{i}" for i in range(1, 10)) + """ from long where side = 'r' group by name),
placed as (select l.name, x, side, """ + " + ".join(f"(x > c{i})::int" for i in range(1, 10)) + """ as bin from long l join cuts using (name)),
totals as (select name, count(*) filter (side = 'r') as nr, count(*) filter (side = 'c') as nc from long group by name),
shares as (select name, bin, greatest(1e-6, count(*) filter (side = 'r') / max(nr)) as r, greatest(1e-6, count(*) filter (side = 'c') / max(nc)) as c from placed join totals using (name) group by name, bin),
runs as (select name, x, sum(count(*) filter (side = 'r')) over w as rc, sum(count(*) filter (side = 'c')) over w as cc from long group by name, x window w as (partition by name order by x rows unbounded preceding)),
ks as (select name, max(abs(rc / nr - cc / nc)) as ks from runs join totals using (name) group by name)
select s.name, round(sum((c - r) * ln(c / r)), 6) as psi, round(max(ks), 6) as ks from shares s join ks using (name) group by s.name""")  # fmt: skip
def t21(spark, sf):
    rows = table(spark, sf, "events").select("ts", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    return r(T.drift(rows.where("ts < '2024-01-16'"), rows.where("ts >= '2024-01-16'"), ["value", "k"]), "psi", "ks")


@register("t22_control_chart", sql(BARS, HOURS, ROLL, """
err as (select series, ts, abs(close - mean) as error from roll),
chart as (
  select series, ts, error, avg(error) over (partition by series order by ts rows between 5 preceding and current row) as now,
    avg(error) over p + 1.0 * stddev_samp(error) over p as lim
  from err window p as (partition by series order by ts rows between 168 preceding and 1 preceding))""",
  'select series, ts, round(error, 6) as error, round(now, 6) as now, round(lim, 6) as "limit", coalesce(now > lim, false) as flag from chart'))
def t22(spark, sf):
    errors = T.rolling(hours(spark, sf), 24, 3600).select("series", "ts", F.abs(F.col("close") - F.col("mean")).alias("error"))
    return r(T.control_chart(errors, 1.0, 168, 6), "error", "now", "limit")


ALERTS = """
ticks as (select event_type as series, ts, event_id as id, value as price from events),
moves as (select *, lag(price) over w as past, lag(price, 3) over w as far from ticks window w as (partition by series order by ts, id)),
cand as (
  select series, 'cross' as rule, ts, id, price from moves where past < 60 and price >= 60
  union all select series, 'move', ts, id, price from moves where abs((price - far) / nullif(far, 0)) >= 2),
numbered as (select *, row_number() over (partition by series, rule order by ts, id) as n from cand),
nexts as (
  select a.series, a.rule, a.n, min(b.n) as nxt from numbered a left join numbered b
  on a.series = b.series and a.rule = b.rule and b.ts >= a.ts + interval '6 hours' group by 1, 2, 3),
em as (
  select series, rule, 1::bigint as n from numbered where n = 1
  union all select e.series, e.rule, x.nxt from em e join nexts x on x.series = e.series and x.rule = e.rule and x.n = e.n where x.nxt is not null)"""

ALERT_RULES = {"level": 60.0, "move": 2.0, "lookback": 3, "seconds": 6 * 3600}


def ticks(spark, sf):
    return table(spark, sf, "events").select(F.col("event_type").alias("series"), "ts", F.col("event_id").alias("id"), F.col("value").alias("price"))


@register("t23_price_alerts", "with recursive" + ALERTS + "\nselect series, rule, id, ts, price from em join numbered using (series, rule, n)")
def t23(spark, sf):
    return T.price_alerts(ticks(spark, sf), **ALERT_RULES)
