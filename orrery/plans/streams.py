"""Registered queries of the streaming operators: the events table replayed in several files,
some rows repeated or late, ending with rows far in the future that close what is open."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.plans.registry import register
from orrery.plans.series import ALERT_RULES, ALERTS, r
from orrery.plans.views import sql
from orrery.plans.learning import SESSION_ROWS, SESSIONS
from orrery.sources.shared import new_folder
from orrery.sources.tables import table
from orrery.streaming import streams as S

#: Batches of a replay at least, and rows of a batch and of a file at most.
BATCHES, BATCH_ROWS, FILE_ROWS = 3, 50_000_000, 1_000_000
DAY = 86_400_000_000  # in microseconds


def replayed(spark: SparkSession, sf: str, twice: bool = False) -> DataFrame:
    """The events as a stream, cut by time into batches of about equally many rows, each of as many
    files as its size asks for. Rows of a batch's last day with an event_id divisible by 50 come
    with the next one (late, but within two days); with `twice`, a tenth of all comes twice."""
    events = table(spark, sf, "events")
    total = events.count()
    batches = max(BATCHES, math.ceil(total / BATCH_ROWS))
    files = max(1, math.ceil(total / batches / FILE_ROWS))
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = events.agg(F.percentile_approx(us, [i / batches for i in range(1, batches)])).first()[0] or []
    ends = F.array(*[F.lit(c).cast("bigint") for c in cuts]).cast("array<bigint>")
    part = F.aggregate(ends, F.lit(0), lambda n, c: n + F.when(us > c, 1).otherwise(0))
    late = (F.col("event_id") % 50 == 0) & F.coalesce(F.try_element_at(ends, F.col("part") + 1) - us < DAY, F.lit(False))
    placed = events.withColumn("part", part).withColumn("part", F.col("part") + F.when(late, 1).otherwise(0))
    path = new_folder(spark, "replay")
    spread = lambda df: df.repartition(files) if files > 1 else df.coalesce(1)  # noqa: E731  a trigger takes one batch's files
    for i in range(batches):
        rows = placed.where(F.col("part") == i).drop("part")
        if twice:
            rows = rows.unionByName(rows.where("event_id % 10 = 0"))
        spread(rows).write.mode("append").parquet(path)
    for year in (2030, 2031, 2032):  # a row in each of a batch's files
        end = spark.range(0, files, 1, files).select((-year - F.col("id") * 10_000).alias("event_id"), F.lit(f"{year}-01-01 00:00:00").cast("timestamp_ntz").alias("ts"), F.lit(-1).cast("bigint").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
        end.write.mode("append").parquet(path)
    return S.replay(spark, path, events.schema, files=files)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """All that a stream appends, as a table with times without zone."""
    spark = stream.sparkSession
    path, mark = new_folder(spark, name), new_folder(spark, f"{name}-progress")
    S.alert_sink(stream, path, mark).awaitTermination()
    out = spark.read.schema(stream.schema).parquet(f"{path}/batch=*")
    return out.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in out.schema if f.dataType.typeName() == "timestamp"})


STREAM_BARS = "select event_type as series, time_bucket(interval '6 hours', ts) as ts, count(*) as n, min(value) as low, max(value) as high, round(sum(value), 4) as total from events group by 1, 2"


@register("t24_stream_alerts", "with recursive" + ALERTS + "\nselect series, rule, id, ts, price from em join numbered using (series, rule, n)")
def t24(spark, sf):
    spark.conf.set(*S.STATE_STORE)
    ticks = replayed(spark, sf).select(F.col("event_type").alias("series"), "ts", F.col("event_id").alias("id"), F.col("value").alias("price"))
    return drained(S.stream_alerts(ticks, delay="2 days", **ALERT_RULES), "alerts").where("series <> 'end'")


@register("t25_stream_bars", STREAM_BARS)
def t25(spark, sf):
    return r(drained(S.stream_bars(replayed(spark, sf), "event_type", "6 hours", None, "2 days"), "bars"), "total", places=4).where("series <> 'end'")


@register("t25_stream_bars_sliding", """
select event_type as series, t as ts, count(*) as n, min(value) as low, max(value) as high, round(sum(value), 4) as total
from (select *, unnest([time_bucket(interval '6 hours', ts), time_bucket(interval '6 hours', ts) - interval '6 hours']) as t from events) group by 1, 2""")
def t25_sliding(spark, sf):
    return r(drained(S.stream_bars(replayed(spark, sf), "event_type", "12 hours", "6 hours", "2 days"), "slides"), "total", places=4).where("series <> 'end'")


@register("t26_stream_dedup", "select event_id, user_id, event_type, value from events")
def t26(spark, sf):
    rows = S.stream_dedup(replayed(spark, sf, twice=True), ["event_id"], "40 days")
    return drained(rows, "dedup").where("event_type <> 'end'").select("event_id", "user_id", "event_type", "value")


@register("t27_stream_resolve", """
select f.event_id as forecast_id, a.event_id as actual_id, f.user_id, f.value as yhat, a.value as y
from events f join events a on f.user_id = a.user_id and a.ts >= f.ts and a.ts <= f.ts + interval '3 hours' where f.event_id % 2 = 0 and a.event_id % 2 = 1""")
def t27(spark, sf):
    forecasts = replayed(spark, sf).where("event_id % 2 = 0 and event_type <> 'end'").select(F.col("event_id").alias("forecast_id"), "user_id", F.col("ts").alias("made_at"), F.col("value").alias("yhat"))
    actuals = replayed(spark, sf).where("event_id % 2 = 1 and event_type <> 'end'").select(F.col("event_id").alias("actual_id"), "user_id", F.col("ts").alias("seen_at"), F.col("value").alias("y"))
    return drained(S.stream_resolve(forecasts, actuals, "user_id", "3 hours", "40 days"), "resolved").select("forecast_id", "actual_id", "user_id", "yhat", "y")


@register("t28_alert_sink", "select event_id, event_type, value from events where value > 90")
def t28(spark, sf):
    return drained(replayed(spark, sf).where("value > 90").select("event_id", "event_type", "value"), "high")


@register("r11_stream_sessions", sql(SESSIONS, SESSION_ROWS))
def r11_stream(spark, sf):
    return r(drained(S.stream_sessions(replayed(spark, sf), "4 hours", "2 days"), "sessions").where("user_id >= 0"), "total", places=4)
