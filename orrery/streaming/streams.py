"""Structured Streaming forms of the monitoring operators. Event times are TIMESTAMP (watermarks
refuse TIMESTAMP_NTZ), in UTC."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType


def replay(spark: SparkSession, path: str, schema: StructType, ts: str = "ts", files: int = 1) -> DataFrame:
    """A stream of the files of a folder, `files` to a batch in the order of their times."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def stream_bars(sdf: DataFrame, series: str, width: str, slide: str | None, delay: str) -> DataFrame:
    """Count, range and sum per series and window, tumbling or sliding; rows later than the
    watermark are dropped."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (
        sdf.withWatermark("ts", delay).groupBy(F.col(series).alias("series"), window.alias("w"))
        .agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.sum("value").alias("total"))
        .select("series", F.col("w.start").alias("ts"), "n", "low", "high", "total")
    )


def stream_dedup(sdf: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """The first of repeated ticks; state is kept for `delay` behind the newest tick."""
    return sdf.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def stream_resolve(forecasts: DataFrame, actuals: DataFrame, key: str, bound: str, delay: str) -> DataFrame:
    """Forecasts `(key, made_at, yhat)` with the actuals `(key, seen_at, y)` that follow within
    `bound`."""
    f = forecasts.withWatermark("made_at", delay)
    a = actuals.withWatermark("seen_at", delay).withColumnRenamed(key, f"{key}_seen")
    near = F.expr(f"seen_at >= made_at and seen_at <= made_at + interval {bound}")
    return f.join(a, (F.col(key) == F.col(f"{key}_seen")) & near).drop(f"{key}_seen")


def stream_sessions(sdf: DataFrame, gap: str, delay: str) -> DataFrame:
    """Sessions as in batch, each once the watermark has passed its end."""
    from orrery.operators.learner import sessions

    return sessions(sdf.withWatermark("ts", delay), gap)


#: The store of state that stream_alerts needs: it writes changes only, and keeps state on disk.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def rising(us: np.ndarray, last: int, gap: int) -> list[int]:
    """Places in the sorted times `us` at which a rule speaks that then is silent for `gap`, having last
    spoken at `last`."""
    out, i = [], int(np.searchsorted(us, last + gap))
    while i < len(us):
        out.append(i)
        i = max(i + 1, int(np.searchsorted(us, int(us[i]) + gap)))
    return out


class AlertRules(StatefulProcessor):
    """The state of one series: its waiting ticks as a list of blocks (a row for many ticks, as arrays of
    bytes) that new ones are appended to, and one value: how far ticks have been taken, the next
    timer, the last prices and the last alert times.

    A timer fires when the watermark has passed the earliest tick that waits; what it has passed is
    then taken in order. Ticks that were taken stay in the list until they are half of it, and are
    skipped meanwhile: so rewriting the list costs no more than the ticks that came. Ticks are
    handled as arrays; only alerts are looped over."""

    TICKS = "us binary, id binary, price binary"
    MARKS = "taken bigint, timer bigint, gone bigint, prices array<double>, last array<bigint>"
    KINDS = (np.int64, np.int64, np.float64)
    BLOCK = 65_536  # ticks of a row of the list at most
    NEVER = -(1 << 62)

    def __init__(self, level: float, move: float, lookback: int, seconds: int):
        self.level, self.move, self.lookback, self.seconds = level, move, lookback, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.TICKS)
        self.marks = handle.getValueState("marks", self.MARKS)

    def state(self) -> tuple[int, int, int, list[float], list[int]]:
        if self.marks.exists():
            taken, timer, gone, prices, last = self.marks.get()
            return taken, timer, gone, list(prices), list(last)
        return self.NEVER, 0, 0, [], [self.NEVER, self.NEVER]

    def wake(self, timer: int, us: int) -> int:
        """A timer for a tick at `us`, if there is no earlier one."""
        at = us // 1000 + 1
        if timer and timer <= at:
            return timer
        if timer:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)
        return at

    def blocks(self, ticks: list[np.ndarray]) -> list[tuple[bytes, ...]]:
        return [tuple(c[i : i + self.BLOCK].tobytes() for c in ticks) for i in range(0, len(ticks[0]), self.BLOCK)]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        taken, timer, gone, prices, last = self.state()
        for frame in rows:
            if len(frame):
                us = frame["ts"].astype("datetime64[us]").astype("int64")
                columns = (us, frame["id"], frame["price"])
                self.waiting.appendList(self.blocks([c.to_numpy(kind) for c, kind in zip(columns, self.KINDS, strict=True)]))
                timer = self.wake(timer, int(us.min()))
        self.marks.update((taken, timer, gone, prices, last))
        yield alerts([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        taken, _, gone, prices, last = self.state()
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        parts = list(self.waiting.get())
        ticks = [np.concatenate([np.frombuffer(p[c], kind) for p in parts] or [np.zeros(0, kind)]) for c, kind in enumerate(self.KINDS)]
        ready, later = ([c[which] for c in ticks] for which in ((ticks[0] > taken) & (ticks[0] <= mark), ticks[0] > mark))
        us, ids, price = (c[np.lexsort(ready[::-1])] for c in ready)
        past = np.concatenate([np.full(self.lookback, np.nan), np.array(prices, np.float64), price])  # no rule fires on what isn't there
        n = len(price)
        before, far = past[len(past) - n - 1 : len(past) - 1], past[len(past) - n - self.lookback : len(past) - self.lookback]
        with np.errstate(all="ignore"):
            hits = [(before < self.level) & (price >= self.level), (far != 0) & (np.abs((price - far) / far) >= self.move)]
        out = []
        for r, name in enumerate(("cross", "move")):
            at = np.flatnonzero(hits[r])
            for i in at[rising(us[at], last[r], self.seconds * 1_000_000)].tolist():
                last[r] = int(us[i])
                out.append((i, (key[0], name, int(ids[i]), last[r], float(price[i]))))
        prices = [*prices, *price[-self.lookback :].tolist()][-self.lookback :]
        gone, left = gone + n, len(later[0])
        if not left:
            self.waiting.clear()
            gone = 0
        elif gone >= left:
            self.waiting.put(self.blocks(later))
            gone = 0
        timer = self.wake(0, int(later[0].min())) if left else 0
        self.marks.update((mark, timer, gone, prices, last))
        yield alerts([row for _, row in sorted(out, key=lambda x: x[0])])

    def close(self) -> None:
        pass


def alerts(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["series", "rule", "id", "us", "price"]).astype({"id": "int64", "us": "int64", "price": "float64"})


def stream_alerts(sdf: DataFrame, level: float, move: float, lookback: int, seconds: int, delay: str) -> DataFrame:
    """The batch rules of price_alerts with state per series: ticks wait until the watermark has
    passed them and are then taken in (ts, id) order, so late ones within the delay change nothing.
    What has come while a series is silent is taken when the watermark passes it. The query must
    run with STATE_STORE, in append mode."""
    rows = sdf.withWatermark("ts", delay).select("series", "ts", "id", "price").groupBy("series")
    rules = AlertRules(level, move, lookback, seconds)
    found = rows.transformWithStateInPandas(rules, "series string, rule string, id bigint, us bigint, price double", "Append", "EventTime")
    return found.select("series", "rule", "id", F.timestamp_micros("us").alias("ts"), "price")


def alert_sink(sdf: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """One write per micro-batch, to a folder named by the batch's id: a batch that runs again
    after a failure replaces what it wrote."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return sdf.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
