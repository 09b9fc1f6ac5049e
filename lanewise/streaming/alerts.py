"""The alert flow as Structured Streaming: deadlines, ticks in time, send-once state, late results, day windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import signals as G

KEY = ["jcd", "hd", "rno"]
SENT = "jcd string, hd string, rno int, sent boolean, ts timestamp, top_trifecta string, top_prob double"


def read_new_files(spark: SparkSession, path: str, schema: str, format: str = "parquet", per_trigger: int = 1000) -> DataFrame:
    """New files of a folder only; the checkpoint remembers those that were read."""
    return spark.readStream.schema(schema).format(format).option("maxFilesPerTrigger", per_trigger).load(path)


def first_deadlines(rows: DataFrame, delay: str = "1 day") -> DataFrame:
    return rows.withWatermark("seen_ts", delay).dropDuplicatesWithinWatermark(KEY)


class SendOnce(StatefulProcessor):
    """One decision a race: the first tick over the threshold is emitted as sent; a race without one emits its last tick
    when event time passes its deadline. At that time all state of the race is cleared: later ticks in time are behind
    the watermark and don't come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "done boolean")
        self.last = handle.getValueState("last", "ts timestamp, top_trifecta string, top_prob double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.done.exists():
            return
        frames = list(rows)
        if not list(self.handle.listTimers()):
            self.handle.registerTimer(int(frames[0]["close_ts"].iloc[0].timestamp() * 1000))
        ticks = pd.concat(frames).sort_values(["ts", "top_trifecta"])
        over = ticks[ticks["top_prob"] > ticks["threshold"]]
        if len(over):
            self.done.update((True,))
            self.last.clear()
            yield self.row(key, True, over.iloc[0])
            return
        end = ticks.iloc[-1]
        if not self.last.exists() or tuple(self.last.get())[0] <= end["ts"]:
            self.last.update((end["ts"], end["top_trifecta"], float(end["top_prob"])))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.done.exists() and self.last.exists():
            ts, tri, prob = self.last.get()
            yield self.row(key, False, {"ts": ts, "top_trifecta": tri, "top_prob": prob})
        self.done.clear()
        self.last.clear()

    def row(self, key, sent: bool, tick) -> pd.DataFrame:
        return pd.DataFrame({"jcd": [key[0]], "hd": [key[1]], "rno": [key[2]], "sent": [sent], "ts": [tick["ts"]], "top_trifecta": [tick["top_trifecta"]], "top_prob": [float(tick["top_prob"])]})

    def close(self) -> None:
        pass


def send_once_stream(ticks: DataFrame, closing: DataFrame, limits: DataFrame, delay: str = "10 minutes", minutes: int = G.MINUTES) -> DataFrame:
    """Streaming form of signals.in_time and signals.send_once; closing and limits are static."""
    near = G.in_time(ticks.withWatermark("ts", delay), closing, minutes).join(limits, "jcd", "left")
    return near.groupBy(*KEY).transformWithStateInPandas(SendOnce(), SENT, "Append", "EventTime")


def settle_stream(sent: DataFrame, official: DataFrame, wait: str = "1 day") -> DataFrame:
    """Sent signals with results that come up to `wait` later; those without any are given out as open."""
    s, o = sent.withWatermark("ts", wait).alias("s"), official.withWatermark("result_ts", wait).alias("o")
    near = [F.col(f"s.{k}") == F.col(f"o.{k}") for k in KEY] + [F.col("o.result_ts") >= F.col("s.ts"), F.col("o.result_ts") <= F.col("s.ts") + F.expr(f"interval {wait}")]
    return s.join(o, near, "leftOuter").select("s.*", "o.official_tri", "o.payout_yen", "o.result_ts")


def day_windows(events: DataFrame, value: str, delay: str = "1 day") -> DataFrame:
    """Counts and sums by day; windows close when the watermark passes them."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("day"), "n", "total")


def week_windows(events: DataFrame, value: str, delay: str = "1 day") -> DataFrame:
    """The same from Monday to Sunday: the epoch was a Thursday, so weeks start four days on."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "7 days", "7 days", "4 days")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("week"), "n", "total")


def month_windows(events: DataFrame, value: str, delay: str = "1 day") -> DataFrame:
    """The same by calendar month, which no fixed window length gives: the watermark follows the months' first days, so
    that a month closes when an event comes whose month began more than `delay` after it."""
    months = events.withColumn("month", F.date_trunc("month", "ts")).withWatermark("month", delay)
    return months.groupBy("month").agg(F.count("*").alias("n"), F.sum(value).alias("total"))
