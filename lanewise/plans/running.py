"""Queries of streams that stop, fail and go on: each gives what an unbroken run gives, so its SQL is that run's."""

from __future__ import annotations

import contextlib

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import signals
from ..sources import readers
from ..streaming import alerts
from . import standins as X
from .ingest import _CLOSED, as_stream, drained
from .registry import ORACLES, query

STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@query(ORACLES["race_stream_alerts"])
def race_stream_restarted(spark: SparkSession, sf: str) -> DataFrame:
    """The alert stream, stopped after the files of the first days and started again from its checkpoint when those of
    the later days have come: every file is read once, and the state of open races is carried over."""
    ticks, closing = X.ticks(spark, sf)
    ticks = ticks.withColumn("ts", F.col("ts").cast("timestamp"))
    first, last = ticks.agg(F.min("ts"), F.max("ts")).first()
    middle = F.lit(first + (last - first) / 2)
    path, limits = X.scratch(spark, "restarted"), signals.thresholds(spark)
    with setting(spark, STORE, ROCKS):
        for part in (F.col("ts") < middle, F.col("ts") >= middle):
            ticks.where(part).write.mode("append").parquet(f"{path}/in")
            stream = alerts.send_once_stream(alerts.read_new_files(spark, f"{path}/in", ", ".join(f"{c} {t}" for c, t in ticks.dtypes)), closing, limits, minutes=120)
            stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(alerts.SENT).parquet(f"{path}/out").withColumn("top_prob", F.round("top_prob", 6))


class Broken(Exception):
    pass


@query(ORACLES["race_documents"])
def race_documents_replayed(spark: SparkSession, sf: str) -> DataFrame:
    """Documents merged by a running stream whose sink fails after it wrote a batch and before that was committed: the
    batch comes again after the restart, and changes nothing."""
    o, path = X.table(spark, sf, "orders"), X.scratch(spark, "replayed")
    versions = o.select("o_orderkey", F.col("o_totalprice").alias("price"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("note"), F.lit(1).alias("version"))
    changes = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit(None).cast("double").alias("price"), F.lit(None).cast("string").alias("note"), F.lit(2).alias("version"))
    sink, failed = readers.merge_documents(f"{path}/out", ["o_orderkey"], ["version"]), []

    def write(batch: DataFrame, number: int) -> None:
        sink(batch, number)
        if number == 1 and not failed:
            failed.append(number)
            raise Broken("after the write, before the commit")

    def run() -> None:
        stream = alerts.read_new_files(spark, f"{path}/in", ", ".join(f"{c} {t}" for c, t in versions.dtypes))
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()

    for part in (versions, changes):
        part.write.mode("append").parquet(f"{path}/in")
        try:
            run()
        except StreamingQueryException:
            if not failed:
                raise
            run()
    return readers.read_documents(spark, f"{path}/out", ["o_orderkey"], ["version"])


@query(f"select date_trunc('month', ts)::timestamp \"month\", count(*) n, round(sum(value), 4) total {_CLOSED} where date_trunc('month', ts) < date_trunc('month', m) - interval 1 day group by 1")
def race_stream_months(spark: SparkSession, sf: str) -> DataFrame:
    """Calendar months that the watermark has closed, from a stream."""
    events = as_stream(spark, X.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "value"), "events")
    return drained(spark, alerts.month_windows(events, "value"), "months").withColumn("total", F.round("total", 4))


@query("with s as (" + ORACLES["race_send_once"] + """), o as (select jcd, hd, rno, rno || '-' || jcd official_tri, cast(rno * 100 + cast(jcd as int) as int) payout_yen,
strptime(hd, '%Y%m%d') + interval 18 hours + case rno % 4 when 0 then interval 2 hours when 1 then interval 20 hours else interval 3 days end result_ts from s where rno % 4 <> 3)
select s.jcd, s.hd, s.rno, s.sent, s.ts, s.top_trifecta, s.top_prob, o.official_tri, o.payout_yen, o.result_ts from s left join o on s.jcd = o.jcd and s.hd = o.hd and s.rno = o.rno and o.result_ts between s.ts and s.ts + interval 1 day""")
def race_stream_settled(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts and their results as two streams: those that come within a day are met, a race without one or with a later
    one is given out as open once both streams have passed it. A last row far ahead in each stream closes all races."""
    ticks, closing = X.ticks(spark, sf)
    sent = signals.send_once(signals.in_time(ticks, closing, 120), signals.thresholds(spark)).select("jcd", "hd", "rno", "sent", F.col("ts").cast("timestamp").alias("ts"), "top_trifecta", F.round("top_prob", 6).alias("top_prob"))
    kind = F.col("rno") % 4
    wait = F.when(kind == 0, F.expr("interval 2 hours")).when(kind == 1, F.expr("interval 20 hours")).otherwise(F.expr("interval 72 hours"))
    official = closing.where(kind != 3).select("jcd", "hd", "rno", F.concat_ws("-", "rno", "jcd").alias("official_tri"), (F.col("rno") * 100 + F.col("jcd").cast("int")).cast("int").alias("payout_yen"), (F.col("close_ts") + wait).alias("result_ts"))
    one = spark.range(1)
    sent = sent.unionByName(one.selectExpr("'' jcd", "'' hd", "-1 rno", "false sent", "timestamp'2100-01-01' ts", "'' top_trifecta", "0D top_prob"))
    official = official.unionByName(one.selectExpr("'' jcd", "'' hd", "-2 rno", "'' official_tri", "0 payout_yen", "timestamp'2100-01-01' result_ts"))
    return drained(spark, alerts.settle_stream(as_stream(spark, sent, "sent"), as_stream(spark, official, "official")), "settled").where("rno > 0")
