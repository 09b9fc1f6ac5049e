"""The given tables as race data: orders are races, line items entrants, embeddings score vectors, events ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import scratch  # noqa: F401

#: Columns that, with race and lane, order an entrant's loads totally.
SEQUENCE = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def races(spark: SparkSession, sf: str) -> DataFrame:
    """race_key, race_date, venue, race_no and what the weather and payouts derive from."""
    t = lambda n: table(spark, sf, n)
    o = t("orders").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.select(
        F.col("o_orderkey").cast("string").alias("race_key"), F.col("o_orderdate").cast("date").alias("race_date"), F.col("n_name").alias("venue"), (F.col("o_orderkey") % 12 + 1).cast("int").alias("race_no"),
        (F.col("o_orderkey") % 11).cast("int").alias("wind_speed_m"), (F.col("o_orderkey") % 13).cast("int").alias("wave_height_cm"), ((F.col("o_orderkey") % 16) * 22.5).alias("wind_dir_deg"), F.col("o_totalprice").alias("payout_yen"), (F.col("o_custkey") % 120 + 1).cast("int").alias("popularity_rank"),
    )


def weather(spark: SparkSession, sf: str) -> DataFrame:
    return races(spark, sf).select("race_key", F.lit(None).cast("double").alias("air_temp"), F.col("wind_speed_m").cast("double").alias("wind_speed"), "wind_dir_deg", (F.col("wave_height_cm") / 100.0).alias("wave_height"), F.lit(None).cast("double").alias("water_temp"), F.lit("晴").alias("weather_txt"))


def entrants_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Loads of entrants, with repeats: lane, racer, course, timings and the order they finished in."""
    loads = table(spark, sf, "lineitem").where("l_linenumber <= 6").select(F.col("l_orderkey").cast("string").alias("race_key"), F.col("l_linenumber").alias("lane"), "l_returnflag", "l_tax", "l_discount", *SEQUENCE)
    finish = Window.partitionBy("race_key").orderBy(F.desc("l_extendedprice"), "lane", *SEQUENCE)
    return loads.select(
        "race_key", "lane", F.col("l_suppkey").alias("racer_id"), (F.col("l_partkey") % 6 + 1).cast("int").alias("course"), F.col("l_tax").alias("exh_time"), F.col("l_discount").alias("start_timing"), F.when(F.col("l_returnflag") == "R", "F").alias("status"),
        F.row_number().over(finish).alias("finish_order"), F.lit("逃げ").alias("winning_method"), F.col("l_quantity").alias("weight"), *SEQUENCE,
    )


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """race_key, venue, scores and ranks: two slices of each vector, the second ranked in descending order."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("race_key"), (F.col("label").cast("string")).alias("venue"), F.slice("embedding", 1, 6).cast("array<double>").alias("scores"), F.slice("embedding", 7, 6).cast("array<double>").alias("other"))
    return e.select("race_key", "venue", "scores", ranks_of(F.col("other")).alias("ranks"))


def ranks_of(xs: Column) -> Column:
    """Rank of each lane by descending value, ties by lane."""
    return F.transform(xs, lambda x, i: (F.size(F.filter(xs, lambda y, j: (y > x) | ((y == x) & (j < i)))) + 1).cast("int"))


def bets(spark: SparkSession, sf: str) -> DataFrame:
    """Races with a model rank, probability, gap and odds, for the return reports."""
    r, k = races(spark, sf), F.col("race_key").cast("long")
    return r.select("race_key", "race_date", "venue", (F.pmod(k * 7919, F.lit(40)) + 1).cast("int").alias("true_order_rank"), F.when(k % 17 != 0, F.round(F.col("payout_yen") / 1000.0, 2)).alias("trifecta_odds"), (F.pmod(k * 104729, F.lit(1009)) / 1009.0).alias("pl_prob"), (F.pmod(k * 1299709, F.lit(499)) / 499.0).alias("gap"), F.col("wind_speed_m").cast("double").alias("wind_speed"), (F.col("wave_height_cm") / 10.0).alias("wave_height"), "wind_dir_deg")


def ticks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Ticks (a user and day is a race) and a deadline of each race, three quarters through its day."""
    t = table(spark, sf, "events").select(F.lpad((F.col("user_id") % 24 + 1).cast("string"), 2, "0").alias("jcd"), F.date_format("ts", "yyyyMMdd").alias("hd"), (F.col("user_id") % 12 + 1).cast("int").alias("rno"), "ts", F.col("event_id").cast("string").alias("top_trifecta"), (F.col("value") / 500.0).alias("top_prob"))
    closing = t.select("jcd", "hd", "rno").distinct().withColumn("close_ts", (F.to_date("hd", "yyyyMMdd").cast("timestamp") + F.expr("interval 18 hours")))
    return t, closing
