"""Alerts before the deadline and the summaries of what they returned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores as S

#: Alert threshold and the probability of full strength by venue.
THRESHOLDS = {"01": (0.20, 0.30), "07": (0.16, 0.28), "12": (0.116, 0.20), "15": (0.35, 0.45), "19": (0.27, 0.40), "20": (0.22, 0.25), "24": (0.15, 0.22)}
STAKE, MINUTES = 500, 5


def thresholds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in THRESHOLDS.items()], "jcd string, threshold double, max_prob double")


def strength(prob: Column, threshold: Column, most: Column) -> Column:
    return (prob - threshold) / (most - threshold)


def message(df: DataFrame, base_url: str = "https://example.org/result") -> DataFrame:
    """Text and result link of an alert."""
    return df.withColumns({"text": F.format_string("%s %dR %s p=%.3f", "jcd", "rno", "top_trifecta", "top_prob"), "url": F.concat(F.lit(base_url + "?rno="), F.col("rno").cast("string"), F.lit("&jcd="), F.col("jcd"), F.lit("&hd="), F.col("hd"))})


def deadlines(rows: DataFrame) -> DataFrame:
    """The first known deadline of each race of a day."""
    return rows.groupBy("jcd", "hd", "rno").agg(F.min("close_ts").alias("close_ts"))


def in_time(ticks: DataFrame, closing: DataFrame, minutes: int = MINUTES) -> DataFrame:
    """Ticks of a race within `minutes` before its deadline, both ends included: an equi-join and an interval."""
    near = (F.col("ts") >= F.col("close_ts") - F.expr(f"interval {minutes} minutes")) & (F.col("ts") <= F.col("close_ts"))
    return ticks.join(closing, ["jcd", "hd", "rno"]).where(near)


def send_once(ticks: DataFrame, limits: DataFrame) -> DataFrame:
    """One row a race: the first tick whose probability exceeds its venue's threshold (sent), else the last tick."""
    scored = ticks.join(limits, "jcd", "left").withColumn("over", F.coalesce(F.col("top_prob") > F.col("threshold"), F.lit(False)))
    key = ["jcd", "hd", "rno"]
    rest = F.struct("ts", "top_trifecta", "top_prob", "threshold", "max_prob")
    picked = scored.groupBy(*key).agg(F.min_by(rest, F.struct("ts", "top_trifecta")).alias("_any"), F.expr("min_by(struct(ts, top_trifecta, top_prob, threshold, max_prob), struct(ts, top_trifecta)) filter (where over)").alias("_first"), F.max_by(rest, F.struct("ts", "top_trifecta")).alias("_last"))
    out = picked.select(*key, F.col("_first").isNotNull().alias("sent"), F.coalesce("_first", "_last").alias("r")).select(*key, "sent", "r.*")
    return out.withColumn("strength", F.when(F.col("sent"), strength(F.col("top_prob"), F.col("threshold"), F.col("max_prob"))))


def settle(signals: DataFrame, official: DataFrame, stake: int = STAKE) -> DataFrame:
    """Signals with the official order; hit (any order) and pl_yen are null while a race is open."""
    out = signals.join(official, ["hd", "jcd", "rno"], "left")
    won = S.hit_texts(F.col("tri"), F.col("official_tri"))
    return out.withColumns({"completed": F.col("official_tri").isNotNull(), "hit": won, "pl_yen": F.when(won, F.col("payout_yen") - stake).when(F.col("official_tri").isNotNull(), F.lit(-stake))})


def daily_summary(settled: DataFrame, stake: int = STAKE) -> DataFrame:
    """By day over sent signals: total, completed, hits, staked, returned, pnl, hit_rate and roi_gross (0 when empty)."""
    days = settled.where("sent").groupBy("hd").agg(
        F.count("*").alias("total"), F.count_if("completed").alias("completed"), F.count_if(F.col("completed") & F.col("hit")).alias("hits"),
        F.coalesce(F.sum(F.when(F.col("completed") & F.col("hit"), F.col("payout_yen") * (stake // 100))), F.lit(0)).alias("returned"),
    )
    return with_ratios(days.withColumn("staked", F.col("completed") * stake))


def with_ratios(df: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return df.withColumns({"pnl": F.col("returned") - F.col("staked"), "hit_rate": ratio("hits", "completed"), "roi_gross": ratio("returned", "staked")})


def roll_up(daily: DataFrame, period: str, until: str | None = None) -> DataFrame:
    """Weekly (Monday to Sunday) or monthly sums of daily rows with ratios from the sums; `until` (a date) leaves out
    periods that end after it."""
    start = F.date_trunc(period, F.to_date("hd", "yyyyMMdd")).cast("date")
    sums = daily.groupBy(start.alias("start")).agg(*(F.sum(c).alias(c) for c in ("total", "completed", "hits", "staked", "returned")))
    end = F.date_add("start", 6) if period == "week" else F.last_day("start")
    out = with_ratios(sums).withColumn("end", end)
    return out.where(F.col("end") <= F.lit(until).cast("date")) if until else out


def unsent(batch: DataFrame, sent: DataFrame, keys: tuple[str, ...] = ("hd", "jcd", "rno")) -> DataFrame:
    return batch.join(sent, list(keys), "left_anti")


def prediction_report(predicted: DataFrame, true: DataFrame, threshold: float) -> DataFrame:
    """Predictions beside the true trifecta: hit flags and `over` (true, or null below the threshold)."""
    both = predicted.join(true, "race_key")
    return both.withColumns({"hit_exact": F.col("tri") == F.col("official_tri"), "hit_set": S.hit_texts(F.col("tri"), F.col("official_tri")), "over": F.when(F.col("prob") > threshold, F.lit(True))})


def hits_only(df: DataFrame) -> DataFrame:
    return df.where("hit")


def sent_on(df: DataFrame, day: str) -> DataFrame:
    """Sent signals of a day (yyyyMMdd)."""
    return df.where((F.col("hd") == day) & F.col("sent"))


def after_day(df: DataFrame, day: str) -> DataFrame:
    """Pages or signals of later days (yyyyMMdd)."""
    return df.where(F.col("hd") > day)


def latest_per_race(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("jcd", "hd", "rno").orderBy(F.desc("ts"))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
