"""Standardising, splits and within-race scores; quantile bins are in quantiles.py and named here for callers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantile_bin, quantile_edges, values_at, with_quantile_bin  # noqa: F401


def fit_scaler(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row (a group) of {c}_mean and {c}_std: nulls ignored, population deviation, 1 where it is 0."""
    stats = [x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(F.when(F.stddev_pop(c).isNotNull(), F.lit(1.0))).alias(f"{c}_std"))]
    return df.groupBy(*by).agg(*stats) if by else df.agg(*stats)


def clean_number(c: Column) -> Column:
    """Null, NaN and infinities become 0."""
    x = c.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def standardise(df: DataFrame, scaler: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(x - mean) / std with nulls at the mean; 0 for a column the scaler knows nothing of; absent columns are made."""
    df = df.withColumns({c: F.lit(None).cast("double") for c in columns if c not in df.columns})
    joined = df.join(scaler, list(by), "left") if by else df.crossJoin(F.broadcast(scaler))  # the scaler is one row
    out = {c: F.coalesce((F.coalesce(F.col(c).try_cast("double"), F.col(f"{c}_mean")) - F.col(f"{c}_mean")) / F.col(f"{c}_std"), F.lit(0.0)) for c in columns}
    return joined.withColumns(out).drop(*(f"{c}_{s}" for c in columns for s in ("mean", "std")))


def fill_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.coalesce(c, F.lit(False)) for c in df.columns if c.endswith("_fs_flag")})


def fill_ranks(df: DataFrame, prediction: bool = False) -> DataFrame:
    """Missing lane ranks become 7; before a race the finishers are the placeholders 1, 2 and 3."""
    out = {f"lane{i}_rank": F.coalesce(F.col(f"lane{i}_rank"), F.lit(7)) for i in range(1, 7) if f"lane{i}_rank" in df.columns}
    if prediction:
        out |= {n: F.lit(i) for i, n in ((1, "first_lane"), (2, "second_lane"), (3, "third_lane"))}
    return df.withColumns(out)


def race_z(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """{c}_z: deviation from the race's mean over its population deviation (1 where that is tiny); long form."""
    w = Window.partitionBy("race_key")
    return df.withColumns({f"{c}_z": (F.col(c) - F.avg(c).over(w)) / F.when(F.stddev_pop(c).over(w) < 1e-6, 1.0).otherwise(F.stddev_pop(c).over(w)) for c in columns})


def array_z(xs: Column) -> Column:
    """The same for an array by lane, without a shuffle."""
    from ..functions.scores import let, total

    return let(total(xs) / F.size(xs), lambda m: let(F.sqrt(total(F.transform(xs, lambda x: (x - m) * (x - m))) / F.size(xs)), lambda s: F.transform(xs, lambda x: (x - m) / F.when(s < 1e-6, 1.0).otherwise(s))))


def course_deviation(lane: Column, course: Column) -> tuple[Column, Column]:
    return (lane - course) / 5.0, (lane != course).cast("double")


def frame_stats(wide: DataFrame) -> DataFrame:
    """The env_stats of model_inputs: one row of means and population deviations (1 where it is 0) of the environment
    and of the weight over all lanes together; temperatures that are always null have neither."""
    env = ("wind_speed", "wave_height", "air_temp", "water_temp")
    lanes = [f"lane{i}_weight" for i in range(1, 7) if f"lane{i}_weight" in wide.columns]
    rows = wide.select(*(F.col(c).cast("double").alias(c) for c in env), F.array(*(F.col(c).cast("double") for c in lanes)).alias("_w"))
    # Sums over the lanes in the row, so that the pooled weight costs no more rows.
    known = lambda f: F.sum(F.aggregate(F.filter("_w", lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + f(x)))
    out = fit_sums(rows, env, known)
    mean = F.col("_s") / F.nullif(F.col("_c"), F.lit(0.0))
    spread = F.sqrt(F.greatest(F.col("_q") / F.nullif(F.col("_c"), F.lit(0.0)) - mean * mean, F.lit(0.0)))
    return out.withColumns({"weight_mean": mean, "weight_std": F.when(spread > 0, spread).when(spread.isNotNull(), F.lit(1.0))}).drop("_s", "_q", "_c")


def fit_sums(rows: DataFrame, env: Sequence[str], known) -> DataFrame:
    stats = [x for c in env for x in (F.avg(c).alias(f"{c}_mean"), F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).when(F.stddev_pop(c).isNotNull(), F.lit(1.0)).alias(f"{c}_std"))]
    return rows.agg(*stats, known(lambda x: x).alias("_s"), known(lambda x: x * x).alias("_q"), known(lambda x: F.lit(1.0)).alias("_c"))


def model_inputs(wide: DataFrame, env_stats: DataFrame) -> DataFrame:
    """race_key, ctx[6], boats[6][D], ranks[6], st[6], mask[6]; groups of boat columns that wide lacks are left out.

    env_stats: one row of means and deviations for wind_speed, wave_height, air_temp, water_temp and weight.
    """
    env = ("wind_speed", "wave_height", "air_temp", "water_temp")
    joined = wide.crossJoin(F.broadcast(env_stats))
    z = lambda c, s: (F.coalesce(c.cast("double"), F.lit(0.0)) - F.coalesce(F.col(f"{s}_mean"), F.lit(0.0))) / F.coalesce(F.col(f"{s}_std"), F.lit(1.0))
    ctx = F.array(*(z(F.col(c), c) for c in env), F.coalesce("wind_sin", F.lit(0.0)), F.coalesce("wind_cos", F.lit(0.0)))
    lanes = lambda f: F.array(*(clean_number(F.col(f"lane{i}_{f}")) for i in range(1, 7)))
    has = lambda f: f"lane1_{f}" in wide.columns
    columns = [array_z(lanes("exh_time"))]
    columns += [array_z(lanes("bf_st_time"))] if has("bf_st_time") else []
    columns += [F.array(*(F.coalesce(F.col(f"lane{i}_fs_flag"), F.lit(False)).cast("double") for i in range(1, 7)))] if has("fs_flag") else []
    if has("weight"):
        columns += [lanes("weight"), F.array(*(z(F.col(f"lane{i}_weight"), "weight") for i in range(1, 7)))]
    columns += [array_z(lanes(f)) for f in ("first_rate", "two_rate", "three_rate") if has(f)]
    if has("bf_course"):
        pairs = [course_deviation(F.lit(i), clean_number(F.col(f"lane{i}_bf_course"))) for i in range(1, 7)]
        columns += [F.array(*(p[0] for p in pairs)), F.array(*(p[1] for p in pairs))]
    boats = F.array(*(F.array(*(c[i] for c in columns)) for i in range(6)))
    st = lanes("st_time") if has("st_time") else F.array(*(F.lit(0.0) for _ in range(6)))
    ranks = F.array(*(F.coalesce(F.col(f"lane{i}_rank"), F.lit(7)).cast("int") for i in range(1, 7))) if has("rank") else F.array(*(F.lit(7) for _ in range(6)))
    return joined.select("race_key", ctx.alias("ctx"), boats.alias("boats"), ranks.alias("ranks"), st.alias("st"), F.transform(st, lambda x: (x != 0).cast("double")).alias("mask"))


def split_cutoff(df: DataFrame, day: str = "race_date") -> DataFrame:
    """One row: n, first and last day, share r held out and the cutoff; training lies before it, validation from it."""
    bounds = df.agg(F.count("*").alias("n"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    days = F.datediff("last_day", "first_day") + 1
    within = lambda x: F.least(F.greatest(x, F.lit(0.15)), F.lit(0.25))
    bounds = bounds.withColumn("r", F.greatest(F.lit(0.10), F.least(F.lit(0.25), F.greatest(within(120 / days), within(1000 / F.col("n")), F.lit(0.15)))))
    counts = df.where(F.col(day).isNotNull()).groupBy(F.unix_date(day).alias("d")).agg(F.count("*").alias("c"))
    # The linear quantile of the rows' days from counts by day: the days at the two ranks around (n - 1) (1 - r).
    upto = counts.withColumn("upto", F.sum("c").over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)))  # one row a day
    at = upto.crossJoin(F.broadcast(bounds)).withColumn("at", (F.col("n") - 1) * (1 - F.col("r")))
    low = F.min(F.when(F.col("upto") > F.floor("at"), F.col("d")))
    high = F.min(F.when(F.col("upto") > F.ceil("at"), F.col("d")))
    q = at.groupBy("n", "first_day", "last_day", "r", "at").agg(low.alias("low"), high.alias("high"))
    cut = F.date_from_unix_date(F.floor(F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))).cast("int"))
    early = F.date_sub("last_day", 120)
    return q.select("n", "first_day", "last_day", "r", F.when(F.datediff(F.col("last_day"), cut) < 120, early).otherwise(cut).alias("cutoff"))
