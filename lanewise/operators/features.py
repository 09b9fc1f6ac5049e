"""Race features: the entrant table, racer history, pivots to one row a race, evaluation columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import conform as C

LANES = range(1, 7)
#: Entrant columns that a race row carries for each lane.
FIELDS = ("racer_id", "weight", "exh_time", "tilt_deg", "fs_flag", "bf_st_time", "bf_course", "st_time", "rank")
RACE_FIELDS = ("race_date", "venue", "air_temp", "wind_speed", "wind_dir_deg", "wave_height", "water_temp", "weather_txt")
RATES = ("starts", "firsts", "first_rate", "two_rate", "three_rate")


def boat_flat(boats: DataFrame, weather: DataFrame, results: DataFrame | None, races: DataFrame, how: str = "inner") -> DataFrame:
    """One row an entrant, with its race's weather, date and venue, and its rank where results are given."""
    out = boats.join(weather, "race_key", how)
    if results is not None:
        out = out.join(results, ["race_key", "lane"])
    return out.join(races.select("race_key", "race_date", "venue"), "race_key")


def course_stats(flat: DataFrame) -> DataFrame:
    """Starts, firsts and first/two/three rates of each racer, course and venue over all history."""
    rate = lambda k: (F.sum((F.col("rank") <= k).cast("int")) / F.count("*"))
    return flat.groupBy("racer_id", "course", "venue").agg(
        F.count("*").alias("starts"), F.sum((F.col("rank") == 1).cast("int")).alias("firsts"), rate(1).alias("first_rate"), rate(2).alias("two_rate"), rate(3).alias("three_rate"),
    )


def course_stats_as_of(flat: DataFrame) -> DataFrame:
    """flat with the same statistics from earlier days alone, which leaks nothing of the race itself."""
    before = Window.partitionBy("racer_id", "course", "venue").orderBy(F.unix_date("race_date")).rangeBetween(Window.unboundedPreceding, -1)
    rate = lambda k: F.sum((F.col("rank") <= k).cast("int")).over(before) / F.nullif(F.count("*").over(before), F.lit(0))
    return flat.withColumns({"starts": F.count("*").over(before), "firsts": F.coalesce(F.sum((F.col("rank") == 1).cast("int")).over(before), F.lit(0)), "first_rate": rate(1), "two_rate": rate(2), "three_rate": rate(3)})


def pivot_lanes(flat: DataFrame, fields: tuple[str, ...] = FIELDS, race_fields: tuple[str, ...] = RACE_FIELDS, whole: bool = True) -> DataFrame:
    """One row a race with lane{i}_{field} columns, by one aggregate with explicit lanes.

    whole: races with several dates or venues under one key go (least and greatest are compared).
    """
    held = lambda i, f: F.bool_or(F.when(F.col("lane") == i, F.col(f))) if f == "fs_flag" else F.max(F.when(F.col("lane") == i, F.col(f)))
    fields = tuple(f for f in fields if f in flat.columns)
    race_fields = tuple(f for f in race_fields if f in flat.columns)
    checks = [F.min(c).alias(f"_least_{c}") for c in ("race_date", "venue")] if whole else []
    out = flat.groupBy("race_key").agg(*(F.max(f).alias(f) for f in race_fields), *(held(i, f).alias(f"lane{i}_{f}") for i in LANES for f in fields), *checks)
    if whole:
        out = out.where("_least_race_date = race_date and _least_venue = venue")
    return out.drop("_least_race_date", "_least_venue")


def lane_arrays(flat: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """race_key and, for each field, an array by lane: the form that the score functions take."""
    out = flat.where(F.col("lane").between(1, 6)).groupBy("race_key").agg(*(F.max(F.when(F.col("lane") == i, F.col(f))).alias(f"_{f}{i}") for f in fields for i in LANES))
    return out.select("race_key", *(F.array(*(F.col(f"_{f}{i}") for i in LANES)).alias(f) for f in fields))


def to_long(wide: DataFrame, fields: tuple[str, ...], keep: tuple[str, ...] = ("race_key", "venue")) -> DataFrame:
    """One row a lane, from one pass over the wide rows."""
    boxes = F.array(*(F.struct(F.lit(i).alias("lane"), *(F.col(f"lane{i}_{f}").alias(f) for f in fields)) for i in LANES))
    return wide.select(*keep, F.inline(boxes))


def lane_stats(wide: DataFrame, stats: DataFrame) -> DataFrame:
    """lane{i}_{rate} columns of each race by the racer's history on the lane's course at the venue.

    Rows without a racer or course never match, so they skip the join instead of meeting in one task.
    """
    long = to_long(wide, ("racer_id", "bf_course")).withColumnRenamed("bf_course", "course").where("racer_id is not null and course is not null")
    joined = long.join(stats.where("racer_id is not null and course is not null"), ["racer_id", "course", "venue"])
    return joined.groupBy("race_key").agg(*(F.max(F.when(F.col("lane") == i, F.col(r))).alias(f"lane{i}_{r}") for i in LANES for r in RATES))


def with_lane_stats(wide: DataFrame, stats: DataFrame) -> DataFrame:
    return wide.join(lane_stats(wide, stats), "race_key", "left")


def finishing_positions(flat: DataFrame) -> DataFrame:
    """first_lane, second_lane and third_lane by rank, ties by lane."""
    order = Window.partitionBy("race_key").orderBy("rank", "lane")
    placed = flat.where("rank is not null").withColumn("place", F.row_number().over(order))
    return placed.groupBy("race_key").agg(*(F.min(F.when(F.col("place") == k, F.col("lane"))).alias(f"{n}_lane") for k, n in ((1, "first"), (2, "second"), (3, "third"))))


def rank_columns(flat: DataFrame) -> DataFrame:
    return flat.groupBy("race_key").agg(*(F.max(F.when(F.col("lane") == i, F.col("rank"))).alias(f"lane{i}_rank") for i in LANES))


def evaluation(features: DataFrame, positions: DataFrame, trifecta: DataFrame, trio: DataFrame | None = None) -> DataFrame:
    """features with the first three lanes and the odds of the ordered and, where given, the unordered three."""
    lanes = ["first_lane", "second_lane", "third_lane"]
    paid = trifecta.select("race_key", *lanes, C.odds_of(F.col("payout_yen")).alias("trifecta_odds"), F.col("popularity_rank").alias("trifecta_popularity_rank"))
    out = features.join(positions, "race_key", "left").join(paid, ["race_key", *lanes], "left")
    if trio is not None:
        sides = C.sort_three(*(F.col(c) for c in lanes))
        out = out.withColumns(dict(zip(("low_lane", "mid_lane", "high_lane"), sides, strict=True)))
        names = dict(zip(lanes, ("low_lane", "mid_lane", "high_lane"), strict=True))
        paid = trio.select("race_key", *(F.col(c).alias(n) for c, n in names.items()), C.odds_of(F.col("payout_yen")).alias("trio_odds"))
        out = out.join(paid, ["race_key", *names.values()], "left")
    return out


def merge_odds(results: DataFrame, odds: DataFrame, sequence: list[str], columns: tuple[str, ...] = ("trifecta_odds",)) -> DataFrame:
    """results with the last loaded odds of each race; odds columns that were there before are dropped."""
    from .core import latest

    return results.drop(*columns).join(latest(odds, ["race_key"], sequence).select("race_key", *columns), "race_key", "left")


def select_races(df: DataFrame, keys: DataFrame) -> DataFrame:
    return df.join(keys.select("race_key").distinct(), "race_key", "left_semi")


def report_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that df has, in that order."""
    return df.select(*(c for c in wanted if c in df.columns))


def null_report(df: DataFrame) -> DataFrame:
    """column, null_ratio and nulls, the emptiest first."""
    counts = df.agg(*(F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns), F.count("*").alias("_n"))
    return counts.unpivot("_n", df.columns, "column", "nulls").select("column", (F.col("nulls") / F.col("_n")).alias("null_ratio"), "nulls").orderBy(F.desc("null_ratio"), "column")


def without_columns(df: DataFrame, unused: list[str]) -> DataFrame:
    """df without the unused lane columns (a name stands for lane1_name to lane6_name); absent ones are ignored."""
    return df.drop(*unused, *(f"lane{i}_{c}" for c in unused for i in LANES))


def stack_reports(parts: list[DataFrame], columns: list[str]) -> DataFrame:
    """All rows of the parts with exactly these columns in this order; absent ones are null."""
    first, *rest = parts
    for p in rest:
        first = first.unionByName(p, allowMissingColumns=True)
    return first.select(*(F.col(c) if c in first.columns else F.lit(None).alias(c) for c in columns))


def join_scores(scores: DataFrame, odds: DataFrame, environment: DataFrame, pl: DataFrame, sequence: list[str]) -> DataFrame:
    """Scores with the odds, the environment (its last row a race by sequence) and the Plackett-Luce features of their
    race, each null where a race has none. All four meet on race_key, so they are shuffled once each."""
    from .core import latest

    last = latest(environment, ["race_key"], sequence).drop(*(c for c in sequence if c != "race_key"))
    return scores.join(odds, "race_key", "left").join(last, "race_key", "left").join(pl, "race_key", "left")


class Registry:
    """Named feature columns: register a factory with its inputs and type, then apply those that are asked for."""

    def __init__(self) -> None:
        self.features: dict[str, tuple[Column, tuple[str, ...], str]] = {}

    def register(self, name: str, column: Column, needs: tuple[str, ...], dtype: str = "double") -> None:
        self.features[name] = (column, needs, dtype)

    def apply(self, df: DataFrame, include: list[str] | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
        """df with the chosen features whose inputs it has; a feature may need others, which come in a projection before."""
        left = [n for n in (include or self.features) if n not in exclude]
        while ready := [n for n in left if set(self.features[n][1]) <= set(df.columns)]:
            df = df.withColumns({n: self.features[n][0].cast(self.features[n][2]) for n in ready})
            left = [n for n in left if n not in ready]
        return df
