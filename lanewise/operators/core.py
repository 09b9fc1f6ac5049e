"""Latest-wins dedupe, conformed tables, inserts and upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import conform as C


def pick_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first in the given order, which should end in an ingest sequence."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def latest(df: DataFrame, keys: Sequence[str], sequence: Sequence[str]) -> DataFrame:
    """The row of the greatest sequence for each key: a window that Spark also limits to one row a key before the shuffle."""
    return pick_one(df, keys, [F.col(c).desc() for c in sequence])


def insert_absent(target: DataFrame, batch: DataFrame, keys: Sequence[str], sequence: Sequence[str]) -> DataFrame:
    """Rows to append: of the batch's keys that target lacks, the first of each."""
    return pick_one(batch.join(target.select(*keys), list(keys), "left_anti"), keys, [F.col(c) for c in sequence])


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str], sequence: Sequence[str]) -> DataFrame:
    """target with the batch's rows in place of those with equal keys; within the batch the last in sequence wins."""
    both = target.withColumn("_b", F.lit(0)).unionByName(batch.withColumn("_b", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, ["_b", *sequence]).drop("_b")


def races(results: DataFrame) -> DataFrame:
    return results.select("race_key", "race_date", "venue", "race_no").distinct()


def results(raw: DataFrame, sequence: Sequence[str]) -> DataFrame:
    """race_key, lane, racer_id, rank, winning pattern: latest load of each entrant."""
    conformed = raw.withColumns({"rank": C.rank_of(F.col("finish_order")), "win_pattern": C.win_pattern(F.col("winning_method"))})
    return latest(conformed, ["race_key", "lane"], sequence).select("race_key", "lane", "rank", "winning_method", "win_pattern")


def entrants(raw: DataFrame, sequence: Sequence[str]) -> DataFrame:
    """boat_info and results side by side, from one choice of the latest load of each entrant."""
    both = raw.withColumns({"rank": C.rank_of(F.col("finish_order")), "win_pattern": C.win_pattern(F.col("winning_method"))})
    return boat_info(both, sequence).drop("finish_order")


def conform_races(race: DataFrame, event: DataFrame, venue: DataFrame) -> DataFrame:
    """Races with their event's date and venue and a race key: race(event_id, race_no, ..), event(event_id, venue_id,
    event_date), venue(venue_id, name). Venues are few, events one a venue and day; Spark picks the joins by size."""
    keyed = race.join(event.select("event_id", "venue_id", F.col("event_date").alias("race_date")), "event_id").join(venue.select("venue_id", F.col("name").alias("venue")), "venue_id")
    return keyed.withColumn("race_key", C.race_key(F.col("race_date"), F.col("race_no"), F.col("venue"))).drop("event_id", "venue_id")


def boat_info(raw: DataFrame, sequence: Sequence[str], programs: DataFrame | None = None) -> DataFrame:
    """Entrant columns with the false-start flag and signed start; weight comes from the programme where one is given."""
    base = latest(raw, ["race_key", "lane"], sequence).withColumns({"fs_flag": F.col("status") == "F", "st_time": C.signed_start(F.col("start_timing"), F.col("status"))})
    if programs is not None:
        base = base.drop("weight").join(programs.select("race_key", "lane", F.col("weight_kg").alias("weight")), ["race_key", "lane"], "left")
    return base


def weather(raw: DataFrame, sequence: Sequence[str]) -> DataFrame:
    out = latest(raw, ["race_key"], sequence)
    return out.select("race_key", F.lit(None).cast("double").alias("air_temp"), F.col("wind_speed_m").cast("double").alias("wind_speed"), C.compass_degrees(F.col("wind_direction")).alias("wind_dir_deg"), C.wave_metres(F.col("wave_height_cm")).alias("wave_height"), F.lit(None).cast("double").alias("water_temp"), F.col("weather").alias("weather_txt"))


def payouts(raw: DataFrame, sequence: Sequence[str]) -> DataFrame:
    return latest(raw.withColumn("bet_type", C.bet_type(F.col("bet_type"))), ["race_key", "bet_type", "combination"], sequence)


def payouts_by_lanes(paid: DataFrame, kind: str, ordered: bool, sequence: Sequence[str]) -> DataFrame:
    """race_key, first_lane, second_lane, third_lane, payout: of three-lane bets of one type."""
    lanes = C.lanes_of(C.combination_digits(F.col("combination")), ordered)
    rows = paid.where(F.col("bet_type") == kind).withColumn("_l", lanes).where("_l is not null")
    rows = rows.select("*", *(F.col("_l")[i].alias(n) for i, n in enumerate(("first_lane", "second_lane", "third_lane")))).drop("_l")
    return latest(rows, ["race_key", "first_lane", "second_lane", "third_lane"], sequence)


def pred_boat_info(before: DataFrame, sequence: Sequence[str]) -> DataFrame:
    """Pre-race rows conformed: the lowest course of each entrant."""
    keyed = before.withColumn("race_key", C.race_key(F.col("race_date"), F.col("race_no"), F.col("stadium")))
    one = pick_one(keyed, ["race_key", "lane"], [F.col("course").asc_nulls_last(), *(F.col(c).desc() for c in sequence)])
    return one.select("race_key", "lane", "racer_id", C.to_number(F.col("weight_raw")).alias("weight"), "exh_time", "tilt_deg", C.false_start_flag(F.col("st_time_raw")).alias("fs_flag"), C.start_timing(F.col("st_time_raw")).alias("bf_st_time"), F.col("course").alias("bf_course"))


def pred_weather(raw: DataFrame) -> DataFrame:
    """Readings as numbers, of the highest label of each race; wave height stays in cm until conform_units."""
    keyed = raw.withColumn("race_key", C.race_key(F.col("race_date"), F.col("race_no"), F.col("stadium")))
    one = latest(keyed, ["race_key"], ["obs_time_label"])
    number = {n: C.to_number(F.col(f"{n}_raw")).alias(n) for n in ("air_temp", "wind_speed", "wave_height", "water_temp")}
    return one.select("race_key", *number.values(), C.wind_icon_degrees(F.col("wind_dir_raw")).alias("wind_dir_deg"), "weather_txt")


def conform_units(features: DataFrame) -> DataFrame:
    """Prediction rows in training units: waves in metres, temperatures unknown."""
    return features.withColumns({"wave_height": F.col("wave_height") * 0.01, "air_temp": F.lit(None).cast("double"), "water_temp": F.lit(None).cast("double")})


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n and has_data of each table, by one job."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n", (F.col("n") > 0).alias("has_data")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
