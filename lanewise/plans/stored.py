"""Registered queries of stored layers and partition-wise merges, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import core, features, layers
from ..sources.shared import scratch, stage
from . import standins as X
from .queries import FLAT, ORACLES, RACES, rounded
from .registry import query


def conformed(spark: SparkSession, sf: str, buckets: int = 16) -> layers.Layers:
    """The race tables as layers: raw loads, entrants (latest load of each), weather, races, and flat, made from them."""
    out = layers.Layers(spark, "race_key", buckets)
    out.define("loads", lambda: X.entrants_raw(spark, sf), sort=["lane"])
    out.define("weather", lambda: X.weather(spark, sf))
    out.define("races", lambda: core.races(X.races(spark, sf)))
    out.define("entrants", lambda loads: core.entrants(loads, X.SEQUENCE).withColumn("bf_course", F.col("course")), ["loads"], ["lane"])
    out.define("flat", lambda entrants, weather, races: features.boat_flat(entrants, weather, None, races), ["entrants", "weather", "races"], ["lane"])
    return out


def pivot_of_loads(stored: layers.Layers) -> DataFrame:
    """Dedupe, join and pivot over the bucketed loads, weather and races: no shuffle."""
    boats = core.entrants(stored["loads"], X.SEQUENCE)
    return features.pivot_lanes(features.boat_flat(boats, stored["weather"], None, stored["races"]), ("racer_id", "exh_time", "course", "fs_flag"), ("race_date", "venue", "wind_speed"))


@query(ORACLES["race_pivot"])
def race_stored_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """race_pivot's rows from bucketed tables."""
    stored = conformed(spark, sf)
    stored.refresh("loads", "weather", "races")
    return pivot_of_loads(stored)


@query(ORACLES["race_lane_stats"])
def race_stored_lane_stats(spark: SparkSession, sf: str) -> DataFrame:
    """race_lane_stats' rows from the stored flat layer, which both sides of the history join read."""
    stored = conformed(spark, sf)
    stored.refresh()
    wide = features.pivot_lanes(stored["flat"], ("racer_id", "bf_course"), ("race_date", "venue"))
    out = features.with_lane_stats(wide, features.course_stats(stored["flat"]))
    rates = [f"lane{i}_{r}" for i in range(1, 7) for r in ("first_rate", "three_rate")]
    return rounded(out.select("race_key", *(f"lane{i}_starts" for i in range(1, 7)), *rates), *rates)


@query(FLAT + " select race_key, count(*) boats, count(*) filter (where rank = 1) winners, round(sum(weight), 2) + 1000 * count(*) weight from flat where race_key::bigint % 7 <> 0 group by race_key")
def race_refreshed_layers(spark: SparkSession, sf: str) -> DataFrame:
    """Layers after their raw loads changed: what is made from loads is rebuilt, weather and races keep their tables."""
    stored, state = conformed(spark, sf), {"changed": False}
    loads = stored.made["loads"][1]
    stored.define("loads", lambda: loads().where("cast(race_key as bigint) % 7 <> 0").withColumn("weight", F.col("weight") + 1000) if state["changed"] else loads(), sort=["lane"])
    stored.refresh()
    state["changed"] = True
    stored.refresh("loads")
    return rounded(stored["flat"].groupBy("race_key").agg(F.count("*").alias("boats"), F.count_if(F.col("rank") == 1).alias("winners"), F.sum("weight").alias("weight")), "weight", digits=2)


_MONTHS = f"""with {RACES}, m as (select k, race_key, strftime(race_date, '%Y%m') as month, payout_yen from races), base as (select * from m where k % 5 <> 0), batch as (select * from m where month >= '199801' and k % 3 = 0)"""


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    return X.races(spark, sf).select("race_key", F.date_format("race_date", "yyyyMM").alias("month"), "payout_yen", F.lit(0).alias("load"))


def with_files(spark: SparkSession, path: str, before: DataFrame) -> DataFrame:
    """month, n, total and whether the month has the files that it had before."""
    now = layers.files_of(spark, path, ["month"]).join(before.withColumnRenamed("files", "old"), "month", "left")
    rows = spark.read.parquet(path).groupBy("month").agg(F.count("*").alias("n"), F.round(F.sum("payout_yen"), 2).alias("total"))
    return rows.join(now.select("month", F.coalesce(F.col("files") == F.col("old"), F.lit(False)).alias("kept")), "month").select(F.col("month").cast("string").alias("month"), "n", "total", "kept")


@query(_MONTHS + """, u as (select month, payout_yen + 1000 v from batch union all select month, payout_yen from base where not exists (select 1 from batch where batch.race_key = base.race_key))
select month, count(*) n, round(sum(v), 2) total, month not in (select month from batch) kept from u group by month""")
def race_merged_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """A table by month after a batch of later months was merged into it twice: the other months keep their files."""
    path, rows = scratch(spark, "monthly"), monthly(spark, sf)
    rows.where("cast(race_key as bigint) % 5 <> 0").write.partitionBy("month").parquet(path)
    before = stage(layers.files_of(spark, path, ["month"]), "files-before")
    batch = rows.where("month >= '199801' and cast(race_key as bigint) % 3 = 0").withColumns({"payout_yen": F.col("payout_yen") + 1000, "load": F.lit(1)})
    for _ in range(2):
        layers.merge_partitions(spark, path, batch, ["race_key"], ["load"], ["month"])
    return with_files(spark, path, before)


@query(_MONTHS + """, u as (select month, payout_yen v from base union all select month, payout_yen + 1000 from batch where k % 5 = 0)
select month, count(*) n, round(sum(v), 2) total, month not in (select month from batch where k % 5 = 0) kept from u group by month""")
def race_inserted_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """The same table after a batch's absent races were appended twice: rows that are there stay as they are."""
    path, rows = scratch(spark, "monthly"), monthly(spark, sf)
    rows.where("cast(race_key as bigint) % 5 <> 0").write.partitionBy("month").parquet(path)
    before = stage(layers.files_of(spark, path, ["month"]), "files-before")
    batch = rows.where("month >= '199801' and cast(race_key as bigint) % 3 = 0").withColumns({"payout_yen": F.col("payout_yen") + 1000, "load": F.lit(1)})
    for _ in range(2):
        layers.insert_partitions(spark, path, batch, ["race_key"], ["load"], ["month"])
    return with_files(spark, path, before)
