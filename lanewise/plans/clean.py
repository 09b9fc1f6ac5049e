"""Queries of the scalar clean-up, joins and reports beside those of queries.py. Raw spellings are derived from the
given tables by string expressions, so that the SQL states the clean values from the same columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import conform as C
from ..functions import scores as S
from ..operators import core, features, metrics, prepare, roi, signals
from . import queries as Q
from . import standins as X
from .registry import ORACLES, query

LISTED = lambda xs: "[" + ", ".join("null" if x is None else f"'{x}'" if isinstance(x, str) else repr(x) for x in xs) + "]"


def picked(xs: list, at: Column) -> Column:
    """The value at a 0-based place of a fixed list."""
    return F.get(F.array(*map(F.lit, xs)), at.cast("int"))


METHODS = [*C.WIN_METHODS, "不明", None]
ALIASES = [(a, name) for name, aliases in C.BET_LABELS.items() for a in aliases] + [("その他", "その他")]
POINTS = [*C.COMPASS, "無風"]


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return X.table(spark, sf, "orders").withColumn("k", F.col("o_orderkey"))


@query(f"""with v as (select o_orderkey, {LISTED(C.VENUES)}[o_orderkey % 24 + 1] name, lpad(cast(o_orderkey % 24 + 1 as varchar), 2, '0') code, o_orderdate, lpad(cast(o_orderkey % 12 + 1 as varchar), 2, '0') rno from orders)
select o_orderkey, code number, strftime(o_orderdate, '%Y-%m-%d') || '-' || rno || '-' || code race_key, case when length(name) = 2 then name[1:1] || ' ' || name[2:2] else name end place, case when o_orderkey % 7 <> 0 then strftime(o_orderdate, '%Y-%m-%d') || '-' || rno || '-' || code end known_key from v""")
def race_venue_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Venues named, spaced or numbered; a key with a null part is null."""
    k, name = F.col("k"), picked(C.VENUES, F.col("k") % 24)
    raw = F.when(k % 3 == 0, name).when(k % 3 == 1, F.concat(F.substring(name, 1, 1), F.lit("　"), F.substring(name, 2, 9))).otherwise((k % 24 + 1).cast("string"))
    day, rno = F.col("o_orderdate").cast("date"), (k % 12 + 1).cast("int")
    return orders(spark, sf).select("o_orderkey", C.venue_number(raw).alias("number"), C.race_key(day, rno, raw).alias("race_key"), C.spaced_place(name).alias("place"), C.race_key(day, F.when(k % 7 != 0, rno), raw).alias("known_key"))


@query(f"""select o_orderkey, coalesce({LISTED([*C.WIN_METHODS.values(), 'OTHER', 'OTHER'])}[o_orderkey % {len(METHODS)} + 1]) win_pattern, case when o_orderkey % 17 < 16 then (o_orderkey % 17) * 22.5::double end degrees,
case when o_orderkey % 19 between 1 and 16 then ((o_orderkey % 19) % 16) * 22.5::double end icon_degrees, {LISTED([n for _, n in ALIASES])}[o_orderkey % {len(ALIASES)} + 1] bet_type from orders""")
def race_codes(spark: SparkSession, sf: str) -> DataFrame:
    """All winning methods, compass points, wind icons and bet labels, and values beside them."""
    k = F.col("k")
    return orders(spark, sf).select(
        "o_orderkey", C.win_pattern(picked(METHODS, k % len(METHODS))).alias("win_pattern"), C.compass_degrees(picked(POINTS, k % 17)).alias("degrees"),
        C.wind_icon_degrees(F.concat(F.lit("is-wind"), (k % 19).cast("string"))).alias("icon_degrees"), C.bet_type(picked([a for a, _ in ALIASES], k % len(ALIASES))).alias("bet_type"),
    )


@query("""with r as (select *, cast(round(l_discount * 100) as integer) h, l_linenumber % 5 form from lineitem)
select l_orderkey, l_linenumber, case when l_partkey % 10 <> 0 then l_quantity + 0.5 end weight, case form when 1 then -h / 100.0::double when 0 then h / 100.0::double when 2 then h / 100.0::double end st_time, form = 1 is_false_start,
case when l_returnflag = 'R' then -l_discount else l_discount end signed_start, l_partkey % 30 / 100.0::double wave_height, case when l_partkey % 4 = 3 then l_tax else 0 end clean from r""")
def race_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Weights with units, start timings in all spellings, waves in cm, numbers beside NaN, infinity and null."""
    h = F.lpad(F.round(F.col("l_discount") * 100).cast("int").cast("string"), 2, "0")
    raw = picked_column([F.concat(F.lit("."), h), F.concat(F.lit("F."), h), F.concat(F.lit("0."), h), F.lit("L"), F.lit("")], F.col("l_linenumber") % 5)
    part = F.col("l_partkey")
    odd = picked_column([F.lit(float("nan")), F.lit(float("-inf")), F.lit(None).cast("double"), F.col("l_tax")], part % 4)
    return X.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", C.to_number(F.when(part % 10 != 0, F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".5kg"))).otherwise("kg")).alias("weight"),
        C.start_timing(raw).cast("double").alias("st_time"), C.false_start_flag(raw).alias("is_false_start"), C.signed_start(F.col("l_discount"), F.when(F.col("l_returnflag") == "R", "F")).alias("signed_start"),
        C.wave_metres(part % 30).alias("wave_height"), prepare.clean_number(odd).alias("clean"),
    )


def picked_column(xs: list[Column], at: Column) -> Column:
    return F.get(F.array(*xs), at.cast("int"))


_DIGITS = "select *, o_orderkey % 6 + 1 a, (o_orderkey // 6) % 6 + 1 b, (o_orderkey // 36) % 6 + 1 c from orders"


@query(f"""with d as ({_DIGITS}) select o_orderkey, case when o_orderkey % 4 <= 1 then a || '' || b || c end digits, case when o_orderkey % 4 <= 1 then a || '-' || b || '-' || c end ordered,
case when o_orderkey % 4 <= 1 then array_to_string(list_sort([a, b, c]), '-') end unordered, list_sort([a, b, c])[1]::integer low, list_sort([a, b, c])[2]::integer mid, list_sort([a, b, c])[3]::integer high from d""")
def race_combinations(spark: SparkSession, sf: str) -> DataFrame:
    """Full-width, dashed, unusable and too long combinations as lanes, in and without order."""
    k = F.col("k")
    a, b, c = ((F.floor(k / d) % 6 + 1).cast("int") for d in (1, 6, 36))
    dash = lambda s, *xs: F.concat_ws(s, *(x.cast("string") for x in xs))
    raw = picked_column([F.translate(dash("－", a, b, c), "123456", "１２３４５６"), dash("=", a, b, c), F.lit("返還"), dash("-", a, b, c, a)], k % 4)
    digits, three = C.combination_digits(raw), C.sort_three(a, b, c)
    joined = lambda xs: F.array_join(xs.cast("array<string>"), "-")
    return orders(spark, sf).select("o_orderkey", digits.alias("digits"), joined(C.lanes_of(digits)).alias("ordered"), joined(C.lanes_of(digits, False)).alias("unordered"), *(x.alias(n) for n, x in zip(("low", "mid", "high"), three, strict=True)))


@query("""select o_orderkey, case when o_orderkey % 5 <> 0 then o_orderdate::date end "day", case when o_orderkey % 5 <> 0 then cast(o_orderkey % 12 + 1 as integer) end race_no from orders""")
def race_file_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Date and race number of page files by name; files of another name have neither."""
    k = F.col("k")
    path = F.when(k % 5 == 0, F.concat(F.lit("store/other_"), k.cast("string"), F.lit(".html"))).otherwise(F.concat(F.lit("store/deep/beforeinfo_"), (k % 24 + 1).cast("string"), F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), (k % 12 + 1).cast("string"), F.lit(".html")))
    day, number = C.file_date_and_race(path)
    return orders(spark, sf).select("o_orderkey", day.alias("day"), number.alias("race_no"))


def _wide(spark: SparkSession, sf: str) -> DataFrame:
    return features.pivot_lanes(Q.flat(spark, sf), ("fs_flag", "rank", "weight", "exh_time", "bf_course", "st_time"), ("race_date", "venue", "air_temp", "water_temp", "wind_speed", "wave_height", "wind_dir_deg"))


@query(Q.FLAT + " select race_key, " + ", ".join(f"coalesce(bool_or(case when lane = {i} then status = 'F' end), false) lane{i}_fs_flag, coalesce(max(case when lane = {i} then rank end), 7)::integer lane{i}_rank" for i in range(1, 7)) + ", 1 first_lane, 2 second_lane, 3 third_lane from flat group by race_key")
def race_filled(spark: SparkSession, sf: str) -> DataFrame:
    """Race rows with flags and ranks filled, and the placeholder finishers of prediction; unused columns dropped."""
    wide = features.without_columns(_wide(spark, sf), ["weight", "exh_time", "bf_course", "st_time", "air_temp", "water_temp", "wind_dir_deg"])
    return prepare.fill_ranks(prepare.fill_flags(wide), prediction=True).drop("race_date", "venue", "wind_speed", "wave_height")


_RANKS = Q.SCORED + ", q as (select *, case when lane = race_key::bigint % 9 + 1 then null when lane = race_key::bigint % 8 then 0 else rank end r from lr)"


@query(_RANKS + ", t as (select race_key, count(*) filter (where r > 0) known, list(lane order by r, lane) filter (where r > 0) best, list(p order by lane) again from (select *, row_number() over (partition by race_key order by case when r >= 1 then r else 7 end, lane) p from q) group by race_key) select race_key, case when known >= 3 then array_to_string(best[1:3], '-') end trifecta, array_to_string(again, '-') reranked, case when race_key::bigint % 3 = 0 then race_key::bigint * 1.5::double else 0.0::double end odds from t")
def race_rank_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Trifectas and unique ranks from ranks with gaps and zeros; odds kept on hits alone."""
    k = F.col("race_key").cast("long")
    ranks = F.transform("ranks", lambda r, i: F.when(i + 1 == k % 9 + 1, F.lit(None).cast("int")).when(i + 1 == k % 8, F.lit(0)).otherwise(r))
    return X.scored(spark, sf).select("race_key", S.trifecta_text(ranks).alias("trifecta"), F.array_join(S.rerank(ranks).cast("array<string>"), "-").alias("reranked"), S.masked_odds(k * 1.5, F.when(k % 3 == 0, F.lit(True)).when(k % 3 == 1, F.lit(False))).alias("odds"))


@query(ORACLES["race_trifecta_top"].replace('rk::integer "rank", combination, round(p, 6) p, round(1 / p, 3) fair_odds', "combination, round(p, 6) p"))
def race_top_map(spark: SparkSession, sf: str) -> DataFrame:
    """The map from the ten likeliest trifectas to their probabilities, a row each."""
    return Q.rounded(X.scored(spark, sf).select("race_key", F.explode(S.probability_map(F.col("scores"))).alias("combination", "p")), "p")


@query(f"with {Q.ENTRANTS} select race_key, lane, racer_id, case when lane <= 3 then cast(45 + race_key::bigint % 10 as integer) end weight from ent")
def race_program_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Entrants with the weight of the programme, which knows three lanes."""
    races = X.races(spark, sf).select("race_key", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("lane"), (45 + F.col("race_key").cast("long") % 10).cast("int").alias("weight_kg"))
    return core.boat_info(X.entrants_raw(spark, sf), X.SEQUENCE, races).select("race_key", "lane", "racer_id", "weight")


_BEFORE = f"""with {Q.RACES}, before as (select l_orderkey, strftime(race_date, '%Y-%m-%d') || '-' || lpad(race_no::varchar, 2, '0') || '-' || venue race_key, race_date, venue, l_linenumber lane, l_suppkey racer_id, cast(l_partkey % 6 + 1 as integer) course, l_tax exh_time, l_quantity, cast(round(l_discount * 100) as integer) h, l_shipdate, l_partkey, l_suppkey, l_extendedprice
  from lineitem join races on l_orderkey = k where l_linenumber <= 6),
boats as (select *, exists (select 1) one from before qualify row_number() over (partition by race_key, lane order by course, l_orderkey desc, l_shipdate desc, l_partkey desc, l_suppkey desc, l_extendedprice desc, l_quantity desc) = 1),
readings as (select strftime(race_date, '%Y-%m-%d') || '-' || lpad(race_no::varchar, 2, '0') || '-' || venue race_key, k, wind_speed_m, wave_height_cm, k % 17 icon from races where k % 3 <> 0),
sky as (select * from readings qualify row_number() over (partition by race_key order by lpad(k::varchar, 12, '0') desc) = 1)"""


def before_info(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pre-race entrants, readings (of two races in three) and race keys, as their files would give them."""
    r = X.races(spark, sf).withColumn("k", F.col("race_key").cast("long"))
    loads = X.table(spark, sf, "lineitem").where("l_linenumber <= 6").join(r.select("k", "race_date", "race_no", F.col("venue").alias("stadium")), F.col("l_orderkey") == F.col("k"))
    h = F.lpad(F.round(F.col("l_discount") * 100).cast("int").cast("string"), 2, "0")
    boats = loads.select("stadium", "race_date", "race_no", F.col("l_linenumber").alias("lane"), F.col("l_suppkey").alias("racer_id"), F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("kg")).alias("weight_raw"), F.col("l_tax").alias("exh_time"), F.lit(0.5).alias("tilt_deg"), F.concat(F.lit("F."), h).alias("st_time_raw"), (F.col("l_partkey") % 6 + 1).cast("int").alias("course"), "l_orderkey", *X.SEQUENCE)
    text = lambda c, unit: F.concat(F.col(c).cast("string"), F.lit(unit))
    readings = r.where("k % 3 <> 0").select(F.col("venue").alias("stadium"), "race_date", "race_no", F.lpad(F.col("k").cast("string"), 12, "0").alias("obs_time_label"), F.lit("晴").alias("weather_txt"), F.lit("15.0℃").alias("air_temp_raw"), text("wind_speed_m", "m").alias("wind_speed_raw"), F.lit("").alias("water_temp_raw"), text("wave_height_cm", "cm").alias("wave_height_raw"), F.concat(F.lit("is-wind"), (F.col("k") % 17).cast("string")).alias("wind_dir_raw"))
    keys = core.races(r.withColumn("race_key", C.race_key(F.col("race_date"), F.col("race_no"), F.col("venue"))))
    return core.pred_boat_info(boats, ["l_orderkey", *X.SEQUENCE]), core.pred_weather(readings), keys


@query(_BEFORE + """ select race_key, lane, racer_id, l_quantity weight, exh_time, true fs_flag, -h / 100.0::double bf_st_time, course bf_course from boats""")
def race_before_boats(spark: SparkSession, sf: str) -> DataFrame:
    """Pre-race entrants conformed: of several loads the lowest course."""
    return before_info(spark, sf)[0].select("race_key", "lane", "racer_id", "weight", "exh_time", "fs_flag", F.col("bf_st_time").cast("double").alias("bf_st_time"), "bf_course")


@query(_BEFORE + """ select race_key, 15.0::double air_temp, wind_speed_m::double wind_speed, wave_height_cm::double wave_height, null::double water_temp, case when icon between 1 and 16 then (icon % 16) * 22.5::double end wind_dir_deg from sky""")
def race_before_weather(spark: SparkSession, sf: str) -> DataFrame:
    return before_info(spark, sf)[1].select("race_key", "air_temp", "wind_speed", "wave_height", "water_temp", "wind_dir_deg")


@query(_BEFORE + """, k as (select distinct race_key, race_date, venue from before) select race_key, race_date, venue, max(wind_speed_m)::double wind_speed, round(max(wave_height_cm) * 0.01::double, 6) wave_height, null::double air_temp, """ + ", ".join(f"max(case when lane = {i} then racer_id end) lane{i}_racer_id, max(case when lane = {i} then course end) lane{i}_bf_course" for i in range(1, 7)) + " from boats join k using (race_key, race_date, venue) left join sky using (race_key) group by 1, 2, 3")
def race_before_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Prediction rows: entrants with the weather where there is any, one row a race, in training units."""
    boats, sky, keys = before_info(spark, sf)
    flat = features.boat_flat(boats, sky, None, keys.select("race_key", "race_date", "venue").distinct(), how="left")
    wide = core.conform_units(features.pivot_lanes(flat, ("racer_id", "bf_course"), ("race_date", "venue", "wind_speed", "wave_height"), whole=False))
    return Q.rounded(wide, "wave_height").drop("water_temp")


_POSITIONS = """pos as (select race_key, min(lane) filter (where p = 1) a, min(lane) filter (where p = 2) b, min(lane) filter (where p = 3) c from (select *, row_number() over (partition by race_key order by rank, lane) p from flat) group by race_key)"""


@query(Q.FLAT + ", " + _POSITIONS + " select race_key, case when b is not null and c is not null and race_key::bigint % 3 <> 0 then round(payout_yen / 2.0::double / 100.0::double, 6) end trio_odds from pos join races using (race_key)")
def race_trio_odds(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation rows with the odds of the unordered three, which two races in three have."""
    f = Q.flat(spark, sf)
    positions = features.finishing_positions(f)
    lanes = ("first_lane", "second_lane", "third_lane")
    paid = positions.join(X.races(spark, sf).select("race_key", "payout_yen", "popularity_rank"), "race_key")
    low, mid, high = C.sort_three(*(F.col(c) for c in lanes))
    trio = paid.where("cast(race_key as long) % 3 <> 0").select("race_key", low.alias("first_lane"), mid.alias("second_lane"), high.alias("third_lane"), (F.col("payout_yen") / 2).alias("payout_yen"))
    return Q.rounded(features.evaluation(f.select("race_key").distinct(), positions, paid, trio), "trio_odds").select("race_key", "trio_odds")


@query(f"""with d as ({_DIGITS}), t as (select * from d where o_orderkey % 2 = 0) select cast(o_orderkey // 10 as varchar) race_key, a::integer first_lane, b::integer second_lane, c::integer third_lane, arg_max(cast(floor(o_totalprice) as integer), o_orderkey) payout_yen from t group by all""")
def race_payout_lanes(spark: SparkSession, sf: str) -> DataFrame:
    """The latest trifecta payout of each three lanes of a race, from raw labels and spellings."""
    k = F.col("k")
    abc = [(F.floor(k / d) % 6 + 1).cast("int").cast("string") for d in (1, 6, 36)]
    raw = orders(spark, sf).select(F.floor(k / 10).cast("string").alias("race_key"), F.when(k % 2 == 0, picked(["３連単", "TRIFECTA", "三連単"], k % 3)).otherwise("３連複").alias("bet_type"), F.concat_ws("－", *abc).alias("combination"), F.floor("o_totalprice").cast("int").alias("payout_yen"), "k")
    paid = core.payouts(raw, ["k"])
    return core.payouts_by_lanes(paid, "3連単", True, ["k"]).select("race_key", "first_lane", "second_lane", "third_lane", "payout_yen")


@query(f"with {Q.RACES} select race_key, trifecta_odds from races left join (select cast(l_orderkey as varchar) race_key, arg_max(l_extendedprice, (l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity)) trifecta_odds from lineitem where l_returnflag = 'A' group by 1) using (race_key)")
def race_merged_odds(spark: SparkSession, sf: str) -> DataFrame:
    """Races whose stale odds give way to the last loaded ones."""
    odds = X.table(spark, sf, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").cast("string").alias("race_key"), F.col("l_extendedprice").alias("trifecta_odds"), F.col("l_extendedprice"), *(c for c in X.SEQUENCE if c != "l_extendedprice"))
    return features.merge_odds(X.bets(spark, sf), odds, X.SEQUENCE).select("race_key", "trifecta_odds")


@query(Q.BETS + " select race_key, true_order_rank, gap from bets where race_key in (select cast(l_orderkey as varchar) from lineitem where l_returnflag = 'N' and l_quantity > 40)")
def race_selected(spark: SparkSession, sf: str) -> DataFrame:
    """Races of a list of keys that repeats some; a report's columns that are there."""
    keys = X.table(spark, sf, "lineitem").where("l_returnflag = 'N' and l_quantity > 40").select(F.col("l_orderkey").cast("string").alias("race_key"))
    return features.report_columns(features.select_races(X.bets(spark, sf), keys), ["race_key", "no_such_column", "true_order_rank", "gap"])


@query(Q.SCORED + ", p as (select race_key, string_agg(lane::varchar, '-' order by pred) filter (where pred <= 3) tri, string_agg(lane::varchar, '-' order by rank) filter (where rank <= 3) official_tri, max(es) / sum(es) prob, count(*) filter (where pred <= 3 and rank <= 3) = 3 hit_set from lr group by race_key) select race_key, tri, official_tri, tri = official_tri hit_exact, hit_set, case when prob > 0.18 then true end \"over\" from p")
def race_prediction_report(spark: SparkSession, sf: str) -> DataFrame:
    d = X.scored(spark, sf)
    said = d.select("race_key", S.order_text(S.predicted_order(F.col("scores"))).alias("tri"), F.array_max(S.softmax(F.col("scores"))).alias("prob"))
    true = d.select("race_key", S.order_text(S.true_order(F.col("ranks"))).alias("official_tri"))
    return signals.prediction_report(said, true, 0.18).drop("prob")


@query(Q.FLAT + " select race_key, lane, round((lane - course) / 5.0, 6) + 0.0 deviation, (lane <> course)::integer::double violation from flat")
def race_course_gap(spark: SparkSession, sf: str) -> DataFrame:
    gap, off = prepare.course_deviation(F.col("lane"), F.col("course"))
    return Q.flat(spark, sf).select("race_key", "lane", (F.round(gap, 6) + 0.0).alias("deviation"), off.alias("violation"))


_FRAME = Q.FLAT + """, env as (select avg(w) wm, case when stddev_pop(w) > 0 then stddev_pop(w) else 1 end ws, avg(h) hm, case when stddev_pop(h) > 0 then stddev_pop(h) else 1 end hs from (select race_key, max(wind_speed) w, max(wave_height) h from flat group by race_key)),
pool as (select avg(weight) km, case when stddev_pop(weight) > 0 then stddev_pop(weight) else 1 end ks from flat)"""


@query(_FRAME + " select round(wm, 6) wind_speed_mean, round(ws, 6) wind_speed_std, round(hm, 6) wave_height_mean, round(hs, 6) wave_height_std, round(km, 5) weight_mean, round(ks, 5) weight_std, null::double air_temp_mean from env, pool")
def race_frame_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Environment statistics of a frame, and those of the weight over all lanes together."""
    s = prepare.frame_stats(_wide(spark, sf))
    return s.select(*(F.round(f"{c}_{k}", 6).alias(f"{c}_{k}") for c in ("wind_speed", "wave_height") for k in ("mean", "std")), F.round("weight_mean", 5).alias("weight_mean"), F.round("weight_std", 5).alias("weight_std"), "air_temp_mean")


@query(_FRAME + """, l as (select race_key, unnest(range(1, 7))::integer lane from (select distinct race_key from flat)), x as (select l.race_key, l.lane, coalesce(f.exh_time, 0) exh, coalesce(f.weight, 0) weight, coalesce(f.status = 'F', false) fs, coalesce(f.course, 0) course, coalesce(f.rank, 7)::integer rnk, coalesce(case when f.status = 'F' then -f.start_timing else f.start_timing end, 0) st from l left join flat f on l.race_key = f.race_key and l.lane = f.lane),
y as (select x.*, avg(exh) over w m, stddev_pop(exh) over w s from x window w as (partition by race_key)), r as (select race_key, max(wind_speed) ws_, max(wave_height) wh_ from flat group by race_key)
select race_key, lane, round((ws_ - wm) / ws, 5) + 0.0 ctx_wind, round((wh_ - hm) / hs, 5) + 0.0 ctx_wave, 0.0::double ctx_air, round((exh - m) / case when s < 1e-6 then 1 else s end, 5) + 0.0 exh_z, fs::integer::double fs_flag, weight, round((weight - km) / ks, 5) + 0.0 weight_z, round((lane - course) / 5.0, 5) + 0.0 gap, (lane <> course)::integer::double off, rnk \"rank\", round(st, 6) + 0.0 st, (st <> 0)::integer::double mask from y join r using (race_key), env, pool""")
def race_model_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """The nested inputs of the scoring network, a row for each lane; lanes without an entrant are zeros."""
    wide = _wide(spark, sf).drop(*(f"lane{i}_bf_st_time" for i in range(1, 7))).withColumns({"wind_sin": F.lit(0.0), "wind_cos": F.lit(1.0)})
    rows = prepare.model_inputs(wide, prepare.frame_stats(wide))
    lane = rows.select("race_key", "ctx", F.posexplode(F.arrays_zip("boats", "ranks", "st", "mask")).alias("i", "x"))
    five = lambda c: F.round(c, 5) + 0.0
    b = lambda j: F.col("x.boats")[j]
    return lane.select("race_key", (F.col("i") + 1).alias("lane"), five(F.col("ctx")[0]).alias("ctx_wind"), five(F.col("ctx")[1]).alias("ctx_wave"), five(F.col("ctx")[2]).alias("ctx_air"), five(b(0)).alias("exh_z"), b(1).alias("fs_flag"), b(2).alias("weight"), five(b(3)).alias("weight_z"), five(b(4)).alias("gap"), b(5).alias("off"), F.col("x.ranks").alias("rank"), (F.round("x.st", 6) + 0.0).alias("st"), F.col("x.mask").alias("mask"))


@query("with r as (" + ORACLES["race_conditions"] + ") select top_n, condition, count(distinct label) n_bins from r group by all")
def race_bin_counts(spark: SparkSession, sf: str) -> DataFrame:
    return roi.bins_by_condition(roi.condition_report(X.bets(spark, sf)))


@query("with r as (" + ORACLES["race_conditions"] + f") select top_n, condition, label, n_races, n_hits, hit_rate, roi_net from r qualify row_number() over (partition by top_n order by roi_net desc, n_races desc, hit_rate desc, list_position({LISTED(roi.CONDITIONS)}, condition), label) = 1")
def race_best_by_top_n(spark: SparkSession, sf: str) -> DataFrame:
    """The best condition for each number of tickets."""
    best = roi.best_conditions(roi.condition_report(X.bets(spark, sf)))
    return Q.rounded(best, "hit_rate").select("top_n", "condition", "label", "n_races", F.col("n_hits").cast("long").alias("n_hits"), "hit_rate", F.round("roi_net", 5).alias("roi_net"))


@query(Q.SCORED + ", r as (select race_key, " + ", ".join(f"max(case when lane = {i} and rank = {i} then 1 else 0 end) b{i}" for i in (1, 2, 3)) + ", max(case when rank <= 3 then lane end) = 3 trio from lr group by race_key) select round(avg(b1), 6) base1, round(avg(b2), 6) base2, round(avg(b3), 6) base3, round(avg(b1 * b2 * b3), 6) base_trifecta, round(avg(trio::integer), 6) base_trio from r")
def race_baselines(spark: SparkSession, sf: str) -> DataFrame:
    """What always betting on 1-2-3 hits."""
    return metrics.quality(X.scored(spark, sf)).select(*(F.round(c, 6).alias(c) for c in ("base1", "base2", "base3", "base_trifecta", "base_trio")))


@query(Q.SCORED + ", p as (select score, case when lane <> race_key::bigint % 7 then other else 0 end actual from lr) select round(avg((score - actual) * (score - actual)), 8) mse, round(avg(abs(score - actual)), 8) mae from p where actual <> 0")
def race_start_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Start-time errors over the lanes that have a true time."""
    e = X.table(spark, sf, "embeddings")
    other = F.transform(F.slice("embedding", 7, 6).cast("array<double>"), lambda x, i: F.when(i + 1 != F.col("vec_id") % 7, x).otherwise(F.lit(0.0)))
    return Q.rounded(metrics.start_errors(e.select(F.slice("embedding", 1, 6).cast("array<double>").alias("st_pred"), other.alias("st"))), "mse", "mae", digits=8)


@query(Q._DAYS + ", w as (select cast(date_trunc('month', strptime(hd, '%Y%m%d')) as date) start, sum(total)::bigint total, sum(hits)::bigint hits, sum(returned)::bigint returned from d group by 1) select start, total, hits, returned, last_day(start) \"end\" from w where last_day(start) <= date '2024-02-15'")
def race_monthly_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly sums of complete months."""
    return signals.roll_up(signals.daily_summary(Q.settled(spark, sf)), "month", "2024-02-15").select("start", "total", "hits", "returned", "end")


_KEYS = "select distinct lpad(cast(user_id % 24 + 1 as varchar), 2, '0') jcd, strftime(ts, '%Y%m%d') hd, cast(user_id % 12 + 1 as integer) rno from events"


@query(f"with k as ({_KEYS}), s as ({_KEYS} where event_type = 'purchase') select * from k anti join s using (jcd, hd, rno)")
def race_unsent(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts that were not sent before."""
    ticks, closing = X.ticks(spark, sf)
    e = X.table(spark, sf, "events").where("event_type = 'purchase'").select(F.col("event_id").cast("string").alias("top_trifecta"))
    sent = ticks.join(e, "top_trifecta", "left_semi").select("jcd", "hd", "rno")
    return signals.unsent(closing.select("jcd", "hd", "rno"), sent)


@query(Q.TICKS + " select jcd, hd, rno, min(ts) close_ts from t group by all")
def race_deadlines(spark: SparkSession, sf: str) -> DataFrame:
    """The first deadline that was seen of each race of a day."""
    return signals.deadlines(X.ticks(spark, sf)[0].withColumnRenamed("ts", "close_ts"))


_OPEN = Q.TICKS + """, s as (select jcd, hd, rno, arg_max(top_trifecta, (ts, top_trifecta)) t from t group by all), o as (select *, case t::bigint % 3 when 0 then '1-2-3' when 1 then '3-1-2' else '4-5-6' end tri, case when t::bigint % 4 <> 0 then '2-1-3' end official_tri, case when t::bigint % 4 <> 0 then cast(t::bigint % 900 as integer) end payout_yen from s)"""


def signals_and_results(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Sent signals and the official results of three races in four."""
    last = signals.latest_per_race(X.ticks(spark, sf)[0])
    t = F.col("top_trifecta").cast("long")
    sent = last.select("jcd", "hd", "rno", picked(["1-2-3", "3-1-2", "4-5-6"], t % 3).alias("tri"), F.lit(True).alias("sent"), t.alias("_t"))
    official = sent.where("_t % 4 <> 0").select("jcd", "hd", "rno", F.lit("2-1-3").alias("official_tri"), (F.col("_t") % 900).cast("int").alias("payout_yen"))
    return sent.drop("_t"), official


@query(_OPEN + " select jcd, hd, rno, tri, official_tri, payout_yen, official_tri is not null completed, case when official_tri is not null then tri <> '4-5-6' end hit, case when official_tri is not null then case when tri <> '4-5-6' then payout_yen - 500 else -500 end end pl_yen from o")
def race_settled(spark: SparkSession, sf: str) -> DataFrame:
    """Signals with late results: open ones stay, with nulls."""
    return signals.settle(*signals_and_results(spark, sf)).select("jcd", "hd", "rno", "tri", "official_tri", "payout_yen", "completed", "hit", "pl_yen")


@query(_OPEN + " select jcd, hd, rno, tri, 'hit' kind, payout_yen from o where official_tri is not null and tri <> '4-5-6' union all select jcd, hd, rno, tri, 'day', null from o where hd = '20240110' union all select jcd, hd, rno, tri, 'later', null from o where hd > '20240120'")
def race_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Hits only, sent signals of a day and signals after a day, stacked with fixed columns."""
    sent, official = signals_and_results(spark, sf)
    kind = lambda df, n: df.withColumn("kind", F.lit(n))
    hits = kind(signals.hits_only(signals.settle(sent, official)), "hit")
    parts = [hits, kind(signals.sent_on(sent, "20240110"), "day"), kind(signals.after_day(sent, "20240120"), "later")]
    return features.stack_reports([parts[0], *(p.drop("sent") for p in parts[1:])], ["jcd", "hd", "rno", "tri", "kind", "payout_yen"])


@query(Q.TICKS + " select jcd, hd, rno, top_trifecta, printf('%s %dR %s p=%.3f', jcd, rno, top_trifecta, floor(top_prob * 100) / 100) \"text\", 'https://example.org/result?rno=' || rno || '&jcd=' || jcd || '&hd=' || hd url from t")
def race_messages(spark: SparkSession, sf: str) -> DataFrame:
    return signals.message(X.ticks(spark, sf)[0].withColumn("top_prob", F.floor(F.col("top_prob") * 100) / 100)).select("jcd", "hd", "rno", "top_trifecta", "text", "url")


@query(Q.SCORED + ", s as (select race_key, max(score) best from lr group by race_key), o as (select cast(o_orderkey as varchar) race_key, o_totalprice odds from orders where o_orderkey % 2 = 0), sky as (select cast(l_orderkey as varchar) race_key, arg_max(l_tax, (l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)) wind from lineitem group by 1), p as (select race_key, round(var_pop(score), 5) variance from lr group by race_key) select race_key, round(best, 6) best, odds, wind, variance from s left join o using (race_key) left join sky using (race_key) left join p using (race_key)")
def race_scores_joined(spark: SparkSession, sf: str) -> DataFrame:
    """Scores beside odds, the last environment row and the Plackett-Luce features."""
    d = X.scored(spark, sf)
    o = X.table(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("string").alias("race_key"), F.col("o_totalprice").alias("odds"))
    sequence = ["l_shipdate", "l_linenumber", *X.SEQUENCE[1:]]
    e = X.table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("race_key"), F.col("l_tax").alias("wind"), *sequence)
    pl = d.select("race_key", F.round(S.trifecta_gap(F.col("scores"))["variance"], 5).alias("variance"))
    return Q.rounded(features.join_scores(d.select("race_key", F.array_max("scores").alias("best")), o, e, pl, sequence), "best")


@query(Q.BETS + " select race_key, round(sin(radians(wind_dir_deg)), 6) + 0.0 wind_sin, case when sin(radians(wind_dir_deg)) < 0 then 1 else 0 end::integer tailwind, round(wind_speed * 2, 6) doubled from bets")
def race_registered_features(spark: SparkSession, sf: str) -> DataFrame:
    """Registered features, one of which needs another; one is left out."""
    r = features.Registry()
    r.register("tailwind", F.col("wind_sin") < 0, ("wind_sin",), "int")
    r.register("wind_sin", F.sin(F.radians("wind_dir_deg")), ("wind_dir_deg",))
    r.register("doubled", F.col("wind_speed") * 2, ("wind_speed",))
    r.register("left_out", F.lit(1.0), ())
    r.register("no_input", F.lit(1.0), ("no_such_column",))
    return r.apply(X.bets(spark, sf), exclude=("left_out",)).select("race_key", (F.round("wind_sin", 6) + 0.0).alias("wind_sin"), "tailwind", "doubled")


@query(f"with {Q.RACES} select race_key, strftime(race_date, '%Y-%m-%d') || '-' || lpad(race_no::varchar, 2, '0') || '-' || venue conformed_key, race_date, venue from races")
def race_conformed_races(spark: SparkSession, sf: str) -> DataFrame:
    """Races joined to their event (a venue and day) and venue."""
    t = lambda n: X.table(spark, sf, n)
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), "c_nationkey")
    event_id = F.concat_ws("/", F.col("c_nationkey").cast("string"), F.col("day").cast("string")).alias("event_id")
    race = o.select(event_id, (F.col("o_orderkey") % 12 + 1).cast("int").alias("race_no"), F.col("o_orderkey").cast("string").alias("id"))
    event = o.select(event_id, F.col("c_nationkey").alias("venue_id"), F.col("day").alias("event_date")).distinct()
    out = core.conform_races(race, event, t("nation").select(F.col("n_nationkey").alias("venue_id"), F.col("n_name").alias("name")))
    return out.select(F.col("id").alias("race_key"), F.col("race_key").alias("conformed_key"), "race_date", "venue")
