"""Registered queries of the race operators on the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import conform as C
from ..functions import scores as S
from ..operators import core, features, metrics, prepare, roi, signals
from ..sources import pages
from . import standins as X
from .registry import ORACLES, QUERIES, query  # noqa: F401 - named here for callers

RACES = """races as (select cast(o_orderkey as varchar) race_key, cast(o_orderdate as date) race_date, n_name venue, cast(o_orderkey % 12 + 1 as integer) race_no,
  cast(o_orderkey % 11 as integer) wind_speed_m, cast(o_orderkey % 13 as integer) wave_height_cm, (o_orderkey % 16) * 22.5::double wind_dir_deg, o_totalprice payout_yen, cast(o_custkey % 120 + 1 as integer) popularity_rank, o_orderkey k
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""
ENTRANTS = """loads as (select cast(l_orderkey as varchar) race_key, l_linenumber lane, l_suppkey racer_id, cast(l_partkey % 6 + 1 as integer) course, l_tax exh_time, l_discount start_timing,
  case when l_returnflag = 'R' then 'F' end status, l_quantity weight, l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity from lineitem where l_linenumber <= 6),
fin as (select *, row_number() over (partition by race_key order by l_extendedprice desc, lane, l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity) finish_order from loads),
ent as (select *, case when finish_order <= 6 then finish_order else 7 end rank from fin
  qualify row_number() over (partition by race_key, lane order by l_shipdate desc, l_partkey desc, l_suppkey desc, l_extendedprice desc, l_quantity desc) = 1)"""
FLAT = f"""with {RACES}, {ENTRANTS}, flat as (select ent.*, race_date, venue, wind_speed_m::double wind_speed, wind_dir_deg, wave_height_cm / 100.0::double wave_height from ent join races using (race_key))"""
SCORED = """with e as (select cast(vec_id as varchar) race_key, cast(label as varchar) venue, list_transform(list_slice(embedding, 1, 6), lambda x: x::double) s, list_transform(list_slice(embedding, 7, 12), lambda x: x::double) o from embeddings),
lanes as (select race_key, unnest(range(1, 7))::integer lane, unnest(s) score, unnest(o) other from e),
lr as (select *, row_number() over (partition by race_key order by other desc, lane)::integer rank, row_number() over (partition by race_key order by score desc, lane)::integer pred,
  exp(score - max(score) over (partition by race_key)) es from lanes)"""
TRIPLES = """tri as (select a.race_key, a.lane i, b.lane j, c.lane k, a.es / d.t * (b.es / (d.t - a.es)) * (c.es / (d.t - a.es - b.es)) p
  from lr a join lr b on a.race_key = b.race_key and a.lane <> b.lane join lr c on a.race_key = c.race_key and c.lane <> a.lane and c.lane <> b.lane
  join (select race_key, sum(es order by lane) t from lr group by race_key) d on a.race_key = d.race_key)"""
BETS = f"""with {RACES}, bets as (select race_key, race_date, venue, cast((k * 7919) % 40 + 1 as integer) true_order_rank, case when k % 17 <> 0 then round(payout_yen / 1000.0, 2) end trifecta_odds,
  ((k * 104729) % 1009) / 1009.0::double pl_prob, ((k * 1299709) % 499) / 499.0::double gap, wind_speed_m::double wind_speed, wave_height_cm / 10.0::double wave_height, wind_dir_deg from races)"""
TICKS = """with t as (select lpad(cast(user_id % 24 + 1 as varchar), 2, '0') jcd, strftime(ts, '%Y%m%d') hd, cast(user_id % 12 + 1 as integer) rno, ts, cast(event_id as varchar) top_trifecta, value / 500.0 top_prob from events),
near as (select * from t where ts between strptime(hd, '%Y%m%d') + interval 18 hour - interval 120 minute and strptime(hd, '%Y%m%d') + interval 18 hour),
lim as (select * from (values ('01', 0.20, 0.30), ('07', 0.16, 0.28), ('12', 0.116, 0.20), ('15', 0.35, 0.45), ('19', 0.27, 0.40), ('20', 0.22, 0.25), ('24', 0.15, 0.22)) v(jcd, threshold, max_prob))"""


def flat(spark: SparkSession, sf: str) -> DataFrame:
    """Entrants with rank and boat columns from one dedupe of the raw rows, beside their race's weather."""
    boats = core.entrants(X.entrants_raw(spark, sf), X.SEQUENCE).withColumn("bf_course", F.col("course"))
    return features.boat_flat(boats, X.weather(spark, sf), None, core.races(X.races(spark, sf)))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(FLAT + " select racer_id, course, venue, count(*) starts, count(*) filter (where rank = 1) firsts, round(count(*) filter (where rank <= 1) / count(*), 6) first_rate, round(count(*) filter (where rank <= 2) / count(*), 6) two_rate, round(count(*) filter (where rank <= 3) / count(*), 6) three_rate from flat group by all")
def race_course_stats(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: latest entrants joined to races and weather, then each racer's record by course and venue."""
    return rounded(features.course_stats(flat(spark, sf)), "first_rate", "two_rate", "three_rate")


@query(FLAT + " select race_key, lane, racer_id, course, exh_time, status = 'F' fs_flag, case when status = 'F' then -start_timing else start_timing end st_time, weight, rank::integer \"rank\", race_date, venue, wind_speed, wave_height from flat")
def race_boat_flat(spark: SparkSession, sf: str) -> DataFrame:
    return flat(spark, sf).select("race_key", "lane", "racer_id", "course", "exh_time", "fs_flag", "st_time", "weight", "rank", "race_date", "venue", "wind_speed", "wave_height")


@query(f"with {ENTRANTS} select race_key, lane, rank::integer \"rank\", 'NIGE' win_pattern from ent")
def race_results_latest(spark: SparkSession, sf: str) -> DataFrame:
    return core.results(X.entrants_raw(spark, sf), X.SEQUENCE).select("race_key", "lane", "rank", "win_pattern")


_PIVOT = ", ".join(f"max(case when lane = {i} then {c} end) lane{i}_{c}" for i in range(1, 7) for c in ("racer_id", "exh_time", "course")) + ", " + ", ".join(f"bool_or(case when lane = {i} then status = 'F' end) lane{i}_fs_flag" for i in range(1, 7))


@query(FLAT + f" select race_key, max(race_date) race_date, max(venue) venue, max(wind_speed) wind_speed, {_PIVOT} from flat group by race_key having count(distinct race_date) = 1 and count(distinct venue) = 1")
def race_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return features.pivot_lanes(flat(spark, sf), ("racer_id", "exh_time", "course", "fs_flag"), ("race_date", "venue", "wind_speed"))


@query(FLAT + ", st as (select racer_id, course, venue, count(*) starts, count(*) filter (where rank = 1) / count(*) fr, count(*) filter (where rank <= 3) / count(*) tr from flat group by all) select race_key, " + ", ".join(f"max(starts) filter (where lane = {i}) lane{i}_starts, round(max(fr) filter (where lane = {i}), 6) lane{i}_first_rate, round(max(tr) filter (where lane = {i}), 6) lane{i}_three_rate" for i in range(1, 7)) + " from flat left join st using (racer_id, course, venue) group by race_key")
def race_lane_stats(spark: SparkSession, sf: str) -> DataFrame:
    f = flat(spark, sf)
    wide = features.pivot_lanes(f, ("racer_id", "bf_course"), ("race_date", "venue"))
    out = features.with_lane_stats(wide, features.course_stats(f))
    rates = [f"lane{i}_{r}" for i in range(1, 7) for r in ("first_rate", "three_rate")]
    return rounded(out.select("race_key", *(f"lane{i}_starts" for i in range(1, 7)), *rates), *rates)


@query(FLAT + """, pos as (select race_key, min(lane) filter (where p = 1) first_lane, min(lane) filter (where p = 2) second_lane, min(lane) filter (where p = 3) third_lane from (select *, row_number() over (partition by race_key order by rank, lane) p from flat) group by race_key)
select race_key, first_lane, second_lane, third_lane, least(first_lane, second_lane, third_lane) low_lane, case when third_lane is not null and second_lane is not null then greatest(first_lane, second_lane, third_lane) end high_lane, case when first_lane is not null and second_lane is not null and third_lane is not null then round(payout_yen / 100.0, 4) end trifecta_odds, case when third_lane is not null then popularity_rank end trifecta_popularity_rank
from (select distinct race_key from flat) f left join pos using (race_key) left join races using (race_key)""".replace("least(first_lane, second_lane, third_lane) low_lane", "case when third_lane is not null and second_lane is not null then least(first_lane, second_lane, third_lane) end low_lane"))
def race_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    f = flat(spark, sf)
    positions = features.finishing_positions(f)
    paid = positions.join(X.races(spark, sf), "race_key").select("race_key", "first_lane", "second_lane", "third_lane", "payout_yen", "popularity_rank")
    out = features.evaluation(f.select("race_key").distinct(), positions, paid)
    low, _, high = C.sort_three(F.col("first_lane"), F.col("second_lane"), F.col("third_lane"))
    return rounded(out.withColumns({"low_lane": low, "high_lane": high}), "trifecta_odds", digits=4).select("race_key", "first_lane", "second_lane", "third_lane", "low_lane", "high_lane", "trifecta_odds", "trifecta_popularity_rank")


@query(FLAT + " select race_key, " + ", ".join(f"max(case when lane = {i} then rank end)::integer lane{i}_rank" for i in range(1, 7)) + " from flat group by race_key")
def race_rank_columns(spark: SparkSession, sf: str) -> DataFrame:
    return features.rank_columns(flat(spark, sf))


@query(FLAT + " select venue, round(avg(exh_time), 6) exh_time_mean, round(case when stddev_pop(exh_time) > 0 then stddev_pop(exh_time) else 1 end, 6) exh_time_std, round(avg(weight), 6) weight_mean, round(case when stddev_pop(weight) > 0 then stddev_pop(weight) else 1 end, 6) weight_std from flat group by venue")
def race_scaler(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(prepare.fit_scaler(flat(spark, sf), ["exh_time", "weight"], ["venue"]), "exh_time_mean", "exh_time_std", "weight_mean", "weight_std")


@query(FLAT + " select race_key, lane, round((weight - avg(weight) over ()) / stddev_pop(weight) over (), 5) weight from flat")
def race_standardised(spark: SparkSession, sf: str) -> DataFrame:
    f = flat(spark, sf).select("race_key", "lane", "weight")
    return rounded(prepare.standardise(f, prepare.fit_scaler(f, ["weight"]), ["weight"]), "weight", digits=5)


@query(FLAT + ", z as (select race_key, lane, exh_time - avg(exh_time) over w d, stddev_pop(exh_time) over w s from flat window w as (partition by race_key)) select race_key, lane, round(d / case when s < 1e-6 then 1 else s end, 5) + 0.0 exh_time_z from z")
def race_within_z(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.race_z(flat(spark, sf).select("race_key", "lane", "exh_time"), ["exh_time"]).select("race_key", "lane", (F.round("exh_time_z", 5) + 0.0).alias("exh_time_z"))


@query(f"""with {RACES}, b as (select count(*) n, min(race_date) first_day, max(race_date) last_day from races),
r as (select *, greatest(0.10, least(0.25, greatest(least(greatest(120.0 / (last_day - first_day + 1), 0.15), 0.25), least(greatest(1000.0 / n, 0.15), 0.25), 0.15)))::double r from b),
o as (select race_date - date '1970-01-01' d, row_number() over (order by race_date) - 1 i, (n - 1) * (1 - r) pos_ from races, r),
q as (select r.*, date '1970-01-01' + floor((select max(d) filter (where i = floor(pos_)) + (max(d) filter (where i = ceil(pos_)) - max(d) filter (where i = floor(pos_))) * (max(pos_) - floor(max(pos_))) from o))::integer c from r)
select n, first_day, last_day, round(r, 6) r, case when last_day - c < 120 then last_day - 120 else c end cutoff from q""")
def race_split(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(prepare.split_cutoff(X.races(spark, sf)), "r")


@query(BETS + ", e as (select venue, list_distinct(quantile_cont(pl_prob, [0, 0.25, 0.5, 0.75, 1.0])) edges from bets group by venue) select race_key, greatest(1, len(list_filter(edges, lambda x: x < pl_prob)))::integer - 1 bin from bets join e using (venue)")
def race_quantile_bins(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.with_quantile_bin(X.bets(spark, sf), "pl_prob", 4, "b", ["venue"]).select("race_key", F.col("b.id").alias("bin"))


@query(BETS + " select 'trifecta_odds' \"column\", round(avg((trifecta_odds is null)::integer), 6) null_ratio, sum((trifecta_odds is null)::integer)::bigint nulls from bets union all select 'venue', round(avg((venue is null)::integer), 6), sum((venue is null)::integer)::bigint from bets")
def race_null_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features.null_report(X.bets(spark, sf).select("trifecta_odds", "venue")), "null_ratio")


@query("select 'orders' name, count(*) n, count(*) > 0 has_data from orders union all select 'lineitem', count(*), count(*) > 0 from lineitem union all select 'events', count(*), count(*) > 0 from events")
def race_row_counts(spark: SparkSession, sf: str) -> DataFrame:
    return core.row_counts({n: X.table(spark, sf, n) for n in ("orders", "lineitem", "events")})


@query(SCORED + " select race_key, lane, round(es / sum(es) over (partition by race_key), 6) p, round(1 / (es / sum(es) over (partition by race_key)), 4) fair_odds from lr")
def race_win_probability(spark: SparkSession, sf: str) -> DataFrame:
    p = X.scored(spark, sf).select("race_key", F.posexplode(S.softmax(F.col("scores"))).alias("lane", "p"))
    return p.select("race_key", (F.col("lane") + 1).alias("lane"), F.round("p", 6).alias("p"), F.round(S.fair_odds(F.col("p")), 4).alias("fair_odds"))


@query(SCORED + ", " + TRIPLES + " select race_key, rk::integer \"rank\", combination, round(p, 6) p, round(1 / p, 3) fair_odds from (select *, i || '-' || j || '-' || k combination, row_number() over (partition by race_key order by p desc, i, j, k) rk from tri) where rk <= 10")
def race_trifecta_top(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.scored(spark, sf).select("race_key", F.inline(S.top_exotics(F.col("scores"), 3))), "p").withColumn("fair_odds", F.round("fair_odds", 3))


@query(SCORED + ", ex as (select a.race_key, a.lane || '-' || b.lane combination, a.lane i, b.lane j, a.es / t * (b.es / (t - a.es)) p from lr a join lr b on a.race_key = b.race_key and a.lane <> b.lane join (select race_key, sum(es order by lane) t from lr group by race_key) d on a.race_key = d.race_key) select race_key, rk::integer \"rank\", combination, round(p, 6) p from (select *, row_number() over (partition by race_key order by p desc, i, j) rk from ex) where rk <= 10")
def race_exacta_top(spark: SparkSession, sf: str) -> DataFrame:
    return X.scored(spark, sf).select("race_key", F.inline(S.top_exotics(F.col("scores"), 2))).select("race_key", "rank", "combination", F.round("p", 6).alias("p"))


@query(SCORED + ", " + TRIPLES + ", b as (select race_key, max(case when rk = 1 then combination end) label, max(case when rk = 1 then p end) p1, max(case when rk = 2 then p end) p2 from (select *, i || '-' || j || '-' || k combination, row_number() over (partition by race_key order by p desc, i, j, k) rk from tri) group by race_key), v as (select race_key, var_pop(score) variance, -sum(pw * ln(pw + 1e-12)) entropy from (select *, es / sum(es) over (partition by race_key) pw from lr) group by race_key) select race_key, label, round(p1, 6) p1, round(p1 - p2, 6) gap, round(entropy, 5) entropy, round(variance, 5) variance from b join v using (race_key)")
def race_trifecta_gap(spark: SparkSession, sf: str) -> DataFrame:
    g = X.scored(spark, sf).select("race_key", S.trifecta_gap(F.col("scores")).alias("g")).select("race_key", "g.*")
    return g.select("race_key", "label", F.round("p1", 6).alias("p1"), F.round("gap", 6).alias("gap"), F.round("entropy", 5).alias("entropy"), F.round("variance", 5).alias("variance"))


@query(SCORED + """, o as (select *, sum(es) over (partition by race_key order by rank rows between current row and unbounded following) rest from lr), t as (select race_key, exp(sum(ln(es / rest))) p from o group by race_key), """ + TRIPLES + """, st as (select race_key, list_sort(list(lane)) top from lr where rank <= 3 group by race_key), sp as (select tri.race_key, sum(p) q from tri join st on tri.race_key = st.race_key and list_sort([i, j, k]) = top group by tri.race_key) select race_key, round(p, 8) order_prob, round(q, 6) set_prob from t join sp using (race_key)""")
def race_true_probability(spark: SparkSession, sf: str) -> DataFrame:
    s, r = F.col("scores"), F.col("ranks")
    return X.scored(spark, sf).select("race_key", F.round(S.true_order_probability(s, r), 8).alias("order_prob"), F.round(S.true_set_probability(s, r), 6).alias("set_prob"))


@query(SCORED + ", " + TRIPLES + """, tt as (select race_key, max(lane) filter (where rank = 1) a, max(lane) filter (where rank = 2) b, max(lane) filter (where rank = 3) c from lr group by race_key),
rk as (select *, row_number() over (partition by race_key order by p desc, i, j, k) n from tri),
sets as (select a.race_key, a.lane i, b.lane j, c.lane k, a.score + b.score + c.score v from lr a join lr b on a.race_key = b.race_key and a.lane < b.lane join lr c on a.race_key = c.race_key and b.lane < c.lane),
sr as (select *, row_number() over (partition by race_key order by v desc, i, j, k) n from sets)
select tt.race_key, sr.n::integer set_rank, rk.n::integer trifecta_rank from tt join rk on tt.race_key = rk.race_key and (rk.i, rk.j, rk.k) = (a, b, c) join sr on tt.race_key = sr.race_key and [sr.i, sr.j, sr.k] = list_sort([a, b, c])""")
def race_true_ranks(spark: SparkSession, sf: str) -> DataFrame:
    s, r = F.col("scores"), F.col("ranks")
    return X.scored(spark, sf).select("race_key", S.set_rank(s, r).alias("set_rank"), S.trifecta_rank(s, r).alias("trifecta_rank"))


@query(SCORED + ", " + """p6 as (select a.race_key, a.lane l1, b.lane l2, c.lane l3, d.lane l4, e.lane l5, f.lane l6, [a.rank, b.rank, c.rank, d.rank, e.rank, f.rank] rs,
  round(ln(a.es) - ln(a.es + b.es + c.es + d.es + e.es + f.es) + ln(b.es) - ln(b.es + c.es + d.es + e.es + f.es) + ln(c.es) - ln(c.es + d.es + e.es + f.es) + ln(d.es) - ln(d.es + e.es + f.es) + ln(e.es) - ln(e.es + f.es), 12) lp
  from lr a join lr b on a.race_key = b.race_key and b.lane <> a.lane join lr c on a.race_key = c.race_key and c.lane not in (a.lane, b.lane) join lr d on a.race_key = d.race_key and d.lane not in (a.lane, b.lane, c.lane) join lr e on a.race_key = e.race_key and e.lane not in (a.lane, b.lane, c.lane, d.lane) join lr f on a.race_key = f.race_key and f.lane not in (a.lane, b.lane, c.lane, d.lane, e.lane)),
 n6 as (select race_key, rs, row_number() over (partition by race_key order by lp desc, l1, l2, l3, l4, l5, l6) n from p6)
select race_key, min(n) filter (where rs = [1, 2, 3, 4, 5, 6])::integer order_rank, min(n) filter (where list_sort(rs[1:3]) = [1, 2, 3])::integer set_rank from n6 group by race_key""")
def race_full_order_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks among the 720 full orders."""
    return S.full_order_ranks(X.scored(spark, sf))


@query(SCORED + """, r as (select race_key, max(case when pred = 1 and rank = 1 then 1 else 0 end) h1, max(case when pred = 2 and rank = 2 then 1 else 0 end) h2, max(case when pred = 3 and rank = 3 then 1 else 0 end) h3,
 max(case when lane = 1 and rank = 1 then 1 else 0 end) b1, sum(case when pred <= 3 and rank <= 3 then 1 else 0 end) s3, max(case when rank = 1 then 1.0 / pred end) rr, 1 - 6 * sum((pred - rank) * (pred - rank)) / 210.0 sp, var_samp(score) vs from lr group by race_key)
select count(*) n_races, round(avg(h1), 6) hit1, round(avg(h2), 6) hit2, round(avg(h3), 6) hit3, round(avg(h1 * h2 * h3), 6) trifecta_hit, round(avg(case when s3 = 3 then 1 else 0 end), 6) trio_hit, round(avg(b1), 6) base1, round(avg(rr), 6) mrr, round(avg(sp), 6) spearman, round(avg(vs), 5) spread_mean, round(quantile_disc(vs, 0.5), 5) spread_median from r""")
def race_model_quality(spark: SparkSession, sf: str) -> DataFrame:
    q = metrics.quality(X.scored(spark, sf))
    return q.select("n_races", *(F.round(c, 6).alias(c) for c in ("hit1", "hit2", "hit3", "trifecta_hit", "trio_hit", "base1", "mrr", "spearman")), *(F.round(c, 5).alias(c) for c in ("spread_mean", "spread_median")))


@query(BETS + ", m as (select b.race_key, true_order_rank, popularity_rank, popularity_rank - true_order_rank gain from bets b join races r using (race_key)) select count(*) n_races, round(avg(popularity_rank), 6) market_rank, round(avg(true_order_rank), 6) model_rank, round(avg(gain), 6) gain_mean, round(median(gain), 6) gain_median, round(avg((gain > 0)::integer), 6) beat_rate, round(avg((true_order_rank <= 1)::integer), 6) model_top1, round(avg((popularity_rank <= 3)::integer), 6) market_top3 from m")
def race_model_vs_market(spark: SparkSession, sf: str) -> DataFrame:
    model = X.bets(spark, sf).select("race_key", F.col("true_order_rank").alias("trifecta_rank"))
    m = metrics.model_vs_market(model, X.races(spark, sf).select("race_key", "popularity_rank"))
    return m.select("n_races", *(F.round(c, 6).alias(c) for c in ("market_rank", "model_rank", "gain_mean", "gain_median", "beat_rate", "model_top1", "market_top3")))


@query(SCORED + """, c as (select *, greatest(-20.0, least(20.0, score)) s from lr), o as (select *, ln(sum(exp(s)) over (partition by race_key order by rank rows between current row and unbounded following)) - s term from c),
n as (select race_key, sum(term) full_nll, sum(term * (4 - rank)) filter (where rank <= 3) / 6 top3, sum(abs(pred - rank)) / 6.0 l1 from o group by race_key),
k as (select a.race_key, avg(ln(1 + exp(-sign(b.rank - a.rank) * (a.score - b.score)))) rn from lr a join lr b on a.race_key = b.race_key and a.lane < b.lane group by a.race_key)
select round(avg(full_nll), 5) pl_nll, round(avg(top3), 5) pl_top3, round(avg(rn), 5) ranknet, round(avg(l1), 5) rank_l1 from n join k using (race_key)""")
def race_losses(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.losses(X.scored(spark, sf)), "pl_nll", "pl_top3", "ranknet", "rank_l1", digits=5)


@query(BETS + " select n::integer n, races, races * n * 100 submitted, round(benefit, 2) benefit, round(benefit / (races * n * 100) * 100, 4) roi_pct from (select n, count(*) races, sum(case when true_order_rank <= n then coalesce(trifecta_odds, 0) * 100 else 0 end) benefit from bets, range(1, 6) t(n) group by n)")
def race_top_n(spark: SparkSession, sf: str) -> DataFrame:
    return roi.top_n_simulation(X.bets(spark, sf)).withColumns({"benefit": F.round("benefit", 2), "roi_pct": F.round("roi_pct", 4)})


_LONG = """known as (select * from bets where trifecta_odds is not null),
e as (select list_distinct(quantile_cont(pl_prob, [0, 0.25, 0.5, 0.75, 1.0])) pe, list_distinct(quantile_cont(gap, [0, 0.25, 0.5, 0.75, 1.0])) ge from known),
b as (select known.*, greatest(1, len(list_filter(pe, lambda x: x < pl_prob))) - 1 pb, greatest(1, len(list_filter(ge, lambda x: x < gap))) - 1 gb,
  case when wind_speed < 2 then 0 when wind_speed < 4 then 1 when wind_speed < 6 then 2 when wind_speed < 8 then 3 else 4 end wb, case when wave_height < 0.5 then 0 when wave_height < 1 then 1 when wave_height < 2 then 2 else 3 end vb, case when sin(radians(wind_dir_deg)) < 0 then 1 else 0 end tw from known, e),
long as (select 'pl_prob_bin' condition, pb::varchar label, * from b union all select 'gap_bin', gb::varchar, * from b union all select 'wind_bin', wb::varchar, * from b union all select 'wave_bin', vb::varchar, * from b union all select 'tailwind', tw::varchar, * from b union all select 'venue', venue, * from b)"""


@query(BETS + ", " + _LONG + " select condition, label, n::integer top_n, count(*) n_races, count(*) filter (where true_order_rank <= n) n_hits, round(count(*) filter (where true_order_rank <= n) / count(*), 6) hit_rate, round((sum(case when true_order_rank <= n then trifecta_odds else 0 end) - n * count(*)) / (n * count(*)), 5) roi_net from long, range(1, 6) t(n) group by 1, 2, 3, n having count(*) >= case when condition = 'venue' then 50 else 30 end")
def race_conditions(spark: SparkSession, sf: str) -> DataFrame:
    r = roi.condition_report(X.bets(spark, sf))
    return r.select("condition", "label", "top_n", "n_races", F.col("n_hits").cast("long").alias("n_hits"), F.round("hit_rate", 6).alias("hit_rate"), F.round("roi_net", 5).alias("roi_net"))


_SETS = ORACLES["race_conditions"].replace("long as (select 'pl_prob_bin'", "sets as (select pb, gb, wb, vb, tw, venue, n, grouping(pb) * 32 + grouping(gb) * 16 + grouping(wb) * 8 + grouping(vb) * 4 + grouping(tw) * 2 + grouping(venue) g, count(*) races, count(*) filter (where true_order_rank <= n) hits, sum(case when true_order_rank <= n then trifecta_odds else 0 end) ret\n  from b, range(1, 6) t(n) group by grouping sets ((pb, n), (gb, n), (wb, n), (vb, n), (tw, n), (venue, n))),\nold as (select 'pl_prob_bin'")
_SETS = _SETS[: _SETS.index(",\nold as (")] + """
select case g when 31 then 'pl_prob_bin' when 47 then 'gap_bin' when 55 then 'wind_bin' when 59 then 'wave_bin' when 61 then 'tailwind' when 62 then 'venue' end condition, coalesce(pb::varchar, gb::varchar, wb::varchar, vb::varchar, tw::varchar, venue) label,
  n::integer top_n, races n_races, hits n_hits, round(hits / races, 6) hit_rate, round((ret - n * races) / (n * races), 5) roi_net from sets where races >= case when g = 62 then 50 else 30 end"""


@query(_SETS)
def race_condition_sets(spark: SparkSession, sf: str) -> DataFrame:
    """The condition report by one GROUPING SETS aggregate."""
    r = roi.condition_sets(X.bets(spark, sf))
    return r.select("condition", "label", "top_n", "n_races", F.col("n_hits").cast("long").alias("n_hits"), F.round("hit_rate", 6).alias("hit_rate"), F.round("roi_net", 5).alias("roi_net"))


_WALK = BETS + ", " + """span as (select min(race_date) a, max(race_date) b from bets), win as (select k::integer w, a + (120 + 30 * k)::integer t0 from span, range(0, 1000) r(k) where a + (120 + 30 * k)::integer <= b),
placed as (select w, true tune, bets.* from bets join win on race_date >= t0 - 120 and race_date < t0 union all select w, false, bets.* from bets join win on race_date >= t0 and race_date < t0 + 30),
fit as (select w from placed group by w having count(*) filter (where tune) >= 50 and count(*) filter (where not tune) >= 10),
e as (select w, quantile_cont(pl_prob, [0, 0.25, 0.5, 0.75, 1.0]) pe, quantile_cont(gap, [0, 0.25, 0.5, 0.75, 1.0]) ge from placed where tune and trifecta_odds is not null group by w),
b as (select p.*, case when len(list_distinct(pe)) > 1 and pl_prob between pe[1] and pe[5] then greatest(1, len(list_filter(list_distinct(pe), lambda x: x < pl_prob))) - 1 end pb, case when len(list_distinct(ge)) > 1 and gap between ge[1] and ge[5] then greatest(1, len(list_filter(list_distinct(ge), lambda x: x < gap))) - 1 end gb,
  case when wind_speed < 2 then 0 when wind_speed < 4 then 1 when wind_speed < 6 then 2 when wind_speed < 8 then 3 else 4 end wb, case when wave_height < 0.5 then 0 when wave_height < 1 then 1 when wave_height < 2 then 2 else 3 end vb, case when sin(radians(wind_dir_deg)) < 0 then 1 else 0 end tw from placed p join e using (w) where w in (select w from fit)),
long as (select 1 place, 'pl_prob_bin' condition, pb::varchar label, * from b union all select 2, 'gap_bin', gb::varchar, * from b union all select 3, 'wind_bin', wb::varchar, * from b union all select 4, 'wave_bin', vb::varchar, * from b union all select 5, 'tailwind', tw::varchar, * from b union all select 6, 'venue', venue, * from b),
rep as (select w, place, condition, label, n::integer top_n, count(*) filter (where tune and trifecta_odds is not null) races, count(*) filter (where tune and trifecta_odds is not null and true_order_rank <= n) hits, coalesce(sum(trifecta_odds) filter (where tune and true_order_rank <= n), 0) ret,
  count(*) filter (where not tune) n_races, count(*) filter (where not tune and true_order_rank <= n) n_hits, coalesce(sum(trifecta_odds) filter (where not tune and true_order_rank <= n), 0) total_return from long, range(1, 6) t(n) where label is not null group by all),
good as (select *, (ret - top_n * races) / (top_n * races) tune_roi, count(*) over (partition by w, top_n, condition) bins from rep where races >= case when condition = 'venue' then 50 else 30 end),
chosen as (select * from good where bins > 1 and hits >= 3 qualify row_number() over (partition by w, top_n order by tune_roi desc, races desc, hits / races desc, place, label) = 1)"""


@query(_WALK + " select w \"window\", top_n, condition, label, n_races, n_hits, round(total_return, 2) total_return, round((total_return - n_races * top_n) / nullif(n_races * top_n, 0), 11) roi_net, round(tune_roi, 11) tune_roi from chosen")
def race_walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    """Rolling windows: the condition chosen on the tune days and what it returns on the test days."""
    w = roi.walk_forward(X.bets(spark, sf))
    return w.select("window", "top_n", "condition", "label", "n_races", "n_hits", F.round("total_return", 2).alias("total_return"), F.round("roi_net", 11).alias("roi_net"), F.round("tune_roi", 11).alias("tune_roi"))


@query(BETS + """, known as (select * from bets where trifecta_odds is not null), e as (select list_distinct(quantile_cont(pl_prob, list_transform(range(0, 11), lambda x: x / 10.0))) pe from known),
d as (select known.*, greatest(1, len(list_filter(pe, lambda x: x < pl_prob)))::integer - 1 decile from known, e),
g as (select decile, n::integer top_n, count(*) n_races, avg(pl_prob) pm, median(pl_prob) pd, count(*) filter (where true_order_rank <= n) h, sum(case when true_order_rank <= n then trifecta_odds else 0 end) r from d, (values (1), (2), (3), (5)) t(n) group by decile, n)
select decile, top_n, n_races, round(pm, 6) prob_mean, round(pd, 6) prob_median, h n_hits, round(h / n_races, 6) hit_rate, round((r - top_n * n_races) / (top_n * n_races), 5) roi_net, round(r / nullif(sum(r) over (partition by top_n), 0), 6) return_share, round(h / nullif(sum(h) over (partition by top_n), 0), 6) hit_share from g""")
def race_decile_audit(spark: SparkSession, sf: str) -> DataFrame:
    a = roi.decile_audit(X.bets(spark, sf))
    return a.select("decile", "top_n", "n_races", F.round("prob_mean", 6).alias("prob_mean"), F.round("prob_median", 6).alias("prob_median"), F.col("n_hits").cast("long").alias("n_hits"), F.round("hit_rate", 6).alias("hit_rate"), F.round("roi_net", 5).alias("roi_net"), F.round("return_share", 6).alias("return_share"), F.round("hit_share", 6).alias("hit_share"))


@query(_WALK + " select top_n, sum(n_races)::bigint n_races, sum(n_hits)::bigint n_hits, round(sum(total_return), 2) total_return, count(*) windows, round((sum(total_return) - sum(n_races * top_n)) / nullif(sum(n_races * top_n), 0), 11) roi_net from chosen group by top_n")
def race_walk_total(spark: SparkSession, sf: str) -> DataFrame:
    t = roi.walk_forward_total(roi.walk_forward(X.bets(spark, sf)))
    return t.select("top_n", "n_races", "n_hits", F.round("total_return", 2).alias("total_return"), "windows", F.round("roi_net", 11).alias("roi_net"))


_DRAW = "(('0x' || substr(md5(race_key || '|' || lane || '|0|{k}'), 1, 12))::bigint + 0.5::double) / 281474976710656.0::double"
_VOTES = SCORED + ", n as (select *, " + ", ".join(_DRAW.format(k=k) + f" u{k}" for k in (0, 1)) + """ from lr),
v as (select race_key, lane, score / 0.8::double + case when lane <= 2 then 0.15 else 0 end::double safe, score / 1.3::double + case when lane >= 4 then 0.2 else 0 end::double + 0.07::double * sqrt(-2 * ln(u0)) * cos(2 * pi() * u1) chaos, score trend from n),
c as (select race_key, unnest([array_to_string(list(lane order by safe desc, lane)[1:3], '-'), array_to_string(list(lane order by chaos desc, lane)[1:3], '-'), array_to_string(list(lane order by trend desc, lane)[1:3], '-')]) trifecta from v group by race_key),
votes as (select race_key, trifecta, count(*) votes from c group by all)"""


@query(_VOTES + " select * from votes")
def race_persona_votes(spark: SparkSession, sf: str) -> DataFrame:
    """Votes of three bettors; one of them draws noise from md5 digests of race, lane and seed."""
    votes, _ = metrics.persona_votes(X.scored(spark, sf))
    return votes


@query(_VOTES + " select race_key, max(votes) max_votes, 3 - max(votes) disagreement from votes group by race_key")
def race_persona_disagreement(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.persona_votes(X.scored(spark, sf))[1]


@query("select cast(l_orderkey as varchar) race_key, l_linenumber lane, l_suppkey racer_id, l_shipdate from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by case when l_shipdate >= timestamp '1998-01-01' then 1 else 0 end desc, l_shipdate desc, l_partkey desc, l_suppkey desc, l_extendedprice desc, l_quantity desc) = 1")
def race_upsert(spark: SparkSession, sf: str) -> DataFrame:
    loads = X.table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("race_key"), F.col("l_linenumber").alias("lane"), *X.SEQUENCE)
    old, new = (loads.where(f"l_shipdate {op} timestamp '1998-01-01'") for op in ("<", ">="))
    return core.upsert(old, new, ["race_key", "lane"], X.SEQUENCE).select("race_key", "lane", F.col("l_suppkey").alias("racer_id"), "l_shipdate")


@query("select l_orderkey, l_linenumber, l_suppkey from lineitem a where l_returnflag = 'R' and not exists (select 1 from lineitem b where b.l_returnflag = 'A' and a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber) qualify row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity) = 1")
def race_insert_absent(spark: SparkSession, sf: str) -> DataFrame:
    loads = X.table(spark, sf, "lineitem")
    return core.insert_absent(loads.where("l_returnflag = 'A'"), loads.where("l_returnflag = 'R'"), ["l_orderkey", "l_linenumber"], X.SEQUENCE).select("l_orderkey", "l_linenumber", "l_suppkey")


@query(TICKS + " select jcd, hd, rno, ts, top_trifecta, round(top_prob, 6) top_prob from near")
def race_ticks_in_time(spark: SparkSession, sf: str) -> DataFrame:
    t, closing = X.ticks(spark, sf)
    return signals.in_time(t, closing, 120).select("jcd", "hd", "rno", "ts", "top_trifecta", F.round("top_prob", 6).alias("top_prob"))


@query(TICKS + """, s as (select near.*, threshold, max_prob, coalesce(top_prob > threshold, false) over_ from near left join lim using (jcd)),
r as (select *, bool_or(over_) over w any_over, row_number() over (partition by jcd, hd, rno order by case when over_ then 0 else 1 end, ts, top_trifecta) f, row_number() over (partition by jcd, hd, rno order by ts desc, top_trifecta desc) l from s window w as (partition by jcd, hd, rno))
select jcd, hd, rno, any_over sent, ts, top_trifecta, round(top_prob, 6) top_prob, round(case when any_over then (top_prob - threshold) / (max_prob - threshold) end, 5) strength from r where (any_over and f = 1) or (not any_over and l = 1)""")
def race_send_once(spark: SparkSession, sf: str) -> DataFrame:
    t, closing = X.ticks(spark, sf)
    sent = signals.send_once(signals.in_time(t, closing, 120), signals.thresholds(spark))
    return sent.select("jcd", "hd", "rno", "sent", "ts", "top_trifecta", F.round("top_prob", 6).alias("top_prob"), F.round("strength", 5).alias("strength"))


_SETTLED = """with t as (select strftime(ts, '%Y%m%d') hd, event_type <> 'error' completed, event_type = 'purchase' hit, cast(floor(value * 10) as bigint) payout from events)"""
_DAYS = _SETTLED + ", d as (select hd, count(*) total, count(*) filter (where completed) completed, count(*) filter (where hit) hits, coalesce(sum(payout * 5) filter (where hit), 0)::bigint returned from t group by hd)"


def settled(spark: SparkSession, sf: str) -> DataFrame:
    e = X.table(spark, sf, "events")
    return e.select(F.date_format("ts", "yyyyMMdd").alias("hd"), F.lit(True).alias("sent"), (F.col("event_type") != "error").alias("completed"), (F.col("event_type") == "purchase").alias("hit"), F.floor(F.col("value") * 10).alias("payout_yen"))


@query(_DAYS + " select hd, total, completed, hits, completed * 500 staked, returned, returned - completed * 500 pnl, round(hits / completed, 6) hit_rate, round(returned / (completed * 500), 6) roi_gross from d")
def race_daily_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(signals.daily_summary(settled(spark, sf)), "hit_rate", "roi_gross").select("hd", "total", "completed", "hits", "staked", "returned", "pnl", "hit_rate", "roi_gross")


@query(_DAYS + ", w as (select cast(date_trunc('week', strptime(hd, '%Y%m%d')) as date) start, sum(total)::bigint total, sum(completed)::bigint completed, sum(hits)::bigint hits, sum(returned)::bigint returned from d group by 1) select start, total, completed, hits, returned, returned - completed * 500 pnl, round(hits / completed, 6) hit_rate, cast(start + 6 as date) \"end\" from w")
def race_weekly_summary(spark: SparkSession, sf: str) -> DataFrame:
    w = signals.roll_up(signals.daily_summary(settled(spark, sf)), "week")
    return rounded(w, "hit_rate").select("start", "total", "completed", "hits", "returned", "pnl", "hit_rate", "end")


@query("select o_orderkey, cast(last_day(o_orderdate - interval 1 month) as date) train_until, cast(date_trunc('month', o_orderdate - interval 1 month) as date) eval_from, isodow(o_orderdate) = 7 is_week_end, cast(o_orderdate as date) = last_day(o_orderdate) is_month_end from orders")
def race_calendar(spark: SparkSession, sf: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    cut = C.month_cutoffs(day)
    return X.table(spark, sf, "orders").select("o_orderkey", cut["train_until"].alias("train_until"), cut["eval_from"].alias("eval_from"), *(c.alias(n) for n, c in C.period_ends(day).items()))


@query(SCORED + ", p as (select race_key, string_agg(lane::varchar, '-' order by pred) filter (where pred <= 3) pred, string_agg(lane::varchar, '-' order by rank) filter (where rank <= 3) true_, count(*) filter (where pred <= 3 and rank <= 3) = 3 trio_hit from lr group by race_key) select race_key, pred pred_order, true_ true_order, pred = true_ trifecta_hit, trio_hit from p")
def race_orders_and_hits(spark: SparkSession, sf: str) -> DataFrame:
    d = X.scored(spark, sf).withColumns({"p": S.predicted_order(F.col("scores")), "t": S.true_order(F.col("ranks"))})
    return d.select("race_key", S.order_text(F.col("p")).alias("pred_order"), S.order_text(F.col("t")).alias("true_order"), S.hit_ordered(F.col("p"), F.col("t")).alias("trifecta_hit"), S.hit_unordered(F.col("p"), F.col("t")).alias("trio_hit"))


@query("select page_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(html || url, '(?:page|rno)=([0-9]{1,2})', 1), lambda x: x::integer), lambda x: x between 1 and 12)))::varchar numbers, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') page from pages")
def race_page_links(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers and a query value from pages' links (their links say page where race pages say rno)."""
    p = X.table(spark, sf, "pages")
    numbers = pages.race_numbers(F.regexp_replace(F.concat("html", "url"), "page=", "rno="))
    return p.select("page_id", F.concat(F.lit("["), F.concat_ws(", ", numbers.cast("array<string>")), F.lit("]")).alias("numbers"), pages.query_value(F.col("url"), "page").alias("page"))


@query("select conv_id, turn, trim(regexp_replace(text, '[ \\t　]+', ' ', 'g')) tidy from conversations")
def race_tidy_text(spark: SparkSession, sf: str) -> DataFrame:
    return X.table(spark, sf, "conversations").select("conv_id", "turn", C.collapse_spaces(F.col("text")).alias("tidy"))


@query(BETS + " select race_key, case when wind_speed < 2 then 0 when wind_speed < 4 then 1 when wind_speed < 6 then 2 when wind_speed < 8 then 3 else 4 end::integer wind_bin, case when wave_height < 0.5 then 0 when wave_height < 1 then 1 when wave_height < 2 then 2 else 3 end::integer wave_bin, round(sin(radians(wind_dir_deg)), 6) + 0.0 wind_sin, round(cos(radians(wind_dir_deg)), 6) + 0.0 wind_cos from bets")
def race_wind_and_waves(spark: SparkSession, sf: str) -> DataFrame:
    sin, cos = C.wind_parts(F.col("wind_dir_deg"))
    return X.bets(spark, sf).select("race_key", C.wind_bin(F.col("wind_speed"))["id"].alias("wind_bin"), C.wave_bin(F.col("wave_height"))["id"].alias("wave_bin"), (F.round(sin, 6) + 0.0).alias("wind_sin"), (F.round(cos, 6) + 0.0).alias("wind_cos"))


@query(f"with {ENTRANTS}, {RACES}, h as (select ent.*, race_date, venue from ent join races using (race_key)) select race_key, lane, count(*) over w starts, coalesce(sum((rank = 1)::integer) over w, 0)::bigint firsts from h window w as (partition by racer_id, course, venue order by race_date range between unbounded preceding and interval 1 day preceding)")
def race_course_stats_as_of(spark: SparkSession, sf: str) -> DataFrame:
    return features.course_stats_as_of(flat(spark, sf)).select("race_key", "lane", "starts", F.col("firsts").cast("long").alias("firsts"))


@query(ORACLES["race_conditions"].replace(" select condition,", ", rep as (select condition,", 1) + ") select * from rep order by roi_net desc, hit_rate desc, condition, label, top_n limit 10")
def race_best_conditions(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best rows of the condition report."""
    return roi.top_rows(race_conditions(spark, sf))


@query("with a as (" + ORACLES["race_decile_audit"] + ") select top_n, arg_min(hit_rate, decile) low_hit_rate, arg_min(roi_net, decile) low_roi_net, arg_max(hit_rate, decile) high_hit_rate, arg_max(roi_net, decile) high_roi_net from a group by top_n")
def race_decile_ends(spark: SparkSession, sf: str) -> DataFrame:
    return roi.decile_ends(race_decile_audit(spark, sf))


from . import clean, ingest, stored, access, running, models  # noqa: E402, F401 - they register their queries
