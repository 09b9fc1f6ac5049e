"""Queries of the sources: text reports, HTML pages, CSV files, feature stores, documents and streams.

Files and pages are made from the given tables, written to the shared folder where they are files, and read back by the
library's readers; the SQL states the values that went in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import conform as C
from ..operators import signals
from ..sources import pages, readers, reports
from ..streaming import alerts
from . import queries as Q
from . import standins as X
from .clean import LISTED, picked
from .registry import ORACLES, query

PLACES, SKIES = ["北西", "南", "東北東"], ["晴", "曇り", "雨"]
METHODS = ["逃げ", "まくり差し", "まくり", "差し", None]


def say(*parts) -> Column:
    """The parts one after the other: texts as they are, columns as text."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def padded(c: Column, n: int) -> Column:
    """A number with leading zeros up to n digits; longer ones stay whole."""
    return F.lpad(c.cast("string"), F.greatest(F.length(c.cast("string")), F.lit(n)), "0")


def by_race(spark: SparkSession, sf: str, line: Column) -> DataFrame:
    """Races with `lines`: the lines of their entrants (six at most) by lane."""
    lines = Q.flat(spark, sf).groupBy("race_key").agg(F.sort_array(F.collect_list(F.struct("lane", line.alias("line")))).alias("lines"))
    return X.races(spark, sf).join(lines, "race_key").withColumn("k", F.col("race_key").cast("long")).withColumn("lines", F.transform("lines", lambda x: x["line"]))


def hundredths(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("int")


def written_reports(spark: SparkSession, sf: str, text: DataFrame) -> DataFrame:
    """The texts as packed report files of many blocks, read again."""
    path = X.scratch(spark, "reports")
    text.write.option("maxRecordsPerFile", 500).option("compression", "gzip").text(path)
    return readers.read_reports(spark, path, pattern="*.txt.gz")


def result_files(spark: SparkSession, sf: str) -> DataFrame:
    start = F.when(F.col("fs_flag"), say("F0.", padded(hundredths("start_timing"), 2))).otherwise(say("0.", padded(hundredths("start_timing"), 2)))
    tag, time = F.when(F.col("fs_flag"), F.lit("F ")).otherwise(padded(F.col("rank"), 2)), F.when(F.col("fs_flag"), F.lit(".   .")).otherwise(say("1.49.", F.col("lane")))
    row = say("  ", tag, " ", F.col("lane"), " ", padded(F.col("racer_id"), 4), " 選　手　", picked(["太郎", "花子"], F.col("racer_id") % 2), " ", F.col("lane") + 10, "   ", F.col("lane") + 20, "  6.", padded(hundredths("exh_time"), 2), "   ", F.col("course"), "    ", start, "     ", time)
    row = F.when(F.col("lane") == 6, F.concat(row, F.lit("\n  not a row"))).otherwise(row)
    k, day = F.col("k"), F.col("race_date")
    text = say(
        "24KBGN\n", F.col("venue"), "［成績］      ", F.month(day), "/ ", F.dayofmonth(day), "      杯　", k % 9, "　競走　　  第 ", k % 6 + 1, "日\n\n   第 ", k % 6 + 1, "日          ", F.year(day), "/ ", F.month(day), "/ ", F.dayofmonth(day), "\n\n",
        "  ", F.col("race_no"), "R  ", picked(["一般", "予選   進入固定"], k % 2), "         H1800m  ", picked(SKIES, k % 3), "　  風  ", picked(PLACES, k % 3), "　  ", F.col("wind_speed_m"), "m  波　  ", F.col("wave_height_cm"), "cm\n",
        "  着 艇 登番 　選　手　名　　 ", F.coalesce(picked(METHODS, k % 5), F.lit("")), "\n", "-" * 40, "\n", F.array_join("lines", "\n"), "\n\n",
        "        ３連単   1-2-3  ", F.format_number(F.floor("payout_yen"), 0), "  人気  ", F.col("popularity_rank"), "\n                 2－3        340\n24KEND",
    )
    return written_reports(spark, sf, by_race(spark, sf, row).select(text.alias("value")))


_EVENT = "venue, '杯 ' || k % 9 || ' 競走' event_name, cast(k % 6 + 1 as integer) event_day_number, race_date event_date, race_no"
_RACED = Q.FLAT + ", r as (select * from races where race_key in (select race_key from flat))"


@query(_RACED + f" select {_EVENT}, case when k % 2 = 0 then '一般' else '予選' end category, case when k % 2 = 1 then '進入固定' end notes, 1800 distance_m, {LISTED(SKIES)}[k % 3 + 1] weather, {LISTED(PLACES)}[k % 3 + 1] wind_direction, wind_speed_m, wave_height_cm, {LISTED(METHODS)}[k % 5 + 1] winning_method from r")
def race_report_races(spark: SparkSession, sf: str) -> DataFrame:
    """Race headers of results reports."""
    return reports.result_races(result_files(spark, sf)).drop("source_file", "block_no", "line_no")


@query(Q.FLAT + """ select venue, race_date event_date, race_no, case when status is null then rank::integer end finish_order, status, lane, racer_id::integer reg_no, '選 手 ' || case when racer_id % 2 = 0 then '太郎' else '花子' end player_name, lane + 10 motor_no, lane + 20 boat_no,
round(6 + exh_time, 2) tenji_time, course course_entry, start_timing, case when status is null then '1.49.' || lane end race_time from flat join (select race_key, race_no from races) using (race_key)""")
def race_report_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Entrants of results reports; lines of another form are rejects."""
    return reports.result_rows(result_files(spark, sf))[0].drop("source_file", "block_no", "line_no")


@query(Q.FLAT + " select '  not a row' line, count(*) n from flat where lane = 6")
def race_report_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return reports.result_rows(result_files(spark, sf))[1].groupBy("line").agg(F.count("*").alias("n"))


@query(_RACED + " select venue, race_date event_date, race_no, '３連単' bet_type, '1-2-3' combination, cast(floor(payout_yen) as integer) payout_yen, popularity_rank from r union all select venue, race_date, race_no, '３連単', '2-3', 340, null from r")
def race_report_payouts(spark: SparkSession, sf: str) -> DataFrame:
    """Payouts of results reports, also on lines that have no label."""
    return reports.result_payouts(result_files(spark, sf)).drop("source_file", "block_no", "line_no", "pair_no")


def program_files(spark: SparkSession, sf: str) -> DataFrame:
    row = say(F.col("lane"), " ", padded(F.col("racer_id"), 4), picked(["山田太郎", "鈴木花子"], F.col("racer_id") % 2), 20 + F.col("racer_id") % 30, "福岡", 45 + F.col("racer_id") % 10, picked(["A1", "B2"], F.col("racer_id") % 2), " 6.", padded(hundredths("exh_time"), 2), " 45.00 5.", padded(hundredths("start_timing"), 2), " 40.00 ", F.col("lane") + 10, " 33.30 ", F.col("lane") + 20, " 31.20 1 2 3")
    k, day = F.col("k"), F.col("race_date")
    wide = F.translate(say(F.col("race_no"), "R"), "0123456789R", "０１２３４５６７８９Ｒ")
    text = say(
        "24BBGN\nボートレース", F.col("venue"), "   ", F.month(day), "月\n               ＊＊＊　番組表　＊＊＊\n              杯　", k % 9, "　競走\n   第　", k % 6 + 1, "日          ", F.year(day), "年　", F.month(day), "月　", F.dayofmonth(day), "日\n",
        "　", wide, "  ", picked(["一般", "予選"], k % 2), "     ", picked(["進入固定 ", ""], k % 2), "Ｈ１８００ｍ  電話投票締切予定", 8 + k % 10, "：", padded(k % 60, 2), "\n", "-" * 40, "\n艇 選手\n", "-" * 40, "\n", F.array_join("lines", "\n"), "\n24BEND",
    )
    return written_reports(spark, sf, by_race(spark, sf, row).select(text.alias("value")))


@query(_RACED + " select venue, race_date event_date, race_no, case when k % 2 = 0 then '一般' else '予選' end category, cast(1 - k % 2 as integer) entry_fixed, 1800 distance_m, lpad((8 + k % 10)::varchar, 2, '0') || ':' || lpad((k % 60)::varchar, 2, '0') phone_close_time, race_date + to_hours((8 + k % 10)::integer) + to_minutes((k % 60)::integer) phone_close_at from r")
def race_program_races(spark: SparkSession, sf: str) -> DataFrame:
    """Race headers of programmes, in full-width letters."""
    return reports.program_races(program_files(spark, sf)).drop("source_file", "block_no", "line_no")


@query(Q.FLAT + """ select venue, race_date event_date, race_no, lane, racer_id::integer reg_no, case when racer_id % 2 = 0 then '山田太郎' else '鈴木花子' end player_name, cast(20 + racer_id % 30 as integer) age, '福岡' branch, cast(45 + racer_id % 10 as integer) weight_kg, case when racer_id % 2 = 0 then 'A1' else 'B2' end class,
round(6 + exh_time, 2) nat_win_rate, 45.0::double nat_2rate, round(5 + start_timing, 2) local_win_rate, 40.0::double local_2rate, 33.3::double motor_2rate, 31.2::double boat_2rate, lane + 10 motor_no, lane + 20 boat_no, '1 2' series_note, '3' early_note from flat join (select race_key, race_no from races) using (race_key)""")
def race_program_entries(spark: SparkSession, sf: str) -> DataFrame:
    return reports.program_entries(program_files(spark, sf)).drop("source_file", "block_no", "line_no")


def unit(kind: str, value: Column | str, part: str = "Data") -> list:
    return [f'<div class="weather1_bodyUnit {kind}"><span class="weather1_bodyUnitLabel{part}">', value, "</span></div>"]


def weather_html() -> list:
    k = F.col("k")
    return [
        '<div class="weather1"><p class="weather1_title">気象 10:00現在</p>', *unit("is-direction", "15.0℃"), *unit("is-weather", picked(SKIES, k % 3), "Title"), *unit("is-wind", say(F.col("wind_speed_m"), "m")), *unit("is-waterTemperature", "20.0℃"), *unit("is-wave", say(F.col("wave_height_cm"), "cm")),
        '<div class="weather1_bodyUnit is-windDirection"><p class="weather1_bodyUnitImage is-wind', k % 16 + 1, '"></p></div></div>',
    ]


def head_html(label: Column | str = "結果") -> list:
    return [
        '<!DOCTYPE html><html><body><div class="heading1_mainLabel">', label, '</div><div class="heading2_area"><img alt="', picked(C.VENUES, F.col("k") % 24),
        '"></div><h2 class="heading2_titleName">杯 &amp; 旗</h2><div class="tab2_tabs"><ul><li>前<li class="is-active2">1月2日</ul></div>',
    ]


def page_rows(spark: SparkSession, sf: str, line: Column, body: list) -> DataFrame:
    return by_race(spark, sf, line).select(F.col("race_key").alias("path"), say(*body).alias("html"))


def before_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pre-race pages with unclosed cells; one in nine says that there is no data."""
    lane, racer = F.col("lane"), F.col("racer_id")
    shown = say('<div class="table1_boatImage1"><span class="table1_boatImage1Number">', lane, '</span><span class="table1_boatImage1TimeInner">.', padded(hundredths("start_timing"), 2), "</span></div>")
    row = say('<tbody class="is-fs12"><tr><td class="is-boatColor', lane, '">', lane, '<td><img src="', racer, '.jpg"><td><a href="/profile?toban=', racer, '">選　手 ', racer, "</a><td>", F.col("weight").cast("int"), ".0kg<td>6.", padded(hundredths("exh_time"), 2), "<td>-0.5<tr><td>0.5</tbody>")
    both = F.concat(shown, F.lit("\x01"), row)
    part = lambda i: F.array_join(F.transform("lines", lambda x: F.get(F.split(x, "\x01"), F.lit(i))), "")
    label = F.when(F.col("k") % 9 == 0, F.lit("データがありません")).otherwise("直前情報")
    return page_rows(spark, sf, both, head_html(label) + [part(0), '<table class="is-w748">', part(1), "</table>", *weather_html(), "</body></html>"])


_PLACE = f"(select race_key path, case when length(n) = 2 then n[1:1] || ' ' || n[2:2] else n end place, n, k, wind_speed_m, wave_height_cm, payout_yen, race_no, race_date from (select *, {LISTED(C.VENUES)}[k % 24 + 1] n from races))"


@query(Q.FLAT + f""" select path, place, lane, racer_id::varchar racer_id, '選 手 ' || racer_id "name", cast(weight as integer) || '.0kg' weight, '0.5' adjust_weight, '6.' || lpad(round(exh_time * 100)::integer::varchar, 2, '0') exhibition_time, '-0.5' tilt, racer_id || '.jpg' photo, '.' || lpad(round(start_timing * 100)::integer::varchar, 2, '0') st_time_raw,
cast(row_number() over (partition by path order by lane) as integer) course from flat join {_PLACE} on path = race_key where k % 9 <> 0""")
def race_page_racers(spark: SparkSession, sf: str) -> DataFrame:
    """Racers of pre-race pages beside the start exhibition."""
    return pages.before_rows(before_pages(spark, sf))[0]


_SKY = f"'気象 10:00現在' obs_time_label, {LISTED(SKIES)}[k % 3 + 1] weather_txt, '15.0℃' air_temp_raw, wind_speed_m || 'm' wind_speed_raw, '20.0℃' water_temp_raw, wave_height_cm || 'cm' wave_height_raw, 'is-wind' || (k % 16 + 1) wind_dir_raw"


@query(Q.FLAT + f" select path, place, {_SKY} from {_PLACE} where k % 9 <> 0 and path in (select race_key from flat)")
def race_page_weather(spark: SparkSession, sf: str) -> DataFrame:
    return pages.before_rows(before_pages(spark, sf))[1]


@query(Q.FLAT + f" select path, place, '杯 & 旗' race_title, '1月2日' date_label from {_PLACE} where k % 9 <> 0 and path in (select race_key from flat)")
def race_page_meta(spark: SparkSession, sf: str) -> DataFrame:
    return pages.before_rows(before_pages(spark, sf))[2]


def result_pages(spark: SparkSession, sf: str) -> DataFrame:
    lane, racer = F.col("lane"), F.col("racer_id")
    shown = say('<div class="table1_boatImage1"><span class="table1_boatImage1Number">', lane, '</span><span class="table1_boatImage1TimeInner">.', padded(hundredths("start_timing"), 2), "　逃げ</span></div>")
    row = say("<tbody><tr><td>", F.col("rank"), "</td><td>", lane, "</td><td><span>", racer, "</span><span>選　手", racer, "</span></td><td>1'49\"", lane, "</td></tr></tbody>")
    both = F.concat(shown, F.lit("\x01"), row)
    part = lambda i: F.array_join(F.transform("lines", lambda x: F.get(F.split(x, "\x01"), F.lit(i))), "")
    body = [
        '<div class="tab3_tabs"><a href="/result?rno=', F.col("race_no"), '&amp;jcd=01">R</a></div>', part(0), '<table class="is-w495"><thead><tr><th>着</th></tr></thead>', part(1), "</table>",
        '<table class="is-w495"><thead><tr><th>勝式</th></tr></thead><tbody><tr><td>3連単</td><td>1-2-3</td><td>&yen;', F.format_number(F.floor("payout_yen"), 0), "</td><td>", F.col("k") % 7 + 1, "</td></tr><tr><td></td><td>9</td><td>&nbsp;</td><td></td></tr></tbody></table>",
    ]
    return page_rows(spark, sf, both, head_html() + body + weather_html() + ["</body></html>"])


@query(Q.FLAT + f""" select path, n place, '杯 & 旗' race_title, '1月2日' date_label, race_no::varchar race_no, rank::varchar "position", lane, racer_id::varchar racer_no, '選 手' || racer_id racer_name, '1''49"' || lane "time", cast(row_number() over (partition by path order by lane) as integer) course, '.' || lpad(round(start_timing * 100)::integer::varchar, 2, '0') st_time, '逃げ' tactic from flat join {_PLACE} on path = race_key""")
def race_page_finishers(spark: SparkSession, sf: str) -> DataFrame:
    return pages.result_rows(result_pages(spark, sf))[0]


@query(Q.FLAT + f" select path, n place, race_no::varchar race_no, '3連単' bet_type, '1-2-3' combination, cast(floor(payout_yen) as integer) payout_yen, cast(k % 7 + 1 as integer) popularity from {_PLACE} where path in (select race_key from flat)")
def race_page_payouts(spark: SparkSession, sf: str) -> DataFrame:
    """Payouts of result pages, without continuation rows."""
    return pages.result_rows(result_pages(spark, sf))[1]


@query(Q.FLAT + f" select path, n place, race_no::varchar race_no, {_SKY} from {_PLACE} where path in (select race_key from flat)")
def race_result_weather(spark: SparkSession, sf: str) -> DataFrame:
    return pages.result_rows(result_pages(spark, sf))[2]


@query(f"with {Q.RACES}, r as (select race_key path, unnest([1, 2]) i, k, race_date from races) select path, case when i = 1 then cast(k % 12 + 1 as integer) else 7 end rno, (8 + k % 10) || ':' || lpad((k % 60)::varchar, 2, '0') \"time\", race_date + to_hours((8 + k % 10 - 9)::integer) + to_minutes((k % 60)::integer) close_ts, lpad((k % 24 + 1)::varchar, 2, '0') jcd, strftime(race_date, '%Y%m%d') hd from r")
def race_closing_times(spark: SparkSession, sf: str) -> DataFrame:
    """Deadlines of race index pages; the number is in the link or, without it there, in the link's text."""
    r = X.races(spark, sf).withColumn("k", F.col("race_key").cast("long"))
    link = lambda number, label: say('<tr><td><a href="/racelist?', number, "jcd=", padded(F.col("k") % 24 + 1, 2), "&amp;hd=", F.date_format("race_date", "yyyyMMdd"), '">', label, "</a></td><td>", 8 + F.col("k") % 10, ":", padded(F.col("k") % 60, 2), "</td></tr>")
    html = say('<div class="table1"><table><tbody>', link(say("rno=", F.col("k") % 12 + 1, "&amp;"), "出走"), link("", "7R"), "<tr><td>締切</td><td>0:00</td></tr></tbody></table></div>")
    return pages.closing_times(r.select(F.col("race_key").alias("path"), html.alias("html"))).select("path", "rno", "time", "close_ts", "jcd", "hd")


#: Rows of a staging file: a reader's task holds the bytes of whole files.
STAGED_ROWS = 50_000


def staged_files(spark: SparkSession, sf: str) -> str:
    """CSV files with two different headers in one folder."""
    x = X.table(spark, sf, "lineitem").where("l_linenumber <= 6")
    name = F.when(F.col("l_orderkey") % 5 == 0, F.lit("other.html")).otherwise(say("beforeinfo_20_", F.date_format("l_shipdate", "yyyyMMdd"), "_", F.col("l_orderkey") % 12 + 1, ".html"))
    whole = x.select(F.col("l_linenumber").alias("lane"), F.col("l_suppkey").alias("racer_id"), F.lit("a,b").alias("name"), say(F.col("l_quantity").cast("int"), ".0kg").alias("weight"), F.when(F.col("l_partkey") % 3 == 0, F.lit("-")).otherwise(F.col("l_tax").cast("string")).alias("exhibition_time"), F.lit("-0.5").alias("tilt"), name.alias("source_file"), F.lit(".12").alias("ST"), (F.col("l_partkey") % 6 + 1).alias("course"), "l_returnflag")
    path = X.scratch(spark, "staged")
    whole.where("l_returnflag = 'R'").drop("l_returnflag").write.option("header", True).option("maxRecordsPerFile", STAGED_ROWS).csv(f"{path}/one")
    whole.where("l_returnflag <> 'R'").select("source_file", "course", "lane", "racer_id", "weight", "exhibition_time", F.lit("0.3").alias("adjust_weight")).write.option("header", True).option("maxRecordsPerFile", STAGED_ROWS).csv(f"{path}/two")
    return f"{path}/*/*.csv"


@query("""select '20' stadium, l_shipdate::date race_date, cast(l_orderkey % 12 + 1 as integer) race_no, l_linenumber lane, l_suppkey::integer racer_id, cast(l_quantity as integer) || '.0kg' weight_raw, case when l_returnflag <> 'R' then 0.3::double end adjust_weight, case when l_partkey % 3 <> 0 then l_tax end exh_time, case when l_returnflag = 'R' then -0.5::double end tilt_deg, case when l_returnflag = 'R' then '.12' end st_time_raw, cast(l_partkey % 6 + 1 as integer) course
from lineitem where l_linenumber <= 6 and l_orderkey % 5 <> 0""")
def race_staged_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Staging files with different headers: absent columns and bad numbers are null, rows of other file names go."""
    return readers.stage_beforeinfo(readers.read_beforeinfo(spark, staged_files(spark, sf)), "20").drop("source_file")


@query(f"with {Q.RACES} select '20' stadium, race_date, race_no, k::varchar obs_time_label, '晴' weather_txt, '15.0℃' air_temp_raw, wind_speed_m || 'm' wind_speed_raw, null::varchar water_temp_raw, wave_height_cm || 'cm' wave_height_raw, 'is-wind3' wind_dir_raw from races")
def race_weather_csv(spark: SparkSession, sf: str) -> DataFrame:
    r = X.races(spark, sf)
    path = X.scratch(spark, "weather")
    name = say("beforeinfo_20_", F.date_format("race_date", "yyyyMMdd"), "_", F.col("race_no"), ".html")
    r.select(F.col("race_key").alias("obs_datetime_label"), F.lit("晴").alias("weather"), F.lit("15.0℃").alias("air_temp_C"), say(F.col("wind_speed_m"), "m").alias("wind_speed_m"), say(F.col("wave_height_cm"), "cm").alias("wave_height_cm"), F.lit("is-wind3").alias("wind_dir_icon"), name.alias("source_file")).write.option("header", True).option("maxRecordsPerFile", STAGED_ROWS).csv(path)
    return readers.stage_weather(readers.read_weather(spark, path), "20").drop("source_file")


@query("select conv_id, turn, 'say \"' || role || '\",' || chr(10) || 'line two' quoted from conversations")
def race_quoted_csv(spark: SparkSession, sf: str) -> DataFrame:
    """CSV whose quoted fields hold commas, quotes and line breaks."""
    path = X.scratch(spark, "quoted")
    X.table(spark, sf, "conversations").select("conv_id", "turn", say('say "', F.col("role"), '",\nline two').alias("quoted")).write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    schema = ", ".join(f"{c} {t}" for c, t in X.table(spark, sf, "conversations").select("conv_id", "turn").dtypes) + ", quoted string"
    return readers.read_csv_encoded(spark, path, schema)


@query(Q.BETS + " select race_key, race_date, venue, gap from bets where race_date between date '1996-01-01' and date '1997-12-31' and venue = 'NATION_3'")
def race_feature_store(spark: SparkSession, sf: str) -> DataFrame:
    """A feature table partitioned by venue, read by date and venue: other venues' files are pruned."""
    path = X.scratch(spark, "features")
    readers.write_features(X.bets(spark, sf).select("race_key", "race_date", "venue", "gap"), path)
    return readers.read_features(spark, path, "1996-01-01", "1997-12-31", "NATION_3")


@query("with s as (" + ORACLES["race_course_stats"] + ") select racer_id, course, venue, starts, firsts from s union all select racer_id, course, venue, starts, firsts from s where starts > 1")
def race_report_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The racer statistics as CSV with a header, and a second run appended."""
    path, stats = X.scratch(spark, "report"), Q.race_course_stats(spark, sf).select("racer_id", "course", "venue", "starts", "firsts")
    readers.write_report(stats, path)
    readers.write_report(stats.where("starts > 1"), path, mode="append")
    return readers.read_csv_encoded(spark, path, ", ".join(f"{c} {t}" for c, t in stats.dtypes))


@query("select o_orderkey, o_totalprice price, case when o_orderkey % 3 = 0 then o_orderpriority end note, case when o_orderkey % 2 = 0 then 2 else 1 end::integer version from orders")
def race_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents merged field by field over two batches, one of which comes twice."""
    o, path = X.table(spark, sf, "orders"), X.scratch(spark, "documents")
    sink = readers.merge_documents(path, ["o_orderkey"], ["version"])
    first = o.select("o_orderkey", F.col("o_totalprice").alias("price"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("note"), F.lit(1).alias("version"))
    second = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit(None).cast("double").alias("price"), F.lit(None).cast("string").alias("note"), F.lit(2).alias("version"))
    for number, batch in ((0, first), (1, second), (1, second)):
        sink(batch, number)
    return readers.read_documents(spark, path, ["o_orderkey"], ["version"])


def drained(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    """All that a stream gives out of the files that are there, as a table."""
    path = X.scratch(spark, label)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def as_stream(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    path = X.scratch(spark, label)
    df.write.parquet(path)
    return alerts.read_new_files(spark, path, ", ".join(f"{c} {t}" for c, t in df.dtypes))


@query("with s as (" + ORACLES["race_send_once"] + ") select jcd, hd, rno, sent, ts, top_trifecta, top_prob from s")
def race_stream_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """The alerts of race_send_once from a stream of files, with keyed state and event-time timers."""
    key, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key, None)
    ticks, closing = X.ticks(spark, sf)
    spark.conf.set(key, rocks)
    try:
        out = drained(spark, alerts.send_once_stream(as_stream(spark, ticks.withColumn("ts", F.col("ts").cast("timestamp")), "ticks"), closing, signals.thresholds(spark), minutes=120), "alerts")
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return out.withColumn("top_prob", F.round("top_prob", 6))


_CLOSED = "from events, (select max(ts) m from events)"


@query(f"select date_trunc('day', ts)::timestamp \"day\", count(*) n, round(sum(value), 4) total {_CLOSED} where date_trunc('day', ts) + interval 1 day <= m - interval 1 day group by 1")
def race_stream_days(spark: SparkSession, sf: str) -> DataFrame:
    """Day windows that the watermark has closed, from a stream."""
    events = as_stream(spark, X.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "value"), "events")
    return drained(spark, alerts.day_windows(events, "value"), "days").withColumn("total", F.round("total", 4))


@query(f"select date_trunc('week', ts)::timestamp \"week\", count(*) n, round(sum(value), 4) total {_CLOSED} where date_trunc('week', ts) + interval 7 day <= m - interval 1 day group by 1")
def race_stream_weeks(spark: SparkSession, sf: str) -> DataFrame:
    events = as_stream(spark, X.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "value"), "events")
    return drained(spark, alerts.week_windows(events, "value"), "weeks").withColumn("total", F.round("total", 4))


@query(Q.TICKS + " select distinct jcd, hd, rno from t")
def race_stream_deadlines(spark: SparkSession, sf: str) -> DataFrame:
    """Each race's deadline once, however often it is seen within a day."""
    seen = X.ticks(spark, sf)[0].select("jcd", "hd", "rno", F.col("ts").cast("timestamp").alias("seen_ts"))
    return drained(spark, alerts.first_deadlines(as_stream(spark, seen, "seen"), "2 days"), "deadlines").select("jcd", "hd", "rno")
