import datetime as dt

import pytest
from pyspark.sql import functions as F

from lanewise.operators import core
from lanewise.sources import pages, readers, reports

RESULTS = """STARTK
24KBGN
大　村［成績］      1/ 1      年末感謝競走　　  第 4日

   第 4日          2023/ 1/ 1                             ボートレース大　村

               ＊＊＊　競走成績　＊＊＊

   1R  一般         H1800m  晴　  風  北西　  3m  波　  2cm
  着 艇 登番 　選　手　名　　ﾓｰﾀｰ ﾎﾞｰﾄ 展示 進入 ｽﾀｰﾄﾀｲﾐﾝｸ ﾚｰｽﾀｲﾑ 逃げ
-------------------------------------------------------------------------------
  01  1 4321 山　田　　太　郎 12   34  6.78   1    0.12     1.49.8
  02  3 4322 佐　藤　　次　郎 13   35  6.80   3    0.15     1.51.0
  F   2 4323 鈴　木　　三　郎 14   36  6.81   2   F0.01      .   .
  S1  4 4324 高　橋　　四　郎 15   37  6.82   4   S0.12      .   .
  garbage row

        単勝     1          150
        複勝     1          100  3          210
        ２連単   1-3       1,230  人気     2
                 1－3        340  人気     1
        ３連単   1-3-5     12,340  人気    22

   2R  予選   進入固定  H1800m  曇り  風  南　  1m  波　  1cm
  着 艇 登番 まくり差し
-------------------------------------------------------------------------------
  01  6 4325 田　中　　五　郎 16   38  6.83   6    0.20     1.50.1

24KEND
"""
PROGRAM = """STARTB
24BBGN
ボートレース大　村   １月　１日
               ＊＊＊　番組表　＊＊＊
              年末感謝競走
   第　４日          ２０２３年　１月　１日
　１Ｒ  一般     進入固定 Ｈ１８００ｍ  電話投票締切予定１０：３０
-------------------------------------------------------------------------------
艇 選手 選手  年 支 体級    全国      当地     モーター   ボート
-------------------------------------------------------------------------------
1 4321山田太郎35福岡52A1 6.50 45.00 6.10 40.00 12 33.30 45 31.20 1 2 3 4
2 4322佐藤次郎40長崎50B1 5.50 35.00 5.10 30.00 13 32.30 46 30.20
3 4323鈴木三郎40長崎50B1 5.50 35.00
1 4324a山40長崎50B1 5.50
4 4325b山40長崎50B1 5.50
5 4326c山40長崎50B1 5.50
6 4327d山40長崎50B1 5.50
24BEND
"""


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("k")
    (d / "deep").mkdir()
    (d / "deep" / "K230101.TXT").write_text(RESULTS.replace("\n", "\r\n"), encoding="utf-8")
    return readers.read_reports(spark, str(d))


@pytest.fixture(scope="module")
def program(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("b")
    (d / "B230101.TXT").write_bytes(PROGRAM.encode("cp932"))
    return readers.read_reports(spark, str(d), "cp932")


def test_result_races(results):
    rows = reports.result_races(results).orderBy("race_no").collect()
    assert [(r.race_no, r.category, r.weather, r.wind_direction, r.wind_speed_m, r.wave_height_cm, r.winning_method) for r in rows] == [(1, "一般", "晴", "北西", 3, 2, "逃げ"), (2, "予選", "曇り", "南", 1, 1, "まくり差し")]
    assert rows[0].event_date == dt.date(2023, 1, 1) and rows[0].venue == "大 村" and rows[0].event_day_number == 4 and rows[0].event_name == "年末感謝競走"
    assert rows[1].notes == "進入固定" or rows[1].category.startswith("予選")


def test_result_rows(results):
    good, bad = reports.result_rows(results)
    rows = {(r.race_no, r.lane): r for r in good.collect()}
    assert set(rows) == {(1, 1), (1, 3), (1, 2), (1, 4), (2, 6)}
    assert (rows[1, 1].finish_order, rows[1, 1].status, rows[1, 1].start_timing, rows[1, 1].race_time) == (1, None, 0.12, "1.49.8")
    assert (rows[1, 2].finish_order, rows[1, 2].status, rows[1, 2].start_timing, rows[1, 2].race_time) == (None, "F", 0.01, None)
    assert (rows[1, 4].status, rows[1, 4].start_timing) == ("S1", None)
    assert rows[1, 1].player_name == "山 田 太 郎" and rows[1, 1].motor_no == 12 and rows[1, 1].tenji_time == 6.78
    assert [r.line.strip() for r in bad.collect()] == ["garbage row"]


def test_result_payouts(results):
    rows = [(r.bet_type, r.combination, r.payout_yen, r.popularity_rank) for r in reports.result_payouts(results).orderBy("line_no", "pair_no").collect()]
    assert rows == [("単勝", "1", 150, None), ("複勝", "1", 100, None), ("複勝", "3", 210, None), ("２連単", "1-3", 1230, 2), ("２連単", "1-3", 340, 1), ("３連単", "1-3-5", 12340, 22)]


def test_fallback_blocks(spark):
    one = spark.createDataFrame([("f", "11KBGN\n x\n11KEND\n12KBGN\n y\n12KEND")], "source_file string, text string")
    assert reports.result_blocks(one).count() == 2


def test_program(program):
    race = reports.program_races(program).collect()
    assert [(r.race_no, r.category, r.entry_fixed, r.distance_m, r.phone_close_time, r.phone_close_at) for r in race] == [(1, "一般", 1, 1800, "10:30", dt.datetime(2023, 1, 1, 10, 30))]
    assert race[0].venue == "大村" and reports.program_events(program).first().event_name == "年末感謝競走"
    rows = reports.program_entries(program).orderBy("line_no").collect()
    assert len(rows) == 6
    a = rows[0]
    assert (a.lane, a.reg_no, a.player_name, a.age, a.branch, a.weight_kg, a["class"]) == (1, 4321, "山田太郎", 35, "福岡", 52, "A1")
    assert (a.nat_win_rate, a.nat_2rate, a.motor_no, a.motor_2rate, a.boat_no, a.boat_2rate) == (6.5, 45.0, 12, 33.3, 45, 31.2)
    assert (a.series_note, a.early_note) == ("1 2 3", "4") and rows[1].series_note is None and rows[2].motor_no is None


BEFORE = """<html><h2 class="heading2_titleName">優勝戦</h2><div class="heading2_area"><img alt="若松"></div>
<ul class="tab2_tabs"><li>x</li><li class="is-active2">1月1日４日目</li></ul>
<table class="is-w748"><tbody class="is-fs12"><tr><td class="is-boatColor1">1</td><td><img src="a.jpg"></td><td><a href="/p/profile?toban=4321">山田</a></td><td>52.0kg</td><td>6.78</td><td>-0.5</td></tr><tr><td>0.5</td></tr></tbody>
<tbody class="is-fs12"><tr><td class="is-boatColor2">2</td><td><img src="b.jpg"></td><td><a href="/p/profile?toban=4322">佐藤</a></td><td></td><td>6.80</td><td>0.0</td></tr></tbody>
<tbody class="is-fs12"><tr><td>legend</td></tr></tbody></table>
<div class="table1_boatImage1"><span class="table1_boatImage1Number">2</span><span class="table1_boatImage1Time">.12</span></div>
<div class="table1_boatImage1"><span class="table1_boatImage1Number">1</span><span class="table1_boatImage1Time">F.03</span></div>
<div class="weather1"><p class="weather1_title">10:00現在</p><div class="weather1_bodyUnit is-weather"><span class="weather1_bodyUnitLabelTitle">晴</span></div><div class="weather1_bodyUnit is-direction"><span class="weather1_bodyUnitLabelData">15.0℃</span></div>
<div class="weather1_bodyUnit is-wind"><span class="weather1_bodyUnitLabelData">3m</span></div><div class="weather1_bodyUnit is-windDirection"><p class="weather1_bodyUnitImage is-wind4"></p></div><div class="weather1_bodyUnit is-wave"><span class="weather1_bodyUnitLabelData">2cm</span></div></div></html>"""
RESULT = """<div class="heading2_area"><img alt="大村"></div><ul class="tab3_tabs"><li><a href="?rno=7&jcd=24">7R</a></li></ul>
<table class="is-w495"><thead><tr><th>着</th></tr></thead><tbody><tr><td>1</td><td>1</td><td><span>4321</span><span>山田</span></td><td>1'49"8</td></tr></tbody></table>
<div class="table1_boatImage1"><span class="table1_boatImage1Number">1</span><span class="table1_boatImage1TimeInner">.12 逃げ</span></div>
<table class="is-w495"><thead><tr><th>勝式</th></tr></thead><tbody><tr><td>3連単</td><td>1-2-3</td><td>¥1,230</td><td>2</td></tr><tr><td></td><td>x</td><td>y</td><td>z</td></tr></tbody></table>"""
INDEX = """<div class="table1"><table><tbody><tr><td><a href="/owpc/racelist?rno=2&jcd=24&hd=20250101">2R</a></td><td>18:36</td></tr></tbody><tbody><tr><td><a href="racelist?jcd=24&hd=bad">1R</a></td><td>x</td></tr></tbody></table></div>"""


def test_pages(spark):
    many = spark.createDataFrame([("a", BEFORE), ("b", '<p class="heading1_mainLabel">データがありません</p>'), ("c", BEFORE.replace("４日目", "中止")), ("d", None), ("e", BEFORE.replace("table1_boatImage1", "x"))], "path string, html string")
    racers, weather, meta = pages.before_rows(many)
    rows = racers.orderBy("lane").collect()
    assert [(r.lane, r.racer_id, r.weight, r.adjust_weight, r.exhibition_time, r.tilt, r.st_time_raw, r.course) for r in rows] == [(1, "4321", "52.0kg", "0.5", "6.78", "-0.5", "F.03", 2), (2, "4322", None, None, "6.80", "0.0", ".12", 1)]
    assert rows[0].place == "若 松"
    w = weather.collect()[0]
    assert (w.weather_txt, w.air_temp_raw, w.wind_speed_raw, w.wind_dir_raw, w.wave_height_raw, w.water_temp_raw) == ("晴", "15.0℃", "3m", "is-wind4", "2cm", None)
    assert meta.count() == 2


def test_result_and_index_pages(spark):
    f, p, _ = pages.result_rows(spark.createDataFrame([("a", RESULT)], "path string, html string"))
    r = f.collect()[0]
    assert (r.race_no, r.position, r.lane, r.racer_no, r.racer_name, r.course, r.st_time, r.tactic) == ("7", "1", 1, "4321", "山田", 1, ".12", "逃げ")
    assert [(x.bet_type, x.combination, x.payout_yen, x.popularity) for x in p.collect()] == [("3連単", "1-2-3", 1230, 2)]
    rows = pages.closing_times(spark.createDataFrame([("a", INDEX)], "path string, html string")).orderBy("rno").collect()
    assert [(r.rno, r.time, r.hd, r.close_ts) for r in rows] == [(1, "x", "bad", None), (2, "18:36", "20250101", dt.datetime(2025, 1, 1, 9, 36))]


def test_staging(spark, tmp_path):
    (tmp_path / "a_beforeinfo.csv").write_text("lane,racer_id,name,weight,adjust_weight,exhibition_time,tilt,source_file,ST,course\n1,4321,a,52.0kg,0.5,6.78,-0.5,x/beforeinfo_20_20250101_8.html,.12,2\n1,4321,a,52.0kg,0.5,bad,-0.5,x/beforeinfo_20_20250101_8.html,F.03,1\n2,1,b,,,,,x/other.html,L,\n")
    rows = readers.stage_beforeinfo(readers.read_beforeinfo(spark, str(tmp_path / "*_beforeinfo.csv")), "若 松")
    got = core.pred_boat_info(rows, ["source_file"]).collect()
    assert [(r.race_key, r.lane, r.weight, float(r.bf_st_time), r.fs_flag, r.exh_time, r.bf_course) for r in got] == [("2025-01-01-08-20", 1, 52.0, -0.03, True, None, 1)]


def test_documents_sink(spark, tmp_path):
    write = readers.merge_documents(str(tmp_path / "d"), ["id"], ["seq"])
    write(spark.createDataFrame([("a", 1, 1), ("a", 2, 2)], "id string, seq int, v int"), 0)
    write(spark.createDataFrame([("a", 1, 9), ("b", 1, 3)], "id string, seq int, v int"), 1)
    got = readers.read_documents(spark, str(tmp_path / "d"), ["id"], ["seq"]).select("id", "v").orderBy("id").collect()
    assert [tuple(r) for r in got] == [("a", 9), ("b", 3)]


def test_report_writer(spark, tmp_path):
    df = spark.range(2).select("id", F.array(F.lit(1)).alias("xs"))
    readers.write_report(df, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).columns == ["id", "xs"]


def test_staging_files_of_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("lane,racer_id,ST,course,source_file\n1,4321,.12,1,x\n2,bad,F.03,2,\"y,\nz\"\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("course,lane,tilt\r\n3,6,-0.5\r\n", encoding="utf-8")
    (tmp_path / "empty.csv").write_text("", encoding="utf-8")
    rows = {r.lane: r for r in readers.read_beforeinfo(spark, str(tmp_path / "*.csv")).collect() if r.lane}
    assert (rows[1].racer_id, rows[1].st_time_raw, rows[1].tilt) == (4321, ".12", None) and rows[2].racer_id is None
    assert (rows[6].course, rows[6].tilt, rows[6].st_time_raw) == (3, -0.5, None)
    assert readers.read_beforeinfo(spark, str(tmp_path / "empty.csv")).count() == 0


def test_encoded_csv_with_line_breaks(spark, tmp_path):
    text = '名前,値\n"山\n田",1\n"a ""b"", c",2\n'
    for encoding in ("utf-8", "cp932"):
        (tmp_path / encoding).mkdir()
        (tmp_path / encoding / "x.csv").write_bytes(text.encode(encoding))
        rows = readers.read_csv_encoded(spark, str(tmp_path / encoding), "name string, n int", encoding).collect()
        assert sorted((r.n, r.name) for r in rows) == [(1, "山\n田"), (2, 'a "b", c')]


def test_deep_and_broken_pages(spark):
    deep = "<div>" * 5000 + "<p>" * 3000 + "x"
    html = f'<div class="heading1_mainLabel">直前情報</div><h2 class="heading2_titleName">杯</h2>{deep}'
    rows = spark.createDataFrame([("a", html), ("b", "<td" * 2000), ("c", None)], "path string, html string")
    assert [r.path for r in pages.extract(rows, pages.before_page, pages.BEFORE).collect()] == ["a"]
    cells = pages.Tree("<table><tr><td>1<td>2<tr><td>3</table><p>one<p>two").root
    assert [[c.text() for c in r.all("td")] for r in cells.all("tr")] == [["1", "2"], ["3"]] and [p.text() for p in cells.all("p")] == ["one", "two"]


def test_documents_are_merged_by_field(spark, tmp_path):
    sink = readers.merge_documents(str(tmp_path / "d"), ["id"], ["at"])
    schema = "id int, at int, a string, b string"
    sink(spark.createDataFrame([(1, 1, "x", None), (1, 2, None, "y"), (2, 1, "z", "z")], schema), 0)
    for _ in range(2):
        sink(spark.createDataFrame([(1, 3, None, "new")], schema), 1)
    want = {(1, "x", "new"), (2, "z", "z")}
    got = readers.read_documents(spark, str(tmp_path / "d"), ["id"], ["at"])
    assert {(r.id, r.a, r.b) for r in got.collect()} == want
    readers.compact_documents(spark, str(tmp_path / "d"), str(tmp_path / "e"), ["id"], ["at"])
    assert {(r.id, r.a, r.b) for r in readers.read_documents(spark, str(tmp_path / "e"), ["id"], ["at"]).collect()} == want


def test_pages_of_one_form_share_a_shape_and_odd_ones_say_the_same(spark):
    """A page of plain tags never meets the standard parser; the same page with a mark that only that reads gives the same."""
    before = pages.before_page(BEFORE)
    assert pages.Tree(BEFORE).plain and pages.Tree(RESULT).plain and pages.Tree(BEFORE).shape is pages.Tree(BEFORE.replace("4321", "999999")).shape
    for odd in ("<td a='1'></td>", "<script>if (a<b) {}</script>", "<!-- a > b -->", "x > y"):
        assert not pages.Tree(BEFORE + odd).plain and pages.before_page(BEFORE + odd) == before
    assert pages.before_page(BEFORE.replace("山田", "山 &amp; 田"))["racers"][0]["name"] == "山 & 田"
    assert pages.before_page(BEFORE, {"place"})["racers"] == [] and pages.before_page(BEFORE, {"weather"})["weather"] == before["weather"]
    assert len(before["racers"]) == 2 and [len(x) for x in (pages.result_page(RESULT)["finishers"], pages.result_page(RESULT, {"payouts"})["finishers"])] == [1, 0]
    racers, weather, meta = pages.before_rows(spark.createDataFrame([("a", BEFORE)], "path string, html string"))
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (racers, weather, meta)]
    assert ["weather" in plans[0], "racers" in plans[1], "racers" in plans[2]] == [False] * 3 and all("MapInArrow" in p for p in plans)


def test_reports_are_parsed_without_a_shuffle(results, program):
    """A block's lines stay in its row, so reports of any number cost no shuffle and no sort."""
    for df in (reports.result_races(results), *reports.result_rows(results), reports.result_payouts(results), reports.program_races(program), reports.program_entries(program)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Exchange", "Window", "Sort"))


def test_report_files_are_packed(spark):
    from lanewise.plans import queries  # noqa: F401 - it registers what ingest needs
    from lanewise.plans import ingest

    files = ingest.written_reports(spark, "", spark.createDataFrame([("24KBGN\nx\n24KEND",), ("y",)], "value string").coalesce(1)).collect()
    assert [(f.source_file.endswith(".txt.gz"), f.text) for f in files] == [(True, "24KBGN\nx\n24KEND\ny\n")]


def test_staging_rows_are_read_batch_by_batch():
    """Beside a file's bytes only a batch of its rows is held, whatever the file's size."""
    import tracemalloc

    import pyarrow as pa

    n = 200_000
    content = pa.py_buffer(b"\xef\xbb\xbfST,lane,name\n" + b".12,3,\"a\nb\"\n" * n + b"\xff,4,\n")
    tracemalloc.start()
    total, last = 0, None
    for batch in readers.staged_batches(content, ["lane", "name", "ST", "tilt"], 5_000):
        total, last = total + batch.num_rows, batch
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == n + 1 and last.to_pylist() == [{"lane": "4", "name": None, "ST": "�", "tilt": None}] and peak < 10e6


def test_staging_files_are_bounded(spark, small, monkeypatch):
    from lanewise.plans import queries
    from lanewise.plans import ingest

    monkeypatch.setattr(ingest, "STAGED_ROWS", 500)
    files = spark.read.format("binaryFile").load(ingest.staged_files(spark, small)).select(F.size(F.split(F.col("content").cast("string"), "\n")).alias("n")).collect()
    assert len(files) > 5 and max(f.n for f in files) <= 502 and queries
