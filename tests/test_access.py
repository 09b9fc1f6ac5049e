"""Database reads, encodings, headers by file, SQL functions, matching races, and streams that stop and go on."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from lanewise.functions import conform as C
from lanewise.functions import sql
from lanewise.operators import roi
from lanewise.sources import jdbc, readers
from lanewise.streaming import alerts


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_database_answers_the_predicates(spark):
    url = f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"
    rows = [(f"r{i}", dt.date(2024, 1, 1) + dt.timedelta(days=i % 100), "AB"[i % 2], i * 1.5) for i in range(500)]
    df = spark.createDataFrame(rows, "race_key string, race_date date, venue string, gap double")
    jdbc.write_table(df, url, "features")
    part = jdbc.read_table(spark, url, "features", "2024-01-10", "2024-02-10", "B", 4)
    assert part.rdd.getNumPartitions() == 4
    plan = plan_of(part)
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(race_date" in plan and "LessThanOrEqual(race_date" in plan and "EqualTo(venue,B)" in plan
    assert "Filter" not in plan.replace("PushedFilters", "")  # the database leaves nothing to filter
    assert {tuple(r) for r in part.collect()} == {r for r in rows if dt.date(2024, 1, 10) <= r[1] <= dt.date(2024, 2, 10) and r[2] == "B"}
    # Bounds of the table's own: nothing outside them is lost.
    every = jdbc.read_table(spark, url, "features", partitions=3)
    assert every.rdd.getNumPartitions() == 3 and every.count() == 500
    assert jdbc.read_table(spark, url, "features", "2030-01-01", None, None, 4).count() == 0
    jdbc.write_table(df.limit(1), url, "features", "append")
    assert jdbc.read_table(spark, url, "features").count() == 501


def test_first_encoding_that_holds(spark, tmp_path):
    texts = {"a.txt": ("浜名湖 ①", "cp932", "cp932"), "b.txt": ("浜名湖", "shift_jis", "shift_jis"), "c.txt": ("浜名湖 €\r\n", "utf-8", "utf-8")}
    (tmp_path / "empty.txt").write_bytes(b"")  # Spark skips files without bytes
    for name, (text, encoding, _) in texts.items():
        (tmp_path / name).write_bytes(text.encode(encoding))
    (tmp_path / "e.txt").write_bytes(b"ok \x81\xff\xfe")
    got = {r.source_file.rsplit("/", 1)[1]: (r.text, r.encoding) for r in readers.read_texts(spark, str(tmp_path), ("utf-8", "shift_jis", "cp932")).collect()}
    assert {n: got[n] for n in texts} == {n: (t.replace("\r", ""), e) for n, (t, _, e) in texts.items()}
    assert got["e.txt"][1] is None and got["e.txt"][0].startswith("ok ") and "�" in got["e.txt"][0]
    nulls = spark.createDataFrame([(None,)], "content binary").select(readers.decoded(F.col("content"), ["utf-8"]).alias("d")).first()
    assert nulls.d.encoding is None and nulls.d.text is None


def test_every_file_has_its_own_header(spark, tmp_path):
    files = {
        "1.csv": '﻿lane,name,ST\n1,"a, ""b""",.12\n2,"line\ntwo",\n\n', "2.csv": "ST,x,lane\n.05,9,3\n.06\n", "3.csv": "", "4.csv": "lane\n", "5.csv": "other\r\n7\r\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8", newline="")
    df = readers.read_staging(spark, str(tmp_path / "*.csv"), ["lane", "name", "ST"], {"lane": "int"}, {"ST": "st_time_raw"})
    assert df.columns == ["lane", "name", "st_time_raw"]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted([(1, 'a, "b"', ".12"), (2, "line\ntwo", None), (3, None, ".05"), (None, None, ".06"), (None, None, None)], key=repr)
    assert plan_of(df).count("FileScan") == 1  # read once, headers and all


def test_sql_functions_are_the_columns(spark):
    assert sql.register(spark) == ["official_venue_no", "race_key"] == sql.register(spark)
    rows = [(n, dt.date(2024, 3, i % 28 + 1), i + 1) for i, n in enumerate([*C.VENUES, "浜　名 湖", "7", "07", " 12 ", "123", "elsewhere", "", None])] + [("桐生", None, 1), ("桐生", dt.date(2024, 1, 2), None)]
    df = spark.createDataFrame(rows, "stadium string, day date, rno int")
    df = df.select("*", C.venue_number(F.col("stadium")).alias("a"), C.race_key(F.col("day"), F.col("rno"), F.col("stadium")).alias("b"))
    got = spark.sql("select a, b, official_venue_no(stadium) c, race_key(day, rno, stadium) d from {df}", df=df).collect()
    assert len(got) == len(rows) and all(r.a == r.c and r.b == r.d for r in got)


def test_matching_of_a_key_with_half_of_all_rows(spark):
    long = spark.range(20_000).select(F.col("id").cast("string").alias("race_key"), F.lit("tailwind").alias("condition"), F.when(F.col("id") % 2 == 0, "0").when(F.col("id") < 19_000, "1").alias("label"))
    chosen = spark.createDataFrame([(1, "tailwind", "0"), (2, "tailwind", "0"), (3, "tailwind", "1"), (4, "venue", "x")], "top_n int, condition string, label string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = roi.matching(long, chosen, salts=16).repartition(1).cache()
        assert found.columns == ["condition", "label", "race_key", "top_n"]
        # Every salt has a share of the hot bin, so that no task of the join gets it whole.
        joined = roi.matching(long.repartition(8), chosen, salts=16)
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) > 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert {(r.top_n, r["count"]) for r in found.groupBy("top_n").count().collect()} == {(1, 10_000), (2, 10_000), (3, 9_500)}
    salts = long.where("label = '0'").groupBy(F.pmod(F.xxhash64("race_key"), F.lit(16))).count().collect()
    assert len(salts) == 16 and max(r["count"] for r in salts) < 800


def test_months_close_one_by_one(spark, tmp_path):
    rows = [(dt.datetime(2024, m, d, 5), 1.0 * m) for m in (1, 2, 4) for d in (1, 15, 28)]
    spark.createDataFrame(rows, "ts timestamp, value double").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = alerts.month_windows(alerts.read_new_files(spark, str(tmp_path / "e"), "ts timestamp, value double"), "value")
    stream.writeStream.format("memory").queryName("months").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert {(r.month.month, r.n, r.total) for r in spark.table("months").collect()} == {(1, 3, 3.0), (2, 3, 6.0)}
