"""Stored layers: no shuffle over bucketed tables, refreshes in order, merges that keep untouched files."""

import pytest
from pyspark.sql import functions as F

from lanewise.operators import core, layers
from lanewise.plans import standins as X
from lanewise.plans import stored


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dedupe_join_and_pivot_without_a_shuffle(spark, small):
    tables = stored.conformed(spark, small, 4)
    assert tables.refresh("loads", "weather", "races") == ["loads", "weather", "races"]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for threshold in ("-1", before):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            pivot = stored.pivot_of_loads(tables)
            plan = plan_of(pivot)
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert "Exchange hashpartitioning" not in plan and "Window" in plan
        assert threshold != "-1" or ("SortMergeJoin" in plan and "Exchange" not in plan)
    raw = spark.read.parquet(*[f.removeprefix("file:") for f in tables["loads"].inputFiles()])
    assert "Exchange hashpartitioning" in plan_of(core.latest(raw, ["race_key", "lane"], X.SEQUENCE))  # the same files without their buckets
    tables.drop()


def test_refresh_rebuilds_what_depends(spark):
    made = []

    def build(name, *names):
        def run(*inputs):
            made.append(name)
            return spark.range(10).select(F.col("id").cast("string").alias("race_key")) if not inputs else inputs[0]

        return run

    tables = layers.Layers(spark, buckets=2)
    tables.define("a", build("a")).define("b", build("b")).define("ab", build("ab"), ["a", "b"]).define("abc", build("abc"), ["ab"]).define("b2", build("b2"), ["b"])
    assert tables.refresh() == ["a", "b", "ab", "abc", "b2"] == made
    kept = tables.tables["b2"]
    assert tables.refresh("a") == ["a", "ab", "abc"] and tables.tables["b2"] == kept and tables["abc"].count() == 10
    tables.define("late", build("late"), ["abc"]).define("later", build("later"), ["late"])
    assert tables.refresh("b2") == ["b2"] and tables.refresh("later") == ["late", "later"]
    with pytest.raises(ValueError):
        tables.define("x", build("x"), ["latest"])
    with pytest.raises(ValueError):
        tables.refresh("nothing")
    # A layer that fails leaves its old version.
    good, tables.made["b"] = tables.tables["b"], ((), lambda: spark.range(3).select(F.raise_error(F.lit("broken")).alias("race_key")), ())
    with pytest.raises(Exception, match="broken"):
        tables.refresh("b")
    assert tables.tables["b"] == good and tables["b"].count() == 10
    tables.drop()
    assert not tables.tables


def rows(spark, *values):
    return spark.createDataFrame(values, "k string, part string, v int, seq int")


def test_merges_keep_untouched_files(spark, tmp_path):
    path = str(tmp_path / "t")
    rows(spark, *((f"{p}-{i}", p, i, 0) for p in ("01", "02", "03") for i in range(50))).write.partitionBy("part").parquet(path)
    files = lambda: {r.part: r.files for r in layers.files_of(spark, path, ["part"]).select(F.lpad(F.col("part").cast("string"), 2, "0").alias("part"), "files").collect()}
    before = files()
    batch = rows(spark, ("02-7", "02", 700, 1), ("02-7", "02", 701, 2), ("02-new", "02", 1, 1), ("04-a", "04", 9, 1), ("04-a", "04", 8, 0))
    for _ in range(2):
        parts = layers.merge_partitions(spark, path, batch, ["k"], ["seq"], ["part"])
        assert {r.part for r in parts.collect()} == {"02", "04"}
        got = {r.k: r.v for r in spark.read.parquet(path).collect()}
        assert len(got) == 152 and got["02-7"] == 701 and got["02-new"] == 1 and got["04-a"] == 9 and got["01-49"] == 49
        assert {p: f for p, f in files().items() if p in ("01", "03")} == {p: before[p] for p in ("01", "03")} and files()["02"] != before["02"]
    kept = files()
    assert layers.insert_partitions(spark, path, rows(spark, ("02-7", "02", -1, 9), ("03-x", "03", 5, 2), ("03-x", "03", 4, 1), ("05", "05", 0, 0)), ["k"], ["seq"], ["part"]) == 2
    got = {r.k: r.v for r in spark.read.parquet(path).collect()}
    assert got["02-7"] == 701 and got["03-x"] == 4 and got["05"] == 0
    assert all(set(kept[p]) <= set(f) for p, f in files().items() if p in kept) and files()["01"] == before["01"]


def test_only_touched_partitions_are_read(spark, tmp_path):
    path = str(tmp_path / "t")
    rows(spark, *((f"{p}-{i}", f"{p:02d}", i, 0) for p in range(12) for i in range(20))).write.partitionBy("part").parquet(path)
    batch = rows(spark, ("3-1", "03", 1, 1), ("7-1", "07", 1, 1))
    _, old = layers.touched(layers.partitioned(spark, path, batch, ["part"]), batch, ["part"])
    assert old.count() == 40 and "dynamicpruning" in plan_of(old) and "(part#" in plan_of(old).split("PartitionFilters: [")[1]
    with pytest.raises(ValueError):
        layers.merge_partitions(spark, path, rows(spark, ("x", None, 1, 1)), ["k"], ["seq"], ["part"])
    assert dict(layers.partitioned(spark, path, batch, ["part"]).dtypes)["part"] == "string"


def test_a_merge_that_failed_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "t")
    rows(spark, ("a", "01", 1, 0), ("b", "02", 2, 0)).write.partitionBy("part").parquet(path)
    broken = rows(spark, ("a", "01", 5, 1)).withColumn("v", F.when(F.col("k") == "a", F.raise_error(F.lit("lost")).cast("int")))
    with pytest.raises(Exception, match="lost"):
        layers.merge_partitions(spark, path, broken, ["k"], ["seq"], ["part"])
    assert {(r.k, r.v) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 2)}
    layers.merge_partitions(spark, path, rows(spark, ("a", "01", 5, 1)), ["k"], ["seq"], ["part"])
    layers.merge_partitions(spark, path, rows(spark).limit(0), ["k"], ["seq"], ["part"])
    assert {(r.k, r.v) for r in spark.read.parquet(path).collect()} == {("a", 5), ("b", 2)}
