"""Exact quantiles by sketch brackets: outliers, ties, windows over panes, and sketches that err."""

import random

import numpy as np
from pyspark.sql import functions as F

from lanewise.operators import quantiles, roi


def linear(values, places):
    values = sorted(values)
    return [values[int(np.floor(p))] + (values[int(np.ceil(p))] - values[int(np.floor(p))]) * (p - np.floor(p)) for p in places]


def watched(monkeypatch):
    """The tables that are staged, by label."""
    seen, keep = {}, quantiles.stage

    def stage(df, label):
        seen.setdefault(label, []).append(out := keep(df, label))
        return out

    monkeypatch.setattr(quantiles, "stage", stage)
    return seen


def test_one_outlier_widens_no_bracket(spark, monkeypatch):
    """20,000 values and one of 1e15: no task orders over 5% of the values, and the input is read twice."""
    seen = watched(monkeypatch)
    df = spark.range(20_000).select((F.rand(7) * 1000).alias("x")).unionByName(spark.createDataFrame([(1e15,), (float("nan"),), (None,)], "x double")).cache()
    got = quantiles.values_at(df, "x", quantiles.edge_places(10)).first()["values"]
    values = [r.x for r in df.collect() if r.x is not None and r.x == r.x]
    assert np.allclose(got, linear(values, [(len(values) - 1) * i / 10 for i in range(11)]), rtol=0, atol=1e-12)
    cells = seen["quantile-counts"][-1].where("x is not null").groupBy("low", "point").agg(F.sum("_k").alias("n"), F.count("*").alias("rows")).collect()
    assert max(r.rows for r in cells) <= 0.05 * len(values) and len(seen["quantile-counts"]) == 1
    # Most values are counted in bulk: they never leave their task one by one.
    assert sum(r.n for r in cells) < 0.3 * len(values)


def test_ties_groups_and_two_columns(spark):
    r = random.Random(2)
    rows = [(g, r.choice((1.0, 2.0, 2.0, 2.0, 5.5)) if g < 3 else r.gauss(0, 1), r.randint(0, 4) * 1.0 if g else None) for g in range(5) for _ in range(700)] + [(9, None, 3.0), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g int, x double, y double").repartition(3)
    places = lambda n: F.array((n - 1) / 2, (n - 1) * 0.25, F.lit(0))
    got = {k.g: (k.x, k.y) for k in quantiles.values_of(df, {"x": F.col("x"), "y": F.col("y")}, places, ["g"]).collect() if k.g is not None}
    for g in (0, 1, 2, 3, 4, 9):
        for i in (0, 1):
            own = [k[1 + i] for k in rows if k[0] == g and k[1 + i] is not None]
            want = linear(own, [(len(own) - 1) / 2, (len(own) - 1) * 0.25, 0]) if own else None
            assert got[g][i] == want or np.allclose(got[g][i], want)
    assert quantiles.values_at(df.where("false"), "x", places, ["g"]).count() == 0


def test_a_missed_bracket_is_found_out(spark, monkeypatch):
    """Brackets of a sketch that errs by a tenth of the places: the read is repeated, and the values stay exact."""
    seen, true_grid = watched(monkeypatch), quantiles.grid_of
    monkeypatch.setattr(quantiles, "grid_of", lambda s: F.transform(true_grid(s), lambda x, i: F.get(true_grid(s), F.least(i + 51, F.lit(quantiles.GRID)))))
    df = spark.range(5001).select(F.col("id").cast("double").alias("x"))
    assert quantiles.values_at(df, "x", lambda n: F.array((n - 1) / 2)).first()["values"] == [2500.0]
    assert len(seen["quantile-counts"]) > 1


def test_windows_are_merged_from_panes(spark):
    r = random.Random(5)
    rows = [(r.randint(0, 9), r.choice((r.gauss(0, 3), 1.0, 1e12))) for _ in range(4000)]
    df = spark.createDataFrame(rows, "pane int, x double").repartition(4)
    windows = spark.createDataFrame([(p, w) for w in range(6) for p in range(w, w + 4) if w != 3], "pane int, window int")
    got = {k.window: k.x for k in quantiles.values_of(df, {"x": F.col("x")}, quantiles.edge_places(4), ["window"], ["pane"], windows).collect()}
    assert set(got) == {0, 1, 2, 4, 5}
    for w, found in got.items():
        own = [x for p, x in rows if w <= p < w + 4]
        assert np.allclose(found, linear(own, [(len(own) - 1) * i / 4 for i in range(5)]))


def bets(spark, n=3000, seed=1):
    r = random.Random(seed)
    rows = [(str(i), r.randint(0, 400), r.choice("ABC"), r.choice((None, *range(1, 12))), r.choice((None, 4.0, 11.5, 30.25)), r.random(), r.choice((0.1, r.random())), float(r.randint(0, 10)), r.randint(0, 25) / 10, r.randint(0, 15) * 22.5) for i in range(n)]
    df = spark.createDataFrame(rows, "race_key string, d int, venue string, true_order_rank int, trifecta_odds double, pl_prob double, gap double, wind_speed double, wave_height double, wind_dir_deg double")
    return df.withColumn("race_date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d"))).drop("d")


def test_cells_keep_bins(spark):
    """A value's cell among several windows' edges has the value's bin in each of them."""
    own, more = [0.1, 0.4, 0.9], [0.0, 0.1, 0.25, 0.4, 0.6, 0.9, 1.5]
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.05, 0.1, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.9, 1.0, 1.5, 2.0, None)], "x double")
    e, m = F.array(*map(F.lit, own)), F.array(*map(F.lit, more))
    rows = df.select("x", quantiles.quantile_bin(F.col("x"), e).alias("want"), roi.bin_of_cell(roi.edge_cell(F.col("x"), m), e).alias("got")).collect()
    assert all(r.got == r.want for r in rows) and {r.want.id for r in rows if r.want} == {0, 1}


def test_panes_give_what_windows_of_races_give(spark):
    """walk_forward against the same rule over copied races, for steps that divide the tune days and ones that don't."""
    df = bets(spark)
    for tune, test in ((120, 30), (45, 30), (60, 60)):
        got = {(r.window, r.top_n): (r.condition, r.label, r.tune_races, r.n_races, r.n_hits, round(r.total_return, 6)) for r in roi.walk_forward(df, tune, test, 20, 5, least_hits=1).collect()}
        races = [r.asDict() for r in df.collect()]
        first, last = min(r["race_date"] for r in races), max(r["race_date"] for r in races)
        assert got and {w for w, _ in got} <= set(range(((last - first).days - tune) // test + 1))
        for (w, n), (condition, label, tuned, n_races, n_hits, total) in got.items():
            day = lambda r: (r["race_date"] - first).days
            own = [r for r in races if w * test <= day(r) < w * test + tune and r["true_order_rank"] is not None and r["trifecta_odds"] is not None]
            later = [r for r in races if w * test + tune <= day(r) < w * test + tune + test]
            name = condition.removesuffix("_bin")
            if name in ("pl_prob", "gap"):
                edges = sorted(set(linear([r[name] for r in own], [(len(own) - 1) * i / 4 for i in range(5)])))
                of = lambda r: str(max(1, sum(e < r[name] for e in edges)) - 1) if len(edges) > 1 and edges[0] <= r[name] <= edges[-1] else None
            elif name == "venue":
                of = lambda r: r["venue"]
            elif name == "wind":
                of = lambda r: str(sum(r["wind_speed"] >= e for e in (2, 4, 6, 8)))
            elif name == "wave":
                of = lambda r: str(sum(r["wave_height"] >= e for e in (0.5, 1, 2)))
            else:
                of = lambda r: str(int(np.sin(np.radians(r["wind_dir_deg"])) < 0))
            met = [r for r in later if of(r) == label]
            hits = [r for r in met if r["true_order_rank"] is not None and r["true_order_rank"] <= n]
            assert (tuned, n_races, n_hits, total) == (sum(of(r) == label for r in own), len(met), len(hits), round(sum(r["trifecta_odds"] or 0 for r in hits), 6))


def test_walk_forward_of_nothing(spark):
    assert roi.walk_forward(bets(spark, 10).where("false")).count() == 0
    assert roi.walk_forward(bets(spark, 10)).count() == 0


def test_grouping_sets_give_the_condition_report(spark):
    df = bets(spark)
    key = lambda rows: sorted((r.condition, r.label, r.low is None, r.low or 0, r.high or 0, r.top_n, r.n_races, r.n_hits, round(r.total_return, 6), round(r.roi_net, 9)) for r in rows)
    want = roi.condition_report(df).collect()
    assert len({r.condition for r in want}) == 6 and key(roi.condition_sets(df).collect()) == key(want)
    assert "Expand" in roi.condition_sets(df)._jdf.queryExecution().executedPlan().toString()


def test_reports_read_staged_races(spark, small):
    from lanewise.plans.queries import QUERIES

    for name in ("race_conditions", "race_condition_sets", "race_decile_audit", "race_walk_forward", "race_quantile_bins", "race_model_quality"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan parquet") <= 10 and "BroadcastNestedLoopJoin" not in plan.replace("BroadcastNestedLoopJoin BuildRight, Cross", "").replace("BroadcastNestedLoopJoin BuildRight, LeftOuter", ""), name
