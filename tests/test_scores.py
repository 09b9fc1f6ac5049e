import math
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.functions import conform as C
from lanewise.functions import scores as S
from lanewise.operators import metrics, prepare, scoring

CASES = [
    ("a", [6.0, 5.0, 4.0, 3.0, 2.0, 1.0], [1, 2, 3, 4, 5, 6]), ("b", [0.0] * 6, [3, 1, 2, 6, 5, 4]), ("c", [300.0, -300.0, 2.0, 1.0, 0.5, 0.0], [7, 7, 1, 2, 3, 4]), ("d", [0.3, 0.1, 0.5, 0.2, 0.9, 0.4], [None, 2, 1, 3, 0, 5]),
]


@pytest.fixture(scope="module")
def races(spark):
    return spark.createDataFrame(CASES, "race_key string, scores array<double>, ranks array<int>")


def pl(s, order):
    e = [math.exp(x - max(s)) for x in s]
    p, left = 1.0, sum(e)
    for i in order:
        p, left = p * e[i] / left if left else 0.0, left - e[i]
    return p


def truth(ranks):
    return sorted(range(6), key=lambda i: (ranks[i] if ranks[i] and ranks[i] >= 1 else 7, i))


def test_exotics(races):
    rows = races.select("race_key", "scores", S.exotics(F.col("scores"), 3).alias("x"), S.top_exotics(F.col("scores"), 2, 4).alias("e")).collect()
    for r in rows:
        assert sum(x.p for x in r.x) == pytest.approx(1.0) or r.race_key == "c"
        want = sorted(((-pl(r.scores, p), i) for i, p in enumerate(permutations(range(6), 3))))
        assert [x.p for x in r.x][:5] == pytest.approx([-w[0] for w in want[:5]], abs=1e-12)
    assert [x["combination"] for x in rows[1].e] == ["1-2", "1-3", "1-4", "1-5"]


def test_ranks_against_brute_force(races):
    got = {r.race_key: r for r in S.full_order_ranks(races).collect()}
    other = {r.race_key: r for r in races.select("race_key", S.trifecta_rank(F.col("scores"), F.col("ranks")).alias("t"), S.set_rank(F.col("scores"), F.col("ranks")).alias("s"), S.true_order_probability(F.col("scores"), F.col("ranks")).alias("p")).collect()}
    for key, s, ranks in (c for c in CASES if c[0] != "c"):
        t = truth(ranks)
        every = sorted((-round(math.log(pl(s, p)), 12), i, p) for i, p in enumerate(permutations(range(6))))
        assert got[key].order_rank == 1 + [p for _, _, p in every].index(tuple(t))
        assert got[key].set_rank == 1 + next(i for i, x in enumerate(every) if set(x[2][:3]) == set(t[:3]))
        assert other[key].p == pytest.approx(pl(s, t))
    assert other["a"].t == 1 and other["a"].s == 1


def test_fixed_losses(races):
    one = metrics.losses(races.where("race_key = 'a'")).first()
    assert one.pl_nll == pytest.approx(2.069165, abs=1e-5) and one.pl_top3 == pytest.approx(0.452100, abs=1e-5)
    flat = races.where("race_key = 'a'").select(S.full_nll(F.col("scores"), F.col("ranks"), 3, (1.0, 1.0, 1.0)).alias("x")).first().x
    assert flat == pytest.approx(0.449432, abs=1e-5)


def test_orders_and_personas(races):
    r = {x.race_key: x for x in races.select("race_key", S.trifecta_text(F.col("ranks")).alias("t"), S.rerank(F.col("ranks")).alias("r"), S.hit_texts(F.lit("1-2-3"), F.lit("3-1-2")).alias("h")).collect()}
    assert r["a"].t == "1-2-3" and r["d"].t == "3-2-4" and r["a"].h
    assert all(sorted(x.r) == [1, 2, 3, 4, 5, 6] for x in r.values())
    people = S.persona_scores(F.col("scores"), F.col("race_key"), 3)
    a = races.select("race_key", *(c.alias(n) for n, c in people.items())).orderBy("race_key").collect()
    b = races.repartition(3).select("race_key", *(c.alias(n) for n, c in people.items())).orderBy("race_key").collect()
    assert a == b and sum(a[3].trend) == pytest.approx(0, abs=1e-9) and a[0].safe[0] == pytest.approx(6 / 0.8 + 0.15)


def test_conform(spark):
    df = spark.createDataFrame([("桐　生", "F.12", "１-２-３", "is-wind16", "15.0℃", "まくり差し", "北北東"), ("7", "0.1", "1=1=2", "is-wind4", "", "x", "y"), ("x y", "L", "返還", "z", None, None, None)], "v string, st string, c string, w string, n string, m string, d string")
    r = df.select(C.venue_number(F.col("v")).alias("v"), C.start_timing(F.col("st")).alias("st"), C.combination_digits(F.col("c")).alias("c"), C.wind_icon_degrees(F.col("w")).alias("w"), C.to_number(F.col("n")).alias("n"), C.win_pattern(F.col("m")).alias("m"), C.compass_degrees(F.col("d")).alias("d"), C.bet_type(F.lit("TRIO")).alias("b"), C.nfkc(F.lit("Ａ１")).alias("k"), C.spaced_place(F.lit("若松")).alias("s")).collect()
    assert [x.v for x in r] == ["01", "07", "xy"] and [None if x.st is None else float(x.st) for x in r] == [-0.12, 0.1, None]
    assert [x.c for x in r] == ["123", "112", None] and [x.w for x in r] == [0.0, 90.0, None] and [x.n for x in r] == [15.0, None, None]
    assert [x.m for x in r] == ["MAKURI_SASHI", "OTHER", "OTHER"] and [x.d for x in r] == [22.5, None, None] and (r[0].b, r[0].k, r[0].s) == ("3連複", "A1", "若 松")


def test_quantile_bins(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 1, 1, 2, 3, 4, 5, 6]] + [(None,)], "x double")
    got = [(r.x, r.b.id if r.b else None) for r in prepare.with_quantile_bin(df, "x", 4, "b").collect()]
    pd = pytest.importorskip("pandas")
    want = pd.qcut(pd.Series([x for x, _ in got]), 4, labels=False, duplicates="drop")
    assert [b for _, b in got] == [None if w != w else int(w) for w in want]
    one = prepare.with_quantile_bin(spark.createDataFrame([(1.0,), (1.0,)], "x double"), "x", 4, "b").collect()
    assert all(r.b is None for r in one)


def test_model_scores(spark):
    w = scoring.random_weights(6, 3)
    rng = np.random.default_rng(1)
    rows = [(f"r{i}", "01" if i % 2 else "99", rng.normal(size=6).tolist(), rng.normal(size=(6, 2)).tolist()) for i in range(7)]
    df = spark.createDataFrame(rows, "race_key string, venue string, ctx array<double>, boats array<array<double>>")
    got = {r.race_key: r for r in scoring.predict_scores(df, {"01": w, "": scoring.random_weights(6, 3, 5)}).collect()}
    s, st, _ = scoring.forward(w, np.array([rows[1][2]]), np.array([rows[1][3]]))
    assert got["r1"].scores == pytest.approx((s[0] / 0.8).tolist()) and got["r1"].st_pred == pytest.approx(st[0].tolist()) and len(got) == 7


def test_model_inputs(spark):
    cols = {f"lane{i}_{f}": float(i) for i in range(1, 7) for f in ("exh_time", "weight", "bf_course", "rank")}
    wide = spark.createDataFrame([{"race_key": "a", "wind_speed": 3.0, "wave_height": None, "air_temp": None, "water_temp": None, "wind_sin": 0.5, "wind_cos": None, **cols}], ", ".join(["race_key string", "wind_speed double", "wave_height double", "air_temp double", "water_temp double", "wind_sin double", "wind_cos double", *(f"{c} double" for c in cols)]))
    stats = spark.createDataFrame([(1.0, 2.0, 0.0, 1.0, None, None, None, None, 3.5, 1.0)], "wind_speed_mean double, wind_speed_std double, wave_height_mean double, wave_height_std double, air_temp_mean double, air_temp_std double, water_temp_mean double, water_temp_std double, weight_mean double, weight_std double")
    r = prepare.model_inputs(wide, stats).first()
    assert r.ctx == [1.0, 0.0, 0.0, 0.0, 0.5, 0.0] and len(r.boats) == 6 and len(r.boats[0]) == 5 and r.ranks == [1, 2, 3, 4, 5, 6] and r.mask == [0.0] * 6
