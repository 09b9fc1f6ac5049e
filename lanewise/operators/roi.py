"""Return reports: top-n simulation, conditions, probability deciles, rolling walk-forward evaluation.

Races carry race_key, race_date, venue, true_order_rank (place of the true order in the model's list), trifecta_odds,
pl_prob, gap, wind_speed, wave_height and wind_dir_deg.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import conform as C
from ..sources.shared import stage
from .core import latest
from .quantiles import edges_of, quantile_bin, values_at

TOP_N = (1, 2, 3, 4, 5)
CONDITIONS = ("pl_prob_bin", "gap_bin", "wind_bin", "wave_bin", "tailwind", "venue")
LEAST_RACES, LEAST_RACES_VENUE = 30, 50


def one_per_race(df: DataFrame) -> DataFrame:
    """One row a race: of several, the greatest by all other columns in their order."""
    return latest(df, ["race_key"], [c for c in df.columns if c != "race_key"])


def hit(n: int | Column) -> Column:
    return F.col("true_order_rank") <= n


def top_n_simulation(df: DataFrame) -> DataFrame:
    """n, races, submitted (100 yen a ticket), benefit and percent return; missing odds pay nothing."""
    pays = lambda n: F.sum(F.when(hit(n), F.coalesce("trifecta_odds", F.lit(0.0)) * 100).otherwise(0.0))
    wide = df.agg(F.count("*").alias("races"), *(pays(n).alias(f"b{n}") for n in TOP_N))
    rows = wide.select("races", F.inline(F.array(*(F.struct(F.lit(n).alias("n"), F.col(f"b{n}").alias("benefit")) for n in TOP_N))))
    return rows.select("n", "races", (F.col("races") * F.col("n") * 100).alias("submitted"), "benefit", (F.col("benefit") / (F.col("races") * F.col("n") * 100) * 100).alias("roi_pct"))


def fixed_bins() -> dict[str, Column]:
    """wind_bin, wave_bin and tailwind as bin structs."""
    tail = (F.coalesce(F.sin(F.radians("wind_dir_deg")), F.lit(0.0)) < 0).cast("int")
    return {"wind_bin": C.wind_bin(F.col("wind_speed")), "wave_bin": C.wave_bin(F.col("wave_height")), "tailwind": F.struct(tail.alias("id"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))}


def as_conditions(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """keep, condition, label, low and high: one row for each condition a race meets, from one pass."""
    bins = {c: F.struct(F.lit(c).alias("condition"), F.col(c)["id"].cast("string").alias("label"), F.col(c)["low"].alias("low"), F.col(c)["high"].alias("high")) for c in CONDITIONS if c != "venue"}
    venue = F.struct(F.lit("venue").alias("condition"), F.col("venue").cast("string").alias("label"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    return df.select(*keep, F.inline(F.array(*bins.values(), venue))).where("label is not null")


def summarise(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n_races, n_hits, hit_rate, total_return, total_cost, roi_net and avg_odds_on_hits by condition, bin and top_n.

    Five conditional sums a group, unpivoted afterwards, instead of five times the rows.
    """
    sums = [x for n in TOP_N for x in (F.sum(hit(n).cast("int")).alias(f"h{n}"), F.sum(F.when(hit(n), F.coalesce("trifecta_odds", F.lit(0.0))).otherwise(0.0)).alias(f"r{n}"))]
    return by_top_n(long.groupBy(*by, "condition", "label", "low", "high").agg(F.count("*").alias("n_races"), *sums), by)


def by_top_n(wide: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows by top_n, with rates and returns, from columns h1 .. (hits) and r1 .. (returned)."""
    rows = wide.select(*by, "condition", "label", "low", "high", "n_races", F.inline(F.array(*(F.struct(F.lit(n).alias("top_n"), F.col(f"h{n}").alias("n_hits"), F.col(f"r{n}").alias("total_return")) for n in TOP_N))))
    return rows.withColumn("total_cost", F.col("top_n") * F.col("n_races")).withColumns({
        "hit_rate": F.col("n_hits") / F.col("n_races"), "roi_net": (F.col("total_return") - F.col("total_cost")) / F.col("total_cost"), "avg_odds_on_hits": F.col("total_return") / F.nullif(F.col("n_hits"), F.lit(0)),
    })


def enough() -> Column:
    return F.col("n_races") >= F.when(F.col("condition") == "venue", LEAST_RACES_VENUE).otherwise(LEAST_RACES)


def binned(df: DataFrame, q: int) -> DataFrame:
    """One row a race whose rank and odds are known, with its bin structs; the deduped races are written once, and the
    edges of both quantile conditions come from the same reads."""
    known = stage(one_per_race(df).where("race_key is not null and true_order_rank is not null and trifecta_odds is not null"), "condition-races")
    edges = edges_of(known, ["pl_prob", "gap"], q).toDF("_p", "_g")
    return known.crossJoin(F.broadcast(edges)).withColumns({**fixed_bins(), "pl_prob_bin": quantile_bin(F.col("pl_prob"), F.col("_p")), "gap_bin": quantile_bin(F.col("gap"), F.col("_g"))})  # one row


def condition_report(df: DataFrame, q: int = 4) -> DataFrame:
    """The summary over all races whose rank, odds and bin are known, best return first."""
    return summarise(as_conditions(binned(df, q), ["race_key", "true_order_rank", "trifecta_odds"])).where(enough()).orderBy(F.desc("roi_net"), F.desc("hit_rate"), "condition", "label", "top_n")


def condition_sets(df: DataFrame, q: int = 4) -> DataFrame:
    """The same report by one GROUPING SETS aggregate over the six conditions; grouping_id says which one a row is of."""
    box = lambda label, low=None, high=None: F.struct(label.cast("string").alias("label"), *(F.lit(None).cast("double").alias(n) if x is None else x.alias(n) for n, x in (("low", low), ("high", high))))
    bins = {c: F.when(F.col(c).isNotNull(), box(F.col(c)["id"], F.col(c)["low"], F.col(c)["high"])) for c in CONDITIONS if c != "venue"} | {"venue": F.when(F.col("venue").isNotNull(), box(F.col("venue")))}
    sums = [x for n in TOP_N for x in (F.sum(hit(n).cast("int")).alias(f"h{n}"), F.sum(F.when(hit(n), F.col("trifecta_odds")).otherwise(0.0)).alias(f"r{n}"))]
    rows = binned(df, q).select("true_order_rank", "trifecta_odds", *(x.alias(c) for c, x in bins.items()))
    wide = rows.groupingSets([[c] for c in CONDITIONS], *CONDITIONS).agg(F.grouping_id().alias("_g"), F.count("*").alias("n_races"), *sums)
    # The bit of a set's own column is the one that is 0; the first column has the highest.
    every, last = (1 << len(CONDITIONS)) - 1, len(CONDITIONS) - 1
    own = [F.when(F.col("_g") == every - (1 << last - i), F.struct(F.lit(c).alias("condition"), F.col(c).alias("bin"))) for i, c in enumerate(CONDITIONS)]
    named = wide.withColumn("_o", F.coalesce(*own)).where("_o.bin is not null").select("_o.condition", "_o.bin.label", "_o.bin.low", "_o.bin.high", *(c for c in wide.columns if c not in (*CONDITIONS, "_g")))
    return by_top_n(named).where(enough()).orderBy(F.desc("roi_net"), F.desc("hit_rate"), "condition", "label", "top_n")


def best_conditions(report: DataFrame, by: Sequence[str] = ("top_n",)) -> DataFrame:
    """The best row by roi_net, n_races and hit_rate; remaining ties by the conditions' order, then the bins'."""
    place = F.array_position(F.lit(list(CONDITIONS)), F.col("condition"))
    order = Window.partitionBy(*by).orderBy(F.desc("roi_net"), F.desc("n_races"), F.desc("hit_rate"), place, F.col("low").asc_nulls_first(), "label")
    return report.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def matching(races: DataFrame, chosen: DataFrame, by: Sequence[str] = (), salts: int = 32) -> DataFrame:
    """Rows of the long form that meet a chosen condition (and window), with its top_n: an equi-join on condition and bin.

    A condition of two bins has half of all races in one key: races are dealt by a salt from their key, and the few chosen
    rows are repeated for every salt, so that no task gets a bin whole.
    """
    key = [*by, "condition", "label"]
    some = chosen.select(*key, "top_n", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    return races.withColumn("_salt", F.pmod(F.xxhash64("race_key"), F.lit(salts)).cast("int")).join(some, [*key, "_salt"]).drop("_salt")


def matching_races(df: DataFrame, q: int = 4, by: Sequence[str] = ("top_n",)) -> DataFrame:
    """race_key, true_order_rank, trifecta_odds, top_n, condition and label of the races that meet the best condition of
    each top_n."""
    long = stage(as_conditions(binned(df, q), ["race_key", "true_order_rank", "trifecta_odds"]), "condition-long")
    chosen = stage(best_conditions(summarise(long).where(enough()), by), "condition-chosen")  # one row a top_n
    return matching(long.drop("low", "high"), chosen)


def roles_of(panes: DataFrame, last: int, tune: int, test: int) -> DataFrame:
    """pane, window and is_tune: windows 0 .. last tune on panes k * test .. k * test + tune - 1 and test on the next
    `test` panes. Arithmetic on the pane, not a join on ranges."""
    pane = F.col("pane")
    first_tune, last_tune = F.greatest(F.lit(0), F.ceil((pane - tune + 1) / test)), F.least(F.lit(last), F.floor(pane / test))
    test_at = F.floor((pane - tune) / test)
    box = lambda k, is_tune: F.struct(k.cast("int").alias("window"), F.lit(is_tune).alias("is_tune"))
    nothing = F.expr("cast(array() as array<struct<window:int,is_tune:boolean>>)")
    tunes = F.when(first_tune <= last_tune, F.transform(F.sequence(first_tune, last_tune), lambda k: box(k, True))).otherwise(nothing)
    tests = F.when((test_at >= 0) & (test_at <= last), F.array(box(test_at, False))).otherwise(nothing)
    return panes.select("pane", F.inline(F.concat(tunes, tests)))


def edge_cell(x: Column, edges: Column) -> Column:
    """struct(low, point) of where x lies among edges: the edge that it is, or the greatest below it (null below all)."""
    return F.when(x.isNotNull(), F.struct(F.array_max(F.filter(edges, lambda e: e <= x)).alias("low"), F.coalesce(F.array_contains(edges, x), F.lit(False)).alias("point")))


def bin_of_cell(cell: Column, edges: Column) -> Column:
    """quantile_bin of all values of a cell: its edges hold these edges, so they are in one bin."""
    low, top = cell["low"], F.get(edges, F.size(edges) - 1)
    i = F.greatest(F.lit(1), F.size(F.filter(edges, lambda e: (e < low) | ((e == low) & ~cell["point"]))))
    inside = (F.size(edges) > 1) & (low >= F.get(edges, F.lit(0))) & ((low < top) | ((low == top) & cell["point"]))
    return F.when(inside, F.struct((i - 1).alias("id"), F.get(edges, i - 1).alias("low"), F.get(edges, i).alias("high")))


def pane_sums(races: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts and returns by pane, condition, bin, and (quantile conditions) cell among the pane's edges: known races' as
    k, hk1 .., rk1 .., all races' as m, hm1 .., rm1 ... edges: pane, _p and _g, the edges of all windows it serves."""
    nothing, no_cell = F.lit(None).cast("double"), F.lit(None).cast("struct<low:double,point:boolean>")
    box = lambda c, label, low, high, cell: F.struct(F.lit(c).alias("condition"), label.cast("string").alias("label"), low.alias("low"), high.alias("high"), cell.alias("cell"))
    fixed = [box(c, F.col(c)["id"], F.col(c)["low"], F.col(c)["high"], no_cell) for c in fixed_bins()]
    moving = [box(f"{c}_bin", F.lit(None), nothing, nothing, edge_cell(F.col(c), F.col(e))) for c, e in (("pl_prob", "_p"), ("gap", "_g"))]
    long = races.join(edges, "pane").withColumns(fixed_bins()).select("pane", "is_known", "true_order_rank", "trifecta_odds", F.inline(F.array(*fixed, *moving, box("venue", F.col("venue"), nothing, nothing, no_cell)))).where("label is not null or cell is not null")
    sums = []
    for s, of in (("k", F.col("is_known")), ("m", F.lit(True))):
        sums += [F.count_if(of).alias(s), *(x for n in TOP_N for x in (F.count_if(of & hit(n)).alias(f"h{s}{n}"), F.sum(F.when(of & hit(n), F.coalesce("trifecta_odds", F.lit(0.0))).otherwise(0.0)).alias(f"r{s}{n}")))]
    return long.groupBy("pane", "condition", "label", "low", "high", "cell").agg(*sums)


def walk_forward(df: DataFrame, tune_days: int = 120, test_days: int = 30, least_tune: int = 50, least_test: int = 10, q: int = 4, least_hits: int = 3) -> DataFrame:
    """For each window and top_n: the condition chosen on the tune days and what it returns on the test days.

    Window k tunes on the tune_days before its test start, min + tune_days + k * test_days. Days are cut into panes that
    windows are made of; races are summed by pane once, and windows are sums of panes' sums, never copies of races.
    Quantile edges are the tune races' and are applied to the test races: they come from panes' sketches and counts, and
    races are summed by their cell among the edges of all windows that a pane serves. A chosen condition that no test
    race meets gives a row of zeros with null rates. Races need a key and a rank; tune races odds too, while a missing
    odds of a test hit pays nothing.
    """
    races = stage(one_per_race(df).where("race_key is not null and race_date is not null"), "walk-races")
    a, b = races.agg(F.min("race_date"), F.max("race_date")).first()
    days = gcd(tune_days, test_days)
    last = -1 if a is None else ((b - a).days - tune_days) // test_days  # of the windows that start by the last day
    races = races.withColumns({"pane": F.floor(F.datediff("race_date", F.lit(a).cast("date")) / days).cast("int"), "is_known": F.col("true_order_rank").isNotNull() & F.col("trifecta_odds").isNotNull()})
    panes = stage(races.groupBy("pane").agg(F.count("*").alias("n")), "walk-panes")
    roles = roles_of(panes, last, tune_days // days, test_days // days)
    sizes = roles.join(panes, "pane").groupBy("window").agg(*(F.coalesce(F.sum(F.when(of, F.col("n"))), F.lit(0)).alias(n) for n, of in (("_t", F.col("is_tune")), ("_e", ~F.col("is_tune")))))
    roles = stage(roles.join(sizes.where((F.col("_t") >= least_tune) & (F.col("_e") >= least_test)).select("window"), "window"), "walk-roles")
    edges = stage(edges_of(races.where("is_known"), ["pl_prob", "gap"], q, ["window"], ["pane"], roles.where("is_tune").select("pane", "window")).toDF("window", "_p", "_g"), "walk-edges")
    every = roles.join(edges, "window").groupBy("pane").agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("_p", "_g")))  # of a few windows
    sums = stage(pane_sums(races, every), "walk-sums")
    placed = sums.join(roles, "pane").join(edges, "window")
    moved = F.when(F.col("condition") == "pl_prob_bin", bin_of_cell(F.col("cell"), F.col("_p"))).when(F.col("condition") == "gap_bin", bin_of_cell(F.col("cell"), F.col("_g")))
    placed = placed.withColumn("_m", moved).withColumns({"label": F.coalesce("label", F.col("_m.id").cast("string")), "low": F.coalesce("low", "_m.low"), "high": F.coalesce("high", "_m.high")}).where("label is not null")
    names = ["k", *(f"{x}k{n}" for n in TOP_N for x in "hr")], ["m", *(f"{x}m{n}" for n in TOP_N for x in "hr")]
    wide = placed.groupBy("window", "condition", "label", "low", "high").agg(*(F.coalesce(F.sum(F.when(of, F.col(c))), F.lit(0)).alias(c) for side, of in zip(names, (F.col("is_tune"), ~F.col("is_tune")), strict=True) for c in side))
    box = lambda n: F.struct(F.lit(n).alias("top_n"), F.col(f"hk{n}").alias("h"), F.col(f"rk{n}").alias("r"), F.col(f"hm{n}").alias("n_hits"), F.col(f"rm{n}").alias("total_return"))
    rows = wide.select("window", "condition", "label", "low", "high", F.col("k").alias("tune_races"), F.col("m").alias("_races"), F.inline(F.array(*map(box, TOP_N)))).withColumn("n_races", F.col("tune_races"))
    report = rows.where(enough()).withColumns({"roi_net": (F.col("r") - F.col("top_n") * F.col("n_races")) / (F.col("top_n") * F.col("n_races")), "hit_rate": F.col("h") / F.col("n_races")})
    several = report.withColumn("_bins", F.count("*").over(Window.partitionBy("window", "top_n", "condition"))).where("_bins > 1")
    chosen = best_conditions(several.where(F.col("roi_net").isNotNull() & (F.col("h") >= least_hits)), ["window", "top_n"])
    out = chosen.select("window", "top_n", "condition", "label", "low", "high", F.col("roi_net").alias("tune_roi"), "tune_races", F.col("_races").alias("n_races"), "n_hits", "total_return").withColumn("total_cost", F.col("n_races") * F.col("top_n"))
    return out.withColumns({"hit_rate": F.col("n_hits") / F.nullif(F.col("n_races"), F.lit(0)), "roi_net": (F.col("total_return") - F.col("total_cost")) / F.nullif(F.col("total_cost"), F.lit(0))})


def walk_forward_total(windows: DataFrame) -> DataFrame:
    sums = windows.groupBy("top_n").agg(*(F.sum(c).alias(c) for c in ("n_races", "n_hits", "total_return", "total_cost")), F.count("*").alias("windows"))
    return sums.withColumns({"hit_rate": F.col("n_hits") / F.nullif(F.col("n_races"), F.lit(0)), "roi_net": (F.col("total_return") - F.col("total_cost")) / F.nullif(F.col("total_cost"), F.lit(0))})


def decile_audit(df: DataFrame, q: int = 10, tops: Sequence[int] = (1, 2, 3, 5)) -> DataFrame:
    """Hits and returns by probability decile (0-based) and top_n, with the decile's shares of hits and return."""
    known = stage(one_per_race(df).where("pl_prob is not null and true_order_rank is not null and trifecta_odds is not null").select("pl_prob", "true_order_rank", "trifecta_odds"), "decile-races")
    edges = edges_of(known, ["pl_prob"], q).toDF("edges")
    binned = known.crossJoin(F.broadcast(edges)).withColumn("decile", quantile_bin(F.col("pl_prob"), F.col("edges"))["id"])  # one row
    sums = [x for n in tops for x in (F.sum(hit(n).cast("int")).alias(f"h{n}"), F.sum(F.when(hit(n), F.col("trifecta_odds")).otherwise(0.0)).alias(f"r{n}"))]
    medians = values_at(binned, "pl_prob", lambda n: F.array((n - 1) / 2), ["decile"]).select("decile", F.get("values", F.lit(0)).alias("prob_median"))
    wide = binned.groupBy("decile").agg(F.count("*").alias("n_races"), F.avg("pl_prob").alias("prob_mean"), *sums).join(medians, "decile")
    rows = wide.select("decile", "n_races", "prob_mean", "prob_median", F.inline(F.array(*(F.struct(F.lit(n).alias("top_n"), F.col(f"h{n}").alias("n_hits"), F.col(f"r{n}").alias("total_return")) for n in tops))))
    w = Window.partitionBy("top_n")
    return rows.withColumns({"hit_rate": F.col("n_hits") / F.col("n_races"), "total_cost": F.col("top_n") * F.col("n_races")}).withColumns({
        "roi_net": (F.col("total_return") - F.col("total_cost")) / F.col("total_cost"),
        "return_share": F.col("total_return") / F.nullif(F.sum("total_return").over(w), F.lit(0.0)), "hit_share": F.col("n_hits") / F.nullif(F.sum("n_hits").over(w), F.lit(0)),
    })


def bins_by_condition(report: DataFrame) -> DataFrame:
    return report.groupBy("top_n", "condition").agg(F.count_distinct("label").alias("n_bins"))


def top_rows(report: DataFrame, n: int = 10) -> DataFrame:
    """The n best rows of a condition report."""
    return report.orderBy(F.desc("roi_net"), F.desc("hit_rate"), "condition", "label", "top_n").limit(n)


def decile_ends(audit: DataFrame) -> DataFrame:
    """For each top_n, hit rate and return of the lowest and the highest decile side by side."""
    ends = [f(F.struct("hit_rate", "roi_net"), "decile").alias(n) for n, f in (("low", F.min_by), ("high", F.max_by))]
    rows = audit.groupBy("top_n").agg(*ends)
    return rows.select("top_n", *(F.col(f"{n}.{c}").alias(f"{n}_{c}") for n in ("low", "high") for c in ("hit_rate", "roi_net")))
