"""Model quality over races with arrays `scores` and `ranks`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..sources.shared import stage
from .quantiles import values_at


def per_race(df: DataFrame) -> DataFrame:
    """Per-race figures that the summaries average."""
    s, r = F.col("scores"), F.col("ranks")
    df = df.withColumns({"pred": S.predicted_order(s), "true": S.true_order(r)})
    hits = {f"hit{k}": (F.col("pred")[k - 1] == F.col("true")[k - 1]).cast("double") for k in (1, 2, 3)}
    base = {f"base{k}": (F.col("true")[k - 1] == k).cast("double") for k in (1, 2, 3)}
    return df.withColumns({
        **hits, **base,
        "trifecta_hit": S.hit_ordered(F.col("pred"), F.col("true")).cast("double"), "trio_hit": S.hit_unordered(F.col("pred"), F.col("true")).cast("double"),
        "base_trifecta": (F.slice("true", 1, 3) == F.expr("array(1,2,3)")).cast("double"), "base_trio": (F.array_sort(F.slice("true", 1, 3)) == F.expr("array(1,2,3)")).cast("double"),
        "mrr": 1.0 / S.winner_position(s, r), "spearman": S.spearman(s, r),
        "set_rank": S.set_rank(s, r), "trifecta_rank": S.trifecta_rank(s, r),
    }).withColumn("spread", S.let(S.total(s) / 6, lambda m: S.total(F.transform(s, lambda x: (x - m) * (x - m))) / 5))


def quality(df: DataFrame) -> DataFrame:
    """One row: races, position and set hit rates, constant 1-2-3 baselines, MRR, Spearman, score spread, mean ranks."""
    names = ["hit1", "hit2", "hit3", "trifecta_hit", "trio_hit", "base1", "base2", "base3", "base_trifecta", "base_trio", "mrr", "spearman", "set_rank", "trifecta_rank"]
    races = stage(per_race(df).select("spread", *names), "quality-races")
    lower = values_at(races, "spread", lambda n: F.array(F.ceil(n / 2) - 1)).select(F.get("values", F.lit(0)).alias("spread_median"))
    return races.agg(F.count("*").alias("n_races"), *(F.avg(c).alias(c) for c in names), F.avg("spread").alias("spread_mean")).join(lower, F.lit(True), "left")  # one row each


def model_vs_market(races: DataFrame, market: DataFrame) -> DataFrame:
    """One row: races with both ranks, their means, gain (popularity rank less model rank) and coverage of the first 1 and 3."""
    both = races.join(market, "race_key").where("trifecta_rank is not null and popularity_rank is not null").withColumn("gain", F.col("popularity_rank") - F.col("trifecta_rank"))
    cover = lambda c, k: F.avg((F.col(c) <= k).cast("double"))
    return both.agg(
        F.count("*").alias("n_races"), F.avg("popularity_rank").alias("market_rank"), F.avg("trifecta_rank").alias("model_rank"), F.avg("gain").alias("gain_mean"), F.median("gain").alias("gain_median"),  # whole numbers within a few hundred: few distinct values
        F.avg((F.col("gain") > 0).cast("double")).alias("beat_rate"), *(x for k in (1, 3) for x in (cover("trifecta_rank", k).alias(f"model_top{k}"), cover("popularity_rank", k).alias(f"market_top{k}"), (cover("trifecta_rank", k) - cover("popularity_rank", k)).alias(f"top{k}_difference"))),
    )


def losses(df: DataFrame, weights: tuple[float, float, float] = (3.0, 2.0, 1.0)) -> DataFrame:
    """One row: mean Plackett-Luce losses over six and over three weighted places, RankNet and rank distance."""
    s, r = F.col("scores"), F.col("ranks")
    return df.agg(F.avg(S.full_nll(s, r)).alias("pl_nll"), F.avg(S.full_nll(s, r, 3, weights)).alias("pl_top3"), F.avg(S.ranknet(s, r)).alias("ranknet"), F.avg(S.rank_distance(s, r) / 6).alias("rank_l1"))


def start_errors(df: DataFrame, predicted: str = "st_pred", actual: str = "st") -> DataFrame:
    """Mean squared and absolute start-time error over lanes with a true time that isn't 0."""
    pairs = df.select(F.inline(F.arrays_zip(F.col(predicted).alias("p"), F.col(actual).alias("a")))).where("a <> 0")
    return pairs.agg(F.avg((F.col("p") - F.col("a")) ** 2).alias("mse"), F.avg(F.abs(F.col("p") - F.col("a"))).alias("mae"))


def persona_votes(df: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Votes per race and trifecta over the personas' first choices; and per race the most votes and the disagreement."""
    people = S.persona_scores(F.col("scores"), F.col("race_key"), seed)
    first = F.array(*(F.struct(F.lit(n).alias("persona"), S.order_text(S.predicted_order(x)).alias("trifecta")) for n, x in people.items()))
    votes = df.select("race_key", F.inline(first)).groupBy("race_key", "trifecta").agg(F.count("*").alias("votes"))
    return votes, votes.groupBy("race_key").agg(F.max("votes").alias("max_votes"), (F.lit(len(people)) - F.max("votes")).alias("disagreement"))
