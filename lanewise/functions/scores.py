"""Expressions over a race's six scores and ranks (arrays by lane): Plackett-Luce probabilities, orders, hits, personas.

All stay inside a row: permutations are literal arrays, so no race is joined or shuffled to be expanded.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = range(1, 7)
EPSILON = 1e-12


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def orders(n: int, ordered: bool = True) -> Column:
    """All ways to pick n lanes, as a literal array of arrays in lexicographic order."""
    pick = permutations if ordered else combinations
    return F.expr("array(" + ",".join("array(" + ",".join(map(str, p)) + ")" for p in pick(LANES, n)) + ")")


def strengths(scores: Column, tau: float = 1.0) -> Column:
    """exp(tau (s - max s))."""
    return let(F.array_max(scores), lambda top: F.transform(scores, lambda s: F.exp(tau * (s - top))))


def softmax(scores: Column) -> Column:
    return let(strengths(scores), lambda e: let(total(e), lambda d: F.transform(e, lambda x: x / d)))


def fair_odds(p: Column) -> Column:
    return 1.0 / F.greatest(p, F.lit(EPSILON))


def order_probability(e: Column, whole: Column, picks: Column, n: int) -> Column:
    """Plackett-Luce probability of the first n places; picks: lanes in order."""
    p, left = F.lit(1.0), whole
    for k in range(n):
        s = e[picks[k] - 1]
        p, left = p * F.coalesce(F.try_divide(s, left), F.lit(0.0)), left - s  # nothing is left where scores lie very far apart
    return p


def exotics(scores: Column, n: int, tau: float = 1.0) -> Column:
    """struct(p, at, lanes) of all ordered picks of n lanes, most probable first, ties in lexicographic order."""
    def of(e: Column) -> Column:
        return let(total(e), lambda d: F.transform(orders(n), lambda o, i: F.struct((-order_probability(e, d, o, n)).alias("minus_p"), i.alias("at"), o.alias("lanes"))))

    return F.transform(F.array_sort(let(strengths(scores, tau), of)), lambda x: F.struct((-x["minus_p"]).alias("p"), x["at"].alias("at"), x["lanes"].alias("lanes")))


def top_exotics(scores: Column, n: int, k: int = 10, tau: float = 1.0) -> Column:
    """The k most probable picks: struct(rank, combination, p, fair_odds)."""
    return F.transform(F.slice(exotics(scores, n, tau), 1, k), lambda x, i: F.struct((i + 1).alias("rank"), F.concat_ws("-", x["lanes"].cast("array<string>")).alias("combination"), x["p"].alias("p"), fair_odds(x["p"]).alias("fair_odds")))


def probability_map(scores: Column, k: int = 10) -> Column:
    return F.map_from_entries(F.transform(top_exotics(scores, 3, k), lambda x: F.struct(x["combination"], x["p"])))


def trifecta_gap(scores: Column) -> Column:
    """struct(label, p1, p2, gap, entropy, variance): the two best trifectas, win entropy, population variance."""
    best = F.slice(exotics(scores, 3), 1, 2)
    mean = lambda xs: total(xs) / F.size(xs)
    entropy = let(softmax(scores), lambda p: -total(F.transform(p, lambda x: x * F.ln(x + EPSILON))))
    variance = let(mean(scores), lambda m: mean(F.transform(scores, lambda s: (s - m) * (s - m))))
    return let(best, lambda b: F.struct(F.concat_ws("-", b[0]["lanes"].cast("array<string>")).alias("label"), b[0]["p"].alias("p1"), b[1]["p"].alias("p2"), (b[0]["p"] - b[1]["p"]).alias("gap"), entropy.alias("entropy"), variance.alias("variance")))


def true_order(ranks: Column) -> Column:
    """Lanes by rank, ties by lane; missing and unplaced ranks (null, below 1) come last."""
    keyed = F.transform(ranks, lambda r, i: F.struct(F.when((r >= 1), r).otherwise(F.lit(7)).alias("r"), (i + 1).alias("lane")))
    return F.transform(F.array_sort(keyed), lambda x: x["lane"])


def predicted_order(scores: Column) -> Column:
    """Lanes by descending score, ties by lane."""
    return F.transform(F.array_sort(F.transform(scores, lambda s, i: F.struct((-s).alias("s"), (i + 1).alias("lane")))), lambda x: x["lane"])


def rerank(ranks: Column) -> Column:
    """A unique rank 1 to 6 for each lane, ties by lane."""
    return let(true_order(ranks), lambda o: F.transform(ranks, lambda _, i: F.array_position(o, i + 1).cast("int")))


def order_text(lanes: Column, n: int = 3) -> Column:
    return F.concat_ws("-", F.slice(lanes, 1, n).cast("array<string>"))


def trifecta_text(ranks: Column) -> Column:
    """'a-b-c' of the three best known ranks; null with fewer than three."""
    known = F.filter(F.transform(ranks, lambda r, i: F.struct(r.alias("r"), (i + 1).alias("lane"))), lambda x: x["r"] > 0)
    return F.when(F.size(known) >= 3, F.concat_ws("-", F.transform(F.slice(F.array_sort(known), 1, 3), lambda x: x["lane"]).cast("array<string>")))


def hit_ordered(a: Column, b: Column, n: int = 3) -> Column:
    return F.slice(a, 1, n) == F.slice(b, 1, n)


def hit_unordered(a: Column, b: Column, n: int = 3) -> Column:
    return F.array_sort(F.slice(a, 1, n)) == F.array_sort(F.slice(b, 1, n))


def hit_texts(a: Column, b: Column) -> Column:
    """Whether two 'a-b-c' texts name the same set."""
    return F.array_sort(F.split(a, "-")) == F.array_sort(F.split(b, "-"))


def masked_odds(odds: Column, hit: Column) -> Column:
    return F.when(F.coalesce(hit, F.lit(False)), odds).otherwise(F.lit(0.0))


def true_order_probability(scores: Column, ranks: Column) -> Column:
    return let(strengths(scores), lambda e: let(true_order(ranks), lambda o: order_probability(e, total(e), o, 6)))


def true_set_probability(scores: Column, ranks: Column) -> Column:
    """Probability that the true first three fill the first three places, in any order."""
    def of(e: Column, o: Column) -> Column:
        d, p = total(e), F.lit(0.0)
        for pick in permutations(range(3)):
            p = p + order_probability(e, d, F.array(*(o[i] for i in pick)), 3)
        return p

    return let(strengths(scores), lambda e: let(true_order(ranks), lambda o: of(e, o)))


def set_rank(scores: Column, ranks: Column) -> Column:
    """Place of the true set of three among the 20 by the sum of its scores."""
    value = lambda o: scores[o[0] - 1] + scores[o[1] - 1] + scores[o[2] - 1]
    return let(F.array_sort(F.slice(true_order(ranks), 1, 3)), lambda t: let(value(t), lambda v: let(F.array_position(orders(3, False), t), lambda at: F.size(F.filter(orders(3, False), lambda o, i: (value(o) > v) | ((value(o) == v) & (i + 1 < at)))) + 1)))


def trifecta_rank(scores: Column, ranks: Column) -> Column:
    """Place of the true first three among the 120 ordered triples by probability."""
    return let(F.slice(true_order(ranks), 1, 3), lambda t: F.array_position(F.transform(exotics(scores, 3), lambda x: x["lanes"]), t).cast("int"))


def full_order_ranks(df: DataFrame, batch: int = 256) -> DataFrame:
    """race_key, order_rank and set_rank among the 720 full orders, by numpy within tasks.

    order_rank: place of the true order by probability, ties in lexicographic order; set_rank: the best place of an
    order whose first three are the true ones. At most `batch` races are held against the 720 orders at once.
    """
    index = np.array(list(permutations(range(6))))
    sets = np.sort(index[:, :3], axis=1) @ np.array([36, 6, 1])

    def ranked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                s = np.array(part["scores"].tolist(), dtype=float).reshape(-1, 6)
                r = np.array([[7.0 if x is None or not x >= 1 else float(x) for x in row] for row in part["ranks"]]).reshape(-1, 6)
                true = np.argsort(r, axis=1, kind="stable")
                e = np.exp(s - s.max(axis=1, keepdims=True))[:, index]
                log_p = (np.log(e) - np.log(np.cumsum(e[:, :, ::-1], axis=2)[:, :, ::-1])).sum(axis=2).round(12)
                own = (index[None] == true[:, None]).all(axis=2).argmax(axis=1)
                place = np.argsort(np.argsort(-log_p, axis=1, kind="stable"), axis=1, kind="stable") + 1
                same = sets[None] == (np.sort(true[:, :3], axis=1) @ np.array([36, 6, 1]))[:, None]
                yield pd.DataFrame({"race_key": part["race_key"], "order_rank": place[np.arange(len(s)), own], "set_rank": np.where(same, place, 721).min(axis=1)})

    return df.select("race_key", "scores", "ranks").mapInPandas(ranked, "race_key string, order_rank int, set_rank int")


def full_nll(scores: Column, ranks: Column, top: int = 6, weights: tuple[float, ...] | None = None) -> Column:
    """Plackett-Luce negative log likelihood of the first `top` places, scores clamped to 20; weighted by place."""
    clamped = F.transform(scores, lambda s: F.greatest(F.lit(-20.0), F.least(F.lit(20.0), s)))

    def of(e: Column, s: Column, o: Column) -> Column:
        out, left = F.lit(0.0), total(e)
        for k in range(top):
            term = F.ln(F.greatest(left, F.lit(1e-300))) - s[o[k] - 1]
            out = out + term * (weights[k] if weights else 1.0)
            left = left - e[o[k] - 1]
        return out / (sum(weights) if weights else 1.0)

    return let(clamped, lambda s: let(F.transform(s, lambda x: F.exp(x)), lambda e: let(true_order(ranks), lambda o: of(e, s, o))))


def ranknet(scores: Column, ranks: Column) -> Column:
    """Mean over the 15 lane pairs of softplus(-sign(rank_j - rank_i) (s_i - s_j))."""
    out = F.lit(0.0)
    for i, j in combinations(range(6), 2):
        out = out + F.log1p(F.exp(-F.signum((ranks[j] - ranks[i]).cast("double")) * (scores[i] - scores[j])))
    return out / 15


def rank_distance(scores: Column, ranks: Column, power: int = 1) -> Column:
    """Sum of |d| (power 1) or d squared (2) between predicted and true places of the lanes."""
    places = lambda o: F.transform(F.sequence(F.lit(1), F.lit(6)), lambda lane: F.array_position(o, lane))
    d = F.zip_with(places(predicted_order(scores)), places(true_order(ranks)), lambda a, b: F.abs(a - b).cast("double"))
    return total(F.transform(d, lambda x: x if power == 1 else x * x))


def spearman(scores: Column, ranks: Column) -> Column:
    return 1 - 6 * rank_distance(scores, ranks, 2) / (6 * 35.0)


def winner_position(scores: Column, ranks: Column) -> Column:
    return let(true_order(ranks), lambda o: F.array_position(predicted_order(scores), o[0]))


def with_temperature(scores: Column, t: float) -> Column:
    return F.transform(scores, lambda s: s / t)


def with_lane_bias(scores: Column, lanes: list[int], bias: float) -> Column:
    return F.transform(scores, lambda s, i: F.when((i + 1).isin(lanes), s + bias).otherwise(s))


def with_noise(scores: Column, key: Column, scale: float, seed: int) -> Column:
    """Adds N(0, scale) drawn from a hash of key, lane and seed, the same in any partitioning (Box-Muller)."""
    text = lambda i, k: F.concat_ws("|", key, (i + 1).cast("string"), F.lit(str(seed)), F.lit(str(k)))
    unit = lambda i, k: (F.conv(F.left(F.md5(text(i, k).cast("binary")), F.lit(12)), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return F.transform(scores, lambda s, i: s + scale * F.sqrt(-2 * F.ln(unit(i, 0))) * F.cos(2 * float(np.pi) * unit(i, 1)))


def sharpened(scores: Column, power: float) -> Column:
    """log of the powered and renormalised win probabilities, centred on 0."""
    raised = lambda p: F.transform(p, lambda x: F.pow(x, F.lit(power)))
    logs = let(raised(softmax(scores)), lambda q: let(total(q), lambda d: F.transform(q, lambda x: F.ln(F.greatest(x / d, F.lit(EPSILON))))))
    return let(logs, lambda xs: let(total(xs) / F.size(xs), lambda m: F.transform(xs, lambda x: x - m)))


def persona_scores(scores: Column, key: Column, seed: int = 0) -> dict[str, Column]:
    """Scores as three bettors see them: safe (inner lanes), chaos (outer lanes, noise) and trend (sharpened)."""
    return {
        "safe": with_lane_bias(with_temperature(scores, 0.8), [1, 2], 0.15),
        "chaos": with_noise(with_lane_bias(with_temperature(scores, 1.3), [4, 5, 6], 0.20), key, 0.07, seed),
        "trend": sharpened(scores, 1.35),
    }
