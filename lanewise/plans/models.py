"""The query of a small network's scores, with the network written out in SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scoring
from . import standins as X
from .registry import query

#: Two venues of their own and all others; hidden layers of two units, so that SQL can spell every term.
NAMED = ("1", "2", "")


def small_weights(seed: int) -> dict[str, np.ndarray]:
    """A weight set of a rule: two context columns, one of an entrant and one of its lane."""
    at = lambda *shape, k: np.round(np.sin(np.arange(1, np.prod(shape) + 1) * (seed + k)), 3).reshape(shape)
    out = {"lane": at(6, 1, k=1), "ctx_w": at(2, 2, k=2), "ctx_b": at(2, k=3), "boat_w": at(2, 2, k=4), "boat_b": at(2, k=5)}
    for i, n in enumerate(("rank", "st", "win")):
        out |= {f"{n}_w1": at(2, 2, k=6 + i), f"{n}_b1": at(2, k=9 + i), f"{n}_w2": at(2, 1, k=12 + i), f"{n}_b2": at(1, k=15 + i)}
    return out


WEIGHTS = {v: small_weights(i + 1) for i, v in enumerate(NAMED)}


def _sql() -> str:
    """One select a venue's set: the units of the entrant's layer, then each head's."""
    parts = []
    for venue, w in WEIGHTS.items():
        num = lambda x: f"({float(x)!r}::double)"
        unit = lambda j, w=w: f"tanh(c1 * {num(w['ctx_w'][0, j])} + c2 * {num(w['ctx_w'][1, j])} + {num(w['ctx_b'][j])} + x * {num(w['boat_w'][0, j])} + ({' '.join(f'when {i + 1} then {num(v[0])}' for i, v in enumerate(w['lane']))} end) * {num(w['boat_w'][1, j])} + {num(w['boat_b'][j])})".replace("(when", "(case lane when", 1)
        inner = lambda n, k, w=w: f"greatest(h0 * {num(w[f'{n}_w1'][0, k])} + h1 * {num(w[f'{n}_w1'][1, k])} + {num(w[f'{n}_b1'][k])}, 0::double)"
        head = lambda n, w=w: " + ".join(f"{inner(n, k)} * {num(w[f'{n}_w2'][k, 0])}" for k in (0, 1)) + f" + {num(w[f'{n}_b2'][0])}"
        where = f"venue = '{venue}'" if venue else f"venue not in ({', '.join(repr(v) for v in NAMED if v)})"
        parts.append(f"select race_key, venue, lane, round(({head('rank')}) / {scoring.TEMPERATURE}, 6) score, round({head('st')}, 6) st_pred, round({head('win')}, 6) win_logit from (select *, {unit(0)} h0, {unit(1)} h1 from e where {where})")
    return """with e as (select cast(o_orderkey as varchar) race_key, cast(o_orderkey % 5 as varchar) venue, lane::int lane, o_totalprice / 100000.0 c1, (o_custkey % 7) / 7.0 c2, ((o_custkey * lane) % 11) / 10.0 x
from orders, range(1, 7) t(lane)) """ + " union all ".join(parts)


@query(_sql())
def race_network_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Rank scores, start times and win logits of every race's six entrants by the batch scorer, a weight set a venue."""
    o = X.table(spark, sf, "orders")
    boats = F.array(*(F.array(F.pmod(F.col("o_custkey") * lane, F.lit(11)) / 10.0) for lane in range(1, 7)))
    inputs = o.select(F.col("o_orderkey").cast("string").alias("race_key"), (F.col("o_orderkey") % 5).cast("string").alias("venue"), F.array(F.col("o_totalprice") / 100000.0, F.col("o_custkey") % 7 / 7.0).alias("ctx"), boats.alias("boats"))
    each = scoring.predict_scores(inputs, WEIGHTS).select("race_key", "venue", F.posexplode(F.arrays_zip("scores", "st_pred", "win_logits")).alias("i", "b"))
    return each.select("race_key", "venue", (F.col("i") + 1).cast("int").alias("lane"), F.round("b.scores", 6).alias("score"), F.round("b.st_pred", 6).alias("st_pred"), F.round("b.win_logits", 6).alias("win_logit"))
