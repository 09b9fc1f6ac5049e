"""Batch scoring with a small two-branch ranker, one weight set a venue."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIDDEN, EMBEDDING, TEMPERATURE, BATCH = 160, 8, 0.80, 512
SCORED = "race_key string, venue string, scores array<double>, st_pred array<double>, win_logits array<double>"


def forward(weights: dict[str, np.ndarray], ctx: np.ndarray, boats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rank scores, start times and win logits, (N, 6) each, of inputs ctx (N, C) and boats (N, 6, D).

    Boat columns are cut or padded with zeros to the weights' width.
    """
    width = weights["boat_w"].shape[0] - weights["lane"].shape[1]
    boats = boats[:, :, :width]
    boats = np.concatenate([boats, np.zeros((*boats.shape[:2], width - boats.shape[2]))], axis=2)
    lanes = np.broadcast_to(weights["lane"], (len(boats), *weights["lane"].shape))
    h = np.tanh((ctx @ weights["ctx_w"] + weights["ctx_b"])[:, None] + np.concatenate([boats, lanes], axis=2) @ weights["boat_w"] + weights["boat_b"])
    head = lambda n: (np.maximum(h @ weights[f"{n}_w1"] + weights[f"{n}_b1"], 0) @ weights[f"{n}_w2"] + weights[f"{n}_b2"])[:, :, 0]
    return head("rank"), head("st"), head("win")


def predict_scores(inputs: DataFrame, weights: dict[str, dict[str, np.ndarray]], temperature: float = TEMPERATURE) -> DataFrame:
    """SCORED rows of race_key, venue, ctx and boats; venues without weights use those under ''.

    Weights are of fixed size (some 81,000 numbers a venue) and go to the executors once.
    """
    shared = inputs.sparkSession.sparkContext.broadcast(weights)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for venue, part in frame.groupby("venue", dropna=False):
                w = shared.value.get(venue, shared.value.get(""))
                if w is None:
                    continue
                for at in range(0, len(part), BATCH):
                    p = part.iloc[at : at + BATCH]
                    boats = np.array([np.stack([np.asarray(x, dtype=float) for x in b]) for b in p["boats"]])
                    s, st, win = forward(w, np.stack([np.asarray(x, dtype=float) for x in p["ctx"]]), boats)
                    yield pd.DataFrame({"race_key": p["race_key"], "venue": p["venue"], "scores": list(s / temperature), "st_pred": list(st), "win_logits": list(win)})

    return inputs.select("race_key", "venue", "ctx", "boats").mapInPandas(run, SCORED)  # each batch is split by venue in its task


def random_weights(ctx: int, boat: int, seed: int = 0, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    """A weight set of the right shapes, for tests."""
    r = np.random.default_rng(seed)
    make = lambda *shape: r.normal(0, 0.3, shape)
    out = {"lane": make(6, EMBEDDING), "ctx_w": make(ctx, hidden), "ctx_b": make(hidden), "boat_w": make(boat + EMBEDDING, hidden), "boat_b": make(hidden)}
    for n in ("rank", "st", "win"):
        out |= {f"{n}_w1": make(hidden, 64), f"{n}_b1": make(64), f"{n}_w2": make(64, 1), f"{n}_b2": make(1)}
    return out
