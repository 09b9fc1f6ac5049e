"""Toxicity by a classifier chain over categories, trained from the labels table.

Word evidence comes first: the smoothed log odds of each term (a lower-cased word, or the first letters of a longer
one) between labelled rows with and without a label, from counts by fold. A document's features are short summaries of
its terms' log odds for each label. The chain's categories follow each other, each a logistic regression over these
features and the probabilities of all categories before it. For training, a row's evidence comes from the other folds
and its earlier probabilities from models that did not see its fold; the last models are fitted on those same columns.
Training rests on the SAMPLE_ROWS labelled rows whose ids hash lowest; scoring covers every row and its whole text.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, stage, table

LABELS, FOLDS, SAMPLE_ROWS, MOST_TERMS, PREFIX = ("toxic", "low_quality"), 4, 20_000, 20_000, 5
#: In the chain's order, all from the two labels: toxic, toxic prose of fair quality, and toxic junk of low quality.
CATEGORIES = ("toxic", "prose_abuse", "junk_abuse")
MARKER, RIDGE = 2.0, 1.0
#: A toxic document that stays counts as much as three clean ones that go.
COST = 3
THRESHOLD = 1 / (1 + COST)
WORD = re.compile(r"[^\W\d_]+")


def terms_of(text: str | None) -> set[str]:
    words = set(WORD.findall((text or "").lower()))
    return words | {w[:PREFIX] + "*" for w in words if len(w) > PREFIX}


def summary(terms: set[str], odds: dict[str, tuple[float, ...]]) -> list[float]:
    """For each label: the greatest log odds, the sum of the three greatest, the log count and the share of markers."""
    found = [odds[t] for t in terms if t in odds]
    out: list[float] = []
    for k in range(len(LABELS)):
        top = sorted((f[k] for f in found if f[k] > 0), reverse=True)
        marks = sum(x > MARKER for x in top)
        out += [top[0] if top else 0.0, sum(top[:3]), math.log1p(marks), marks / max(1, len(terms)) ** 0.5]
    return out


@dataclass
class Chain:
    """odds: log odds by term; weights: for each category, over 1, the features and the earlier probabilities."""

    odds: dict[str, tuple[float, ...]]
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    def predict(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.mean) / self.scale
        out = np.zeros((len(x), 0))
        for w in self.weights:
            out = np.column_stack([out, sigmoid(weighted_sum(np.column_stack([x, out]), w))])
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def weighted_sum(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """w[0] + x w[1:], column by column: a row's sum has one order, however many rows stand in the batch."""
    out = np.full(len(x), w[0])
    for k in range(x.shape[1]):
        out = out + x[:, k] * w[k + 1]
    return out


def with_one(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Ridge logistic regression by Newton steps; a constant low probability if only one class is there."""
    x = with_one(x)
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        w[0] = 20.0 if len(y) and y[0] else -20.0
        return w
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(30):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """doc_id, text, fold and 0/1 labels of at most `rows` labelled documents, those with the lowest hash of the id."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"), (1 - F.coalesce(F.min("quality"), F.lit(1))).cast("int").alias("low_quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Repeated rows of an id are one training row, so that the bound holds.
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic", "low_quality").agg(F.min("text").alias("text"))
    return found.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int"))  # at most `rows` rows are broadcast


def term_counts(sample: DataFrame) -> DataFrame:
    """term and, by fold, the rows that have it: f{k}_n in all and f{k}_{label} with a label; the empty term counts all."""
    columns = [f"f{k}_{c}" for k in range(FOLDS) for c in ("n", *LABELS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[Counter] = [Counter() for _ in columns]
        for b in batches:
            for text, fold, *marks in zip(*(b.column(c).to_pylist() for c in ("text", "fold", *LABELS)), strict=True):
                terms, at = terms_of(text) | {""}, fold * (1 + len(LABELS))
                counts[at].update(terms)
                for i, m in enumerate(marks):
                    if m:
                        counts[at + 1 + i].update(terms)
        names = list({t for c in counts for t in c})
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[t] for t in names], pa.int64()) for c in counts)], ["term", *columns])

    parts = sample.select("text", "fold", *LABELS).mapInArrow(run, "term string, " + ", ".join(f"{c} long" for c in columns))
    return parts.groupBy("term").agg(*(F.sum(c).alias(c) for c in columns))


def log_odds(rows: list, leave: int | None) -> dict[str, tuple[float, ...]]:
    """Smoothed log odds by term for each label, from all folds but one."""
    folds = [k for k in range(FOLDS) if k != leave]
    total = lambda r, c: sum(r[f"f{k}_{c}"] for k in folds)
    every = next((r for r in rows if r["term"] == ""), None)
    if every is None:
        return {}
    out = {}
    for r in rows:
        if r["term"] and (n := total(r, "n")) > 1:
            odds = []
            for c in LABELS:
                with_, all_with, all_n = total(r, c), total(every, c), total(every, "n")
                odds.append(math.log((with_ + 0.5) / (all_with + 1)) - math.log((n - with_ + 0.5) / (all_n - all_with + 1)))
            out[r["term"]] = tuple(odds)
    return out


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, most_terms: int = MOST_TERMS) -> Chain:
    sample = stage(labelled_sample(docs, labels, sample_rows), "toxicity-sample")  # sample_rows at most; read three times
    counts = term_counts(sample)
    n = sum(F.col(f"f{k}_n") for k in range(FOLDS))
    # The terms with the strongest evidence for either label: at most most_terms rows reach the driver.
    every = counts.where("term = ''").first()
    if every is None:
        return Chain({}, np.zeros(8), np.ones(8), [fit_logistic(np.zeros((0, 8 + i)), np.zeros(0)) for i in range(len(CATEGORIES))])
    strength = F.lit(0.0)
    for c in LABELS:
        rate = max(sum(every[f"f{k}_{c}"] for k in range(FOLDS)), 0.5) / max(sum(every[f"f{k}_n"] for k in range(FOLDS)), 1)
        with_ = sum(F.col(f"f{k}_{c}") for k in range(FOLDS))
        strength = F.greatest(strength, F.abs(with_ - n * rate) / F.sqrt(n * rate + 1))
    kept = counts.where((F.col("term") != "") & (n > 2)).orderBy(strength.desc(), "term").limit(most_terms).collect()
    kept.append(every)
    by_fold = [log_odds(kept, k) for k in range(FOLDS)]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [summary(terms_of(t), by_fold[f]) for t, f in zip(b.column("text").to_pylist(), b.column("fold").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("fold"), *(b.column(c) for c in LABELS), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "fold", *LABELS, "x"])

    rows = sample.select("doc_id", "text", "fold", *LABELS).mapInArrow(features, "doc_id long, fold int, " + ", ".join(f"{c} int" for c in LABELS) + ", x array<double>").collect()
    rows.sort(key=lambda r: (r.doc_id, r.x))
    x, fold = np.array([r.x for r in rows]), np.array([r.fold for r in rows])
    toxic, low = np.array([r.toxic for r in rows]), np.array([r.low_quality for r in rows])
    targets = [toxic, toxic * (1 - low), toxic * low]
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z, weights = (x - mean) / scale, []
    for y in targets:
        weights.append(fit_logistic(z, y))
        unseen = np.zeros(len(z))
        for k in range(FOLDS):
            unseen[fold == k] = sigmoid(with_one(z[fold == k]) @ fit_logistic(z[fold != k], y[fold != k]))
        z = np.column_stack([z, unseen])
    return Chain(log_odds(kept, None), mean, scale, weights)


def mark_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """All columns of docs with `_toxic`, a struct of the categories' probabilities and the verdict.

    Without labelled rows nothing is toxic. Null labels aren't training rows, a null quality isn't low; repeated labels
    of a document count once (toxic if any is); other columns pass through; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    chain = train(docs, labels, sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # at most MOST_TERMS terms
    schema = "struct<" + ",".join(f"p_{c}:double" for c in CATEGORIES) + ">"

    @F.pandas_udf(schema)
    def run(batches: Iterator[pandas.Series]) -> Iterator[pandas.DataFrame]:
        c = shared.value
        for texts in batches:
            x = np.array([summary(terms_of(t), c.odds) for t in texts]).reshape(-1, 4 * len(LABELS))
            yield pandas.DataFrame(c.predict(x), columns=[f"p_{n}" for n in CATEGORIES])

    return docs.withColumn("_toxic", run(F.coalesce(F.col("text"), F.lit("")))).withColumn("_toxic", F.struct("_toxic.*", (F.greatest(*(F.col(f"_toxic.p_{c}") for c in CATEGORIES)) >= threshold).alias("toxic")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark_toxic(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return marked.select("doc_id", *(F.round(f"_toxic.p_{c}", 6).alias(f"p_{c}") for c in CATEGORIES), "_toxic.toxic")
