"""Quality scores by Naive Bayes support vectors.

A text's terms are n-grams of its words (one or two) and of its tokens' forms (one to four): case, digits, symbols, and
whether a token repeats the one before. Each term's indicator is scaled by its log-count ratio r between the two labels,
each text's row to length one, and a linear hinge-loss model is fitted by dual coordinate descent. Its weights are drawn
to their mean size, which mixes the plain Naive Bayes verdict in. Margins become probabilities by a logistic curve that
is fitted to margins of rows that their model did not see.

Training rests on the SAMPLE_ROWS labelled rows whose ids hash lowest and on the MOST_TERMS terms that most of them have;
each fold's model, and the one of all rows, is fitted by a task of its own. Scoring covers every row and its whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, stage, table

SAMPLE_ROWS, MOST_TERMS, LEAST_ROWS, FOLDS = 20_000, 100_000, 3, 4
#: Smoothing of the counts, the bound of a dual variable, passes at most, and the share of a weight against the mean size.
SMOOTHING, COST, PASSES, SHARE = 1.0, 1.0, 30, 0.25
#: Fit ends when no dual variable's projected gradient in a pass is beyond this.
TOLERANCE = 0.01
THRESHOLD = 0.3
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
#: The form of a token of symbols: its first ones.
SYMBOLS = 3


def form_of(token: str) -> str:
    if token[0].isalpha():
        return "x" if token.islower() else "Xx" if token.istitle() else "X" if token.isupper() else "xX"
    return "0" if token[0].isdigit() else token[:SYMBOLS]


class Forms(dict):
    """Forms by token."""

    def __missing__(self, token: str) -> str:
        self[token] = form = form_of(token)
        return form


def forms_in(tokens: list[str], words: list[str]) -> set[tuple]:
    """All runs of one to four forms, after an empty part. Texts have few different runs of four: the shorter ones are
    read off those, and off the text's end."""
    known = Forms()
    forms = ["x" if low else known[t] for t, low in zip(tokens, map(str.islower, tokens))]
    for i, again in enumerate(map(eq, words, words[1:]), 1):
        if again:
            forms[i] = "="
    runs = set(zip(forms, forms[1:], forms[2:], forms[3:]))
    threes = {r[:3] for r in runs}
    twos = {r[:2] for r in threes}
    shorter = {*threes, *twos, *((r[0],) for r in twos)}
    end = forms[-3:]
    return {*(("", *r) for r in runs), *(("", *r) for r in shorter)} | {("", *end[i:j]) for i in range(len(end)) for j in range(i + 1, len(end) + 1)}


def words_and_forms(text: str | None) -> tuple[list[str], set[tuple]]:
    tokens = TOKEN.findall(text or "")
    words = list(map(str.lower, tokens))
    return words, forms_in(tokens, words)


def terms_of(text: str | None) -> set:
    """A word alone, pairs of words, and one to four forms after an empty part, which no word is."""
    words, forms = words_and_forms(text)
    return {*words, *zip(words, words[1:]), *forms}


def numbers_of(text: str | None, number: dict) -> np.ndarray:
    """The sorted numbers of a text's terms that have one."""
    words, forms = words_and_forms(text)
    found = set(map(number.get, set(words)))
    found.update(map(number.get, zip(words, words[1:])))
    found.update(map(number.get, forms))
    found.discard(None)
    return np.array(sorted(found), np.int64)


def name_of(term: str | tuple) -> str:
    """A term as one string: parts have no spaces."""
    return term if isinstance(term, str) else " ".join(term)


def term_of(name: str) -> str | tuple:
    return tuple(name.split(" ")) if " " in name else name


def sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def ratios(rows: list[np.ndarray], y: np.ndarray, n: int) -> np.ndarray:
    """The log-count ratio of each term between rows of label 1 and others, with smoothed counts."""
    count = {k: SMOOTHING + np.bincount(np.concatenate([np.zeros(0, np.int64), *(r for r, v in zip(rows, y, strict=True) if v == k)]), minlength=n) for k in (1, 0)}
    return np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())


def fit_svm(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, seed: int = 0) -> np.ndarray:
    """Weights of the scaled indicators, then of the constant: min |w|^2/2 + COST * sum of hinge losses, by descent on
    one dual variable after the other (each between 0 and COST), rows in a seeded order of each pass."""
    n, sign, rng = len(r), np.where(y > 0, 1.0, -1.0), np.random.default_rng(seed)
    w, alpha = np.zeros(n + 1), np.zeros(len(rows))
    x = [np.append(v := r[k], np.sqrt(v @ v) or 1.0) / (np.sqrt(v @ v) or 1.0) for k in rows]
    at = [np.append(k, n) for k in rows]
    size = np.array([v @ v for v in x])
    for _ in range(PASSES):
        worst = 0.0
        for i in rng.permutation(len(rows)).tolist():
            k, v = at[i], x[i]
            slope = sign[i] * (w[k] @ v) - 1
            projected = min(slope, 0.0) if alpha[i] <= 0 else max(slope, 0.0) if alpha[i] >= COST else slope
            if projected:
                worst = max(worst, abs(projected))
                new = min(max(alpha[i] - slope / size[i], 0.0), COST)
                w[k] += (new - alpha[i]) * sign[i] * v
                alpha[i] = new
        if worst < TOLERANCE:
            break
    return w


def drawn_to_mean(w: np.ndarray) -> np.ndarray:
    """Weights (the constant last) drawn to their mean size by 1 - SHARE."""
    return np.append((1 - SHARE) * np.abs(w[:-1]).mean() + SHARE * w[:-1], SHARE * w[-1])


def margin(ids: list[int] | np.ndarray, r: np.ndarray, weight: np.ndarray, constant: float) -> float:
    """Sums are exact, so that equal texts have equal margins in any batch. weight: r times the model's weight."""
    length = math.sqrt(math.fsum((r[ids] ** 2).tolist())) or 1.0
    return math.fsum(weight[ids].tolist()) / length + constant


def fit_curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and constant of the logistic curve of labels over margins, by Newton steps, with softened labels."""
    high, low = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    t, x = np.where(y > 0, high, low), np.column_stack([margins, np.ones(len(y))])
    w = np.array([0.0, math.log((y.sum() + 1) / ((1 - y).sum() + 1))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - t) + 1e-6 * w)
        w -= step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


class Model:
    """Terms by number, their log-count ratios and weights, the constant, and the curve."""

    def __init__(self, number: dict, r: np.ndarray, weight: np.ndarray, constant: float, curve: tuple[float, float]):
        self.number, self.r, self.weight, self.constant, self.curve = number, r, weight, constant, curve

    def score(self, text: str | None) -> float:
        return sigmoid(self.curve[0] * margin(numbers_of(text, self.number), self.r, self.weight, self.constant) + self.curve[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """text, y and fold of at most `rows` labelled documents, those whose ids hash lowest; the lowest of repeated labels
    counts, and repeated rows of an id are one training row."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # at most `rows` rows are broadcast
    return found.select("doc_id", "text", "y", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int").alias("fold"))


def common_terms(sample: DataFrame, most: int) -> list[str]:
    """The terms that most rows have, without regard to labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                count.update(terms_of(t))
            if len(count) > 1 << 20:
                yield pa.RecordBatch.from_pydict({"term": list(map(name_of, count)), "n": list(count.values())})
                count = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(map(name_of, count)), pa.string()), pa.array(list(count.values()), pa.int64())], ["term", "n"])

    counts = sample.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return [r.term for r in counts.where(F.col("n") >= LEAST_ROWS).orderBy(F.desc("n"), "term").limit(most).select("term").collect()]


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, most_terms: int = MOST_TERMS) -> Model:
    sample = stage(labelled_sample(docs, labels, sample_rows), "nbsvm-sample")
    classes = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(classes) < 2:  # nothing to tell apart: the share of label 1, a half without rows
        share = sum(y * n for y, n in classes.items()) / max(1, sum(classes.values())) if classes else 0.5
        return Model({}, np.zeros(0), np.zeros(0), 0.0, (0.0, math.log((share + 1e-3) / (1 - share + 1e-3))))
    terms = common_terms(sample, most_terms)
    number = {term_of(t): i for i, t in enumerate(terms)}
    shared = docs.sparkSession.sparkContext.broadcast(number)  # most_terms at most

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            rows = [numbers_of(x, known).astype(np.int32).tobytes() for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), b.column("fold"), pa.array(rows, pa.binary())], ["doc_id", "y", "fold", "ids"])

    # sample_rows rows at most, once for each model: that of all rows (FOLDS) and those without a fold.
    rows = stage(sample.mapInArrow(numbered, "doc_id long, y int, fold int, ids binary"), "nbsvm-rows")
    each = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(FOLDS))).alias("model"))
    n = len(terms)

    def fit(key: tuple, own: pa.Table) -> pa.Table:
        model, own = key[0].as_py(), own.sort_by("doc_id")
        ids, y, fold = [np.frombuffer(x, np.int32).astype(np.int64) for x in own.column("ids").to_pylist()], own.column("y").to_numpy(), own.column("fold").to_numpy()
        seen = np.flatnonzero(fold != model)
        r = ratios([ids[i] for i in seen], y[seen], n)
        w = drawn_to_mean(fit_svm([ids[i] for i in seen], y[seen], r))
        weight, unseen = r * w[:n], np.flatnonzero(fold == model)
        margins = np.array([margin(ids[i], r, weight, w[n]) for i in unseen])
        whole = model == FOLDS
        out = [r.tobytes() if whole else None, w.tobytes() if whole else None, margins.tobytes(), y[unseen].astype(np.int32).tobytes()]
        return pa.table([pa.array([model], pa.int32()), *(pa.array([x], pa.binary()) for x in out)], names=["model", "r", "w", "margins", "y"])

    found = sorted(each.groupBy("model").applyInArrow(fit, "model int, r binary, w binary, margins binary, y binary").collect())  # FOLDS + 1 rows
    of = lambda key, kind: np.concatenate([np.frombuffer(f[key], kind) for f in found[:-1]])
    r, w = np.frombuffer(found[-1]["r"]), np.frombuffer(found[-1]["w"])
    return Model(number, r, r * w[:n], float(w[n]), fit_curve(of("margins", np.float64), of("y", np.int32)))


def score_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, most_terms: int = MOST_TERMS) -> DataFrame:
    """All columns of docs with `_quality`, the probability of label 1.

    Only text is an input of a score; null and empty texts have no terms and get one score; equal texts get equal
    scores. Without labels of both classes every score is the labels' share (a half without any). Null labels and ids
    aren't training rows. Repeated rows are scored each; an empty table gives no rows. A column of docs of that name is
    replaced.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample_rows, most_terms))  # most_terms at most

    @F.pandas_udf("double")
    def run(batches: Iterator[pandas.Series]) -> Iterator[pandas.Series]:
        model = shared.value
        for texts in batches:
            yield pandas.Series([model.score(t) for t in texts], dtype="float64")

    return docs.withColumn("_quality", run(F.coalesce(F.col("text"), F.lit(""))))


def is_held_out(doc_id: Column) -> Column:
    """Whether the CRC-32 of the id as text is a multiple of five; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_quality(docs, labels.where(~is_held_out(F.col("doc_id"))))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("_quality").alias("score"), (F.col("_quality") >= THRESHOLD).cast("int").alias("predicted"))
