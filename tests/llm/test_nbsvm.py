"""The quality classifier: its fit against a plain solver, held-out accuracy, and odd rows."""

import numpy as np
from pyspark.sql import functions as F

from lanewise.llm import nbsvm
from lanewise.llm.common import table


def test_descent_reaches_the_minimum():
    rng = np.random.default_rng(3)
    rows = [np.flatnonzero(rng.random(12) < 0.4) for _ in range(150)]
    y = np.array([int(len(set(r) & {1, 2, 3}) + rng.normal(0, 0.5) > 1) for r in rows])
    r = nbsvm.ratios(rows, y, 12)
    count = lambda k: np.array([1 + sum(t in set(x) for x, v in zip(rows, y, strict=True) if v == k) for t in range(12)])
    assert np.allclose(r, np.log(count(1) / count(1).sum()) - np.log(count(0) / count(0).sum()))
    x = np.array([[r[t] if t in set(k) else 0.0 for t in range(12)] for k in rows])
    x = np.column_stack([x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None], np.ones(len(x))])
    sign, plain = np.where(y > 0, 1, -1), np.zeros(13)
    loss = lambda w: w @ w / 2 + nbsvm.COST * np.maximum(0, 1 - sign * (x @ w)).sum()
    for k in range(1, 40_000):
        active = sign * (x @ plain) < 1
        plain -= (plain - nbsvm.COST * (sign[active, None] * x[active]).sum(axis=0)) / (20 + k)
    w = nbsvm.fit_svm(rows, y, r)
    assert loss(w) <= 1.005 * loss(plain)
    assert np.allclose(nbsvm.drawn_to_mean(w)[:12], 0.75 * np.abs(w[:12]).mean() + 0.25 * w[:12])


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    found = nbsvm.op13_quality_classifier(spark, sf)
    assert found.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    assert found.count() == docs.count() and found.where("score is null or score < 0 or score > 1 or predicted <> int(score >= 0.3)").count() == 0
    rows = found.where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    assert sum(r.predicted for r in rows if r.quality) >= 0.97 * sum(r.quality for r in rows)
    # Labels of held-out rows are never read: turning them over changes nothing.
    seen = labels.where(~nbsvm.is_held_out(F.col("doc_id")))
    turned = seen.unionByName(labels.where(nbsvm.is_held_out(F.col("doc_id"))).withColumn("quality", 1 - F.col("quality")))
    again = nbsvm.score_quality(docs, turned.where(~nbsvm.is_held_out(F.col("doc_id")))).select("doc_id", F.col("_quality").alias("again"))
    assert found.join(again, "doc_id").where("score <> again").count() == 0


def test_odd_rows(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    given = docs.select("doc_id", "text").unionByName(odd.select(F.col("doc_id") + 10**9, "text").toDF("doc_id", "text")).withColumn("y", F.lit(1)).withColumn("model", F.lit(2)).repartition(3)
    more = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int").select(*(F.col(c).cast(t).alias(c) for c, t in labels.dtypes)))
    scored = nbsvm.score_quality(given, more)
    assert scored.columns == [*given.columns, "_quality"]
    rows = [r for r in scored.collect() if r.doc_id is None or r.doc_id > 10**9]
    by_text = {}
    for r in rows:
        by_text.setdefault(r.text or "", set()).add(r._quality)
    assert len(rows) == odd.count() and all(len(s) == 1 for s in by_text.values())  # equal texts, equal scores
    assert nbsvm.score_quality(none, labels).count() == 0
    assert {r._quality for r in nbsvm.score_quality(odd, labels.limit(0)).collect()} == {0.5}
    one = nbsvm.score_quality(odd, spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, quality int"))
    assert all(r._quality > 0.99 for r in one.collect())


def test_terms():
    assert nbsvm.terms_of(None) == set() == nbsvm.terms_of("  \n")
    found = nbsvm.terms_of("Go GO go!! 12")
    assert {"go", ("go", "go"), ("", "Xx"), ("", "="), ("", "Xx", "="), ("", "Xx", "=", "=", "!!"), ("", "=", "=", "!!", "0")} <= found
    for text in ("Go GO go!! 12", "one", "a b", "A b 3", "x && x x_y __ 7 7 é É", "w " * 9, "İstanbul iSTANBUL McX ǅ"):
        tokens = nbsvm.TOKEN.findall(text)
        forms = ["=" if i and t.lower() == tokens[i - 1].lower() else nbsvm.form_of(t) for i, t in enumerate(tokens)]
        assert nbsvm.words_and_forms(text)[1] == {("", *forms[i : i + n]) for n in range(1, 5) for i in range(len(forms) - n + 1)}
        number = {t: i for i, t in enumerate(sorted(nbsvm.terms_of(text), key=repr)) if i % 2}
        assert nbsvm.numbers_of(text, number).tolist() == sorted(number.values())
    assert {nbsvm.term_of(nbsvm.name_of(t)) for t in found} == found
