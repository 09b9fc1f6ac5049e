"""Quality rules: text statistics with fixed base rules, then robust multivariate outliers by language and source.

All statistics are taken inside a row by DataFrame functions. The outlier verdict is a Mahalanobis distance to a
regularised minimum-covariance-determinant (MCD) estimate of each (lang, source), shrunk towards that of the language,
and that towards the estimate of all rows, with the weight of PRIOR_ROWS rows: a rule for groups of every size.
Estimates come from concentration steps from two starts (the moments of all rows; medians and scaled absolute
deviations) that each keep the `keep` share of rows nearest to the current estimate. A step is one aggregation of counts, sums and cross products by group and distance bin and a
running count over the bins, so no step gathers a group's rows: its subset ends with a whole bin (1/32 octave).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, let, stage, table, words_of

FEATURES = ("x0", "x1", "x2", "x3", "x4")
#: Spreads that are never held against a text, added to each feature's variance (squared): twice the length (log 2), an
#: eighth in word length and in the shares of repeated lines and words, not quite twice the symbols.
FLOORS = (0.7, 0.12, 0.6, 0.12, 0.12)
#: Share of rows an estimate rests on; the chi-square quantile (5 degrees of freedom) of that share; concentration steps;
#: the rows that a parent's estimate counts as beside a group's own.
KEEP, KEEP_CHI2, STEPS, PRIOR_ROWS = 0.75, 6.6257, 5, 60
#: Text statistics are far from normal, so the cutoff is not a normal quantile. By Chebyshev's inequality for vectors, at
#: most d / cutoff of any distribution lie beyond a squared distance of `cutoff`: here a twelfth.
MOST_BEYOND = 1 / 12
CUTOFF = len(FEATURES) / MOST_BEYOND
#: Steps of a feature by which medians are taken, so that they are sums of counts and never depend on the partitioning.
GRID = 256
BINS_PER_OCTAVE = 32


def repeated_words(words: Column, n: int = 3) -> Column:
    """Positions of words that lie in an n-word window found twice or more; windows are told apart by XXH64."""

    def of(w: Column) -> Column:
        last = F.size(w) - n
        hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n))))
        return F.when(last < 1, F.lit(0)).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(ordered, lambda s: F.transform(F.filter(s, lambda x, k: x["h"].eqNullSafe(F.get(s, k - 1)["h"]) | x["h"].eqNullSafe(F.get(s, k + 1)["h"])), lambda x: x["i"]))
        # Each window covers n positions, less those that the window found before it covers too.
        steps = let(F.sort_array(twice), lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(n), F.coalesce(x - F.get(p, k - 1), F.lit(n)))), F.lit(0), lambda a, x: a + x))
        return steps

    return let(words, of).cast("long")


def text_stats(docs: DataFrame) -> DataFrame:
    """docs with text_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of the whole text."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, SPACE_CLASS, "")) > 0)
    return docs.select(
        "*",
        let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words"))).alias("_w"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("_l"),
    ).select("*", "_w.*", "_l.*").drop("_w", "_l")


def features(df: DataFrame) -> DataFrame:
    """Transformed statistics: log length, log mean word length, log symbol share, shares of repeated lines and words."""
    n, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return df.withColumns(dict(zip(FEATURES, (
        F.log1p(F.col("n_words").cast("double")), F.log(F.greatest("word_chars", F.lit(1)) / n), F.log(F.col("n_symbols") / n + 0.02),
        F.col("n_dup_lines") / lines, F.col("n_repeat_words") / n,
    ), strict=True)))


def moments(weight: Column | None = None) -> list[Column]:
    x = [F.col(c) for c in FEATURES]
    return [F.count("*").alias("n"), *(F.sum(a).alias(f"s{i}") for i, a in enumerate(x)), *(F.sum(x[i] * x[j]).alias(f"p{i}{j}") for i in range(len(x)) for j in range(i + 1))]


def estimate(sums: DataFrame) -> DataFrame:
    """From n, s and p: the means m and the lower triangle l of the regularised covariance's Cholesky factor."""
    d = len(FEATURES)
    out = sums.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(d)})
    for i in range(d):
        for j in range(i + 1):
            c = F.col(f"p{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")
            c = F.greatest(c, F.lit(0.0)) + FLOORS[i] ** 2 if i == j else c
            for k in range(j):
                c = c - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(c, F.lit(1e-9))) if i == j else c / F.col(f"l{j}{j}"))
    keep = [f"m{i}" for i in range(d)] + [f"l{i}{j}" for i in range(d) for j in range(i + 1)]
    return out.select(*(c for c in sums.columns if not (c == "n" or c[0] in "sp" and c[1:].isdigit())), *keep)


def distance(df: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance of x to m by forward substitution with l."""
    d = len(FEATURES)
    for i in range(d):
        z = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            z = z - F.col(f"l{i}{k}") * F.col(f"z{k}")
        df = df.withColumn(f"z{i}", z / F.col(f"l{i}{i}"))
    return df.withColumn("d2", sum(F.col(f"z{i}") * F.col(f"z{i}") for i in range(d)))


def medians(rows: DataFrame, columns: list[Column], name: str) -> DataFrame:
    """grp and `name`0, 1, ..: each column's lower median by group, to 1 / GRID, from counts by bin."""
    long = rows.select("grp", F.posexplode(F.array(*columns)).alias("i", "x")).select("grp", "i", F.round(F.col("x") * GRID).alias("bin"))
    by = Window.partitionBy("grp", "i")
    upto = F.sum("n").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    counts = long.groupBy("grp", "i", "bin").agg(F.count("*").alias("n")).select("grp", "i", "bin", (upto * 2 >= F.sum("n").over(by)).alias("half"))
    return counts.where("half").groupBy("grp").agg(*(F.min(F.when(F.col("i") == i, F.col("bin") / GRID)).alias(f"{name}{i}") for i in range(len(columns))))


def mcd(rows: DataFrame, keep: float = KEEP, steps: int = STEPS) -> DataFrame:
    """The estimates by group: rows has `grp` and FEATURES. Returns grp, rows, m, l and `scale` (the squared distance
    that holds `keep` of the rows)."""
    d = len(FEATURES)
    first = rows.groupBy("grp").agg(*moments()).withColumn("start", F.lit(0))
    centre = stage(medians(rows, [F.col(c) for c in FEATURES], "s"), "mcd-centre")
    spread = medians(rows.join(centre, "grp"), [F.abs(F.col(c) - F.col(f"s{i}")) for i, c in enumerate(FEATURES)], "a").join(centre, "grp")
    second = spread.select("grp", F.lit(1).cast("long").alias("n"), *(F.col(f"s{i}") for i in range(d)), *((F.col(f"s{i}") * F.col(f"s{j}") + (F.pow(1.4826 * F.col(f"a{i}"), F.lit(2)) if i == j else 0)).alias(f"p{i}{j}") for i in range(d) for j in range(i + 1)), F.lit(1).alias("start"))
    now = stage(estimate(first.unionByName(second)), "mcd-start")
    for _ in range(steps):
        bins = distance(rows.join(now, "grp")).withColumn("bin", F.floor(F.log2(F.col("d2") + 1e-6) * BINS_PER_OCTAVE)).groupBy("grp", "start", "bin").agg(*moments())
        by = Window.partitionBy("grp", "start")
        upto = by.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        kept = bins.withColumn("of", F.sum("n").over(by)).withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).where(F.col("before") < F.col("of") * keep)
        sums = [c for c in bins.columns if c not in ("grp", "start", "bin")]
        now = stage(estimate(kept.groupBy("grp", "start").agg(*(F.sum(c).alias(c) for c in sums), F.max("bin").alias("edge"), F.max("of").alias("rows"))), "mcd-step")
    det = sum(F.log(F.col(f"l{i}{i}")) for i in range(d))
    best = now.groupBy("grp").agg(F.min_by(F.struct(*(c for c in now.columns if c != "grp")), F.struct(det, "start")).alias("b")).select("grp", "b.*")
    return best.withColumn("scale", F.pow(F.lit(2.0), (F.col("edge") + 1) / BINS_PER_OCTAVE)).drop("start", "edge")


def shrunk(own: DataFrame, parent: DataFrame, prior: int) -> DataFrame:
    """own's estimates (keys, rows, m, c, scale) drawn to those of their parent (p_m, p_c, p_scale), as of `prior` rows."""
    share = F.col("rows") / (F.col("rows") + prior)
    values = [c for c in parent.columns if c[:2] == "p_"]
    return own.join(parent, [c for c in parent.columns if c not in values], "left").select(
        *(c for c in own.columns if f"p_{c}" not in values), *((F.col(c[2:]) * share + F.coalesce(F.col(c), F.col(c[2:])) * (1 - share)).alias(c[2:]) for c in values),
    )


def covariances(best: DataFrame) -> DataFrame:
    """c, the lower triangle of the covariance l l', in place of l."""
    d = len(FEATURES)
    return best.select(*(c for c in best.columns if c[0] != "l"), *(sum(F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j + 1)).alias(f"c{i}{j}") for i in range(d) for j in range(i + 1)))


def factors(shrunken: DataFrame) -> DataFrame:
    """l, the Cholesky factor, in place of c."""
    d = len(FEATURES)
    out = shrunken
    for i in range(d):
        for j in range(i + 1):
            c = F.col(f"c{i}{j}")
            for k in range(j):
                c = c - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(c, F.lit(1e-9))) if i == j else c / F.col(f"l{j}{j}"))
    return out.drop(*(f"c{i}{j}" for i in range(d) for j in range(i + 1)))


def group_limits(rows: DataFrame, keep: float = KEEP, steps: int = STEPS, prior: int = PRIOR_ROWS) -> DataFrame:
    """l and s (language and source), m, l and scale of every group; rows has l, s and FEATURES."""
    nothing = F.lit(None).cast("string")
    level_of = lambda k, lang, source: F.struct(F.lit(k).alias("level"), lang.alias("l"), source.alias("s"))
    levels = F.array(level_of(0, nothing, nothing), level_of(1, F.col("l"), nothing), level_of(2, F.col("l"), F.col("s")))
    best = stage(covariances(mcd(rows.select(F.explode(levels).alias("grp"), *FEATURES), keep, steps)), "quality-estimates")
    values = [c for c in best.columns if c not in ("grp", "rows")]
    parent = lambda df, keys: df.select(*keys, *(F.col(c).alias(f"p_{c}") for c in values))
    level = lambda k, keys: best.where(F.col("grp.level") == k).select(*(F.col(f"grp.{c}").alias(c) for c in keys), "rows", *values)
    langs = shrunk(level(1, ["l"]).withColumn("one", F.lit(1)), parent(level(0, []).withColumn("one", F.lit(1)), ["one"]), prior).drop("one")
    return factors(shrunk(level(2, ["l", "s"]), parent(langs, ["l"]), prior)).drop("rows")


def quality_rules(docs: DataFrame, keep: float = KEEP, cutoff: float = CUTOFF, steps: int = STEPS, prior: int = PRIOR_ROWS) -> DataFrame:
    """doc_id, lang, source, the statistics, base_failed, d2 and kept of every row.

    base_failed: fewer than 50 words, or more than half of the words repeated. Others are kept unless their distance
    exceeds `cutoff`, scaled so that the `keep` share of the group lies within its chi-square quantile. Every group has
    an estimate of its own, however few its rows; its parents' count as `prior` rows beside them. Null texts have no
    words; null languages and sources are groups; repeated rows count each; empty tables give no rows; other columns of
    docs are ignored.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    own = features(text_stats(docs.select("doc_id", "text", "lang", "source"))).drop("text")
    # Null and "" are two groups.
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    own = stage(own.withColumns({"base_failed": failed, "l": name("lang"), "s": name("source")}), "quality-stats")
    limits = stage(group_limits(own.where("not base_failed").select("l", "s", *FEATURES), keep, steps, prior), "quality-limits")
    scored = distance(own.join(limits, ["l", "s"], "left"))
    verdict = ~F.col("base_failed") & (F.col("d2").isNull() | (F.col("d2") * KEEP_CHI2 <= F.col("scale") * cutoff))
    return scored.withColumn("kept", verdict).drop("l", "s")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("d2", 3).alias("d2"))
