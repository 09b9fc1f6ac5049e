"""Secret scans: candidate strings of a text, and a random forest that removes false positives among them.

Candidates are runs of 16 or more key characters with a digit, and any value that is assigned to a credential's name,
however short and with or without a digit. Features: length, shares of digits, letters and
signs, changes of character class and the share of vowels (character transitions), the share of letters in
runs that are corpus words (dictionary coverage), whether the candidate lies in a path, and the neighbouring words.
The forest is trained on labelled findings; where no table of them is given, a bounded sample of candidates is labelled
by whether a credential's name is assigned to them, with placeholders labelled as false. No feature reads what that rule
reads: the left neighbour is the word before the credential's name and its sign, so the forest has to tell secrets by
their form and surroundings, and finds them where no name stands before them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, stage, table, words_of

#: The candidates' patterns, and the names and placeholders that label a finding. A value may follow its
#: name's '=' at once; '=' belongs to a candidate only as padding at its end.
CANDIDATE = r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{16,}(?:={1,2}(?![A-Za-z0-9+/_=\-]))?"
NAME = r"(?:token|secret|password|passwd|pwd|api[_\- ]?key|access[_\- ]?key|auth|bearer|credential)s?"
#: A credential's name and its sign, up to the value; and the same with the value, a quoted one up to its closing quote.
ASSIGNS = rf"(?i:{NAME}[\"']?\s*(?:=>|:=|[=:])\s*(?:bearer\s+)?|bearer\s+)"
ASSIGNED = ASSIGNS + r"(?:\"[^\"\n]+(?=\")|'[^'\n]+(?=')|[^\s\"'&;,<>]*[^\s\"'&;,<>.:!?)\]}])"
CREDENTIAL = rf"(?i){NAME}[\"']?\s*(?:=>|:=|[=:])?\s*[\"']?$"
#: All that the rule may read before a value: a name of key characters and signs up to it.
LEAD_IN = r"[\"']?[A-Za-z0-9_\-]*[\"']?\s*(?:=>|:=|[=:])\s*(?i:bearer\s+)?[\"']?$|(?i:" + NAME + r")[\"']?\s*[\"']?$|[\"']$"
PLACEHOLDER = r"(?i)example|x{6,}|0{8,}|1234567|changeme|placeholder"
CONTEXT, TRAIN_ROWS, DICTIONARY_WORDS, TREES, DEPTH, SEED, WORD_BUCKETS = 48, 20_000, 5_000, 20, 6, 7, 8
THRESHOLD = 0.5
NUMERIC = ("f_length", "f_digits", "f_lower", "f_upper", "f_signs", "f_hex", "f_runs", "f_distinct", "f_vowels", "f_known", "f_path", *(f"f_word{i}" for i in range(WORD_BUCKETS)), *(f"f_next{i}" for i in range(WORD_BUCKETS)))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, at (0-based character), found, before and after (up to CONTEXT characters) of every candidate.

    A value assigned to a name is left out where a run of key characters holds all of it.
    """

    def places(pattern: str, found: Column) -> Column:
        return let(F.split("text", pattern, -1), lambda between: F.transform(found, lambda x, i: F.struct(
            (F.aggregate(F.slice(between, 1, i + 1), F.lit(0), lambda a, s: a + F.length(s)) + F.aggregate(F.slice(found, 1, i), F.lit(0), lambda a, s: a + F.length(s))).cast("long").alias("at"),
            x.alias("found"), F.right(between[i], F.lit(CONTEXT)).alias("before"), F.left(between[i + 1], F.lit(CONTEXT)).alias("after"),
        )))

    def value(c: Column) -> Column:
        return let(F.regexp_replace(c["found"], rf"^{ASSIGNS}[\"']?", ""), lambda v: F.struct(
            (c["at"] + F.length(c["found"]) - F.length(v)).alias("at"), v.alias("found"),
            F.right(F.concat(c["before"], F.left(c["found"], F.length(c["found"]) - F.length(v))), F.lit(CONTEXT)).alias("before"), c["after"].alias("after"),
        ))

    end = lambda c: c["at"] + F.length(c["found"])
    both = lambda runs, named: F.concat(runs, F.filter(F.transform(named, value), lambda v: (F.length(v["found"]) > 0) & ~F.exists(runs, lambda r: (r["at"] <= v["at"]) & (end(r) >= end(v)))))
    found = {"runs": F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)), "named": F.regexp_extract_all("text", F.lit(ASSIGNED), F.lit(0))}
    with_any = docs.where("text is not null").select("doc_id", "text", *(c.alias(n) for n, c in found.items())).where((F.size("runs") > 0) | (F.size("named") > 0))
    placed = F.struct(let(F.col("runs"), lambda x: places(CANDIDATE, x)).alias("runs"), let(F.col("named"), lambda x: places(ASSIGNED, x)).alias("named"))
    return with_any.select("doc_id", F.explode(let(placed, lambda p: both(p["runs"], p["named"]))).alias("c")).select("doc_id", "c.*")


def dictionary(docs: DataFrame, most: int = DICTIONARY_WORDS) -> DataFrame:
    """The corpus's `most` most frequent words of three or more letters a-z, counted over all texts."""
    words = docs.select(F.explode(words_of(F.lower("text"))).alias("w")).where(F.col("w").rlike("^[a-z]{3,}$"))
    return words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(most).select("w")


def features(found: DataFrame, known: DataFrame) -> DataFrame:
    """found (candidates) with NUMERIC columns; known: column w, the dictionary (of bounded size)."""
    x, n = F.col("found"), F.length("found")
    share = lambda pattern: F.length(F.regexp_replace(x, pattern, "")) / n
    classes = reduce(lambda c, p: F.regexp_replace(c, *p), [(r"[0-9]", "9"), (r"[a-z]", "a"), (r"[A-Z]", "B"), (r"[^9aB]", "-")], x)
    letters = F.regexp_replace(F.lower("found"), "[^a-z]", "")
    vowels = F.length(F.regexp_replace(F.lower("found"), "[^aeiou]", ""))
    left = F.lower(F.regexp_extract(F.regexp_replace("before", LEAD_IN, ""), r"([A-Za-z]+)[^A-Za-z]*$", 1))
    right = F.lower(F.regexp_extract("after", r"^[^A-Za-z]*([A-Za-z]+)", 1))
    bucket = lambda w, i: ((w != "") & (F.pmod(F.xxhash64(w), F.lit(WORD_BUCKETS)) == i)).cast("double")
    one = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    plain = found.withColumns({
        "f_length": n.cast("double"), "f_digits": share("[^0-9]"), "f_lower": share("[^a-z]"), "f_upper": share("[^A-Z]"), "f_signs": share("[A-Za-z0-9]"),
        "f_hex": one(x.rlike("^[0-9a-fA-F]+$")), "f_runs": F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) / n,
        "f_distinct": F.size(F.array_distinct(F.split(x, ""))) / n, "f_vowels": vowels / F.greatest(F.length(letters), F.lit(1)),
        "f_path": one(F.col("before").rlike(r"(://|www\.|/)\S*$") | x.rlike("/.*/")),
        **{f"f_word{i}": bucket(left, i) for i in range(WORD_BUCKETS)}, **{f"f_next{i}": bucket(right, i) for i in range(WORD_BUCKETS)},
    })
    # Coverage depends on the candidate's characters alone, so it is taken once for each distinct one.
    runs = found.select("found").distinct().select("found", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("found"), F.lit("[a-z]{3,}"), F.lit(0)))).alias("w"))
    covered = runs.join(F.broadcast(known), "w").groupBy(F.col("found").alias("_found")).agg(F.sum(F.length("w")).alias("_covered"))
    covered = stage(covered, "secret-coverage")
    joined = plain.join(covered, F.col("found") == F.col("_found"), "left")
    return joined.withColumn("f_known", F.least(F.lit(1.0), F.coalesce(F.col("_covered"), F.lit(0)) / F.greatest(F.length(letters), F.lit(1)))).drop("_found", "_covered")


def rule_label(found: DataFrame) -> DataFrame:
    """Labelled findings by rule: 1 for a value assigned to a credential's name, 0 otherwise and for placeholders."""
    return found.withColumn("label", (F.col("before").rlike(CREDENTIAL) & ~F.col("found").rlike(PLACEHOLDER)).cast("double"))


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, at, found, score and is_secret of every candidate of every text.

    labelled: findings with doc_id, at and label (0 or 1); by default the rule's labels. The training rows are those
    whose hash is lowest, train_rows at most. If they have one label only, every score is that label; without any
    candidate there are no rows. Null texts have no candidates; repeated rows are scanned each; other columns of docs
    are ignored.
    """
    docs = docs.select("doc_id", "text")
    known = stage(dictionary(docs), "secret-words")
    scored = stage(features(stage(candidates(docs), "secret-found"), known), "secret-candidates")
    if labelled is None:
        findings = rule_label(scored)
    else:
        findings = scored.join(labelled.select("doc_id", "at", F.col("label").cast("double").alias("label")), ["doc_id", "at"])
    sample = stage(findings.select("label", *NUMERIC, F.xxhash64("doc_id", "at").alias("h")).orderBy("h").limit(train_rows), "secret-sample")
    seen = sample.groupBy("label").count().where("label is not null").collect()  # two rows at most
    if len(seen) < 2:
        score = F.lit(float(seen[0].label) if seen else 0.0)
        return scored.select("doc_id", "at", "found", score.alias("score"), (score >= threshold).alias("is_secret"))
    vectors = VectorAssembler(inputCols=list(NUMERIC), outputCol="features")
    ordered = vectors.transform(sample.where("label is not null").repartition(1).sortWithinPartitions("h"))  # train_rows rows
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(ordered)
    out = forest.transform(vectors.transform(scored)).withColumn("score", F.round(vector_to_array("probability")[1], 6))
    return out.select("doc_id", "at", "found", "score", (F.col("score") >= threshold).alias("is_secret"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "at", F.length("found").cast("long").alias("length"), F.sha2("found", 256).alias("found_sha256"), "score", "is_secret")
