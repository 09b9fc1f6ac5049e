"""Document fingerprints by consistent weighted sampling.

A text's terms are its five-word shingles, weighted by their count. For each of SAMPLES samples a term draws, from
hashes of itself and the sample's number, r and c of Gamma(2, 1) and b of U(0, 1); with t = floor(ln w / r + b) its
rank is ln c - r (t - b + 1), and the term of least rank is the sample (term and t). Two texts share a sample with
the probability of their generalised Jaccard similarity, sum of least over sum of greatest weights. A signature holds
16 bits of each sample. Gamma quantiles come from tables that are computed here from the distribution
function, finer and finer towards the lower tail of c, which decides.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, stage, table, words_of

SAMPLES, SHINGLE = 40, 5
#: Rows of a bucket of neighbouring ids, on average, and the most bounds between buckets.
BUCKET_ROWS, MOST_BOUNDS = 512, 1 << 15
#: Bits of a text's hash by which rows with one id are dealt to buckets.
HASH_BITS = 20


def gamma_quantiles(p: np.ndarray) -> np.ndarray:
    """Quantiles of Gamma(2, 1), by bisection on its distribution function 1 - (1 + x) exp(-x)."""
    low, high = np.zeros(len(p)), np.full(len(p), 50.0)
    for _ in range(80):
        x = (low + high) / 2
        below = -np.expm1(-x) - x * np.exp(-x) < p
        low, high = np.where(below, x, low), np.where(below, high, x)
    return x


def draw_tables() -> tuple[Column, Column]:
    """r by 8 uniform bits; -ln c by the run of zero bits (to 23) and 3 more bits that say where in (2^-k-1, 2^-k] p is."""
    r = gamma_quantiles((np.arange(256) + 0.5) / 256)
    p = np.array([2.0 ** -(k + 1) * (1 + (m + 0.5) / 8) for k in range(24) for m in range(8)])
    column = lambda xs: F.expr("array(" + ",".join(f"{x:.7g}D" for x in xs) + ")")
    return column(r), column(-np.log(gamma_quantiles(p)))


def ranked(h: Column, log_weight: Column, j: int, tables: tuple[Column, Column]) -> Column:
    """A long whose order is that of the term's rank in sample j, greatest for the least, with the sample's 16 bits.

    Bits of the term's hash for j: 0-7 r, 8-30 and 31-33 c, 34-53 b, 54-63 and 0-5 the sample's name.
    """
    salt = (j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)  # multiples of the golden ratio's 64 bits
    x = F.xxhash64(h.bitwiseXOR(F.lit(salt - (1 << 64) if salt >> 63 else salt)))
    r = tables[0][x.bitwiseAND(F.lit(255)).cast("int")]
    zeros = F.shiftright(x, 8).bitwiseOR(F.lit(1 << 23))
    zeros = F.bit_count(zeros.bitwiseAND(-zeros) - 1)
    minus_log_c = tables[1][zeros * 8 + F.shiftright(x, 31).bitwiseAND(F.lit(7)).cast("int")]
    b = F.shiftright(x, 34).bitwiseAND(F.lit((1 << 20) - 1)) * F.lit(2.0**-20)
    t = F.floor(log_weight / r + b)
    score = r * (t - b + 1) + minus_log_c
    name = F.shiftrightunsigned(x, 54).bitwiseXOR(F.shiftleft(x, 10)).bitwiseXOR(t)
    return F.shiftleft((score * F.lit(float(1 << 32))).cast("long"), 16) + name.bitwiseAND(F.lit(65535))


def weighted_terms(text: Column, shingle: int = SHINGLE) -> Column:
    """All distinct terms of a text: struct(h, lw) of a shingle's hash and the logarithm of its count.

    A text of fewer words has them all as one term; one without words has none.
    """
    term = lambda h, w: F.struct(h.alias("h"), F.log(w.cast("double")).alias("lw"))

    def hashes(w: Column) -> Column:
        many = F.transform(F.slice(w, 1, F.size(w) - shingle + 1), lambda x, i: F.xxhash64(x, *(w[i + k] for k in range(1, shingle))))
        return F.when(F.size(w) >= shingle, many).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<long>"))

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: ~F.get(s, k).eqNullSafe(F.get(s, k - 1)))
        return let(starts, lambda at: F.transform(at, lambda p, k: term(F.get(s, p), F.coalesce(F.get(at, k + 1), F.size(s)) - p)))

    def counted(h: Column) -> Column:
        once = F.transform(h, lambda x: F.struct(x.alias("h"), F.lit(0.0).alias("lw")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), once).otherwise(let(F.sort_array(h), runs))

    return let(let(words_of(text), hashes), counted)


def signatures(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys and `signature` (array of ints) for each group of keys, from column `text`; all 0 without a term.

    Terms go to their group within a task if texts are partitioned by one of the keys.
    """
    terms = texts.select(*keys, F.explode_outer(weighted_terms(F.col("text"))).alias("t")).select(*keys, "t.h", "t.lw")
    tables = draw_tables()
    best = terms.groupBy(*keys).agg(*(F.max(ranked(F.col("h"), F.col("lw"), j, tables)).alias(f"m{j}") for j in range(samples)))
    return best.select(*keys, F.array(*(F.coalesce(F.col(f"m{j}").bitwiseAND(F.lit(65535)), F.lit(0)).cast("int") for j in range(samples))).alias("signature"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples: the estimate of the generalised Jaccard similarity."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a).cast("double")


def spelled(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 4, "0"))), "")


def bucket_of(docs: DataFrame, bucket_rows: int) -> Column:
    """The bucket of a row (columns doc_id, order): buckets ascend as ids descend, null ids are last.

    Bounds are quantiles of the ids, so buckets hold about equally many rows wherever the ids lie. An id that is a
    bound several times over, and null ids, have as many buckets of their own, by the hash of their texts. Quantiles are
    taken as doubles, so the bounds are 1024 ids apart at least near the ends of a long; order never depends on them.
    """
    n, nulls = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    wanted = min(MOST_BOUNDS, (n - nulls) // bucket_rows)
    cuts = docs.agg(F.percentile_approx("doc_id", [(i + 1) / (wanted + 1) for i in range(wanted)], 10 * max(1000, wanted))).first()[0] if wanted else []
    times = Counter(cuts)
    bounds = sorted(times)
    listed = lambda xs, kind: F.split(F.lit(" ".join(map(str, xs))), " ").cast(f"array<{kind}>")
    # By halving: the last bound that isn't above the id, -1 if all are.
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    at = F.aggregate(F.array(*map(F.lit, steps)), F.lit(-1), lambda a, s: F.when(F.get(listed(bounds, "bigint"), a + s) <= F.col("doc_id"), a + s).otherwise(a)) if bounds else F.lit(-1)
    part = lambda k: F.shiftright(F.shiftrightunsigned(F.col("order").bitwiseXOR(F.lit(-(2**63))), 64 - HASH_BITS) * k, HASH_BITS)

    def numbered(j: Column) -> Column:
        own = F.get(listed([times[b] for b in bounds], "bigint"), j)
        same = (F.get(listed(bounds, "bigint"), j) == F.col("doc_id")) & (own > 1)
        after = (F.lit(len(bounds)) - j).cast("long") * 2
        return F.when(same, F.shiftleft(after + 1, HASH_BITS) + part(own)).otherwise(F.shiftleft(after, HASH_BITS))

    null_parts = min(MOST_BOUNDS, nulls // bucket_rows + 1)
    with_id = let(at, numbered) if bounds else F.lit(0).cast("long")
    return F.when(F.col("doc_id").isNull(), F.lit((2 * len(bounds) + 4) << HASH_BITS) + part(F.lit(null_parts))).otherwise(with_id)


def neighbours(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """bucket, at, extra, doc_id, text, next: each row beside the next lower id's text (after the least: the greatest).

    Rows are cut into buckets of about bucket_rows; each bucket also gets, as a last row with extra = 1, the row that
    follows its last. Null ids come after all others, equal ids in the order of their texts' hashes.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("order", F.xxhash64("text"))
    bucket = bucket_of(docs, bucket_rows)
    # The first row of a bucket has the greatest id and, of equal ones, the least hash.
    firsts = own.select("doc_id", "order", bucket.alias("bucket")).groupBy("bucket").agg(F.max(F.struct("doc_id", F.bitwise_not("order").alias("late"))).alias("first"))
    order = Window.orderBy("bucket")  # 4 * MOST_BOUNDS rows at most
    followed = firsts.select("bucket", F.lead("first").over(order).alias("giver"), F.first("first").over(order).alias("top"))
    givers = stage(followed.select("bucket", F.coalesce("giver", "top").alias("giver")), "cws-givers")
    targets = givers.groupBy(F.col("giver.doc_id").alias("_id"), F.bitwise_not("giver.late").alias("_order")).agg(F.collect_list("bucket").alias("to"))  # one or two each
    own = own.withColumn("bucket", bucket).join(F.broadcast(targets), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("order") == F.col("_order")), "left")
    places = F.concat(F.array(F.struct("bucket", F.lit(0).alias("extra"))), F.coalesce(F.transform("to", lambda b: F.struct(b.alias("bucket"), F.lit(1).alias("extra"))), F.array().cast("array<struct<bucket:bigint,extra:int>>")))
    rows = own.select("doc_id", "order", "text", F.explode(places).alias("p")).select("p.bucket", "p.extra", "doc_id", "order", "text")
    within = Window.partitionBy("bucket").orderBy("extra", F.col("doc_id").desc_nulls_last(), "order")
    return rows.select("bucket", "extra", "doc_id", F.row_number().over(within).alias("at"), "text", F.lead("text").over(within).alias("next"))


def edited_pairs(docs: DataFrame, samples: int = SAMPLES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Fingerprints of each text and of its edited text: the last third replaced by the start of the next text.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for every row.
    Null texts are empty, whose fingerprints are all zeros; a single row is its own next; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.coalesce("next", F.lit("")), F.lit(1), cut))
    both = neighbours(docs, bucket_rows).select("bucket", "extra", "doc_id", "at", n.cast("long").alias("n_chars"), "text", F.when(F.col("extra") == 0, edited).alias("edited"))
    kind = lambda k, text, sha: F.struct(F.lit(k).alias("kind"), F.coalesce(text, F.lit("")).alias("text"), sha.cast("string").alias("sha"))
    own = kind(0, F.col("text"), F.lit(None))
    kinds = F.when(F.col("extra") == 1, F.array(own)).otherwise(F.array(own, kind(1, F.col("edited"), F.sha2("edited", 256))))
    texts = both.select("bucket", "extra", "doc_id", "at", "n_chars", F.explode(kinds).alias("k")).select("bucket", "extra", "doc_id", "at", "n_chars", "k.kind", "k.sha", "k.text")
    signed = signatures(texts, ["bucket", "extra", "doc_id", "at", "n_chars", "kind", "sha"], samples)
    row = Window.partitionBy("bucket").orderBy("at", "kind")
    after = signed.select("*", F.lead("sha", 1).over(row).alias("edited_sha256"), F.lead("signature", 1).over(row).alias("edited_signature"), F.lead("signature", 2).over(row).alias("next_signature"))
    return after.where("kind = 0 and extra = 0").select(
        "doc_id", "n_chars", "edited_sha256", spelled(F.col("signature")).alias("fingerprint"), spelled(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"), likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(table(spark, sf_dir, "documents"))
