"""Spelling variants by Bloom-guided neighbourhoods.

Two words are near if one inserted, deleted or replaced character makes one of the other. Every near pair is met from one
side only: from the longer word by a deletion, or from the word with the lesser character by a replacement. The
generated edits of a word probe blocked Bloom filters of all words (512-bit blocks, one bit in each of eight lanes);
each length of words has a stretch of blocks of its own. Only edits that a filter lets through are shuffled, to an
equi-join with the words that removes the false ones.

Blocks are numbered over all lengths and broadcast in rounds of FILTER_BYTES at most, so that the broadcast doesn't grow
with the vocabulary: a larger one takes more rounds, in each of which an edit is probed only if its block is there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

#: A word's form is its most frequent near word, if that is so many times as frequent.
RATIO = 10
BLOCK_BYTES, LANES, BITS_A_WORD, FILTER_BYTES = 64, 8, 16, 16 << 20
#: Words of this many characters or more share one stretch of blocks, so that the number of stretches is bounded.
LONG = 64
#: Edits that are probed at a time.
PROBES = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of 64-bit numbers (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def at_place(place: np.ndarray, code: np.ndarray) -> np.ndarray:
    """What a character adds to a word's hash at a place; hashes are sums, so that an edit changes few terms."""
    return mixed((place.astype(np.uint64) << np.uint64(21)) + code.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places in words of those of equal length, and their characters' codes, a row a word."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(length):
        own = np.flatnonzero(length == n)
        yield own, np.frombuffer("".join([words[i] for i in own.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(own), n)


class Stretches:
    """Where each length's blocks are among all blocks."""

    def __init__(self, words_by_length: dict[int, int]):
        self.size = np.zeros(LONG + 1, np.int64)
        for length, n in words_by_length.items():
            self.size[min(length, LONG)] += n
        self.size = -(-self.size * BITS_A_WORD // (8 * BLOCK_BYTES))
        self.first = np.cumsum(self.size) - self.size
        self.blocks = int(self.size.sum())

    def meets(self, length: int, low: int, high: int) -> bool:
        """Whether blocks of a length are among low .. high - 1."""
        k = min(length, LONG)
        return bool(self.size[k]) and self.first[k] < high and self.first[k] + self.size[k] > low

    def block(self, length: int, hashes: np.ndarray) -> np.ndarray:
        k = min(length, LONG)
        return self.first[k] + ((hashes >> np.uint64(32)) % np.uint64(self.size[k])).astype(np.int64)


def lane_bit(hashes: np.ndarray, lane: int) -> np.ndarray:
    return mixed(hashes + np.uint64(lane // 8 + 1)) >> np.uint64(6 * (lane % 8)) & np.uint64(63)


def filters(words: DataFrame, stretches: Stretches) -> DataFrame:
    """block and its eight lanes, of every block with a word."""
    names = ["block", *(f"lane{k}" for k in range(LANES))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, codes in by_length(b.column("word").to_pylist()):
                n = codes.shape[1]
                h = at_place(np.arange(n)[None, :], codes).sum(axis=1, dtype=np.uint64)
                masks = [(np.uint64(1) << lane_bit(h, k)).view(np.int64) for k in range(LANES)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (stretches.block(n, h), *masks)], names)

    bits = words.select("word").mapInArrow(run, ", ".join(f"{c} long" for c in names))
    return bits.groupBy("block").agg(*(F.bit_or(c).alias(c) for c in names[1:]))


class Round:
    """The filter blocks low .. high - 1, as rows of eight lanes."""

    def __init__(self, stretches: Stretches, low: int, high: int, lanes: np.ndarray):
        self.stretches, self.low, self.high, self.lanes = stretches, low, high, lanes

    def passes(self, length: int, hashes: np.ndarray) -> np.ndarray:
        """The places of the hashes of words of a length that may be in this round's blocks."""
        block = self.stretches.block(length, hashes) - self.low
        left = np.flatnonzero((block >= 0) & (block < self.high - self.low))
        for k in range(LANES):  # most fall out at the first lanes
            left = left[(self.lanes[block[left], k] >> lane_bit(hashes[left], k)) & np.uint64(1) == 1]
        return left

    def edits(self, codes: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Row, place and character (0: none) of the edits of words of one length that pass, some at a time."""
        n = codes.shape[1]
        if not n:
            return
        shorter, equal = (self.stretches.meets(k, self.low, self.high) for k in (n - 1, n))
        if not shorter and not equal:
            return
        for top in range(0, len(codes), rows := max(1, PROBES // n)):
            some = codes[top : top + rows]
            here = at_place(np.arange(n)[None, :], some)
            if shorter:
                moved = at_place(np.arange(n)[None, :] - 1, some)  # of the first place: not used
                after = moved.sum(axis=1, dtype=np.uint64)[:, None] - np.cumsum(moved, axis=1, dtype=np.uint64)
                hashes = np.cumsum(here, axis=1, dtype=np.uint64) - here + after
                new = np.ones(some.shape, bool)  # of equal neighbours, the first goes
                new[:, 1:] = some[:, 1:] != some[:, :-1]
                row, place = np.nonzero(new)
                left = self.passes(n - 1, hashes[row, place])
                yield row[left] + top, place[left], np.zeros(len(left), np.int64)
            if equal:
                yield from self.replaced(some, here, alphabet, top)

    def replaced(self, codes: np.ndarray, here: np.ndarray, alphabet: np.ndarray, top: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        whole, n = here.sum(axis=1, dtype=np.uint64), codes.shape[1]
        width = max(1, min(n, PROBES // len(alphabet)))
        height = max(1, PROBES // (len(alphabet) * width))
        for at in range(0, n, width):
            added = at_place(np.arange(at, min(n, at + width))[:, None], alphabet[None, :])
            for down in range(0, len(codes), height):
                own, old = codes[down : down + height, at : at + width], here[down : down + height, at : at + width]
                row, place, char = np.nonzero(own[:, :, None] < alphabet[None, None, :])
                left = self.passes(n, whole[down + row] - old[row, place] + added[place, char])
                yield row[left] + down + top, place[left] + at, alphabet[char[left]].astype(np.int64)


def candidates(words: DataFrame, shared: Broadcast, alphabet: np.ndarray) -> DataFrame:
    """word, n and edit of all edits that pass a round's filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = shared.value
        for b in batches:
            words_, n = b.column("word").to_pylist(), b.column("n")
            for own, codes in by_length(words_):
                for row, place, char in probe.edits(codes, alphabet):
                    which = own[row]
                    edits = [words_[i][:p] + (chr(c) if c else "") + words_[i][p + 1 :] for i, p, c in zip(which.tolist(), place.tolist(), char.tolist(), strict=True)]
                    if edits:
                        at = pa.array(which)
                        yield pa.RecordBatch.from_arrays([b.column("word").take(at), n.take(at), pa.array(edits, pa.string())], ["word", "n", "edit"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, edit string")


def near_pairs(words: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """a, n_a, b, n_b: every pair of near words once; words: distinct word and n.

    Characters that a replacement tries are those of the words, whose number the caller's class of characters bounds.
    """
    spark = words.sparkSession
    shape = words.groupBy(F.least(F.length("word"), F.lit(LONG)).alias("length")).agg(F.count("*").alias("n")).collect()  # LONG + 1 rows at most
    chars = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().collect()
    alphabet = np.array(sorted(ord(r.c) for r in chars), np.uint32)
    schema = "word string, n long, edit string"
    if not len(alphabet):
        return spark.createDataFrame([], "a string, n_a long, b string, n_b long")
    stretches = Stretches({r.length: r.n for r in shape})
    bits = stage(filters(words, stretches), "variant-filters")
    rounds, found = max(1, filter_bytes // BLOCK_BYTES), spark.createDataFrame([], schema)
    for low in range(0, stretches.blocks, rounds):
        high = min(stretches.blocks, low + rounds)
        part = bits.where(f"block >= {low} and block < {high}").toArrow()  # filter_bytes at most
        lanes = np.zeros((high - low, LANES), np.uint64)
        lanes[part.column("block").to_numpy() - low] = np.column_stack([part.column(f"lane{k}").to_numpy() for k in range(LANES)]).view(np.uint64)
        shared = spark.sparkContext.broadcast(Round(stretches, low, high, lanes))
        found = found.unionByName(stage(candidates(words, shared, alphabet), "variant-edits"))
        shared.unpersist()
    known = words.select(F.col("word").alias("edit"), F.col("n").alias("n_b"))
    return found.join(known, "edit").select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("edit").alias("b"), "n_b")


def spelling_groups(words: DataFrame, ratio: int = RATIO, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word; words: distinct word (not null) and n.

    The form is the near word with the greatest n (of equal ones the least in code-point order) if that n is at least
    ratio times the word's; root follows forms to the last. Words without near words have n_near 0, no form and
    themselves as root; no words give no rows; other columns are ignored.
    """
    words = words.select("word", F.col("n").cast("long").alias("n"))
    pairs = stage(near_pairs(words, filter_bytes), "variant-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    has = -F.col("best.m") >= F.col("n") * ratio
    formed = stage(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.m")).alias("form_n")), "variant-forms")
    # Each form is ratio times as frequent as the word, so that chains are short; every round doubles what a step spans.
    most = formed.agg(F.max("n")).first()[0] or 1
    steps = formed.where("form is not null").select("word", F.col("form").alias("root"))
    span, reach = 1, 1
    while most >= ratio ** (span + 1) and ratio > 1:
        span += 1
    while reach < span:
        steps = stage(steps, "variant-roots")
        after = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        steps, reach = steps.join(after, "root", "left").select("word", F.coalesce("further", "root").alias("root")), 2 * reach
    return formed.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of these characters are words; the class is of fixed size, and so is the alphabet of edits.
LETTERS = "A-Za-zÀ-ÿ"


def typo(doc_id: Column, run: Column, every: int) -> Column:
    """The run, without one character where the CRC-32 of `<doc_id>:<run>` is a multiple of every; a null id is empty."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, least_length: int = 7, least_count: int = 2, every: int = 31) -> DataFrame:
    """word and n of all documents' runs of letters, with A-Z in lower case and planted typos, of least_length characters
    or more and least_count occurrences or more. Null and empty texts have none; repeated rows count each; other columns
    are ignored; an empty table gives no rows."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))).alias("run"))
    words = runs.select(typo(F.col("doc_id"), F.translate("run", UPPER, LOWER), every).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(f"n >= {least_count}")


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(stage(vocabulary(table(spark, sf_dir, "documents")), "variant-words"))


#: CRC-32 has no function there: its table of 256 numbers is computed bit by bit, and a text's bytes are folded over it.
#: All letters are below U+0100, so one of 128 or more has two bytes in UTF-8.
OP12_SQL = """
WITH RECURSIVE bits AS (
  SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8
),
crc_table AS (SELECT list(c ORDER BY i) AS crcs FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')) AS r FROM documents) GROUP BY ALL
),
coded AS (
  SELECT doc_id, run, k, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + unicode(x)::BIGINT // 64, 128 + unicode(x)::BIGINT % 64] END)) AS bytes
  FROM runs
),
hashed AS (
  SELECT doc_id, run, k, xor(4294967295, list_reduce(bytes, lambda h, b: xor(h // 256, crcs[1 + xor(h % 256, b)]), 4294967295)) AS h FROM coded, crc_table
),
typed AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM hashed
),
words AS (SELECT word, sum(k)::BIGINT AS n FROM typed WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cut AS (
  SELECT DISTINCT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS short FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM words)
),
pairs AS (
  SELECT a.word AS word, b.word AS near, b.n AS m FROM cut a JOIN cut b ON a.short = b.short AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.short = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.short = b.word
),
best AS (SELECT word, count(*) AS n_near, min({'m': -m, 'near': near}) AS best FROM pairs GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN -b.best.m >= 10 * w.n THEN b.best.near END AS form,
    CASE WHEN -b.best.m >= 10 * w.n THEN -b.best.m END AS form_n
  FROM words w LEFT JOIN best b USING (word)
),
chain AS (
  SELECT word, coalesce(form, word) AS last, 0 AS k FROM formed
  UNION ALL
  SELECT c.word, f.form, c.k + 1 FROM chain c JOIN formed f ON f.word = c.last WHERE f.form IS NOT NULL
),
roots AS (SELECT word, max_by(last, k) AS root FROM chain GROUP BY word)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM formed f JOIN roots r USING (word)
"""
