"""Line dedup by content-defined chunks of lines, and by windows of lines across chunk edges.

A text's lines are hashed; a rolling hash over each window of WINDOW line hashes ends a chunk where it is 0 modulo
DIVISOR, so that boundaries move with the content. Chunk edges depend on the lines around a passage, so every text also
has windows whose boundaries depend on nothing but their own lines: from each line the shortest run down, and to each line
the shortest run up, with more than PASSAGE_WORDS words. Every line of a repeated passage of more words is in a window
inside the passage, and a window is only repeated if one other place has all of it.

Chunks of two lines or more and windows are grouped over all documents by a hash first; only those of hashes with several
places are then compared by their bytes. Of equal ones the first of the document with the least id stays, and the lines of
all others are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, stage, table, words_of

WINDOW, DIVISOR = 2, 2
#: Windows are the shortest runs of lines with more words than this.
PASSAGE_WORDS = 50
#: Steps that double as long as a window may have lines (each has a word).
STEPS = [1 << k for k in range(PASSAGE_WORDS.bit_length())]
CHUNK, PASSAGE = 0, 1
#: What words_of splits at.
SPACES = " \t\n\x0b\x0c\r"
#: Who holds a unit: documents with an id by their id, before those without one by their text's hash.
OWNER = ["no_id", "id"]


def hashes_of(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.xxhash64(x))


def chunks_of(hashes: Column) -> Column:
    """All chunks in order, from the lines' hashes: struct(start, end), the first and the last line."""

    def cut(h: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(h)), lambda i: (i == F.size(h)) | (F.pmod(F.xxhash64(*(F.get(h, i - 1 - k) for k in range(WINDOW))), F.lit(DIVISOR)) == 0))
        return let(ends, lambda ends: F.transform(ends, lambda e, k: F.struct(F.coalesce(F.get(ends, k - 1), F.lit(0)).alias("start"), (e - 1).alias("end"))))

    return let(hashes, cut)


def shortest(counts: Column) -> Column:
    """For each place of an array of word counts, how many places from there on have more than PASSAGE_WORDS words in all,
    at least; null if all that follow have too few. Sums of 1, 2, 4 .. places are added as long as they are too few."""
    def level(k: int, known: Column) -> Column:
        if k == len(STEPS):
            start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("words"))
            return F.transform(known["s1"], lambda x, i: F.when(x > PASSAGE_WORDS, F.lit(1)).otherwise(descend(known, i, len(STEPS) - 1, start)))
        half = STEPS[k] // 2
        longer = F.transform(known[f"s{half}"], lambda x, i: x + F.coalesce(F.get(known[f"s{half}"], i + half), F.lit(0)))
        return let(F.struct(*(known[f"s{s}"].alias(f"s{s}") for s in STEPS[:k]), longer.alias(f"s{STEPS[k]}")), lambda more: level(k + 1, more))

    def descend(known: Column, i: Column, k: int, state: Column) -> Column:
        if k < 0:
            return F.when(i + state["n"] < F.size(known["s1"]), state["n"] + 1)
        more = F.coalesce(F.get(known[f"s{STEPS[k]}"], i + state["n"]), F.lit(0))
        taken = F.when(state["words"] + more <= PASSAGE_WORDS, F.struct((state["n"] + STEPS[k]).alias("n"), (state["words"] + more).alias("words"))).otherwise(state)
        return let(taken, lambda now: descend(known, i, k - 1, now))

    return let(F.struct(counts.alias("s1")), lambda known: level(1, known))


def windows_of(lines: Column, hashes: Column) -> Column:
    """struct(start, end, hash) of the distinct windows of a text's lines; lines without a word don't count."""
    full = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.size(words_of(x)).alias("n"), F.get(hashes, i).alias("h"))), lambda x: x["n"] > 0)

    def spans(own: Column) -> Column:
        counts, last = F.transform(own, lambda x: x["n"]), F.size(own) - 1
        # Both ends in a number, as those are told apart by hashing, and null where there is no window.
        packed = lambda a, b: F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long"))
        down = F.transform(shortest(counts), lambda n, i: packed(i, i + n - 1))
        up = F.transform(shortest(F.reverse(counts)), lambda n, i: packed(last - i - n + 1, last - i))
        both = F.filter(F.array_distinct(F.concat(down, up)), lambda s: s.isNotNull())
        return F.transform(both, lambda s: window(own, F.shiftright(s, 32).cast("int"), s.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")))

    def window(own: Column, a: Column, b: Column) -> Column:
        return F.struct(F.get(own, a)["at"].alias("start"), F.get(own, b)["at"].alias("end"), F.xxhash64(F.transform(F.slice(own, a + 1, b - a + 1), lambda x: x["h"])).alias("hash"))

    return let(full, spans)


def body_of(lines: Column, kind: Column, start: Column, end: Column) -> Column:
    """A unit's bytes: all lines of a chunk, a window's lines with a word."""
    own = F.slice(lines, start + 1, end - start + 1)
    return F.array_join(F.when(kind == CHUNK, own).otherwise(F.filter(own, lambda x: F.btrim(x, F.lit(SPACES)) != "")), "\n")


def units_of(lines: Column) -> Column:
    """struct(kind, start, end, hash) of all chunks of several lines and all windows; the hash is that of the lines' hashes."""

    def of(h: Column) -> Column:
        chunks = F.transform(F.filter(chunks_of(h), lambda c: c["end"] > c["start"]), lambda c: F.struct(F.lit(CHUNK).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), F.xxhash64(F.slice(h, c["start"] + 1, c["end"] - c["start"] + 1)).alias("hash")))
        return F.concat(chunks, F.transform(windows_of(lines, h), lambda w: F.struct(F.lit(PASSAGE).alias("kind"), w["start"].alias("start"), w["end"].alias("end"), w["hash"].alias("hash"))))

    return let(hashes_of(lines), of)


def repeated_spans(texts: DataFrame) -> DataFrame:
    """OWNER, th and spans: which units of each text go, as struct(start, end); texts: OWNER, th (the text's hash), text.

    Of a text's own repeats the first occurrence stays whole, also where a later one overlaps it.
    """
    row = [*OWNER, "th"]
    places = stage(texts.select(*row, F.explode(units_of(F.split("text", "\n"))).alias("u")).select(*row, "u.*"), "line-places")
    # Counts of a text's own repeats and of rows that repeat are enough to suspect a hash; the bytes decide.
    twice = stage(places.groupBy("kind", "hash").agg(F.count("*").alias("n")).where("n > 1").select("kind", "hash"), "line-hashes")
    suspects = stage(places.join(twice, ["kind", "hash"]).groupBy(*row).agg(F.collect_set(F.struct("kind", "start", "end", "hash")).alias("units")), "line-suspects")
    bytes_of = lambda lines: F.transform("units", lambda u: F.struct(u["kind"].alias("kind"), u["start"].alias("start"), u["end"].alias("end"), u["hash"].alias("hash"), F.sha2(body_of(lines, u["kind"], u["start"], u["end"]), 256).alias("bytes")))
    bodies = texts.join(suspects.hint("merge"), row).select(*row, let(F.split("text", "\n"), bytes_of).alias("units"))
    told = stage(bodies.select(*row, F.explode("units").alias("u")).select(*row, "u.*").distinct(), "line-bodies")  # rows that repeat count once
    keepers = stage(told.groupBy("kind", "hash", "bytes").agg(F.count("*").alias("n"), F.min(F.struct(*OWNER)).alias("keeper")).where("n > 1").select("kind", "hash", "bytes", "keeper"), "line-keepers")
    met = told.join(keepers, ["kind", "hash", "bytes"]).withColumn("own", F.struct(*OWNER) == F.col("keeper"))
    each = met.groupBy(*row, "kind", "hash", "bytes").agg(F.first("own").alias("own"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("at"))
    first_end = F.get("at", F.lit(0))["end"]
    later = F.filter(F.transform(F.slice("at", 2, F.size("at")), lambda s: F.struct(F.greatest(s["start"], first_end + 1).alias("start"), s["end"].alias("end"))), lambda s: s["start"] <= s["end"])
    return stage(each.select(*row, F.explode(F.when(F.col("own"), later).otherwise(F.col("at"))).alias("s")).groupBy(*row).agg(F.collect_list("s").alias("spans")), "line-spans")


def dedupe_lines(docs: DataFrame) -> DataFrame:
    """The columns of docs with repeated chunks and passages cut out of text, plus n_lines, removed_lines and
    removed_chunks (chunks of which no line stays).

    Rows with null text pass as they are. What is left of a text keeps its lines' order and may be empty. Rows of one
    doc_id are one document, and equal texts of it keep the same lines; rows without an id are documents by their text,
    after all others. Lines are split at \\n alone. An empty table gives no rows; columns of docs that are named like a
    result are replaced.
    """
    docs = docs.drop("n_lines", "removed_lines", "removed_chunks")
    row = [*OWNER, "th"]
    hashed = F.xxhash64("text")
    owner = [F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), hashed).alias("id"), hashed.alias("th")]
    texts = docs.select(*owner, "text").where("text is not null")
    spans = repeated_spans(texts)
    # The row's columns are nested, so that no name of theirs meets one of these.
    given = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), *owner)
    joined = given.join(spans.hint("merge"), row, "left")  # the spans grow with the corpus
    lines = F.split("doc.text", "\n")
    none = F.lit(0).cast("long")

    def cut(lines: Column) -> Column:
        gone = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"])))
        return let(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda kept: F.struct(
            F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n").alias("text"), F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(kept)).cast("long").alias("removed_lines"), whole_chunks(lines, kept).alias("removed_chunks"),
        ))

    def whole_chunks(lines: Column, kept: Column) -> Column:
        """A chunk has a kept line if a kept line's chunk is it: the chunks' ends below each kept line are counted."""
        chunk_at = F.flatten(F.transform(chunks_of(hashes_of(lines)), lambda c, k: F.array_repeat(k, c["end"] - c["start"] + 1)))
        return let(chunk_at, lambda at: (F.element_at(at, -1) + 1 - F.size(F.array_distinct(F.transform(kept, lambda i: F.get(at, i))))).cast("long"))

    as_is = F.struct(F.col("doc.text").alias("text"), F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), none.alias("removed_lines"), none.alias("removed_chunks"))
    done = joined.withColumn("result", F.when(F.col("spans").isNull() | F.col("doc.text").isNull(), as_is).otherwise(let(lines, cut)))
    return done.select(*(F.col("result.text").alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns), "result.n_lines", "result.removed_lines", "result.removed_chunks")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "removed_lines", "removed_chunks")
