"""SimHash near-dedup with pivot distance tables.

A text's fingerprint is the majority of the bits of its word shingles' XXH64. Hamming distances to pivots are kept for
each distinct fingerprint: to a base pivot, and to pivots that differ from it in one block of two bits each. The
difference of two such distances tells how many bits of that block differ from the base, so a bit in which two
fingerprints differ moves the distances to one block's pivot alone. With blocks dealt to five groups, fingerprints
within two bits agree in the distances of three whole groups: the candidates are equal keys in one of ten tables.
Candidates whose largest coordinate difference exceeds the radius are discarded; survivors are verified bit by bit.
Tables' keys that very many fingerprints share are not paired: their fingerprints meet in the points one bit away
from them (two fingerprints are within two bits exactly if they share one), at most 65 fingerprints a point.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, stage, table
from .components import components

BITS, BLOCK, GROUPS, RADIUS = 64, 2, 5, 2
#: XXH64 of "pivot" with seed 42, as a signed long: an arbitrary base.
BASE = int(np.uint64(xxhash.xxh64_intdigest(b"pivot", 42)).astype(np.int64))
#: Fingerprints of one table key that are paired; beyond it they meet in points.
MOST_PAIRED = 48


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The signed 64-bit SimHash of a UTF-8 text; 0 without a word."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    return majority(np.array(hashes, dtype=np.uint64))


def majority(h: np.ndarray) -> int:
    """The signed long whose bits are those that more than half of the hashes have."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):
        counts += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp of every row; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py() or b"", shingle) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def pivots() -> list[int]:
    """The base pivot and, for each block, the base with that block's bits flipped; signed longs."""
    flipped = [np.int64(BASE) ^ np.uint64(((1 << BLOCK) - 1) << i).astype(np.int64) for i in range(0, BITS, BLOCK)]
    return [BASE, *(int(x) for x in flipped)]


def coordinates(fp: Column) -> Column:
    """The row of the pivot distance table."""
    return F.array(*(F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("byte") for p in pivots()))


def table_keys(fps: DataFrame) -> DataFrame:
    """fp and key for each table: the distances of three groups of blocks, as one number beside the table's."""
    blocks = [F.shiftright(F.get("at", F.lit(0)).cast("int") - F.get("at", F.lit(i + 1)).cast("int") + BLOCK, 1) for i in range(BITS // BLOCK)]
    parts = {f"part{g}": sum((b.cast("long") * (BLOCK + 1) ** i for i, b in enumerate(blocks[g::GROUPS])), F.lit(0).cast("long")) for g in range(GROUPS)}
    size = (BLOCK + 1) ** (-(-len(blocks) // GROUPS))
    keys = []
    for t, chosen in enumerate(combinations(range(GROUPS), GROUPS - RADIUS)):
        key = F.lit(t).cast("long")
        for g in chosen:
            key = key * size + F.col(f"part{g}")
        keys.append(key)
    return fps.select("fp", coordinates(F.col("fp")).alias("at")).withColumns(parts).select("fp", F.explode(F.array(*keys)).alias("key"))


def near_links(fps: DataFrame, most_paired: int = MOST_PAIRED) -> DataFrame:
    """Links a < b that join all distinct fingerprints (column fp) within two bits: every such pair of a table key
    that is paired, and pairs with the least fingerprint of each shared point for the others."""
    keyed = stage(table_keys(fps.select("fp")), "simhash-keys")
    shared = stage(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-shared")
    members = keyed.join(shared, "key")
    boxed = (
        members.where(F.col("n") <= most_paired).select("key", F.struct("fp", coordinates(F.col("fp")).alias("at")).alias("x"))
        .groupBy("key").agg(F.collect_list("x").alias("xs"))
    )
    far = lambda x, y: F.exists(F.zip_with(x["at"], y["at"], lambda p, q: F.abs(p.cast("int") - q.cast("int"))), lambda v: v > RADIUS)
    close = lambda x, y: ~far(x, y) & (F.bit_count(x["fp"].bitwiseXOR(y["fp"])) <= RADIUS)
    paired = boxed.select(F.explode("xs").alias("x"), "xs").select("x.fp", F.explode(F.filter("xs", lambda y: (y["fp"] > F.col("x")["fp"]) & close(F.col("x"), y))).alias("y"))
    pairs = paired.select(F.col("fp").alias("a"), F.col("y")["fp"].alias("b"))
    crowd = members.where(F.col("n") > most_paired).select("fp").distinct()
    points = crowd.select("fp", F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(int(np.uint64(1 << i).astype(np.int64)))) for i in range(BITS)))).alias("point"))
    met = points.groupBy("point").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # at most 65 of them
    stars = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable over links of two bits or fewer) of every row.

    Null texts are empty (fingerprint 0, linked like others); repeated rows keep a row each; a component of null ids
    alone has a null component_id; other columns are ignored; an empty table gives no rows. Equal fingerprints are one
    node, so copies are never expanded into pairs.
    """
    bounded_batches(docs.sparkSession)
    rows = stage(fingerprints(docs, shingle), "simhash-rows")
    nodes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    labels = components(near_links(nodes.select("fp")))
    named = nodes.join(labels, F.col("fp") == F.col("node"), "left").withColumn("label", F.coalesce("label", "fp"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = stage(named.select("fp", "label").join(least, "label").select("fp", "component_id"), "simhash-named")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
