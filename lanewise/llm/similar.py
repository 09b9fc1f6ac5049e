"""Near-dedup by verified similarity: components over pairs of texts with a shingle Jaccard similarity of 0.8 or more.

SimHash with pivot distance tables proposes the first pairs: fingerprints of five-word shingles within two bits. It can't
find all: texts of similarity 0.8 differ in about 10 of 64 bits on average and many in more, and tables that guarantee
such a radius are keyed by a few bits only. What it leaves apart is proposed by prefixes, which lose no pair: in any
order of all shingles, two sets of similarity 0.8 share one of their first n - ceil(0.8 n) + 1. The order is by the count
in a bounded sample, then by hash, so that common passages come last. Of the sets that share a shingle, all are compared
with the least of them first; then only those that are still in different components are compared with one another.

Two filters that lose nothing come before the exact comparison: sets of similarity 0.8 have sizes within a factor of 0.8,
and differ in at most a ninth of their sizes' sum, hence in no more bits of bit maps of their hashes, which are about four
times as long as the sets are large, so that they tell texts of any length apart. Every remaining pair is verified by the exact similarity of its shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stage
from .components import components
from .simhash import majority, near_links

SHINGLE, SAMPLE_ROWS, COMMON = 5, 4_000, 50_000
#: Least bits of a map, and most bits of a brief one.
MAP_BITS, BRIEF_BITS = 512, 2048
#: Members of a group that one row holds, about, and the ratio of a band's sizes: above 1.25, that of sizes that fit.
CELL, BAND = 1024, 1.3
#: The least similarity, as a fraction.
NUM, DEN = 4, 5


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct XXH64 of a UTF-8 text's word shingles; a text of fewer words is one, none without a word."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.int64)
    digest = xxhash.xxh64_intdigest
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends + 1 - [len(w) + 1 for w in words]
    last = max(1, len(words) - shingle + 1)
    hashes = [digest(joined[a:b], 42) for a, b in zip(starts[:last].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)]
    return np.unique(np.array(hashes, dtype=np.uint64).view(np.int64))


def name_of(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 7)).astype(np.int64))


def bit_map(hashes: np.ndarray) -> np.ndarray:
    """A map as longs, the bits of the hashes' residues set; its length is a power of two from four bits a hash on."""
    size = max(MAP_BITS, (1 << (4 * len(hashes)).bit_length()) >> 1)
    bits = np.zeros(size, np.uint8)
    bits[hashes.view(np.uint64) % size] = 1
    return np.packbits(bits).view(np.int64)


def brief_map(longs: np.ndarray) -> np.ndarray:
    """A map folded to BRIEF_BITS, if it is longer."""
    return np.bitwise_or.reduce(longs.reshape(-1, BRIEF_BITS // 64), axis=0) if len(longs) > BRIEF_BITS // 64 else longs


def same_length(x: Column, y: Column) -> Column:
    """The map x folded to y's length if it is twice as long: residues modulo the half."""
    half = F.size(y)
    return F.when(F.size(x) == 2 * half, F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseOR(q))).otherwise(x)


def sizes_fit(x: Column, y: Column) -> Column:
    return F.least(x, y) * DEN >= F.greatest(x, y) * NUM


def may_be_close(x: Column, y: Column) -> Column:
    """Whether two sets, structs of n and map, can have the similarity by their sizes and maps. Sizes that fit are
    within a factor of two, so one folding is enough."""
    differ = F.zip_with(same_length(x["map"], y["map"]), same_length(y["map"], x["map"]), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    apart = F.aggregate(differ, F.lit(0), lambda a, v: a + v)
    return F.when(sizes_fit(x["n"], y["n"]), apart * (NUM + DEN) <= (x["n"] + y["n"]) * (DEN - NUM)).otherwise(False)


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of a bounded sample and their counts, by hash; they only order the prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py() or b""), pa.int64())], ["h"])

    share = min(1.0, SAMPLE_ROWS / max(1, docs.count()))
    sample = texts_of(docs).where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).mapInArrow(run, "h long")
    rows = sample.groupBy("h").agg(F.count("*").alias("n")).where("n > 3").orderBy(F.desc("n"), "h").limit(COMMON).orderBy("h").collect()
    return np.array([r.h for r in rows], np.int64), np.array([r.n for r in rows], np.int64)


def prefix(h: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 shingles, rarest first."""
    n = np.zeros(len(h), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        n = np.where(common[at] == h, counts[at], 0)
    return h[np.lexsort((h, n))][: len(h) - -(-NUM * len(h) // DEN) + 1] if len(h) else h


def similar_pairs(docs: DataFrame, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those pairs (a, b) of set names that have the similarity; rows: doc_id, node of every text."""
    wanted = stage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "similar-wanted")
    # One text of each wanted set is read again; a null id is told apart by a flag.
    ids = rows.join(wanted, "node").groupBy("node").agg(F.min("doc_id").alias("id")).select(F.coalesce("id", F.lit(-(2**63))).alias("_id")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py() or b"") for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([name_of(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "set"])

    again = texts_of(docs).join(ids, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))) == F.col("_id"), "left_semi")
    sets = stage(again.mapInArrow(run, "node long, set array<long>").join(wanted, "node", "left_semi").groupBy("node").agg(F.first("set").alias("set")), "similar-sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared * (NUM + DEN) >= (F.size("x") + F.size("y")) * NUM).select("a", "b")


def candidate_members(nodes: DataFrame) -> DataFrame:
    """g, least, size and node: the members of every group of sets that share a shingle of their prefixes, with the least
    of them and their number. Shingles of the same sets make one group, told by their number, least, sum and exclusive or;
    no list of members is gathered, and a crowded shingle is counted before the shuffle."""
    shared = nodes.select("node", F.explode("keys").alias("key"))
    found = shared.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("least"), F.bit_xor("node").alias("x"), F.sum(F.hash("node").cast("long")).alias("s")).where("size > 1")
    kept = stage(found.groupBy("size", "least", "x", "s").agg(F.min("key").alias("g")).select("g", "least", "size"), "similar-groups")
    return stage(shared.join(kept, F.col("key") == F.col("g")).select("g", "least", "size", "node"), "similar-candidates")


def apart_pairs(held: DataFrame, nodes: DataFrame, cell: int = CELL) -> DataFrame:
    """Pairs (a, b) of members of a group that have different labels, as sizes and brief maps let them; held: g, size,
    node and label; nodes: node, n and brief. A group of more than `cell` members is cut by bands of n, of which only the same and the next
    can hold a fitting size, and a band by the node's hash, into cells of about that many. Cells meet in pairs, so that a
    row holds two cells at most, however large the group is."""
    band = F.when(F.col("size") > cell, F.floor(F.log("n") / F.log(F.lit(BAND)))).otherwise(0).alias("band")
    banded = stage(held.join(nodes.select("node", "n"), "node").select("g", band, "node", "label"), "similar-held")
    counts = banded.groupBy("g", "band").agg(F.ceil(F.count("*") / cell).alias("parts"))
    salted = banded.join(stage(counts, "similar-parts"), ["g", "band"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    member = salted.join(nodes.select("node", F.struct("n", "node", F.col("brief").alias("map")).alias("y")), "node").withColumn("y", F.struct("y.n", "y.node", "label", "y.map"))
    cells = stage(member.groupBy("g", "band", "part").agg(F.array_sort(F.collect_list("y")).alias("xs")), "similar-cells")
    fits = lambda x, y: F.when(y["label"] != x["label"], may_be_close(x, y)).otherwise(False)
    pair = lambda df: df.select("x", F.explode("ys").alias("y")).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    each = cells.select("xs", F.posexplode("xs").alias("i", "x"))
    within = pair(each.select("x", F.filter(F.slice("xs", F.col("i") + 2, F.size("xs")), lambda y: fits(F.col("x"), y)).alias("ys")))
    # Keys of cells are paired first; members then come to one pair of cells at a time.
    key = lambda k: cells.select("g", F.struct("band", "part").alias(k))
    near = F.abs(F.col("c.band") - F.col("d.band")) <= 1
    met = stage(key("c").join(key("d"), "g").where(near & (F.col("c") < F.col("d"))), "similar-cell-pairs")
    side = lambda k, xs: cells.select("g", F.struct("band", "part").alias(k), F.col("xs").alias(xs))
    two = met.join(side("c", "xs"), ["g", "c"]).join(side("d", "ys"), ["g", "d"]).select("ys", F.explode("xs").alias("x"))
    across = pair(two.select("x", F.filter("ys", lambda y: fits(F.col("x"), y)).alias("ys")))
    return within.unionByName(across).distinct()


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs of sets that SimHash proposes: with equal fingerprints, and with ones that pivot distance tables link."""
    least = nodes.groupBy("fp").agg(F.min("node").alias("least"))
    same = nodes.join(least, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    links = near_links(least.select("fp"))
    named = links.join(least.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    return same.unionByName(named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()


def close_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those pairs (a, b) that the filters leave; nodes: node, n and map."""
    side = lambda k: nodes.select(F.col("node").alias(k), F.struct("n", "map").alias(f"_{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(may_be_close(F.col("_a"), F.col("_b"))).select("a", "b")


def near_texts(docs: DataFrame, carry: tuple[str, ...] = (), cell: int = CELL) -> DataFrame:
    """doc_id, the long columns in carry, component_id (the least doc_id reachable over pairs of similarity 0.8 or more)
    and label (which names the component, also where doc_ids repeat or are null) of every row.

    Null texts are empty; texts with equal shingle sets, also without any, are alike; repeated rows keep a row each; a
    component of null ids alone has a null component_id; other columns are ignored; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    common, counts = common_shingles(docs)
    schema = ", ".join(["doc_id long", *(f"`{c}` long" for c in carry), "node long, n int, fp long, map array<long>, brief array<long>, keys array<long>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py() or b"") for t in b.column("text")]
            longs = [pa.array(x, pa.int64()) for x in ([name_of(s) for s in sets], [majority(s.view(np.uint64)) for s in sets])]
            maps = [bit_map(s) for s in sets]
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (maps, [brief_map(m) for m in maps], [prefix(s, common, counts) for s in sets])]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(b.column(c) for c in carry), longs[0], pa.array([len(s) for s in sets], pa.int32()), longs[1], *lists], ["doc_id", *carry, "node", "n", "fp", "map", "brief", "keys"],
            )

    rows = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, F.col("text").cast("binary").alias("text")).mapInArrow(run, schema), "similar-rows")
    once = rows.dropDuplicates(["node"])  # rows of one node have equal sets
    nodes = stage(once.select("node", "n", "fp", "map", "brief"), "similar-nodes")
    members = candidate_members(once.select("node", "keys"))
    links = stage(similar_pairs(docs, rows, stage(close_pairs(simhash_pairs(nodes), nodes), "similar-first")), "similar-links")
    labels = lambda: components(links).select(F.col("node").alias("_n"), "label")
    named = lambda df, k, known: df.join(known, F.col(k) == F.col("_n"), "left").withColumn(f"label_{k}", F.coalesce("label", k)).drop("_n", "label")
    # Every set with the least of each group, unless they are in one component already.
    known = stage(labels(), "similar-labels")
    stars = members.select(F.col("least").alias("a"), F.col("node").alias("b")).where("a <> b").distinct()
    stars = named(named(stars, "a", known), "b", known).where("label_a <> label_b").select("a", "b")
    links = stage(links.unionByName(similar_pairs(docs, rows, stage(close_pairs(stars, nodes), "similar-stars"))), "similar-links")
    # Members of a group that are in different components meet each other within rows of cells, and leave them as pairs
    # only where sizes and brief maps let them.
    known = stage(labels(), "similar-labels")
    member = stage(named(members.drop("least"), "node", known).withColumnRenamed("label_node", "label"), "similar-members")
    mixed = member.groupBy("g").agg(F.min("label").alias("_l"), F.max("label").alias("_m")).where("_l <> _m").select("g")
    held = member.join(stage(mixed, "similar-mixed"), "g")
    rest = close_pairs(stage(apart_pairs(held, nodes, cell), "similar-apart"), nodes)
    links = stage(links.unionByName(similar_pairs(docs, rows, stage(rest, "similar-rest"))), "similar-all")
    least = rows.groupBy("node").agg(F.min("doc_id").alias("least"))
    labelled = stage(named(least, "node", labels()).select("node", F.col("label_node").alias("label"), "least"), "similar-named")
    best = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    found = stage(labelled.join(best, "label").select("node", "label", "component_id"), "similar-components")
    return rows.select("doc_id", *carry, "node").join(found, "node").select("doc_id", *carry, "component_id", "label")
