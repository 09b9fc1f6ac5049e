"""Vector bin packing of documents into shards of near equal bytes, with tokens and rows balanced beside them.

Equal texts form a group. A group up to ``1 / (shards * parts)`` of any total is placed with the other small groups
of its parcel (a hash of the text's digest picks one of ``shards * parts`` parcels), so that the number of items to
place is bounded however many documents there are; a larger group is an item of its own. Only a group of more than
``1 / (shards * CUT)`` of a total, a shard's whole share, is cut by a hash of the id, into pieces of about
``1 / (shards * parts)``, since no shard holds it; all smaller ones have one shard.
Items go in descending order of size to the shard whose residual capacity has the highest dot product with the item's
vector (bytes, tokens, rows, each as a share of its total), among the shards that the item does not overfill.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_length, stage, table, words_of

#: Parcels of small groups per shard.
PARTS = 128
#: Groups of up to 1 / CUT of a shard's equal share stay whole.
CUT = 1
#: Rows of one numbering block within a shard.
BLOCK_ROWS = 4096


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item; items: one row of (bytes, tokens, rows) each. Ties go to the lowest shard."""
    totals = np.maximum(items.sum(axis=0), 1e-9)
    share = items / totals
    room = np.full((shards, items.shape[1]), 1.0 / shards)
    out = np.zeros(len(items), dtype=int)
    for i in np.lexsort((np.arange(len(items)), -share[:, 0])):
        fits = room[:, 0] >= share[i, 0]
        score = room @ share[i]
        if fits.any():
            out[i] = int(np.argmax(np.where(fits, score, -np.inf)))
        else:  # nothing holds it whole: where most bytes are left, so that sizes stay near equal
            out[i] = int(np.argmax(room[:, 0]))
        room[out[i]] -= share[i]
    return out


def shard_documents(docs: DataFrame, shards: int = 16, parts: int = PARTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null) and tokens of every row.

    Null texts count as empty; repeated rows keep a slot each; null ids are rows like others; an empty table gives no
    rows; columns other than doc_id and text are ignored. Slots number a shard's rows from 0 by block and id. Copies of a hot group that have no id share one piece.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = stage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.unhex(F.md5(text.cast("binary"))).alias("digest"),
            (byte_length(text) + 1).alias("size"),
            F.size(words_of(text)).cast("long").alias("tokens"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        ),
        "shard-rows",
    )
    total = rows.agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).first()
    most = {c: max((total[c] or 0) // (shards * parts), 1) for c in ("size", "tokens", "rows")}
    group = rows.groupBy("digest").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    # A group's share of a shard, at most; one row is never cut.
    whole = F.lit(1) >= F.greatest(*(F.col(c) * (shards * CUT) / F.lit(max(total[c] or 0, 1)) for c in most))
    pieces = F.when(whole | (F.col("rows") == 1), 1).otherwise(F.greatest(*(F.ceil(F.col(c) / F.lit(most[c])) for c in most))).cast("int")
    # At most 3 * shards * parts groups can exceed a share of 1 / (shards * parts) of one of three totals.
    large = stage(group.where(F.greatest(*((F.col(c) > most[c]).cast("int") for c in most)) == 1).select("digest", pieces.alias("pieces")), "shard-large")
    keyed = rows.join(F.broadcast(large), "digest", "left").withColumn(
        "item",
        F.when(F.col("pieces").isNull(), F.pmod(F.xxhash64("digest"), F.lit(shards * parts)))
        # A piece: negative numbers from the group's hash and the piece's number.
        .otherwise(-1 - F.shiftrightunsigned(F.xxhash64("digest", F.pmod(F.xxhash64("doc_id"), F.col("pieces"))), 2)),
    )
    items = keyed.groupBy("item").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).orderBy("item").collect()
    placed = place(np.array([[r.size, r.tokens, r.rows] for r in items], dtype=float).reshape(-1, 3), shards)
    where = spark.createDataFrame([(r.item, int(s)) for r, s in zip(items, placed, strict=True)], "item long, shard int")
    out = keyed.join(F.broadcast(where), "item").drop("digest", "pieces", "item")
    return number_slots(out, (total["rows"] or 0), shards, block_rows).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens"
    )


def number_slots(rows: DataFrame, n: int, shards: int, block_rows: int) -> DataFrame:
    """Add slot, gapless from 0 in each shard. Rows are numbered within blocks; the blocks' offsets are sums of counts."""
    blocks = max(1, -(-n // (shards * block_rows)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(blocks)).cast("int"))
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("rank", F.row_number().over(within))
    return numbered.join(offsets, ["shard", "block"]).withColumn("slot", (F.col("offset") + F.col("rank") - 1).cast("long"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
