"""A corpus pipeline of five stages over `documents`: toxicity, line dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet to the shared
folder and gives it to the next. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm import lines, mixing, pieces, similar, toxicity
from lanewise.llm.common import stage, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The mix takes this share of the tokens that reach it, each document at most once.
MIX_SHARE, MIX_EPOCHS = 0.95, 1


def columns_of(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars as the text is now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no category of the toxicity chain rejects. Null and empty texts are not toxic; repeated rows and null
    ids are rows like others; without labels nothing is rejected; an empty table stays empty."""
    return toxicity.mark_toxic(docs, table(spark, sf_dir, "labels")).where("not _toxic.toxic").select(*COLUMNS)


def dedupe_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the multi-line chunks and passages that an earlier document has; none is dropped here. Null texts
    stay null; equal texts of one id keep the same lines; rows without an id are documents by their text, after all others."""
    return columns_of(lines.dedupe_lines(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts with a similarity of 0.8 or more: that with the least doc_id, null ids last; of
    rows with equal ids, one. Null and empty texts are one component. The verdict is each row's own, by a row number
    that is written beside the row, so repeated and missing ids change nothing."""
    numbered = stage(docs.withColumn("_row", F.monotonically_increasing_id()), "near-rows")
    near = similar.near_texts(numbered, carry=("_row",))
    best = near.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")).alias("b")).select("b._row")
    return numbered.join(stage(best, "near-kept").hint("merge"), "_row", "left_semi").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights take. Null languages and sources are leaves of their own; documents without a
    word count no tokens and are never taken; repeated rows are drawn each."""
    return mixing.select_mix(docs, budget_share=MIX_SHARE, max_epochs=MIX_EPOCHS).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids and the digest of the decoded text of every row; null and empty texts have no pieces."""
    return pieces.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedupe_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: The toxicity chain is trained and the pieces are searched, so no SQL states run()'s rows; tests/llm holds the stages
#: against plain versions (test_pipeline.py, and each operator's own tests).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
