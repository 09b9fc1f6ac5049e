"""Shared helpers of the corpus operators: the staging folder, lineage cuts, let-bindings and word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words everywhere in this package: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session (tests) may do without."""
    where = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_lanewise_dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = spark._lanewise_dir = tempfile.mkdtemp(prefix="spark-")
    return where.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, under the application's id so that an owner can drop all of a run at once."""
    return f"{shared_dir(spark)}/lanewise-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, settings: dict[str, str] | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: a lineage cut that outlives lost executors.
    The shuffle files of the written plan go when it has ended, since only the table is read from then on. Settings
    hold for this write only."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, label)
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", **(settings or {})}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of at most `rows` whole texts, for the session: the default of 10,000 long texts fills a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """All maximal runs of other than white space, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def byte_length(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
