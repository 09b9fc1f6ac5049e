"""Stored layers: tables bucketed by race_key that later jobs dedupe, join and pivot without a shuffle, refreshed in the
order of what they are made from; and merges that rewrite only the partitions that a batch touches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import scratch, stage
from .core import insert_absent, latest, upsert


class Layers:
    """Named tables, each made from others and stored in one number of buckets of one key, so that they are
    co-partitioned. A refresh writes a new version beside the old one and then turns the name to it: a refresh that fails
    leaves the old version in place."""

    def __init__(self, spark: SparkSession, key: str = "race_key", buckets: int = 64):
        self.spark, self.key, self.buckets = spark, key, buckets
        self.made: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame], tuple[str, ...]]] = {}
        self.tables: dict[str, str] = {}

    def define(self, name: str, build: Callable[..., DataFrame], inputs: Sequence[str] = (), sort: Sequence[str] = ()) -> Layers:
        """build takes the tables of the inputs, which are defined before; rows of a bucket are sorted by key and sort."""
        missing = [i for i in inputs if i not in self.made]
        if missing:
            raise ValueError(f"layer {name} is made from {missing}, which are not defined")
        self.made[name] = (tuple(inputs), build, tuple(sort))
        return self

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.table(self.tables[name])

    def refresh(self, *changed: str) -> list[str]:
        """Rebuild the changed layers (all if none is named), inputs that aren't stored yet, and all stored layers that are
        made from them, inputs first."""
        again = set(changed or self.made)
        if again - set(self.made):
            raise ValueError(f"no such layers: {sorted(again - set(self.made))}")
        for name in reversed(self.made):
            again |= {i for i in self.made[name][0] if name in again and i not in self.tables}
        done = []
        for name, (inputs, build, sort) in self.made.items():  # definitions come after their inputs'
            if name in again or (name in self.tables and set(inputs) & set(done)):
                old = self.tables.get(name)
                self.tables[name] = self.store(name, build(*(self[i] for i in inputs)), sort)
                done.append(name)
                if old:
                    self.spark.sql(f"drop table {old}")
        return done

    def store(self, name: str, df: DataFrame, sort: Sequence[str]) -> str:
        table = f"lanewise_{name}_{uuid.uuid4().hex}"
        rows = df.repartition(self.buckets, self.key)  # one file a bucket
        rows.write.format("parquet").option("path", scratch(self.spark, table)).bucketBy(self.buckets, self.key).sortBy(self.key, *sort).saveAsTable(table)
        return table

    def drop(self) -> None:
        for table in self.tables.values():
            self.spark.sql(f"drop table if exists {table}")
        self.tables.clear()


def partitioned(spark: SparkSession, path: str, batch: DataFrame, by: Sequence[str]) -> DataFrame:
    """The table at path, its partition columns with the batch's types (their folders' names don't tell)."""
    kinds = {f.name: f.dataType for f in batch.schema.fields if f.name in by}
    fields = [T.StructField(f.name, kinds.get(f.name, f.dataType), True) for f in spark.read.parquet(path).schema.fields]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def touched(target: DataFrame, batch: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The partitions of a batch, and the target's rows in them. The target's files are pruned by the range of the first
    partition column when the read is planned, and by the partitions themselves when it runs."""
    parts = stage(batch.select(*by).distinct(), "touched")
    if not parts.where(" or ".join(f"`{c}` is null" for c in by)).isEmpty():
        raise ValueError(f"every row of a batch needs a partition: {list(by)}")
    low, high = parts.agg(F.min(by[0]), F.max(by[0])).first()
    within = F.col(by[0]).between(F.lit(low), F.lit(high))
    return parts, target.where(within).join(parts.where(within), list(by), "left_semi")


def merge_partitions(spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str], sequence: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Upsert a batch into the table at path that is partitioned by `by`; gives the partitions that were rewritten.

    A key must always be in one partition. Only the partitions of the batch's rows are read, shuffled and replaced; the
    others keep their files. The merged rows are written to the shared folder before the table is touched, so that a
    merge can be repeated after a failure; a batch that comes twice changes no row.
    """
    batch = stage(latest(batch, keys, sequence), "merge-batch")
    target = partitioned(spark, path, batch, by)
    parts, old = touched(target, batch, by)
    rows = stage(upsert(old, batch, keys, sequence).select(*target.columns), "merged")
    # Spark deals a partition's rows to as many files as their size needs.
    rows.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return parts


def insert_partitions(spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str], sequence: Sequence[str], by: Sequence[str]) -> int:
    """Append those rows of a batch whose keys the table at path lacks, the first of each; gives their number. Only the
    partitions of the batch's rows are compared; no file is rewritten."""
    target = partitioned(spark, path, batch, by)
    batch = stage(batch.select(*target.columns), "insert-batch")
    _, old = touched(target, batch, by)
    rows = stage(insert_absent(old, batch, keys, sequence), "insert-rows")
    rows.hint("rebalance", *by).write.mode("append").partitionBy(*by).parquet(path)
    return rows.count()


def files_of(spark: SparkSession, path: str, by: Sequence[str]) -> DataFrame:
    """by and the sorted names of the files that hold a partition's rows."""
    return spark.read.parquet(path).select(*by, F.col("_metadata.file_name").alias("f")).distinct().groupBy(*by).agg(F.sort_array(F.collect_list("f")).alias("files"))
