"""Queries on keys with more digits than the given tables have."""

import os

import pytest
from pyspark.sql import functions as F

from lanewise.plans.queries import ORACLES, QUERIES
from tests.test_entry import TABLES, same


@pytest.fixture(scope="module")
def shifted(spark, small, tmp_path_factory):
    """The smallest tables with numbers of suppliers that have five digits."""
    path = str(tmp_path_factory.mktemp("shifted"))
    for t in TABLES:
        if t == "lineitem":
            spark.read.parquet(f"{small}/{t}.parquet").withColumn("l_suppkey", F.col("l_suppkey") + 59_990).coalesce(1).write.parquet(f"{path}/rows")
            part = next(f for f in os.listdir(f"{path}/rows") if f.endswith(".parquet"))
            os.link(f"{path}/rows/{part}", f"{path}/{t}.parquet")
        else:
            os.symlink(f"{small}/{t}.parquet", f"{path}/{t}.parquet")
    return path


@pytest.mark.parametrize("name", ["race_program_entries", "race_report_rows"])
def test_numbers_of_five_digits(spark, shifted, name):
    same(spark, shifted, name, QUERIES, ORACLES)
