"""Every query of the subpackage over empty tables, and over tables with rows of nulls and clashing columns."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from leafmill.llm.queries import QUERIES


def odd_tables(spark, data, folder, kind):
    for path in glob.glob(f"{data}/*.parquet"):
        df = spark.read.parquet(path)
        if kind == "empty":
            df = df.limit(0)
        else:
            nulls = spark.range(3).select(*(F.lit(None).cast(t).alias(n) for n, t in df.dtypes))
            df = df.limit(60).union(nulls).withColumn("form", F.lit("x")).withColumn("n", F.lit(1)).withColumn("h", F.lit(None).cast("string"))
        df.coalesce(1).write.parquet(f"{folder}/{os.path.basename(path)}")
    return str(folder)


@pytest.fixture(scope="module")
def empty(spark, data, tmp_path_factory):
    return odd_tables(spark, data, tmp_path_factory.mktemp("empty"), "empty")


@pytest.fixture(scope="module")
def nulls(spark, data, tmp_path_factory):
    return odd_tables(spark, data, tmp_path_factory.mktemp("nulls"), "nulls")


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", QUERIES)
def test_rows_of_nulls(spark, nulls, name):
    QUERIES[name](spark, nulls).write.format("noop").mode("overwrite").save()
