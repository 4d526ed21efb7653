"""Session helpers: shared folder, materialised intermediates, table loading."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` of the session.

    Only where the session names none and runs in local mode (tests), a temporary folder is set.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="leafmill-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_written: list[str] = []


def clear(spark: SparkSession) -> None:
    """Remove all intermediate tables written so far; results that still read them must be done with."""
    while _written:
        _remove(spark, _written.pop())


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back.

    Cuts the lineage like `checkpoint()`, survives the loss of executors, and stores columns compressed.
    The files go with `clear`, or when the Python process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/leafmill/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(clear, spark)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
