"""Tables written once and read by several branches of a plan."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). In local mode without the setting a temporary folder
    is taken."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder in the shared one for tables that nothing reads afterwards; deleted at the end, also after a fault."""
    folder = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def staged(df: DataFrame, under: str | None = None) -> DataFrame:
    """df written to the shared folder, or one under it, and read back: branches that build on it do its work once,
    survive lost executors, and are compiled apart from it."""
    spark = df.sparkSession
    path = f"{under or shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
