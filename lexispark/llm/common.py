"""Helpers that the training-data operators share: shared scratch tables and text columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: bounds what a Python worker holds of long texts, and the buffers that its executor
#: keeps for batches.
BATCH_ROWS, BATCH_BYTES = 256, 2 << 20
#: Bits of the bitmap that rows are told apart by before a join.
MARKS = 1 << 26


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only in local mode where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str, under: str | None = None) -> str:
    return f"{under or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder in the shared one for tables that nothing reads afterwards; deleted at the end, also after a fault."""
    folder = new_path(spark, name)
    try:
        yield folder
    finally:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def staged(df: DataFrame, name: str, *partition_by: str, under: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder (or one under it) and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name, under)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small whatever the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def own_columns(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def marked(docs: DataFrame, ids: DataFrame, column: str) -> tuple[DataFrame, Column]:
    """docs' rows as structs beside a bitmap of fixed size (8 MB, so it's broadcast) of the ids, and whether a row's bit is set."""
    at = F.pmod(F.xxhash64(column), F.lit(MARKS))
    marks = ids.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("marks"))
    rows = docs.select(F.struct("*").alias("row"), at.alias("at")).withColumn("bucket", F.bitmap_bucket_number("at")).join(F.broadcast(marks), "bucket", "left")
    return rows, F.expr("coalesce(shiftright(cast(conv(hex(substring(marks, cast(bitmap_bit_position(at) div 8 AS int) + 1, 1)), 16, 10) AS int), cast(bitmap_bit_position(at) % 8 AS int)) & 1 = 1, false)")


def meeting(docs: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows of docs whose column is in ids: most others are left out before anything is shuffled."""
    rows, unsure = marked(docs, ids, column)
    return rows.where(unsure).select("row.*").join(ids.select(column).distinct(), column, "left_semi").select(own_columns(docs))


def apart(docs: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows of docs whose column is not in ids or null: most are kept without a shuffle."""
    rows, unsure = marked(docs, ids, column)
    rest = rows.where(unsure).select("row.*").join(ids.select(column), column, "left_anti").select(own_columns(docs))
    return rows.where(~unsure).select("row.*").union(rest)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_bytes(name: str = "text") -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
