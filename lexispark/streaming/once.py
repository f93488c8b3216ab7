"""Streams that are run until what there is has been read, as tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..staging import shared_dir

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_db(spark: SparkSession) -> Iterator[None]:
    """The state store that processors of arbitrary state need; afterwards the session has its own setting again."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS_DB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def drained(stream: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """All rows that the stream gives for its present input; with keys only the last one of each key. Batches are written
    to the shared folder under their numbers, so one that is done again replaces itself."""
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    with rocks_db(spark):
        query = stream.writeStream.outputMode("update" if keys else "append").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
        query.awaitTermination()
    if query.lastProgress is None:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{folder}/rows")
    if not keys:
        return rows.drop("batch")
    last = F.max_by(F.struct(*[c for c in stream.columns if c not in keys]), "batch")
    return rows.groupBy(*keys).agg(last.alias("last")).select(*keys, "last.*")
