"""Places of rows in an order, found without bringing all rows of a group to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, staged


def ranked(rows: DataFrame, order: list[Column], tree: str | None = None, under: str | None = None) -> DataFrame:
    """rows with rank (0 first, long) in the given order and n, the number of rows; both by groups of the column tree, if any.

    rows is a table that can be read twice (its columns aren't called run, at, rank or n). Rows are sorted into ranges,
    which are numbered as they lie; only one row a range and group is summed up to say where each begins. Groups of any
    size are dealt over the ranges, rows that the order can't tell apart stand as they come. Null groups are groups.
    """
    spark = rows.sparkSession
    group = [F.col(f"`{tree}`")] if tree else []
    salted = rows.withColumn("run", F.xxhash64(F.monotonically_increasing_id()))  # equal rows are dealt over ranges, too
    dealt = salted.repartitionByRange(partitions(spark), *group, *order, "run").sortWithinPartitions(*group, *order, "run")
    lying = staged(dealt.withColumn("run", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "ranges", under=under)
    runs = lying.groupBy("run", *group).agg(F.count(F.lit(1)).alias("own"), F.min("at").alias("first"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("run").alias("its_run"), *[g.alias("its_group") for g in group], "first", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"), F.sum("own").over(whole).alias("n"))
    same = F.col("run") == F.col("its_run")
    if tree:
        same = same & group[0].eqNullSafe(F.col("its_group"))
    return lying.join(runs, same).select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("before") + F.col("at") - F.col("first")).alias("rank"), "n")
