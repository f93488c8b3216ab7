"""Which strings hold which others: a join on character runs, each needle anchored at its rarest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import anchors
from ..staging import staged

#: Characters of a run; needles that are shorter are runs themselves.
RUN = 3


def _runs(needle: Column) -> Column:
    size = F.least(F.length(needle), F.lit(RUN))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(needle) - size + 1), lambda i: F.substr(needle, i, size)))


def contained(hay: DataFrame, needles: DataFrame, under: str | None = None) -> DataFrame:
    """(hay, needle) for all distinct strings hay that hold a distinct needle which isn't empty.

    Runs that no needle has are left out before anything is shuffled. A count table over all of hay says how many strings
    have a run; each needle is looked for where its rarest run is, and nowhere if one of its runs is in no string.
    """
    own = needles.select("needle").distinct().where("needle <> ''").select("needle", F.explode(_runs(F.col("needle"))).alias("run"))
    sizes = [r[0] for r in own.select(F.length("run")).distinct().collect()]  # RUN at most
    texts = hay.select("hay").distinct()
    if not sizes:
        return texts.select("hay", F.col("hay").alias("needle")).limit(0)
    placed = texts.select("hay", F.explode(anchors(F.col("hay"), sizes)).alias("run")).join(own.select("run").distinct(), "run", "left_semi")
    placed = staged(placed, under)
    often = placed.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    rarest = own.join(often, "run", "left").groupBy("needle").agg(F.min_by("run", F.struct(n, "run")).alias("run"), F.min(n).alias("n")).where("n > 0").drop("n")
    return placed.join(rarest, "run").where(F.contains("hay", "needle")).select("hay", "needle")
