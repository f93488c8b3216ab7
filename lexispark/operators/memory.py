"""Consistency memory: translations that are decided, and references to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip_target_suffix, ws_trim
from ..staging import scratch, staged
from .containment import contained
from .series import keyed

LEAST_BYTES, REFERENCES = 3, 12


def build(entries: DataFrame) -> DataFrame:
    """(key, source, target): the first translated source of each key; a numbered name decides its base too."""
    done = keyed(entries).where(~is_blank("source") & ~is_blank("target"))
    whole = done.select("pos", F.lit(0).alias("ord"), ws_trim("source").alias("source"), ws_trim("target").alias("target"), "key")
    base = done.where("base IS NOT NULL").select("pos", F.lit(1).alias("ord"), ws_trim("base").alias("source"), strip_target_suffix(F.col("target"), F.col("suffix")).alias("target"), F.col("base_key").alias("key"))
    every = whole.union(base).where("source <> '' AND target IS NOT NULL AND target <> ''").where(F.octet_length("key") >= LEAST_BYTES)
    first = F.min_by(F.struct("source", "target"), F.struct("pos", "ord", "source", "target"))
    return every.groupBy("key").agg(first.alias("t")).select("key", "t.source", "t.target")


def references(keys: DataFrame, memory: DataFrame, top: int = REFERENCES) -> DataFrame:
    """(key, rank, ref_key, ref_source, ref_target): up to top terms whose key is a proper part of key, those of the
    longest source first. The memory's keys are found in others at their rarest runs of characters; of a key's references
    no more than top are ever held together."""
    terms = memory.select(F.col("key").alias("ref_key"), F.col("source").alias("ref_source"), F.col("target").alias("ref_target"))
    with scratch(keys.sparkSession) as under:
        found = contained(keys.select(F.col("key").alias("hay")), terms.select(F.col("ref_key").alias("needle")), under).where("hay <> needle")
        found = found.join(terms, F.col("needle") == F.col("ref_key")).withColumnRenamed("hay", "key")
        order = Window.partitionBy("key").orderBy(F.octet_length("ref_source").desc(), "ref_key")
        return staged(found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select("key", "rank", "ref_key", "ref_source", "ref_target"))
