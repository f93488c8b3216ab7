"""Numbered series: profiles of their bases, and bases of one script that stand for those of another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import consistency_key, contains_cjk, contains_latin, is_blank, series_variant, ws_trim
from ..staging import scratch, staged

#: Suffixes that are taken as a set; there are 2^HOT such sets at most.
HOT = 8
KEYED = ("base", "suffix", "base_key", "key")


def keyed(entries: DataFrame) -> DataFrame:
    """entries with base and suffix (null unless they are numbered names), base_key, and the key of the source. Staged,
    as memory, series and plans all read it."""
    if set(KEYED) <= set(entries.columns):
        return entries
    named = entries.withColumn("v", series_variant("source")).withColumns({"base": F.col("v.base"), "suffix": F.col("v.suffix")}).drop("v")
    with scratch(entries.sparkSession) as under:
        return staged(staged(named, under).withColumns({"base_key": consistency_key("base"), "key": consistency_key("source")}))


def variants(entries: DataFrame) -> DataFrame:
    """entries that are numbered names, with base, suffix and base_key."""
    return keyed(entries).where("base IS NOT NULL AND base_key <> ''")


def profiles(found: DataFrame) -> DataFrame:
    """Per base_key: the first base, the number of suffixes, and the scripts of its bases."""
    return found.groupBy("base_key").agg(
        F.min_by("base", F.struct("pos", "base")).alias("base_source"), F.count_distinct(F.lower(ws_trim("suffix"))).alias("n_suffixes"),
        F.bool_or(contains_latin("base")).alias("has_latin"), F.bool_or(contains_cjk("base")).alias("has_cjk"),
    )


def aliases_by_content(found: DataFrame, known: DataFrame) -> DataFrame:
    """(base_key, canonical): where bases share a contentuid, those with CJK text stand for the Latin base of most
    suffixes, then the longest, then the last. Of several contentuids the least decides."""
    shared = found.where(~is_blank("contentuid")).select("contentuid", "base_key").distinct().join(known, "base_key")
    best = Window.partitionBy("contentuid").orderBy(F.col("n_suffixes").desc(), F.octet_length("base_source").desc(), F.col("base_key").desc())
    chosen = shared.where("has_latin").withColumn("r", F.row_number().over(best)).where("r = 1").select("contentuid", F.col("base_key").alias("canonical"))
    pairs = shared.where("has_cjk").join(chosen, "contentuid").where("base_key <> canonical")
    return pairs.groupBy("base_key").agg(F.min_by("canonical", "contentuid").alias("canonical"))


def best_overlaps(cjk: DataFrame, latin: DataFrame) -> DataFrame:
    """(suffixes, canonical) for each row of cjk (suffixes: a sorted array, each once): of the rows of latin (suffixes,
    canonical, m) that share at least two suffixes, the one that shares most, then has the largest m, then the least name.

    The HOT suffixes that most rows have make at most 2^HOT different sets, and of the rows of latin with one such set
    only the best can win by hot suffixes alone; these few sets meet by two of them. Rows that share any other suffix
    meet by it, and all that they share is counted. So neither join has pairs of a suffix that everything has.
    """
    every = cjk.select("suffixes").union(latin.select("suffixes"))
    hot = [r["s"] for r in every.select(F.explode("suffixes").alias("s")).groupBy("s").count().orderBy(F.desc("count"), "s").limit(HOT).collect()]
    hot = F.array(*[F.lit(s) for s in hot]).cast("array<string>")
    common = lambda x: F.array_intersect(x, hot)
    first = F.min_by(F.struct("m", "canonical"), F.struct(-F.col("m"), "canonical"))
    champions = latin.groupBy(common("suffixes").alias("theirs")).agg(first.alias("c")).select("theirs", "c.*")
    twos = lambda x: F.flatten(F.transform(x, lambda a, i: F.transform(F.slice(x, i + 2, F.size(x)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    two = lambda rows, x: rows.withColumn("two", F.explode(twos(F.col(x))))
    sets = cjk.select(common("suffixes").alias("ours")).distinct()
    shared = lambda a, b: F.size(F.array_intersect(a, b)).alias("n")
    by_hot = two(sets, "ours").join(two(champions, "theirs"), "two").select("ours", "canonical", "m", shared("ours", "theirs"))
    best = F.min_by(F.struct("n", "m", "canonical"), F.struct(-F.col("n"), -F.col("m"), "canonical"))
    by_hot = by_hot.groupBy("ours").agg(best.alias("best"))
    won = cjk.withColumn("ours", common("suffixes")).join(by_hot, "ours").select("suffixes", "best.*")
    other = lambda rows, name: rows.select(F.col("suffixes").alias(name), *[c for c in rows.columns if c != "suffixes"], F.explode(F.array_except("suffixes", hot)).alias("s"))
    met = other(cjk, "ours").join(other(latin, "theirs"), "s").select("ours", "theirs", "canonical", "m").distinct()
    met = met.select(F.col("ours").alias("suffixes"), shared("ours", "theirs"), "m", "canonical").where("n >= 2")
    return won.union(met).groupBy("suffixes").agg(best.alias("best")).select("suffixes", "best.canonical")


def aliases_by_suffix(found: DataFrame, known: DataFrame, taken: DataFrame, under: str | None = None) -> DataFrame:
    """(base_key, canonical) of pure CJK bases without alias: the Latin base that shares most suffixes, at least two,
    then has most, then comes first. Bases of one set of suffixes are one row: they have one answer, or only the first
    of them can be one."""
    sets = found.select("base_key", F.lower(ws_trim("suffix")).alias("s")).distinct().groupBy("base_key").agg(F.sort_array(F.collect_list("s")).alias("suffixes"))
    sets = staged(sets.join(known.select("base_key", "has_latin", "has_cjk"), "base_key"), under)
    open_ = sets.where("has_cjk AND NOT has_latin").join(taken.select("base_key"), "base_key", "left_anti").select("base_key", "suffixes")
    latin = sets.where("has_latin").groupBy("suffixes").agg(F.min("base_key").alias("canonical")).withColumn("m", F.size("suffixes"))
    best = best_overlaps(open_.select("suffixes").distinct(), latin)
    return open_.join(best, "suffixes").select("base_key", "canonical")


def aliases(entries: DataFrame) -> DataFrame:
    """All aliases, one hop; a staged table."""
    found = variants(entries)
    with scratch(entries.sparkSession) as under:
        known = staged(profiles(found), under)
        by_content = staged(aliases_by_content(found, known), under)
        by_suffix = aliases_by_suffix(found, known, by_content, under)
        return staged(by_content.withColumn("rule", F.lit("contentuid")).union(by_suffix.withColumn("rule", F.lit("suffix"))))
