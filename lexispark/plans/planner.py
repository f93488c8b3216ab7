"""Which entries are decided already, and the fewest jobs for the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import compose_variant, consistency_key, is_blank, style_hint
from ..operators import glossary, memory, series
from ..staging import staged


def pending(entries: DataFrame) -> DataFrame:
    return entries.where(~is_blank("source") & is_blank("target"))


def plan(entries: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(resolved, jobs). resolved: id, pos, target, rule. jobs: kind, base, first_pos, members (id, suffix in order).
    known is the entries' memory, if it is at hand.

    In order: numbered names whose base is in memory; series of two or more pending names; exact keys in memory;
    the rest by exact key.
    """
    entries = series.keyed(entries)
    open_entries, known = pending(entries), staged(memory.build(entries)) if known is None else known
    alias = series.aliases(entries).select(F.col("base_key").alias("raw_key"), "canonical")
    sources = series.profiles(series.variants(entries)).select("base_key", "base_source")
    named = series.variants(open_entries).drop("key").withColumnRenamed("base_key", "raw_key").join(alias, "raw_key", "left").withColumn("base_key", F.coalesce("canonical", "raw_key")).join(sources, "base_key", "left").withColumn("base_source", F.coalesce("base_source", "base"))
    terms = known.select(F.col("key").alias("base_key"), F.col("target").alias("known"))
    joined = staged(named.join(terms, "base_key", "left"))
    hits = joined.where("known IS NOT NULL").select("id", "pos", compose_variant(F.col("known"), F.col("suffix")).alias("target"), F.lit("series").alias("rule"))
    member = F.sort_array(F.collect_list(F.struct("pos", "id", "suffix")))
    groups = joined.where("known IS NULL").groupBy("base_key").agg(F.min_by("base_source", "pos").alias("base"), F.min("pos").alias("first_pos"), member.alias("members")).where(F.size("members") >= 2)
    used = hits.select("id").union(groups.select(F.explode("members.id").alias("id"))).distinct()
    rest = open_entries.join(used, "id", "left_anti").drop("suffix")
    exact = rest.join(known.select("key", F.col("target").alias("known")), "key", "left")
    resolved = hits.union(exact.where("known IS NOT NULL").select("id", "pos", F.col("known").alias("target"), F.lit("exact").alias("rule")))
    alike = exact.where("known IS NULL").withColumn("suffix", F.lit(None).cast("string")).groupBy("key").agg(F.min_by("source", "pos").alias("base"), F.min("pos").alias("first_pos"), member.alias("members"))
    jobs = groups.select(F.lit("series").alias("kind"), "base", "first_pos", "members").union(alike.select(F.when(F.size("members") > 1, "exact_group").otherwise("single").alias("kind"), "base", "first_pos", "members"))
    return resolved, jobs


def fan_out(jobs: DataFrame, output: Column) -> DataFrame:
    """id and target of every member of a job: its output, with the member's suffix in a series."""
    each = jobs.withColumn("output", output).select("kind", "output", F.explode("members").alias("m"))
    return each.select("m.id", F.col("m.pos").alias("pos"), F.when(F.col("kind") == "series", compose_variant(F.col("output"), F.col("m.suffix"))).otherwise(F.col("output")).alias("target"))


def prompt(source: Column, matched: Column, consistent: Column, hint: Column) -> Column:
    """The request's text. matched and consistent: arrays of (source, target), maybe null; hint: maybe null."""
    lines = lambda a: F.array_join(F.transform(a, lambda m: F.concat(m["source"], F.lit(" = "), m["target"])), "\n")
    section = lambda title, a: F.when(F.size(F.coalesce(a, F.array().cast("array<struct<source:string,target:string>>"))) > 0, F.concat(F.lit(title + "\n"), lines(a)))
    context = style_hint(hint)
    parts = F.concat_ws("\n\n", F.when(context.isNotNull(), F.concat(F.lit("[Context] Use it for meaning and tone; terms and tags go first:\n"), context)), section("[Terms] Use exactly these translations:", matched), section("[Decided] Names already translated in this mod:", consistent))
    ask = "Translate into Simplified Chinese and answer with the translation only"
    return F.when(parts == "", F.concat(F.lit(f"{ask}:\n\n"), source)).otherwise(F.concat(F.lit(f"{ask}.\n\n"), parts, F.lit("\n\nText:\n"), source))


def planned(entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(resolved, jobs, known): plan() with the entries' memory; entries are keyed, and their memory is built, once."""
    entries = series.keyed(entries)
    known = staged(memory.build(entries))
    return *plan(entries, known), known


def requests(jobs: DataFrame, terms: DataFrame, known: DataFrame, hint: Column | None = None) -> DataFrame:
    """jobs with matches, consistency terms and the prompt. Jobs are staged, as three branches read them."""
    jobs = staged(jobs)
    keyed = jobs.withColumn("key", consistency_key("base"))
    pair = lambda order, a, b: F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(a).alias("source"), F.col(b).alias("target")))), lambda m: F.struct(m["source"], m["target"]))
    found = glossary.matches(jobs.select("base").distinct(), terms, "base", "base").groupBy("base").agg(pair("rank", "source", "target").alias("matches"))
    refs = memory.references(keyed, known).groupBy("key").agg(pair("rank", "ref_source", "ref_target").alias("consistency_terms"))
    out = keyed.join(found, "base", "left").join(refs, "key", "left")
    return out.withColumn("prompt", prompt(F.col("base"), F.col("matches"), F.col("consistency_terms"), hint if hint is not None else F.lit(None).cast("string")))
