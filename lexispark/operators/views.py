"""Browsing: work items, search, folder trees and write plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.files import file_kind, folders, target_path, write_priority
from ..functions.text import is_blank
from ..staging import staged

#: The collation of names.
LOCALE = "en"


def work_items(entries: DataFrame) -> DataFrame:
    return entries.where(~is_blank("source"))


def only_pending(entries: DataFrame) -> DataFrame:
    """Those whose target is empty as it stands, untrimmed."""
    return entries.where("target = ''")


def search(entries: DataFrame, query: str, *columns: str) -> DataFrame:
    """Entries with the trimmed query, in any case, in one of the columns; all if it is empty."""
    q, hit = query.strip().lower(), F.lit(False)
    for c in columns or ("source", "target", "contentuid"):
        hit = hit | F.lower(F.col(c)).contains(q)
    return entries.where(hit) if q else entries


def selected(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Entries of the files (name)."""
    return entries.join(files.select(F.col("name").alias("source_file")), "source_file", "left_semi")


def retranslate_all(entries: DataFrame) -> DataFrame:
    """If nothing is pending, every work item pending again."""
    nothing = entries.agg(F.coalesce(F.max((~is_blank("source") & is_blank("target")).cast("int")), F.lit(0)).alias("open"))
    reset = (F.col("open") == 0) & ~is_blank("source")
    return entries.crossJoin(F.broadcast(nothing)).withColumns({"target": F.when(reset, "").otherwise(F.col("target")), "status": F.when(reset, "pending").otherwise(F.col("status")), "error": F.when(~reset, F.col("error"))}).drop("open")


def classified(files: DataFrame) -> DataFrame:
    return files.withColumn("kind", file_kind(F.col("name")))


def localization_only(files: DataFrame) -> DataFrame:
    return files.where(F.col("kind").isin("localization-xml", "localization-loca"))


def collated(x: Column | str) -> Column:
    """A name as it is sorted for readers: by the collation of the locale, not by bytes."""
    return F.collate(x, LOCALE)


def language_order(files: DataFrame) -> list[Column]:
    """Files by language, those without one last, then by name."""
    return [collated(F.coalesce("language", F.lit("zzz"))), collated("name"), F.col("name")]


def by_language(files: DataFrame) -> DataFrame:
    return files.orderBy(*language_order(files))


def by_name(files: DataFrame) -> DataFrame:
    return files.orderBy("name")


def write_plan(files: DataFrame) -> DataFrame:
    """Per target path the file of most priority, then the first. Files without entries are left out."""
    full = files.where("n_entries > 0").withColumns({"target_path": target_path(F.col("name")), "priority": write_priority(F.col("language"))})
    best = Window.partitionBy("target_path").orderBy(F.col("priority").desc(), "pos")
    return full.withColumn("r", F.row_number().over(best)).where("r = 1").select("target_path", "name", "priority")


def folder_rollup(files: DataFrame) -> DataFrame:
    """Per folder at any depth: files in it, checked ones, and the state of its box."""
    each = files.select(F.explode(folders(F.col("name"))).alias("path"), "checked")
    per = each.groupBy("path").agg(F.count("*").alias("total"), F.count_if(F.col("checked")).alias("n_checked"))
    state = F.when(F.col("n_checked") == 0, "unchecked").when(F.col("n_checked") == F.col("total"), "checked").otherwise("indeterminate")
    return per.withColumns({"state": state, "depth": F.size(F.split("path", "/")).cast("long")})


def tree(files: DataFrame) -> DataFrame:
    """Nodes of the path tree: path, name, depth, is_leaf; in_tree_order sorts them."""
    leaf = files.select(F.col("name").alias("path"), F.lit(True).alias("is_leaf"))
    inner = files.select(F.explode(folders(F.col("name"))).alias("path"), F.lit(False).alias("is_leaf")).distinct()
    parts = F.split("path", "/")
    return leaf.union(inner).withColumns({"name": F.element_at(parts, -1), "depth": F.size(parts).cast("long")})


def tree_order() -> list[Column]:
    """A node's key in a tree that is shown unfolded: at each level folders before files, then by name; a folder stands
    right before what is in it."""
    parts = F.split("path", "/")
    last = F.size(parts) - 1
    key = F.transform(parts, lambda x, i: F.struct(F.when((i == last) & F.col("is_leaf"), 1).otherwise(0).alias("file"), collated(x).alias("name"), x.alias("raw")))
    return [key]


def in_tree_order(nodes: DataFrame) -> DataFrame:
    """Nodes as the unfolded tree shows them."""
    return nodes.orderBy(*tree_order())


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with place (1, 2, ...) in an order. Rows are sorted in ranges; only the ranges' sizes meet in one task."""
    keyed = rows.select(F.struct("*").alias("row"), *[x.alias(f"k{i}") for i, x in enumerate(order)])
    keys = [f"k{i}" for i in range(len(order))]
    lying = staged(keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("row", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    sizes = lying.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lying.join(sizes.select("part", "first", before.alias("before")), "part").select("row.*", (F.col("before") + F.col("at") - F.col("first") + 1).alias("place"))


def toggle(selected: DataFrame, shown: DataFrame, on: bool) -> DataFrame:
    """The selection with all shown names added or taken away."""
    return selected.select("name").union(shown.select("name")).distinct() if on else selected.join(shown, "name", "left_anti")


def latest_readable(copies: DataFrame, strict: bool = False) -> DataFrame:
    """Per name the last copy that can be read; names without one are reported with a null pos, or an error if strict."""
    good = F.col("readable")
    found = copies.groupBy("name").agg(F.max(F.when(good, F.col("pos"))).alias("pos"), F.count_if(~good).alias("unreadable"), F.count("*").alias("copies"))
    return found.where(F.when(F.col("pos").isNotNull(), True).otherwise(F.raise_error(F.concat(F.lit("no copy can be read: "), "name")).cast("boolean"))) if strict else found
