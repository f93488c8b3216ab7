"""Functions of file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized_path(x: Column) -> Column:
    return F.replace(x, F.lit("\\"), F.lit("/"))


def file_kind(path: Column) -> Column:
    p = F.lower(path)
    return (
        F.when(p.endswith(".xml") & p.contains("localization"), "localization-xml").when(p.endswith(".loca"), "localization-loca").when(p.endswith(".lsx"), "metadata-lsx")
        .when(p.endswith(".lua"), "script-lua").when(p.endswith(".txt"), "data-txt").otherwise("other")
    )


def segments(path: Column) -> Column:
    return F.filter(F.split(normalized_path(path), "/"), lambda s: s != "")


def language(path: Column) -> Column:
    """The folder after the first localization folder; null if there is none."""
    parts = segments(path)
    at = F.array_position(F.transform(parts, F.lower), "localization")
    return F.when((at > 0) & (F.size(parts) > at + 1), F.get(parts, at.cast("int")))


def short_source(path: Column) -> Column:
    """The last two parts of a path of more than two."""
    parts = segments(path)
    return F.when(F.size(parts) > 2, F.array_join(F.slice(parts, -2, 2), "/")).otherwise(path)


def target_path(path: Column, language: str = "Chinese") -> Column:
    """With the part after the first localization folder replaced, if at least two parts follow that folder."""
    parts = F.split(path, "/")
    at = F.array_position(F.transform(parts, F.lower), "localization").cast("int")
    swapped = F.transform(parts, lambda s, i: F.when(i == at, F.lit(language)).otherwise(s))
    return F.when((at > 0) & (F.size(parts) - at >= 2), F.array_join(swapped, "/")).otherwise(path)


def write_priority(language: Column) -> Column:
    return F.when(language == "English", 3).when(language.isin("Chinese", "ChineseSimplified"), 2).otherwise(1)


def is_safe(path: Column) -> Column:
    """Relative, without parent folders or drives."""
    p = normalized_path(path)
    return ~p.rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|\z)")


def safe_or_error(path: Column) -> Column:
    return F.when(is_safe(path), path).otherwise(F.raise_error(F.concat(F.lit("unsafe path: "), path)).cast("string"))


def is_archive(path: Column) -> Column:
    return path.rlike(r"(?i)\.(pak|zip)\z")


def output_name(path: Column) -> Column:
    base = F.element_at(segments(path), -1)
    return F.concat(F.regexp_replace(base, r"(?i)\.(pak|zip)\z", ""), F.lit("_zh.pak"))


def folders(path: Column) -> Column:
    """All folders above a file."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))
