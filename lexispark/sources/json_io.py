"""Glossaries and event streams as JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ws_trim
from ..schema import TERM

#: Fields of a glossary file, in both spellings that files use.
FIELDS = "source string, target string, category string, sourceKind string, source_kind string, enabled boolean, ambiguous boolean, wholeWord boolean, whole_word boolean, caseSensitive boolean, case_sensitive boolean, count long"


def glossary_terms(texts: DataFrame, column: str = "value") -> DataFrame:
    """Terms of glossary files, one JSON text `{"terms": [...]}` a row, with defaults for what is missing."""
    terms = F.from_json(F.col(column), f"terms array<struct<{FIELDS.replace(' ', ':')}>>".replace(",:", ", "))
    t = texts.select(F.posexplode(terms["terms"]).alias("pos", "t")).select(F.col("pos").cast("long"), "t.*")
    pick = lambda default, *names: F.coalesce(*[F.col(n) for n in names], F.lit(default))
    return t.where("source IS NOT NULL AND target IS NOT NULL").select(
        "pos", "source", "target", pick("name_or_title", "category").alias("category"), pick("", "sourceKind", "source_kind").alias("source_kind"), pick(True, "enabled").alias("enabled"),
        pick(False, "ambiguous").alias("ambiguous"), pick(True, "wholeWord", "whole_word").alias("whole_word"), pick(False, "caseSensitive", "case_sensitive").alias("case_sensitive"), pick(0, "count").alias("count"),
    )


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    return glossary_terms(spark.read.text(path, wholetext=True))


def glossary_json(terms: DataFrame) -> DataFrame:
    """One row: the glossary file of terms, in order; categories are not written."""
    term = F.struct("source", "target", F.col("source_kind").alias("sourceKind"), "enabled", "ambiguous", F.col("whole_word").alias("wholeWord"), F.col("case_sensitive").alias("caseSensitive"), "count")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", term.alias("t")))), lambda x: x["t"])
    return terms.agg(F.to_json(F.struct(ordered.alias("terms"))).alias("value"))


def event_json(kind: Column) -> Column:
    """An event row as JSON, without the fields that its type lacks."""
    return F.to_json(F.struct(kind.alias("type"), "entryId", "status", "text", "message", "total", "failed"))


def sse_deltas(bodies: DataFrame, column: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """pos and text of the deltas of server-sent events, one body a row. Columns of keep tell bodies apart. A last line
    without its end is unfinished, so it doesn't count."""
    lines = F.split(F.col(column), "\n")
    whole = F.slice(lines, F.lit(1), F.size(lines) - 1)
    return line_deltas(bodies.select(*keep, F.posexplode(whole).alias("pos", "line")), keep)


def line_deltas(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The deltas among whole lines (pos, line); lines of other kinds, broken ones and empty deltas don't count.
    A text is exploded from an array of its own, as a filter on it would parse each line a second time."""
    data = ws_trim(F.regexp_extract("line", r"(?s)^data: (.*?)\r*\z", 1))
    parsed = F.from_json(data, "choices array<struct<delta:struct<content:string>>>")
    found = F.get(parsed["choices"], F.lit(0))["delta"]["content"]
    rows = lines.where(F.startswith("line", F.lit("data: "))).where(data != "[DONE]")
    return rows.select(*keep, F.col("pos").cast("long"), F.explode(F.filter(F.array(found), lambda t: t != "")).alias("text"))


#: A small glossary to begin with; own terms.
SEED = [
    ("Ember Ward", "余烬结界", "spell"), ("Frost Lance", "霜矛", "spell"), ("Tide Caller", "唤潮者", "class"), ("Stone Warden", "石卫", "class"),
    ("Hill Folk", "丘民", "race"), ("Marsh Drake", "沼泽龙", "creature"), ("Old Harbour", "旧港", "location"), ("Saving Roll", "豁免掷骰", "mechanic"),
]
TERM_COLUMNS = ["pos", "source", "target", "category", "source_kind", "enabled", "ambiguous", "whole_word", "case_sensitive", "count"]


def seed(spark: SparkSession) -> DataFrame:
    """The terms of a glossary that nobody has edited; official, so they can't be deleted."""
    rows = [(i, s, t, c, "official", True, False, True, False, 0) for i, (s, t, c) in enumerate(SEED)]
    return spark.createDataFrame(rows, TERM)


def save_glossary(terms: DataFrame, folder: str) -> None:
    """A term a line, in as many files as there are partitions; categories are not written."""
    terms.select([c for c in TERM_COLUMNS if c != "category"]).write.mode("overwrite").json(folder)


def load_glossary(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of a saved glossary. If there is none, the seed, which is saved; if a line of it is no term, the seed."""
    try:
        rows = spark.read.schema(f"{TERM}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(folder)
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        return reset_glossary(spark, folder)
    broken = rows.select("pos", "source", "target", "_corrupt").where("_corrupt IS NOT NULL OR pos IS NULL OR source IS NULL OR target IS NULL")
    return rows.drop("_corrupt").fillna({"category": "name_or_title"}) if broken.isEmpty() else seed(spark)


def reset_glossary(spark: SparkSession, folder: str) -> DataFrame:
    """The seed, saved in place of what was there."""
    save_glossary(seed(spark), folder)
    return seed(spark)
