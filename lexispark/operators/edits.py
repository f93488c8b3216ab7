"""Glossary edits as a log: appended with sequence numbers, folded into the terms they were made on, and compacted.

Edits are rows (seq, kind, source, new_source, new_target): add (new_source, new_target) replaces the first term of
that source in its place, or comes last; update replaces the first term of source, which may get another; delete takes
away all terms of source, unless the first is official; reset puts the seed in the place of all. Edits that a list
would refuse (blank texts, sources that no term has, official terms) change nothing. What replaces or adds is a user's
term, also in an official one's place.

Sources that no update links with another are folded by aggregates alone. The others are sequential by nature: sources
that updates link, directly or not, are one group, whose edits are gone through in order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ws_trim
from ..staging import scratch, staged

EDIT = "seq long, kind string, source string, new_source string, new_target string"
TERMS = "pos long, source string, target string, source_kind string"
#: What the places of added terms begin with: after all that were there, in the order of their edits.
ADDED = 1 << 48
#: Kinds of terms: those of the seed, and those that a user made.
OFFICIAL, USER = "official", "user"


def _since_reset(terms: DataFrame, edits: DataFrame, seed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The terms that the last reset leaves, and the edits after it."""
    last = edits.agg(F.max(F.when(F.col("kind") == "reset", F.col("seq"))).alias("reset"))  # one row
    columns = ["pos", "source", "target", "source_kind"]
    both = terms.select(*columns, F.lit(False).alias("seeded")).union(seed.select(*columns, F.lit(True)))
    kept = both.join(last, F.col("seeded") == F.col("reset").isNotNull()).select(*columns)
    return kept, edits.join(last, F.col("seq") > F.coalesce("reset", F.lit(-1).cast("long"))).drop("reset").where("kind <> 'reset'")


def _groups(links: DataFrame, under: str) -> DataFrame:
    """(source, name): sources that links (a, b) connect have one name. Each round takes the least name beside, and the
    name that this one has by now."""
    both = staged(links.union(links.select("b", "a")).union(links.select("a", "a")).distinct(), under)
    names = both.select(F.col("a").alias("source")).distinct().withColumn("name", F.col("source"))
    while True:
        near = staged(both.join(names, F.col("b") == F.col("source")).groupBy("a").agg(F.min("name").alias("name")), under)
        far = near.select(F.col("a").alias("at"), F.col("name").alias("its"))
        after = staged(near.join(far, F.col("name") == F.col("at")).select(F.col("a").alias("source"), F.least("name", "its").alias("name")), under)
        if names.join(after.withColumnRenamed("name", "new"), "source").where("name <> new").isEmpty():
            return after
        names = after


def _fold_apart(terms: DataFrame, edits: DataFrame) -> DataFrame:
    """Terms of sources that no update touches."""
    adds = edits.where("kind = 'add'").groupBy(F.col("new_source").alias("source")).agg(F.min("seq").alias("first_add"))
    firsts = terms.groupBy("source").agg(F.min("pos").alias("first"), F.min_by(F.coalesce("source_kind", F.lit("")), "pos").alias("first_kind"))
    known = adds.join(firsts, "source", "full_outer")
    # a delete of an official term holds once an add has replaced it; one of nothing changes nothing
    holds = (F.coalesce("first_kind", F.lit("")) != OFFICIAL) | (F.col("seq") > F.coalesce("first_add", F.lit(ADDED)))
    gone = edits.where("kind = 'delete'").select("source", "seq").join(known, "source").where(holds).groupBy("source").agg(F.max("seq").alias("gone"))
    told = edits.where("kind = 'add'").select(F.col("new_source").alias("source"), "seq", F.col("new_target")).join(gone, "source", "left").where("gone IS NULL OR seq > gone")
    told = told.groupBy("source").agg(F.min("seq").alias("since"), F.max_by("new_target", "seq").alias("last"))
    about = known.select("source", "first").join(gone, "source", "left").join(told, "source", "left")
    kept = terms.join(about, "source").where("gone IS NULL")
    hit = (F.col("pos") == F.col("first")) & F.col("last").isNotNull()
    kept = kept.select("pos", "source", F.when(hit, F.col("last")).otherwise(F.col("target")).alias("target"), F.when(hit, USER).otherwise(F.col("source_kind")).alias("source_kind"))
    added = about.where("last IS NOT NULL AND (first IS NULL OR gone IS NOT NULL)")
    return kept.union(added.select((F.lit(ADDED) + F.col("since")).alias("pos"), "source", F.col("last").alias("target"), F.lit(USER).alias("source_kind")))


def _fold_linked(rows: pd.DataFrame) -> pd.DataFrame:
    """One group's terms and edits, in order."""
    is_term = rows["kind"] == "term"
    terms = [[r.seq, r.source, r.new_target, r.source_kind] for r in rows[is_term].sort_values("seq").itertuples()]

    def first(source: str) -> int | None:
        return next((i for i, t in enumerate(terms) if t[1] == source), None)

    for e in rows[~is_term].sort_values("seq").itertuples():
        at = first(e.new_source if e.kind == "add" else e.source)
        if e.kind == "delete":
            if at is not None and terms[at][3] != OFFICIAL:
                terms = [t for t in terms if t[1] != e.source]
        elif at is not None:
            terms[at][1:] = [e.new_source, e.new_target, USER]
        elif e.kind == "add":
            terms.append([ADDED + e.seq, e.new_source, e.new_target, USER])
    return pd.DataFrame(terms, columns=["pos", "source", "target", "source_kind"])


def fold(terms: DataFrame, edits: DataFrame, seed: DataFrame) -> DataFrame:
    """The terms (pos, source, target, source_kind) after the edits, a staged table."""
    fine = (F.col("kind").isin("delete", "reset")) | ((ws_trim("new_source") != "") & (ws_trim("new_target") != ""))
    with scratch(terms.sparkSession) as under:
        base, log = (staged(x, under) for x in _since_reset(terms, edits.where(fine), seed))
        names = _groups(log.where("kind = 'update'").select(F.col("source").alias("a"), F.col("new_source").alias("b")).distinct(), under)
        key = F.when(F.col("kind") == "add", F.col("new_source")).otherwise(F.col("source"))
        keyed = log.withColumn("key", key).join(names.select(F.col("source").alias("key"), "name"), "key", "left").drop("key")
        named = base.join(names, "source", "left")
        apart = _fold_apart(named.where("name IS NULL").drop("name"), keyed.where("name IS NULL").drop("name"))
        as_edits = named.where("name IS NOT NULL").select("name", F.col("pos").alias("seq"), F.lit("term").alias("kind"), "source", F.lit(None).cast("string").alias("new_source"), F.col("target").alias("new_target"), "source_kind")
        linked = as_edits.unionByName(keyed.where("name IS NOT NULL").withColumn("source_kind", F.lit(None).cast("string")))
        return staged(apart.unionByName(linked.groupBy("name").applyInPandas(_fold_linked, TERMS)))


class GlossaryLog:
    """A glossary in a folder that all executors share: terms as they were after some edit, and the edits since."""

    def __init__(self, spark: SparkSession, folder: str, seed: DataFrame):
        self.spark, self.folder, self.seed = spark, folder.rstrip("/"), seed
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        if not self._bases():
            seed.select("pos", "source", "target", "source_kind").write.mode("overwrite").parquet(f"{self.folder}/terms--1")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _bases(self) -> list[int]:
        """The edits up to which whole tables of terms have been written."""
        if not self.fs.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(""))]
        return sorted(int(n.removeprefix("terms-")) for n in names if n.startswith("terms-") and self.fs.exists(self._path(f"{n}/_SUCCESS")))

    def append(self, edits: DataFrame) -> None:
        """Edits with numbers above all before."""
        edits.select(*[c.split()[0] for c in EDIT.split(", ")]).write.mode("append").parquet(f"{self.folder}/edits")

    def _pending(self, since: int) -> DataFrame:
        found = self.spark.read.schema(EDIT).parquet(f"{self.folder}/edits") if self.fs.exists(self._path("edits")) else self.spark.createDataFrame([], EDIT)
        return found.where(F.col("seq") > since)

    def terms(self) -> DataFrame:
        since = self._bases()[-1]
        base = self.spark.read.schema(TERMS).parquet(f"{self.folder}/terms-{since}")
        return fold(base, self._pending(since), self.seed)

    def compact(self) -> None:
        """Write the terms of now; edits up to here count no more. One that is cut off leaves the old ones in force."""
        bases = self._bases()
        last = self._pending(bases[-1]).agg(F.max("seq")).first()[0]
        if last is None:
            return
        self.terms().write.mode("overwrite").parquet(f"{self.folder}/terms-{last}")
        for old in bases:
            self.fs.delete(self._path(f"terms-{old}"), True)
