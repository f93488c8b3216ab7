"""Line dedup: hashes of lines in levelled sorted runs, to which batches of documents are added.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased; it stands for its 128-bit XXH3 hash
(of n keys two share one with a probability under n^2 / 2^129). A run is a table of (key, docs: documents that hold it,
top: the id of the first of them), bucketed and sorted by key. A new batch's keys are counted, merge-anti-joined with
every run (keys that a run already found in enough documents need no more counting), and what is left becomes a run of
level 0. When a level has FAN runs they are merged into one of a higher level, so a key lies in few runs and is
rewritten a logarithmic number of times. A run's name says which batches it covers; a run that isn't whole, or that a
merged one covers, is passed over, so a job that was cut off goes on where it was.

Documents count in the order of batches, and within a batch by id, the largest first (null last). A key of at least
LEAST_CHARS code points that is found in at least LEAST_DOCS documents loses its lines in all but the first; rows of one
id in one batch are documents of their own, but keep or lose a line together. Null or empty texts are one empty line.
Texts are taken whole, of any length, and split where they lie; a key that a third of all documents hold is counted
before anything is shuffled, and looked up in a broadcast table of at most MOST_HOT rows. An empty table gives an empty
result. Other columns pass through dedup_lines(), whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, NumericType, StructField, StructType

from .common import bounded_batches, marked, new_path, partitions, scratch, staged, text_bytes
from .packing import giving_back

LEAST_CHARS, LEAST_DOCS = 20, 3
#: Batches that a whole table is taken in, and runs of a level that are merged.
BATCHES, FAN = 6, 2
#: A key in more than one of MOST_HOT of all lines is hot: there can't be more of them.
MOST_HOT = 4096


def line_key(line: bytes) -> bytes:
    return line.strip().lower()  # ASCII white space and letters only, as these are bytes


def is_long(key: bytes, least: int = LEAST_CHARS) -> bool:
    """At least so many code points."""
    return len(key) >= least and (len(key) >= 4 * least or sum(b & 0xC0 != 0x80 for b in key) >= least)


def keys_of(text: bytes, least: int) -> set[bytes]:
    """Hashes of the keys that are long enough, each once."""
    return {xxhash.xxh3_128_digest(k) for k in {line_key(x) for x in text.split(b"\n")} if is_long(k, least)}


def line_keys(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, key) for each document and key in it."""
    bounded_batches(docs.sparkSession)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [keys_of(t.as_py(), least) for t in batch.column(1)]
            at = pa.array([i for i, own in enumerate(keys) for _ in own], pa.int64())
            yield pa.record_batch({"doc_id": batch.column(0).take(at), "key": pa.array([k for own in keys for k in own], pa.binary())})

    return docs.select("doc_id", text_bytes()).mapInArrow(giving_back(found), StructType([docs.schema["doc_id"], StructField("key", BinaryType())]))


class LineRuns:
    """The runs in a folder that all executors share; opening a folder again finds them."""

    def __init__(self, spark: SparkSession, folder: str, ident: str, least_docs: int = LEAST_DOCS, fan: int = FAN):
        self.spark, self.folder, self.least_docs, self.fan = spark, folder, least_docs, fan
        self.schema = f"key binary, docs bigint, batch bigint, top {ident}"
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self.fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(place)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def runs(self) -> list[tuple[int, int, int, int]]:
        """(level, first batch, last batch, buckets) of the runs that count, the oldest first."""
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(""))]
        whole = [tuple(map(int, m.groups())) for n in names if (m := re.fullmatch(r"level(\d+)-(\d+)-(\d+)-(\d+)", n)) and self.fs.exists(self._path(f"{n}/_SUCCESS"))]
        return sorted((r for r in whole if not any(o[0] > r[0] and o[1] <= r[1] and r[2] <= o[2] for o in whole)), key=lambda r: r[1])

    def read(self, run: tuple[int, int, int, int]) -> DataFrame:
        """A run as a table that Spark knows to be bucketed, so that joins take it as it lies."""
        name = self._table(run)
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({self.schema}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {run[3]} BUCKETS LOCATION '{self.folder}/{self._name(run)}'")
        return self.spark.table(name)

    def add(self, keys: DataFrame, batch: int) -> None:
        """Add a batch's (doc_id, key) rows, one for each document and key; batches are numbered as they come."""
        new = keys.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.lit(batch).cast("bigint").alias("batch"), F.max("doc_id").alias("top"))
        for run in self.runs():
            settled = self.read(run).where(F.col("docs") >= self.least_docs).select("key")
            new = new.join(settled.hint("merge"), "key", "left_anti")
        self._write(new, (0, batch, batch))
        self.compact()

    def compact(self, fan: int | None = None) -> None:
        """Merge the runs of each level that has enough of them."""
        level, fan = 0, fan or self.fan
        while level <= max((r[0] for r in self.runs()), default=-1):
            own = [r for r in self.runs() if r[0] == level]
            if len(own) >= fan:
                self._merge(own, level + 1)
            level += 1

    def whole(self) -> DataFrame:
        """All runs merged into one."""
        runs = self.runs()
        if len(runs) > 1:
            self._merge(runs, 1 + max(r[0] for r in runs))
        return self.read(self.runs()[0])

    def _merge(self, runs: list[tuple[int, int, int, int]], level: int) -> None:
        """Merge runs, the oldest first, by merge joins of their buckets as they lie: nothing is shuffled."""
        while len(runs) > 1:
            old, new = self.read(runs[0]).alias("old"), self.read(runs[1]).alias("new")
            both = old.hint("merge").join(new, "key", "full_outer")
            docs = F.coalesce("old.docs", F.lit(0)) + F.coalesce("new.docs", F.lit(0))
            top = F.when(F.col("old.batch").isNotNull(), F.col("old.top")).otherwise(F.col("new.top"))
            merged = (level, runs[0][1], runs[1][2])
            self._write(both.select("key", docs.alias("docs"), F.least("old.batch", "new.batch").alias("batch"), top.alias("top")), merged)
            for run in runs[:2]:
                self._forget(run)
            runs = [r for r in self.runs() if r[1] == merged[1]] + runs[2:]
            level += 1

    def _write(self, rows: DataFrame, covers: tuple[int, int, int]) -> None:
        run = (*covers, partitions(self.spark))
        self.fs.delete(self._path(self._name(run)), True)  # what a job that was cut off left
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(run)}")
        writer = rows.select("key", "docs", "batch", "top").write.format("parquet").option("path", f"{self.folder}/{self._name(run)}")
        writer.bucketBy(run[3], "key").sortBy("key").saveAsTable(self._table(run))

    def _forget(self, run: tuple[int, int, int, int]) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(run)}")
        self.fs.delete(self._path(self._name(run)), True)

    def close(self) -> None:
        """Take the tables out of the session's catalog; the folder stays."""
        for run in self.runs():
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(run)}")

    @staticmethod
    def _name(run: tuple[int, int, int, int]) -> str:
        return "level{}-{}-{}-{}".format(*run)

    def _table(self, run: tuple[int, int, int, int]) -> str:
        return f"lines_{xxhash.xxh3_64_hexdigest(self.folder)}_{'_'.join(map(str, run))}"


def batch_borders(keys: DataFrame, batches: int) -> list:
    """Ids that deal the rows into ranges of about the same size; ids that aren't numbers are one range."""
    if not isinstance(keys.schema["doc_id"].dataType, NumericType) or batches < 2:
        return []
    found = keys.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0]
    return sorted(set(found or []))


def lost_lines(keys: DataFrame, frequent: DataFrame) -> DataFrame:
    """(doc_id, key) of the lines that go: those of frequent keys (key, docs, top) outside their first document."""
    lines = keys.count()
    hot = F.broadcast(frequent.where(F.col("docs") * MOST_HOT > lines))
    cold = frequent.where(F.col("docs") * MOST_HOT <= lines)
    rest = keys.join(hot.select("key"), "key", "left_anti")
    elsewhere = ~F.col("doc_id").eqNullSafe(F.col("top"))
    return keys.join(hot, "key").where(elsewhere).select("doc_id", "key").union(rest.join(cold, "key").where(elsewhere).select("doc_id", "key"))


def without(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """row, n_lines, n_dropped and kept (bytes): docs without the lines lost (doc_id, key). Only rows whose ids may lose
    lines are shuffled."""
    bounded_batches(docs.sparkSession)
    by_doc = lost.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("key").alias("keys"))
    rows, unsure = marked(docs, lost.select("doc_id"), "doc_id")

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, keys in zip(batch.column(1), batch.column(2), strict=True):
                lines, gone = text.as_py().split(b"\n"), set(keys.as_py() or ())
                stay = [x for x in lines if xxhash.xxh3_128_digest(line_key(x)) not in gone] if gone else lines
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                kept.append(b"\n".join(stay))
            yield pa.record_batch({"row": batch.column(0), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64()), "kept": pa.array(kept, pa.binary())})

    schema = StructType([StructField("row", docs.schema), StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("kept", BinaryType())])
    meet = rows.where(unsure).select("row").join(by_doc, F.col("row.doc_id").eqNullSafe(F.col("id")), "left").select("row", "keys")
    every = rows.where(~unsure).select("row", F.lit(None).cast("array<binary>").alias("keys")).union(meet)
    return every.select("row", text_bytes("row.text").alias("text"), "keys").mapInArrow(giving_back(rewritten), schema)


def _deduped(docs: DataFrame, least_chars: int, least_docs: int, batches: int, folder: str) -> DataFrame:
    spark = docs.sparkSession
    keys = staged(line_keys(docs, least_chars), "line-keys", under=folder)
    borders = batch_borders(keys, batches)
    number = sum((F.coalesce(F.col("doc_id") <= F.lit(b), F.lit(True)).cast("int") for b in borders), F.lit(0))
    keys = staged(keys.withColumn("batch", number), "batches", "batch", under=folder)
    runs = LineRuns(spark, new_path(spark, "runs", folder), docs.schema["doc_id"].dataType.simpleString(), least_docs)
    for batch in range(len(borders) + 1):
        runs.add(keys.where(F.col("batch") == batch).drop("batch"), batch)
    frequent = staged(runs.whole().where(F.col("docs") >= least_docs), "frequent", under=folder)
    runs.close()
    return without(docs, staged(lost_lines(keys.drop("batch"), frequent), "lost", under=folder))


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES) -> DataFrame:
    """docs with the lines that stay as their texts; those that lose none keep theirs, null too."""
    with scratch(docs.sparkSession, "line-dedup") as folder:
        rows = _deduped(docs, least_chars, least_docs, batches, folder)
        text = F.when(F.col("n_dropped") > 0, F.col("kept").cast("string")).otherwise(F.col("row.text"))
        return staged(rows.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]), "deduped")


def dedup_report(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_lines, n_dropped, and the sha256 of what stays."""
    with scratch(docs.sparkSession, "line-dedup") as folder:
        rows = _deduped(docs.select("doc_id", "text"), least_chars, least_docs, batches, folder)
        return staged(rows.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")), "deduped")
