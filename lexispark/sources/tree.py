"""Files of a table written below a folder, and which writer an entry's file has."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.files import file_kind, safe_or_error, target_path
from ..staging import staged
from . import archive
from .contentlist import written_lsx, written_xml
from .streams import batched, place, small_batches, standing


def written(files: DataFrame, entries: DataFrame, retarget: bool = False) -> DataFrame:
    """(name, content) of the files of entries: contentList files anew, LSX files from files (name, content) with the
    targets put in place. Other kinds are not written. With retarget, names are those of the target language."""
    kind = file_kind(F.col("source_file"))
    xml = written_xml(entries.where(kind == "localization-xml")).select(F.col("source_file").alias("name"), F.col("content").cast("binary").alias("content"))
    own = entries.where(kind == "metadata-lsx")
    originals = files.where(file_kind(F.col("name")) == "metadata-lsx").join(own.select(F.col("source_file").alias("name")).distinct(), "name", "left_semi")
    out = xml.union(written_lsx(originals, own))
    return out.withColumn("name", target_path(F.col("name"))) if retarget else out


def _put(files: DataFrame, folder: str, chosen: Callable[[Iterator[tuple]], Iterator[tuple[str, bytes]]]) -> DataFrame:
    """Files that are chosen of a partition's rows, below folder; see write_tree."""
    system, root = place(folder.rstrip("/"))
    job = f"{root}/{uuid.uuid4().hex}.part"  # a task's file there says what it may have begun
    system.create_dir(job, recursive=True)

    def written(rows: Iterator[tuple]) -> Iterator[tuple[str, int]]:
        system, task, parent = place(folder)[0], f"{uuid.uuid4().hex}.part", None
        for name, content in chosen(rows):
            path = f"{root}/{name}"
            if parent != (parent := path.rpartition("/")[0]):
                own = f"{parent}/{task}"  # not in the job's folder: names that change folders are changed one at a time
                system.create_dir(parent, recursive=True)
                with system.open_output_stream(f"{job}/{task}", compression=None) as out:
                    out.write(own.encode())
            with system.open_output_stream(own, compression=None) as out:
                out.write(content)
            system.move(own, path)
            yield name, len(content)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from batched(written(row for batch in batches for row in batch.itertuples(index=False, name=None)), ["name", "size"], 0)

    try:
        with small_batches(files.sparkSession):
            return staged(files.withColumn("name", safe_or_error(F.col("name"))).mapInPandas(each, "name string, size long"))
    finally:
        for task, *_ in standing(system, job):
            with system.open_input_file(f"{job}/{task}") as file:
                own = file.read().decode()
            if system.get_file_info(own).type == fs.FileType.File:
                system.delete_file(own)
        system.delete_dir(job)


def write_tree(files: DataFrame, folder: str) -> DataFrame:
    """Files (name, content) written below folder, which all executors share. Returns the staged list of what was
    written: name and size. Each file appears whole under its name, so tasks may run again; what failed or lost ones
    had begun goes when the job has ended. An unsafe name is an error."""
    return _put(files.where("content IS NOT NULL").select("name", "content"), folder, lambda rows: rows)


def _last_readable(rows: Iterator[tuple]) -> Iterator[tuple[str, bytes]]:
    """The first row of each name, of rows (name, content, readable) sorted by name, the last that can be read first."""
    last = None
    for name, content, readable, *_ in rows:
        if name != last:
            if not readable:
                raise ValueError(f"no copy can be read: {name}")
            last = name
            yield name, content


def extract(members: DataFrame, folder: str) -> DataFrame:
    """Members of archives written below folder: of copies of a name the last that can be read, by pos and then archive.
    Names without one are an error once all copies of it failed. Members are read once, dealt by name and sorted."""
    order = [c for c in ("readable", "pos", "archive") if c in members.columns]
    return _put(members.select("name", "content", *order).repartition("name").sortWithinPartitions("name", *map(F.desc, order)), folder, _last_readable)


def extract_archives(spark: SparkSession, path: str, folder: str, strict: bool = False) -> DataFrame:
    """extract() of the zip archives at path, where the last copy is that of the last archive. A member is read by the task
    that writes it, so no content goes through an exchange, and copies before the last that can be read are not read."""
    return _put(archive.copies(spark, path, strict), folder, archive.last_readable)
