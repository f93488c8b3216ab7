"""Folders that tasks list and files that tasks read: the driver holds neither names nor contents."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import staged
from .streams import batched, place, standing

#: What a small file costs beside its bytes, of the bytes of a task that reads files; and those of one task, about.
OPEN_BYTES, TASK_BYTES = 64 << 10, 128 << 20


def kind_of(path: str) -> fs.FileType:
    """What stands at a path; Unknown in a store that only Spark's readers open."""
    try:
        system, at = place(path)
        return system.get_file_info(at).type
    except (ValueError, OSError):
        return fs.FileType.Unknown


def files_below(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(name, length): every file below a folder, or in it alone, named from there on; also empty and hidden ones.
    Folders that can't be read are skipped. Each level of folders is dealt over tasks, which stream out what they find."""
    if kind_of(folder) != fs.FileType.Directory:
        raise FileNotFoundError(folder)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = place(folder.rstrip("/"))
        names = (name for batch in batches for name in batch["name"])
        found = ((f"{name}/{own}".lstrip("/"), *more) for name in names for own, *more in standing(system, f"{root}/{name}"))
        yield from batched(found, ["name", "is_folder", "length"], 0)

    levels, todo, n = [], spark.range(0, 1, 1, 1).select(F.lit("").alias("name")), 1
    while n and (recursive or not levels):
        spread = todo.repartition(min(n, 4 * spark.sparkContext.defaultParallelism), "name")
        levels.append(staged(spread.mapInPandas(each, "name string, is_folder boolean, length long")))
        todo = levels[-1].where("is_folder").select("name")
        n = todo.count()
    return reduce(DataFrame.union, levels).where("NOT is_folder").select("name", "length")


def dealt(files: DataFrame, size: Column) -> DataFrame:
    """files (name) over as many tasks as their bytes need, and all cores."""
    total = files.agg(F.coalesce(F.sum(size + OPEN_BYTES), F.lit(0)).alias("n")).first()["n"]
    return files.repartition(max(total // TASK_BYTES + 1, files.sparkSession.sparkContext.defaultParallelism), "name")


def with_content(files: DataFrame, folder: str) -> DataFrame:
    """(name, length, content) of files (name, length) of a folder, in frames of bounded bytes; those that are gone
    meanwhile are left out."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = place(folder.rstrip("/"))

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for name in batch["name"]:
                    try:
                        with system.open_input_file(f"{root}/{name}") as file:
                            content = file.read()
                    except FileNotFoundError:
                        continue
                    yield name, len(content), content

        yield from batched(rows(), ["name", "length", "content"], 2)

    return dealt(files, F.col("length")).select("name").mapInPandas(each, "name string, length long, content binary")
