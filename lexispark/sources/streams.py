"""Files that tasks stream out piece by piece."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from ..staging import staged


#: Rows and bytes of a frame that a task takes or gives back.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def batched(rows: Iterable[tuple], columns: list[str], content: int) -> Iterator[pd.DataFrame]:
    """rows in frames of bounded numbers and bytes, so that neither one row nor all of them make a frame; content is the
    place of what their size is in, bytes or text."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[content] or b"")
        if size > BATCH_BYTES or len(held) == BATCH_ROWS:
            yield pd.DataFrame(held, columns=columns, dtype=object)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns, dtype=object)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Tasks in Python take batches of as many rows and bytes at most; afterwards the session has its own settings again."""
    own = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {name: spark.conf.get(name) for name in own}
    for name, value in own.items():
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, as Spark gives it (file:/x for file:///x)."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def standing(system: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int]]:
    """Name, whether it is a folder, and bytes of what stands in a folder; nothing if that can't be read. A local folder
    is read as a stream, so millions of files are never held."""
    if not isinstance(system, fs.LocalFileSystem):
        try:
            found = system.get_file_info(fs.FileSelector(folder.rstrip("/")))
        except OSError:
            return
        yield from ((x.base_name, x.type == fs.FileType.Directory, x.size or 0) for x in found)
        return
    try:
        found = os.scandir(folder)
    except OSError:
        return
    with found:
        for x in found:
            try:
                if x.is_dir() or x.is_file():
                    yield x.name, x.is_dir(), 0 if x.is_dir() else x.stat().st_size
            except OSError:  # gone meanwhile
                continue


class Growing:
    """A file under a name of its own until it is closed; then it has its path, whole."""

    def __init__(self, path: str, job: str):
        self.system, self.path = place(path)
        self.own, self.size = f"{self.path}.{uuid.uuid4().hex}.{job}", 0
        self.system.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.system.open_output_stream(self.own)

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.system.move(self.own, self.path)

    def drop(self) -> None:
        self.out.close()
        self.system.delete_file(self.own)


def sweep(folder: str, job: str) -> None:
    """Takes away what lost tasks of a job had begun."""
    system, root = place(folder)

    def begun(folder: str) -> Iterator[str]:
        for name, is_folder, _ in standing(system, folder):
            if is_folder:
                yield from begun(f"{folder}/{name}")
            elif name.endswith(job):
                yield f"{folder}/{name}"

    for path in list(begun(root)):
        system.delete_file(path)


def write_streams(pieces: DataFrame, order: list[str], folder: str, head: str = "", between: str = "", tail: str = "") -> DataFrame:
    """A file folder/name of each name's pieces (name, piece and the columns of order), in order. Returns the staged list
    of what was written: path, pieces and bytes. A file appears whole under its name, so tasks may run again."""
    job = f"{uuid.uuid4().hex}.part"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, name, many, done = None, None, 0, []

        def close() -> None:
            nonlocal file
            file.write(tail.encode())
            file.close()
            done.append((f"{folder}/{name}", many, file.size))
            file = None

        try:
            for batch in batches:
                for own, piece in zip(batch["name"], batch["piece"]):
                    if file is None or own != name:
                        if file:
                            close()
                        file, name, many = Growing(f"{folder}/{own}", job), own, 0
                    file.write(((between if many else head) + piece).encode())
                    many += 1
            if file:
                close()
        except BaseException:
            if file:
                file.drop()
            raise
        yield pd.DataFrame(done, columns=["path", "pieces", "bytes"])

    dealt = pieces.repartition("name").sortWithinPartitions("name", *order).select("name", "piece")
    try:
        with small_batches(pieces.sparkSession):
            return staged(dealt.mapInPandas(write, "path string, pieces long, bytes long"))
    finally:
        sweep(folder, job)
