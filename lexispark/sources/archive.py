"""Zip archives of mod files as tables: listing, extraction and repacking. No archive is ever one value or in one batch."""

from __future__ import annotations

import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.files import file_kind, is_safe, language, normalized_path, safe_or_error
from ..staging import staged
from . import folders
from .streams import Growing, batched, place, small_batches, sweep

#: Bytes of members that one task reads, about.
RANGE_BYTES = 32 << 20
#: Fixed values of the zip format: signatures, versions, methods, flags, the local header's length.
LOCAL, CENTRAL, END, END_64, LOCATOR_64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
PLAIN, DEFLATED, VERSION, VERSION_64, UTF8_NAME, ENCRYPTED, LOCAL_BYTES, MOST_32, MOST_16 = 0, 8, 20, 45, 0x800, 1, 30, 0xFFFFFFFF, 0xFFFF
EPOCH = 33  # 1980-01-01 in the format's date
DIRECTORY = "archive string, pos long, name string, size long, packed long, crc long, method int, encrypted boolean, offset long, error string"


def directory(archives: DataFrame) -> DataFrame:
    """A row for each member of archives (path): what its archive's directory says, with nothing but the directory read.
    An archive that can't be opened is one row with an error and no name."""

    def members(path: str) -> Iterator[tuple]:
        system, at = place(path)
        try:
            with system.open_input_file(at) as file, zipfile.ZipFile(file) as z:  # reads the end and the directory
                found = z.infolist()
        except (zipfile.BadZipFile, NotImplementedError, ValueError, OSError) as fault:
            yield path, -1, None, None, None, None, None, None, None, f"archive: {fault}"
            return
        for i, m in enumerate(found):
            if not m.is_dir():
                yield path, i, m.filename, m.file_size, m.compress_size, m.CRC, m.compress_type, bool(m.flag_bits & ENCRYPTED), m.header_offset, None

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paths = (path for batch in batches for path in batch["path"])
        yield from batched((row for path in paths for row in members(path)), [c.split()[0] for c in DIRECTORY.split(", ")], 2)

    return archives.select("path").mapInPandas(listed, DIRECTORY)


class Place(NamedTuple):
    """Where a member stands in its archive, and how."""

    size: int
    packed: int
    crc: int
    method: int
    encrypted: int
    offset: int


def _member(file: pa.NativeFile, m: object) -> bytes:
    """A member's bytes, by two reads of their ranges."""
    if m.encrypted or m.method not in (PLAIN, DEFLATED):
        raise ValueError("encrypted" if m.encrypted else f"method {m.method}")
    file.seek(m.offset)
    head = file.read(LOCAL_BYTES)
    if len(head) < LOCAL_BYTES or struct.unpack("<I", head[:4])[0] != LOCAL:
        raise ValueError("no member there")
    name_bytes, extra_bytes = struct.unpack("<HH", head[26:30])
    file.seek(m.offset + LOCAL_BYTES + name_bytes + extra_bytes)
    data = file.read(m.packed)
    if m.method == DEFLATED:
        machine = zlib.decompressobj(-15)
        data = machine.decompress(data, m.size + 1)  # no more than was said, whatever the bytes hold
    if len(data) != m.size or zlib.crc32(data) != m.crc:
        raise ValueError("damaged")
    return data


def contents(members: DataFrame) -> DataFrame:
    """Rows of a directory with their content, and an error where it can't be read. Ranges of members are dealt over
    tasks by their bytes, so one archive is read by many and a task holds one member at a time."""
    members = staged(members)
    span = F.floor(F.col("offset") / RANGE_BYTES)
    ranges = members.select(F.coalesce(F.sum("packed"), F.lit(0)).alias("n")).first()["n"] // RANGE_BYTES + 1
    dealt = members.repartition(max(ranges, 1), "archive", span) if ranges > 1 else members

    def rows(batch: pd.DataFrame) -> Iterator[tuple]:
        for path, own in batch.sort_values(["archive", "offset"]).groupby("archive", sort=False):
            system, at = place(path)
            file = None
            for m in own.itertuples(index=False):
                content, error = None, m.error
                if m.name is not None:
                    try:
                        file = file or system.open_input_file(at)
                        content = _member(file, m)
                    except (ValueError, OSError, zlib.error) as fault:
                        error = f"member: {fault}"
                yield m.archive, m.pos, m.name, m.size, content, error
            if file:
                file.close()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            whole = batch.astype({c: "Int64" for c in ("size", "packed", "crc", "method", "offset")})  # floats beside a broken archive's nulls
            batch = whole.astype(object).where(batch.notna(), None)
            yield from batched(rows(batch), ["archive", "pos", "name", "size", "content", "error"], 4)

    return dealt.mapInPandas(read, "archive string, pos long, name string, size long, content binary, error string")


def _paths(spark: SparkSession, path: str) -> DataFrame:
    """path of each archive. A folder is listed by tasks, other paths by Spark's reader on the driver."""
    if folders.kind_of(path) != FileType.Directory:
        return spark.read.format("binaryFile").load(path).select("path")
    path = path.rstrip("/") if "://" in path and not path.startswith("file:") else "file:" + place(path)[1].rstrip("/")
    own = folders.files_below(spark, path, recursive=False).where(~F.col("name").rlike("^[_.]"))
    return folders.dealt(own, F.lit(0)).select(F.concat(F.lit(f"{path}/"), "name").alias("path"))


def read_archives(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """A row for each member of the zip archives at path: archive, pos, name, size, kind, language, content, readable and error.

    Members whose paths leave the archive are left out, or an error if strict. Those that can't be read have no content;
    an archive that can't be opened is one such row, with an empty name. Of a folder all files are taken but hidden ones.
    """
    named = _safely_named(contents(directory(_paths(spark, path))), strict)
    return named.withColumns({"kind": file_kind(F.col("name")), "language": language(F.col("name")), "readable": F.col("content").isNotNull()})


def _safely_named(members: DataFrame, strict: bool) -> DataFrame:
    named = members.withColumn("name", normalized_path(F.coalesce("name", F.lit(""))))
    return named.withColumn("name", safe_or_error(F.col("name"))) if strict else named.where(is_safe(F.col("name")))


def copies(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """The members of read_archives without their content, but with what last_readable needs to read it: name, archive, size,
    packed, crc, method, encrypted and offset. Dealt by name over as many tasks as their bytes need, a name's last copy first,
    by archive and there by pos."""
    own = folders.dealt(_safely_named(staged(directory(_paths(spark, path))), strict), F.col("size"))
    return own.sortWithinPartitions("name", F.desc("archive"), F.desc("pos")).select("name", "archive", *Place._fields)


def last_readable(rows: Iterator[tuple]) -> Iterator[tuple[str, bytes]]:
    """Each name and its first copy that can be read, of rows of copies(); none is an error."""
    for name, own in groupby(rows, key=itemgetter(0)):
        for _, path, *at in own:
            if pd.isna(at[-1]):  # of an archive that can't be opened
                continue
            system, file_path = place(path)
            try:
                with system.open_input_file(file_path) as file:
                    content = _member(file, Place(*map(int, at)))
            except (ValueError, OSError, zlib.error):
                continue
            yield name, content
            break
        else:
            raise ValueError(f"no copy can be read: {name}")


def inner_packages(members: DataFrame) -> DataFrame:
    """(archive, name): the first member of each archive, by name, that is a package itself."""
    return members.where(F.col("name").rlike(r"(?i)\.pak\z")).groupBy("archive").agg(F.min("name").alias("name"))


def _extra_64(*values: int) -> tuple[list[int], bytes]:
    """Values as 32-bit fields, and the extra field of those that don't fit."""
    large = [v for v in values if v >= MOST_32]
    return [min(v, MOST_32) for v in values], struct.pack(f"<HH{len(large)}Q", 1, 8 * len(large), *large) if large else b""


def _local_header(name: bytes, crc: int, size: int, packed: int, method: int) -> bytes:
    extra = struct.pack("<HHQQ", 1, 16, size, packed) if max(size, packed) >= MOST_32 else b""
    sizes = (MOST_32, MOST_32) if extra else (packed, size)
    return struct.pack("<IHHHHHIIIHH", LOCAL, VERSION_64 if extra else VERSION, UTF8_NAME, method, 0, EPOCH, crc, *sizes, len(name), len(extra)) + name + extra


def _central_header(name: bytes, crc: int, size: int, packed: int, method: int, offset: int) -> bytes:
    (size, packed, offset), extra = _extra_64(size, packed, offset)
    return struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, VERSION_64, VERSION_64 if extra else VERSION, UTF8_NAME, method, 0, EPOCH, crc, packed, size, len(name), len(extra), 0, 0, 0, 0, offset) + name + extra


def _end(members: int, start: int, length: int) -> bytes:
    end_64 = b""
    if members >= MOST_16 or start >= MOST_32 or length >= MOST_32:
        end_64 = struct.pack("<IQHHIIQQQQ", END_64, 44, VERSION_64, VERSION_64, 0, 0, members, members, length, start) + struct.pack("<IIQI", LOCATOR_64, 0, start + length, 1)
    return end_64 + struct.pack("<IHHHHIIH", END, 0, 0, min(members, MOST_16), min(members, MOST_16), min(length, MOST_32), min(start, MOST_32), 0)


class _Zip:
    """One archive being written: members one after the other, and then their directory."""

    def __init__(self, path: str, job: str):
        self.out, self.members, self.headers = Growing(path, job), 0, []

    def add(self, name: str, crc: int, size: int, method: int, data: bytes) -> None:
        raw = name.encode()
        self.headers.append(_central_header(raw, crc, size, len(data), method, self.out.size))
        for piece in (_local_header(raw, crc, size, len(data), method), data):
            self.out.write(piece)
        self.members += 1

    def close(self) -> int:
        start, length = self.out.size, sum(map(len, self.headers))
        for piece in (*self.headers, _end(self.members, start, length)):
            self.out.write(piece)
        self.out.close()
        return self.out.size

    def drop(self) -> None:
        self.out.drop()


def packed(members: DataFrame) -> DataFrame:
    """(archive, name, crc, size, method, data): members (archive, name, content) deflated where they are."""

    def deflated(m: object) -> tuple:
        machine = zlib.compressobj(6, zlib.DEFLATED, -15)
        data = machine.compress(m.content) + machine.flush()
        method, data = (DEFLATED, data) if len(data) < len(m.content) else (PLAIN, bytes(m.content))
        return m.archive, m.name, zlib.crc32(m.content), len(m.content), method, data

    def deflate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from batched(map(deflated, batch.itertuples(index=False)), ["archive", "name", "crc", "size", "method", "data"], 5)

    safe = members.where(is_safe(F.col("name")) & F.col("content").isNotNull())
    return safe.select("archive", "name", "content").mapInPandas(deflate, "archive string, name string, crc long, size long, method int, data binary")


def write_archives(members: DataFrame, folder: str) -> DataFrame:
    """One zip of each archive's members (archive, name, content), by name, at folder/archive, which all executors reach.
    Returns the staged list of what was written: path, members and bytes.

    Members are deflated in parallel and sorted by archive and name; the task with an archive's members streams them out
    one by one and ends with the directory, so neither an archive nor its members are ever held. A file appears whole
    under its name, so tasks may run again; what a failed task had begun it takes away, and what a lost one had begun
    goes when the job has ended.
    """

    job = f"{uuid.uuid4().hex}.part"
    system, root = place(folder)
    system.create_dir(root, recursive=True)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        zip_, name, done = None, None, []
        try:
            for batch in batches:
                for m in batch.itertuples(index=False):
                    if zip_ is None or m.archive != name:
                        if zip_:
                            done.append((f"{folder}/{name}", zip_.members, zip_.close()))
                        zip_, name = None, m.archive
                        zip_ = _Zip(f"{folder}/{name}", job)
                    zip_.add(m.name, m.crc, m.size, m.method, m.data)
            if zip_:
                last, zip_ = zip_, None
                done.append((f"{folder}/{name}", last.members, last.close()))
        except BaseException:
            if zip_:
                zip_.drop()
            raise
        yield pd.DataFrame(done, columns=["path", "members", "bytes"])

    sorted_ = packed(members).withColumn("archive", safe_or_error(F.col("archive"))).repartition("archive").sortWithinPartitions("archive", "name")
    try:
        with small_batches(members.sparkSession):
            return staged(sorted_.mapInPandas(write, "path string, members long, bytes long"))
    finally:
        sweep(folder, job)
