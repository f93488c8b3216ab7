"""Token ids of documents in files of independent zstandard frames with a seek table.

A file has the ids of consecutive documents, in ascending order of doc_id over all files:

* frames: zstandard frames of whole documents' ids, little-endian unsigned integers of `width` bytes;
* an index: a skippable frame (magic 0x184D2A50) with an Arrow stream of doc_id, frame, offset and n_tokens;
* the seek table of the zstandard seekable format: a skippable frame (magic 0x184D2A5E) with the compressed and
  decompressed size and the checksum (XXH64 of the ids' bytes, low half) of each frame; then the number of
  frames and the magic 0x8F92EAB1.

Any zstandard reader decompresses a whole file; `read_documents` reads the end of a file, then only the frames
that hold the documents asked for. Tasks write files of names of their own and report them; the manifest, written
by Spark, lists those of the attempts that succeeded, so a lost or repeated task leaves no trace in it.

Null texts count as empty: the end id alone. Null ids come first; repeated ids are all kept, in the order of a
hash of their texts. An empty table has an empty manifest. A document of any length is whole within one frame. Other
columns than doc_id and text don't matter, whatever their names.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, new_path, partitions, staged, text_bytes

#: Ids of a frame; bytes of text for one file.
FRAME_TOKENS, FILE_BYTES = 1 << 16, 256 << 20
INDEX_MAGIC, TABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
TOKENIZERS: dict[str, WordIds] = {}


class WordIds(dict):
    """Packed ids of words without white space, which the tokenizer encodes separately; the words that were not
    used since it was last full are forgotten."""

    def __init__(self, path: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        # the library looks for added tokens first, in the text as it stands; those that reach past a word need all of it
        self.whole = any(x.lstrip or x.rstrip or x.single_word or x.normalized or x.content.split() != [x.content] for x in added)
        self.added = re.compile(b"|".join(re.escape(x.content.encode().lower()) for x in added) or b"(?!)")
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.pack = {n: struct.Struct(f"<{n}{'H' if self.width == 2 else 'I'}").pack for n in range(64)}
        self.most, self.older = most, {}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(word)
        if ids is None:
            ids = self.direct(word)
        self[word] = ids
        return ids

    def direct(self, text: bytes) -> bytes:
        found = self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
        return self.pack[len(found)](*found) if len(found) < 64 else np.array(found, f"<u{self.width}").tobytes()

    def encode(self, text: bytes) -> bytes:
        """Ids as the library gives them. The normaliser lower-cases words, but not what may be an added token."""
        if self.whole:
            return self.direct(text)
        low = text.lower()
        if not self.added.search(low):
            return b"".join(map(self.__getitem__, low.split()))
        return b"".join(self.direct(raw) if self.added.search(word) else self[word] for word, raw in zip(low.split(), text.split()))


def word_ids(path: str) -> WordIds:
    """One for all tasks of a Python worker."""
    if path not in TOKENIZERS:
        TOKENIZERS.clear()
        TOKENIZERS[path] = WordIds(path)
    return TOKENIZERS[path]


class FrameWriter:
    """Writes one file; holds one frame and the index."""

    def __init__(self, path: str, width: int, kind: pa.DataType, frame_tokens: int = FRAME_TOKENS):
        self.width, self.kind, self.frame_bytes = width, kind, frame_tokens * width
        store, place = pafs.FileSystem.from_uri(path)
        store.create_dir(place.rpartition("/")[0], recursive=True)
        self.file, self.press = store.open_output_stream(place, compression=None), zstandard.ZstdCompressor(level=3)
        self.held: list[bytes] = []
        self.size = self.tokens = 0
        self.table: list[tuple[int, int, int]] = []
        self.index: tuple[list, list, list, list] = ([], [], [], [])

    def add(self, doc_id: object, ids: bytes) -> None:
        for column, value in zip(self.index, (doc_id, len(self.table), self.size // self.width, len(ids) // self.width)):
            column.append(value)
        self.held.append(ids)
        self.size += len(ids)
        self.tokens += len(ids) // self.width
        if self.size >= self.frame_bytes:
            self._frame()

    def _frame(self) -> None:
        raw = b"".join(self.held)
        frame = self.press.compress(raw)
        self.file.write(frame)
        self.table.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self._frame()
        arrays = [pa.array(self.index[0], self.kind), *(pa.array(x, pa.int64()) for x in self.index[1:])]
        batch = pa.RecordBatch.from_arrays(arrays, schema=pa.schema(list(zip(("doc_id", "frame", "offset", "n_tokens"), (a.type for a in arrays))), {"width": str(self.width)}))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(batch)
        index = sink.getvalue().to_pybytes()
        table = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0x80, SEEKABLE_MAGIC)
        self.file.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index + struct.pack("<II", TABLE_MAGIC, len(table)) + table)
        self.file.close()


class FrameReader:
    """Reads a file's table and index, and frames when documents in them are asked for."""

    def __init__(self, path: str):
        store, place = pafs.FileSystem.from_uri(path)
        self.file = store.open_input_file(place)
        end = self.file.size()
        count, _, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{path} has no seek table")
        begin = end - 9 - 12 * count
        self.table = [struct.unpack_from("<III", data, 12 * i) for data in [self._at(begin, 12 * count)] for i in range(count)]
        self.starts = [0]
        for size, _, _ in self.table:
            self.starts.append(self.starts[-1] + size)
        at = self.starts[-1] + 8
        stream = pa.ipc.open_stream(self._at(at, begin - 8 - at))
        self.width, self.index = int(stream.schema.metadata[b"width"]), stream.read_all()

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def frame(self, n: int) -> bytes:
        size, raw_size, checksum = self.table[n]
        raw = zstandard.ZstdDecompressor().decompress(self._at(self.starts[n], size), max_output_size=raw_size)
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {n} does not have its checksum")
        return raw

    def documents(self, wanted: set | None = None) -> Iterator[tuple[object, int, np.ndarray]]:
        """(doc_id, ids of the file's documents before it, ids), of all documents or those wanted."""
        before, at, raw = 0, -1, b""
        for doc_id, frame, offset, n in zip(*(self.index.column(i).to_pylist() for i in range(4))):
            if wanted is None or doc_id in wanted:
                if frame != at:
                    at, raw = frame, self.frame(frame)
                yield doc_id, before, np.frombuffer(raw, f"<u{self.width}", n, offset * self.width)
            before += n
        self.file.close()


def write_documents(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, files: int | None = None) -> DataFrame:
    """Encode, end each document with end_id and write its ids. Returns the staged manifest: place, path, n_docs,
    n_tokens and start (ids of all files before it)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    path = path or new_path(spark, "token-frames")
    files = files or max(partitions(spark), -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 1) // FILE_BYTES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, writer, docs = word_ids(tokenizer_path), None, 0
        end, place = np.array([end_id], f"<u{ids.width}").tobytes(), TaskContext.get().partitionId()
        name = f"{path}/part-{place:06d}-{uuid.uuid4().hex}.zst"
        for batch in batches:
            if batch.num_rows and writer is None:
                writer = FrameWriter(name, ids.width, batch.column(0).type)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                writer.add(doc_id, ids.encode(text.as_py()) + end)
                docs += 1
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([name]), pa.array([docs], pa.int64()), pa.array([writer.tokens], pa.int64())], ["place", "path", "n_docs", "n_tokens"])

    rows = docs.select("doc_id", text_bytes().alias("text")).withColumn("tie", F.xxhash64("text"))
    order = rows.repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    return staged(order.mapInArrow(write, "place int, path string, n_docs long, n_tokens long"), "token-manifest")


def read_documents(manifest: DataFrame, kind: str = "bigint", wanted: list | None = None, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids; with digest, ids_crc32 instead of ids."""
    spark = manifest.sparkSession
    bounded_batches(spark)
    sizes = sorted((r["place"], r["n_tokens"]) for r in manifest.select("place", "n_tokens").collect())  # one row a file
    before, total = {}, 0
    for place, n in sizes:
        before[place], total = total, total + n
    asked = None if wanted is None else set(wanted)
    field = pa.int64() if digest else pa.list_(pa.int64())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader, rows, held = FrameReader(path), [], 0
                made = lambda rows, kind=reader.index.schema.field("doc_id").type: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((kind, pa.int64(), pa.int64(), field))], ["doc_id", "start", "n_tokens", "ids"])
                for doc_id, at, ids in reader.documents(asked):
                    rows.append((doc_id, before[place] + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids.tolist()))
                    held += 1 if digest else len(ids)
                    if held >= FRAME_TOKENS:
                        yield made(rows)
                        rows, held = [], 0
                yield made(rows)

    last = "ids_crc32 long" if digest else "ids array<bigint>"
    dealt = manifest.select("place", "path").repartition(max(1, min(len(sizes), 10 * partitions(spark))))
    return dealt.mapInArrow(read, f"doc_id {kind}, start long, n_tokens long, ids {last.split()[1]}").withColumnRenamed("ids", last.split()[0])
