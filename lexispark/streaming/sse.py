"""Server-sent events from chunks that may be cut anywhere, in lines and in characters too."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.json_io import line_deltas, sse_deltas


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each body in a batch of chunks: their seqs, sizes and bytes on end, as every row that a stateful
    processor takes costs several microseconds. Null chunks are empty, null seqs the last."""
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column(0).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        first = np.flatnonzero(np.diff(codes[order], prepend=-2))
        bounds = np.append(first, len(order))
        chunks = batch.column(2).cast(pa.binary()).fill_null(b"").take(pa.array(order))
        offsets = np.frombuffer(chunks.buffers()[1], "<i4", len(order) + 1)
        seqs = batch.column(1).fill_null(np.iinfo("i8").max).to_numpy(zero_copy_only=False)[order]
        parts = [(bounds * 8, pa.py_buffer(seqs.astype("<i8"))), (bounds * 4, pa.py_buffer(np.diff(offsets).astype("<i4"))), (offsets[bounds], chunks.buffers()[2] or pa.py_buffer(b""))]
        held = [pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(at.astype("<i4")), data]) for at, data in parts]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(order[first])), *held], ["body", "seqs", "sizes", "data"])


def _in_order(seqs: list[bytes], sizes: list[bytes], data: list[bytes]) -> bytes:
    """The bytes of packed chunks by seq; chunks that lie side by side already are taken together."""
    order = np.argsort(np.frombuffer(b"".join(seqs), "<i8"), kind="stable")
    ends, whole = np.cumsum(length := np.frombuffer(b"".join(sizes), "<i4"), dtype="i8"), b"".join(data)
    cuts = np.flatnonzero(np.diff(order) != 1) + 1
    first, last = order[np.append(0, cuts)], order[np.append(cuts - 1, len(order) - 1)]
    return b"".join([whole[a:b] for a, b in zip((ends - length)[first].tolist(), ends[last].tolist())])


class Lines(StatefulProcessor):
    """Of each body the bytes after its last line end, and how many lines there were. A line is decoded only when it is
    whole, so characters are too."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rest = handle.getValueState("rest", "data binary, pos bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        data, pos = self.rest.get() if self.rest.exists() else (b"", 0)
        lines = b"".join([bytes(data), *[bytes(c) for c in pd.concat(rows).sort_values("seq")["chunk"] if c is not None]]).split(b"\n")
        self.rest.update((lines[-1], pos + len(lines) - 1))
        yield pd.DataFrame({"body": key[0], "pos": range(pos, pos + len(lines) - 1), "line": [x.decode("utf-8", "replace") for x in lines[:-1]]})

    def close(self) -> None:
        pass


class PackedLines(StatefulProcessor):
    """The same for the bodies of a bucket, whose chunks come in packs: a body is no call and no frame of its own."""

    #: Lines in a frame, about.
    LINES = 8192

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rest = handle.getMapState("rest", "body string", "data binary, pos bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        packs = pd.concat(rows)
        codes, bodies = pd.factorize(packs["body"], use_na_sentinel=False)
        order = np.argsort(codes, kind="stable")
        columns = [packs[c].take(order).tolist() for c in ("seqs", "sizes", "data")]
        bounds = np.searchsorted(codes[order], range(len(bodies) + 1)).tolist()
        out: tuple[list, list, list] = [], [], []
        for body, a, b in zip(bodies, bounds, bounds[1:]):
            of = (None if pd.isna(body) else body,)
            data, pos = self.rest.getValue(of) or (b"", 0)
            *lines, rest = (bytes(data) + _in_order(*[c[a:b] for c in columns])).split(b"\n")
            self.rest.updateValue(of, (rest, pos + len(lines)))
            for column, more in zip(out, (of * len(lines), range(pos, pos + len(lines)), [x.decode("utf-8", "replace") for x in lines])):
                column.extend(more)
            if len(out[0]) >= self.LINES:
                yield pd.DataFrame(dict(zip(("body", "pos", "line"), out)), dtype=object)  # strings of pandas may be in pieces, which Spark does not take
                out = [], [], []
        yield pd.DataFrame(dict(zip(("body", "pos", "line"), out)), dtype=object)

    def close(self) -> None:
        pass


def delta_stream(chunks: DataFrame, buckets: int = 1024) -> DataFrame:
    """(body, pos, text) of the deltas in a stream of chunks (body string, seq long, chunk binary). Chunks of a batch go to
    the state in packs and are taken by seq; across batches order is the source's duty. Only a body's unfinished line is
    kept between batches, by buckets of bodies. The session must have the RocksDB state store."""
    packs = chunks.select("body", "seq", "chunk").mapInArrow(_packed, "body string, seqs binary, sizes binary, data binary")
    lines = packs.withColumn("bucket", F.pmod(F.xxhash64("body"), F.lit(buckets))).groupBy("bucket").transformWithStateInPandas(statefulProcessor=PackedLines(), outputStructType="body string, pos bigint, line string", outputMode="Append", timeMode="None")
    return line_deltas(lines, ["body"])


def deltas(chunks: DataFrame) -> DataFrame:
    """The same for chunks that are all there: a body's chunks are put together in one row."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda x: F.hex(x["chunk"]))
    whole = chunks.groupBy("body").agg(F.unhex(F.array_join(ordered, "")).alias("data"))
    return sse_deltas(whole.select("body", F.make_valid_utf8(F.col("data").cast("string")).alias("value")), keep=["body"])
