"""Benchmark decontamination by a distributed positional inverted index.

The index is a table of segments. A segment holds some documents whole: the sorted hashes of their terms and,
for each term, its sorted positions in the segment, where documents lie one after another with a gap. Segments
are made where the documents are read, without a shuffle, and a query runs on all segments alike, so no list of
a frequent term meets in one task. A phrase starts from its rarest term's positions in the segment and
intersects them with the other terms' lists, each less its offset, rarest first, until none is left.

Queries are compiled where the items are read, into blocks of bounded size in the shared folder; a segment is read once
and meets one block after the other. Null texts have no words; empty documents give rows without hits; items without
words match nothing, and without items nothing is hit. Texts are taken whole: a segment ends behind the document that
fills it. Repeated documents give a row each; an item id that repeats
counts once, and an item without an id marks words but is not counted.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, bounded_batches, staged, text_bytes
from .packing import giving_back, pack, unpack
from .words import Hashes, alnum

SEGMENT_WORDS = 1_000_000
#: Words of the queries in one block that a task holds.
BLOCK_WORDS = 200_000


def build_index(docs: DataFrame, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Segments of docs: segment (a name), doc_ids, their numbers of words, terms, counts and positions. Written to the shared folder."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ids, lists, held = Hashes(), [], [], 0

        def segment() -> pa.RecordBatch:
            lengths = np.array([len(x) for x in lists], np.int64)
            tokens = np.concatenate(lists) if lists else np.empty(0, np.uint64)
            gap = np.repeat(np.arange(len(lists)), lengths)
            order = np.argsort(tokens, kind="stable")
            terms, counts = np.unique(tokens[order], return_counts=True)
            positions = (np.arange(len(tokens)) + gap)[order].astype(np.uint32)
            return pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex]), pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(ids[0].type)), pa.array([lengths], pa.list_(pa.int64())), *(pa.array([pack(x)], pa.binary()) for x in (terms, counts.astype(np.uint32), positions))],
                ["segment", "doc_ids", "lengths", "terms", "counts", "positions"],
            )

        for batch in batches:
            at = 0
            for i, text in enumerate(batch.column(1)):
                lists.append(hashes.of(alnum(text.as_py())))
                held += len(lists[-1]) + 1
                if held >= segment_words:
                    ids.append(batch.column(0).slice(at, i + 1 - at))
                    yield segment()
                    ids, lists, held, at = [], [], 0, i + 1
            if at < batch.num_rows:
                ids.append(batch.column(0).slice(at))
        if lists:
            yield segment()

    schema = f"segment string, doc_ids array<{kind}>, lengths array<bigint>, terms binary, counts binary, positions binary"
    return staged(docs.select("doc_id", text_bytes().alias("text")).mapInArrow(giving_back(segments), schema), "positional-index")


class _Segment:
    """Position lists of one segment by query term."""

    def __init__(self, row: dict, wanted: np.ndarray):
        self.lengths = np.array(row["lengths"], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths + 1)))
        terms, counts = unpack(row["terms"], np.uint64), unpack(row["counts"], np.uint32).astype(np.int64)
        self.positions = unpack(row["positions"], np.uint32)
        ends = np.cumsum(counts)
        at = np.minimum(np.searchsorted(terms, wanted), max(len(terms) - 1, 0))
        found = terms[at] == wanted if len(terms) else np.zeros(len(wanted), bool)
        self.count = np.where(found, counts[at], 0) if len(terms) else np.zeros(len(wanted), np.int64)
        self.first = np.where(found, ends[at] - counts[at], 0) if len(terms) else self.count
        self.wide: dict[int, np.ndarray] = {}

    def of(self, term: int) -> np.ndarray:
        known = self.wide.get(term)
        if known is None:
            known = self.wide[term] = self.positions[self.first[term] : self.first[term] + self.count[term]].astype(np.int64)
        return known

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Where the terms stand one after another."""
        order = np.argsort(self.count[terms], kind="stable")
        at = self.of(terms[order[0]]) - order[0]
        for offset in order[1:]:
            if not len(at):
                break
            there = self.of(terms[offset])
            i = np.minimum(np.searchsorted(there, at + offset), len(there) - 1)
            at = at[there[i] == at + offset]
        return at

    def near(self, terms: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last positions of the terms in order with at most slop other words among them; per end the shortest."""
        span = len(terms) + slop
        rare = self.of(terms[np.argmin(self.count[terms])])
        first = self.of(terms[0])
        i = np.searchsorted(rare, first - span)
        first = first[(i < len(rare)) & (rare[np.minimum(i, len(rare) - 1)] < first + span)]
        last = first
        for term in terms[1:]:
            there = self.of(term)
            i = np.searchsorted(there, last, side="right")
            ok = i < len(there)
            first, last = first[ok], there[i[ok]]
        ok = (last - first < span) & (self.doc(first) == self.doc(last))
        first, last = first[ok], last[ok]
        shortest = np.append(last[1:] != last[:-1], True) if len(last) else np.empty(0, bool)
        return first[shortest], last[shortest]

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1


class Queries:
    """A block of word sequences, each once, and the items that it belongs to."""

    def __init__(self, block: dict):
        self.items: list[str] = block["items"]
        self.terms, self.flat = unpack(block["terms"], np.uint64), unpack(block["sequences"], np.uint32).astype(np.int64)
        self.ends, self.owner_ends = (np.cumsum(unpack(block[c], np.uint32).astype(np.int64)) for c in ("lengths", "owner_counts"))
        self.owners_flat = unpack(block["owners"], np.uint32)

    def owners(self, n: int) -> np.ndarray:
        return self.owners_flat[self.owner_ends[n - 1] if n else 0 : self.owner_ends[n]]

    def matches(self, row: dict, slop: int) -> tuple[_Segment, list[tuple[int, np.ndarray, np.ndarray]]]:
        segment, out = _Segment(row, self.terms), []
        starts = np.concatenate(([0], self.ends[:-1]))
        there = np.flatnonzero(np.minimum.reduceat(segment.count[self.flat], starts)) if len(self.ends) else []
        for n in there:  # all terms of these stand in the segment
            terms = self.flat[starts[n] : self.ends[n]]
            first, last = segment.near(terms, slop) if slop else (at := segment.phrase(terms), at + len(terms) - 1)
            if len(first):
                out.append((n, first, last))
        return segment, out


def _compiled(items: list[tuple], width: int | None) -> pa.RecordBatch:
    """Items (id, hashed words) as a block."""
    names = sorted({str(k) for k, _ in items if k is not None})
    number = {k: i for i, k in enumerate(names)}
    owners: dict[tuple, set[int]] = {}
    for key, words in items:
        n = len(words)
        step = n if width is None or n < width else width
        for i in range(n - step + 1 if n else 0):
            owner = owners.setdefault(tuple(words[i : i + step].tolist()), set())
            if key is not None:
                owner.add(number[str(key)])
    terms = np.array(sorted({t for sequence in owners for t in sequence}), np.uint64)
    flat = np.searchsorted(terms, np.array([t for s in owners for t in s], np.uint64))
    each = {"terms": terms, "sequences": flat, "lengths": [len(s) for s in owners], "owner_counts": [len(o) for o in owners.values()], "owners": [i for o in owners.values() for i in sorted(o)]}
    packed = {c: pa.array([pack(x if c == "terms" else np.array(x, np.uint32))], pa.binary()) for c, x in each.items()}
    return pa.record_batch({"items": pa.array([names], pa.list_(pa.string())), **packed})


BLOCK = "items array<string>, terms binary, sequences binary, lengths binary, owner_counts binary, owners binary"


def compile_queries(items: DataFrame, width: int | None, block_words: int = BLOCK_WORDS) -> list[str]:
    """The items' word sequences as blocks of about block_words words, made where the items are read and written to the
    shared folder; the driver gets the names of the files. With a width, an item longer than a block goes on in the next,
    so that each window lies within one."""
    bounded_batches(items.sparkSession)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, block, held = Hashes(), [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = hashes.of(alnum(text.as_py()))
                step = len(words) if width is None else max(block_words, width)
                for i in range(0, max(len(words) - (width or 1) + 1, 1), step or 1):
                    part = words[i : i + step + (width or 1) - 1] if i or len(words) > step else words
                    if block and held + len(part) > block_words:
                        yield _compiled(block, width)
                        block, held = [], 0
                    block.append((key, part))
                    held += len(part)
        if held:
            yield _compiled(block, width)

    return staged(items.select("item_id", text_bytes().alias("text")).mapInArrow(giving_back(blocks), BLOCK), "queries").inputFiles()


class _Blocks:
    """The blocks of files in the shared folder, one at a time; a single one is kept for a task's next segments."""

    def __init__(self, files: list[str]):
        self.files, self.kept = files, None

    def __iter__(self) -> Iterator[Queries]:
        if self.kept:
            yield self.kept
            return
        n = 0
        for file in self.files:
            store, place = pafs.FileSystem.from_uri(file)
            with store.open_input_file(place) as source:
                table = pq.ParquetFile(source)
                for group in range(table.num_row_groups):
                    for batch in table.iter_batches(1, [group]):
                        n += 1
                        queries = Queries(batch.to_pylist()[0])
                        yield queries
        if n == 1:
            self.kept = queries


def find(index: DataFrame, items: DataFrame, *, width: int | None = None, slop: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """All matches: doc_id, item_id (as text), first and last (word numbers in the document). width: match every
    window of so many words of an item instead of whole items; slop: other words allowed among an item's."""
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    blocks = _Blocks(compile_queries(items, width, block_words))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for queries in blocks:
                    segment, matches = queries.matches(row, slop)
                    for n, first, last in matches:
                        doc = segment.doc(first)
                        for owner in queries.owners(n):
                            yield pa.RecordBatch.from_arrays([pa.array([row["doc_ids"][d] for d in doc], batch.schema.field("doc_ids").type.value_type), pa.array([queries.items[owner]] * len(doc)), pa.array(first - segment.starts[doc]), pa.array(last - segment.starts[doc])], ["doc_id", "item_id", "first", "last"])

    return index.mapInArrow(giving_back(search), f"doc_id {kind}, item_id string, first long, last long")


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def contamination(index: DataFrame, items: DataFrame, *, width: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document of the index: segment, row (its place there), doc_id, n_words, spans (hit words, from first to
    before end) and item_ids (those with a window that occurs). The index is scanned once, whatever the items' number:
    a segment meets one block of queries after the other."""
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    blocks = _Blocks(compile_queries(items, width, block_words))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], np.int64)
                starts = np.concatenate(([0], np.cumsum(lengths + 1)))
                edges, found = np.zeros(starts[-1] + 1, np.int32), [set() for _ in row["doc_ids"]]
                for queries in blocks:
                    segment, matches = queries.matches(row, 0)
                    for n, first, last in matches:
                        np.add.at(edges, first, 1)
                        np.add.at(edges, last + 1, -1)
                        names = [queries.items[x] for x in queries.owners(n)]
                        for d in np.unique(segment.doc(first)):
                            found[d].update(names)
                mask = np.diff((np.cumsum(edges) > 0).astype(np.int8), prepend=0)
                begin, end = np.flatnonzero(mask == 1), np.flatnonzero(mask == -1)
                spans: list[list] = [[] for _ in found]
                for d, a, b in zip(np.searchsorted(starts, begin, side="right") - 1, begin, end):
                    spans[d].append({"first": a - starts[d], "end": b - starts[d]})
                for i in range(0, len(found), 4096):
                    part = slice(i, i + 4096)
                    items_of = [sorted(f) for f in found[part]]
                    arrays = [pa.array([row["segment"]] * len(items_of)), pa.array(range(i, i + len(items_of)), pa.int32()), pa.array(row["doc_ids"][part], batch.schema.field("doc_ids").type.value_type), pa.array(row["lengths"][part], pa.int64()), pa.array(spans[part], SPANS), pa.array(items_of, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(arrays, ["segment", "row", "doc_id", "n_words", "spans", "item_ids"])

    return index.mapInArrow(giving_back(search), f"segment string, row int, doc_id {kind}, n_words long, spans array<struct<first:bigint,end:bigint>>, item_ids array<string>")


def contamination_report(docs: DataFrame, items: DataFrame, *, width: int = 10) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 and contaminated."""
    found = contamination(build_index(docs), items, width=width)
    start = F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(F.sort_array("spans"), start, lambda acc, x: F.struct(F.greatest(acc["to"], x["end"]).alias("to"), (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["to"], x["first"]))).alias("n")))
    return found.select(
        "doc_id", "n_words", covered["n"].alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, *, width: int = 10) -> DataFrame:
    """docs without those that have a word in an occurrence of an item's window. Each row is judged by its own text,
    also where an id is null or repeated; own columns may have any names."""
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("doc_id"), "text")
    found = contamination(build_index(rows.select("doc_id", "text")), items, width=width).where("size(spans) > 0")
    return apart(rows.select("row", "doc_id"), staged(found.select("doc_id"), "contaminated"), "doc_id").select("row.*")
