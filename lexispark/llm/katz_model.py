"""Katz backoff language model: training on a corpus into packed tables, and scores of texts by them.

Bigrams back off to unigrams, and those to one unknown word. Counts up to 5 are discounted by Good and Turing;
where their counts of counts allow none, 0.5 is taken off the count. A context's backoff weight makes its
probabilities over the vocabulary and the unknown word sum to one exactly; a context without discounted counts
gets one more in its denominator, so that there is something to back off with.

`fit` trains and scores in the same exchange, as each text must meet the counts of its bigrams anyway:

1. Documents become chunks: token numbers of the chunk, and its words' hashes. Staged.
2. Words meet by hash bucket: ids and training counts, stored as the unigram table by bucket, go back to chunks.
3. Each chunk sends its bigrams, with documents, to their context's bucket. A bucket has all that follows its
   contexts, so it counts, stores its part of the bigram table, and scores all but what needs the discounts:
   how many tokens of a document had a bigram of count 1 to 5, and which contexts it backed off from.
   Contexts with many rows are dealt over several buckets; their weights are put together on the driver, which
   are at most a million rows. A bigram that many documents of a chunk have is sent once: the bucket takes it for a
   document of its own, and the chunk shares its score out. There are as many buckets as the texts need.
4. Discounts known, each bucket computes its backoff weights and sends sums of documents back to their chunks.

`score` evaluates other texts by the stored tables: words look their ids up in the unigram table, bigrams meet their
context's bucket of the bigram table, which gives a seen bigram's probability, or else the context's weight times the
unigram's.

A word is its XXH3 64-bit hash. Null texts count as empty: their one token is the end. A document without id
counts as training. Repeated documents are scored row by row; an empty table gives no rows; held-out documents
alone are scored by the unknown word; texts may have any length. Other columns don't matter.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, staged, text_bytes
from .packing import gaps, mixed, pack, sums, unpack
from .words import Hashes, spaced

#: Tokens of a chunk; bytes of text for one bucket; documents of a chunk with a bigram from which it is sent once; the
#: most contexts that are dealt.
CHUNK_TOKENS, BUCKET_BYTES, MANY, DEALT = 1_250_000, 5 << 20, 48, 1_000_000
K = 5
#: Hash of the end of a text: of bytes that are no word.
END = xxhash.xxh3_64_intdigest(b" end ")
NO_DISCOUNT = [(r - 0.5) / r for r in range(1, K + 1)]


def held_out(doc_id: str = "doc_id") -> Column:
    """The documents kept from training: CRC-32 of the id as text, modulo 7, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def discounts(counts_of_counts: list[int]) -> list[float]:
    """Katz's d_1 to d_K from n_1 to n_(K+1)."""
    n = [0, *counts_of_counts]
    if not n[1]:
        return NO_DISCOUNT
    tail = (K + 1) * n[K + 1] / n[1]
    out = []
    for r in range(1, K + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail != 1 else 0
        out.append(d if 0 < d < 1 else NO_DISCOUNT[r - 1])
    return out


class Unigrams:
    """Probabilities of words by training count, and of the unknown word."""

    def __init__(self, tokens: int, types: int, counts_of_counts: list[int]):
        self.tokens, self.types, self.d = tokens, types, discounts(counts_of_counts)
        left = sum((1 - d) * r * n for r, d, n in zip(range(1, K + 1), self.d, counts_of_counts))
        self.total = tokens if left > 0 else tokens + 1
        self.unknown = left / tokens if left > 0 else 1 / (tokens + 1)

    def p(self, count: np.ndarray) -> np.ndarray:
        d = np.array([0.0, *self.d])[np.minimum(count, K)]
        return np.where(count == 0, self.unknown, np.where(count <= K, d, 1.0) * count / self.total)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.tokens + self.types + 1))


def _counts_of(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, K + 2), minlength=K + 3)[1 : K + 2].tolist()


def chunked(docs: DataFrame, held: Column, buckets: int, chunk_tokens: int) -> DataFrame:
    """Chunks of documents: doc_ids, held, lengths, tokens (numbers in the chunk, frequent words first), and the
    words' hashes, training counts and buckets."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def chunk(ids: list, held: list, lists: list[np.ndarray]) -> pa.RecordBatch:
        lengths = np.array([len(x) for x in lists], np.int64)
        words, tokens, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        number = np.empty(len(order), np.uint32)
        number[order] = np.arange(len(order), dtype=np.uint32)
        tokens, words = number[tokens], words[order]
        trained = np.bincount(tokens, weights=np.repeat(~np.array(held), lengths), minlength=len(words))
        blobs = [pack(tokens), words.tobytes(), pack(trained.astype(np.uint32)), pack((words % np.uint64(buckets)).astype(np.uint32))]
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(ids[0].type)), pa.array([held]), pa.array([lengths]), *(pa.array([b], pa.binary()) for b in blobs)], ["chunk", "doc_ids", "held", "lengths", "tokens", "words", "trained", "buckets"])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, end = Hashes(200_000), np.array([END], np.uint64)
        ids, flags, lists, size = [], [], [], 0
        for batch in batches:
            at, out = 0, batch.column(1).to_pylist()
            for i, text in enumerate(batch.column(2)):
                lists.append(np.concatenate((hashes.of(spaced(text.as_py())), end)))
                flags.append(out[i])
                size += len(lists[-1])
                if size >= chunk_tokens:
                    ids.append(batch.column(0).slice(at, i + 1 - at))
                    yield chunk(ids, flags, lists)
                    ids, flags, lists, size, at = [], [], [], 0, i + 1
            if at < batch.num_rows:
                ids.append(batch.column(0).slice(at))
        if lists:
            yield chunk(ids, flags, lists)

    schema = f"chunk string, doc_ids array<{kind}>, held array<boolean>, lengths array<bigint>, tokens binary, words binary, trained binary, buckets binary"
    return staged(docs.select("doc_id", held.alias("held"), text_bytes().alias("text")).mapInArrow(chunks, schema), "katz-chunks")


def _sender(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sends chunks' words to their buckets."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, trained, bucket = np.frombuffer(row["words"], np.uint64), unpack(row["trained"], np.uint32), unpack(row["buckets"], np.uint32)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                parts = [order[a:b] for a, b in zip(cuts, cuts[1:])]
                full = [i for i, x in enumerate(parts) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([row["chunk"]] * len(full)), pa.array([words[parts[i]].tobytes() for i in full], pa.binary()), pa.array([pack(trained[parts[i]]) for i in full], pa.binary())], ["bucket", "chunk", "words", "trained"])

    return send


def unigram_table(chunks: DataFrame, buckets: int) -> DataFrame:
    """Staged by kind: "chunk" rows give a chunk its words' ids and counts of one bucket, in the order in which it
    sent them; "model" rows are the unigram table."""

    def meet(rows: pa.Table) -> pa.Table:
        bucket, chunk = rows.column("bucket")[0].as_py(), rows.column("chunk").to_pylist()
        lists = [np.frombuffer(x, np.uint64) for x in rows.column("words").to_pylist()]
        words, at = np.unique(np.concatenate(lists), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([unpack(x, np.uint32) for x in rows.column("trained").to_pylist()]), minlength=len(words)).astype(np.int64)
        rank = np.empty(len(words), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(words))
        ids = rank * buckets + bucket + 1
        cuts = np.cumsum([len(x) for x in lists])[:-1]
        per = [(pack(ids[x]), pack(counts[x])) for x in np.split(at, cuts)]
        n = len(per) + 1
        known = counts > 0
        columns = {
            "kind": ["chunk"] * len(per) + ["model"], "bucket": [bucket] * n, "chunk": [*chunk, None], "words": [None] * len(per) + [words.tobytes()],
            "ids": [x[0] for x in per] + [pack(ids)], "counts": [x[1] for x in per] + [pack(counts)],
            "tokens": [0] * len(per) + [int(counts.sum())], "types": [0] * len(per) + [int(known.sum())], "coc": [None] * len(per) + [_counts_of(counts)],
        }
        return pa.table([pa.array(v, t) for v, t in zip(columns.values(), (pa.string(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], list(columns))

    sent = chunks.select("chunk", "words", "trained", "buckets").mapInArrow(_sender(buckets), "bucket int, chunk string, words binary, trained binary")
    return staged(sent.groupBy("bucket").applyInArrow(meet, "kind string, bucket int, chunk string, words binary, ids binary, counts binary, tokens long, types long, coc array<bigint>"), "katz-unigrams", "kind")


def _bigrams(chunks: DataFrame, unigrams: DataFrame, model: Unigrams, trained_docs: int, buckets: int) -> DataFrame:
    """Of each chunk, packed bigrams with documents by context bucket, and a "docs" row with what is known per document."""
    kind = chunks.schema["doc_ids"].dataType.elementType
    hot = max(1000, model.tokens // (4 * buckets), model.tokens // DEALT)

    def send(chunk: pa.Table, words: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        tokens, bucket = unpack(row["tokens"], np.uint32).astype(np.int64), unpack(row["buckets"], np.uint32)
        parts = sorted(zip(words.column("bucket").to_pylist(), words.column("ids").to_pylist(), words.column("counts").to_pylist()))
        order = np.argsort(bucket, kind="stable")
        ids, counts = np.zeros(len(bucket) + 1, np.int64), np.zeros(len(bucket) + 1, np.int64)
        ids[order + 1] = np.concatenate([unpack(x[1], np.int64) for x in parts])
        counts[order + 1] = np.concatenate([unpack(x[2], np.int64) for x in parts])
        counts[0] = trained_docs  # the context at the start of a text
        lengths = np.array(row["lengths"])
        starts = np.cumsum(lengths) - lengths
        known = counts[tokens + 1]
        per_doc = [np.add.reduceat(x, starts) for x in (model.base(known), (known > 0).astype(np.int64))]
        doc = np.repeat(np.arange(len(lengths)), lengths)
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1] + 1
        before[starts] = 0
        word_bits, doc_bits = int(len(bucket) + 1).bit_length(), len(lengths).bit_length()
        keys, n = np.unique(((tokens + 1) << word_bits | before) << doc_bits | doc, return_counts=True)
        doc, pair = keys & ((1 << doc_bits) - 1), keys >> doc_bits
        held = np.array(row["held"])
        start = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        size = np.diff(np.append(start, len(pair)))
        many = np.flatnonzero(size >= MANY)
        inside = np.repeat(size >= MANY, size)
        shared = (np.repeat(np.arange(len(many)), size[many]), doc[inside], n[inside])
        code = np.append(doc[~inside] * 4 + held[doc[~inside]], (len(lengths) + np.arange(len(many))) * 4 + 2)
        trained = np.bincount(shared[0], weights=np.where(held[shared[1]], 0, shared[2]), minlength=len(many)).astype(np.int64)
        n, pair = np.append(n[~inside], trained), np.append(pair[~inside], pair[start[many]])
        w1, w2 = pair & ((1 << word_bits) - 1), pair >> word_bits
        salt = mixed(ids[w2]) % (1 + counts[w1] // hot).astype(np.uint64)
        to = (mixed(ids[w1].astype(np.uint64) + salt * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.uint16 if buckets < 65536 else np.uint32)
        by = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[by], np.arange(buckets + 1))
        rows: list[tuple] = []
        for b in range(buckets):
            if cuts[b] == cuts[b + 1]:
                continue
            x = by[cuts[b] : cuts[b + 1]]
            x = x[np.lexsort((ids[w1[x]], ids[w2[x]]))]
            second, at, run = np.unique(ids[w2[x]], return_index=True, return_counts=True)
            first, from_, place = np.unique(ids[w1[x]], return_index=True, return_inverse=True)
            arrays = (run.astype(np.uint32), counts[w2[x[at]]], counts[w1[x[from_]]], place.astype(np.uint32), code[x].astype(np.uint32), n[x].astype(np.uint32))
            rows.append((b, row["chunk"], [*(gaps((i + 1).astype(np.uint64)) for i in (second, first)), *(pack(a) for a in arrays)], None, None))  # unknown words are -1
        rows.append((int(row["chunk"][:8], 16) % buckets, row["chunk"], [pack(a) for a in (held.astype(np.uint8), lengths, per_doc[1], per_doc[0], *(x.astype(np.uint32) for x in shared))], row["doc_ids"], len(lengths)))
        types = (pa.int32(), pa.string(), pa.list_(pa.binary()), chunk.schema.field("doc_ids").type, pa.int64())
        return pa.table([pa.array(v, t) for v, t in zip(zip(*rows), types)], ["bucket", "chunk", "parts", "doc_ids", "n_docs"])

    ids = unigrams.where("kind = 'chunk'").select("chunk", "bucket", "ids", "counts")
    left = chunks.select("chunk", "doc_ids", "held", "lengths", "tokens", "buckets")
    return left.groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInArrow(send, f"bucket int, chunk string, parts array<binary>, doc_ids array<{kind.simpleString()}>, n_docs long")


def _gathered(items: list[dict]) -> tuple:
    """Of the rows that chunks sent to a bucket: first and second word, their counts, document codes, and occurrences;
    each chunk's first document, and how many there are."""
    cols: list[list[np.ndarray]] = [[] for _ in range(6)]
    offset, offsets = 0, []
    for r in items:
        second, first = (sums(x).astype(np.int64) - 1 for x in r["parts"][:2])
        run, count2, count1, place, doc, n = (unpack(x, t) for x, t in zip(r["parts"][2:], (np.uint32, np.int64, np.int64, np.uint32, np.uint32, np.uint32)))
        for col, x in zip(cols, (first[place], np.repeat(second, run), np.repeat(count2, run), count1[place], doc.astype(np.int64) + 4 * offset, n)):
            col.append(x)
        offsets.append(offset)
        offset += int(doc.max()) // 4 + 1
    return *map(np.concatenate, cols), offsets, offset


def bigram_table(sent: DataFrame, model: Unigrams) -> DataFrame:
    """Staged by kind. "bigrams": a bucket's part of the bigram table with its contexts, and what its documents have
    so far; "docs": the rows of documents."""
    kind = sent.schema["doc_ids"].dataType

    def meet(rows: pa.Table) -> pa.Table:
        bucket, items = rows.column("bucket")[0].as_py(), rows.to_pylist()
        docs = [r for r in items if r["doc_ids"] is not None]
        items = [r for r in items if r["doc_ids"] is None]
        out: list[dict] = [{"kind": "docs", "bucket": bucket, "chunk": r["chunk"], "parts": r["parts"], "doc_ids": r["doc_ids"]} for r in docs]
        if items:
            w1, w2, c2, c1, doc, n, offsets, offset = _gathered(items)
            order = np.lexsort((w2, w1))
            w1, w2, c2, c1, doc, n = (x[order] for x in (w1, w2, c2, c1, doc, n))
            del order
            new = np.append(True, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1]))
            starts = np.flatnonzero(new)
            pair_count = np.add.reduceat(np.where(doc & 1, 0, n).astype(np.int64), starts)
            n = np.where(doc & 2, 1, n)  # of a bigram sent once, the score is asked for once
            doc = doc >> 2
            ctx_new = np.append(True, w1[starts][1:] != w1[starts][:-1])
            ctx_of_pair, ctx_starts = np.cumsum(ctx_new) - 1, np.flatnonzero(ctx_new)
            ctx_count = c1[starts][ctx_starts]
            small = np.zeros((K, len(ctx_starts)), np.int64)
            for r in range(1, K + 1):
                small[r - 1] = np.add.reduceat((pair_count == r).astype(np.int64), ctx_starts)
            lower = model.p(c2)
            seen_mass = np.add.reduceat(np.where(pair_count > 0, lower[starts], 0.0), ctx_starts)
            total = np.add.reduceat(pair_count, ctx_starts)
            partial = total < ctx_count  # the rest of the context is in other buckets
            pair = np.cumsum(new) - 1
            count, ctx = pair_count[pair], ctx_of_pair[pair]
            seen, bare = count > 0, (small.sum(0) == 0)
            whole = ctx_count + (bare & ~partial)
            value = n * np.where(seen, np.log10(np.maximum(count, 1)) - np.log10(np.maximum(whole[ctx], 1)), np.log10(lower))
            per_doc = [np.bincount(doc, weights=value, minlength=offset)]
            per_doc += [np.bincount(doc, weights=np.where(count == r, n, 0), minlength=offset) for r in range(1, K + 1)]
            touched = np.flatnonzero(np.bincount(doc, minlength=offset))
            missed = np.flatnonzero(~seen & (ctx_count[ctx] > 0))
            doubt = np.flatnonzero(seen & (bare & partial)[ctx])
            kept = pair_count > 0
            table = [w1[starts][ctx_starts], np.bincount(ctx_of_pair[kept], minlength=len(ctx_starts)).astype(np.uint32), w2[starts][kept], pair_count[kept]]
            contexts = [ctx_count, seen_mass, partial.astype(np.uint8), *small.astype(np.uint32)]
            about = [touched, per_doc[0][touched], *(x[touched].astype(np.uint32) for x in per_doc[1:])]
            later = [ctx[missed].astype(np.uint32), doc[missed], n[missed].astype(np.uint32), ctx[doubt].astype(np.uint32), doc[doubt], n[doubt].astype(np.uint32)]
            hot = [{"id": int(table[0][i]), "count": int(ctx_count[i]), "mass": float(seen_mass[i]), "small": small[:, i].tolist()} for i in np.flatnonzero(partial)]
            out.append({"kind": "bigrams", "bucket": bucket, "chunks": [r["chunk"] for r in items], "offsets": offsets, "parts": [pack(x) for x in (*table, *contexts)], "scores": [pack(x) for x in (*about, *later)], "coc": _counts_of(pair_count), "hot": hot})
        hot_type = pa.list_(pa.struct([("id", pa.int64()), ("count", pa.int64()), ("mass", pa.float64()), ("small", pa.list_(pa.int64()))]))
        fields = {"kind": pa.string(), "bucket": pa.int32(), "chunk": pa.string(), "parts": pa.list_(pa.binary()), "doc_ids": rows.schema.field("doc_ids").type, "chunks": pa.list_(pa.string()), "offsets": pa.list_(pa.int64()), "scores": pa.list_(pa.binary()), "coc": pa.list_(pa.int64()), "hot": hot_type}
        return pa.Table.from_pylist(out, pa.schema(fields))

    schema = f"kind string, bucket int, chunk string, parts array<binary>, doc_ids {kind.simpleString()}, chunks array<string>, offsets array<bigint>, scores array<binary>, coc array<bigint>, hot array<struct<id:bigint,count:bigint,mass:double,small:array<bigint>>>"
    return staged(sent.groupBy("bucket").applyInArrow(meet, schema), "katz-bigrams", "kind")


def backoff_weights(count: np.ndarray, mass: np.ndarray, small: np.ndarray, d: list[float]) -> np.ndarray:
    """What a context's unseen words' lower probabilities are multiplied by, so that all sum to one."""
    left = sum((1 - d[r]) * (r + 1) * small[r] for r in range(K))
    count = np.maximum(count, 1)
    return np.where(left > 0, left / count, 1 / (count + 1)) / np.maximum(1 - mass, 1e-300)


def _sum_coc(rows: list) -> list[int]:
    return [sum(r["coc"][i] for r in rows) for i in range(K + 1)]


@dataclass
class Katz:
    """A fitted model: its tables in the shared folder, and numbers of fixed size."""

    unigrams: DataFrame
    bigrams: DataFrame
    words: Unigrams
    d: list[float]
    hot: dict[int, tuple]
    trained_docs: int
    buckets: int

    def weights(self, ids: np.ndarray, count: np.ndarray, mass: np.ndarray, partial: np.ndarray, small: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of contexts: log10 of the backoff weights, and whether they have no discounted count."""
        log_weight, bare = np.log10(backoff_weights(count, mass, small, self.d)), small.sum(0) == 0
        for i in np.flatnonzero(partial):
            log_weight[i], bare[i] = self.hot[int(ids[i])]
        return log_weight, bare


TABLE = (np.int64, np.uint32, np.int64, np.int64, np.int64, np.float64, np.uint8, *[np.uint32] * K)


def fit(docs: DataFrame, held: Column | None = None, chunk_tokens: int = CHUNK_TOKENS) -> Katz:
    """Train on the documents that are not held out; all of docs can be scored afterwards by scores_of."""
    bounded_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(F.col("text")))).first()[0] or 0
    buckets = max(2, -(-size // BUCKET_BYTES))
    chunks = chunked(docs, held_out() if held is None else held, buckets, chunk_tokens)
    unigrams = unigram_table(chunks, buckets)
    seen = unigrams.where("kind = 'model'").agg(F.sum("tokens").alias("n"), F.sum("types").alias("v"), *[F.sum(F.col("coc")[i]).alias(f"n{i}") for i in range(K + 1)]).first()
    words = Unigrams(seen["n"] or 0, seen["v"] or 0, [seen[f"n{i}"] or 0 for i in range(K + 1)])
    trained_docs = chunks.agg(F.sum(F.size(F.filter("held", lambda x: ~x)))).first()[0] or 0
    table = bigram_table(_bigrams(chunks, unigrams, words, trained_docs, buckets), words)
    pairs = table.where("kind = 'bigrams'")
    coc = pairs.agg(*[F.sum(F.col("coc")[i]).alias(f"n{i}") for i in range(K + 1)]).first()
    d = discounts([coc[f"n{i}"] or 0 for i in range(K + 1)])
    hot = pairs.select(F.explode("hot").alias("h")).groupBy("h.id").agg(F.max("h.count").alias("count"), F.sum("h.mass").alias("mass"), *[F.sum(F.col("h.small")[i]).alias(f"s{i}") for i in range(K)])
    whole = {}
    for r in hot.collect():  # DEALT rows at most
        small = np.array([[r[f"s{i}"]] for i in range(K)])
        whole[r["id"]] = (float(np.log10(backoff_weights(np.array([r["count"]]), np.array([r["mass"]]), small, d)[0])), not small.any())
    return Katz(unigrams, table, words, d, whole, trained_docs, buckets)


def _gather(model: Katz, rows: DataFrame, kind: str) -> DataFrame:
    """Results from rows of chunks' documents, and of their sums from each bucket."""

    def gather(rows: pa.Table) -> pa.Table:
        items = rows.to_pylist()
        row = next(r for r in items if r["doc_ids"] is not None)
        held, lengths, known, base, pair, doc, n = (unpack(x, t) for x, t in zip(row["parts"], (np.uint8, np.int64, np.int64, np.float64, np.uint32, np.uint32, np.uint32)))
        total = np.zeros(len(lengths) + (int(pair.max()) + 1 if len(pair) else 0))
        for r in items:
            if r["doc_ids"] is None:
                total[unpack(r["parts"][0], np.uint32)] += unpack(r["parts"][1], np.float64)
        total, shared = total[: len(lengths)], total[len(lengths) :]
        total = total + np.bincount(doc, weights=n * shared[pair], minlength=len(lengths))
        return pa.table([pa.array(row["doc_ids"], rows.schema.field("doc_ids").type.value_type), pa.array(held.astype(bool)), pa.array(lengths), pa.array(known), pa.array(np.full(len(lengths), model_tokens, np.int64)), pa.array(base), pa.array(total)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    model_tokens = model.words.tokens
    return rows.groupBy("chunk").applyInArrow(gather, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _dealt(chunks: list[str], offsets: list[int], touched: np.ndarray, value: np.ndarray) -> tuple[list[str], list[list[bytes]]]:
    """A bucket's sums, by chunk."""
    cuts = np.append(np.searchsorted(touched, np.array(offsets)), len(touched))
    return chunks, [[pack((touched[a:b] - o).astype(np.uint32)), pack(value[a:b])] for a, b, o in zip(cuts, cuts[1:], offsets)]


def _parts(model: Katz) -> Katz:
    """What tasks need of a model."""
    return Katz(None, None, model.words, model.d, model.hot, model.trained_docs, model.buckets)


def scores_of(model: Katz) -> DataFrame:
    """Scores of the documents that fit() was given, held out or not: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score (log10)."""
    pairs, shared = model.bigrams.where("kind = 'bigrams'"), model.bigrams.sparkSession.sparkContext.broadcast(_parts(model))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        log_d = np.log10(model.d)
        for batch in batches:
            for row in batch.to_pylist():
                ids, _, _, _, count, mass, partial, *small = (unpack(x, t) for x, t in zip(row["parts"], TABLE))
                touched, value, *rest = (unpack(x, t) for x, t in zip(row["scores"], (np.int64, np.float64, *[np.uint32] * K, np.uint32, np.int64, np.uint32, np.uint32, np.int64, np.uint32)))
                log_weight, bare = model.weights(ids, count, mass, partial, np.array(small, np.int64))
                value = value + sum(log_d[r] * rest[r] for r in range(K))
                miss_ctx, miss_doc, miss_n, ctx, doc, n = rest[K:]
                size = int(touched[-1]) + 1
                more = np.bincount(miss_doc, weights=miss_n * log_weight[miss_ctx], minlength=size)
                more += np.bincount(doc, weights=n * np.where(bare[ctx], np.log10(count[ctx] / (count[ctx] + 1)), 0.0), minlength=size)
                chunks, parts = _dealt(row["chunks"], row["offsets"], touched, value + more[touched])
                yield pa.RecordBatch.from_arrays([pa.array(chunks), pa.array(parts, pa.list_(pa.binary()))], ["chunk", "parts"])

    known = model.bigrams.where("kind = 'docs'").select("chunk", "parts", "doc_ids")
    sent = pairs.select("chunks", "offsets", "parts", "scores").mapInArrow(weigh, "chunk string, parts array<binary>")
    whole = model.bigrams.schema["doc_ids"].dataType
    return _gather(model, known.unionByName(sent.withColumn("doc_ids", F.lit(None).cast(whole))), whole.elementType.simpleString())


def _looked_up(model: Katz, chunks: DataFrame) -> DataFrame:
    """Ids and training counts of chunks' words from the unigram table; unknown words have -1 and 0."""

    def look(words: pa.Table, table: pa.Table) -> pa.Table:
        row = (table.to_pylist() or [None])[0]
        known = np.frombuffer(row["words"], np.uint64) if row else np.empty(0, np.uint64)
        ids, counts = (unpack(row["ids"], np.int64), unpack(row["counts"], np.int64)) if row else (np.empty(0, np.int64),) * 2
        out = []
        for r in words.to_pylist():
            asked = np.frombuffer(r["words"], np.uint64)
            at = np.minimum(np.searchsorted(known, asked), max(len(known) - 1, 0))
            hit = known[at] == asked if len(known) else np.zeros(len(asked), bool)
            found = [np.full(len(asked), -1), np.zeros(len(asked), np.int64)]
            for x, own in zip(found, (ids, counts)):
                x[hit] = own[at[hit]]
            out.append((r["chunk"], r["bucket"], *map(pack, found)))
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.binary(), pa.binary()))], ["chunk", "bucket", "ids", "counts"])

    sent = chunks.select("chunk", "words", "trained", "buckets").mapInArrow(_sender(model.buckets), "bucket int, chunk string, words binary, trained binary")
    table = model.unigrams.where("kind = 'model'").select("bucket", "words", "ids", "counts")
    return sent.groupBy("bucket").cogroup(table.groupBy("bucket")).applyInArrow(look, "chunk string, bucket int, ids binary, counts binary")


def score(model: Katz, docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Scores of any documents by a fitted model's tables, as scores_of gives them; held_out is true."""
    bounded_batches(docs.sparkSession)
    chunks = chunked(docs, F.lit(True), model.buckets, chunk_tokens)
    ids = staged(_looked_up(model, chunks), "katz-words")
    sent = _bigrams(chunks, ids.withColumn("kind", F.lit("chunk")), model.words, model.trained_docs, model.buckets)
    shared, kind = docs.sparkSession.sparkContext.broadcast(_parts(model)), sent.schema["doc_ids"].dataType

    def evaluate(rows: pa.Table, table: pa.Table) -> pa.Table:
        model, items = shared.value, rows.to_pylist()
        out = [(r["chunk"], r["parts"], r["doc_ids"]) for r in items if r["doc_ids"] is not None]
        items = [r for r in items if r["doc_ids"] is None]
        if items:
            w1, w2, c2, c1, doc, n, offsets, _ = _gathered(items)
            n, doc = np.where(doc & 2, 1, n), doc >> 2
            parts = (table.to_pylist() or [{"parts": None}])[0]["parts"]
            own, sizes, second, pairs, count, mass, partial, *small = (unpack(x, t) for x, t in zip(parts, TABLE)) if parts else (np.empty(0, t) for t in TABLE)
            log_weight, bare = model.weights(own, count, mass, partial, np.array(small, np.int64).reshape(K, len(own)))
            keys = np.repeat(np.arange(len(own)), sizes) << 40 | second  # ids of words stay below 2^40
            ctx = np.searchsorted(own, w1)
            there = np.append(own, -2)[ctx] == w1
            at = np.searchsorted(keys, ctx << 40 | np.maximum(w2, 0))
            seen = there & (np.append(keys, -1)[at] == (ctx << 40 | w2)) & (w2 >= 0)
            back = np.zeros(len(w1))
            back[there] = log_weight[ctx[there]]
            for i in np.flatnonzero(~there & (c1 > 0)):  # a dealt context none of whose bigrams are here
                back[i] = model.hot[int(w1[i])][0]
            r = np.append(pairs, 0)[np.where(seen, at, len(pairs))]
            discount = np.array([1.0, *model.d, 1.0])[np.minimum(r, K + 1)]
            whole = np.append(count + bare, 1)[np.where(there, ctx, len(own))]
            with np.errstate(divide="ignore"):
                value = n * np.where(seen, np.log10(discount * r / np.maximum(whole, 1)), np.where(c1 > 0, back, 0.0) + np.log10(model.words.p(c2)))
            touched = np.flatnonzero(np.bincount(doc))
            out += [(c, p, None) for c, p in zip(*_dealt([r["chunk"] for r in items], offsets, touched, np.bincount(doc, weights=value)[touched]))]
        types = (pa.string(), pa.list_(pa.binary()), rows.schema.field("doc_ids").type)
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["chunk", "parts", "doc_ids"])

    table = model.bigrams.where("kind = 'bigrams'").select("bucket", "parts")
    met = sent.groupBy("bucket").cogroup(table.groupBy("bucket")).applyInArrow(evaluate, f"chunk string, parts array<binary>, doc_ids {kind.simpleString()}")
    return _gather(model, met, kind.elementType.simpleString())
