"""N-gram Jaccard join of all documents and its linked groups, by prefixes of token combinations.

Tokens are a document's distinct word shingles, in an order of all shingles that has the rare ones first. Of two
sets that are similar enough, the prefixes share enough tokens: rare tokens are indexed one by one; frequent ones
are dealt into classes by hash, prefixes are extended by k - 1 tokens for each class met, and combinations of k
tokens of one class are indexed. k grows with the frequency: a factor of 64 more documents takes one token more. How
many classes there are depends on the power of two below the set's size; sets just above a power of two are indexed
for the lower one too.

1. Documents are read once. Each chunk sends its distinct tokens, once, to buckets by range of their hashes; a bucket
   returns those that more documents have, with a code of how many. So a token that nothing shares is never an index
   key, and a set without enough shared tokens is in no pair. Tokens are the leading bits of a hash, 16 for each
   token there is: two that meet there only make a candidate more.
2. Index keys of the sets left, (key, node) rows. Sets that are equal are one node. Keys of tokens that many documents
   have are dealt over shards, by node, wherever rows meet what is known of their key.
3. Candidates are verified exactly on their texts in three rounds: each node with the leader it shares most keys with;
   then, among keys whose nodes are not all linked yet, with several leaders of each; then all pairs of different components
   that still share a key, which tiles of bounded size compare by parities of their tokens before texts are read.
   So nothing is compared that is known to be connected, and every link between components is found.

Words, shingles and sets stand for 64-bit hashes. Nulls and texts without words have empty sets and link with
nothing; rows without doc_id are returned with a null component; repeated rows are in one component. An empty table
gives no rows; other columns than doc_id and the text don't matter. percent is 50 or more.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, bounded_batches, meeting, scratch, staged, text_bytes
from .components import components
from .packing import gaps, giving_back, mixed, pack, release, sums, unpack
from .words import Hashes, spaced

#: Tokens of one chunk of documents, and bytes of text for one bucket of tokens.
CHUNK, BUCKET_BYTES = 1 << 21, 12 << 20
#: Documents with a token from which it is frequent, and by which factor k grows.
FREQUENT, FACTOR = 64, 64
#: Documents of one key in one shard; nodes of one tile; pairs of one node in one group.
SHARD, TILE, GROUP = 1 << 12, 1 << 11, 2_000
#: Leaders of a key that its nodes may be compared with before all pairs are, and of how many of them a node is.
LEADERS, MOST_LEADERS = 6, 16
#: Parities of a node's tokens.
PARITIES = 1 << 12


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of width words; of fewer words, of the whole sequence."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    odd = mixed(np.arange(1, width + 1)) | np.uint64(1)
    if n < width:
        return mixed(np.array([(words * odd[:n]).sum(dtype=np.uint64) + np.uint64(n)]))
    total = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        total += words[i : n - width + 1 + i] * odd[i]
    return np.unique(mixed(total))


def node_of(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) >> 1


def needed(n: int, percent: int) -> int:
    """How many of n tokens, counted as the classes do, two similar sets' prefixes must hold."""
    return n - -(-percent * n // 100) + 1


def codes_of(counts: np.ndarray) -> np.ndarray:
    """The place in the order of tokens that so many documents have: 0 for one, then 8 times the logarithm."""
    return np.floor(8 * np.log2(np.maximum(counts, 1))).astype(np.uint16)


def shards_of(codes: np.ndarray) -> np.ndarray:
    """Over how many shards keys of tokens with these codes are dealt."""
    return np.ceil(2.0 ** ((codes.astype(np.float64) + 1) / 8) / SHARD).astype(np.int64)


@cache
def _picks(n: int, k: int) -> np.ndarray:
    return np.array(list(itertools.combinations(range(n), k)), np.int64)


def keys_of(values: np.ndarray, codes: np.ndarray, n: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a set of n tokens, of which those that others have are given by code and value: index keys, each key's least
    code, and how many tokens come before all that the set can share if it shares the key. A token before a single
    one would be a common key itself; combinations are only needed by sets that share no rare token."""
    first = n - len(values)  # in the order, the tokens that no other document has lead
    rare = int(np.searchsorted(codes, 8 * np.log2(FREQUENT)))
    need = needed(n, percent)
    single = slice(0, max(0, need - first)) if first + rare >= need else slice(0, rare)
    at = np.arange(first, first + len(values[single]))
    new = np.append(True, values[single][1:] != values[single][:-1])[: len(at)]
    keys, found, places = [mixed(values[single][new])], [codes[single][new]], [at[new]]
    if first + rare < need:
        before = first + rare
        values, codes = values[rare:], codes[rare:]
        size = n.bit_length() - 1
        for level in (size, size - 1) if percent * n <= 100 * ((1 << size) - 1) else (size,):
            k = 2 + ((codes.astype(np.int64) >> 3) - FREQUENT.bit_length() + 1) // (FACTOR.bit_length() - 1)
            k = np.minimum(k, 4 if level >= 5 else 2)
            dealt = np.maximum(1, (1 << max(level, 0)) // (7 * (k - 1))).astype(np.uint64)
            classes = (mixed(values + np.uint64(level)) % dealt).astype(np.int64) * 8 + k
            by = np.argsort(classes, kind="stable")
            starts = np.flatnonzero(np.append(True, classes[by][1:] != classes[by][:-1]))
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by)) - np.repeat(starts, np.diff(np.append(starts, len(by))))
            end = int(np.searchsorted(np.cumsum(rank >= k - 1), need - before))
            other = np.flatnonzero(values[end:] != values[min(end, len(values) - 1)])  # equal ones are all taken
            end = end + int(other[0]) if len(other) else len(values)
            by = by[by < end]
            starts = np.flatnonzero(np.append(True, classes[by][1:] != classes[by][:-1])[: len(by)])
            for a, b in zip(starts, np.append(starts[1:], len(by))):
                size_k = int(k[by[a]])
                if b - a < size_k:
                    continue
                picks = by[a:b][_picks(int(b - a), size_k)]
                key = np.full(len(picks), 8 * (level + 1) + size_k, np.uint64)
                for column in picks.T:
                    key = mixed(key ^ values[column])
                keys.append(key)
                found.append(codes[picks].min(axis=1))
                places.append(np.full(len(key), before))
    return np.concatenate(keys), np.concatenate(found), np.concatenate(places)


def _sets(batch: pa.RecordBatch, hashes: Hashes, width: int) -> Iterator[np.ndarray]:
    for text in batch.column("text"):
        yield shingle_set(hashes.of(spaced(text.as_py())), width)


def _expanded(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)


def _indexed(docs: DataFrame, width: int, percent: int, under: str) -> DataFrame:
    """Staged by kind: "docs" rows (doc_id, n, node) of all documents, and "keys" rows (key, node, n, pos, shards) of
    sets that have enough tokens in common with others."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(8, -(-size // BUCKET_BYTES)))
    bits = int(max(1, size // 2)).bit_length() + 3  # a token takes two bytes of text at least, and six or more in prose
    per_bucket = -(-(1 << bits) // buckets)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["bucket", "chunk", "parts", "doc_ids"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ids, sizes, nodes, owners, lists, seen, held = Hashes(200_000), [], [], [], [], [], set(), 0

        def flush() -> pa.RecordBatch:
            name, lengths = uuid.uuid4().hex, np.array([len(x) for x in lists], np.int64)
            values = np.concatenate(lists) >> np.uint64(64 - bits) if lists else np.empty(0, np.uint64)
            owner = np.repeat(np.array(owners, np.uint32), lengths)
            by = np.argsort(values, kind="stable")
            values, owner = values[by], owner[by]
            start = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
            count = np.diff(np.append(start, len(values)))
            values, own = values[start], owner[start]
            cuts = np.searchsorted(values, np.arange(buckets + 1, dtype=np.uint64) * np.uint64(per_bucket))
            rows: list[tuple] = []
            for b in range(buckets):
                x = slice(cuts[b], cuts[b + 1])
                if cuts[b] < cuts[b + 1]:
                    place, one = values[x] - np.uint64(b * per_bucket), count[x] == 1
                    rows.append((b, name, [gaps(place[one]), pack(own[x][one]), gaps(place[~one]), pack(count[x][~one].astype(np.uint32))], None))
            many = count > 1  # who has them need not go to the buckets
            about = [pack(np.array(sizes, np.int64)), pack(np.array(nodes, np.int64)), gaps(values[many]), pack(count[many].astype(np.uint32)), pack(owner[_expanded(start[many], count[many])])]
            rows.append((int(name[:8], 16) % buckets, name, about, pa.concat_arrays(ids).to_pylist()))
            types = (pa.int32(), pa.string(), pa.list_(pa.binary()), pa.list_(ids[0].type))
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names)

        for batch in batches:
            at = 0
            for i, (doc_id, tokens) in enumerate(zip(batch.column("doc_id"), _sets(batch, hashes, width))):
                node = node_of(tokens)
                sizes.append(len(tokens))
                nodes.append(node)
                if len(tokens) and doc_id.is_valid and node not in seen:
                    seen.add(node)
                    owners.append(len(nodes) - 1)
                    lists.append(tokens)
                    held += len(tokens)
                if held >= CHUNK or len(nodes) >= CHUNK // 8:
                    ids.append(batch.column("doc_id").slice(at, i + 1 - at))
                    yield flush()
                    ids, sizes, nodes, owners, lists, seen, held, at = [], [], [], [], [], set(), 0, i + 1
            if at < batch.num_rows:
                ids.append(batch.column("doc_id").slice(at))
        if nodes:
            yield flush()
        del ids, sizes, nodes, owners, lists, seen, hashes
        release()

    def meet(rows: pa.Table) -> pa.Table:
        own = rows.filter(pc.is_valid(rows.column("doc_ids")))
        rows = rows.filter(pc.is_null(rows.column("doc_ids")))
        bucket, chunks = rows.column("bucket").to_pylist()[:1], rows.column("chunk").to_pylist()
        value, weight, single, owner, at = [], [], [], [], []
        for i, (one, who, many, count) in enumerate(rows.column("parts").to_pylist()):
            for v, w in ((sums(one), None), (sums(many), unpack(count, np.uint32))):
                value.append(v)
                weight.append(np.ones(len(v), np.int64) if w is None else w.astype(np.int64))
                single.append(w is None)
                at.append(i)
            owner.append(unpack(who, np.uint32))
        out = []
        if chunks:
            lengths = [len(v) for v in value]
            every = np.concatenate(value)
            by = np.argsort(every, kind="stable")
            start = np.flatnonzero(np.append(True, every[by][1:] != every[by][:-1])[: len(by)])
            codes = np.empty(len(by), np.uint16)
            codes[by] = np.repeat(codes_of(np.add.reduceat(np.concatenate(weight)[by], start)), np.diff(np.append(start, len(by))))
            parts = np.split(codes, np.cumsum(lengths)[:-1])
            for i, name in enumerate(chunks):
                one, many = parts[2 * i], parts[2 * i + 1]
                shared = one > 0
                out.append((bucket[0], name, [gaps(value[2 * i][shared] + np.uint64(bucket[0] * per_bucket)), pack(owner[i][shared]), pack(one[shared]), pack(many)], None))
        columns = [pa.array([r[i] for r in out], t) for i, t in enumerate(rows.schema.types)]
        return pa.concat_tables([own, pa.Table.from_arrays(columns, schema=rows.schema)])

    def gather(rows: pa.Table) -> pa.Table:
        items = rows.to_pylist()
        about = next(r for r in items if r["doc_ids"] is not None)
        items = sorted((r for r in items if r["doc_ids"] is None), key=lambda r: r["bucket"])
        sizes, nodes, many, count, who = (f(x) for f, x in zip((lambda x: unpack(x, np.int64), lambda x: unpack(x, np.int64), sums, lambda x: unpack(x, np.uint32), lambda x: unpack(x, np.uint32)), about["parts"]))
        values, owner, code = ([f(r["parts"][i]) for r in items] for i, f in enumerate((sums, lambda x: unpack(x, np.uint32), lambda x: unpack(x, np.uint16))))
        common = np.concatenate([np.empty(0, np.uint16), *(unpack(r["parts"][3], np.uint16) for r in items)])
        value, owner, code = np.concatenate([*values, np.repeat(many, count)]), np.concatenate([*owner, who]), np.concatenate([*code, np.repeat(common, count)])
        enough = np.bincount(owner, minlength=len(sizes)) * 100 >= percent * sizes
        left = enough[owner]
        value, owner, code = value[left], owner[left], code[left]
        by = np.lexsort((value, code, owner))
        value, owner, code = value[by], owner[by], code[by]
        cuts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])[: len(owner)])
        keys, doc = [[], [], []], []
        for a, b in zip(cuts, np.append(cuts[1:], len(owner))):
            found = keys_of(value[a:b], code[a:b], int(sizes[owner[a]]), percent)
            for column, x in zip(keys, found):
                column.append(x)
            doc.append(np.full(len(found[0]), owner[a], np.int64))
        key, code, pos, doc = (np.concatenate([np.empty(0, np.int64), *x]) for x in (*([y.view(np.int64) for y in keys[0]], *keys[1:]), doc))
        n, k = len(sizes), len(doc)
        kinds, whole = pa.array(["docs"] * n + ["keys"] * k), rows.schema.field("doc_ids").type.value_type
        ints = lambda a, b: pa.concat_arrays([pa.nulls(n, pa.int64()) if a is None else pa.array(a, pa.int64()), pa.array(b, pa.int64())])
        ids = pa.concat_arrays([pa.array(about["doc_ids"], whole), pa.nulls(k, whole)])
        return pa.table([kinds, ids, ints(sizes, sizes[doc]), ints(nodes, nodes[doc]), ints(None, key), ints(None, pos), ints(None, shards_of(code))], ["kind", "doc_id", "n", "node", "key", "pos", "shards"])

    packed = f"bucket int, chunk string, parts array<binary>, doc_ids array<{kind}>"
    met = docs.mapInArrow(send, packed).groupBy("bucket").applyInArrow(meet, packed)
    return staged(met.groupBy("chunk").applyInArrow(gather, f"kind string, doc_id {kind}, n long, node long, key long, pos long, shards long"), "index", "kind", under=under)


def _shard(of: str) -> Column:
    return F.pmod(F.xxhash64(of), F.col("shards"))


def _per_key(keys: DataFrame, *found) -> DataFrame:
    """keys with what is found over all rows of their key; rows of a key meet it in as many places as it has shards."""
    each = keys.groupBy("key").agg(*found, F.max("shards").alias("of"))
    each = each.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("of") - 1))).drop("of")
    return keys.withColumn("shard", _shard("node")).join(each, ["key", "shard"]).drop("shard")


def _shared_keys(index: DataFrame, percent: int, under: str) -> DataFrame:
    """(key, node, n, pos, shards) of the keys that more than one node has, of nodes that another one with the key
    may be similar to. Staged."""
    keys = index.where("kind = 'keys'").groupBy("key", "node").agg(F.first("n").alias("n"), F.min("pos").alias("pos"), F.max("shards").alias("shards"))
    met = _per_key(keys, F.count("*").alias("nodes"), F.min("n").alias("least")).where("nodes > 1")
    other = F.greatest("least", F.ceil(F.col("n") * percent / 100))  # the smallest set that could be similar
    return staged(met.where((F.col("n") - F.col("pos")) * (100 + percent) >= (F.col("n") + other) * percent).select("key", "node", "n", "pos", "shards"), "keys", under=under)


def _texts(docs: DataFrame, index: DataFrame, keys: DataFrame, width: int, under: str) -> DataFrame:
    """(node, text, parities) of the nodes that share keys, texts compressed; of one document each. Staged."""
    wanted = index.where("kind = 'docs' AND doc_id IS NOT NULL").select("node", "doc_id").join(keys.select("node").distinct(), "node", "left_semi")
    one = staged(wanted.groupBy("node").agg(F.min("doc_id").alias("doc_id")), "nodes", under=under)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, press = Hashes(), zstandard.ZstdCompressor(level=3)
        for batch in batches:  # ids may repeat with other texts
            rows = []
            for node, text, tokens in zip(batch.column("node").to_pylist(), batch.column("text"), _sets(batch, hashes, width)):
                if node_of(tokens) == node:
                    odd = np.bincount((tokens % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
                    rows.append((node, press.compress(text.as_py()), np.packbits(odd.astype(np.uint8)).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["node", "text", "parities"])

    found = meeting(docs, one.select("doc_id"), "doc_id").join(one, "doc_id").select("node", "text")
    return staged(found.mapInArrow(giving_back(squeeze), "node long, text binary, parities binary"), "texts", under=under)


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int, under: str) -> DataFrame:
    """The pairs (a, b) that are similar enough. A node's pairs go in groups of bounded size past its set. Staged."""
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    dealt = pairs.join(groups, "a").select("a", "b", F.pmod(F.xxhash64("b"), "groups").alias("part"))
    held = F.col("node").alias("b")
    members = dealt.join(texts.select(held, "text"), "b").select("a", "part", "b", "text", F.lit(1).alias("after"))
    leaders = dealt.select("a", "part").distinct().join(texts.select(F.col("node").alias("a"), "text"), "a").select("a", "part", F.col("a").alias("b"), "text", F.lit(0).alias("after"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, raw, lead, tokens = Hashes(), zstandard.ZstdDecompressor(), None, None
        for batch in batches:
            rows = []
            for a, b, text, after in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text", "after"))):
                own = shingle_set(hashes.of(spaced(raw.decompress(text))), width)
                if not after:
                    lead, tokens = a, own
                elif lead == a:
                    common = len(tokens) + len(own) - len(np.union1d(tokens, own))
                    if 100 * common >= percent * (len(tokens) + len(own) - common):
                        rows.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["a", "b"])

    rows = members.union(leaders).repartition("a", "part").sortWithinPartitions("a", "part", "after")
    return staged(rows.mapInArrow(giving_back(verify), "a long, b long"), "links", under=under)


def _crossing(keys: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes of different roots that share a key and may be similar by their parities. Of keys of
    the same nodes, the first in the order stands for all, as it comes first in each of them; a key's nodes are dealt into tiles, and each two tiles meet in one task. A pair comes from the least key it shares."""
    members = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.count("*").alias("nodes")]
    lists = keys.groupBy("key").agg(*members, F.sum("pos").alias("places"), F.max("shards").alias("shards")).groupBy("x", "y", "nodes").agg(F.min(F.struct("places", "key", "shards")).alias("first"))
    each = lists.select("first.key", F.ceil(F.col("nodes") / TILE).alias("tiles"), F.explode(F.sequence(F.lit(0), F.col("first.shards") - 1)).alias("shard"))
    rows = keys.withColumn("shard", _shard("node")).join(each, ["key", "shard"]).withColumn("tile", F.pmod(F.xxhash64("node", F.lit(2)), "tiles"))
    about = rows.groupBy("node").agg(F.collect_list("key").alias("keys")).join(texts.select("node", "parities"), "node")  # a set's keys are as bounded as its text
    rows = rows.join(about, "node").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("key", F.least("tile", "with").alias("i"), F.greatest("tile", "with").alias("j"), "tile", "node", "root", "n", "keys", "parities")

    def cross(group: pa.Table) -> pa.Table:
        alone = group.column("i")[0].as_py() == group.column("j")[0].as_py()
        tile, node, root, n = (group.column(c).to_numpy() for c in ("tile", "node", "root", "n"))
        key, keys = group.column("key")[0].as_py(), [frozenset(x) for x in group.column("keys").to_pylist()]
        bits = np.frombuffer(b"".join(group.column("parities").to_pylist()), np.uint64).reshape(len(node), PARITIES // 64)
        found: list[np.ndarray] = [np.empty((2, 0), np.int64)]
        for r in range(len(node) - 1):
            x = np.arange(r + 1, len(node))
            x = x[(root[r] != root[x]) & (alone | (tile[r] != tile[x])) & (np.minimum(n[r], n[x]) * 100 >= np.maximum(n[r], n[x]) * percent)]
            differ = np.bitwise_count(bits[r] ^ bits[x]).sum(axis=1, dtype=np.int64)
            x = x[100 * (n[r] + n[x] - differ) >= percent * (n[r] + n[x] + differ)]
            x = np.array([i for i in x if min(keys[r] & keys[i]) == key], np.int64)
            found.append(np.stack([np.full(len(x), node[r]), node[x]]))
        a, b = np.concatenate(found, axis=1)
        return pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return rows.groupBy("key", "i", "j").applyInArrow(cross, "a long, b long")


def _placed(docs: DataFrame, width: int, percent: int, under: str) -> DataFrame:
    """Per row of docs (doc_id and text): doc_id, n, node, root (the least node reachable) and component_id. Staged."""
    index = _indexed(docs, width, percent, under)
    keys = _shared_keys(index, percent, under)
    texts = _texts(docs, index, keys, width, under)
    # of two similar sets, the first common token leaves enough tokens behind it in both
    fits = (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent)

    def led(keys: DataFrame, leaders: int) -> DataFrame:
        """Nodes beside so many leaders of each of their keys: those of least hash."""
        leads = F.array_distinct(F.transform(F.array(*[F.min(F.struct(F.xxhash64("node", F.lit(i)), "node", "n", "pos")) for i in range(leaders)]), lambda x: F.struct(x["node"].alias("node"), x["n"].alias("n"), x["pos"].alias("pos"))))
        rows = _per_key(keys, leads.alias("leads")).withColumn("lead", F.explode("leads"))
        return rows.select(F.col("lead.node").alias("a"), F.col("node").alias("b"), F.col("lead.n").alias("n_a"), F.col("n").alias("n_b"), F.col("lead.pos").alias("pos_a"), F.col("pos").alias("pos_b")).where("a <> b").where(fits)

    hits = led(keys, 1).groupBy("a", "b").agg(F.count("*").alias("hits"))
    tried = staged(hits.groupBy("b").agg(F.max(F.struct("hits", "a")).alias("best")).select(F.col("best.a").alias("a"), "b"), "tried", under=under)
    links = _verified(tried, texts, width, percent, under)
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    for last in (False, True):
        roots = components(links, "components", under)
        colored = keys.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        open_keys = _per_key(colored, F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        keys = staged(open_keys.select("key", "node", "n", "pos", "shards", "root"), "open", under=under)
        if last:
            pairs = _crossing(keys, texts, percent)
        else:
            side = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
            apart_ = led(keys.drop("root"), LEADERS).groupBy("a", "b").agg(F.count("*").alias("hits")).join(side("a"), "a", "left").join(side("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
            # those that a node shares most keys with; the last round has all others
            pairs = apart_.withColumn("place", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("hits"), "a"))).where(F.col("place") <= MOST_LEADERS).select("a", "b")
        fresh = staged(pairs.select(*ordered).distinct().join(tried.select(*ordered), ["a", "b"], "left_anti"), "tried", under=under)
        tried, keys = tried.union(fresh), keys.drop("root")
        links = links.union(_verified(fresh, texts, width, percent, under))
    roots = components(links, "components", under)
    placed = index.where("kind = 'docs'").select("doc_id", "n", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")))
    return staged(placed.join(least, "root", "left").select("doc_id", "n", "node", "root", component.alias("component_id")), "jaccard-components")


def _checked(docs: DataFrame, percent: int, text: str) -> DataFrame:
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", text_bytes(text).alias("text"))


def linked(docs: DataFrame, *, width: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the least doc_id reachable by links)."""
    docs = _checked(docs, percent, text)
    with scratch(docs.sparkSession, "jaccard") as under:
        placed = _placed(docs, width, percent, under)
    return placed.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component: the one of the least doc_id, in full and with its own columns. Rows
    without doc_id stay. Where an id has several rows, each is judged by its own text; of those that are in one
    component, or have the same text, one stays."""
    rows = _checked(docs, percent, "text")
    with scratch(docs.sparkSession, "jaccard") as under:
        placed = _placed(rows, width, percent, under).where("doc_id IS NOT NULL")
    repeated = staged(placed.groupBy("doc_id").count().where("count > 1").select("doc_id"), "jaccard-repeated")
    gone = placed.where("doc_id <> component_id").select("doc_id")
    if repeated.isEmpty():
        return apart(docs, gone, "doc_id")
    group = F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("node"))
    first = placed.where("doc_id = component_id").join(repeated, "doc_id", "left_semi").groupBy("doc_id", group.alias("group")).agg(F.min("node").alias("node")).select("doc_id", "node")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([node_of(x) for x in _sets(batch, hashes, width)], pa.int64())], ["row", "node"])

    several = meeting(docs, repeated, "doc_id").select(F.struct("*").alias("row"), text_bytes().alias("text"))
    named = several.mapInArrow(giving_back(name), f"row {several.schema['row'].dataType.simpleString()}, node long").withColumn("doc_id", F.col("row.doc_id"))
    kept = named.join(first, ["doc_id", "node"], "left_semi").dropDuplicates(["doc_id", "node"]).select("row.*")
    return apart(docs, gone.union(repeated).distinct(), "doc_id").union(kept)
