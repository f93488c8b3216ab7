"""Merkle dataset manifest: a tree of hashes by language and one above them, built and checked in Pregel-style supersteps.

H is the lowercase hex sha256 of its inputs one after the other; digests go in as hex text. A row's leaf is H of its
fields, each `-` if null, else the UTF-8 bytes' number, `:` and the value. In each tree leaves ascend by the order
column; every two consecutive nodes (a last one alone, too) become their H until one is left, the subroot. Subroots by
the tree column's bytes (null first) form the tree of the root.

A vertex of the supersteps is a block of 2^SPAN places of one tree. Upward, children send their digests to their
block's vertex; when all it waits for have come, it hashes SPAN levels and sends its own digest on, until one is left
of its tree. Downward, from the root, each vertex completes the siblings' path that it got for each of its children and
sends it to them, down to the leaves, which fold what they hold now with their path and compare it with the root. Each
superstep is one shuffle of messages whose groups have 2^SPAN children at most; the vertices between are files in the
shared folder, so lost executors cost no more than their tasks, and the driver sees only the trees' largest height.

Null fields, ids and tree values are values as any; null ids stand first, rows of one id by their leaf; rows that are
alike in all fields are leaves of their own, in any order, as their digests are the same. An empty table gives an empty
result. Texts of any length are hashed where they are read; other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator, Mapping

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_path, partitions, scratch, staged
from .ranking import ranked

#: Levels of a tree that a vertex holds: 2^SPAN children at most.
SPAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

Node = bytes  # 64 hex digits
Key = tuple[object, int]  # tree, block
Path = list[tuple[int, Node]]  # upward: LEFT or RIGHT and the sibling, or ALONE
LEFT, RIGHT, ALONE = 0, 1, 2


def digest(*inputs: Node) -> Node:
    return hashlib.sha256(b"".join(inputs)).hexdigest().encode()


def leaf_digest(fields: Iterable[Column]) -> Column:
    """H of a row's fields, as SQL."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def climbed(children: list[Node], n: int) -> list[list[Node]]:
    """The levels of a block, its children first, of a tree with n nodes on the children's level."""
    levels = [children]
    for _ in range(SPAN):
        if n == 1:
            break
        now = levels[-1]
        levels.append([digest(*now[i : i + 2]) for i in range(0, len(now), 2)])
        n = (n + 1) // 2
    return levels


def siblings(levels: list[list[Node]], child: int) -> Path:
    """The path of a child up to its block's top."""
    path: Path = []
    for level in levels[:-1]:
        other = child ^ 1
        path.append((LEFT, level[other]) if child & 1 else (RIGHT, level[other]) if other < len(level) else (ALONE, b""))
        child >>= 1
    return path


def folded(node: Node, path: Path) -> Node:
    for side, other in path:
        node = digest(other, node) if side == LEFT else digest(node, other) if side == RIGHT else digest(node)
    return node


def height(n: int) -> int:
    return (n - 1).bit_length() if n > 1 else 0


def top_step(n: int) -> int:
    """The superstep in which a tree of n leaves is down to one node."""
    return max(0, -(-height(n) // SPAN) - 1)


def _place(key: Key) -> int:
    return zlib.crc32(repr(key).encode())


class Forest:
    """Trees over ranked rows (tree, rank, n, digest, held: what goes down to the leaf with its path)."""

    def __init__(self, rows: DataFrame, folder: str):
        self.spark, self.folder = rows.sparkSession, folder
        self.many = partitions(self.spark)
        self.steps: list[RDD] = []
        most = rows.agg(F.max("n")).first()[0] or 0
        sent = rows.select("tree", "rank", "n", "digest", "held").rdd.map(lambda r: ((r.tree, r.rank >> SPAN), (r.rank, r.n, r.digest.encode(), tuple(r.held))))
        for step in range(top_step(most) + 1):
            vertices = self._kept(sent.groupByKey(self.many, _place).map(_vertex), f"up{step}")
            self.steps.append(vertices)
            sent = vertices.filter(lambda v: v[1][0] > 1 << SPAN).map(_forwarded)

    def _kept(self, rdd: RDD, name: str) -> RDD:
        """rdd as files in the shared folder: cuts lineage."""
        path = new_path(self.spark, name, self.folder)
        rdd.saveAsPickleFile(path)
        return self.spark.sparkContext.pickleFile(path)

    def roots(self) -> RDD:
        """(tree, its root) of all trees."""
        return self.spark.sparkContext.union([v.filter(lambda v: v[1][0] <= 1 << SPAN).map(lambda v: (v[0][0], climbed(v[1][1], v[1][0])[-1][0])) for v in self.steps])

    def down(self, start: RDD) -> RDD:
        """(leaf's digest, held, path, said) of all leaves; start has (tree, (its n, path above its root, what all its leaves are told))."""
        sc, told = self.spark.sparkContext, None
        for step in reversed(range(len(self.steps))):
            here = start.filter(lambda t, step=step: top_step(t[1][0]) == step).map(lambda t: ((t[0], 0), t[1][1:]))
            told = here if told is None else sc.union([here, told])
            met = sc.union([self.steps[step], told.map(lambda m: (m[0], (None, *m[1])))]).groupByKey(self.many, _place)
            if step:
                told = self._kept(met.flatMap(_told), f"down{step}")
        return met.flatMap(_leaves)


def _vertex(group: tuple[Key, Iterable[tuple]]) -> tuple[Key, tuple]:
    """(key, (nodes of the tree on the children's level, children, what leaves hold)) when all children have come."""
    key, messages = group
    messages = sorted(messages, key=lambda m: m[0])
    n = messages[0][1]
    if len(messages) != min(1 << SPAN, n - (key[1] << SPAN)):
        raise ValueError(f"block {key} has {len(messages)} children of a tree of {n}")
    return key, (n, [m[2] for m in messages], [m[3] for m in messages])


def _forwarded(vertex: tuple[Key, tuple]) -> tuple[Key, tuple]:
    (tree, block), (n, children, _) = vertex
    return (tree, block >> SPAN), (block, -(-n // (1 << SPAN)), climbed(children, n)[-1][0], ())


def _children(group: tuple[Key, Iterable[tuple]]) -> Iterator[tuple[int, Node, tuple, Path, object]]:
    """Each child of a vertex with its whole path; the vertex's state and what it is told come in any order."""
    state = path = said = None
    for value in group[1]:
        if value[0] is None:
            _, path, said = value
        else:
            state = value
    n, children, held = state
    levels = climbed(children, n)
    for i, (child, own) in enumerate(zip(children, held, strict=True)):
        yield i, child, own, siblings(levels, i) + path, said


def _told(group: tuple[Key, Iterable[tuple]]) -> Iterator[tuple[Key, tuple[Path, object]]]:
    (tree, block) = group[0]
    for i, _, _, path, said in _children(group):
        yield (tree, block << SPAN | i), (path, said)


def _leaves(group: tuple[Key, Iterable[tuple]]) -> Iterator[tuple[Node, tuple, Path, object]]:
    for _, child, own, path, said in _children(group):
        yield child, own, path, said


def _proved(leaf: tuple[Node, tuple, Path, tuple[Node, Node]]) -> tuple:
    node, (ident, now), path, (subroot, root) = leaf
    found = folded(now.encode() if now else node, path)
    return ident, node.decode(), subroot.decode(), root.decode(), digest(*[other for _, other in path]).decode(), found.decode(), found == root


def manifest(docs: DataFrame, fields: Iterable[str] = FIELDS, order: str = "doc_id", tree: str = "lang", now: Mapping[str, Column] | None = None) -> DataFrame:
    """The manifest of docs, checked: order's column, leaf, subroot, root, proof_sha256 (H of the siblings from the leaf
    up), folded_root (from what the row holds now and its siblings) and verified. now has what fields hold when they are
    checked, as far as that differs from docs."""
    spark, now = docs.sparkSession, now or {}
    ident = docs.schema[order].dataType.simpleString()
    column = {f: F.col(f"`{f}`") for f in fields}
    leaf = leaf_digest(column.values())
    held = leaf_digest(now.get(f, c) for f, c in column.items())
    with scratch(spark, "manifest") as folder:
        leaves = staged(docs.select(F.col(f"`{order}`").alias("ident"), F.col(f"`{tree}`").cast("string").alias("tree"), leaf.alias("digest"), (held if now else F.lit(None).cast("string")).alias("now")), "leaves", under=folder)
        leaves = leaves.withColumn("now", F.when(F.col("now") != F.col("digest"), F.col("now")))
        rows = ranked(leaves, [F.col("ident").asc_nulls_first(), F.col("digest")], "tree", under=folder)
        rows = staged(rows.select("tree", "rank", "n", "digest", F.struct("ident", "now").alias("held")), "ranked", under=folder)
        low = Forest(rows, folder)
        roots = spark.createDataFrame(low.roots().map(lambda t: (t[0], t[1].decode())), "tree string, digest string", verifySchema=False)
        sizes = rows.where("rank = 0").select(F.col("tree").alias("its"), F.col("n").alias("leaves"))
        roots = staged(roots.join(sizes, F.col("tree").eqNullSafe(F.col("its"))).select("tree", "digest", "leaves"), "roots", under=folder)
        if roots.isEmpty():
            return spark.createDataFrame([], _schema(order, ident))
        above = staged(ranked(roots, [F.col("tree").asc_nulls_first()], under=folder).select(F.lit("root").alias("tree"), "rank", "n", "digest", F.struct("tree", "leaves").alias("held")), "above", under=folder)
        high = Forest(above, folder)
        root = high.roots().map(lambda t: (t[0], t[1]))
        n = above.first().n
        start = high.down(root.map(lambda t: (t[0], (n, [], t[1]))))  # one tree
        proved = low.down(start.map(lambda x: (x[1][0], (x[1][1], x[2], (x[0], x[3])))))
        return staged(spark.createDataFrame(proved.map(_proved), _schema(order, ident), verifySchema=False), "proved")


def _schema(order: str, ident: str) -> str:
    return f"`{order}` {ident}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def tampered_report(docs: DataFrame) -> DataFrame:
    """The manifest of documents, checked after 1 was added to n_chars wherever 7 divides the id's crc32 (never where either is null)."""
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return manifest(docs, now={"n_chars": F.when(hit, more).otherwise(F.col("n_chars").cast("string"))})
