"""Byte-level BPE by a lazily determinised transducer with registers, and streaming decoding.

The last token of the encoding of a prefix is the one token that ends the prefix and *stands* after the
encoding of what precedes it: merging the bytes of both tokens gives back the two tokens. So every
position of the input where a token may begin is a thread: a node of the vocabulary's trie. Threads that die drop out,
and the oldest live one says which others live, as their bytes are ends of its own; such a set is a state. Its transition
by a byte names the tokens that end there. One register a position holds the last token of the prefix, which is the first
of these that stands after the register at its own beginning; read backwards, registers give the ids. States and their
transitions are built when first met, do not depend on the tokens before, and are forgotten together when the table is full.

Nulls encode as the empty text; empty texts give no ids and decode to empty bytes. Texts, and pieces within them, may
have any length; each row is encoded by itself, so repeated rows and ids give a row each; an empty table gives an empty
one. Columns of docs that no result has may have any names.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import struct
from array import array
from collections.abc import Callable, Iterable, Iterator
from contextlib import AbstractContextManager, contextmanager
from threading import Lock, Timer

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .packing import release

NEVER = 1 << 60
#: Bytes from which on a piece is rare enough for arrays.
LONG = 256


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class _State(dict):
    """Transitions by byte: (next state, tokens that end there, longest first, each with where the one before it is, from
    the end, and what it stands after). threads: live trie nodes with the bytes they have read, oldest first."""

    __slots__ = ("missing", "threads")

    def __init__(self, threads: tuple, missing: Callable[[_State, int], tuple]):
        self.threads, self.missing = threads, missing

    def __missing__(self, byte: int) -> tuple[_State, tuple]:
        return self.missing(self, byte)


class _Stands(dict):
    """Whether a token stands after another one, by that; -1 is the beginning of a piece."""

    __slots__ = ("missing", "token")

    def __init__(self, token: int, missing: Callable[[int, int], bool]):
        self.token, self.missing = token, missing
        self[-1] = True

    def __missing__(self, left: int) -> bool:
        known = self[left] = self.missing(left, self.token)
        return known


class _Packs(dict):
    def __missing__(self, n: int) -> Callable[..., bytes]:
        self[n] = struct.Struct(f"<{n}I").pack
        return self[n]


PACK = _Packs()


class MergeTransducer:
    """Encodes byte pieces by ranked merges, a byte at a time."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 100_000):
        self.ranks, self.max_states = ranks, max_states
        self.token = {rank: token for token, rank in ranks.items()}
        self.child: dict[int, int] = {}
        self.ends = [-1]
        self.inner = [False]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                below = self.child.get(node << 8 | byte)
                if below is None:
                    below = self.child[node << 8 | byte] = len(self.ends)
                    self.ends.append(-1)
                    self.inner.append(False)
                    self.inner[node] = True
                node = below
            self.ends[node] = rank
        self.length = {rank: len(token) for rank, token in self.token.items()}
        self.edges: tuple[dict, dict] = {}, {}
        self._forget()

    def _forget(self) -> None:
        for state in getattr(self, "states", {}).values():
            state.clear()  # states refer to each other
        self.states: dict[int, _State] = {}
        self.after: dict[int, _Stands] = {}
        self.pairs = 0
        self.start = self._state(((0, 0),))

    def _state(self, threads: tuple) -> _State:
        known = self.states.get(threads[0][0])
        if known is None:
            known = self.states[threads[0][0]] = _State(threads, self._transition)
        return known

    def merged(self, piece: bytes, until: int = 1) -> list[bytes]:
        """Plain merging, lowest rank and then leftmost first; only for tokens, to find their halves."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        rank = self.ranks.get
        while len(parts) > until:
            costs = [rank(a + b, NEVER) for a, b in zip(parts, parts[1:])]
            least = min(costs)
            if least == NEVER:
                break
            at = costs.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, token: bytes) -> tuple[bytes, bytes]:
        """What the last merge that makes a token joins."""
        return tuple(self.merged(token, 2))

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The parts of a token at one edge while it is merged, and the rank of the merge that ends each."""
        known = self.edges[side].get(token)
        if known is None:
            known = [(token, NEVER)]
            if len(token) > 1:
                inner = self._edge(self._halves(token)[side], side)
                known += [(inner[0][0], self.ranks[token]), *inner[1:]]
            self.edges[side][token] = known
        return known

    def _stands(self, left: int, right: int) -> bool:
        """No merge across the border comes before the merges on either side. Of equal ranks the leftmost goes first."""
        self.pairs += 1
        if self.pairs >= 2 * self.max_states:
            for known in self.after.values():
                known.clear()
                known[-1] = True
            self.pairs = 0
        rank = self.ranks.get
        for b, until_b in self._edge(self.token[right], 0):
            for a, until_a in self._edge(self.token[left], 1):
                joined = rank(a + b)
                if joined is not None and joined < until_a and joined <= until_b:
                    return False
        return True

    def _transition(self, state: _State, byte: int) -> tuple[_State, tuple]:
        alive, ended = [], []
        for node, n in state.threads:
            below = self.child.get(node << 8 | byte)
            if below is None:
                continue
            if self.inner[below]:
                alive.append((below, n + 1))
            if (token := self.ends[below]) >= 0:
                if token not in self.after:
                    self.after[token] = _Stands(token, self._stands)
                ended.append((~n, token, self.after[token]))
        alive.append((0, 0))
        if full := len(self.states) >= self.max_states:
            self._forget()
        made = (self._state(tuple(alive)), tuple(ended))
        if not full:
            state[byte] = made
        return made

    def encode(self, piece: bytes) -> bytes:
        """Ids of one piece as little-endian unsigned 32-bit integers."""
        state, last = self.start, [-1] if len(piece) < LONG else array("q", [-1])
        for byte in piece:
            state, ended = state[byte]
            for before, token, stands in ended:
                if stands[last[before]]:
                    last.append(token)
                    break
            else:
                raise ValueError(f"byte {byte} cannot be encoded by this vocabulary")
        ids, at, length = [], len(piece), self.length
        while at:
            ids.append(last[at])
            at -= length[last[at]]
        ids.reverse()
        return PACK[len(ids)](*ids) if len(piece) < LONG else np.array(ids, "<u4").tobytes()


class _Units(dict):
    """Ids by unit of text, encoded when missing and kept from the second time on, as most units never come again; when
    full, units not used since the last time are forgotten."""

    MARKS = 1 << 20

    def __init__(self, encode: Callable[[str], bytes], most: int = 100_000):
        self.encode, self.most, self.older, self.met = encode, most, {}, bytearray(self.MARKS)

    def __missing__(self, unit: str) -> bytes:
        ids = self.older.get(unit)
        if ids is None:
            ids, at = self.encode(unit), hash(unit) % self.MARKS
            if not self.met[at]:
                self.met[at] = 1
                return ids
        if len(self) >= self.most:
            self.older, self.met = dict(self), bytearray(self.MARKS)
            self.clear()
        self[unit] = ids
        return ids


class BpeCodec:
    """Whole texts to packed ids and back. pattern splits texts into the pieces that are encoded separately. Under the
    public tokenizers' pattern a match begins at each single space between other characters, so that units between such
    spaces are looked up whole; under any other pattern texts are taken piece by piece."""

    #: A single space before a unit starts a match of its own; next to other white space it does not.
    UNEVEN = regex.compile(r"\s[ ]|[ ]\s|\A[ ]|[ ]\Z")

    def __init__(self, ranks: dict[bytes, int], pattern: str, room: float = 1.0):
        """room: of what its tables may hold; with less, more is built again."""
        self.machine = MergeTransducer(ranks, int(100_000 * room))
        self.pieces, self.by_space = regex.compile(pattern).findall, pattern == public_tokenizers.PATTERN
        self.piece = _Units(lambda piece: self.machine.encode(piece.encode()), int(100_000 * room))
        self.unit = _Units(self._pieces, int(20_000 * room))
        self.spaced = _Units(lambda unit: self._pieces(" " + unit), int(100_000 * room))
        self.token = [self.machine.token.get(i, b"") for i in range(max(self.machine.token, default=-1) + 1)]

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.piece.__getitem__, self.pieces(text)))

    def encode(self, text: str) -> bytes:
        if not self.by_space or self.UNEVEN.search(text):
            return self._pieces(text)
        first, *rest = text.split(" ")
        return self.unit[first] + b"".join(map(self.spaced.__getitem__, rest))

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))

    def decode_stream(self, chunks: Iterable[np.ndarray]) -> Iterator[str]:
        """Text of each chunk of ids as far as its characters are complete; faulty bytes become U+FFFD."""
        machine = Utf8Machine()
        for ids in chunks:
            yield machine.feed(self.decode_bytes(ids))
        yield machine.end()


class Utf8Machine:
    """Incremental UTF-8: holds back the bytes of a character that is not complete yet."""

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def open_at(data: bytes) -> int:
        """Where an incomplete but so far valid character begins at the end of data, or its length."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 == 0x80:
                continue
            needs = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1
            if needs <= back:
                break
            if back > 1:  # the second byte's range depends on the first
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)
                if not low <= data[1 - back] <= high:
                    break
            return len(data) - back
        return len(data)

    def feed(self, data: bytes) -> str:
        data = self.held + data
        at = self.open_at(data)
        self.held = data[at:]
        return data[:at].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.held = self.held.decode("utf-8", "replace"), b""
        return rest


class _Lent:
    """One codec for all tasks of a Python worker, so that what it has built serves the next task too. Workers outlive
    their stage, so it is given up when no task has begun for a while."""

    IDLE_S = 2.0

    def __init__(self) -> None:
        self.lock, self.key, self.codec, self.turn, self.users = Lock(), None, None, 0, 0

    @contextmanager
    def __call__(self, ranks_path: str, pattern: str, room: float = 1.0) -> Iterator[BpeCodec]:
        with self.lock:
            if self.key != (ranks_path, pattern, room):
                self.key, self.codec = (ranks_path, pattern, room), BpeCodec(read_ranks(ranks_path), pattern, room)
            codec, self.users = self.codec, self.users + 1
        try:
            yield codec
        finally:
            with self.lock:
                self.turn, self.users = self.turn + 1, self.users - 1
                later = Timer(self.IDLE_S, self._give_up, [self.turn])
            later.daemon = True
            later.start()

    def _give_up(self, turn: int) -> None:
        with self.lock:
            if self.users or turn != self.turn:
                return
            self.key = self.codec = None
        gc.collect()  # states refer to each other
        release()


_LENT = _Lent()


def codec_of(ranks_path: str, pattern: str, room: float = 1.0) -> AbstractContextManager[BpeCodec]:
    """The worker's codec, while it is used."""
    return _LENT(ranks_path, pattern, room)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, *, decode: bool = True) -> DataFrame:
    """One row per document: doc_id, ids (packed 32-bit), n_tokens, decoded (bytes of the ids, if asked for).

    One pass without a shuffle; each Python worker keeps one codec with bounded caches.
    """
    bounded_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec_of(ranks_path, pattern) as codec:
            for batch in batches:
                ids = [codec.encode(text or "") for text in batch.column(1).to_pylist()]
                arrays = [batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
                if decode:
                    arrays.append(pa.array([codec.decode_bytes(np.frombuffer(x, "<u4")) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "ids", "n_tokens", "decoded"][: len(arrays)])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, n_tokens long" + ", decoded binary" * decode
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(encode, schema)


def token_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document: n_tokens and the SHA-256 of its ids and of the bytes that they decode to.

    Decoding streams through Utf8Machine; the digest is over the decoded text's bytes.
    """
    bounded_batches(docs.sparkSession)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec_of(ranks_path, pattern) as codec:
            for batch in batches:
                rows: tuple[list, list, list] = ([], [], [])
                for text in batch.column(1).to_pylist():
                    ids = codec.encode(text or "")
                    tokens, sha = np.frombuffer(ids, "<u4"), hashlib.sha256()
                    for part in codec.decode_stream(tokens[i : i + 4096] for i in range(0, len(tokens), 4096)):
                        sha.update(part.encode())
                    for column, value in zip(rows, (len(tokens), hashlib.sha256(ids).hexdigest(), sha.hexdigest())):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(digest, schema)


def tokenized(docs: DataFrame, ranks_path: str, pattern: str, room: float = 0.5) -> DataFrame:
    """docs' columns but text, with ids (packed 32-bit), n_tokens, and round_trip (whether decoding gives the text back);
    own columns of these names are left out. Null texts have no ids. room: of the codec's tables, as executors that have
    done other stages have less memory left."""
    bounded_batches(docs.sparkSession)
    own = [f for f in docs.schema.fields if f.name not in ("text", "ids", "n_tokens", "round_trip")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec_of(ranks_path, pattern, room) as codec:
            for batch in batches:
                texts = batch.column(batch.num_columns - 1).to_pylist()
                ids = [codec.encode(t) for t in texts]
                same = ["".join(codec.decode_stream([np.frombuffer(x, "<u4")])) == t for x, t in zip(ids, texts)]
                arrays = [*batch.columns[:-1], pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(same)]
                yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:-1], "ids", "n_tokens", "round_trip"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own)
    return docs.select(*[F.col(f"`{f.name}`") for f in own], F.coalesce("text", F.lit("")).alias("text")).mapInArrow(encode, f"{schema}ids binary, n_tokens long, round_trip boolean")
