"""Token counts of a unigram tokenizer without its tokens: Viterbi over Aho-Corasick matches.

Text is split at white space, each word gets a leading U+2581, if it has none, and is segmented alone. An Aho-Corasick automaton
of the vocabulary yields, for every end in a word, the pieces that end there, longest first; the best score, the
number of pieces and the number of unknown ones of the best path are carried from end to end. A later candidate
wins only with a greater score, so of equal paths the one with the longest last piece stays, as in the
tokenizers library. A character without a piece of its own may be an unknown piece, 10 below the least score;
unknown pieces side by side count as one.

The scores come from a public vocabulary's order by a rule (see `pieces`); nothing is trained. Null and empty
texts have no tokens; repeated documents are counted row by row; texts of any length are counted whole. An empty table
gives no rows; other columns than doc_id and the text don't matter, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

MARK, PENALTY = "▁", 10.0
#: White space to Python, but not to Unicode, so not to tokenizers.
SEPARATORS = re.compile("[\x1c-\x1f]")
SPACE = regex.compile(r"\s+")


def pieces(model_path: str) -> list[tuple[str, float]]:
    """Vocabulary and scores: the log probability of Zipf's law at the piece's rank among the ordinary pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    own = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / (i + 3) for i in range(len(own))))
    return [(piece, -math.log(i + 3) - total) for i, piece in enumerate(own)]


class Counts(dict):
    """(pieces, unknown pieces) by word, packed as pieces << 32 | unknown; forgets all when full."""

    def __init__(self, vocabulary: list[tuple[str, float]], most: int = 500_000):
        self.most, self.unknown = most, min(score for _, score in vocabulary) - PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()

    def best(self, word: str) -> tuple[float, int, int]:
        """Score, pieces and unknown pieces of the best path."""
        n = len(word)
        ends: list[list] = [[] for _ in range(n)]
        for end, found in self.automaton.iter(word):
            ends[end].append(found)
        score, count, strange, last_strange = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            top, start, known, single = None, 0, True, False
            for length, value in sorted(ends[end - 1], reverse=True):
                single = single or length == 1
                candidate = score[end - length] + value
                if top is None or candidate > top:
                    top, start = candidate, end - length
            if not single and (top is None or score[end - 1] + self.unknown > top):
                top, start, known = score[end - 1] + self.unknown, end - 1, False
            fused = not known and last_strange[start]
            score[end], count[end], strange[end], last_strange[end] = top, count[start] + (not fused), strange[start] + (not known and not fused), not known
        return score[n], count[n], strange[n]

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        _, count, strange = self.best(word if word.startswith(MARK) else MARK + word)
        value = self[word] = count << 32 | strange
        return value

    def of(self, text: str) -> tuple[int, int]:
        words = [w for w in SPACE.split(text) if w] if SEPARATORS.search(text) else text.split()
        total = sum(map(self.__getitem__, words))
        return total >> 32, total & 0xFFFFFFFF


@lru_cache(maxsize=1)
def counts_of(model_path: str) -> Counts:
    """One for all tasks of a Python worker."""
    return Counts(pieces(model_path))


def count_tokens(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Per row: doc_id, n_pieces and n_unknown. One pass without a shuffle."""
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counts_of(model_path)
        for batch in batches:
            found = [counts.of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["doc_id", "n_pieces", "n_unknown"])

    return docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text")).mapInArrow(count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_pieces long, n_unknown long")
