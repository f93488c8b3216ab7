"""Importance resampling towards a target: hashed n-gram features, log gains, and the highest scores with Gumbel noise.

Words are runs of digits, letters and all that isn't ASCII, A-Z lower-cased; features are all runs of 1 to `width` words
joined by one space, repeats counted; a feature's bucket is its crc32 modulo BUCKETS. One pass counts buckets in
every task by np.bincount, and treeReduce adds the tasks' vectors up, so that the driver gets one. A bucket's gain is the
logarithm, in thousandths, of how much likelier it is in the target, plus-one smoothed. The second pass gathers the
broadcast gains (80 KB at any size of the corpus) and sums them by document with bincount's weights. Of the documents
with enough words the highest scores are drawn: weights with Gumbel noise of the id's hash, so a draw repeats.

A null text has no words; a null id counts as the id `null` for the noise; rows of one id share their noise and are
drawn each by its own text; ties go to the smaller id (null last), then stand as they come. An empty corpus or target
gives gains of zero counts. Texts are taken whole, of any length: sums stay exact up to 2^53. Other columns pass through
resample(), whatever their names, and are left out of reports.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import bounded_batches, own_columns, scratch, staged, text_bytes
from .packing import giving_back
from .ranking import ranked
from .words import ALNUM

BUCKETS = 10_000
#: Words of documents with a score, and the share of them that is drawn, in hundredths.
LEAST_WORDS, PERCENT = 20, 10
SEED = 2024


class _Buckets(dict):
    """Bucket by feature; forgets all when full, so memory stays bounded."""

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        value = self[feature] = zlib.crc32(feature) % BUCKETS
        return value


def _features(text: bytes, width: int, buckets: _Buckets) -> tuple[int, np.ndarray]:
    """Number of words, and the buckets of all features."""
    words = text.translate(ALNUM).split()
    runs = [np.fromiter(map(buckets.__getitem__, words), np.int64, len(words))]
    for k in range(2, width + 1):
        many = max(0, len(words) - k + 1)
        runs.append(np.fromiter((zlib.crc32(b" ".join(words[i : i + k])) % BUCKETS for i in range(many)), np.int64, many))
    return len(words), np.concatenate(runs) if width > 1 else runs[0]


def bucket_counts(docs: DataFrame, width: int = 1) -> np.ndarray:
    """How often each bucket is found in all texts."""
    bounded_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, buckets = np.zeros(BUCKETS, np.int64), _Buckets()
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(_features(text.as_py(), width, buckets)[1], minlength=BUCKETS)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = docs.select(text_bytes()).mapInArrow(giving_back(counted), "counts binary").rdd.map(lambda r: np.frombuffer(r.counts, np.int64))
    depth = max(2, math.ceil(math.log(max(2, vectors.getNumPartitions()), 32)))  # at most about 32 vectors meet
    return vectors.treeReduce(np.add, depth) if vectors.getNumPartitions() else np.zeros(BUCKETS, np.int64)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket, in thousandths, rounded down."""
    s, t = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * s / ((float(a) + 1) * t))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.float64)


def noise(ident: str) -> int:
    """Gumbel noise of an id, in thousandths, rounded down."""
    h = int(hashlib.sha256(f"{SEED}:{ident}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, width: int = 1, row: bool = False) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document; with row, the document itself beside them."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(gain)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, buckets = shared.value, _Buckets()
        for batch in batches:
            n_words, found = [], []
            for text in batch.column(1):
                words, features = _features(text.as_py(), width, buckets)
                n_words.append(words)
                found.append(features)
            many = np.array([len(f) for f in found], np.int64)
            weight = np.bincount(np.repeat(np.arange(len(found)), many), gain[np.concatenate(found)], len(found)).astype(np.int64) if found else many
            score = weight + np.array([noise(x.as_py()) for x in batch.column(2)], np.int64)
            columns = {"doc_id": batch.column(0), "n_words": pa.array(n_words, pa.int64()), "n_features": pa.array(many), "weight": pa.array(weight), "score": pa.array(score)}
            if row:
                columns["row"] = batch.column(3)
            yield pa.record_batch(columns)

    needed = docs.select(F.col("doc_id"), text_bytes(), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), *([F.struct("*")] if row else []))
    schema = StructType([docs.schema["doc_id"], *[StructField(c, LongType()) for c in ("n_words", "n_features", "weight", "score")]])
    return needed.mapInArrow(giving_back(weighed), schema.add("row", docs.schema) if row else schema)


def _order() -> list[Column]:
    return [F.desc("score"), F.asc_nulls_last("doc_id")]


def drawn(scores: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, under: str | None = None) -> DataFrame:
    """scores (a table) with rank: 1 for the highest of those with enough words, as far as they are drawn, else null."""
    enough = scores.where(F.col("n_words") >= least_words)
    places = ranked(enough, _order(), under=under)
    rank = F.when(F.col("rank") < F.floor(F.col("n") * percent / 100), F.col("rank") + 1)
    short = scores.where(F.col("n_words") < least_words)
    return places.select(*[F.col(c) for c in scores.columns], rank.alias("rank")).unionByName(short.withColumn("rank", F.lit(None).cast("bigint")))


def importance_report(docs: DataFrame, target: DataFrame, width: int = 1, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document."""
    gain = gains(bucket_counts(docs, width), bucket_counts(target, width))
    with scratch(docs.sparkSession, "resampling") as folder:
        scores = staged(scored(docs, gain, width), "scores", under=folder)
        return staged(drawn(scores, percent, under=folder).select("doc_id", "n_features", "weight", "score", "rank"), "drawn")


def resample(docs: DataFrame, target: DataFrame, width: int = 1, percent: int = PERCENT) -> DataFrame:
    """The documents drawn, with all their columns: only rows that reach the last score drawn are sorted with their texts."""
    gain = gains(bucket_counts(docs, width), bucket_counts(target, width))
    with scratch(docs.sparkSession, "resampling") as folder:
        scores = staged(scored(docs, gain, width), "scores", under=folder)
        many, last = drawn(scores, percent, under=folder).where("rank IS NOT NULL").agg(F.count("rank"), F.min("score")).first()
        rows = staged(scored(docs, gain, width, row=True).where((F.col("n_words") >= LEAST_WORDS) & (F.col("score") >= F.lit(last))), "rows", under=folder)
        return staged(ranked(rows, _order(), under=folder).where(F.col("rank") < many).select("row.*"), "resampled").select(own_columns(docs))
