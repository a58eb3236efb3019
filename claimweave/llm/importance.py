"""Importance resampling towards a target distribution, on hashed word n-grams.

Texts are brought to one form: ASCII letters in lower case, every run of separators one blank. An
overlapped regular expression with look-arounds at both ends then emits each n-gram as a span of
those bytes, and its checksum is its bucket. Bucket counts of the raw and the target texts give
each bucket a gain; a document's weight is its mean gain, and seeded Gumbel noise on top of the
weights draws without replacement in proportion to them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions.ordered import dense_ids
from claimweave.llm.common import map_texts, pinned

BUCKETS = 10_000
MAX_WORDS = 1
SEED = 2024
MIN_WORDS = 20
PERCENT = 10

# Bytes of words: digits, ASCII letters in lower case, and everything beyond ASCII. The rest separates.
_FORM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_BLANKS = regex.compile(rb"  +")


def normal_form(text: str | None) -> bytes:
    """UTF-8 bytes of the words in lower case, with one blank between two of them."""
    return _BLANKS.sub(b" ", (text or "").encode("utf-8", "replace").translate(_FORM)).strip(b" ")


def pattern(words: int) -> regex.Pattern:
    """Spans of so many whole words; scanned overlapped, they begin at every word that has enough words after it."""
    return regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (words - 1))


def checksums(text: bytes, patterns: Sequence[regex.Pattern]) -> np.ndarray:
    """The checksum of every n-gram of a text in normal form, repeats included."""
    return np.fromiter((zlib.crc32(span.group()) for p in patterns for span in p.finditer(text, overlapped=True)), np.uint32)


def bucket_counts(texts: DataFrame, max_words: int = MAX_WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """How many n-grams of one to ``max_words`` words of all ``texts`` (``text``) fall into each bucket.

    Tasks add up what they read, so at most a row per task and bucket is shuffled, and a row per
    bucket comes to the driver, whatever the size of the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [pattern(n) for n in range(1, max_words + 1)]
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += np.bincount(checksums(normal_form(text), patterns) % np.uint32(buckets), minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": found, "n": total[found]})

    counted = texts.where(F.col("text").isNotNull()).select("text").mapInArrow(run, "bucket bigint, n bigint")
    summed = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[summed["bucket"].to_numpy()] = summed["n"].to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the logarithm of each bucket's smoothed share in the target over that in the raw texts, rounded down."""
    raw_all, target_all = int(raw.sum()) + len(raw), int(target.sum()) + len(target)
    return np.array([math.floor(1000 * math.log((t + 1) * raw_all / ((s + 1) * target_all))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, max_words: int = MAX_WORDS, keep: Sequence[str] | None = None) -> DataFrame:
    """Every document with ``n_words``, ``n_features`` and ``weight``, the mean gain of its n-grams rounded down (0 without any)."""

    def score(texts: list[str | None]) -> list[list[int]]:
        patterns = [pattern(n) for n in range(1, max_words + 1)]
        words, features, weights = [], [], []
        for text in texts:
            form = normal_form(text)
            sums = checksums(form, patterns)
            words.append(form.count(b" ") + 1 if form else 0)
            features.append(len(sums))
            weights.append(int(gain[sums % np.uint32(len(gain))].sum()) // len(sums) if len(sums) else 0)
        return [words, features, weights]

    return map_texts(docs, score, {"n_words": pa.int64(), "n_features": pa.int64(), "weight": pa.int64()}, keep)


def gumbel(doc_id: Column, seed: int) -> Column:
    """A thousand times a Gumbel draw, rounded down, from 32 bits of the seeded hash of the id."""
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((drawn + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def resample(
    docs: DataFrame, target: DataFrame, max_words: int = MAX_WORDS, buckets: int = BUCKETS, seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT, keep: Sequence[str] | None = None
) -> DataFrame:
    """Every document with ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank``.

    Of the documents with at least ``min_words`` words, ``percent`` in a hundred (rounded down) are
    drawn: those with the highest ``score``, ranked from 1; ties go to the smaller id. The rank of
    the others is null.

    Both tables need ``text``, the first ``doc_id`` too. A null or empty text has no n-grams and
    weight 0. Rows that repeat an id draw the same noise, and rank one after the other if their
    score is the same; null ids draw alike and come last among equals. Without target texts all
    that counts is rarity. The document's columns (those in ``keep``) stay inside ``row``, so
    they cannot clash. An empty table gives no rows. Texts are read twice, whole, and only shuffled
    with their row if ``keep`` names them; the order is found over range partitions.
    """
    gain = gains(bucket_counts(docs, max_words, buckets), bucket_counts(target, max_words, buckets))
    weighed = weigh(docs, gain, max_words, keep).withColumn("score", F.col("weight") + gumbel(F.col("row.doc_id"), seed))
    # Written out: scanning is the costly part, and both branches and the order read it again.
    scored = pinned(weighed, "importance-scored")
    able = F.col("n_words") >= min_words
    drawn = scored.where(able).count() * percent // 100
    order = ["_down", "_none", "_id", "n_features", "weight"]
    placed = scored.where(able).withColumns({"_down": -F.col("score"), "_none": F.col("row.doc_id").isNull(), "_id": F.col("row.doc_id")})
    ranked = dense_ids(placed, order, "rank").drop("_down", "_none", "_id")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("bigint")))
