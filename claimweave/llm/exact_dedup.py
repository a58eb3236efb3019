"""Exact de-duplication through an extendible-hash index on shared files.

Texts are hashed without white space. A directory over the hash's leading bits starts with one
bucket and doubles as often as overfull buckets must be split; it is built from the weights of
the prefixes, of which there are 2^18 at most. Owner tasks take whole buckets, so ranges of the
hash: they chain the texts whose hashes meet, compare their bytes, and write one index entry per
distinct text to the shared folder. Each document then looks up its entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.llm.common import NO_ID, SPACE, pinned

# Text of a bucket, in bytes; a bucket above is split. The directory never has more than 2^MAX_DEPTH entries.
BUCKET_BYTES = 4 << 20
MAX_DEPTH = 18


class Directory(NamedTuple):
    depth: int
    buckets: np.ndarray  # bucket of each prefix of ``depth`` bits; equal numbers where a bucket is less deep


def directory(weights: dict[int, int], capacity: int = BUCKET_BYTES, max_depth: int = MAX_DEPTH) -> Directory:
    """The directory after all splits. ``weights`` maps prefixes of ``max_depth`` bits to bytes."""
    leaves = np.zeros(1 << max_depth, np.int64)
    for prefix, weight in weights.items():
        leaves[prefix] = weight
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].reshape(-1, 2).sum(axis=1))
    levels.reverse()  # levels[d]: the bytes below each prefix of d bits
    depth = 0
    pointers = np.zeros(1, np.int64)
    local = np.zeros(1, np.int64)  # depth of the bucket each entry points to
    while depth < max_depth:
        overfull = (local == depth) & (levels[depth] > capacity)
        if not overfull.any():
            break
        # Doubling: every entry becomes two; those of an overfull bucket part.
        depth += 1
        local = np.repeat(np.where(overfull, depth, local), 2)
        pointers = np.repeat(pointers * 2, 2)
        pointers[1::2] += overfull
    return Directory(depth, np.unique(pointers, return_inverse=True)[1])


def _normal() -> Column:
    return F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACE + "+", "")


def _hash(bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64("normal"), 64 - bits) if bits < 64 else F.xxhash64("normal")


def _prefix(bits: int, depth: int) -> Column:
    return F.shiftrightunsigned("h", bits - depth).cast("int") if depth else F.lit(0)


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for the equal texts of a batch, so copies by the thousand are not moved one by one."""
    for batch in batches:
        best = batch.sort_values(["chars", "ord"], ascending=[False, True], kind="stable")
        grouped = best.groupby("normal", sort=False)
        first = grouped.head(1).set_index("normal")
        first["rows"] = grouped.size()
        yield first.reset_index()[["h", "normal", "chars", "ord", "rows"]]


class _Entry:
    def __init__(self, normal: str) -> None:
        self.normal, self.chars, self.ord, self.rows = normal, -1, NO_ID, 0

    def add(self, chars: int, ord_: int, rows: int) -> None:
        self.rows += rows
        if (-chars, ord_) < (-self.chars, self.ord):
            self.chars, self.ord = chars, ord_


def _own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Index entries of an owner's rows, which come sorted by hash; only the texts of one hash are held."""
    hash_, chain = None, []

    def closed(h: int, entries: list[_Entry]) -> list[tuple]:
        return [(h, hashlib.sha256(e.normal.encode("utf-8", "replace")).hexdigest(), e.ord, e.chars, e.rows) for e in entries]

    for batch in batches:
        out: list[tuple] = []
        for h, normal, chars, ord_, rows in zip(batch["h"], batch["normal"], batch["chars"], batch["ord"], batch["rows"], strict=True):
            if h != hash_:
                out += closed(hash_, chain)
                hash_, chain = h, []
            entry = next((e for e in chain if e.normal == normal), None)  # the bytes decide, not the hash
            if entry is None:
                chain.append(entry := _Entry(normal))
            entry.add(chars, ord_, rows)
        yield pd.DataFrame(out, columns=["h", "sha", "keep_ord", "keep_chars", "group_size"])
    if chain:
        yield pd.DataFrame(closed(hash_, chain), columns=["h", "sha", "keep_ord", "keep_chars", "group_size"])


def build_index(docs: DataFrame, light: DataFrame, bits: int = 64, capacity: int = BUCKET_BYTES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The index: one entry per distinct text, on shared files."""
    max_depth = min(max_depth, bits)
    per_hash = light.groupBy("h").agg(F.max("bytes").alias("bytes"))
    weights = per_hash.groupBy(_prefix(bits, max_depth).alias("p")).agg(F.sum("bytes")).collect()  # 2^max_depth rows at most
    found = directory({r[0]: r[1] or 0 for r in weights}, capacity, max_depth)
    spark = docs.sparkSession
    entries = spark.createDataFrame(pd.DataFrame({"p": np.arange(len(found.buckets)), "bucket": found.buckets}), "p int, bucket bigint")
    rows = docs.select(_normal().alias("normal"), F.length(F.coalesce(F.col("text"), F.lit(""))).cast("bigint").alias("chars"), F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("ord"))
    folded = rows.withColumn("h", _hash(bits)).mapInPandas(_fold, "h bigint, normal string, chars bigint, ord bigint, rows bigint")
    # The directory has at most 2^max_depth rows of twelve bytes: three megabytes.
    placed = folded.withColumn("p", _prefix(bits, found.depth)).join(F.broadcast(entries), "p").drop("p")
    owned = placed.repartition("bucket").sortWithinPartitions("h").drop("bucket")
    return pinned(owned.mapInPandas(_own, "h bigint, sha string, keep_ord bigint, keep_chars bigint, group_size bigint"), "exact-index")


def dedup(docs: DataFrame, bits: int = 64, capacity: int = BUCKET_BYTES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` of the text without white space.

    Of equal texts the one with the most code points as it came stays, then the smallest id; null
    ids come last. Rows that repeat that id and length are one document too many: one of them
    stays. A null text counts as empty, and all empty texts are equal. Only ``doc_id`` and
    ``text`` are read. An empty table gives no rows. ``bits`` narrows the hash, for tests.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    light = pinned(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.length(text).cast("bigint").alias("chars"), _normal().alias("normal")).select(
            "doc_id", "chars", _hash(bits).alias("h"), F.sha2("normal", 256).alias("sha"), F.octet_length("normal").cast("bigint").alias("bytes")
        ),
        "exact-light",
    )
    index = build_index(docs, light, bits, capacity, max_depth)
    best = (F.coalesce(F.col("doc_id"), F.lit(NO_ID)) == F.col("keep_ord")) & (F.col("chars") == F.col("keep_chars"))
    met = light.join(index, ["h", "sha"]).withColumn("best", best)
    turn = F.row_number().over(Window.partitionBy("doc_id", "sha", "best").orderBy("chars"))
    keep_id = F.when(F.col("keep_ord") == NO_ID, F.lit(None)).otherwise(F.col("keep_ord"))
    return met.select("doc_id", keep_id.alias("keep_id"), "group_size", (F.col("best") & (turn == 1)).alias("kept"), F.col("sha").alias("text_sha256"))
