"""Approximate search over product-quantised residuals.

Every vector is kept beside a short code: the k-means cell it lies in, and for each of ``parts``
slices of what is left after the cell's centre the number of the nearest of 256 words. What the words
leave is coded once more the same way (``fine``): without it the error of a score is as wide as the gap
between the best rows and the candidates of a large table. A query scores both codes by tables of its products with
the words, so the vectors themselves are not touched; only the ``refine`` best candidates of each
query are read in full and ranked exactly, with those whose codes do not tell them from the
``k`` best: near copies of one vector, however many.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweave.functions import vector as vec
from claimweave.operators.pivot_tree import unit_rows
from claimweave.session import cut_lineage

WORDS = 256
# Rows that centres and words are learned from, about; indexing uses all rows.
TRAIN_ROWS = 65_536
# Centres and words travel with the tasks and may have so many bytes together.
MAX_MODEL_BYTES = 64 * 1024 * 1024
# Codes of one cell that one task scores at a time.
BLOCK_ROWS = 1 << 17
_DRAWS = 1 << 40
_DIGITS = 12
# A score by codes is taken to be off by so many standard deviations at most.
_DEVIATIONS = 4.0


class Index(NamedTuple):
    rows: DataFrame  # the input columns, cell, code, fine and left: the length of what both codes leave
    centres: np.ndarray  # lists x width
    words: list[np.ndarray]  # per slice: words x width of the slice
    fine_words: list[np.ndarray]  # the same for what the words leave


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1)[None, :] - 2.0 * points @ centres.T).argmin(axis=1)


def _learn_words(points: np.ndarray, words: int, rounds: int, seed: int) -> np.ndarray:
    """A few rounds of k-means over the slices of one part."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(words, len(points)), replace=False)].copy()
    for _ in range(rounds):
        home = _nearest(points, centres)
        counts = np.bincount(home, minlength=len(centres))
        sums = np.stack([np.bincount(home, column, len(centres)) for column in points.T], axis=1)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0][:, None]
    return centres


def _slices(width: int, parts: int) -> list[slice]:
    edges = np.linspace(0, width, parts + 1).round().astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def _code(rest: np.ndarray, cuts: list[slice], words: list[np.ndarray]) -> np.ndarray:
    """The number of the nearest word of each slice; what the words leave stays in ``rest``."""
    codes = np.empty((len(rest), len(cuts)), np.uint8)
    for part, (cut, book) in enumerate(zip(cuts, words, strict=True)):
        codes[:, part] = _nearest(rest[:, cut], book)
        rest[:, cut] -= book[codes[:, part]]
    return codes


def quantized_index(df: DataFrame, lists: int = 100, parts: int = 16, id: str = "id", vector: str = "embedding", train_rows: int = TRAIN_ROWS, rounds: int = 10, seed: int = 7) -> Index:
    """Indexes every usable vector of ``df``; null and zero vectors have no place in it.

    Centres and words are learned from about ``train_rows`` rows, drawn by a hash of the id: the
    centres by distributed k-means, the words of each slice in a task of its own. Write ``rows``
    partitioned by ``cell``, and a search reads codes and ids of the probed cells, and vectors of candidates only.
    """
    usable = df.where(F.col(vector).isNotNull() & F.exists(vector, lambda x: x != 0))
    share = min(_DRAWS, int(_DRAWS * train_rows / max(1, usable.count())))
    drawn = usable.where(F.pmod(F.xxhash64(F.lit(seed), id), F.lit(_DRAWS)) < share).select(F.col(vector).alias("_v"))
    unit = F.transform("_v", lambda x: x.cast("double") / F.col("_n"))
    sample = cut_lineage(drawn.withColumn("_n", vec.norm("_v")).select("_v", array_to_vector(unit).alias("_p")))
    fitted = KMeans(k=lists, seed=seed, featuresCol="_p", predictionCol="cell", maxIter=10).fit(sample)
    centres = np.array([np.asarray(c) for c in fitted.clusterCenters()])
    width = centres.shape[1]
    if 8 * (len(centres) + 2 * WORDS) * width > MAX_MODEL_BYTES:
        raise ValueError(f"{lists} centres of {width} numbers are more than {MAX_MODEL_BYTES} bytes; ask for fewer lists")
    cuts = _slices(width, min(parts, width))

    def residuals(batches: Iterator[pa.RecordBatch], words: list[np.ndarray] | None) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = unit_rows(batch.column("_v"))
                rest = points - centres[_nearest(points, centres)]
                if words is not None:
                    _code(rest, cuts, words)
                for part, cut in enumerate(cuts):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rest), part), pa.int32()), pa.array(list(rest[:, cut]), pa.list_(pa.float64()))], ["part", "slice"])

    def learned(key: tuple, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        found = _learn_words(np.stack(table.column("slice").to_numpy()), WORDS, rounds, seed + part)
        return pa.table([pa.array(np.full(len(found), part), pa.int32()), pa.array(np.arange(len(found)), pa.int32()), pa.array(list(found), pa.list_(pa.float64()))], ["part", "word", "values"])

    def book(words: list[np.ndarray] | None) -> list[np.ndarray]:
        slices = sample.select("_v").mapInArrow(lambda batches: residuals(batches, words), "part int, slice array<double>")
        books = slices.groupBy("part").applyInArrow(learned, "part int, word int, values array<double>")
        table = books.orderBy("part", "word").toArrow()  # parts x WORDS rows
        part_of, values = table["part"].to_numpy(), table["values"].to_numpy()
        return [np.stack(values[part_of == part]) for part in range(len(cuts))]

    words = book(None)
    fine_words = book(words)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = unit_rows(batch.column("_v"))
            cells, codes, left = np.empty(0, np.int64), [[], []], np.empty(0)
            if batch.num_rows:
                cells = _nearest(points, centres)
                rest = points - centres[cells]
                codes = [[row.tobytes() for row in _code(rest, cuts, book)] for book in (words, fine_words)]
                left = np.linalg.norm(rest, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(cells, pa.int32()), *(pa.array(c, pa.binary()) for c in codes), pa.array(left)], ["row", "cell", "code", "fine", "left"])

    rows = usable.select(F.struct("*").alias("row"), F.col(vector).alias("_v"))
    schema = T.StructType([rows.schema["row"], T.StructField("cell", T.IntegerType()), T.StructField("code", T.BinaryType()), T.StructField("fine", T.BinaryType()), T.StructField("left", T.DoubleType())])
    return Index(rows.mapInArrow(encode, schema).select("row.*", "cell", "code", "fine", "left"), centres, words, fine_words)


def quantized_top_k(
    index: Index,
    queries: DataFrame,
    k: int,
    probes: int | None = None,
    refine: int | None = None,
    id: str = "id",
    vector: str = "embedding",
    query_id: str = "query_id",
    query_vector: str = "embedding",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Top ``k`` by cosine of each query: ``query_id, id, similarity, rank``; approximate.

    The codes of the ``probes`` nearest cells are scored (by default of all: codes are short), and the
    best ``refine`` (by default 10 ``k``) are read in full, and what may be among the best ``k`` besides.
    ``candidates`` with ``k`` gives them without the reading.
    A cell of more than ``block_rows`` codes is dealt to several tasks.
    """
    near = candidates(index, queries, refine or 10 * k, probes, id, query_id, query_vector, block_rows, k)
    asked = queries.select(F.col(query_id).alias("_q"), F.col(query_vector).alias("_qv"))
    # Few rows look for their vectors; whether they are shipped is left to Spark.
    full = near.join(index.rows.select(F.col(id).alias("_id"), F.col(vector).alias("_v")), "_id").join(asked, "_q")
    scored = full.select("_q", "_id", F.round(vec.cosine("_v", "_qv"), _DIGITS).alias("similarity"))
    ranking = Window.partitionBy("_q").orderBy(F.desc("similarity"), "_id")
    best = scored.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= k)
    return best.select(F.col("_q").alias(query_id), F.col("_id").alias(id), "similarity", F.col("rank").cast("bigint").alias("rank"))


def candidates(
    index: Index, queries: DataFrame, refine: int, probes: int | None = None, id: str = "id", query_id: str = "query_id", query_vector: str = "embedding", block_rows: int = BLOCK_ROWS, k: int | None = None
) -> DataFrame:
    """``_q, _id`` of the ``refine`` best rows of each query by their codes alone.

    With ``k`` also all others that may be closer than the k-th best is for sure: the error of a score is about as wide
    as what the codes leave, over the root of the width.
    """
    centres, words, fine_words = index.centres, index.words, index.fine_words
    refine = max(refine, k or 0)
    cuts = np.cumsum([0, *[w.shape[1] for w in words]])
    asked = queries.where(F.col(query_vector).isNotNull() & F.exists(query_vector, lambda x: x != 0)).select(F.col(query_id).alias("_q"), F.col(query_vector).alias("_qv"))
    wide = len(centres) if probes is None else min(probes, len(centres))

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            points = unit_rows(batch.column("_qv"))
            products = points @ centres.T
            # The nearest cells, as distances see them.
            cells = np.argsort((centres**2).sum(axis=1)[None, :] - 2.0 * products, axis=1, kind="stable")[:, :wide]
            rows = np.repeat(np.arange(len(points)), wide)
            flat = cells.ravel()
            yield pa.RecordBatch.from_arrays(
                [batch.column("_q").take(pa.array(rows)), batch.column("_qv").take(pa.array(rows)), pa.array(flat, pa.int32()), pa.array(products[rows, flat])], ["_q", "_qv", "cell", "_base"]
            )

    kinds = f"_q {asked.schema['_q'].dataType.simpleString()}, _qv {asked.schema['_qv'].dataType.simpleString()}"
    visits = asked.mapInArrow(probed, f"{kinds}, cell int, _base double")
    codes = index.rows.select(F.col(id).alias("_id"), "cell", "code", "fine", "left")
    # One row per list; each cell is dealt to as many groups as it has blocks, and its queries visit all of them.
    sizes = codes.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_blocks"))
    dealt = codes.join(F.broadcast(sizes), "cell").withColumn("_block", F.pmod(F.xxhash64("_id"), F.col("_blocks")).cast("int")).drop("_blocks")
    visits = visits.join(F.broadcast(sizes), "cell").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    schema = T.StructType([asked.schema["_q"], T.StructField("_id", codes.schema["_id"].dataType), T.StructField("_near", T.DoubleType()), T.StructField("_error", T.DoubleType())])

    def scan(queries_: pa.Table, block: pa.Table) -> pa.Table:
        ids, left, right, scores, errors = block["_id"], [], [], [], []
        if block.num_rows and queries_.num_rows:
            packed, fine = (np.frombuffer(b"".join(block[name].to_pylist()), np.uint8).reshape(block.num_rows, -1) for name in ("code", "fine"))
            error = block["left"].to_numpy() * (_DEVIATIONS / cuts[-1] ** 0.5)
            points, base = unit_rows(queries_["_qv"]), queries_["_base"].to_numpy()
            for i in range(len(points)):
                score = np.full(block.num_rows, base[i])
                for part, (book, fine_book) in enumerate(zip(words, fine_words, strict=True)):
                    asked_part = points[i, cuts[part] : cuts[part + 1]]
                    score += (book @ asked_part)[packed[:, part]] + (fine_book @ asked_part)[fine[:, part]]
                best = np.argpartition(-score, refine - 1)[:refine] if len(score) > refine else np.arange(len(score))
                if k is not None and len(score) > refine:
                    surely = np.partition(score - error, len(score) - k)[len(score) - k]
                    best = np.union1d(best, np.flatnonzero(score + error >= surely))
                left.append(np.full(len(best), i))
                right.append(best)
                scores.append(score[best])
                errors.append(error[best])
        chosen = [np.concatenate(x) if x else np.empty(0) for x in (left, right, scores, errors)]
        return pa.table([queries_["_q"].take(pa.array(chosen[0].astype(np.int64))), ids.take(pa.array(chosen[1].astype(np.int64))), pa.array(chosen[2], pa.float64()), pa.array(chosen[3], pa.float64())], names=["_q", "_id", "_near", "_error"])

    keys = ["cell", "_block"]
    scored = visits.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(scan, schema)
    ranking = Window.partitionBy("_q").orderBy(F.desc("_near"), "_id")
    placed = scored.withColumn("_n", F.row_number().over(ranking))
    taken = F.col("_n") <= refine
    if k is not None:
        surely = F.col("_near") - F.col("_error")
        placed = placed.withColumn("_k", F.row_number().over(Window.partitionBy("_q").orderBy(F.desc(surely), "_id")))
        placed = placed.withColumn("_least", F.max(F.when(F.col("_k") == k, surely)).over(Window.partitionBy("_q")))
        taken = taken | F.coalesce(F.col("_near") + F.col("_error") >= F.col("_least"), F.lit(False))
    return placed.where(taken).select("_q", "_id")


def read_share(index: Index, near: DataFrame) -> Column:
    """The largest share of all indexed vectors that any query of ``candidates`` reads in full, as a scalar subquery."""
    most = near.groupBy("_q").count().agg(F.max("count").cast("double").alias("m")).scalar()
    return most / index.rows.agg(F.count("*")).scalar()
