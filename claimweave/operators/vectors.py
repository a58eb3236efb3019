"""Vector search and similarity joins.

One query vector stays in native columns. Many vectors go through blocked matrix
products over Arrow batches; a side is shipped to every task only when its size
was checked, and both sides are cut into bounded blocks otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweave.functions import vector as vec
from claimweave.operators.calls import TokenBucket, in_order
from claimweave.operators.pivot_tree import MAX_TREE_BYTES, fitting_tree, unit_rows
from claimweave.session import cut_lineage

# Defaults of the parameters of the same names. A side of at most so many vectors and bytes is shipped to every task.
MAX_SHIPPED = 4096
MAX_SHIPPED_BYTES = 64 * 1024 * 1024
# Rows per block; in a cell of an index there are fewer blocks to meet.
BLOCK_ROWS = 2048
CELL_BLOCK_ROWS = 8192
# Similarities that are held at once.
_PRODUCT = 1 << 22
# Rows of a batch of results.
_BATCH = 1 << 18
# Pairs are listed once there are at most this many per row.
MAX_PAIRS_PER_ROW = 16
# Similarities are ranked after rounding, so that equal vectors tie exactly.
_DIGITS = 12


def _matrix(column: pa.Array, metric: str = "dot") -> np.ndarray:
    """A list column as a matrix, its rows of unit length for the cosine."""
    if metric == "cosine":
        return unit_rows(column)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    widths = pc.unique(pc.list_value_length(column))
    if len(widths) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(widths.to_pylist())[:5]}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _plain(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False))


def _usable(df: DataFrame, vector: str, metric: str) -> DataFrame:
    """Without NULL vectors, and for the cosine without zero vectors."""
    kept = df.filter(F.col(vector).isNotNull())
    return kept.filter(F.exists(vector, lambda x: x != 0)) if metric == "cosine" else kept


def _shipped(df: DataFrame, rows: int) -> pa.Table | None:
    """The whole frame, if it has at most so many rows, and few bytes."""
    size = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(F.size("_v")), F.lit(0))).first()
    if size[0] > rows or 8 * size[1] > MAX_SHIPPED_BYTES:
        return None
    return df.toArrow()


# --- one query vector ----------------------------------------------------------


def search(
    corpus: DataFrame,
    query: Column,
    k: int,
    vector: str = "embedding",
    tie: Sequence[str] = ("id",),
    metric: str = "cosine",
    threshold: float | None = None,
    where: Column | None = None,
) -> DataFrame:
    """The ``k`` rows closest to one query vector, as a ``similarity`` column.

    ``threshold`` is strict. A top-k sort keeps ``k`` rows per task.
    """
    rows = corpus if where is None else corpus.filter(where)
    scored = _usable(rows, vector, metric).withColumn("similarity", F.round(vec.similarity(vector, query, metric), _DIGITS))
    if threshold is not None:
        scored = scored.filter(F.col("similarity") > threshold)
    return scored.orderBy(F.desc_nulls_last("similarity"), *tie).limit(k)


def search_text(chunks: DataFrame, query: Column, k: int = 10, product: str | None = None) -> DataFrame:
    """Top chunks, optionally of one product; chunks without a vector are skipped."""
    where = None if product is None else F.col("product_name") == product
    hits = search(chunks, query, k, "original_embedding", ["product_name", "chunk_index"], where=where)
    return hits.drop("original_embedding")


def explain_coverage(benefits: DataFrame, query: Column, k: int = 5) -> DataFrame:
    """Top existing benefits by the vector of their original text."""
    hits = search(benefits, query, k, "original_embedding", ["benefit_name", "product_name"], where=F.col("benefit_exist"))
    return hits.select(F.lit("benefit").alias("item_type"), F.col("benefit_name").alias("item_name"), "product_name", "similarity", "original_text")


def search_layers(
    query: Column, tables: Mapping[str, DataFrame], k: int = 10, name: str = "item_name", vector: str = "normalized_embedding", exist: str | None = "exist"
) -> DataFrame:
    """Top ``k`` of every named table, tagged with the table, merged and sorted."""
    hits = [
        search(frame, query, k, vector, [name, "product_name"], where=F.col(exist) if exist else None).select(
            F.lit(source).alias("source_table"), name, "product_name", "similarity"
        )
        for source, frame in tables.items()
    ]
    return reduce(DataFrame.unionByName, hits).orderBy(F.desc("similarity"), "source_table", name, "product_name")


def user_memories(memories: DataFrame, user_id: object) -> DataFrame:
    return memories.filter(F.col("user_id") == user_id)


def user_search(memories: DataFrame, user_id: object, query: Column, k: int = 10) -> DataFrame:
    return search(user_memories(memories, user_id), query, k)


def hybrid_search(
    df: DataFrame,
    terms: str,
    query: Column,
    text_weight: float = 0.3,
    vector_weight: float = 0.7,
    k: int = 10,
    text: str = "text",
    vector: str = "embedding",
    tie: Sequence[str] = ("id",),
    digits: int = _DIGITS,
) -> DataFrame:
    """Weighted sum of two scores, each scaled to 0..1 over all rows: the share of
    the query's distinct terms found in the text, and the cosine.

    Rows are ranked by the sum as it is told, with ``digits`` digits: what is equal then is a tie.
    """
    wanted = sorted({w for w in terms.lower().split() if w})
    found = F.array_intersect(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), F.array(*[F.lit(w) for w in wanted]))
    scored = df.withColumns(
        {"_text": F.size(found) / F.lit(float(max(len(wanted), 1))), "_vector": F.coalesce(vec.cosine(vector, query), F.lit(0.0))}
    )
    bounds = scored.agg(F.struct(*[f(c).alias(f"{n}{c}") for c in ("_text", "_vector") for n, f in (("lo", F.min), ("hi", F.max))]).alias("b")).scalar()

    def scaled(column: str) -> Column:
        low, high = bounds[f"lo{column}"], bounds[f"hi{column}"]
        return F.coalesce(F.try_divide(F.col(column) - low, high - low), F.lit(0.0))

    score = F.round(scaled("_text") * text_weight + scaled("_vector") * vector_weight, _DIGITS)
    return scored.withColumn("score", F.round(score, digits)).drop("_text", "_vector").orderBy(F.desc("score"), *tie).limit(k)


# --- many query vectors --------------------------------------------------------


def _best(scores: np.ndarray, ids: np.ndarray, k: int, threshold: float | None) -> np.ndarray:
    """Positions of the ``k`` best scores, smaller ids first among equals."""
    candidates = np.arange(len(scores))
    if threshold is not None:
        candidates = candidates[scores > threshold]
    if len(candidates) > k:
        cut = np.partition(scores[candidates], -k)[-k]
        candidates = candidates[scores[candidates] >= cut]
    order = np.lexsort((ids[candidates], -scores[candidates]))
    return candidates[order[:k]]


def _ranked(queries: np.ndarray, query_ids: np.ndarray, corpus: np.ndarray, ids: np.ndarray, k: int, threshold: float | None, schema: pa.Schema) -> pa.Table:
    """Top-k of a block of queries against a block of the corpus."""
    left, right, scores = [], [], []
    slice_ = max(1, _PRODUCT // max(1, len(ids)))
    for begin in range(0, len(query_ids) if len(ids) else 0, slice_):
        product = queries[begin : begin + slice_] @ corpus.T
        np.round(product, _DIGITS, out=product)
        for row, query_id in zip(product, query_ids[begin : begin + slice_]):
            chosen = _best(row, ids, k, threshold)
            left.append(np.repeat(np.asarray([query_id], dtype=query_ids.dtype), len(chosen)))
            right.append(ids[chosen])
            scores.append(row[chosen])
    if not left:
        return schema.empty_table()
    columns = [np.concatenate(left), np.concatenate(right), np.concatenate(scores)]
    return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def top_k(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    id: str = "id",
    vector: str = "embedding",
    query_id: str = "query_id",
    query_vector: str = "embedding",
    metric: str = "cosine",
    threshold: float | None = None,
    where: Column | None = None,
    max_shipped: int = MAX_SHIPPED,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Best ``k`` corpus rows of every query: ``query_id, id, similarity, rank``.

    A query side of at most ``max_shipped`` rows visits every corpus task, and each
    batch passes on at most ``k`` rows per query; a corpus that small visits the query
    tasks. Otherwise hash blocks of ``block_rows`` meet pairwise, and again only the best
    ``k`` per query and block go on. The result is exact in all three cases. Vectors of
    different lengths are an error.
    """
    corpus = _usable(corpus if where is None else corpus.filter(where), vector, metric).select(F.col(id).alias("_id"), F.col(vector).alias("_v"))
    queries = _usable(queries, query_vector, metric).select(F.col(query_id).alias("_q"), F.col(query_vector).alias("_v"))
    schema = T.StructType(
        [T.StructField("_q", queries.schema["_q"].dataType), T.StructField("_id", corpus.schema["_id"].dataType), T.StructField("similarity", T.DoubleType())]
    )
    arrow = _arrow_schema(schema)

    if (small := _shipped(queries, max_shipped)) is not None:
        hits = corpus.mapInArrow(_scan(small, "_q", k, metric, threshold, arrow, corpus_first=False), schema)
    elif (small := _shipped(corpus, max_shipped)) is not None:
        hits = queries.mapInArrow(_scan(small, "_id", k, metric, threshold, arrow, corpus_first=True), schema)
    else:
        hits = _meet(queries, "_q", corpus, "_id", schema, lambda left, right: _ranked(
            _matrix(left["_v"], metric), _plain(left["_q"]), _matrix(right["_v"], metric), _plain(right["_id"]), k, threshold, arrow), block_rows)
    ranking = Window.partitionBy("_q").orderBy(F.desc("similarity"), "_id")
    return (
        hits.withColumn("rank", F.row_number().over(ranking))
        .filter(F.col("rank") <= k)
        .select(F.col("_q").alias(query_id), F.col("_id").alias("id" if id == query_id else id), "similarity", F.col("rank").cast("bigint").alias("rank"))
    )


def _scan(small: pa.Table, small_id: str, k: int, metric: str, threshold: float | None, arrow: pa.Schema, corpus_first: bool):
    """Scores every scanned batch against the shipped side."""
    shipped = _matrix(small["_v"], metric)
    shipped_ids = _plain(small[small_id])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            mine, ids = _matrix(batch.column(1), metric), _plain(batch.column(0))
            if corpus_first:
                table = _ranked(mine, ids, shipped, shipped_ids, k, threshold, arrow)
            else:
                table = _ranked(shipped, shipped_ids, mine, ids, k, threshold, arrow)
            yield from table.to_batches()

    return scan


def _meet(left: DataFrame, left_id: str, right: DataFrame, right_id: str, schema: T.StructType, kernel: Callable[[pa.Table, pa.Table], pa.Table], block_rows: int) -> DataFrame:
    """Every hash block of one side with every hash block of the other."""

    def blocks(df: DataFrame) -> int:
        return max(1, -(-df.count() // block_rows))

    n_left, n_right = blocks(left), blocks(right)

    def numbered(df: DataFrame, key: str, own: int, other: int, names: tuple[str, str]) -> DataFrame:
        return df.withColumn(names[0], F.pmod(F.xxhash64(key), F.lit(own)).cast("int")).withColumn(names[1], F.explode(F.sequence(F.lit(0), F.lit(other - 1))))

    a = numbered(left, left_id, n_left, n_right, ("_lb", "_rb"))
    b = numbered(right, right_id, n_right, n_left, ("_rb", "_lb"))
    return a.groupBy("_lb", "_rb").cogroup(b.groupBy("_lb", "_rb")).applyInArrow(kernel, schema)


def similarity_matrix(a: DataFrame, b: DataFrame, a_id: str, b_id: str, a_vector: str = "embedding", b_vector: str = "embedding", metric: str = "cosine", max_shipped: int = MAX_SHIPPED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All similarities of two sets: ``a_id, b_id, similarity``.

    The second set visits every task when it has at most ``max_shipped`` rows; otherwise blocks meet.
    """
    left = _usable(a, a_vector, metric).select(F.col(a_id).alias("_a"), F.col(a_vector).alias("_v"))
    right = _usable(b, b_vector, metric).select(F.col(b_id).alias("_b"), F.col(b_vector).alias("_v"))
    schema = T.StructType([T.StructField("_a", left.schema["_a"].dataType), T.StructField("_b", right.schema["_b"].dataType), T.StructField("similarity", T.DoubleType())])
    arrow = _arrow_schema(schema)

    def full(mine: np.ndarray, ids: np.ndarray, other: np.ndarray, other_ids: np.ndarray) -> pa.Table:
        if not (len(ids) and len(other_ids)):
            return arrow.empty_table()
        columns = [np.repeat(ids, len(other_ids)), np.tile(other_ids, len(ids)), (mine @ other.T).ravel()]
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

    small = _shipped(right, max_shipped)
    if small is not None:
        other, other_ids = _matrix(small["_v"], metric), _plain(small["_b"])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield from full(_matrix(batch.column(1), metric), _plain(batch.column(0)), other, other_ids).to_batches()

        pairs = left.mapInArrow(scan, schema)
    else:
        pairs = _meet(left, "_a", right, "_b", schema, lambda x, y: full(_matrix(x["_v"], metric), _plain(x["_a"]), _matrix(y["_v"], metric), _plain(y["_b"])), block_rows)
    return pairs.select(F.col("_a").alias(a_id), F.col("_b").alias(b_id), "similarity")


def match_existing(new: DataFrame, existing: DataFrame, threshold: float, id: str = "id", name: str = "name", vector: str = "embedding", metric: str = "dot", **limits: int) -> DataFrame:
    """Per new row: is its best existing match at least ``threshold``, which one, how close.

    Without any existing row the answer is false, NULL, 0.
    """
    best = top_k(existing, new, 1, name, vector, id, vector, metric, **limits).drop("rank").withColumnRenamed(id, "_id")
    similar = F.coalesce(F.col("similarity"), F.lit(0.0))
    return new.select(id).join(best, F.col(id) == F.col("_id"), "left").select(
        id,
        (F.col("similarity").isNotNull() & (similar >= threshold)).alias("is_similar"),
        F.when(similar >= threshold, F.col(name)).alias("matched"),
        similar.alias("similarity"),
    )


# --- similarity joins ----------------------------------------------------------


def similarity_join(
    left: DataFrame,
    right: DataFrame | None,
    threshold: float,
    id: str = "id",
    vector: str = "embedding",
    inclusive: bool = False,
    block_rows: int | None = None,
    max_tree_bytes: int = MAX_TREE_BYTES,
) -> DataFrame:
    """Pairs ``left_id, right_id, similarity`` whose cosine exceeds the threshold.

    Without ``right`` it is a self join keeping ``left_id < right_id``. The join is
    exact. Vectors are cut into the cells of a pivot tree drawn from the data; a row
    meets only the cells its radius reaches, and each cell, however full, is cut
    into hash blocks of bounded size. Cells of ``block_rows`` rows that rows would reach
    by the dozen are made larger first. Only pairs beyond the threshold leave a task.
    A tree of more than ``max_tree_bytes`` keeps its second level distributed.
    The input is read several times: pass a table or a pinned frame.
    """
    return _blocked_join(left, right, threshold, id, vector, inclusive, block_rows, max_tree_bytes, "pairs")


def compared_pairs(left: DataFrame, right: DataFrame | None, threshold: float, id: str = "id", vector: str = "embedding", block_rows: int | None = None, max_tree_bytes: int = MAX_TREE_BYTES) -> DataFrame:
    """One row: the pairs that such a join compares, and all pairs there are."""
    placed = _placed(left, right, threshold, id, vector, block_rows or BLOCK_ROWS, max_tree_bytes)
    if placed is None:
        return left.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("compared"), F.lit(0).cast("bigint").alias("all_pairs"))
    sizes = placed.sizes()
    met = F.col("_homes") * F.col("_guests")
    if right is None:
        met = met - F.expr("_homes * (_homes + 1) div 2")  # within a cell each pair once
        total = (F.sum("_homes") * (F.sum("_homes") - 1) / 2).cast("bigint")
    else:
        total = F.sum("_homes") * F.lit(_usable(right, vector, "cosine").count())
    return sizes.agg(F.sum(met).alias("compared"), total.alias("all_pairs"))


def neighbour_counts(
    left: DataFrame,
    right: DataFrame | None,
    threshold: float,
    id: str = "id",
    vector: str = "embedding",
    inclusive: bool = False,
    block_rows: int | None = None,
    max_tree_bytes: int = MAX_TREE_BYTES,
) -> DataFrame:
    """The same join reduced inside the tasks to ``right_id, hits``: how many left rows
    each right row meets. A crowd of close vectors gives one row each, not all pairs."""
    blocks = _blocked_join(left, right, threshold, id, vector, inclusive, block_rows, max_tree_bytes, "hits")
    return blocks.groupBy("right_id").agg(F.sum("hits").alias("hits"))


def paired_ids(df: DataFrame, threshold: float, id: str = "id", vector: str = "embedding", block_rows: int | None = None, max_tree_bytes: int = MAX_TREE_BYTES) -> DataFrame:
    """The ids of the rows that have a partner, of at least the threshold, in their own table. No pair leaves a task."""
    blocks = _blocked_join(df, None, threshold, id, vector, True, block_rows, max_tree_bytes, "ids")
    return blocks.select(F.col("right_id").alias(id)).distinct()


def nearest(left: DataFrame, right: DataFrame, threshold: float, id: str = "id", vector: str = "embedding", block_rows: int | None = None, max_tree_bytes: int = MAX_TREE_BYTES) -> DataFrame:
    """``right_id, left_id, similarity``: the most similar left row of each right row, if it is one of at least the threshold.

    The smallest ``left_id`` among equals. A task passes on one row per right row, as ``top_k`` does, but rows travel
    as in the join: to the cells they reach, or once for each of a few large blocks.
    """
    blocks = _blocked_join(left, right, threshold, id, vector, True, block_rows, max_tree_bytes, "nearest")
    best = F.min_by(F.struct("left_id", "similarity"), F.struct(-F.col("similarity"), F.col("left_id")))
    return blocks.groupBy("right_id").agg(best.alias("_b")).select("right_id", "_b.left_id", "_b.similarity")


class _Placed(NamedTuple):
    """Rows of both sides by cell: ``homes`` in their own, ``guests`` also in those they reach."""

    homes: DataFrame
    guests: DataFrame
    one_table: bool
    rows: int  # of a cell, about, as of a block

    def sizes(self) -> DataFrame:
        """Homes and guests of each cell that has both."""
        if self.one_table:
            counts = self.guests.groupBy("_cell").agg(F.count_if("_own").alias("_homes"), F.count("*").alias("_guests"))
            return counts.where("_homes > 0")
        counted = lambda df, name: df.groupBy("_cell").agg(F.count("*").alias(name))
        return counted(self.homes, "_homes").join(counted(self.guests, "_guests"), "_cell")


def _placed(left: DataFrame, right: DataFrame | None, threshold: float, id: str, vector: str, rows: int, max_tree_bytes: int) -> _Placed | None:
    a = _usable(left, vector, "cosine").select(F.col(id).alias("_id"), F.col(vector).alias("_v"))
    b = a if right is None else _usable(right, vector, "cosine").select(F.col(id).alias("_id"), F.col(vector).alias("_v"))
    radius = float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold)))
    tree, rows = fitting_tree(a, b, rows, radius, right is None, max_tree_bytes)
    if tree.empty:
        return None
    if right is None:
        guests = tree.place(a, radius, halved=True)
        # Columns of its own, so that Spark can tell both sides of the join apart.
        homes = guests.where("_own").select(*[F.col(c).alias(f"{c}_") for c in guests.columns]).toDF(*guests.columns)
        return _Placed(homes, guests, True, rows)
    return _Placed(tree.place(a, None), tree.place(b, radius), False, rows)


def _blocked_join(
    left: DataFrame, right: DataFrame | None, threshold: float, id: str, vector: str, inclusive: bool, block_rows: int | None, max_tree_bytes: int, kind: str
) -> DataFrame:
    self_join = right is None
    right_field = T.StructField("right_id", (left if self_join else right).schema[id].dataType)
    counted = kind in ("hits", "ids")
    if counted:
        schema = T.StructType([right_field, T.StructField("hits", T.LongType())])
    else:
        schema = T.StructType([T.StructField("left_id", left.schema[id].dataType), right_field, T.StructField("similarity", T.DoubleType())])
    placed = _placed(left, right, threshold, id, vector, block_rows or BLOCK_ROWS, max_tree_bytes)
    if placed is None:
        return left.sparkSession.createDataFrame([], schema)
    rows = placed.rows

    # A row per cell: as many as the table has blocks. Left to Spark, which ships it if it is small.
    blocks = lambda name: F.ceil(F.col(name) / F.lit(rows)).cast("int")
    # Where all guests of a cell live in it, two of its blocks meet once.
    once = (F.lit(self_join) & (F.col("_homes") == F.col("_guests"))).alias("_once")
    sizes = placed.sizes().select("_cell", blocks("_homes").alias("_nl"), blocks("_guests").alias("_nr"), once)

    def block(df: DataFrame, own: str, other: str, names: tuple[str, str], guest: bool) -> DataFrame:
        sized = df.join(sizes, "_cell").withColumn(names[0], F.pmod(F.xxhash64("_id"), F.col(own)).cast("int"))
        low, high = F.lit(0), F.col(other) - 1
        if guest:
            high = F.when(F.col("_once"), F.col(names[0])).otherwise(high)
        else:
            low = F.when(F.col("_once"), F.col(names[0])).otherwise(low)
        dealt = sized.withColumn(names[1], F.explode(F.sequence(low, high)))
        # Both sides come as one frame; their ids may differ in type.
        mine, none = F.col("_id"), F.lit(None)
        ids = [none.cast(left.schema[id].dataType), mine] if guest else [mine, none.cast(right_field.dataType)]
        both_ways = F.col("_own") & ~(F.col("_once") & (F.col("_lb") != F.col("_rb")))
        return dealt.select(*keys, F.lit(guest).alias("_guest"), both_ways.alias("_own"), "_v", ids[0].alias("_x"), ids[1].alias("_y"))

    arrow = _arrow_schema(schema)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(batches)
        x, y = both.filter(pc.invert(both["_guest"])), both.filter(both["_guest"])
        if x.num_rows == 0 or y.num_rows == 0:
            return
        mine, other = unit_rows(x["_v"]), unit_rows(y["_v"])
        x_ids, y_ids = _plain(x["_x"]), _plain(y["_y"])
        own = _plain(y["_own"]).astype(bool)
        del both, x, y
        step = max(1, _PRODUCT // len(y_ids))
        if kind == "nearest":
            yield from _batches(_nearest(mine, x_ids, other, y_ids, threshold, step), arrow)
            return
        x_hits, y_hits = np.zeros(len(x_ids), np.int64), np.zeros(len(y_ids), np.int64)
        for start in range(0, len(x_ids), step):
            scores = mine[start : start + step] @ other.T
            i, j = np.nonzero(scores >= threshold if inclusive else scores > threshold)
            similarity, i = scores[i, j], start + i
            if self_join:
                # Two rows of one block meet in both orders, as they may in one cell; a guest from a later cell meets once.
                kept = (x_ids[i] < y_ids[j]) | ~own[j]
                i, j, similarity = i[kept], j[kept], similarity[kept]
            turned = x_ids[i] > y_ids[j] if self_join else np.zeros(len(i), bool)
            if kind == "ids":
                x_hits[i], y_hits[j] = 1, 1
                continue
            if counted:
                x_hits += np.bincount(i[turned], minlength=len(x_hits))
                y_hits += np.bincount(j[~turned], minlength=len(y_hits))
                continue
            # What a slice has found leaves the task before the next one is looked at.
            left_ids, right_ids = x_ids[i], y_ids[j]
            if self_join:
                left_ids, right_ids = np.where(turned, right_ids, left_ids), np.where(turned, left_ids, right_ids)
            yield from _batches((left_ids, right_ids, similarity), arrow)
        if counted:
            for ids, hits in ((x_ids, x_hits), (y_ids, y_hits)):
                yield from _batches((ids[hits > 0], hits[hits > 0]), arrow)

    keys = ["_cell", "_lb", "_rb"]
    x = block(placed.homes, "_nl", "_nr", ("_lb", "_rb"), False)
    y = block(placed.guests, "_nr", "_nl", ("_rb", "_lb"), True)
    return x.unionByName(y).groupBy(*keys).applyInArrow(kernel, schema)


def _nearest(mine: np.ndarray, ids: np.ndarray, other: np.ndarray, other_ids: np.ndarray, threshold: float, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows of ``other`` that have one: the id of the most similar row of ``mine``, the smallest among equals, their own id and the similarity."""
    order = np.argsort(ids, kind="stable")
    mine, ids = mine[order], ids[order]
    at, best = np.zeros(len(other_ids), np.int64), np.full(len(other_ids), -np.inf)
    for start in range(0, len(ids), step):
        scores = mine[start : start + step] @ other.T
        i, j = np.nonzero(scores >= threshold - 10.0**-_DIGITS)
        similarity = np.round(scores[i, j], _DIGITS)
        kept = similarity >= threshold
        i, j, similarity = i[kept], j[kept], similarity[kept]
        ranked = np.lexsort((i, -similarity, j))
        firsts = ranked[np.flatnonzero(np.diff(j[ranked], prepend=-1))]
        # Slices come in the order of their ids, so an equal one is no better.
        firsts = firsts[similarity[firsts] > best[j[firsts]]]
        at[j[firsts]], best[j[firsts]] = start + i[firsts], similarity[firsts]
    found = np.flatnonzero(best > -np.inf)
    return ids[at[found]], other_ids[found], best[found]


def _batches(columns: Sequence[np.ndarray], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The columns as batches of bounded size."""
    for start in range(0, len(columns[0]), _BATCH):
        yield pa.RecordBatch.from_arrays([pa.array(c[start : start + _BATCH], type=f.type) for c, f in zip(columns, arrow)], schema=arrow)


def _copies(df: DataFrame, order: str, vector: str) -> DataFrame:
    """Every row with the first ``order`` value among the rows of the same vector."""
    firsts = df.groupBy(vector).agg(F.min(order).alias("_first"))
    return df.join(firsts, vector)


def near_duplicates(
    df: DataFrame, threshold: float, id: str = "id", vector: str = "embedding", block_rows: int | None = None, max_tree_bytes: int = MAX_TREE_BYTES, all_copies: bool = False
) -> DataFrame:
    """Pairs above the threshold among distinct vectors, each standing under its first id.

    Further copies of a vector are linked to that first id only, so a vector
    repeated n times gives n - 1 pairs instead of all of them. With ``all_copies`` every
    pair of rows is listed: copies with each other, and each copy with all that its vector is close to.
    """
    usable = _usable(df.select(id, vector), vector, "cosine")
    if all_copies:
        return similarity_join(usable, None, threshold, id, vector, block_rows=block_rows, max_tree_bytes=max_tree_bytes)
    # The join below reads its input several times, so the fold is pinned.
    firsts = cut_lineage(usable.groupBy(vector).agg(F.min(id).alias(id)))
    between = similarity_join(firsts, None, threshold, id, vector, block_rows=block_rows, max_tree_bytes=max_tree_bytes)
    copies = _copies(usable, id, vector).filter(F.col(id) != F.col("_first"))
    return between.unionByName(copies.select(F.col("_first").alias("left_id"), F.col(id).alias("right_id"), F.lit(1.0).alias("similarity")))


def dedup(df: DataFrame, threshold: float, id: str = "id", vector: str = "embedding", block_rows: int | None = None) -> DataFrame:
    """Drops the later id of every close pair.

    Of the copies of a vector only the first can stay. No pair leaves a task: each
    vector only learns whether an earlier one is close.
    """
    usable = _usable(df.select(id, vector), vector, "cosine")
    firsts = cut_lineage(usable.groupBy(vector).agg(F.min(id).alias(id)))
    late = neighbour_counts(firsts, None, threshold, id, vector, block_rows=block_rows).select(F.col("right_id").alias(id))
    copies = usable.select(id).join(firsts.select(id), id, "left_anti")
    return df.join(late.unionByName(copies), id, "left_anti")


def canonicalize(
    new: DataFrame,
    existing: DataFrame | None,
    threshold: float,
    name: str = "name",
    order: str = "pos",
    vector: str = "embedding",
    block_rows: int | None = None,
    pairs_per_row: int = MAX_PAIRS_PER_ROW,
    **limits: int,
) -> DataFrame:
    """Maps each new concept to its most similar canonical concept, or makes it one.

    Concepts are visited by ``order``, which is unique. A concept whose closest
    canonical concept so far (existing ones, and new ones visited before it)
    reaches the threshold maps to it; otherwise it becomes canonical. Returns
    ``name, canonical, similarity, is_new``.

    The visit is replayed in rounds: a concept with no earlier neighbour left to
    decide is decided. While there are many pairs, only their number per concept is
    computed, so a crowd of close concepts is decided without listing its pairs;
    once few are left they are listed and the rounds go on over the list. Copies of
    one vector take part once, under the first.
    """
    rows = new.select(name, order, vector)
    usable = cut_lineage(_copies(_usable(rows, vector, "cosine"), order, vector))
    firsts = usable.filter(F.col(order) == F.col("_first"))
    points = firsts.select(F.col(order).alias("id"), F.col(vector).alias("embedding"))
    # Only concepts near another new one, or with copies, can cover one or be covered; the others need no more than the existing ones.
    paired = paired_ids(points, threshold - 1e-9, block_rows=block_rows)
    copied = usable.filter(F.col(order) != F.col("_first")).select(F.col("_first").alias("id"))
    crowd = cut_lineage(points.join(paired.unionByName(copied), "id", "left_semi"))
    best = None
    undecided = points
    if existing is not None:
        old = existing.select(F.col(name).alias("_old"), F.col(vector).alias("embedding"))
        if _shipped(_usable(old, "embedding", "cosine").select(F.col("embedding").alias("_v")), limits.get("max_shipped", MAX_SHIPPED)) is not None:
            best = top_k(old, points.withColumnRenamed("id", "_first"), 1, "_old", "embedding", "_first", "embedding", **limits).filter(F.col("similarity") >= threshold).drop("rank")
        else:
            best = nearest(old.withColumnRenamed("_old", "id"), points, threshold, block_rows=block_rows).select(F.col("right_id").alias("_first"), F.col("left_id").alias("_old"), "similarity")
        best = cut_lineage(best)
        undecided = points.join(best.select(F.col("_first").alias("id")), "id", "left_anti")
    undecided = cut_lineage(undecided.select("id"))
    crowded = cut_lineage(crowd.join(undecided, "id", "left_semi"))
    chosen = cut_lineage(_first_come(crowded, threshold, block_rows, pairs_per_row))

    # A member's candidates: canonical vectors near its own that were visited before it.
    near = similarity_join(cut_lineage(crowd.join(chosen, "id", "left_semi")), crowd, threshold, inclusive=True, block_rows=block_rows)
    near = near.select(F.col("right_id").alias("_first"), F.col("left_id").alias("_at"), "similarity")
    # Only a candidate closer than all before it can be anyone's best: a vector with
    # very many copies then meets few rows.
    before = Window.partitionBy("_first").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("similarity", F.round("similarity", _DIGITS)).withColumn("_best", F.max("similarity").over(before))
    near = near.filter(F.col("_best").isNull() | (F.col("similarity") > F.col("_best"))).drop("_best")
    names = rows.select(F.col(order).alias("_at"), F.col(name).alias("canonical"))
    members = usable.select(name, order, "_first")
    found = (
        members.join(near, "_first")
        .filter(F.col("_at") < F.col(order))
        .select(name, order, F.lit(1).alias("_late"), "_at", "similarity")
        .groupBy(name, order)
        .agg(F.min_by(F.struct("_late", "_at", "similarity"), F.struct(-F.col("similarity"), F.col("_at"))).alias("_n"))
        .select(name, order, "_n.*")
        .join(names, "_at")
        .select(name, order, "_late", "canonical", "similarity")
    )
    if best is not None:
        older = members.join(best, "_first").select(name, order, F.lit(0).alias("_late"), F.col("_old").alias("canonical"), "similarity")
        found = found.unionByName(older)
    # Among equals an existing concept was there first.
    settled = found.groupBy(name, order).agg(F.min_by(F.struct("canonical", "similarity"), F.struct(-F.col("similarity"), F.col("_late"))).alias("_m"))
    return rows.select(name, order).join(settled, [name, order], "left").select(
        name,
        F.coalesce("_m.canonical", name).alias("canonical"),
        F.coalesce("_m.similarity", F.lit(1.0)).alias("similarity"),
        F.col("_m").isNull().alias("is_new"),
    )


def _first_come(undecided: DataFrame, threshold: float, block_rows: int | None, pairs_per_row: int) -> DataFrame:
    """Ids of ``(id, embedding)`` picked in order, skipping those near an earlier pick."""
    picks = []
    while rows := undecided.count():
        earlier = cut_lineage(neighbour_counts(undecided, None, threshold, inclusive=True, block_rows=block_rows))
        if (earlier.agg(F.sum("hits")).first()[0] or 0) <= pairs_per_row * rows:
            break
        picked = cut_lineage(undecided.join(earlier.select(F.col("right_id").alias("id")), "id", "left_anti"))
        decided = neighbour_counts(picked, undecided, threshold, inclusive=True, block_rows=block_rows).select(F.col("right_id").alias("id"))
        picks.append(picked.select("id"))
        # A pick is near itself; it is named again in case rounding says otherwise.
        undecided = cut_lineage(undecided.join(decided.unionByName(picked.select("id")), "id", "left_anti"))
    edges = similarity_join(undecided, None, threshold, inclusive=True, block_rows=block_rows)
    return reduce(DataFrame.unionByName, picks, _peel(undecided.select("id"), edges))


def _peel(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """The same over listed pairs, ``left_id`` being the earlier.

    In each round an id that is no one's later neighbour is picked, its later
    neighbours are covered, and the pairs of both leave; ids without pairs are
    picked in the end.
    """
    edges = cut_lineage(edges.select("left_id", "right_id"))
    left, right = F.col("id").alias("left_id"), F.col("id").alias("right_id")
    covered = []
    while not edges.isEmpty():
        later = edges.select(F.col("right_id").alias("left_id")).distinct()
        picked = edges.select("left_id").distinct().join(later, "left_id", "left_anti")
        hit = cut_lineage(edges.join(picked, "left_id", "left_semi").select(F.col("right_id").alias("id")).distinct())
        covered.append(hit)
        # A picked id has only covered neighbours, so its pairs leave with them.
        edges = cut_lineage(edges.join(hit.select(left), "left_id", "left_anti").join(hit.select(right), "right_id", "left_anti"))
    return ids.join(reduce(DataFrame.unionByName, covered), "id", "left_anti") if covered else ids


# --- approximate search --------------------------------------------------------


def ann_index(df: DataFrame, lists: int = 100, vector: str = "embedding", train_share: float = 1.0, seed: int = 7) -> tuple[DataFrame, list[list[float]]]:
    """Adds the k-means ``cell`` of each vector; returns the frame and the centres.

    Training uses all rows, or the share of them that the caller gives, by a hash of the vector; indexing uses all.
    Write the frame partitioned by ``cell`` and a probe reads only its cells.
    """
    usable = _usable(df, vector, "cosine")
    length = vec.norm(vector)
    unit = F.transform(vector, lambda x: x.cast("double"))
    points = usable.withColumn("_n", length).withColumn("_p", array_to_vector(F.transform(unit, lambda x: x / F.col("_n"))))
    drawn = F.pmod(F.xxhash64(vector), F.lit(1_000_000)) < int(train_share * 1_000_000)
    sample = points.where(drawn).select("_p") if train_share < 1 else points.select("_p")
    # Training passes over its rows a dozen times.
    sample = sample.persist(StorageLevel.MEMORY_AND_DISK)
    model = KMeans(k=lists, seed=seed, featuresCol="_p", predictionCol="cell", maxIter=10).fit(sample)
    sample.unpersist()
    return model.transform(points).drop("_n", "_p"), [list(map(float, c)) for c in model.clusterCenters()]


def ann_top_k(
    index: DataFrame,
    centres: Sequence[Sequence[float]],
    queries: DataFrame,
    k: int,
    probes: int | None = None,
    id: str = "id",
    vector: str = "embedding",
    query_id: str = "query_id",
    query_vector: str = "embedding",
    first: int = 10,
    block_rows: int = CELL_BLOCK_ROWS,
) -> DataFrame:
    """Top ``k`` of each query from the cells near it, ranked exactly.

    Without ``probes`` nothing is missed: after the nearest ``first`` cells every other one is read
    that may hold a vector as close as the k-th found, by its centre and its widest angle. On
    vectors without clusters that is nearly all of them. With ``probes`` only so many cells are
    read, and the result is approximate.

    Within a cell, blocks of ``block_rows`` queries and vectors meet as matrices, and only the best ``k`` per query
    and block go on. The index is read several times, so it should be written or cut off before.
    """
    spark = queries.sparkSession
    middle = spark.createDataFrame([(i, list(map(float, c))) for i, c in enumerate(centres)], "cell int, _centre array<double>")
    # Each query meets each centre once: a row per query and list, without the centre.
    scored = similarity_matrix(queries.select(F.col(query_id).alias("_q"), F.col(query_vector).alias("_qv")), middle.where(F.exists("_centre", lambda x: x != 0)), "_q", "cell", "_qv", "_centre")
    # A centre without direction is as far as can be.
    blind = queries.select(F.col(query_id).alias("_q")).join(F.broadcast(middle.where(F.forall("_centre", lambda x: x == 0)).select("cell")), how="cross").withColumn("similarity", F.lit(None).cast("double"))
    order = Window.partitionBy("_q").orderBy(F.desc_nulls_last("similarity"), "cell")
    placed = scored.unionByName(blind).withColumn("_n", F.row_number().over(order) - 1)
    wanted = placed.select("_q", "_n", "cell", (-F.col("similarity")).alias("_far"))
    wanted = cut_lineage(wanted if probes is None else wanted.where(F.col("_n") < probes))
    asked = _usable(queries, query_vector, "cosine").select(F.col(query_id).alias("_q"), F.col(query_vector).alias("_v"))
    rows = index.select("cell", F.col(id).alias("_id"), F.col(vector).alias("_v"))
    schema = T.StructType([asked.schema["_q"], T.StructField("_id", rows.schema["_id"].dataType), T.StructField("similarity", T.DoubleType())])
    arrow = _arrow_schema(schema)
    ranking = Window.partitionBy("_q").orderBy(F.desc("similarity"), "_id")

    def ranked(hits: DataFrame) -> DataFrame:
        return hits.withColumn("rank", F.row_number().over(ranking)).filter(F.col("rank") <= k)

    def found(cells: DataFrame) -> DataFrame:
        numbers = [df.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias(n)) for df, n in ((cells, "_queries"), (rows, "_rows"))]
        blocks = F.broadcast(numbers[0].join(numbers[1], "cell"))  # a row per list

        def dealt(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
            numbered = df.join(blocks, "cell").withColumn(own, F.pmod(F.xxhash64(key), own).cast("int"))
            return numbered.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

        meeting = ["cell", "_queries", "_rows"]
        left = dealt(cells.select("_q", "cell"), "_q", "_queries", "_rows").join(asked, "_q").groupBy(*meeting)
        right = dealt(rows, "_id", "_rows", "_queries").groupBy(*meeting)
        return left.cogroup(right).applyInArrow(lambda q, r: _ranked(
            _matrix(q["_v"], "cosine"), _plain(q["_q"]), _matrix(r["_v"], "cosine"), _plain(r["_id"]), k, None, arrow), schema)

    if probes is None:
        near = cut_lineage(ranked(found(wanted.filter(F.col("_n") < first))).drop("rank"))
        hits = near.unionByName(found(_within_bound(index, middle, wanted.filter(F.col("_n") >= first), near, k, vector)))
    else:
        hits = found(wanted)
    return ranked(hits).select(
        F.col("_q").alias(query_id), F.col("_id").alias(id), "similarity", F.col("rank").cast("bigint").alias("rank")
    )


def _within_bound(index: DataFrame, middle: DataFrame, cells: DataFrame, near: DataFrame, k: int, vector: str) -> DataFrame:
    """The ``cells`` of each query that may hold a vector as close as the k-th in ``near``, by the triangle inequality of angles."""
    angle = lambda c: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))
    # A centre without direction has no angles; such a cell is always read.
    widest = index.join(F.broadcast(middle), "cell").groupBy("cell").agg(angle(F.min(vec.cosine(vector, "_centre"))).alias("_wide"))
    floor = near.groupBy("_q").agg(F.when(F.count("*") >= k, F.min("similarity")).alias("_floor"))
    best = F.cos(F.greatest(F.lit(0.0), angle(-F.col("_far")) - F.col("_wide")))
    ruled_out = best < F.col("_floor") - F.lit(1e-6)  # well above what rounding makes of an angle
    return cells.join(widest, "cell").join(floor, "_q", "left").filter(~F.coalesce(ruled_out & F.col("_far").isNotNull() & F.col("_wide").isNotNull(), F.lit(False)))


def recall(exact: DataFrame, approximate: DataFrame, query_id: str = "query_id", id: str = "id") -> DataFrame:
    """Share of the exact hits that the approximate search found, per query."""
    found = approximate.select(query_id, id, F.lit(1).alias("_hit"))
    return exact.join(found, [query_id, id], "left").groupBy(query_id).agg(F.avg(F.coalesce("_hit", F.lit(0)).cast("double")).alias("recall"))


# --- embedding with a caller's model -------------------------------------------


def attach_embeddings(
    df: DataFrame,
    text: str,
    load: Callable[[], Callable[[list[str]], list[list[float]]]],
    batch: int = 50,
    retries: int = 3,
    name: str = "embedding",
    workers: int = 1,
    per_second: float | None = None,
) -> DataFrame:
    """Encodes a text column with a caller's model.

    ``load`` returns the encoder and runs once per task. Each distinct text is
    encoded once; blank texts give NULL. A batch that fails, or gives another number
    of vectors than it has texts, is retried text by text; what still fails gives NULL
    and its reason in the column ``error``. A task makes up to ``workers`` calls at once, for which
    the encoder must be safe, and starts at most ``per_second`` of them, retries included.
    """
    key = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), F.col(text)).alias("b"))
    distinct = df.where(F.trim(text) != "").select(key.alias("_k"), F.col(text).alias("_t")).groupBy("_k", "_t").agg(F.lit(1)).select("_k", "_t")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, bucket = load(), TokenBucket(per_second, workers)

        def encoder(texts: list[str]) -> list[list[float]]:
            bucket.take()
            return model(texts)

        def attempt(texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
            try:
                found = list(encoder(texts))
                if len(found) == len(texts):
                    return [(v, None) for v in found]
            except Exception:  # one bad text must not lose the batch
                pass
            return [retry(t) for t in texts]

        def retry(single: str) -> tuple[list[float] | None, str | None]:
            reason = None
            for _ in range(retries):
                try:
                    found = list(encoder([single]))
                    if len(found) == 1:
                        return found[0], None
                    reason = f"{len(found)} vectors for one text"
                except Exception as error:
                    reason = f"{type(error).__name__}: {error}"
            return None, reason

        for records in batches:
            texts = records.column("_t").to_pylist()
            pairs = [p for part in in_order(attempt, (texts[start : start + batch] for start in range(0, len(texts), batch)), workers) for p in part]
            columns = [records.column("_k"), records.column("_t"), pa.array([v for v, _ in pairs], pa.list_(pa.float32())), pa.array([e for _, e in pairs], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["_k", "_t", name, "error"])

    encoded = distinct.mapInArrow(encode, f"_k struct<a: bigint, b: bigint>, _t string, {name} array<float>, error string")
    # The hash is the key, so long texts are neither sorted nor hashed again; the text decides.
    return df.withColumn("_own", key).join(encoded, (F.col("_own") == F.col("_k")) & (F.col(text) == F.col("_t")), "left").drop("_own", "_k", "_t")
