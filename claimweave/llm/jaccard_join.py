"""Exact Jaccard join of word-shingle sets through a token-group matrix.

1. Equal sets are one node. A global order puts the commonest shingles last; a set's first few
   shingles in that order are such that two similar sets share one of them.
2. Nodes that agree in one of their shared shingles form a group. The matrix, from shingles to the
   groups that hold them, names for each node the few groups it could be similar to.
3. A group's task holds the union of its members' shingles. It bounds what a query shares with
   any member, opens the group only if that can be enough, and then counts the overlap with
   every member exactly. Links that join nothing new are not listed.
4. Links become components.

Texts move once to be dealt by document and once to their groups; the matrix moves numbers only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave.llm.common import NO_ID, pinned
from claimweave.llm.components import components

# Shingles counted as common come from one text in so many, and are so many at most: two megabytes.
SAMPLE = 16
COMMON = 1 << 18
_COMMON_TIMES = 3
# Members of a group that one task holds.
BLOCK = 512
# Pairs of node and group that are looked at together.
_PAIRS = 1 << 18
# A packed shingle: the sign, six bits of class, and the hash.
_CLASS_SHIFT = 57


class Shingles:
    """Shingle sets of texts, as sorted 64-bit numbers."""

    REMEMBERED = 200_000

    def __init__(self, width: int) -> None:
        self._width = width
        self._words: dict[bytes, int] = {}
        self._factors = np.array([pow(0x9E3779B97F4A7C15 | 1, i + 1, 1 << 64) for i in range(width)], np.uint64)

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "replace").lower().split()  # lower-cases A-Z only, splits at ASCII blanks
        if not words:
            return np.empty(0, np.uint64)
        known = self._words
        if len(known) > self.REMEMBERED:
            known.clear()
        for word in set(words):
            if word not in known:
                known[word] = xxhash.xxh64_intdigest(word)
        codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = len(codes) - self._width + 1
        with np.errstate(over="ignore"):
            if n < 1:
                sums = np.array([(codes * self._factors[: len(codes)]).sum() + np.uint64(len(codes))], np.uint64)
            else:
                sums = np.zeros(n, np.uint64)
                for k in range(self._width):
                    sums += codes[k : k + n] * self._factors[k]
            sums ^= sums >> np.uint64(31)
            sums *= np.uint64(0xD6E8FEB86659FD93)
            sums ^= sums >> np.uint64(32)
        return np.unique(sums)


def _node(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _needed(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """Shingles that a set of n must share with any set similar to it."""
    return -(-n * percent // 100)


def _first(shingles: np.ndarray, common: np.ndarray, classes: np.ndarray, percent: int) -> np.ndarray:
    """The set's first shingles in the global order: class, then hash, packed into one number."""
    packed = shingles >> np.uint64(64 - _CLASS_SHIFT)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        packed = packed | np.where(common[at] == shingles, classes[at], np.uint64(0)) << np.uint64(_CLASS_SHIFT)
    count = len(shingles) - int(_needed(len(shingles), percent)) + 1
    return np.partition(packed, count - 1)[:count].astype(np.int64) if count < len(packed) else packed.astype(np.int64)


def _record(columns: dict[str, tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in columns.values()], list(columns))


def _common(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles, by a sample of the documents, and a class that grows with their number.

    They only shape the order, so any choice gives the same links.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingles(width)
        for batch in batches:
            sets = [make.of(t) for t in batch.column("text").to_pylist()]
            found, times = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0, np.uint64), np.empty(0, np.int64))
            yield _record({"shingle": (found.view(np.int64), pa.int64()), "times": (times, pa.int64())})

    # Copies of a text count once, or a few large groups of copies would fill the list.
    drawn = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").distinct()
    counted = drawn.mapInArrow(count, "shingle bigint, times bigint").groupBy("shingle").agg(F.sum("times").alias("times"))
    top = counted.where(F.col("times") >= _COMMON_TIMES).orderBy(F.desc("times"), "shingle").limit(COMMON).toPandas()
    shingles = top["shingle"].to_numpy(np.int64).view(np.uint64)
    classes = np.minimum(31, np.frexp(top["times"].to_numpy(np.float64))[1]).astype(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], classes[order]


def _named(texts: DataFrame, width: int, percent: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``k``, ``ord``, ``node``, ``n`` and ``tokens`` (the first ones) of every document: the one pass that makes all shingles.

    Of the documents of a batch that are one node, only the first has tokens.
    """

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingles(width)
        for batch in batches:
            nodes, sizes, tokens, seen = [], [], [], set()
            for text in batch.column("text").to_pylist():
                shingles = make.of(text)
                nodes.append(_node(shingles) if len(shingles) else None)
                sizes.append(len(shingles))
                fresh = len(shingles) and nodes[-1] not in seen
                tokens.append(_first(shingles, *common, percent) if fresh else None)
                seen.add(nodes[-1])
            columns = [batch.column("k"), batch.column("ord"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["k", "ord", "node", "n", "tokens"])

    return texts.mapInArrow(name, "k bigint, ord bigint, node bigint, n bigint, tokens array<bigint>")


def _shared_tokens(named: DataFrame) -> DataFrame:
    """Nodes with those of their first tokens that another node has among its own: ``node``, ``n``, ``tokens``."""
    buckets = 4 * int(named.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            if batch.num_rows:
                lengths = batch.column("tokens").value_lengths().to_numpy(zero_copy_only=False)
                tokens = batch.column("tokens").flatten().to_numpy()
                nodes = np.repeat(batch.column("node").to_numpy(), lengths)
                sizes = np.repeat(batch.column("n").to_numpy().astype("<u4"), lengths)
                bucket = tokens % buckets
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for b in range(buckets):
                    own = order[cuts[b] : cuts[b + 1]]
                    if len(own):
                        out.append((b, tokens[own].tobytes(), nodes[own].tobytes(), sizes[own].tobytes()))
            columns = [list(c) for c in zip(*out, strict=True)] or [[]] * 4
            yield _record({"bucket": (columns[0], pa.int64()), "tokens": (columns[1], pa.binary()), "nodes": (columns[2], pa.binary()), "sizes": (columns[3], pa.binary())})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        current = None

        def settle() -> pa.RecordBatch:
            tokens, nodes = (np.frombuffer(b"".join(r[i] for r in held), np.int64) for i in (0, 1))
            sizes = np.frombuffer(b"".join(r[2] for r in held), "<u4").astype(np.int64)
            order = np.lexsort((nodes, tokens))
            tokens, nodes, sizes = tokens[order], nodes[order], sizes[order]
            new = np.ones(len(tokens), bool)
            new[1:] = (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])
            tokens, nodes, sizes = tokens[new], nodes[new], sizes[new]
            same = tokens[1:] == tokens[:-1]
            several = np.append(same, False) | np.append(False, same)
            return _record({"node": (nodes[several], pa.int64()), "n": (sizes[several], pa.int64()), "token": (tokens[several], pa.int64())})

        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if row[0] != current:
                    if held:
                        yield settle()
                    held, current = [], row[0]
                held.append(row[1:])
        if held:
            yield settle()

    packed = named.where("tokens is not null").select("node", "n", "tokens").mapInArrow(deal, "bucket bigint, tokens binary, nodes binary, sizes binary")
    shared = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "node bigint, n bigint, token bigint")
    return shared.groupBy("node", "n").agg(F.collect_list("token").alias("tokens"))


def _matches(shared: DataFrame, percent: int) -> DataFrame:
    """How many first tokens a node has in common with the other nodes of a group: ``node``, ``n``, ``g``, ``times``.

    The matrix is read by token, in runs; a run pairs its nodes with its groups, not with each other.
    """

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty((4, 0), np.int64)

        def matched(block: np.ndarray) -> Iterator[pa.RecordBatch]:
            token, g, node, n = block  # sorted by token, then group
            if not len(token):
                return
            runs = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            heads = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (g[1:] != g[:-1])))
            low, high = np.minimum.reduceat(n, heads), np.maximum.reduceat(n, heads)
            alone = np.diff(np.append(heads, len(token))) == 1
            first = np.searchsorted(heads, runs)
            groups = np.diff(np.append(first, len(heads)))
            run = np.cumsum(np.append(False, token[1:] != token[:-1]))
            before = np.cumsum(groups[run])
            cuts = np.searchsorted(before, np.arange(0, before[-1], _PAIRS), "right")
            for begin, end in zip(cuts, np.append(cuts[1:], len(token)), strict=True):
                many = groups[run[begin:end]]
                row = np.repeat(np.arange(begin, end), many)
                head = first[run[row]] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                own = g[row] == g[heads[head]]
                # Sizes must be within the threshold of each other for some member that has this token.
                fits = ~(own & alone[head]) & (100 * high[head] >= percent * n[row]) & (100 * n[row] >= percent * low[head])
                row, head = row[fits], head[fits]
                if len(row):
                    found, times = np.unique(np.stack([node[row], n[row], g[heads[head]]]), axis=1, return_counts=True)
                    yield _record({"node": (found[0], pa.int64()), "n": (found[1], pa.int64()), "g": (found[2], pa.int64()), "times": (times, pa.int64())})

        for batch in batches:
            block = np.concatenate([rest, np.stack([batch.column(c).to_numpy() for c in ("token", "g", "node", "n")])], axis=1)
            cut = int(np.searchsorted(block[0], block[0, -1])) if block.shape[1] else 0
            yield from matched(block[:, :cut])
            rest = block[:, cut:]
        yield from matched(rest)

    matrix = shared.select(F.explode("tokens").alias("token"), "g", "node", "n")
    found = matrix.repartition("token").sortWithinPartitions("token", "g").mapInArrow(look_up, "node bigint, n bigint, g bigint, times bigint")
    return found.groupBy("node", "n", "g").agg(F.sum("times").alias("times"))


def _visits(shared: DataFrame, percent: int) -> DataFrame:
    """The groups a node must visit: ``node``, ``g``. Others cannot hold a similar set.

    Similar sets of n and m shingles share o = ceil(t (n + m) / (1 + t)) at least, so each lacks
    few of the other's. Of the one whose first tokens end earlier, all first tokens that the other
    has are among the other's first tokens; hence both have o - ceil(t max(n, m)) + 1 first tokens
    in common. Over the sizes in a group this is least at its ends; one is taken off for rounding.
    """
    # Written out, so that both sides of the join are plain and adaptive execution can split a hot group.
    sizes = pinned(shared.groupBy("g").agg(F.min("n").alias("low"), F.max("n").alias("high")), "jaccard-sizes")
    met = _matches(shared, percent).join(sizes, "g")
    met = met.withColumn("low", F.greatest("low", F.expr(f"({percent}L * n + 99) div 100"))).withColumn("high", F.least("high", F.expr(f"100L * n div {percent}L")))
    least = [f"({percent}L * (n + {m}) + {99 + percent}L) div {100 + percent}L - ({percent}L * greatest(n, {m}) + 99) div 100" for m in ("low", "high")]
    return met.where("low <= high").where(f"times >= least({least[0]}, {least[1]})").select("node", "g")


def _links(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Links found in the groups' tasks: ``a``, ``b``. ``rows`` has ``g``, ``block``, ``member``, ``node`` and ``text``."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingles(width)
        members: dict[int, np.ndarray] = {}
        root: dict[int, int] = {}
        index: tuple | None = None
        current = None
        out: list[tuple[int, int]] = []

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def build() -> tuple:
            """The group's matrix: all members' shingles in order, and whose they are."""
            sizes = np.array([len(s) for s in members.values()])
            tokens = np.concatenate(list(members.values()))
            owners = np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort(tokens, kind="stable")
            return list(members), sizes, tokens[order], owners[order]

        def ask(node: int, shingles: np.ndarray) -> None:
            names, sizes, tokens, owners = index
            low, high = np.searchsorted(tokens, shingles), np.searchsorted(tokens, shingles, "right")
            if int((high > low).sum()) < _needed(len(shingles), percent):
                return  # the union does not hold enough of the query; the group stays closed
            counts = high - low
            places = np.repeat(low - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(counts.sum())
            both = np.bincount(owners[places], minlength=len(names))
            for i in np.flatnonzero(100 * both >= percent * (sizes + len(shingles) - both)).tolist():
                if names[i] != node and (a := find(node)) != (b := find(names[i])):
                    root[a] = b
                    out.append((node, names[i]))

        def close() -> None:
            nonlocal index
            if members and index is None:
                index = build()
            for name, shingles in members.items():
                ask(name, shingles)

        for batch in batches:
            for g, block, member, node, text in zip(*[batch.column(c).to_pylist() for c in ("g", "block", "member", "node", "text")], strict=True):
                if (g, block) != current:
                    close()
                    members, root, index, current = {}, {}, None, (g, block)
                shingles = make.of(text)
                if member:  # members come first
                    members[node] = shingles
                elif members:  # a block may have visitors only
                    if index is None:
                        index = build()
                    ask(node, shingles)
            yield _record({"a": ([x[0] for x in out], pa.int64()), "b": ([x[1] for x in out], pa.int64())})
            out.clear()
        close()
        yield _record({"a": ([x[0] for x in out], pa.int64()), "b": ([x[1] for x in out], pa.int64())})

    dealt = rows.repartition("g", "block").sortWithinPartitions("g", "block", F.desc("member"))
    return dealt.select("g", "block", "member", "node", "text").mapInArrow(verify, "a bigint, b bigint")


def _texts(docs: DataFrame) -> DataFrame:
    ord_ = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.xxhash64(ord_, text).alias("k"), ord_.alias("ord"), text.alias("text"))


def _grouped(docs: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """``k``, ``ord`` and ``n`` of every document, and ``first``: the ``ord`` and ``k`` of the first one that links reach."""
    texts = _texts(docs)
    named = pinned(_named(texts, width, percent, _common(texts, width)), "jaccard-nodes")
    # The commonest class of a set's tokens is what a crowd of variants has in common; rarer ones come from their edits.
    # Sizes within a tenth of each other share a group, so its bound is sharp.
    commonest = F.filter("tokens", lambda t: F.shiftright(t, _CLASS_SHIFT) == F.shiftright(F.array_max("tokens"), _CLASS_SHIFT))
    group = F.xxhash64(F.array_min(commonest), F.floor(F.log("n") * 10))
    shared = pinned(_shared_tokens(named).withColumn("g", group), "jaccard-shared")
    visits = pinned(_visits(shared, percent), "jaccard-visits")
    # Only groups that someone must visit are opened.
    members = shared.select("node", "g").join(pinned(visits.select("g").distinct(), "jaccard-open"), "g", "left_semi")
    visits = visits.join(shared.select("node", "g"), ["node", "g"], "left_anti").select("node", "g", F.lit(False).alias("member")).union(members.select("node", "g", F.lit(True)))
    visits = pinned(visits, "jaccard-placed")
    groups = visits.groupBy("g").agg(F.count_if("member").alias("members"))
    groups = pinned(groups.select("g", F.ceil(F.col("members") / block).cast("int").alias("blocks")), "jaccard-groups")
    own = F.pmod(F.hash("node"), "blocks")
    # Members of a large group are dealt to blocks, and each visits the blocks before its own.
    places = F.when(F.col("member"), F.transform(F.sequence(F.lit(0), own), lambda b: F.struct(b.alias("block"), (b == own).alias("member")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), F.lit(False).alias("member")))
    )
    asked = visits.join(groups, "g").select("node", "g", F.explode(places).alias("p")).select("node", F.struct("g", "p.block", "p.member").alias("place"))
    one = named.where("node is not null").groupBy("node").agg(F.min("k").alias("k"))
    wanted = asked.groupBy("node").agg(F.collect_list("place").alias("places")).join(one, "node")
    rows = texts.select("k", "text").join(wanted, "k").select("node", "text", F.explode("places").alias("p")).select("p.*", "node", "text")
    labels = pinned(components(_links(rows, width, percent)), "jaccard-labels")

    first = F.min(F.struct("ord", "k"))
    nodes = named.where("node is not null").groupBy("node").agg(first.alias("own")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    nodes = pinned(nodes, "jaccard-named")
    least = pinned(nodes.groupBy("label").agg(F.min("own").alias("least")), "jaccard-least")
    reached = pinned(nodes.select("node", "label").join(least, "label").select("node", "least"), "jaccard-reached")
    return named.join(reached, "node", "left").select("k", "ord", "n", F.coalesce("least", F.struct("ord", "k")).alias("first"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles`` and ``component_id``.

    A document's set holds its distinct shingles of ``width`` words, A-Z lower-cased; with fewer
    words the whole sequence is one shingle. Two documents link if their sets' intersection is at
    least ``percent`` hundredths of their union. ``component_id`` is the smallest id that links reach.

    A text that is null or has no word has an empty set, links with nothing and is its own
    component. Null ids come last: a component of nothing else has the id null. Rows that repeat
    a text have equal sets. Only ``doc_id`` and ``text`` are read; an empty table gives no rows.
    """
    found = _grouped(docs, width, percent, block)
    clean = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return found.select(clean("ord").alias("doc_id"), F.col("n").alias("n_shingles"), clean("first.ord").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """The documents, with the columns they came with, without all but the first of each component.

    The first is the one with the smallest id; of rows that repeat it one stays. Documents without a word stay.
    """
    found = _grouped(docs, width, percent, block).where(F.col("first.k") == F.col("k")).select("k").distinct()
    ord_ = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(ord_, F.coalesce(F.col("text"), F.lit(""))).alias("k"))
    turn = F.row_number().over(Window.partitionBy("k").orderBy("k"))
    return rows.join(found, "k").withColumn("turn", turn).where("turn = 1").select("row.*")
