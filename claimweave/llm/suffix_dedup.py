"""Removal of byte strings that occur earlier, by longest-previous-factor arrays.

Every window of ``length`` bytes belongs to the smallest hash of its shorter substrings, which
depends on the window's bytes alone, so equal windows belong together wherever they stand.
Neighbouring windows with one such key form a segment. Segments whose key occurs once are done;
the others meet by key, and there a suffix order over the different segments of a key gives, for
every window, its longest previous factor: the longest match that starts earlier.

1. Segments of every document: key, document, start, number of windows. No text moves.
2. Keys that occur again ask their documents for the bytes of these segments.
3. Segments meet by key; the longest previous factors mark the windows that occur earlier.
4. The marked runs go back to their documents.

A key that occurs very often is split: its windows then meet one by one, by a hash of all their
bytes, so the work of a hot passage spreads over many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import NO_ID

LENGTH = 100
# Occurrences of a key from which its windows are dealt out one by one.
HOT = 8192
_SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xD6E8FEB86659FD93)
# Segments that are ordered together, in bytes.
_TOGETHER = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.full(n, _BASE, np.uint64)
        up[0] = 1
        down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def window_keys(data: np.ndarray, length: int, powers: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The key of each window of ``length`` bytes, the smallest hash of its substrings of a quarter of that length.

    Also whether the window starts with that substring and has it again. Where a window repeats
    within a segment at a distance that one window spans, some window between the two does.
    """
    short = max(1, length // 4)
    n = len(data)
    if n < length:
        return np.empty(0, np.int64), np.empty(0, bool)
    up, down = powers if powers is not None else _powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        hashes = (sums[short:] - sums[:-short]) * down[: n - short + 1]
        hashes ^= hashes >> np.uint64(32)
        hashes *= _MIX
        hashes ^= hashes >> np.uint64(29)
    width, reach = length - short + 1, 1
    wide = hashes
    while reach * 2 < width:
        wide = np.minimum(wide[:-reach], wide[reach:])
        reach *= 2
    n = len(hashes) - width + 1
    rest = np.minimum(wide[1 : n + 1], wide[width - reach : width - reach + n])  # all but a window's first substring
    least = np.minimum(hashes[:n], rest)
    return least.view(np.int64), (hashes[:n] == rest)


def segments(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Key, number of the text, start, number of windows of each segment, and whether it may hold a window twice."""
    found: list[tuple[np.ndarray, ...]] = []
    powers = _powers(2)

    def work(first: int, group: list[bytes]) -> None:
        nonlocal powers
        data = np.frombuffer(b"".join(group), np.uint8)
        if len(data) < length:
            return
        if len(powers[0]) < len(data) + 1:
            powers = _powers(len(data) + 1)
        keys, twice = window_keys(data, length, powers)
        sizes = np.array([len(t) for t in group])
        begins = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(group)), sizes)[: len(keys)]
        place = np.arange(len(keys)) - begins[owner]
        inside = place + length <= sizes[owner]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(new & inside)
        if not len(at):
            return
        # Windows of a segment follow each other; the last one inside a text ends its segment.
        ends = np.append(np.flatnonzero(new)[1:], len(keys))
        ends = ends[np.searchsorted(np.flatnonzero(new), at)]
        ends = np.minimum(ends, begins[owner[at]] + sizes[owner[at]] - length + 1)
        doubles = np.append(0, np.cumsum(twice))
        inner = (doubles[ends] > doubles[at]) | (ends - at > length - length // 4 + 1)
        found.append((keys[at], owner[at] + first, place[at], ends - at, inner.astype(np.int64)))

    group: list[bytes] = []
    size = first = 0
    for i, text in enumerate(texts):
        group.append(text)
        size += len(text)
        if size >= _SLICE:
            work(first, group)
            group, size, first = [], 0, i + 1
    work(first, group)
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def suffix_ranks(data: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """Ranks of all suffixes by their first 8, 16, 32, ... bytes, up to ``depth``; equal prefixes share a rank."""
    n = len(data)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = data
    packed = np.zeros(n, np.uint64)
    for k in range(8):
        packed = packed << np.uint64(8) | padded[k : n + k]
    # Bytes past the end count as 0, and so rank like a 0 byte; callers look only at windows inside the data.
    rank = np.unique(packed, return_inverse=True)[1].astype(np.int64) + 1
    levels = [(8, rank)]
    while levels[-1][0] * 2 <= depth:
        size, rank = levels[-1]
        second = np.zeros(n, np.int64)
        second[: max(0, n - size)] = rank[size:]
        rank = np.unique(rank * (n + 2) + second, return_inverse=True)[1].astype(np.int64) + 1
        levels.append((size * 2, rank))
    return levels


def _nearest_smaller(values: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value before each, or -1, by pointer jumping."""
    before = np.arange(len(values)) - 1
    active = np.flatnonzero(before >= 0)
    while len(active):
        active = active[values[before[active]] > values[active]]
        before[active] = before[before[active]]
        active = active[before[active] >= 0]
    return before


def longest_previous_factor(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each start, in ascending order, the longest match with an earlier start, up to ``length``.

    The previous and the next start in suffix order that stand earlier in the data are the only
    two that can hold the longest match. At least ``length`` bytes must follow every start.
    """
    levels = suffix_ranks(data, length)
    top, rank = levels[-1]
    order = np.lexsort((starts, rank[starts + length - top], rank[starts])) if length > top else np.lexsort((starts, rank[starts]))
    inorder = starts[order]
    previous = _nearest_smaller(inorder)
    following = len(inorder) - 1 - _nearest_smaller(inorder[::-1])[::-1]  # len(inorder) where there is none

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes a and b, up to ``length``."""
        size = np.zeros(len(a), np.int64)
        for step, r in reversed(levels):
            for _ in range(2 if step == top else 1):  # twice the deepest level reaches ``length``
                fits = size + step <= length
                same = fits & (r[np.where(fits, a + size, a)] == r[np.where(fits, b + size, b)])
                size += step * same
        for _ in range(7):
            fits = size < length
            size += fits & (data[np.where(fits, a + size, a)] == data[np.where(fits, b + size, b)])
        return size

    best = np.zeros(len(starts), np.int64)
    for other in (previous, following):
        some = np.flatnonzero((other >= 0) & (other < len(inorder)))
        best[order[some]] = np.maximum(best[order[some]], common(inorder[some], inorder[other[some]]))
    return best


def _marked(group_texts: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """Runs of bytes (text number, start, size) covered by windows that occur in an earlier text or earlier in their own."""
    data = np.frombuffer(b"".join(group_texts), np.uint8)
    sizes = np.array([len(t) for t in group_texts])
    begins = np.cumsum(sizes) - sizes
    windows = sizes - length + 1
    owner = np.repeat(np.arange(len(sizes)), windows)
    starts = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + begins[owner]
    hit = np.flatnonzero(longest_previous_factor(data, starts, length) >= length)
    if not len(hit):
        return []
    breaks = np.flatnonzero((np.diff(starts[hit]) > 1) | (np.diff(owner[hit]) > 0)) + 1
    first, last = hit[np.append(0, breaks)], hit[np.append(breaks, len(hit)) - 1]
    who = owner[first]
    return list(zip(who.tolist(), (starts[first] - begins[who]).tolist(), (starts[last] - starts[first] + length).tolist(), strict=True))


_SEGMENT = [("key", pa.int64()), ("ord", pa.int64()), ("k", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("bytes", pa.binary()), ("inner", pa.bool_())]


_PACKED = ("lows", "highs", "names", "starts", "windows")


def _ord() -> Column:
    return F.coalesce(F.col("doc_id"), F.lit(NO_ID))


def _rows(columns: list, schema: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, schema, strict=True)], [name for name, _ in schema])


def repeated_runs(texts: DataFrame, firsts: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """Runs of bytes that occur earlier: ``k``, ``start``, ``size``; they may overlap.

    ``texts`` has ``k`` and ``th`` (hashes that name the document and its text), ``doc_id`` and
    ``text``; ``firsts`` has the first document ``k`` of each text ``th``.
    Only these take part, so copies of a whole text are never compared.
    """
    buckets = 4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The segments of a batch, packed by bucket of their key: a few columns of plain numbers."""
        for batch in batches:
            names, at = np.unique(batch.column("th").to_numpy(), return_index=True)
            keys, owner, start, windows, inner = segments(batch.column("text").take(pa.array(at)).cast(pa.binary()).to_pylist(), length)
            bucket = (keys.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            # With the bucket, 40 bits of a key are enough: keys that meet by chance only meet in vain.
            low, high = keys.astype(np.uint32), (keys >> 32).astype(np.uint8)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out = []
            for b in range(buckets):
                own = order[cuts[b] : cuts[b + 1]]
                if len(own):
                    out.append((b, low[own].tobytes(), high[own].tobytes(), names[owner[own]].tobytes(), start[own].astype("<u4").tobytes(), (2 * windows[own] + inner[own]).astype("<u4").tobytes()))
            yield _rows([list(c) for c in zip(*out, strict=True)] or [[]] * 6, [("bucket", pa.int64()), *[(c, pa.binary()) for c in _PACKED]])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each bucket, the segments whose key occurs again, or that may repeat within themselves."""
        held: list[list[bytes]] = []
        current = None

        def settle() -> pa.RecordBatch:
            low, high, names, starts, windows = (np.frombuffer(b"".join(r[i] for r in held), kind).astype(np.int64) for i, kind in enumerate(("<u4", "u1", np.int64, "<u4", "<u4")))
            keys = current << 40 | high << 32 | low
            order = np.lexsort((starts, names, keys))
            keys, names, starts, windows = (c[order] for c in (keys, names, starts, windows))
            new = np.ones(len(keys), bool)  # a text that several batches have counts once
            new[1:] = (keys[1:] != keys[:-1]) | (names[1:] != names[:-1]) | (starts[1:] != starts[:-1])
            keys, names, starts, windows = (c[new] for c in (keys, names, starts, windows))
            _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
            times = counts[inverse]
            again = (times > 1) | (windows % 2 == 1)
            columns = [c[again] for c in (names, keys, starts, windows // 2, times >= hot, windows % 2 == 1)]
            return _rows(columns, [*[(c, pa.int64()) for c in ("th", "key", "start", "windows")], ("hot", pa.bool_()), ("inner", pa.bool_())])

        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                if row[0] != current:
                    if held:
                        yield settle()
                    held, current = [], row[0]
                held.append(row[1:])
        if held:
            yield settle()

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of the segments asked for. Of equal ones in a batch the earliest goes on, the others are marked at once."""
        last = None
        for batch in batches:
            first: dict[tuple[int, bytes], tuple[int, int, int]] = {}
            marked: list[tuple] = []
            for k, ord_, text, asked in zip(*[batch.column(c).to_pylist() for c in ("k", "ord", "text", "asked")], strict=True):
                if k == last:  # a row that repeats the one before
                    continue
                last = k
                data = text.encode("utf-8", "replace") if isinstance(text, str) else text
                for a in asked:
                    key, start, end = a["key"], a["start"], a["start"] + a["windows"] + length - 1
                    if a["hot"]:
                        pieces = [(data[p : p + length], p) for p in range(start, end - length + 1)]
                        pieces = [(int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little", signed=True), w, p) for w, p in pieces]
                    else:
                        pieces = [(key, data[start:end], start)]
                    for at, piece, p in pieces:
                        place = (ord_, k, p, a["inner"] and not a["hot"])
                        earlier = first.setdefault((at, piece), place)
                        if earlier != place:
                            if place < earlier:
                                first[at, piece], place = place, earlier
                            marked.append((*place[:3], len(piece)))
            rows = [(key, *place[:3], len(piece), piece, place[3]) for (key, piece), place in first.items()]
            # Marked runs need no meeting; they are spread by document.
            rows += [(k, ord_, k, p, size, None, False) for ord_, k, p, size in marked]
            yield _rows([list(c) for c in zip(*rows, strict=True)] or [[]] * 7, _SEGMENT)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of each key's segments that occur earlier. Rows come by key, then by place."""
        out: list[tuple[int, int, int]] = []
        pending: list[bytes] = []  # different segments of keys that have several, in order
        places: list[tuple[int, int]] = []
        seen: dict[bytes, tuple[int, int]] = {}  # the place of each; a row that repeats may bring it again from another task
        spots: list[tuple[int, int]] = []
        current, inside = None, False

        def close() -> None:
            if len(seen) > 1 or inside:
                pending.extend(seen)
                places.extend(spots)

        def settle() -> None:
            for i, start, size in _marked(pending, length) if pending else ():
                k, offset = places[i]
                out.append((k, offset + start, size))
            pending.clear()
            places.clear()

        held = 0
        for batch in batches:
            for key, k, start, size, piece, inner in zip(*[batch.column(c).to_pylist() for c in ("key", "k", "start", "size", "bytes", "inner")], strict=True):
                if piece is None:
                    out.append((k, start, size))
                    continue
                if key != current:
                    before = len(pending)
                    close()
                    held += sum(map(len, pending[before:]))
                    if held > _TOGETHER:
                        settle()
                        held = 0
                    seen, spots, current, inside = {}, [], key, False
                inside = inside or inner
                if piece in seen:
                    if seen[piece] != (k, start):
                        out.append((k, start, size))
                else:
                    seen[piece] = (k, start)
                    spots.append((k, start))
            if out:
                yield _rows([list(c) for c in zip(*out, strict=True)], [(c, pa.int64()) for c in ("k", "start", "size")])
                out.clear()
        close()
        settle()
        if out:
            yield _rows([list(c) for c in zip(*out, strict=True)], [(c, pa.int64()) for c in ("k", "start", "size")])

    packed = texts.select("th", "text").mapInArrow(deal, "bucket bigint, " + ", ".join(f"{c} binary" for c in _PACKED))
    again = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(ask, "th bigint, key bigint, start bigint, windows bigint, hot boolean, inner boolean")
    asked = again.groupBy("th").agg(F.collect_list(F.struct("key", "start", "windows", "hot", "inner")).alias("asked")).join(firsts, "th").select("k", "asked")
    pieces = texts.join(asked, "k").select("k", _ord().alias("ord"), "text", "asked").mapInArrow(fetch, "key bigint, ord bigint, k bigint, start bigint, size bigint, bytes binary, inner boolean")
    return pieces.repartition("key").sortWithinPartitions("key", "ord", "k", "start").mapInArrow(mark, "k bigint, start bigint, size bigint")


def dedup_bytes(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes``, the removed ``spans`` and the bytes ``kept``.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document
    with a smaller id, or earlier in the same one. Matches never cross documents and are judged on
    the input. Null ids come last; equal ids are ordered by a hash of their texts. Rows that
    repeat id and text are one document, and all fare alike. A null text counts as empty. Only
    ``doc_id`` and ``text`` are read; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # Both joins with the texts take the same columns, so Spark deals the texts by document once.
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).select(F.xxhash64("doc_id", "text").alias("k"), F.xxhash64("text").alias("th"), "doc_id", "text")
    firsts = texts.groupBy("th").agg(F.min(F.struct(_ord().alias("ord"), "k")).alias("first")).select("th", "first.k")
    runs = repeated_runs(texts.select("k", "th", "doc_id", "text"), firsts, length, hot).groupBy("k").agg(F.collect_list(F.struct("start", "size")).alias("runs"))
    known = firsts.select("k").join(runs, "k", "left").withColumn("runs", F.coalesce("runs", F.array().cast("array<struct<start: bigint, size: bigint>>")))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            for data, found in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("runs").to_pylist(), strict=True):
                merged: list[list[int]] = []
                if found is None:  # a later copy of a whole text
                    found = [{"start": 0, "size": len(data)}] if len(data) >= length else []
                for start, end in sorted((r["start"], r["start"] + r["size"]) for r in found):
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([start, end])
                edges = [0, *[x for m in merged for x in m], len(data)]
                sizes.append(len(data))
                spans.append([{"start": a, "size": b - a} for a, b in merged])
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            span = pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    schema = "doc_id bigint, n_bytes bigint, spans array<struct<start: bigint, size: bigint>>, kept binary"
    return texts.join(known, "k", "left").select("doc_id", "text", "runs").mapInArrow(apply, schema)
