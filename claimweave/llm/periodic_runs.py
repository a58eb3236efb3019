"""Runs (maximal periodic stretches) of words, found through Lyndon roots.

A suffix sorter's first phase groups suffixes by their longest Lyndon prefix: it starts from groups
by first word and, from the highest group down, appends each group's context to the nearest
smaller suffix before each member. The lengths of the contexts are the Lyndon array. One pass per
order of the words (one the reverse of the other) gives every candidate root, and each root is
extended to both sides by longest common extensions. Where two copies of it fit, it is a run.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from claimweave.llm.common import map_texts

MIN_WORDS = 12
MIN_COPIES = 2
# Texts are worked on together up to so many words.
TOGETHER = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def lyndon_lengths(symbols: Sequence[int]) -> list[int]:
    """The length of the longest Lyndon prefix at every position; symbols are positive, 0 is a border that no prefix crosses.

    The first entry must be a border. Groups are a linked list in ascending order; a member that
    moved on stays in its old list and is passed over there. Every position is moved at most once
    per position that points to it, and jumps over decided positions are never repeated, so the work is linear.
    """
    n = len(symbols)
    first: dict[int, list[int]] = {}
    for i, s in enumerate(symbols):
        if s:
            first.setdefault(s, []).append(i)
    # Group 0 stands below all others and holds nothing.
    ordered = sorted(first)
    group_of = [0] * n
    members, context, below, above = [[]], [0], [-1], [0]
    for s in ordered:
        g = len(members)
        above[-1] = g
        members.append(first[s])
        context.append(1)
        below.append(g - 1)
        above.append(0)
        for i in first[s]:
            group_of[i] = g
    lengths = [0] * n
    before = [0] * n
    decided = bytearray(n)
    g = len(members) - 1
    while g > 0:
        size = context[g]
        pointed: dict[int, int] = {}
        for i in members[g]:
            if group_of[i] != g:
                continue
            p = i - 1
            while decided[p]:
                p = before[p]
            before[i] = p
            decided[i] = 1
            lengths[i] = size
            if symbols[p]:
                pointed[p] = pointed.get(p, 0) + 1
        if pointed:
            moved: dict[tuple[int, int], list[int]] = {}
            for p, times in pointed.items():
                moved.setdefault((-times, group_of[p]), []).append(p)
            # More copies sort higher: they are placed first, and fewer copies then right above the old group.
            for (times, old), places in sorted(moved.items()) if len(moved) > 1 else moved.items():
                new = len(members)
                members.append(places)
                context.append(context[old] - times * size)
                over = above[old]
                below.append(old)
                above.append(over)
                above[old] = new
                if over:
                    below[over] = new
                for p in places:
                    group_of[p] = new
        g = below[g]
    return lengths


class Extensions:
    """Longest common extensions to the right, by ranks of blocks of 1, 2, 4, ... symbols: (length x logarithm) integers of 4 bytes."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.ranks = [symbols.astype(np.int32)]
        width = 1
        while width < len(symbols):
            last = self.ranks[-1].astype(np.int64)
            if len(np.unique(last)) == len(last):
                break
            pairs = last[:-width] * (int(last.max()) + 1) + last[width:]
            ranked = np.unique(pairs, return_inverse=True)[1].astype(np.int32)
            self.ranks.append(ranked)
            width *= 2
            if width >= len(ranked):
                break

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from ``a`` on equal those from ``b`` on."""
        a, b = a.copy(), b.copy()
        begin = b.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            ranks, width = self.ranks[k], 1 << k
            # The widest blocks may match more than once, narrower ones at most once after them.
            active = np.flatnonzero((a < len(ranks)) & (b < len(ranks)))
            while len(active):
                active = active[ranks[a[active]] == ranks[b[active]]]
                a[active] += width
                b[active] += width
                if k < len(self.ranks) - 1:
                    break
                active = active[(a[active] < len(ranks)) & (b[active] < len(ranks))]
        return b - begin


def runs_of(symbols: np.ndarray, min_words: int = MIN_WORDS) -> np.ndarray:
    """The runs of a sequence of positive symbols cut by borders (0, first and last), as rows of start, length and period.

    A run has at least ``min_words`` symbols and two periods; rows are ordered by start, then period.
    """
    top = int(symbols.max(initial=0)) + 1
    own = symbols.astype(np.int64)
    borders = np.flatnonzero(own == 0)
    own[borders] = top + np.arange(len(borders))  # no border equals another, so no extension crosses one
    right, left = Extensions(own), Extensions(own[::-1])
    found = []
    places = np.flatnonzero(symbols)
    for order in (symbols, np.where(symbols > 0, top - symbols, 0)):
        period = np.array(lyndon_lengths(order.tolist()), np.int64)[places]
        end = places + period + right.right(places, places + period)
        last = len(symbols) - 1
        start = places - left.right(last - (places - 1), last - (places + period - 1))
        enough = end - start >= np.maximum(min_words, MIN_COPIES * period)
        found.append(np.stack([start, end - start, period], axis=1)[enough])
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def repeated_stretches(ids: np.ndarray, owner: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Stretches of words all of which lie in windows of ``width`` words that occur again in their own text.

    A run of ``2 * width`` words or more and two periods lies inside one of them with all its words, so
    nothing outside has to be grouped. Windows are compared by hashes: one too many only costs time.
    """
    n = len(ids)
    if n <= width:
        return []
    codes = owner[: n - width + 1].astype(np.uint64) + np.uint64(1)
    for k in range(width):
        codes = codes * _MIX + ids[k : n - width + 1 + k].astype(np.uint64)
        codes ^= codes >> np.uint64(29)
    whole = owner[: n - width + 1] == owner[width - 1 :]
    _, inverse, counts = np.unique(codes, return_inverse=True, return_counts=True)
    again = whole & (counts[inverse] > 1)
    edge = np.zeros(n + 1, np.int64)
    edge[: n - width + 1] += again
    edge[width:] -= again
    covered = np.cumsum(edge[:n]) > 0
    begins = np.flatnonzero(covered & np.concatenate(([True], ~covered[:-1] | (owner[1:] != owner[:-1]))))
    ends = np.flatnonzero(covered & np.concatenate((~covered[1:] | (owner[1:] != owner[:-1]), [True]))) + 1
    return [(a, b) for a, b in zip(begins.tolist(), ends.tolist(), strict=True) if b - a >= 2 * width]


def word_runs(texts: Sequence[Sequence[bytes]], min_words: int = MIN_WORDS) -> list[np.ndarray]:
    """The runs of each list of words, as rows of start, length and period."""
    none = np.empty((0, 3), np.int64)
    out = [none] * len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(word, len(numbers) + 1) for words in texts for word in words), np.int64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(texts)), sizes)
    stretches = repeated_stretches(ids, owner, max(1, min_words // 2))
    if not stretches:
        return out
    parts, places = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    for a, b in stretches:
        parts += [ids[a:b], parts[0]]
        places += [np.arange(a, b), places[0]]
    symbols, place = np.concatenate(parts), np.concatenate(places)
    symbols[symbols > 0] = np.unique(symbols[symbols > 0], return_inverse=True)[1] + 1
    runs = runs_of(symbols, min_words)
    if not len(runs):
        return out
    starts = place[runs[:, 0]]
    owners = owner[starts]
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    local = np.stack([starts - begins[owners], runs[:, 1], runs[:, 2]], axis=1)
    # Rows are in the order of their places, so those of one text are neighbours.
    firsts = np.flatnonzero(np.concatenate(([True], owners[1:] != owners[:-1])))
    for text, rows in zip(owners[firsts].tolist(), np.split(local, firsts[1:]), strict=True):
        out[text] = rows
    return out


def collapse(words: Sequence[bytes], runs: np.ndarray) -> bytes:
    """The words joined by blanks, of every run only the first period."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def find_runs(docs: DataFrame, keep: Sequence[str] | None = None, min_words: int = MIN_WORDS) -> DataFrame:
    """Every document with ``n_words``, ``runs`` and ``collapsed``.

    ``runs`` lists start (word number), length and period of every run of ``min_words`` words and
    two periods or more, by start, then period; ``collapsed`` is the text's words joined by blanks,
    of each run only the first period. Words are runs of anything but the six ASCII blanks. A null
    or empty text has no words, no runs and an empty ``collapsed``. Texts are taken whole, however
    long; a text of n words in runs needs n log n integers. The document's columns (those in
    ``keep``) stay inside ``row``, so they cannot clash. Rows that repeat get equal results; an
    empty table gives no rows. Nothing is shuffled.
    """

    def search(texts: list[str | None]) -> list[list]:
        counts, runs, collapsed = [], [], []
        pending: list[list[bytes]] = []
        size = 0

        def settle() -> None:
            for words, found in zip(pending, word_runs(pending, min_words), strict=True):
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found.tolist()])
                collapsed.append(collapse(words, found).decode("utf-8"))
            pending.clear()

        for text in texts:
            pending.append((text or "").encode("utf-8", "replace").split())  # bytes split at the six ASCII blanks only
            size += len(pending[-1])
            if size >= TOGETHER:
                settle()
                size = 0
        settle()
        return [counts, runs, collapsed]

    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    return map_texts(docs, search, {"n_words": pa.int64(), "runs": pa.list_(run), "collapsed": pa.string()}, keep)
