"""Packing token sequences into windows by multiway differencing (Karmarkar-Karp).

A task packs what it reads, so nothing is shuffled: whole windows are cut off long documents,
the rests gather until they fill a block of windows, and each block is partitioned into
near-equal windows. Reading is deterministic, so a task that is run again gives the same pieces.
"""

from __future__ import annotations

import heapq
import os
import re
import sys
import types
import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 4096
END_ID = 2
BLOCK_WINDOWS = 192
COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
SCHEMA = ", ".join(f"{name} bigint" for name in COLUMNS)


class Encoder:
    """Ids of a text. Words are encoded once and remembered, since no token of these
    vocabularies spans white space; texts come many at a time, so that a word of several is
    looked up once for all."""

    # Bytes of text at a time; a longer text comes alone.
    SLICE = 4 << 20
    # Two generations of so many words: what was not met again while one filled is forgotten.
    REMEMBERED = 400_000
    LONGEST = 64
    # Letters that are a token run of their own, also in normal form: those of ASCII and Latin-1.
    LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
    # Marks after such letters are another run, and letters are lower-cased, so "The," is "the" and ",".
    MARKS = b".,;:!?*#$%&"
    # Runs of letters that the tokenizer gets as one text.
    JOINED = 64

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True  # their names in a text are ordinary text
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        suffix = getattr(self._tokenizer.model, "end_of_word_suffix", None)
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self._known: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}

    @classmethod
    def of_worker(cls, path: str) -> Encoder:
        """The encoder of this Python worker: tasks that follow each other share what it remembers."""
        store = sys.modules.setdefault("_packing_encoders", types.ModuleType("_packing_encoders")).__dict__
        if path not in store:
            store[path] = cls(path)
        return store[path]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_runs(self, runs: list[bytes]) -> list[bytes]:
        """The ids of runs of letters. They share texts: the last id of each run, and no other, ends a word."""
        found: list[bytes] = []
        groups = [runs[i : i + self.JOINED] for i in range(0, len(runs), self.JOINED)]
        for group, ids in zip(groups, self._ids([b" ".join(g).decode("utf-8") for g in groups]), strict=True):
            stops = (4 * (np.flatnonzero(self._ends[ids]) + 1)).tolist()
            if len(stops) == len(group):
                data = ids.tobytes()
                found += [data[i:j] for i, j in zip([0, *stops], stops)]
            else:  # this vocabulary does not mark the ends
                found += [x.tobytes() for x in self._ids([run.decode("utf-8") for run in group])]
        return found

    def _of_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of these distinct words."""
        if len(self._known) > self.REMEMBERED:
            self._older, self._known = self._known, {}
        known, older = self._known, self._older
        known[b""] = b""
        found = list(map(known.get, words))
        # Words not met before, as a run of lower-case letters and marks, or as a whole.
        places, cores, tails, wholes = [], [], [], []
        for i in [i for i, ids in enumerate(found) if ids is None]:
            word = words[i]
            if (ids := older.get(word)) is not None:
                known[word] = found[i] = ids
                continue
            core = word if word.isalpha() else word.rstrip(self.MARKS)
            if core.isalpha():
                core = core.lower()
            elif self.LETTERS.fullmatch(core):
                core = core.decode("utf-8").lower().encode("utf-8")
            else:
                wholes.append(i)
                continue
            places.append(i)
            cores.append(core)
            tails.append(word[len(core) :])
        once: dict[bytes, bytes] = {}

        def learn(atoms: list[bytes], encode: Callable[[list[bytes]], list[bytes]]) -> None:
            for atom in atoms:
                if atom in older:
                    known[atom] = older[atom]
            atoms = [a for a in atoms if a not in known]
            for atom, ids in zip(atoms, encode(atoms), strict=True):
                (known if len(atom) <= self.LONGEST else once)[atom] = ids

        learn(list(dict.fromkeys(cores)), self._of_runs)
        learn(list({*tails, *[words[i] for i in wholes]}), lambda atoms: [ids.tobytes() for ids in self._ids([a.decode("utf-8", "replace") for a in atoms])])
        for i in wholes:
            found[i] = known[words[i]] if words[i] in known else once[words[i]]
        for i, core, tail in zip(places, cores, tails, strict=True):
            ids = known[core] if core in known else once[core]
            found[i] = ids = ids + (known[tail] if tail in known else once[tail]) if tail else ids
            if len(words[i]) <= self.LONGEST:
                known[words[i]] = ids
        return found

    def encode(self, texts: pa.Array | Sequence[str]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers; a null is an empty text."""
        if not isinstance(texts, pa.Array):
            texts = pa.array([(t or "").encode("utf-8", "replace") for t in texts], pa.binary()).view(pa.string())
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
        begin = 0
        while begin < len(texts):
            stop = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + self.SLICE, "right"))
            stop = max(stop, begin + 1)
            split = pc.ascii_split_whitespace(texts.slice(begin, stop - begin))
            words = split.flatten().dictionary_encode()
            known = self._of_words(words.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist())
            ids = pa.array(known, pa.large_binary()).take(words.indices)
            _, offsets, data = ids.buffers()
            places = np.frombuffer(offsets, np.int64, len(ids) + 1) if len(ids) else np.zeros(1, np.int64)
            cuts = places[np.cumsum([0, *pc.list_value_length(split).to_pylist()])].tolist()
            view = memoryview(data or b"")
            for i, j in zip(cuts, cuts[1:]):
                yield bytes(view[i:j])
            begin = stop


def differencing(sizes: Sequence[int], k: int) -> np.ndarray:
    """The part, 0 to k - 1, of each item, by multiway differencing.

    Every item starts as a partial partition with one part filled. The two partitions with the
    largest spread are merged, the fullest parts of one with the emptiest of the other, until
    one is left; then the merges are followed backwards.
    """
    n = len(sizes)
    sums: list[np.ndarray | None] = []
    for size in sizes:
        one = np.zeros(k, np.int64)
        one[0] = size
        sums.append(one)
    heap = [(-int(size) if k > 1 else 0, i) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = sums[a] + sums[b][::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        sums[a] = sums[b] = None
        merges.append((a, b, order))
        heapq.heappush(heap, (int(both[-1] - both[0]), len(sums)))
        sums.append(both)
    places: dict[int, np.ndarray] = {len(sums) - 1: np.arange(k)}
    part = np.zeros(n, np.int64)
    for node in range(len(sums) - 1, n - 1, -1):
        a, b, order = merges[node - n]
        before = np.empty(k, np.int64)
        before[order] = places.pop(node)
        places[a], places[b] = before, before[::-1]
    for i in range(n):
        part[i] = places[i][0]
    return part


class Piece(NamedTuple):
    doc_id: int | None
    start: int
    ids: bytes
    doc_tokens: int

    @property
    def length(self) -> int:
        return len(self.ids) // 4


def pack_block(pieces: Sequence[Piece], window: int = WINDOW) -> list[list[Piece]]:
    """The pieces in near-equal windows: as few as hold all tokens, and one more whenever one would overflow."""
    sizes = [p.length for p in pieces]
    k = max(1, -(-sum(sizes) // window))
    while True:
        part = differencing(sizes, k)
        if np.bincount(part, weights=sizes, minlength=k).max() <= window:
            break
        k += 1
    windows: list[list[Piece]] = [[] for _ in range(k)]
    for piece, i in zip(pieces, part, strict=True):
        windows[i].append(piece)
    return [w for w in windows if w]


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per piece: document, ids before it, length, checksum, the document's tokens, sequence and offset there.

    Only the columns ``doc_id`` and ``text`` are read. Every document ends with ``end_id``; a null
    or empty text is that id alone. A document of more than ``window`` ids is cut into whole
    windows and a rest; rests of about ``block_windows`` windows are packed at a time. A sequence
    belongs to one input partition, whose number is the upper half of its id. Rows that repeat are
    packed as often as they come. An empty table gives no rows.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of_worker(tokenizer)
        next_id = TaskContext.get().partitionId() << 32
        rests: list[Piece] = []
        gathered = 0

        def rows(windows: Sequence[Sequence[Piece]]) -> pa.RecordBatch:
            nonlocal next_id
            out = []
            for pieces in windows:
                offset = 0
                for p in pieces:
                    out.append((p.doc_id, p.start, p.length, zlib.crc32(p.ids), p.doc_tokens, next_id, offset))
                    offset += p.length
                next_id += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], COLUMNS)

        for batch in batches:
            full: list[list[Piece]] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text")), strict=True):
                ids += end
                total = len(ids) // 4
                whole = total // window
                full += [[Piece(doc_id, i * window, ids[4 * i * window : 4 * (i + 1) * window], total)] for i in range(whole)]
                if rest := ids[4 * whole * window :]:
                    rests.append(Piece(doc_id, whole * window, rest, total))
                    gathered += len(rest) // 4
                if gathered >= block_windows * window:
                    full += pack_block(rests, window)
                    rests, gathered = [], 0
                if len(full) >= 4 * block_windows:
                    yield rows(full)
                    full = []
            if full:
                yield rows(full)
        if rests:
            yield rows(pack_block(rests, window))

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
