"""Periodic runs against brute force: Lyndon prefixes by rotation, runs by every period."""

import hashlib
import random
import zlib

import pytest

from claimweave.llm import periodic_runs
from claimweave.llm.queries import QUERIES
from tests.llm.messy import LONG, ROWS, empty, frame, words


def brute_runs(w, least):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((i, n, q) for (i, n), q in found.items()), key=lambda r: (r[0], r[2]))


def is_lyndon(w):
    return all(w < w[k:] + w[:k] for k in range(1, len(w)))


def test_lyndon_arrays():
    rng = random.Random(3)
    for _ in range(200):
        parts = [[rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 12))] for _ in range(rng.randint(1, 3))]
        symbols = [0]
        for part in parts:
            symbols += [*part, 0]
        got = periodic_runs.lyndon_lengths(symbols)
        for i, s in enumerate(symbols):
            end = symbols.index(0, i)
            assert got[i] == max((n for n in range(1, end - i + 1) if is_lyndon(symbols[i : i + n])), default=0)


def periodic_words(rng):
    w = []
    while len(w) < rng.randint(0, 80):
        part = [f"w{rng.randint(1, rng.choice([1, 2, 3, 50]))}".encode() for _ in range(rng.randint(1, 9))]
        w += part * rng.choice([1, 2, 3, 9]) + part[: rng.randint(0, len(part))]
    return w


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_match_brute_force(least):
    rng = random.Random(least)
    for _ in range(150):
        texts = [periodic_words(rng) for _ in range(rng.randint(1, 6))]
        for w, found in zip(texts, periodic_runs.word_runs(texts, least)):
            assert [tuple(r) for r in found.tolist()] == brute_runs(w, least)


def test_long_runs():
    assert periodic_runs.word_runs([[b"a"] * 50_000])[0].tolist() == [[0, 50_000, 1]]
    w = [b"%d" % (i % 777) for i in range(30_000)]
    assert periodic_runs.word_runs([w, w[:700]])[0].tolist() == [[0, 30_000, 777]]


def test_awkward_rows(spark):
    rows = [*ROWS, (20, "x y " * 3 + "z " * 12 + "x y z\t" * 5, None, None)]
    got = periodic_runs.find_runs(frame(spark, rows)).select("row.doc_id", "row.text", "n_words", "runs", "collapsed").collect()
    assert len(got) == len(rows)
    for r in got:
        w = words(r.text)
        runs = brute_runs(w, 12) if len(w) < 2000 else []
        assert r.n_words == len(w) and [(x.start, x.length, x.period) for x in r.runs] == runs
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert r.collapsed.encode() == b" ".join(x for i, x in enumerate(w) if i not in gone)
    assert sum(len(r.runs) for r in got) == 3 and max(len(r.text or "") for r in got) > len(LONG)
    assert periodic_runs.find_runs(empty(spark)).count() == 0


def test_query_matches_brute_force(spark, sf_dir):
    """The repeated ends that the query plants are those of its definition, and its digests follow from the runs."""
    got = QUERIES["op13_periodic_runs"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        w, h = words(texts[r.doc_id]), zlib.crc32(str(r.doc_id).encode())
        n, g = len(w), h // 10
        if n > 3000:
            continue
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w, 12)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()
