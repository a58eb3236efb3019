"""Line, suffix, exact and near de-duplication against brute force."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from claimweave.llm import components, exact_dedup, jaccard_join, line_dedup, suffix_dedup
from tests.llm.messy import LONG, POEM, ROWS, empty, frame, words


# --- line chunks ---------------------------------------------------------------


def line_chunks(lines):
    """First and last line of each chunk by the definition, line by line."""
    hashes = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    chosen = [(h + 31337 * (hashes[i - 1] if i else 0)) % 2147483647 % 8 < 7 for i, h in enumerate(hashes)]
    ends = [i for i in range(len(lines)) if chosen[i] or i == len(lines) - 1 or chosen[i + 1]]
    return list(zip([0, *[e + 1 for e in ends[:-1]]], ends))


def brute_lines(rows):
    """Every later chunk grown beside its first occurrence, one line at a time."""
    docs = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0))
    first, gone, out = {}, set(), {r: None for r in rows}
    for key in docs:
        lines = key[1].split("\n")
        for a, b in line_chunks(lines):
            if not any(words(x) for x in lines[a : b + 1]):
                continue
            there, at = first.setdefault("\n".join(lines[a : b + 1]), (key, a))
            if (there, at) == (key, a):
                continue
            other, d = there[1].split("\n"), a - at
            while a > 0 and a - d > 0 and lines[a - 1] == other[a - 1 - d]:
                a -= 1
            while b + 1 < len(lines) and b + 1 - d < len(other) and lines[b + 1] == other[b + 1 - d]:
                b += 1
            worded = [i for i in range(a, b + 1) if words(lines[i])]
            if len(worded) > 1:
                gone.update((key, i) for i in range(worded[0], worded[-1] + 1))
    for key in docs:
        out[key] = "\n".join(x for i, x in enumerate(key[1].split("\n")) if (key, i) not in gone)
    return out


def passages(seed, n=60):
    rng = random.Random(seed)
    lines = [" ".join(rng.choice("alpha beta gamma delta eps".split()) for _ in range(6)) + f" {i}" for i in range(40)]
    shared = ["\n".join(rng.sample(lines, 8)) for _ in range(5)]
    rows = []
    for i in range(n):
        own = [f"own line {i} {j} of this document" for j in range(rng.randint(0, 6))]
        rows.append((i, "\n".join([*own[:2], rng.choice(shared), *own[2:], rng.choice(shared)])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_match_brute_force(spark, seed):
    rows = [*passages(seed), *[(100 + i if r[0] is not None else None, r[1]) for i, r in enumerate(ROWS)]]
    got = line_dedup.dedup_lines(frame(spark, [(a, b, None, None) for a, b in rows])).select("row.doc_id", "row.text", "kept_text", "n_removed", "n_lines").collect()
    want = brute_lines(rows)
    assert len(got) == len(rows)
    assert sum(r.n_removed for r in got) > 50
    for r in got:
        assert r.kept_text == want[r.doc_id, r.text]
        assert r.n_lines == (0 if r.text is None else r.text.count("\n") + 1)


def test_lines_shift(spark):
    """A passage is found wherever it stands, from its first line on."""
    body = "\n".join(f"line number {i} of a long passage" for i in range(40))
    rows = [(1, body), (2, "new head\n" + body), (3, "one\ntwo\nthree\n" + body + "\ntail")]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, [(a, b, None, None) for a, b in rows])).select("row.doc_id", "n_removed", "kept_text").collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 40 and got[3].n_removed == 40
    assert got[2].kept_text == "new head" and got[3].kept_text == "one\ntwo\nthree\ntail"


def test_lines_compare_bytes(spark):
    """With narrow hashes many chunks and lines meet that differ; some repeats still go, and never anything else."""
    rows = passages(3)
    docs = frame(spark, [(a, b, None, None) for a, b in rows], clash=False)
    want = brute_passages(rows)
    for bits in (12, 6):
        left = {(r.doc_id, r.text): r.kept_text for r in line_dedup.dedup_lines(docs, hash_bits=bits).select("row.doc_id", "row.text", "kept_text").collect()}
        for key, kept in left.items():
            # What goes is among the lines that repeated runs take, and nothing is reordered.
            assert not collections.Counter(want[key].split("\n")) - collections.Counter(kept.split("\n")) - collections.Counter([""])
        assert bits < 12 or sum(kept != key[1] for key, kept in left.items()) > 5


def test_lines_find_nine_tenths(spark):
    """Of the words in repeated runs of two lines or more, by pairs of places and without any chunk, nine tenths go; exact copies leave nothing."""
    rng = random.Random(7)
    lines = [" ".join(f"word{rng.randint(0, 99)}" for _ in range(20)) + f" {i}" for i in range(60)]
    shared = [rng.choices(lines, k=rng.randint(2, 5)) for _ in range(14)]
    rows = [(i, "\n".join([f"head {i}", *rng.choice(shared), f"own {i} and more", *rng.choice(shared)])) for i in range(70)]
    rows += [(100 + i, rows[i][1]) for i in range(10)]
    want = brute_passages(rows)
    got = {(r.doc_id, r.text): r.kept_text for r in line_dedup.dedup_lines(frame(spark, [(a, b, None, None) for a, b in rows])).select("row.doc_id", "row.text", "kept_text").collect()}
    size = lambda t: len(t.split())
    repeated = sum(size(key[1]) - size(kept) for key, kept in want.items())
    assert sum(size(key[1]) - size(kept) for key, kept in got.items()) >= 0.9 * repeated > 5000
    assert all(not got[key] for key in rows[70:])


def brute_passages(rows):
    """Repeated runs of lines with words, grown from every pair of places to both sides; no chunks, no windows."""
    places = [(key, i, line) for key in sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0)) for i, line in enumerate(key[1].split("\n"))]
    gone = set()
    for a, b in itertools.combinations(range(len(places)), 2):
        fits = lambda n: b + n < len(places) and places[a + n][0] == places[a][0] and places[b + n][0] == places[b][0] and places[a + n][2] == places[b + n][2]
        if not fits(0) or (a and places[a - 1][0] == places[a][0] and places[b - 1][0] == places[b][0] and places[a - 1][2] == places[b - 1][2]):
            continue
        run = next(n for n in itertools.count() if not fits(n))
        worded = [b + n for n in range(run) if words(places[b + n][2])]
        if len(worded) > 1:
            gone.update(range(worded[0], worded[-1] + 1))
    out = {r: None if r[1] is None else [] for r in rows}
    for at, (key, _, line) in enumerate(places):
        if at not in gone:
            out[key].append(line)
    return {r: None if kept is None else "\n".join(kept) for r, kept in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_match_brute_force(spark, seed):
    """Runs of two to five long lines between lines of their own, with blank ones; none of usual length is missed."""
    rng = random.Random(seed)
    lines = [" ".join(f"word{rng.randint(0, 99)}" for _ in range(30)) + f" {i}" for i in range(30)] + ["", " \t"]
    shared = [rng.choices(lines, k=rng.randint(2, 5)) for _ in range(6)]
    rows = [(i, "\n".join([f"head {i}"] * rng.randint(0, 2) + rng.choice(shared) + [""] * rng.randint(0, 1) + [f"own {i}"] * rng.randint(0, 1) + rng.choice(shared))) for i in range(40)]
    rows += [(50, "a a\na a\na a\na a"), (51, "a a\n\na a"), *[(100 + i if r[0] is not None else None, r[1]) for i, r in enumerate(ROWS)]]
    got = line_dedup.dedup_lines(frame(spark, [(a, b, None, None) for a, b in rows]), passages=True).select("row.doc_id", "row.text", "kept_text", "n_removed", "n_lines").collect()
    want = brute_passages(rows)
    assert len(got) == len(rows)
    assert sum(r.n_removed for r in got) > 150
    for r in got:
        assert r.kept_text == want[r.doc_id, r.text]
        assert r.n_removed == r.n_lines - (r.kept_text.count("\n") + 1 if r.kept_text else 0) or not r.kept_text


def test_lines_empty(spark):
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


# --- longest previous factors --------------------------------------------------


def brute_bytes(rows, length):
    seen, out = {}, {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            if seen.setdefault(data[p : p + length], (doc_id, text, p)) != (doc_id, text, p):
                gone[p : p + length] = True
        out[doc_id, text] = bytes(b for b, g in zip(data, gone) if not g), int((gone & ~np.append(False, gone[:-1])).sum()) if len(gone) else 0
    return out


@pytest.mark.parametrize("hot", [8192, 3])
def test_bytes_match_brute_force(spark, hot):
    rng = random.Random(5)
    shared = ["".join(rng.choice("abcd ") for _ in range(180)) for _ in range(4)]
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 120))) + rng.choice(shared) + "x" * rng.choice([0, 3, 150]) + rng.choice(shared)[: rng.randint(0, 180)]) for i in range(50)]
    rows += [(100 + i if r[0] is not None else None, r[1][:3000] if r[1] else r[1]) for i, r in enumerate(ROWS)]
    got = suffix_dedup.dedup_bytes(frame(spark, [(a, b, None, None) for a, b in rows]), hot=hot)
    found = sorted((str(r.doc_id), r.n_bytes, bytes(r.kept), len(r.spans)) for r in got.collect())
    want = brute_bytes(rows, 100)
    assert found == sorted((str(a), len((b or "").encode()), *want[a, b]) for a, b in rows)


@pytest.mark.parametrize("hot", [8192, 3])
def test_bytes_repeated_rows_apart(spark, tmp_path, hot):
    """Rows that repeat the first occurrence, each in a task of its own, are not their own earlier copies."""
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = [(1, "one " + passage), (2, "two " + passage + " end"), (1, "one " + passage), (3, passage[50:250]), (1, "one " + passage), (2, "two " + passage + " end")]
    for i, row in enumerate(rows):
        frame(spark, [(*row, None, None)], clash=False).coalesce(1).write.parquet(f"{tmp_path}/{i}")
    apart = {"spark.sql.files.maxPartitionBytes": "1k", "spark.sql.files.openCostInBytes": "1k", "spark.sql.autoBroadcastJoinThreshold": "1g"}
    before = {key: spark.conf.get(key, None) for key in apart}
    try:
        for key, value in apart.items():
            spark.conf.set(key, value)
        docs = spark.read.parquet(*[f"{tmp_path}/{i}" for i in range(len(rows))])
        assert docs.rdd.getNumPartitions() >= len(rows)
        got = suffix_dedup.dedup_bytes(docs, hot=hot).collect()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    want = brute_bytes(rows, 100)
    assert sorted((r.doc_id, bytes(r.kept)) for r in got) == sorted((a, want[a, b][0]) for a, b in rows)


def test_longest_previous_factor():
    rng = random.Random(7)
    for _ in range(20):
        n, length = rng.randint(40, 250), rng.choice([8, 9, 12, 17, 20])
        data = bytes(rng.choice(b"ab\0") for _ in range(n))
        starts = np.sort(np.array(rng.sample(range(n - length + 1), rng.randint(1, n - length + 1))))
        got = suffix_dedup.longest_previous_factor(np.frombuffer(data, np.uint8), starts, length)
        for i, s in enumerate(starts):
            matches = [next((m for m in range(length) if data[s + m] != data[q + m]), length) for q in starts[:i]]
            assert got[i] == max(matches, default=0)


def test_bytes_empty(spark):
    assert suffix_dedup.dedup_bytes(empty(spark)).count() == 0


# --- extendible hashing --------------------------------------------------------


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_matches_brute_force(spark, bits):
    """With two bits of hash, chains decide everything."""
    rows = [*ROWS, *[(100 + i, " ".join("xy"[: i % 3]) + " " * (i % 4), None, None) for i in range(30)]]
    got = exact_dedup.dedup(frame(spark, rows), bits=bits, capacity=10).collect()
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    assert len(got) == len(rows)
    for r in got:
        group = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(group) and r.keep_id == min(group)[3]
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in got) == len(groups)


def test_directory_splits_only_what_is_overfull():
    found = exact_dedup.directory({0: 6, 1: 6, 5: 1, 7: 1}, capacity=10, max_depth=3)
    assert found.depth == 3
    # 000 and 001 part; 01x and 1xx stay whole.
    assert found.buckets.tolist() == [0, 1, 2, 2, 3, 3, 3, 3]
    assert exact_dedup.directory({}, 10, 3).depth == 0
    assert exact_dedup.directory({4: 99}, 10, 3).depth == 3  # one key cannot be split: it stays, overfull


def test_exact_empty(spark):
    assert exact_dedup.dedup(empty(spark)).count() == 0


# --- Jaccard join --------------------------------------------------------------


def shingles(text, width):
    found = words((text or "").encode().lower().decode())
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + width]) for i in range(max(1, len(found) - width + 1)))


def brute_components(rows, width, percent):
    sets = [(r[0], shingles(r[1], width)) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, (_, a)), (j, (_, b)) in itertools.combinations(enumerate(sets), 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), 2**63), 2**63 - 1 if doc_id is None else doc_id)
    return [(doc_id, len(s), None if least[find(i)] == 2**63 - 1 else least[find(i)]) for i, (doc_id, s) in enumerate(sets)]


def variants(seed, n=120):
    rng = random.Random(seed)
    bases = [[f"w{rng.randint(0, 300)}" for _ in range(60)] for _ in range(8)]
    rows = []
    for i in range(n):
        text = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            text[rng.randrange(len(text))] = f"W{rng.randint(0, 9)}"
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize(("width", "percent", "block"), [(4, 85, 512), (5, 80, 4), (1, 50, 3)])
def test_jaccard_matches_brute_force(spark, width, percent, block):
    rows = [*variants(width), *[(1000 + r[0] if r[0] is not None else None, r[1]) for r in ROWS]]
    got = jaccard_join.near_duplicates(frame(spark, [(a, b, None, None) for a, b in rows]), width, percent, block).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_components(rows, width, percent)))


def test_keep_one(spark):
    rows = [(3, POEM, "en", "x"), (1, POEM + " now", "en", "y"), (2, LONG, "en", "x"), (2, LONG, "en", "x"), (5, None, "en", "x"), (6, "", "en", "x")]
    left = jaccard_join.keep_one(frame(spark, rows))
    assert left.columns == frame(spark, rows).columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 5, 6]


def test_jaccard_empty(spark):
    assert jaccard_join.near_duplicates(empty(spark)).count() == 0


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
