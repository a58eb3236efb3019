"""Importance resampling against a brute-force version."""

import hashlib
import math
import re
import zlib

import numpy as np

from claimweave.llm import importance
from tests.llm.messy import LONG, POEM, ROWS, empty, frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, most):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def brute(rows, targets, most, buckets, min_words, percent):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    raw, wanted = np.zeros(buckets, int), np.zeros(buckets, int)
    for counts, texts in ((raw, [r[1] for r in rows]), (wanted, targets)):
        for text in texts:
            for g in grams(text, most)[1]:
                counts[bucket(g)] += 1
    s_all, t_all = int(raw.sum()), int(wanted.sum())
    gain = [math.floor(1000 * math.log((int(t) + 1) * (s_all + buckets) / ((int(s) + 1) * (t_all + buckets)))) for s, t in zip(raw, wanted)]
    scored = []
    for doc_id, text, *_ in rows:
        words, found = grams(text, most)
        weight = math.floor(sum(gain[bucket(g)] for g in found) / len(found)) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        scored.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    able = sorted((r for r in scored if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[: len(able) * percent // 100]
    return sorted(map(str, [(*r[:4], n) for n, r in enumerate(drawn, 1)] + [(*r[:4], None) for r in [*able[len(drawn) :], *(r for r in scored if r[4] < min_words)]]))


def mine(found):
    return sorted(str((r.doc_id, r.n_features, r.weight, r.score, r.rank)) for r in found.select("row.doc_id", "n_features", "weight", "score", "rank").collect())


def test_matches_brute_force(spark):
    """Awkward rows, repeated ids, ties and clashing columns; one word, and up to three."""
    rows = [*ROWS, *[(100 + i, f"{POEM} {i % 5} Ünïcode--text_{i}", None, None) for i in range(60)], (100, POEM, None, None)]
    targets = ["the cat sat", None, "", "moon ünïcode TEXT", POEM]
    for most, buckets, percent in ((1, 10_000, 10), (3, 97, 50)):
        found = importance.resample(frame(spark, rows), frame(spark, [(i, t, None, None) for i, t in enumerate(targets)]), most, buckets, min_words=5, percent=percent)
        assert mine(found) == brute(rows, targets, most, buckets, 5, percent)


def test_overlapped_spans():
    text = importance.normal_form("  A-b_c1\tÄ  ÉÈ..d\x00e ")
    assert text == "a b c1 Ä ÉÈ d e".encode()
    spans = [m.group().decode() for m in importance.pattern(3).finditer(text, overlapped=True)]
    assert spans == ["a b c1", "b c1 Ä", "c1 Ä ÉÈ", "Ä ÉÈ d", "ÉÈ d e"]
    assert importance.normal_form(None) == b"" == importance.normal_form(" -- ")
    assert len(importance.checksums(importance.normal_form(LONG), [importance.pattern(1)])) == len(LONG.split())


def test_draw_prefers_the_target(spark):
    rows = [(i, " ".join(["alpha beta" if i % 4 == 0 else f"other{i} thing"] * 15), None, None) for i in range(400)]
    found = importance.resample(frame(spark, rows), frame(spark, [(0, "alpha beta " * 50, None, None)]))
    drawn = [r.doc_id for r in found.where("rank is not null").select("row.doc_id").collect()]
    assert len(drawn) == 40 and sum(i % 4 == 0 for i in drawn) > 30


def test_empty_tables(spark):
    assert importance.resample(empty(spark), empty(spark)).count() == 0
    found = importance.resample(frame(spark), empty(spark))
    assert found.count() == len(ROWS) and found.where("rank is not null").count() == found.where("n_words >= 20").count() // 10
