"""Language identification as a mixture: which languages a text holds, and how much of each.

Learning counts hashed character trigrams per language, in one aggregate over all labelled rows.
A text is explained as a mixture of the learned languages: expectation-maximisation finds the
proportions, and a penalised likelihood decides how many languages the text really has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import map_texts

UNKNOWN = "und"
# Trigrams fall into so many buckets, so a model has languages x buckets numbers at most.
BUCKETS = 1 << 15
SMOOTHING = 0.5
ROUNDS = 12
# By so many standard errors a text may be less likely than the limit.
ERRORS = 6.0
# Texts are worked on together up to so many distinct trigrams.
TOGETHER = 100_000
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Model(NamedTuple):
    languages: list[str]
    log_p: np.ndarray  # buckets x languages


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's character trigrams and how often each occurs.

    Letters count in lower case; everything between words is one blank.
    """
    letters = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    if not letters:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points = np.frombuffer(f" {letters} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    codes = points[:-2] | points[1:-1] << np.uint64(21) | points[2:] << np.uint64(42)
    codes *= _MIX
    counts = np.bincount((codes >> np.uint64(49)).astype(np.int64), minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found]


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def learn(labelled: DataFrame) -> Model:
    """Learns from every row of ``labelled`` (``text``, ``lang``); rows without either teach nothing.

    Tasks count what they read, so the shuffle has a row per task, language and bucket. Languages x
    buckets counts come to the driver: two megabytes for eight languages, whatever the size of the corpus.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                found, counts = trigrams(text)
                if len(found):
                    sums.setdefault(lang, np.zeros(BUCKETS, np.int64))[found] += counts
        for lang, total in sums.items():
            found = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": found, "n": total[found]})

    counted = labelled.where("lang is not null and text is not null").select("lang", "text").mapInPandas(count, "lang string, bucket bigint, n bigint")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(table["lang"].unique())
    counts = np.full((BUCKETS, len(languages)), SMOOTHING)
    column = {lang: i for i, lang in enumerate(languages)}
    counts[table["bucket"].to_numpy(np.int64), table["lang"].map(column).to_numpy(np.int64)] += table["n"].to_numpy(np.float64)
    return Model(languages, np.log(counts / counts.sum(axis=0)))


def _em(p: np.ndarray, counts: np.ndarray, starts: np.ndarray, owner: np.ndarray, totals: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihoods of many texts at once; ``allowed`` masks the languages of each."""
    shares = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(ROUNDS):
        parts = p * shares[owner]
        parts *= (counts / parts.sum(axis=1))[:, None]
        shares = np.add.reduceat(parts, starts, axis=0) / totals[:, None]
    likelihood = np.add.reduceat(counts * np.log((p * shares[owner]).sum(axis=1)), starts)
    return shares, likelihood


def mixtures(model: Model, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The proportion of each language in each text (texts x languages); rows of texts without trigrams are 0.

    All languages are fitted first. Sets of the one, two, ... strongest are then fitted alone, as
    long as another language gains more likelihood than its penalty, half the logarithm of the
    number of trigrams plus the logarithm of the languages to choose from.
    """
    out = np.zeros((len(found), len(model.languages)))
    some = np.array([i for i, (b, _) in enumerate(found) if len(b)], np.int64)
    if not len(some) or not model.languages:
        return out
    sizes = np.array([len(found[i][0]) for i in some])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    owner = np.repeat(np.arange(len(some)), sizes)
    counts = np.concatenate([found[i][1] for i in some]).astype(np.float64)
    totals = np.add.reduceat(counts, starts)
    logs = model.log_p[np.concatenate([found[i][0] for i in some])]
    top = logs.max(axis=1, keepdims=True)  # taken out, so the exponentials stay in range
    p = np.exp(logs - top)
    k = p.shape[1]
    shares, _ = _em(p, counts, starts, owner, totals, np.ones((len(some), k)))
    rank = np.argsort(np.argsort(-shares, axis=1, kind="stable"), axis=1, kind="stable")
    best, best_value = np.zeros_like(shares), np.full(len(some), -np.inf)
    penalty = 0.5 * np.log(np.maximum(totals, 2)) + np.log(k)
    open_ = np.arange(len(some))  # the texts for which one language more may still pay
    for size in range(1, k + 1):
        rows = np.isin(owner, open_)
        lengths = sizes[open_]
        begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        fit, value = _em(p[rows], counts[rows], begin, np.repeat(np.arange(len(open_)), lengths), totals[open_], (rank[open_] < size).astype(np.float64))
        value -= size * penalty[open_]
        better = value > best_value[open_]
        best[open_[better]], best_value[open_[better]] = fit[better], value[better]
        open_ = open_[better]
        if not len(open_):
            break
    out[some] = best
    return out


class Expected(NamedTuple):
    """What a language's own texts look like to the model, per trigram: the mean log-likelihood, its standard deviation, and the log-likelihood of what was never seen."""

    p: np.ndarray  # buckets x languages
    mean: np.ndarray
    spread: np.ndarray
    unseen: np.ndarray


def expected(model: Model) -> Expected:
    p = np.exp(model.log_p)
    # Without the smoothing, which every bucket has alike, what was counted is left.
    seen = p - p.min(axis=0)
    seen /= np.maximum(seen.sum(axis=0), 1e-300)
    mean = (seen * model.log_p).sum(axis=0)
    return Expected(p, mean, np.sqrt((seen * (model.log_p - mean) ** 2).sum(axis=0)), model.log_p.min(axis=0))


def fits(of: Expected, found: list[tuple[np.ndarray, np.ndarray]], shares: np.ndarray) -> list[bool]:
    """Whether each text is closer to texts of its mixture than to what these languages never have.

    Its mean log-likelihood per trigram must reach the middle between the two, less ERRORS standard
    errors, as a short text varies: a rare topic or a name passes, an unlearned script does not.
    Text without trigrams does not fit.
    """
    out = []
    for (buckets, counts), share in zip(found, shares, strict=True):
        total = counts.sum()
        if not len(buckets) or not share.any():
            out.append(False)
            continue
        mean = float(counts @ np.log(of.p[buckets] @ share)) / total
        out.append(bool(mean >= share @ ((of.mean + of.unseen) / 2 - ERRORS / np.sqrt(total) * of.spread)))
    return out


def identify(docs: DataFrame, model: Model, keep: Sequence[str] | None = None) -> DataFrame:
    """Every document with ``lang_pred``, ``score``, ``languages`` and ``fits``.

    ``lang_pred`` is the language with the largest proportion, ``score`` that proportion, and
    ``languages`` all proportions of the selected set. ``fits`` tells whether the text is closer to
    texts of these languages than to what they never have; one in an unlearned script is not, though it
    still has a share in learned languages. A text that is null or has no letter is
    ``und`` with score 0 and does not fit, and so is everything if nothing was learned. Only the text is looked
    at; the document's columns (those in ``keep``) stay inside ``row``, so they cannot clash. Rows
    that repeat get equal results; an empty table gives no rows.
    """

    known: list[Expected] = []

    def predict(texts: list[str | None]) -> list[list]:
        pending: list[tuple[np.ndarray, np.ndarray]] = []
        languages, scores, sets, fit = [], [], [], []
        size = 0
        if not known:
            known.append(expected(model))

        def settle() -> None:
            found = mixtures(model, pending)
            fit.extend(fits(known[0], pending, found))
            for shares in found:
                chosen = [i for i in np.argsort(-shares, kind="stable") if shares[i] > 0]
                languages.append(model.languages[chosen[0]] if chosen else UNKNOWN)
                scores.append(round(min(1.0, float(shares[chosen[0]])), 6) if chosen else 0.0)
                sets.append([{"lang": model.languages[i], "share": float(shares[i])} for i in chosen])
            pending.clear()

        for text in texts:
            pending.append(trigrams(text if has_letter(text) else None))
            size += len(pending[-1][0])
            if size >= TOGETHER:
                settle()
                size = 0
        settle()
        return [languages, scores, sets, fit]

    share = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
    return map_texts(docs, predict, {"lang_pred": pa.string(), "score": pa.float64(), "languages": share, "fits": pa.bool_()}, keep)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: the checksum of its id, modulo 4, is 2. Rows without id are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn_from(docs: DataFrame) -> Model:
    """Learns from the documents that have an id, a text and a language and are not held out."""
    return learn(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
