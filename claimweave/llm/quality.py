"""A cascade of quality rules that stops at the first rejection.

Each rule's cost and share of rejections are estimated on a sample; the rules then run in the
order of rejections per second, so most bad texts are gone before the dear rules are asked.
What the cascade keeps does not depend on the order, only the time does.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import map_texts

SAMPLE_ROWS = 2000
SEED = 20240817
_BLANK = " \t\n\x0b\x0c\r"
# Characters that count as symbols.
_SYMBOLS = "#*$%&|<>"


class Text:
    """A text and its measures, each computed when first asked for."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "replace").split()  # bytes split at the six ASCII blanks only

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, _BLANK))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, _SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        """The lines that have a word."""
        return [line for line in self.text.split("\n") if line.strip(_BLANK)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeat_words(self.words)


def repeat_words(words: Sequence[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur twice or more, the first time included."""
    n = len(words)
    if n <= width:
        return 0
    numbers = dict(zip(words, range(n), strict=True))
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, n)
    codes = ids
    # A window's code, from the left; once the codes would outgrow 63 bits, their ranks stand for them.
    limit = n
    for k in range(1, width):
        if limit * n >= 1 << 63:
            codes = np.unique(codes, return_inverse=True)[1]
            limit = n
        codes = codes[:-1] * n + ids[k:]
        limit *= n
    order = np.sort(codes)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    repeated = np.isin(codes, np.unique(again))
    covered = np.zeros(n, bool)
    for k in range(width):
        covered[k : n - width + 1 + k] |= repeated
    return int(covered.sum())


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Text], bool]


def base_failed(t: Text) -> bool:
    return t.n_words < 10 or 100 * t.n_repeat_words > 20 * t.n_words


RULES = (
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("dup_lines", lambda t: 10 * t.n_dup_lines > 4 * len(t.lines)),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 20 * t.n_words),
    Rule("letters", lambda t: 2 * sum(map(str.isalpha, t.text)) < t.word_chars),
    Rule("top_word", lambda t: 10 * max(Counter(t.words).values(), default=0) > 3 * t.n_words),
)


def estimate(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS, seed: int = SEED) -> list[tuple[str, float, float]]:
    """Name, seconds per row and share of rejections of each rule, in the order they should run.

    About ``sample_rows`` rows are drawn from the whole table. Only those that pass the base count, as
    only they reach the rules, and each rule is timed with the base's measures at hand, as it
    runs. The first rule is the one with most rejections per second; each next one is chosen by the
    rejections among rows that those before it let pass, and its share is of these rows. Rows of the sample that are rejected by the
    same rules come to the driver as one count. Times differ from run to run, so rules of nearly equal worth may change places.
    """
    fraction = min(1.0, sample_rows / max(1, docs.count()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seconds, found = [0.0] * len(rules), Counter()
        for batch in batches:
            for text in batch["text"]:
                t = Text(text)
                if base_failed(t):
                    continue
                for measure in MEASURES:
                    getattr(t, measure)
                rejected = 0
                for i, rule in enumerate(rules):
                    start = time.perf_counter()
                    rejected |= bool(rule.rejects(t)) << i
                    seconds[i] += time.perf_counter() - start
                found[rejected] += 1
        yield pd.DataFrame({"rule": range(len(rules)), "rejected": -1, "seconds": seconds, "rows": 0})
        yield pd.DataFrame({"rule": -1, "rejected": list(found), "seconds": 0.0, "rows": list(found.values())})

    measured = docs.select("text").sample(fraction, seed).mapInPandas(run, "rule int, rejected bigint, seconds double, rows bigint")
    sums = measured.groupBy("rule", "rejected").agg(F.sum("seconds").alias("seconds"), F.sum("rows").alias("rows")).collect()
    reached = sum(r["rows"] for r in sums if r["rule"] < 0)
    cost = {r["rule"]: max(r["seconds"] / max(1, reached), 1e-9) for r in sums if r["rule"] >= 0}
    left, order = {r["rejected"]: r["rows"] for r in sums if r["rule"] < 0}, []
    waiting = list(range(len(rules)))
    while waiting:
        rejections = {i: sum(n for mask, n in left.items() if mask >> i & 1) for i in waiting}
        # Without a single rejection the cheaper rule still comes first.
        best = min(waiting, key=lambda i: (-(rejections[i] + 1 / sample_rows) / cost.get(i, 1e-9), rules[i].name))
        order.append((rules[best].name, cost.get(best, 0.0), rejections[best] / max(1, sum(left.values()))))
        left = {mask: n for mask, n in left.items() if not mask >> best & 1}
        waiting.remove(best)
    return order


def cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, order: Sequence[str] | None = None, keep: Sequence[str] | None = None, **sample) -> DataFrame:
    """Every document with its measures, ``base_failed``, ``kept`` and ``rejected_by``.

    A text that fails the base measures is rejected by ``base``; the others go through the rules
    in ``order`` (by default as estimated), up to the first that rejects. The document's columns
    (those in ``keep``) stay inside ``row``, so they cannot clash. ``rejected_by`` depends on the order, and
    so may differ between runs; nothing else does. Texts of any length are measured whole. A null text has no words and
    fails the base; rows that repeat are judged each for itself; an empty table gives no rows.
    """
    by_name = {rule.name: rule for rule in rules}
    names = order if order is not None else [name for name, _, _ in estimate(docs, rules, **sample)]
    ordered = [by_name[name] for name in names] if names else list(rules)

    def judge(texts: list[str | None]) -> list[list]:
        rows = []
        for text in texts:
            t = Text(text)
            failed = base_failed(t)
            by = "base" if failed else next((rule.name for rule in ordered if rule.rejects(t)), None)
            rows.append((*[getattr(t, m) for m in MEASURES], failed, by is None, by))
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * (len(MEASURES) + 3)

    fields = {m: pa.int64() for m in MEASURES} | {"base_failed": pa.bool_(), "kept": pa.bool_(), "rejected_by": pa.string()}
    return map_texts(docs, judge, fields, keep)
