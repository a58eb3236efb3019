"""Calls to a caller's model from inside a task: several at once, at a limited rate, answers in order."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

A = TypeVar("A")
R = TypeVar("R")


class TokenBucket:
    """Lets ``per_second`` calls pass, after a first burst of at most ``burst``."""

    def __init__(self, per_second: float | None, burst: int = 1) -> None:
        self.per_second, self.burst = per_second, burst
        self._lock = threading.Lock()
        self._tokens, self._then = float(burst), time.monotonic()

    def take(self) -> None:
        if self.per_second is None:
            return
        with self._lock:
            now = time.monotonic()
            self._tokens = min(self.burst, self._tokens + (now - self._then) * self.per_second) - 1
            self._then = now
            wait = -self._tokens / self.per_second
        if wait > 0:
            time.sleep(wait)


def in_order(call: Callable[[A], R], items: Iterable[A], workers: int) -> Iterator[R]:
    """``call`` of every item, up to ``workers`` at once, in the order of the items.

    At most twice as many items are taken ahead of the answer that is waited for, so memory is bounded.
    """
    if workers <= 1:
        yield from map(call, items)
        return
    with ThreadPoolExecutor(workers) as pool:
        waiting: deque = deque()
        for item in items:
            waiting.append(pool.submit(call, item))
            if len(waiting) >= 2 * workers:
                yield waiting.popleft().result()
        while waiting:
            yield waiting.popleft().result()
