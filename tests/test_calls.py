"""Model calls: several at once, at a limited rate, in order."""

import threading
import time

from claimweave.operators import vectors
from claimweave.operators.annotate import annotate
from claimweave.operators.calls import TokenBucket, in_order


def test_in_order_and_bounded():
    taken, running, most = [], [0], [0]
    lock = threading.Lock()

    def items():
        for i in range(40):
            taken.append(i)
            yield i

    def call(i):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.02 if i % 3 else 0.05)
        with lock:
            running[0] -= 1
        return i * i

    answers = in_order(call, items(), 4)
    assert next(answers) == 0 and len(taken) <= 9  # not all items are taken ahead
    assert list(answers) == [i * i for i in range(1, 40)]
    assert 2 <= most[0] <= 4
    assert list(in_order(call, range(3), 1)) == [0, 1, 4]


def test_token_bucket_keeps_the_rate():
    bucket = TokenBucket(50, burst=2)
    start = time.monotonic()
    stamps = list(in_order(lambda _: (bucket.take(), time.monotonic())[1], range(22), 8))
    assert 0.36 <= time.monotonic() - start < 2
    stamps.sort()
    assert all(b - a >= 0.3 for a, b in zip(stamps, stamps[18:]))  # 18 calls take at least 16 / 50 seconds
    TokenBucket(None).take()


def slow_model():
    """Made in a function, so it travels with the plan."""

    def load():
        def call(rows):
            time.sleep(0.05)
            if (rows["n"] == 13).any():
                raise ValueError("unlucky")
            return [str(n * 2) for n in rows["n"]]

        return call

    return load


def test_annotate_at_once(spark):
    df = spark.range(120).selectExpr("id AS n").coalesce(1)
    rows = lambda **options: annotate(df, slow_model(), batch=5, retries=1, **options).collect()
    rows(workers=2)  # the Python worker is up

    def timed(**options):
        start = time.monotonic()
        found = rows(**options)
        return found, time.monotonic() - start

    one, alone = timed()
    many, together = timed(workers=8)
    assert one == many and [r.n for r in one] == list(range(120))
    assert [r.status for r in one].count("error") == 1 and one[13].error == "unlucky"
    assert together < alone / 1.5
    limited, slowly = timed(workers=8, per_second=20)
    assert limited == one and slowly >= (24 + 5 - 8) / 20


def slow_encoder():
    def load():
        def encode(texts):
            time.sleep(0.05)
            return [[float(len(t))] for t in texts]

        return encode

    return load


def test_embeddings_at_once(spark):
    df = spark.createDataFrame([("x" * (i % 40),) for i in range(80)], "t string").coalesce(1)
    plain = vectors.attach_embeddings(df, "t", slow_encoder(), batch=2).collect()
    assert sorted(plain) == sorted(vectors.attach_embeddings(df, "t", slow_encoder(), batch=2, workers=6, per_second=100).collect())
