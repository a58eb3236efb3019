import datetime as dt
import random

from pyspark.sql import functions as F

from claimweave.operators import payments as ops
from claimweave.session import scratch_path
from claimweave.streaming import payment_changes as changes
from claimweave.streaming import payment_status as stream

EVENTS = "event_id bigint, type string, client_reference_id string, session_id string, payment_intent string, ts timestamp"
DONE, GONE, BROKE = "checkout.session.completed", "checkout.session.expired", "payment_intent.payment_failed"


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def webhook(number, kind, payment, minute):
    return (number, kind, payment, f"cs{number}", f"in{number}", at(minute))


def sample(n=600, seed=2):
    rng = random.Random(seed)
    rows = [webhook(i, rng.choice([DONE, GONE, BROKE, "other"]), rng.choice(["hot"] * 10 + [f"p{j}" for j in range(20)] + ["unknown", None, ""]), rng.randint(0, 50)) for i in range(n)]
    rows += rng.sample(rows, 100)  # repeated deliveries
    rng.shuffle(rows)
    return rows


def expected(rows):
    known = {"hot", *[f"p{j}" for j in range(20)]}
    best = {}
    for number, kind, payment, session, intent, ts in rows:
        if kind in (DONE, GONE) and payment in known and (payment not in best or (ts, number) > best[payment][0]):
            best[payment] = ((ts, number), "completed" if kind == DONE else "expired", session if kind == DONE else None)
    return {p: (status, session) for p, (_, status, session) in best.items()}


def payments(spark):
    return spark.createDataFrame([("hot",), *[(f"p{j}",) for j in range(20)]], "payment_intent_id string")


def test_batch_fold(spark):
    rows = sample()
    found = stream.payment_status(spark.createDataFrame(rows, EVENTS), payments(spark)).collect()
    assert {r["payment_intent_id"]: (r["payment_status"], r["session_id"]) for r in found} == expected(rows)


def test_stream_equals_batch_when_late_and_repeated(spark):
    rows = sample(seed=4)
    source, out = scratch_path(spark, "events"), scratch_path(spark, "status")
    known = payments(spark)

    half = len(rows) // 2
    spark.createDataFrame(rows[:half], EVENTS).repartition(3).write.parquet(f"{source}/a")
    source_dirs = f"{source}/*"
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source_dirs)
    sink = lambda e: stream.status_sink(e, f"{out}/deltas", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    assert stream.current_status(spark, f"{out}/deltas", known).count() == 0  # before the first batch
    sink(events)
    assert stream.current_status(spark, f"{out}/deltas", known.limit(0)).count() == 0  # no payment is known yet
    middle = stream.current_status(spark, f"{out}/deltas", known).collect()
    stream.compact_status(spark, f"{out}/deltas")
    assert sorted(stream.current_status(spark, f"{out}/deltas", known).collect()) == sorted(middle)
    assert {r["payment_intent_id"]: (r["payment_status"], r["session_id"]) for r in middle} == expected(rows[:half])
    spark.createDataFrame(rows[half:], EVENTS).repartition(2).write.parquet(f"{source}/b")
    # Restarts from the checkpoint and reads only what is new.
    sink(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source_dirs))
    final = stream.current_status(spark, f"{out}/deltas", known).collect()
    assert {r["payment_intent_id"]: (r["payment_status"], r["session_id"]) for r in final} == expected(rows)
    stream.compact_status(spark, f"{out}/deltas")
    stream.compact_status(spark, f"{out}/deltas")  # nothing new
    assert sorted(stream.current_status(spark, f"{out}/deltas", known).collect()) == sorted(final)


def test_stateful_stream_in_update_mode(spark):
    rows = sample(seed=6)
    source = scratch_path(spark, "events")
    spark.createDataFrame(rows, EVENTS).repartition(4).write.parquet(source)
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    latest = stream.latest_status(stream.known(stream.status_events(events), payments(spark)))
    query = latest.writeStream.outputMode("complete").format("memory").queryName("latest_status").start()
    query.processAllAvailable()
    query.stop()
    assert {r["payment_intent_id"]: (r["payment_status"], r["session_id"]) for r in spark.table("latest_status").collect()} == expected(rows)


def test_changes(spark):
    rows = [webhook(2, GONE, "hot", 5), webhook(1, DONE, "hot", 5), webhook(3, DONE, "p1", 1), webhook(4, BROKE, "hot", 9)]
    found = stream.status_changes(spark.createDataFrame(rows, EVENTS), payments(spark)).collect()
    assert {(r["event_id"], r["old_status"], r["new_status"]) for r in found} == {(1, None, "completed"), (2, "completed", "expired"), (3, None, "completed")}


def ledger(spark):
    rows = [
        ("a", "u1", "q1", 1000, "completed", at(1)), ("b", "u1", "q1", 2000, "failed", at(2)), ("c", "u1", "q2", 3000, "pending", at(2)),
        ("d", "u2", "q3", 4000, None, None), ("e", "u2", "q3", 5050, "completed", at(0)),
    ]
    return spark.createDataFrame(rows, "payment_intent_id string, user_id string, quote_id string, amount bigint, payment_status string, created_at timestamp").withColumn("currency", F.lit("SGD"))


def test_latest_and_payable(spark):
    book = ledger(spark)
    assert {(r["user_id"], r["payment_intent_id"], r["rank"]) for r in ops.latest_per_user(book, 2).collect()} == {("u1", "b", 1), ("u1", "c", 2), ("u2", "e", 1), ("u2", "d", 2)}
    assert ops.latest_per_user(book, 2, "u2").count() == 2
    assert {r["payment_intent_id"] for r in ops.latest_per_quote(book).collect()} == {"b", "c", "e"}
    quotes = spark.createDataFrame([("q1",), ("q2",), ("q3",), ("q4",)], "quote_id string")
    assert {r["quote_id"] for r in ops.payable_quotes(quotes, book).collect()} == {"q1", "q4"}
    assert [r["payment_intent_id"] for r in ops.by_status(book, "completed", 1).collect()] == ["a"]
    assert {r["payment_status"]: r["n"] for r in ops.status_counts(book).collect()}["unknown"] == 1


def test_offers_and_policies(spark):
    response = '{"offerCategories":[{"offers":[{"id":"o1","unitPrice":10.5,"extra":{"k":1}},{"id":"o2","productCode":"P2","unitPrice":3,"currency":"USD"}]},{"offers":[{"id":"o9"}]}]}'
    quotes = spark.createDataFrame([("q1", response), ("q2", "{}"), ("q3", "broken"), ("q4", None)], "quote_id string, quotation_response string")
    offers = ops.quote_offers(quotes).collect()
    assert {(r["quote_id"], r["offer_id"], r["unit_price"], r["currency"]) for r in offers} == {
        ("q1", "o1", 10.5, "SGD"), ("q1", "o2", 3.0, "USD"), ("q2", None, None, None), ("q3", None, None, None), ("q4", None, None, None)
    }
    selections = spark.createDataFrame(
        [("s1", "q1", "a", "o2", "SP", 99.0, "[1]", "{}"), ("s2", "q1", "e", "zz", "SP", 0.0, "[1]", '{"e":1}'), ("s3", None, None, "o1", "SP", 7.0, None, None)],
        "selection_id string, quote_id string, payment_id string, selected_offer_id string, selected_product_code string, total_price double, insureds string, main_contact string",
    )
    chosen = {r["selection_id"]: (r["product_code"], r["unit_price"], r["currency"], r["status"]) for r in ops.selected_offer(selections, quotes, ledger(spark)).collect()}
    assert chosen == {"s1": ("P2", 3.0, "USD", "pending_payment"), "s2": ("SP", 50.5, "SGD", "pending_payment"), "s3": ("SP", 7.0, None, "draft")}
    checks = {r["payment_intent_id"]: (r["ready"], r["reasons"]) for r in ops.purchase_checks(ledger(spark), selections).collect()}
    assert checks["a"] == (False, ["missing_main_contact"]) and checks["e"] == (True, []) and checks["b"] == (False, ["payment_not_completed"])
    policies = {r["payment_id"]: r["premium_amount"] for r in ops.policy_records(ledger(spark), selections).collect()}
    assert policies == {"a": 10.0, "e": 50.5}


def told_in_batches(spark, batches, known, delay="60 minutes", **options):
    source, out = scratch_path(spark, "events"), scratch_path(spark, "changes")
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # one state store; there are few events
    try:
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, EVENTS).repartition(2).write.parquet(f"{source}/{i}")
            events = spark.readStream.schema(EVENTS).parquet(f"{source}/*")
            changes.change_sink(events, out, f"{out}-checkpoint", delay, **options).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    return changes.current_changes(spark, out, known)


def test_changes_stream_equals_batch_when_late_and_repeated(spark):
    """Three deliveries in any order of time, within the delay, with repeats: a late event corrects the change after it."""
    rows = sample(seed=8)
    third = len(rows) // 3
    found = told_in_batches(spark, [rows[:third], rows[third : 2 * third], rows[2 * third :] + rows[:50]], payments(spark))
    batch = stream.status_changes(spark.createDataFrame(list(dict.fromkeys(rows)), EVENTS), payments(spark))
    columns = ["payment_intent_id", "event_id", "ts", "old_status", "new_status"]
    assert sorted(map(str, found.select(columns).collect())) == sorted(map(str, batch.select(columns).collect()))


def test_changes_stream_settles_and_forgets(spark):
    """What is behind the watermark is one status; an event beyond the delay is dropped; an idle payment is forgotten on request."""
    batches = [
        [webhook(1, DONE, "p1", 0), webhook(2, GONE, "p1", 5), webhook(3, DONE, "p2", 300)],
        [webhook(4, DONE, "p1", 3), webhook(5, DONE, "p1", 310)],  # 4 comes too late
        [webhook(6, GONE, "p2", 3000)],
        [webhook(7, GONE, "p1", 3001)],
    ]
    kept = {(r.event_id, r.old_status, r.new_status) for r in told_in_batches(spark, batches, None).collect()}
    assert kept == {(1, None, "completed"), (2, "completed", "expired"), (3, None, "completed"), (5, "expired", "completed"), (6, "completed", "expired"), (7, "completed", "expired")}
    short = {(r.event_id, r.old_status) for r in told_in_batches(spark, batches, None, idle_ms=1000 * 60 * 600).collect()}
    assert short == {(1, None), (2, "completed"), (3, None), (5, "expired"), (6, "completed"), (7, None)}


def test_told_changes():
    a, b, c = (1, 1, "x"), (2, 2, "y"), (3, 3, "z")
    assert changes.told(None, [], [a, c]) == [(a, None), (c, "x")]
    assert changes.told(None, [a, c], [a, b, c]) == [(b, "x"), (c, "y")]
    assert changes.told(a, [c], [b, c]) == [(b, "x"), (c, "y")]
    assert changes.told(a, [c], [c]) == []


def test_a_payment_costs_few_state_calls():
    """Each call for state or timers is a message to the JVM: an event costs three, a timer two."""
    calls = []

    class State:
        value = None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

    class Handle:
        def getValueState(self, *_):
            return State()

        def registerTimer(self, at):
            calls.append(at)

    class Times:
        def __init__(self, watermark):
            self.getCurrentWatermarkInMs = lambda: watermark

    tracker = changes.ChangeTracker()
    tracker.init(Handle())
    events = [{"at": at, "event_id": at, "payment_status": status} for at, status in ((5000, "b"), (2000, "a"), (5000, "b"))]
    found = [tuple(row) for row in tracker.handleInputRows(("p",), iter(events), Times(0))]
    assert found == [("p", 2000, 2000, None, "a"), ("p", 5000, 5000, "a", "b")]
    assert calls == ["get", "update", 6] or calls == ["get", 6, "update"]
    calls.clear()
    assert list(tracker.handleExpiredTimer(("p",), Times(6), None)) == [] and calls == ["get", "update"]
    assert tracker.payment.value == (5000, 5000, "b", [], [], [], None)
