"""Payments from orders, quotes from customers, webhook events from the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave.operators import payments as ops
from claimweave.plans.registry import Registry
from claimweave.plans.tables import table
from claimweave.session import scratch_path
from claimweave.streaming import payment_changes as changes
from claimweave.streaming import payment_status as stream

REGISTRY = Registry.empty()

# The same text runs in both engines.
_PAYMENTS = (
    "SELECT concat('pi_', o_orderkey) AS payment_intent_id, concat('u_', o_custkey) AS user_id, concat('q_', o_custkey) AS quote_id, "
    "cast(round(o_totalprice * 100) as bigint) AS amount, case when o_orderkey % 2 = 0 then 'SGD' else 'USD' end AS currency, "
    "case when o_orderkey % 17 = 0 then null when o_orderstatus = 'F' then 'completed' when o_orderstatus = 'O' then 'pending' else 'failed' end AS payment_status, "
    "concat('cs_', o_orderkey) AS stripe_session_id, cast(null as {text}) AS stripe_payment_intent, cast(o_orderdate as timestamp) AS created_at FROM orders"
)
_QUOTES = (
    "SELECT concat('q_', c_custkey) AS quote_id, case c_custkey % 4 when 0 then '{{\"offerCategories\":[]}}' "
    "when 1 then concat('{{\"offerCategories\":[{{\"offers\":[{{\"id\":\"o1\",\"productCode\":\"P', c_nationkey, '\",\"unitPrice\":12.5,\"currency\":\"USD\"}},{{\"id\":\"o2\",\"productCode\":\"B\"}}]}}]}}') "
    "when 2 then '{{\"offerCategories\":[{{\"offers\":[]}}]}}' "
    "else concat('{{\"offerCategories\":[{{\"offers\":[{{\"id\":\"o2\",\"productCode\":\"C\",\"unitPrice\":', c_nationkey, '}}]}}]}}') end AS quotation_response, "
    "c_custkey % 4 AS form, c_nationkey AS nation FROM customer"
)
_SELECTIONS = (
    "SELECT concat('s_', o_orderkey) AS selection_id, case when o_orderkey % 13 <> 0 then concat('q_', o_custkey) end AS quote_id, "
    "case when o_orderkey % 5 <> 0 then concat('pi_', o_orderkey) end AS payment_id, case o_orderkey % 3 when 0 then 'o1' when 1 then 'o2' end AS selected_offer_id, "
    "'SEL' AS selected_product_code, case when o_orderkey % 2 = 0 then o_totalprice else 0.0 end AS total_price, "
    "case when o_orderkey % 7 <> 0 then '[{{\"n\":1}}]' else '[]' end AS insureds, '{{\"e\":1}}' AS main_contact FROM orders"
)
_WITH = "WITH p AS (" + _PAYMENTS.format(text="varchar") + "), q AS (" + _QUOTES.format() + "), s AS (" + _SELECTIONS.format() + ") "


def _run(spark, sf_dir, sql: str, name: str):
    view = f"_payment_{name}"
    table(spark, sf_dir, name).createOrReplaceTempView(view)
    return spark.sql(sql.format(text="string").replace(f"FROM {name}", f"FROM {view}"))


def payments(spark, sf_dir):
    return _run(spark, sf_dir, _PAYMENTS, "orders")


def quotes(spark, sf_dir):
    return _run(spark, sf_dir, _QUOTES, "customer").drop("form", "nation")


def selections(spark, sf_dir):
    return _run(spark, sf_dir, _SELECTIONS, "orders")


_NEWEST = "ORDER BY created_at DESC NULLS LAST, payment_intent_id"
_SHORT = "user_id, payment_intent_id, amount, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at"


@REGISTRY.add("g01_latest_per_user", _WITH + f"SELECT {_SHORT}, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id {_NEWEST}) AS rank FROM p) WHERE rank <= 3")
def latest_per_user(spark, sf_dir):
    return ops.latest_per_user(payments(spark, sf_dir), 3).select("user_id", "payment_intent_id", "amount", "created_at", "rank")


@REGISTRY.add("g02_latest_per_quote", _WITH + f"SELECT quote_id, payment_intent_id, payment_status FROM (SELECT *, row_number() OVER (PARTITION BY quote_id {_NEWEST}) AS rank FROM p) WHERE rank = 1")
def latest_per_quote(spark, sf_dir):
    return ops.latest_per_quote(payments(spark, sf_dir)).select("quote_id", "payment_intent_id", "payment_status")


@REGISTRY.add("g03_by_status", _WITH + f"SELECT {_SHORT} FROM (SELECT * FROM p WHERE payment_status = 'pending' {_NEWEST} LIMIT 100)")
def by_status(spark, sf_dir):
    return ops.by_status(payments(spark, sf_dir), "pending").select("user_id", "payment_intent_id", "amount", "created_at")


@REGISTRY.add("g04_status_counts", _WITH + "SELECT coalesce(payment_status, 'unknown') AS payment_status, count(*) AS n FROM p GROUP BY 1")
def status_counts(spark, sf_dir):
    return ops.status_counts(payments(spark, sf_dir))


@REGISTRY.add("g05_lookup", _WITH + "SELECT payment_intent_id, user_id, amount FROM p WHERE quote_id IN (SELECT 'q_' || s_suppkey FROM supplier)")
def lookup(spark, sf_dir):
    wanted = table(spark, sf_dir, "supplier").select(F.concat(F.lit("q_"), "s_suppkey").alias("quote_id"))
    return ops.lookup(payments(spark, sf_dir), "quote_id", wanted).select("payment_intent_id", "user_id", "amount")


@REGISTRY.add(
    "g06_quote_offers",
    _WITH + "SELECT quote_id, CAST(0 AS BIGINT) AS offer_index, 'o1' AS offer_id, 'P' || nation AS product_code, CAST(12.5 AS DOUBLE) AS unit_price, 'USD' AS currency FROM q WHERE form = 1 "
    "UNION ALL SELECT quote_id, 1, 'o2', 'B', 0, 'SGD' FROM q WHERE form = 1 UNION ALL SELECT quote_id, 0, 'o2', 'C', CAST(nation AS DOUBLE), 'SGD' FROM q WHERE form = 3 "
    "UNION ALL SELECT quote_id, NULL, NULL, NULL, NULL, NULL FROM q WHERE form IN (0, 2)",
)
def quote_offers(spark, sf_dir):
    return ops.quote_offers(quotes(spark, sf_dir))


_FIRST = "CASE form WHEN 1 THEN 'P' || nation WHEN 3 THEN 'C' END AS product_code, CAST(CASE form WHEN 1 THEN 12.5 WHEN 3 THEN nation ELSE 0 END AS DOUBLE) AS unit_price, CASE form WHEN 1 THEN 'USD' ELSE 'SGD' END AS currency"


@REGISTRY.add("g06_quote_summary", _WITH + f"SELECT quote_id, {_FIRST}, CASE form WHEN 1 THEN 2 WHEN 3 THEN 1 ELSE 0 END::BIGINT AS offers FROM q")
def quote_summary(spark, sf_dir):
    return ops.quote_summary(quotes(spark, sf_dir)).select("quote_id", "product_code", "unit_price", "currency", F.size("offers").alias("offers"))


@REGISTRY.add(
    "g07_selection_view",
    _WITH + "SELECT selection_id, s.quote_id, quotation_response, CASE WHEN form IS NULL THEN NULL WHEN form = 1 THEN 'o1,o2' WHEN form = 3 THEN 'o2' ELSE '' END AS offers FROM s LEFT JOIN q ON s.quote_id = q.quote_id",
)
def selection_view(spark, sf_dir):
    view = ops.selection_view(selections(spark, sf_dir), quotes(spark, sf_dir))
    return view.select("selection_id", "quote_id", "quotation_response", F.array_join(F.transform("offers", lambda o: o["id"]), ",").alias("offers"))


_FOUND = "(form = 1 AND selected_offer_id IN ('o1', 'o2') OR form = 3 AND selected_offer_id = 'o2')"


@REGISTRY.add(
    "g08_selected_offer",
    _WITH + f"SELECT selection_id, s.quote_id, payment_id, selected_offer_id, CASE WHEN {_FOUND} THEN CASE WHEN form = 3 THEN 'C' WHEN selected_offer_id = 'o1' THEN 'P' || nation ELSE 'B' END ELSE selected_product_code END AS product_code, "
    f"round(CAST(CASE WHEN {_FOUND} THEN CASE WHEN form = 3 THEN nation WHEN selected_offer_id = 'o1' THEN 12.5 ELSE 0 END ELSE coalesce(nullif(CAST(total_price AS DOUBLE), 0), amount / 100.0) END AS DOUBLE), 6) AS unit_price, "
    f"CASE WHEN {_FOUND} THEN CASE WHEN form = 1 AND selected_offer_id = 'o1' THEN 'USD' ELSE 'SGD' END ELSE p.currency END AS currency, "
    "CASE WHEN payment_id IS NOT NULL THEN 'pending_payment' ELSE 'draft' END AS status "
    "FROM s LEFT JOIN q ON s.quote_id = q.quote_id LEFT JOIN p ON s.payment_id = p.payment_intent_id",
)
def selected_offer(spark, sf_dir):
    return ops.selected_offer(selections(spark, sf_dir), quotes(spark, sf_dir), payments(spark, sf_dir))


@REGISTRY.add(
    "g09_payable_quotes",
    _WITH + f", newest AS (SELECT quote_id, payment_status FROM (SELECT *, row_number() OVER (PARTITION BY quote_id {_NEWEST}) AS rank FROM p) WHERE rank = 1) "
    "SELECT quote_id FROM q WHERE quote_id NOT IN (SELECT quote_id FROM newest WHERE payment_status IN ('completed', 'pending'))",
)
def payable_quotes(spark, sf_dir):
    return ops.payable_quotes(quotes(spark, sf_dir), payments(spark, sf_dir)).select("quote_id")


@REGISTRY.add(
    "g10_purchase_checks",
    _WITH + "SELECT *, reasons = '' AS ready FROM (SELECT payment_intent_id, selection_id, concat_ws(',', CASE WHEN coalesce(payment_status, '') <> 'completed' THEN 'payment_not_completed' END, "
    "CASE WHEN selection_id IS NOT NULL AND s.quote_id IS NULL THEN 'missing_quote_id' END, CASE WHEN selection_id IS NOT NULL AND selected_offer_id IS NULL THEN 'missing_selected_offer_id' END, "
    "CASE WHEN insureds = '[]' THEN 'missing_insureds' END) AS reasons FROM p LEFT JOIN s ON s.payment_id = p.payment_intent_id)",
)
def purchase_checks(spark, sf_dir):
    checks = ops.purchase_checks(payments(spark, sf_dir), selections(spark, sf_dir))
    return checks.withColumn("reasons", F.array_join("reasons", ","))


@REGISTRY.add(
    "g11_policy_records",
    _WITH + "SELECT 'pol_' || left(sha256(payment_intent_id || '|' || selection_id), 12) AS policy_id, selection_id, user_id, p.quote_id, payment_id, coalesce(selected_offer_id, '') AS purchased_offer_id, "
    "selected_product_code AS product_code, round(CAST(amount AS DOUBLE) / 100, 6) AS premium_amount, currency, 'active' AS status FROM p JOIN s ON s.payment_id = p.payment_intent_id WHERE payment_status = 'completed'",
)
def policy_records(spark, sf_dir):
    return ops.policy_records(payments(spark, sf_dir), selections(spark, sf_dir))


# --- webhook events ------------------------------------------------------------


def webhook_events(events):
    kinds = F.col("event_type")
    number = F.col("event_id")
    return events.select(
        "event_id",
        F.when(kinds == "purchase", "checkout.session.completed").when(kinds == "error", "checkout.session.expired").when(kinds == "signup", "payment_intent.payment_failed").otherwise("other").alias("type"),
        F.when(number % 10 != 0, F.concat(F.lit("pay_"), "user_id")).alias("client_reference_id"),
        F.concat(F.lit("cs_"), number).alias("session_id"),
        F.concat(F.lit("in_"), number).alias("payment_intent"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def known_payments(spark, sf_dir):
    """A payment per customer; every ninth goes by another name, so its events are unknown."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(F.concat(F.when(key % 9 == 0, "other_").otherwise("pay_"), key).alias("payment_intent_id"))


_EVENTS = (
    "WITH w AS (SELECT 'pay_' || user_id AS payment_intent_id, CASE event_type WHEN 'purchase' THEN 'completed' ELSE 'expired' END AS payment_status, "
    "CASE event_type WHEN 'purchase' THEN 'cs_' || event_id END AS session_id, CASE event_type WHEN 'purchase' THEN 'in_' || event_id END AS payment_intent, ts, event_id FROM events "
    "WHERE event_type IN ('purchase', 'error') AND event_id % 10 <> 0 AND user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 <> 0)) "
)
_STATUS = (
    _EVENTS + "SELECT payment_intent_id, payment_status, session_id, payment_intent, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS webhook_processed_at "
    "FROM (SELECT *, row_number() OVER (PARTITION BY payment_intent_id ORDER BY ts DESC, event_id DESC) AS rk FROM w) WHERE rk = 1"
)


@REGISTRY.add("h01_payment_status_batch", _STATUS)
def payment_status_batch(spark, sf_dir):
    return stream.payment_status(webhook_events(table(spark, sf_dir, "events")), known_payments(spark, sf_dir))


@REGISTRY.add("h01_payment_status_stream", _STATUS)
def payment_status_stream(spark, sf_dir):
    """Runs the stream over everything there is, then folds its deltas."""
    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    path = scratch_path(spark, "payment_status")
    sink = stream.status_sink(webhook_events(source), f"{path}/statuses", f"{path}/checkpoint")
    sink.trigger(availableNow=True).start().awaitTermination()
    stream.compact_status(spark, f"{path}/statuses")
    # The payments are those of the time of reading, so events ahead of their payment count.
    return stream.current_status(spark, f"{path}/statuses", known_payments(spark, sf_dir))


@REGISTRY.add(
    "h01_apply_status",
    _EVENTS + ", last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY payment_intent_id ORDER BY ts DESC, event_id DESC) AS rk FROM w) WHERE rk = 1), "
    "known AS (SELECT CASE WHEN c_custkey % 9 = 0 THEN 'other_' ELSE 'pay_' END || c_custkey AS id FROM customer) "
    "SELECT id AS payment_intent_id, coalesce(payment_status, 'pending') AS payment_status, coalesce(session_id, 'none') AS stripe_session_id FROM known LEFT JOIN last ON id = payment_intent_id",
)
def apply_status(spark, sf_dir):
    known = known_payments(spark, sf_dir).withColumns({"payment_status": F.lit("pending"), "stripe_session_id": F.lit("none"), "stripe_payment_intent": F.lit(None).cast("string")})
    statuses = stream.payment_status(webhook_events(table(spark, sf_dir, "events")), known)
    return stream.apply_status(known, statuses).select("payment_intent_id", "payment_status", "stripe_session_id")


_CHANGES = (
    _EVENTS + "SELECT payment_intent_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, lag(payment_status) OVER (PARTITION BY payment_intent_id ORDER BY ts, event_id) AS old_status, payment_status AS new_status FROM w"
)


@REGISTRY.add("h02_status_changes", _CHANGES)
def status_changes(spark, sf_dir):
    return stream.status_changes(webhook_events(table(spark, sf_dir, "events")), known_payments(spark, sf_dir))


@REGISTRY.add("h02_status_changes_stream", _CHANGES)
def status_changes_stream(spark, sf_dir):
    """The events in two deliveries, so at least two micro-batches: a third of the first ones' last day comes late, and a fifth of it comes again."""
    events = table(spark, sf_dir, "events")
    border = events.agg(F.expr("min(ts) + (max(ts) - min(ts)) / 2").alias("m")).first()["m"]
    last_day = F.col("ts").between(F.lit(border) - F.expr("interval 23 hours"), F.lit(border))
    late = last_day & (F.col("event_id") % 3 == 0)
    source, path = scratch_path(spark, "deliveries"), scratch_path(spark, "payment_changes")
    first = events.where((F.col("ts") <= border) & ~late)
    second = events.where((F.col("ts") > border) | late).unionByName(first.where(last_day & (F.col("event_id") % 5 == 0)))
    for name, part in (("first", first), ("second", second)):
        part.write.parquet(f"{source}/{name}")
        deliveries = spark.readStream.schema(events.schema).parquet(f"{source}/*")
        sink = changes.change_sink(webhook_events(deliveries), path, f"{path}-checkpoint", "1 day")
        sink.trigger(availableNow=True).start().awaitTermination()
    return changes.current_changes(spark, path, known_payments(spark, sf_dir))
