"""Payments, quotes and selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions.arrays import names_where

_OFFER = "struct<id:string,productCode:string,unitPrice:double,currency:string>"
_RESPONSE = f"struct<offerCategories:array<struct<offers:array<{_OFFER}>>>>"
_CURRENCY = "SGD"


def _newest_first() -> list[Column]:
    return [F.col("created_at").desc_nulls_last(), F.col("payment_intent_id").asc()]


def _latest(payments: DataFrame, key: str, n: int) -> DataFrame:
    # The rank filter is applied per task before the shuffle too, so a key with
    # very many payments sends n rows per task.
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*_newest_first()))
    return payments.withColumn("rank", rank).filter(F.col("rank") <= n)


def latest_per_user(payments: DataFrame, n: int = 10, user_id: object = None) -> DataFrame:
    """The last ``n`` payments of every user, or of one."""
    chosen = payments if user_id is None else payments.filter(F.col("user_id") == user_id)
    return _latest(chosen, "user_id", n)


def latest_per_quote(payments: DataFrame) -> DataFrame:
    """The newest payment of each quote."""
    return _latest(payments.filter(F.col("quote_id").isNotNull()), "quote_id", 1).drop("rank")


def by_status(payments: DataFrame, status: str, n: int = 100) -> DataFrame:
    """Newest payments in one status: filter first, then limit."""
    return payments.filter(F.col("payment_status") == status).orderBy(*_newest_first()).limit(n)


def status_counts(payments: DataFrame) -> DataFrame:
    return payments.groupBy(F.coalesce("payment_status", F.lit("unknown")).alias("payment_status")).agg(F.count(F.lit(1)).alias("n"))


def lookup(payments: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Payments by payment, quote or session key; ``wanted`` holds the keys under the same name."""
    return payments.join(wanted.select(key).distinct(), key, "left_semi")


# --- quotes and selections -----------------------------------------------------


def _offers(response: str | Column) -> Column:
    """Offers of the first category; an empty array when there are none."""
    parsed = F.from_json(response, _RESPONSE)
    return F.coalesce(F.get(parsed["offerCategories"], 0)["offers"], F.array().cast(f"array<{_OFFER}>"))


def quote_summary(quotes: DataFrame) -> DataFrame:
    """Adds ``offers`` and the first offer's product, price and currency, with defaults."""
    first = F.get("offers", 0)
    return quotes.withColumn("offers", _offers("quotation_response")).withColumns(
        {
            "product_code": first["productCode"],
            "unit_price": F.coalesce(first["unitPrice"], F.lit(0.0)),
            "currency": F.coalesce(first["currency"], F.lit(_CURRENCY)),
        }
    )


def quote_offers(quotes: DataFrame) -> DataFrame:
    """One row per offer of the first category; a quote without offers keeps one empty row."""
    rows = quotes.select("quote_id", F.posexplode_outer(_offers("quotation_response")).alias("offer_index", "_o"))
    return rows.select(
        "quote_id", "offer_index", F.col("_o.id").alias("offer_id"), F.col("_o.productCode").alias("product_code"),
        F.when(F.col("_o").isNotNull(), F.coalesce("_o.unitPrice", F.lit(0.0))).alias("unit_price"),
        F.when(F.col("_o").isNotNull(), F.coalesce("_o.currency", F.lit(_CURRENCY))).alias("currency"),
    )


def _left_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join in which rows without a key meet nothing and so are not dealt by it."""
    keyed = left.filter(F.col(key).isNotNull()).join(right, key, "left")
    added = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields if f.name != key]
    return keyed.unionByName(left.filter(F.col(key).isNull()).select("*", *added))


def selection_view(selections: DataFrame, quotes: DataFrame) -> DataFrame:
    """Selections with their quote's response and offers."""
    quoted = quotes.select("quote_id", "quotation_response", _offers("quotation_response").alias("offers"))
    return _left_join(selections, quoted, "quote_id")


def selected_offer(selections: DataFrame, quotes: DataFrame, payments: DataFrame) -> DataFrame:
    """The chosen offer of each selection, with its status.

    When the quote does not hold the offer, product and price come from the
    selection, then from the payment (cents / 100).
    """
    paid = payments.select(F.col("payment_intent_id").alias("payment_id"), "amount", F.col("currency").alias("_currency"))
    joined = _left_join(selection_view(selections, quotes), paid, "payment_id")
    chosen = F.get(F.filter("offers", lambda o: o["id"] == F.col("selected_offer_id")), 0)
    found = F.col("_o").isNotNull()
    return joined.withColumn("_o", chosen).select(
        "selection_id", "quote_id", "payment_id", "selected_offer_id",
        F.when(found, F.col("_o.productCode")).otherwise(F.col("selected_product_code")).alias("product_code"),
        F.when(found, F.coalesce("_o.unitPrice", F.lit(0.0)))
        .otherwise(F.coalesce(F.nullif("total_price", F.lit(0.0)), F.col("amount") / F.lit(100.0)))
        .alias("unit_price"),
        F.when(found, F.coalesce("_o.currency", F.lit(_CURRENCY))).otherwise(F.col("_currency")).alias("currency"),
        F.when(F.coalesce("payment_id", F.lit("")) != "", "pending_payment").otherwise("draft").alias("status"),
    )


def payable_quotes(quotes: DataFrame, payments: DataFrame, blocking: Sequence[str] = ("completed", "pending")) -> DataFrame:
    """Quotes whose newest payment is neither completed nor pending."""
    taken = latest_per_quote(payments).filter(F.col("payment_status").isin(*blocking))
    return quotes.join(taken.select("quote_id"), "quote_id", "left_anti")


def _blank(column: str) -> Column:
    return F.coalesce(F.trim(F.col(column)), F.lit("")).isin("", "[]", "{}", "null")


def purchase_checks(payments: DataFrame, selections: DataFrame) -> DataFrame:
    """Per payment: the reasons it cannot be completed, and whether it is ready.

    A payment without a selection only has to be completed.
    """
    needed = ["quote_id", "selected_offer_id", "insureds", "main_contact"]
    chosen = selections.filter(F.col("payment_id").isNotNull()).select(
        "selection_id", "payment_id", *[_blank(c).alias(f"_no_{c}") for c in needed]
    )
    joined = payments.select("payment_intent_id", "payment_status").join(chosen, F.col("payment_intent_id") == F.col("payment_id"), "left")
    reasons = names_where(
        {
            "payment_not_completed": F.coalesce("payment_status", F.lit("")) != "completed",
            **{f"missing_{c}": F.col(f"_no_{c}") for c in needed},
        }
    )
    return joined.select("payment_intent_id", "selection_id", reasons.alias("reasons")).withColumn("ready", F.size("reasons") == 0)


def policy_records(payments: DataFrame, selections: DataFrame) -> DataFrame:
    """A policy row per completed payment with a selection; the premium is cents / 100.

    The id follows from payment and selection, so a rerun gives the same rows.
    """
    completed = payments.filter(F.col("payment_status") == "completed").select(
        "payment_intent_id", "user_id", "quote_id", "amount", "currency"
    )
    chosen = selections.select("selection_id", "payment_id", "selected_offer_id", "selected_product_code")
    return completed.join(chosen, F.col("payment_intent_id") == F.col("payment_id")).select(
        F.concat(F.lit("pol_"), F.left(F.sha2(F.concat_ws("|", "payment_intent_id", "selection_id"), 256), F.lit(12))).alias("policy_id"),
        "selection_id", "user_id", "quote_id", "payment_id",
        F.coalesce("selected_offer_id", F.lit("")).alias("purchased_offer_id"),
        F.coalesce("selected_product_code", F.lit("")).alias("product_code"),
        (F.col("amount") / F.lit(100.0)).alias("premium_amount"), "currency", F.lit("active").alias("status"),
    )
