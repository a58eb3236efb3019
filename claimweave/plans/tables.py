"""The given tables and the claims-shaped view over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.session import broadcast_within_threshold, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Claims columns as expressions both engines read alike.
_CLAIMS = {
    "claim_number": "concat(cast(l_orderkey as {text}), '-', cast(l_linenumber as {text}))",
    "product_category": "c_mktsegment",
    "product_name": "o_orderpriority",
    "claim_status": "case o_orderstatus when 'O' then 'Open' when 'F' then 'Closed' else 'Pending' end",
    "accident_date": "cast(o_orderdate as date)",
    "report_date": "cast(l_shipdate as date)",
    "closed_date": "case when o_orderstatus = 'F' then {closed} end",
    "destination": "n_name",
    "claim_type": "l_linestatus",
    "cause_of_loss": "case when l_returnflag <> 'A' then o_orderpriority end",
    "loss_type": "l_returnflag",
    "gross_incurred": "incurred",
    "gross_paid": "paid",
    "gross_reserve": "cast(incurred - paid as decimal(10,2))",
    "net_incurred": "cast(round(incurred * 0.8, 2) as decimal(10,2))",
    "net_paid": "case when l_returnflag <> 'A' or l_linenumber <> 1 then cast(round(paid * 0.8, 2) as decimal(10,2)) end",
    "net_reserve": "cast(round((incurred - paid) * 0.8, 2) as decimal(10,2))",
}
# Amounts every money column builds on, computed once per row below the view.
_AMOUNTS = {
    "incurred": "cast(l_extendedprice as decimal(10,2))",
    "paid": "cast(round(cast(l_extendedprice as decimal(10,2)) * (1 - cast(l_discount as decimal(4,2))), 2) as decimal(10,2))",
}
CLAIM_COLUMNS = list(_CLAIMS)
# From this many columns on, building the rows costs more than moving them.
_WIDE = 8


def _expression(name: str, text: str, closed: str) -> str:
    return _CLAIMS[name].format(text=text, closed=closed)


def claims_view(spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Claims over lineitem, orders, customer and nation; ``columns`` picks a subset.

    Every line has one order, every order one customer and every customer one
    nation, so a table none of whose columns is asked for is left out of the
    join: most statistics then read lineitem alone.
    """
    names = list(columns) if columns else CLAIM_COLUMNS
    used = {name: _expression(name, "string", "date_add(cast(l_shipdate as date), cast(l_quantity as int))") for name in names}
    text = " ".join(used.values())
    lines = table(spark, sf_dir, "lineitem")
    if len(names) > _WIDE:
        lines = spread(lines)
    base = lines.withColumns({name: F.expr(amount) for name, amount in _AMOUNTS.items() if name in text})
    needs_customer = "c_" in text or "n_name" in text
    if needs_customer or "o_" in text:
        # The dimensions meet first, so the lines are shuffled once at most.
        dimension = orders = table(spark, sf_dir, "orders")
        scans = [orders]
        if needs_customer:
            customer = table(spark, sf_dir, "customer")
            scans.append(customer)
            if "n_name" in text:
                nation = table(spark, sf_dir, "nation")
                scans.append(nation)
                customer = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            dimension = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        base = base.join(broadcast_within_threshold(dimension, *scans), F.col("l_orderkey") == F.col("o_orderkey"))
    return base.selectExpr(*[f"{expression} AS {name}" for name, expression in used.items()])


def claims_sql() -> str:
    """The same view for the SQL oracles."""
    columns = ", ".join(
        f"{_expression(name, 'varchar', 'cast(l_shipdate as date) + cast(l_quantity as integer)')} AS {name}" for name in CLAIM_COLUMNS
    )
    return (
        f"SELECT {columns} FROM (SELECT *, {', '.join(f'{amount} AS {name}' for name, amount in _AMOUNTS.items())} FROM lineitem) JOIN orders ON l_orderkey = o_orderkey "
        "JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
    )
