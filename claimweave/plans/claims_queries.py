"""Claims operators over the claims view."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.operators import claims as ops
from claimweave.plans.registry import Registry
from claimweave.plans.tables import CLAIM_COLUMNS, claims_sql, claims_view, table
from claimweave.session import cut_lineage, scratch_path
from claimweave.sources.readers import read_claims
from claimweave.sources.writers import write_table

REGISTRY = Registry.empty()
_KEY = ["claim_number"]
_ALL = list(CLAIM_COLUMNS)
_ROW_TIE = ["claim_number", "report_date", "gross_incurred", "net_paid"]
_DUP = ["product_category", "product_name", "claim_status", "accident_date", "destination", "loss_type"]
_CLAIM = ["claim_number", "product_name", "loss_type", "destination"]


def _sql(body: str, ctes: str = "") -> str:
    return f"WITH claims AS ({claims_sql()}){ctes} {body}"


def _d(expression: str, name: str) -> str:
    """A rounded double under a name."""
    return f"round(cast({expression} AS DOUBLE), 6) AS {name}"


def _date(expression: str, name: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d') AS {name}"


_ALL_SQL = ", ".join(
    _date(c, c) if c in ops.DATES else _d(c, c) if c in ops.MONEY else c for c in CLAIM_COLUMNS
)
_ROW_TIE_SQL = "claim_number, report_date, gross_incurred, net_paid"


def _add(name: str, columns: list[str], sql: str | None = None, ctes: str = ""):
    def register(operator):
        @REGISTRY.add(name, _sql(sql, ctes) if sql else None)
        def query(spark, sf_dir):
            return operator(claims_view(spark, sf_dir, columns))

        return operator

    return register


_TYPES = {**{c: "string" for c in CLAIM_COLUMNS}, **{c: "date" for c in ops.DATES}, **{c: "decimal(10,2)" for c in ops.MONEY}}
_add(
    "b01_profile",
    _ALL,
    " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS ordinal_position, '{c}' AS column_name, '{_TYPES[c]}' AS data_type, count(*) - count({c}) AS nulls FROM claims"
        for i, c in enumerate(CLAIM_COLUMNS, 1)
    ),
)(lambda df: ops.profile(df).drop("is_nullable"))

_LINKS = {"order": ("lineitem", "l_orderkey", "orders", "o_orderkey"), "customer": ("orders", "o_custkey", "customer", "c_custkey"), "nation": ("customer", "c_nationkey", "nation", "n_nationkey")}


@REGISTRY.add(
    "b02_orphans",
    " UNION ALL ".join(f"SELECT '{n}' AS missing, count(*) AS orphans FROM {child} WHERE {key} IS NULL OR {key} NOT IN (SELECT {own} FROM {parent})" for n, (child, key, parent, own) in _LINKS.items()),
)
def orphans(spark, sf_dir):
    """Rows without the row they point to. The claims view leaves out joins none of whose columns are asked for; that is right while all of these are 0."""
    found = []
    for missing, (child, key, parent, own) in _LINKS.items():
        lost = table(spark, sf_dir, child).select(key).join(table(spark, sf_dir, parent).select(own), F.col(key) == F.col(own), "left_anti")
        found.append(lost.agg(F.lit(missing).alias("missing"), F.count("*").alias("orphans")))
    return reduce(DataFrame.unionByName, found).select("missing", "orphans")


_add("b02_row_count", _KEY, "SELECT count(*) AS exact_rows FROM claims")(ops.row_count)
_add("b03_first_n", _ALL, f"SELECT {_ALL_SQL} FROM claims ORDER BY {_ROW_TIE_SQL} LIMIT 10")(lambda df: ops.first_n(df, _ROW_TIE))
_add("b04_random_n", _ALL)(lambda df: ops.random_n(df, _ROW_TIE))


@REGISTRY.add("b04_random_n_properties", "SELECT least(count(*), 20) AS drawn, least(count(*), 20) AS members, least(count(*), 20) AS again FROM lineitem")
def random_n_properties(spark, sf_dir):
    """How many rows are drawn, how many of them are claims, and how many are drawn again from the claims in another order."""
    claims = claims_view(spark, sf_dir)
    # Dealt by a hash of the key, so that the order changes in as many tasks as the session has, and no task sorts.
    other = claims.repartition(F.xxhash64("claim_number"))
    tagged = cut_lineage(reduce(DataFrame.union, [ops.random_n(df, _ROW_TIE).select("claim_number", F.lit(t).alias("t")) for t, df in (("drawn", claims), ("again", other))]))
    per = tagged.groupBy("claim_number").agg(*[F.count_if(F.col("t") == t).alias(t) for t in ("drawn", "again")])
    # Forty keys at most visit the claims.
    found = claims.select("claim_number").join(F.broadcast(per.select("claim_number")), "claim_number").groupBy("claim_number").agg(F.count("*").alias("claim"))
    per = per.join(F.broadcast(found), "claim_number", "left")
    both = lambda other: F.coalesce(F.sum(F.when(F.col(other) > 0, F.col("drawn"))), F.lit(0)).alias({"claim": "members"}.get(other, other))
    return per.agg(F.sum("drawn").alias("drawn"), both("claim"), both("again"))


_PROFILED = ["product_category", "claim_status", "closed_date", "net_paid", "loss_type"]
_add(
    "b01_profile_distinct",
    _PROFILED,
    " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS ordinal_position, '{c}' AS column_name, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values FROM claims" for i, c in enumerate(_PROFILED, 1)
    ),
)(lambda df: ops.profile(df, "exact").select("ordinal_position", "column_name", "nulls", "distinct_values"))

_DISTINCT = ["product_category", "product_name", "claim_status", "loss_type", "destination"]
_add("b05_distinct_counts", _DISTINCT, "SELECT " + ", ".join(f"count(DISTINCT {c}) AS n_{c}" for c in _DISTINCT) + " FROM claims")(
    lambda df: ops.distinct_counts(df, _DISTINCT)
)
_add("b06_distinct_values", ["claim_status"], "SELECT DISTINCT claim_status FROM claims")(lambda df: ops.distinct_values(df, "claim_status"))
for _name, _column, _k in (
    ("b07_top_loss_types", "loss_type", 20),
    ("b07_top_destinations", "destination", 20),
    ("b07_claims_by_status", "claim_status", None),
):
    _limit = f" ORDER BY n DESC, {_column} LIMIT {_k}" if _k else ""
    _add(_name, [_column], f"SELECT {_column}, count(*) AS n FROM claims GROUP BY {_column}{_limit}")(
        lambda df, _column=_column, _k=_k: ops.top_values(df, _column, _k)
    )
_add("b08_null_counts", _ALL, "SELECT " + ", ".join(f"count(*) - count({c}) AS null_{c}" for c in CLAIM_COLUMNS) + " FROM claims")(
    lambda df: ops.null_counts(df, CLAIM_COLUMNS)
)
_PCT = ["claim_status", "closed_date", "destination"]
_add(
    "b09_null_pct",
    _PCT,
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(100.0 * CAST(count(*) - count({c}) AS DOUBLE) / count(*), 6) AS pct_null FROM claims" for c in _PCT
    ),
)(lambda df: ops.null_pct(df, _PCT))

_add(
    "b10_overall_stats",
    ops.MONEY,
    "SELECT count(*) AS n_claims, "
    + ", ".join(_d(f"sum({m})", f"sum_{m}") for m in ops.MONEY)
    + f", {_d('avg(CAST(net_paid AS DOUBLE))', 'avg_net_paid')}, "
    + ", ".join(_d(f"quantile_cont(coalesce(CAST(net_paid AS DOUBLE), 0), {p / 100})", f"p{p}_net_paid") for p in (50, 90))
    + " FROM claims",
)(ops.overall_stats)
STATS_BY_SQL = _sql(
    f"SELECT loss_type, count(*) AS n, {_d('avg(CAST(net_paid AS DOUBLE))', 'avg_net_paid')}, "
    + ", ".join(_d(f"quantile_cont(CAST(net_paid AS DOUBLE), {p / 100})", f"p{p}") for p in (50, 90))
    + f", {_d('sum(net_paid)', 'sum_net_paid')} FROM claims GROUP BY loss_type"
)


@REGISTRY.add("b11_stats_by", STATS_BY_SQL)
def stats_by_loss_type(spark, sf_dir):
    return ops.stats_by(claims_view(spark, sf_dir, ["loss_type", "net_paid"]), "loss_type", "net_paid")


@REGISTRY.add(
    "b11_merged_sketches",
    _sql(f"SELECT loss_type, count(net_paid) AS n, {_d('sum(net_paid)', 'sum')}, {_d('avg(CAST(net_paid AS DOUBLE))', 'avg')}, true AS p50_near, true AS p90_near FROM claims GROUP BY loss_type"),
)
def merged_sketches(spark, sf_dir):
    """Sketches stored by month and loss type, merged per loss type; the ranks of what they give are within 2 % of those asked for."""
    claims = claims_view(spark, sf_dir, ["loss_type", "report_date", "net_paid"])
    stored = cut_lineage(ops.sketch_stats(claims.withColumn("month", F.trunc("report_date", "month")), ["month", "loss_type"], "net_paid"))
    found = ops.merged_stats(stored, ["loss_type"])
    value = F.col("net_paid").cast("double")
    # The rows below and up to each answer enclose its rank.
    ranks = claims.join(found.select(F.col("loss_type").alias("_k"), "p50", "p90"), F.col("loss_type").eqNullSafe(F.col("_k"))).groupBy("_k").agg(
        *[f.alias(f"{side}{p}") for p in (50, 90) for side, f in (("under", F.count_if(value < F.col(f"p{p}"))), ("upto", F.count_if(value <= F.col(f"p{p}"))))], F.count("net_paid").alias("_n")
    )
    near = lambda p: (F.col(f"under{p}") <= (p / 100 + 0.02) * F.col("_n")) & (F.col(f"upto{p}") >= (p / 100 - 0.02) * F.col("_n"))
    return found.join(ranks, F.col("loss_type").eqNullSafe(F.col("_k"))).select("loss_type", "n", "sum", "avg", near(50).alias("p50_near"), near(90).alias("p90_near"))


_add(
    "b12_coverage_period",
    ops.DATES,
    "SELECT " + ", ".join(_date(f"{f}({c})", f"{f}_{c}") for c in ops.DATES for f in ("min", "max")) + " FROM claims",
)(ops.coverage_period)
_add("b13_count_by_month", ["report_date"], f"SELECT {_date('date_trunc(\'month\', report_date)', 'month')}, count(*) AS n_claims FROM claims GROUP BY 1")(
    lambda df: ops.count_by_month(df, "report_date")
)
_add(
    "b14_sum_by_month",
    ["report_date", "net_paid", "net_incurred"],
    f"SELECT {_date('date_trunc(\'month\', report_date)', 'month')}, {_d('sum(net_paid)', 'sum_net_paid')}, {_d('sum(net_incurred)', 'sum_net_incurred')} FROM claims GROUP BY 1",
)(lambda df: ops.sum_by_month(df, "report_date", ["net_paid", "net_incurred"]))
_add(
    "b15_longest_durations",
    ["claim_number", *ops.DATES],
    "SELECT claim_number, " + ", ".join(_date(c, c) for c in ops.DATES)
    + ", report_date - accident_date AS days_to_report, closed_date - report_date AS days_to_close FROM claims "
    "WHERE accident_date IS NOT NULL AND report_date IS NOT NULL ORDER BY days_to_report DESC, claim_number, days_to_close DESC NULLS LAST LIMIT 50",
)(ops.longest_durations)
_add(
    "b16_durations_by",
    ["loss_type", *ops.DATES],
    f"SELECT loss_type, {_d('avg(report_date - accident_date)', 'avg_days_to_report')}, {_d('avg(closed_date - report_date)', 'avg_days_to_close')} "
    "FROM claims WHERE report_date IS NOT NULL AND accident_date IS NOT NULL GROUP BY loss_type",
)(lambda df: ops.durations_by(df, "loss_type"))
# Some reserves are released further than they reached.
_RELEASED = ", released AS (SELECT * REPLACE (CAST(net_reserve - 500 AS DECIMAL(10,2)) AS net_reserve, CASE WHEN loss_type = 'N' AND net_paid > 60000 THEN -net_paid ELSE net_paid END AS net_paid) FROM claims)"


@REGISTRY.add("b17_negative_amounts", _sql(f"SELECT {_ALL_SQL} FROM released WHERE coalesce(net_paid,0) < 0 OR coalesce(net_incurred,0) < 0 OR coalesce(net_reserve,0) < 0", _RELEASED))
def negative_amounts(spark, sf_dir):
    claims = claims_view(spark, sf_dir)
    back = F.when((F.col("loss_type") == "N") & (F.col("net_paid") > 60000), -F.col("net_paid")).otherwise(F.col("net_paid"))
    return ops.negative_amounts(claims.withColumns({"net_reserve": (F.col("net_reserve") - 500).cast("decimal(10,2)"), "net_paid": back}))


_add("b18_closed_with_reserve", _ALL, f"SELECT {_ALL_SQL} FROM claims WHERE claim_status ILIKE 'closed%' AND coalesce(net_reserve,0) > 0")(
    ops.closed_with_reserve
)
_add("b19_report_before_accident", _ALL, f"SELECT {_ALL_SQL} FROM claims WHERE report_date < accident_date")(ops.report_before_accident)
@REGISTRY.add(
    "b20_top_rows",
    _sql(
        f"SELECT claim_number, product_name, loss_type, destination, {_d('c.net_paid', 'net_paid')} FROM claims c "
        "ORDER BY c.net_paid DESC NULLS LAST, claim_number, loss_type LIMIT 20"
    ),
)
def top_rows(spark, sf_dir):
    """The order needs lineitem alone, so the twenty rows are found first and joined then."""
    order = ["net_paid", "claim_number", "loss_type"]
    top = ops.top_rows(claims_view(spark, sf_dir, order), "net_paid", order, ["claim_number", "loss_type"])
    top = top.withColumn("_order", F.split("claim_number", "-")[0].cast("bigint"))
    # Twenty rows, so each table is scanned once for its own columns and nothing is shuffled.
    found = table(spark, sf_dir, "orders").join(F.broadcast(top), F.col("o_orderkey") == F.col("_order"))
    found = table(spark, sf_dir, "customer").join(F.broadcast(found), F.col("c_custkey") == F.col("o_custkey"))
    found = table(spark, sf_dir, "nation").join(F.broadcast(found), F.col("n_nationkey") == F.col("c_nationkey"))
    return found.select("claim_number", F.col("o_orderpriority").alias("product_name"), "loss_type", F.col("n_name").alias("destination"), "net_paid")


_add(
    "b21_top_groups",
    ["destination", "net_paid"],
    f"SELECT destination, {_d('sum(c.net_paid)', 'sum_net_paid')}, count(*) AS n FROM claims c GROUP BY destination ORDER BY sum(c.net_paid) DESC NULLS LAST, destination LIMIT 10",
)(lambda df: ops.top_groups(df, "destination", "net_paid"))
_add(
    "b22_status_matrix",
    ["loss_type", "claim_status"],
    "SELECT loss_type, CAST(sum(CASE WHEN claim_status ILIKE 'open%' THEN 1 ELSE 0 END) AS BIGINT) AS open_cnt, "
    "CAST(sum(CASE WHEN claim_status ILIKE 'closed%' THEN 1 ELSE 0 END) AS BIGINT) AS closed_cnt, count(*) AS total FROM claims GROUP BY loss_type",
)(lambda df: ops.status_matrix(df, "loss_type"))
_add(
    "b23_histogram",
    ["net_paid"],
    "SELECT CAST(CASE WHEN net_paid < 0 THEN 0 WHEN net_paid >= 10000 THEN 11 ELSE floor(net_paid / 1000) + 1 END AS BIGINT) AS bucket, "
    f"{_d('min(net_paid)', 'bucket_min')}, {_d('max(net_paid)', 'bucket_max')}, count(*) AS n FROM claims WHERE net_paid IS NOT NULL GROUP BY 1",
)(lambda df: ops.histogram(df, "net_paid", 0, 10_000, 10))
@REGISTRY.add(
    "b24_outliers",
    _sql(
        f"SELECT {_ALL_SQL.replace(' net_paid)', ' c.net_paid)')} FROM claims c WHERE CAST(c.net_paid AS DOUBLE) > (SELECT quantile_cont(CAST(net_paid AS DOUBLE), 0.99) FROM claims) "
        "ORDER BY c.net_paid DESC, c.claim_number, c.report_date, c.gross_incurred LIMIT 100"
    ),
)
def outliers(spark, sf_dir):
    measured = claims_view(spark, sf_dir, ["net_paid"])
    return ops.outliers(claims_view(spark, sf_dir), "net_paid", ["claim_number", "report_date", "gross_incurred"], measured=measured)


_add(
    "b25_mean_ratio",
    ["net_paid", "net_incurred"],
    f"SELECT {_d('avg(nullif(CAST(net_paid AS DOUBLE), 0) / nullif(CAST(net_incurred AS DOUBLE), 0))', 'avg_paid_to_incurred_ratio')} FROM claims",
)(lambda df: ops.mean_ratio(df, "net_paid", "net_incurred", "avg_paid_to_incurred_ratio"))
_add(
    "b26_reserve_adequacy",
    ["loss_type", "net_incurred", "net_paid", "net_reserve"],
    f"SELECT loss_type, {_d('sum(net_incurred)', 'incurred')}, {_d('sum(net_paid)', 'paid')}, {_d('sum(net_reserve)', 'reserve')}, "
    f"{_d('CASE WHEN sum(net_incurred) > 0 THEN CAST(sum(net_reserve) AS DOUBLE) / CAST(sum(net_incurred) AS DOUBLE) END', 'reserve_to_incurred_ratio')} FROM claims GROUP BY loss_type",
)(lambda df: ops.reserve_adequacy(df, "loss_type"))
_add("b27_duplicate_keys", _KEY, "SELECT claim_number, count(*) AS n FROM claims GROUP BY claim_number HAVING count(*) > 1")(
    lambda df: ops.duplicate_keys(df, "claim_number")
)
_add(
    "b28_duplicate_rows",
    _DUP,
    f"SELECT {', '.join(_date(f'c.{c}', c) if c in ops.DATES else c for c in _DUP)}, count(*) AS n FROM claims c GROUP BY ALL HAVING count(*) > 1 "
    f"ORDER BY n DESC, {', '.join(_DUP)} LIMIT 50",
)(lambda df: ops.duplicate_rows(df, _DUP))
_add(
    "b29_kpis_by",
    ["product_name", "net_paid"],
    f"SELECT product_name, count(*) AS n_claims, {_d('sum(net_paid)', 'sum_net_paid')}, {_d('avg(CAST(net_paid AS DOUBLE))', 'avg_net_paid')} FROM claims GROUP BY product_name",
)(lambda df: ops.kpis_by(df, "product_name", "net_paid"))
_add(
    "b30_heat",
    ["destination", "loss_type"],
    "SELECT destination, loss_type, count(*) AS n FROM claims GROUP BY destination, loss_type ORDER BY n DESC, destination, loss_type LIMIT 200",
)(lambda df: ops.heat(df, "destination", "loss_type"))
_add(
    "b31_open_closed_by_month",
    ["claim_status", "closed_date", "report_date"],
    f"SELECT {_date('date_trunc(\'month\', coalesce(closed_date, report_date))', 'month')}, "
    "CAST(sum(CASE WHEN claim_status ILIKE 'open%' THEN 1 ELSE 0 END) AS BIGINT) AS open_cnt, "
    "CAST(sum(CASE WHEN claim_status ILIKE 'closed%' THEN 1 ELSE 0 END) AS BIGINT) AS closed_cnt FROM claims GROUP BY 1",
)(ops.open_closed_by_month)
_add(
    "b32_triage",
    [*_CLAIM, "claim_status", "net_reserve"],
    f"SELECT claim_number, product_name, loss_type, destination, {_d('c.net_reserve', 'net_reserve')} FROM claims c "
    "WHERE claim_status ILIKE 'open%' AND coalesce(c.net_reserve,0) > 0 ORDER BY c.net_reserve DESC, claim_number, loss_type LIMIT 50",
)(lambda df: ops.triage(df, [*_CLAIM, "net_reserve"], ["claim_number", "loss_type"]))


@REGISTRY.add("b33_report")
def report(spark, sf_dir):
    """The report reads its table many times, so the joined view is written once."""
    path = scratch_path(spark, "claims")
    write_table(claims_view(spark, sf_dir), path)
    return ops.report(read_claims(spark, path))


_add(
    "b34_lifecycle_days",
    ["claim_number", *ops.DATES],
    "SELECT claim_number, " + ", ".join(_date(c, c) for c in ops.DATES)
    + ", report_date - accident_date AS reporting_lag, closed_date - report_date AS settlement_duration, closed_date - accident_date AS total_lifecycle FROM claims",
)(ops.lifecycle_days)

_CHECKS = (
    ("gross_incurred_is_paid_plus_reserve", "gross_incurred <> gross_paid + gross_reserve"),
    ("net_incurred_is_paid_plus_reserve", "net_incurred <> net_paid + net_reserve"),
    ("net_incurred_within_gross", "net_incurred > gross_incurred"),
    ("net_paid_within_gross", "net_paid > gross_paid"),
    ("net_reserve_within_gross", "net_reserve > gross_reserve"),
    ("report_not_before_accident", "report_date < accident_date"),
    ("closed_not_before_report", "closed_date < report_date"),
)
_add(
    "b35_amount_checks",
    _ALL,
    "SELECT * FROM (SELECT claim_number, "
    + _d("gross_incurred", "gross_incurred")
    + ", concat_ws(',', "
    + ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in _CHECKS)
    + ") AS violations FROM claims) WHERE violations <> ''",
)(lambda df: ops.amount_checks(df).select("claim_number", "gross_incurred", F.array_join("violations", ",").alias("violations")))
_add("b36_keyword_filter", ["destination", "loss_type"], "SELECT destination, loss_type FROM claims WHERE destination ILIKE '%1%'")(
    lambda df: ops.keyword_filter(df, "destination", "1")
)

TOPICS = {
    "by_status": "SELECT claim_status, count(*) AS n FROM claims GROUP BY claim_status",
    "big_reserves": "SELECT claim_number FROM claims WHERE net_reserve > 5000",
    "broken": "SELECT no_such_column FROM claims",
    "command": "CREATE OR REPLACE TEMP VIEW claims AS SELECT 1",
    "nothing": "SELECT claim_number FROM claims WHERE net_reserve < 0 AND net_reserve > 0",
}


@REGISTRY.add(
    "b37_run_queries",
    _sql(
        "SELECT 'by_status' AS topic, 'ok' AS status, count(DISTINCT claim_status) AS row_count FROM claims "
        "UNION ALL SELECT 'big_reserves', 'ok', count(*) FROM claims WHERE net_reserve > 5000 "
        "UNION ALL SELECT 'broken', 'error', NULL UNION ALL SELECT 'command', 'error', NULL UNION ALL SELECT 'nothing', 'ok', 0"
    ),
)
def run_topics(spark, sf_dir):
    return ops.run_queries(spark, claims_view(spark, sf_dir), TOPICS).select("topic", "status", "row_count")


_add(
    "b38_destination_summary",
    ["destination", "claim_type", "net_incurred"],
    f"SELECT t.destination, n_claims, {_d('avg_amount', 'avg_amount')}, top_types FROM "
    "(SELECT destination, count(*) AS n_claims, avg(CAST(net_incurred AS DOUBLE)) AS avg_amount FROM claims GROUP BY destination) t JOIN "
    "(SELECT destination, string_agg(claim_type || ':' || n || ':' || printf('%.2f', pct), '|' ORDER BY rk) AS top_types FROM "
    "(SELECT destination, claim_type, n, round(100.0 * n / sum(n) OVER (PARTITION BY destination), 2) AS pct, "
    "row_number() OVER (PARTITION BY destination ORDER BY n DESC, claim_type) AS rk FROM pairs) WHERE rk <= 3 GROUP BY destination) r "
    "ON t.destination = r.destination",
    ", pairs AS (SELECT destination, claim_type, count(*) AS n FROM claims GROUP BY 1, 2)",
)(
    lambda df: ops.destination_summary(df).withColumn(
        "top_types",
        F.array_join(F.transform("top_types", lambda t: F.concat_ws(":", t["type"], t["count"], F.format_string("%.2f", t["percent"]))), "|"),
    )
)
