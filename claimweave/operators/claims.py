"""Profiling and analytics over a claims fact table.

Column names are parameters, so the operators run on any fact table. Every
top-k carries a tie-break key, every sort states where NULLs go, and every
aggregate is one pass with map-side combining.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.functions.arrays import names_where
from claimweave.functions.percentiles import exact_percentiles
from claimweave.session import cut_lineage

MONEY = ["gross_incurred", "gross_paid", "gross_reserve", "net_incurred", "net_paid", "net_reserve"]
DATES = ["accident_date", "report_date", "closed_date"]


def _count() -> Column:
    return F.count(F.lit(1))


def _starts(column: str, prefix: str) -> Column:
    """Case-insensitive prefix test."""
    return F.col(column).ilike(f"{prefix}%")


def _count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("bigint")


def _days(later: str, earlier: str) -> Column:
    return F.datediff(F.col(later), F.col(earlier)).cast("bigint")


def _month(column: Column) -> Column:
    return F.trunc(column, "month")


def _avg(column: str | Column) -> Column:
    return F.avg((F.col(column) if isinstance(column, str) else column).cast("double"))


def _top(df: DataFrame, order: Sequence[Column], k: int | None) -> DataFrame:
    ordered = df.orderBy(*order)
    return ordered.limit(k) if k is not None else ordered


# --- profile and samples -------------------------------------------------------


def profile(df: DataFrame, distinct: str | None = None) -> DataFrame:
    """Position, name, type, nullability and NULL count of every column.

    ``distinct`` adds a distinct count: ``"approx"`` by sketch, ``"exact"`` by
    expansion (each row is shuffled once per column), ``None`` for none.
    """
    counts = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        entry = [F.count_if(column.isNull()).alias("nulls")]
        if distinct == "approx":
            entry.append(F.approx_count_distinct(column).alias("distinct_values"))
        elif distinct == "exact":
            entry.append(F.count_distinct(column).alias("distinct_values"))
        counts.append(F.struct(*entry).alias(field.name))
    single = df.agg(*counts)
    rows = [
        F.struct(
            F.lit(position).cast("bigint").alias("ordinal_position"),
            F.lit(field.name).alias("column_name"),
            F.lit(field.dataType.simpleString()).alias("data_type"),
            F.lit(field.nullable).alias("is_nullable"),
            F.col(f"`{field.name}`.nulls").alias("nulls"),
            *([F.col(f"`{field.name}`.distinct_values").alias("distinct_values")] if distinct else []),
        )
        for position, field in enumerate(df.schema.fields, 1)
    ]
    return single.select(F.inline(F.array(*rows)))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(_count().alias("exact_rows"))


def first_n(df: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(n)


def random_n(df: DataFrame, key: Sequence[str], n: int = 20, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows (or all), repeatable: the order is a hash of key and seed."""
    return df.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(n)


# --- distincts and missing values ----------------------------------------------


def distinct_counts(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """Distinct values of each column. The exact counts run over the distinct rows, so few rows are multiplied by columns."""
    count = F.approx_count_distinct if approx else F.count_distinct
    rows = df if approx else df.select(*columns).distinct()
    return rows.agg(*[count(F.col(c)).alias(f"n_{c}") for c in columns])


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def top_values(df: DataFrame, column: str, k: int | None = 20) -> DataFrame:
    counted = df.groupBy(column).agg(_count().alias("n"))
    return _top(counted, [F.desc("n"), F.col(column).asc_nulls_last()], k)


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns or df.columns])


def null_pct(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Percent NULL, one row per column, from a single scan."""
    single = df.agg(_count().alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.try_divide(F.lit(100.0) * F.col(c), F.col("_n").cast("double")).alias("pct_null"),
        )
        for c in columns
    ]
    return single.select(F.inline(F.array(*rows)))


# --- money statistics ----------------------------------------------------------


def overall_stats(
    df: DataFrame,
    sums: Sequence[str] = tuple(MONEY),
    measure: str = "net_paid",
    percents: Mapping[str, float] | None = None,
    null_as: float | None = 0.0,
) -> DataFrame:
    """Row count, sums, average and percentiles of the whole table.

    The percentiles count NULL as ``null_as``; ``None`` skips NULLs.
    """
    percents = dict(percents or {f"p50_{measure}": 0.5, f"p90_{measure}": 0.9})
    totals = [_count().alias("n_claims"), *[F.sum(c).alias(f"sum_{c}") for c in sums], _avg(measure).alias(f"avg_{measure}")]
    value = F.col(measure).cast("double")
    if null_as is not None:
        value = F.coalesce(value, F.lit(float(null_as)))
    return exact_percentiles(df, [], value, percents, totals)


def stats_by(
    df: DataFrame,
    key: str,
    measure: str,
    percents: Mapping[str, float] | None = None,
    approx: bool = False,
) -> DataFrame:
    """Count, average, percentiles and sum per group; NULLs skipped.

    ``approx`` takes the percentiles from one sketch per group in the same pass.
    """
    percents = dict(percents or {"p50": 0.5, "p90": 0.9})
    aggregates = [_count().alias("n"), _avg(measure).alias(f"avg_{measure}"), F.sum(measure).alias(f"sum_{measure}")]
    order = [F.col(f"sum_{measure}").desc_nulls_last(), F.col(key).asc_nulls_last()]
    names = [key, "n", f"avg_{measure}", *percents, f"sum_{measure}"]
    if approx:
        sketches = [F.percentile_approx(F.col(measure).cast("double"), p, 10_000).alias(name) for name, p in percents.items()]
        return df.groupBy(key).agg(*aggregates, *sketches).select(names).orderBy(*order)
    return exact_percentiles(df, [key], F.col(measure), percents, aggregates).select(names).orderBy(*order)


def sketch_stats(df: DataFrame, keys: Sequence[str], measure: str, k: int = 400) -> DataFrame:
    """Per group: ``n`` values of the measure, their ``sum`` and a mergeable KLL ``sketch``; NULLs skipped.

    Meant to be stored by fine keys, such as day and group, and merged on request: a rank read off a sketch is
    off by about 1.2 / k^0.9 of the rows, 0.7 % for 400, however many sketches were merged.
    """
    value = F.col(measure).cast("double")
    return df.where(F.col(measure).isNotNull()).groupBy(*keys).agg(_count().alias("n"), F.sum(measure).alias("sum"), F.kll_sketch_agg_double(value, k).alias("sketch"))


def merged_stats(sketches: DataFrame, keys: Sequence[str], percents: Mapping[str, float] | None = None) -> DataFrame:
    """Count, average, sum and approximate percentiles per coarser group, from stored sketches alone."""
    percents = dict(percents or {"p50": 0.5, "p90": 0.9})
    merged = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.kll_merge_agg_double("sketch").alias("_s"))
    quantiles = [F.kll_sketch_get_quantile_double("_s", F.lit(float(p))).alias(name) for name, p in percents.items()]
    return merged.select(*keys, "n", (F.col("sum").cast("double") / F.col("n")).alias("avg"), "sum", *quantiles)


def mean_ratio(df: DataFrame, numerator: str, denominator: str, name: str = "avg_ratio") -> DataFrame:
    """Average of row ratios; a zero on either side drops the row."""
    top, bottom = F.col(numerator).cast("double"), F.col(denominator).cast("double")
    return df.agg(F.avg(F.nullif(top, F.lit(0.0)) / F.nullif(bottom, F.lit(0.0))).alias(name))


def reserve_adequacy(
    df: DataFrame, key: str, incurred: str = "net_incurred", paid: str = "net_paid", reserve: str = "net_reserve"
) -> DataFrame:
    sums = df.groupBy(key).agg(F.sum(incurred).alias("incurred"), F.sum(paid).alias("paid"), F.sum(reserve).alias("reserve"))
    ratio = F.when(F.col("incurred") > 0, F.col("reserve").cast("double") / F.col("incurred").cast("double"))
    return sums.withColumn("reserve_to_incurred_ratio", ratio).orderBy(
        F.col("incurred").desc_nulls_last(), F.col(key).asc_nulls_last()
    )


def kpis_by(df: DataFrame, key: str, measure: str) -> DataFrame:
    return (
        df.groupBy(key)
        .agg(_count().alias("n_claims"), F.sum(measure).alias(f"sum_{measure}"), _avg(measure).alias(f"avg_{measure}"))
        .orderBy(F.col(f"sum_{measure}").desc_nulls_last(), F.col(key).asc_nulls_last())
    )


# --- time ----------------------------------------------------------------------


def coverage_period(df: DataFrame, dates: Sequence[str] = tuple(DATES)) -> DataFrame:
    return df.agg(*[f(c).alias(f"{name}_{c}") for c in dates for name, f in (("min", F.min), ("max", F.max))])


def count_by_month(df: DataFrame, date: str) -> DataFrame:
    return (
        df.groupBy(_month(F.col(date)).alias("month")).agg(_count().alias("n_claims")).orderBy(F.col("month").asc_nulls_last())
    )


def sum_by_month(df: DataFrame, date: str, measures: Sequence[str]) -> DataFrame:
    return (
        df.groupBy(_month(F.col(date)).alias("month"))
        .agg(*[F.sum(m).alias(f"sum_{m}") for m in measures])
        .orderBy(F.col("month").asc_nulls_last())
    )


def open_closed_by_month(
    df: DataFrame, status: str = "claim_status", closed: str = "closed_date", reported: str = "report_date"
) -> DataFrame:
    return (
        df.groupBy(_month(F.coalesce(F.col(closed), F.col(reported))).alias("month"))
        .agg(_count_if(_starts(status, "open")).alias("open_cnt"), _count_if(_starts(status, "closed")).alias("closed_cnt"))
        .orderBy(F.col("month").asc_nulls_last())
    )


def longest_durations(
    df: DataFrame, key: str = "claim_number", k: int = 50, accident: str = "accident_date", report: str = "report_date", closed: str = "closed_date"
) -> DataFrame:
    rows = df.filter(F.col(accident).isNotNull() & F.col(report).isNotNull()).select(
        key, accident, report, closed, _days(report, accident).alias("days_to_report"), _days(closed, report).alias("days_to_close")
    )
    return _top(rows, [F.desc("days_to_report"), F.asc(key), F.col("days_to_close").desc_nulls_last()], k)


def durations_by(
    df: DataFrame, key: str, accident: str = "accident_date", report: str = "report_date", closed: str = "closed_date"
) -> DataFrame:
    return (
        df.filter(F.col(report).isNotNull() & F.col(accident).isNotNull())
        .groupBy(key)
        .agg(_avg(_days(report, accident)).alias("avg_days_to_report"), _avg(_days(closed, report)).alias("avg_days_to_close"))
        .orderBy(F.col("avg_days_to_close").desc_nulls_last(), F.col(key).asc_nulls_last())
    )


def lifecycle_days(
    df: DataFrame, accident: str = "accident_date", report: str = "report_date", closed: str = "closed_date"
) -> DataFrame:
    """Adds reporting lag, settlement duration and total lifecycle in days."""
    return df.withColumns(
        {
            "reporting_lag": _days(report, accident),
            "settlement_duration": _days(closed, report),
            "total_lifecycle": _days(closed, accident),
        }
    )


# --- data quality --------------------------------------------------------------


def negative_amounts(df: DataFrame, columns: Sequence[str] = ("net_paid", "net_incurred", "net_reserve")) -> DataFrame:
    return df.filter(reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit(0)) < 0 for c in columns]))


def closed_with_reserve(df: DataFrame, status: str = "claim_status", reserve: str = "net_reserve") -> DataFrame:
    return df.filter(_starts(status, "closed") & (F.coalesce(F.col(reserve), F.lit(0)) > 0))


def report_before_accident(df: DataFrame, accident: str = "accident_date", report: str = "report_date") -> DataFrame:
    return df.filter(F.col(report) < F.col(accident))


def amount_checks(df: DataFrame) -> DataFrame:
    """Rows breaking the documented relations, with the broken ones named."""
    checks = {
        "gross_incurred_is_paid_plus_reserve": F.col("gross_incurred") != F.col("gross_paid") + F.col("gross_reserve"),
        "net_incurred_is_paid_plus_reserve": F.col("net_incurred") != F.col("net_paid") + F.col("net_reserve"),
        "net_incurred_within_gross": F.col("net_incurred") > F.col("gross_incurred"),
        "net_paid_within_gross": F.col("net_paid") > F.col("gross_paid"),
        "net_reserve_within_gross": F.col("net_reserve") > F.col("gross_reserve"),
        "report_not_before_accident": F.col("report_date") < F.col("accident_date"),
        "closed_not_before_report": F.col("closed_date") < F.col("report_date"),
    }
    return df.filter(reduce(lambda a, b: a | b, checks.values())).withColumn("violations", names_where(checks))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(_count().alias("n")).filter("n > 1").orderBy(F.desc("n"), F.col(key).asc_nulls_last())


def duplicate_rows(df: DataFrame, columns: Sequence[str], k: int = 50) -> DataFrame:
    repeated = df.groupBy(*columns).agg(_count().alias("n")).filter("n > 1")
    return _top(repeated, [F.desc("n"), *[F.col(c).asc_nulls_last() for c in columns]], k)


# --- rankings and crosstabs ----------------------------------------------------


def top_rows(df: DataFrame, measure: str, columns: Sequence[str], tie: Sequence[str], k: int = 20) -> DataFrame:
    order = [F.col(measure).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in tie]]
    return _top(df.select(*columns), order, k)


def top_groups(df: DataFrame, key: str, measure: str, k: int = 10) -> DataFrame:
    groups = df.groupBy(key).agg(F.sum(measure).alias(f"sum_{measure}"), _count().alias("n"))
    return _top(groups, [F.col(f"sum_{measure}").desc_nulls_last(), F.col(key).asc_nulls_last()], k)


def status_matrix(df: DataFrame, key: str, status: str = "claim_status") -> DataFrame:
    return (
        df.groupBy(key)
        .agg(
            _count_if(_starts(status, "open")).alias("open_cnt"),
            _count_if(_starts(status, "closed")).alias("closed_cnt"),
            _count().alias("total"),
        )
        .orderBy(F.desc("total"), F.col(key).asc_nulls_last())
    )


def histogram(df: DataFrame, column: str, low: float, high: float, buckets: int) -> DataFrame:
    """Equal-width buckets; 0 holds what lies below, ``buckets + 1`` what lies at or above ``high``."""
    bucket = F.width_bucket(F.col(column).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(buckets))
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(bucket.cast("bigint").alias("bucket"))
        .agg(F.min(column).alias("bucket_min"), F.max(column).alias("bucket_max"), _count().alias("n"))
        .orderBy("bucket")
    )


def outliers(
    df: DataFrame, column: str, tie: Sequence[str], percent: float = 0.99, k: int | None = 100, measured: DataFrame | None = None
) -> DataFrame:
    """Rows above a percentile of the whole table, largest first.

    ``measured`` may give the same column from a cheaper source than a wide join.
    """
    cut = exact_percentiles(df if measured is None else measured, [], F.col(column), {"cut": percent})
    above = df.filter(F.col(column).cast("double") > cut.select("cut").scalar())
    return _top(above, [F.desc(column), *[F.col(c).asc_nulls_last() for c in tie]], k)


def heat(df: DataFrame, a: str, b: str, k: int = 200) -> DataFrame:
    counted = df.groupBy(a, b).agg(_count().alias("n"))
    return _top(counted, [F.desc("n"), F.col(a).asc_nulls_last(), F.col(b).asc_nulls_last()], k)


def triage(
    df: DataFrame, columns: Sequence[str], tie: Sequence[str], status: str = "claim_status", reserve: str = "net_reserve", k: int = 50
) -> DataFrame:
    """Open claims by reserve."""
    open_rows = df.filter(_starts(status, "open") & (F.coalesce(F.col(reserve), F.lit(0)) > 0)).select(*columns)
    return _top(open_rows, [F.desc(reserve), *[F.col(c).asc_nulls_last() for c in tie]], k)


def keyword_filter(df: DataFrame, column: str, word: str) -> DataFrame:
    """Rows containing a word, in any case; ``%``, ``_`` and ``\\`` in it are taken literally."""
    literal = word.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return df.filter(F.col(column).ilike(f"%{literal}%"))


def destination_summary(
    df: DataFrame, destination: str = "destination", kind: str = "claim_type", amount: str = "net_incurred", top: int = 3
) -> DataFrame:
    """Per destination: claims, average amount, and its most frequent types with count and percent."""
    pairs = df.groupBy(destination, kind).agg(
        _count().alias("count"), F.sum(F.col(amount).cast("double")).alias("_sum"), F.count(amount).alias("_k")
    )
    # From here on one row per (destination, type).
    totals = pairs.groupBy(destination).agg(
        F.sum("count").alias("n_claims"), F.try_divide(F.sum("_sum"), F.sum("_k").cast("double")).alias("avg_amount")
    )
    ranked = (
        pairs.withColumn(
            "_rank",
            F.row_number().over(Window.partitionBy(destination).orderBy(F.desc("count"), F.col(kind).asc_nulls_last())),
        )
        .filter(F.col("_rank") <= top)
        .groupBy(destination)
        .agg(F.array_sort(F.collect_list(F.struct("_rank", F.col(kind).alias("type"), "count"))).alias("_top"))
        .withColumnRenamed(destination, "_d")
    )
    percent = F.transform(
        F.col("_top"),
        lambda t: F.struct(
            t["type"].alias("type"),
            t["count"].alias("count"),
            F.round(t["count"] * F.lit(100.0) / F.col("n_claims"), 2).alias("percent"),
        ),
    )
    return (
        totals.join(ranked, F.col(destination).eqNullSafe(F.col("_d")))
        .select(destination, "n_claims", "avg_amount", percent.alias("top_types"))
        .orderBy(F.desc("n_claims"), F.col(destination).asc_nulls_last())
    )


# --- many queries over one view ------------------------------------------------


_QUERY_RESULT = "topic string, status string, row_count bigint, preview array<string>, error string"


# Roots of a parsed query; whatever else a statement parses to is not run.
_QUERIES = {
    "Project", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Filter", "Distinct", "Union", "Except", "Intersect", "Join", "Pivot", "Range", "SubqueryAlias",
    "UnresolvedWith", "CTE", "UnresolvedHaving", "UnresolvedRelation", "UnresolvedInlineTable", "WithWindowDefinition", "LocalRelation",
}


def _refusal(spark: SparkSession, sql: str) -> str | None:
    """Why a statement is not run. Spark parses it without running it; commands are refused."""
    try:
        plan = spark.sql("EXPLAIN EXTENDED " + sql).first()[0]
    except Exception as error:  # whatever Spark says about it
        return str(error)
    root = re.match(r"== Parsed Logical Plan ==\s*'?(\w+)", plan)
    return None if root and root[1] in _QUERIES else f"refused, not a query: {plan.split(chr(10))[1] if root else plan}"


def run_queries(spark: SparkSession, claims: DataFrame, queries: Mapping[str, str], preview: int = 5, view: str = "claims") -> DataFrame:
    """Runs several SELECTs over the claims view; a failing one is reported and the rest go on.

    One row per topic: its row count and its first ``preview`` rows as JSON, or the
    whole error. Each query runs once, and only those few rows and the count reach the
    driver. Statements that are not queries are refused. They run in a session of their
    own, so the caller's view of that name stays as it is.
    """
    inner = spark.newSession()
    # The claims cross over by their plan; a temporary view in the caller's session would be seen there.
    shared = f"_{view}_{uuid.uuid4().hex}"
    claims.createOrReplaceGlobalTempView(shared)
    inner.table(f"global_temp.{shared}").createOrReplaceTempView(view)
    outcomes = []
    for topic, sql in queries.items():
        if reason := _refusal(inner, sql):
            outcomes.append((topic, "error", None, None, reason))
            continue
        try:
            frame = inner.sql(sql)
            record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in frame.columns]), {"ignoreNullFields": "false"})
            # One pass: the rows are counted on their way to a bounded sort by their own order.
            seen = Observation()
            rows = frame.select(record.alias("r"), F.monotonically_increasing_id().alias("i")).observe(seen, F.count(F.lit(1)).alias("n"))
            head = [row["r"] for row in rows.orderBy("i").limit(preview).collect()]
            outcomes.append((topic, "ok", seen.get.get("n", 0), head, None))
        except Exception as error:  # a bad query becomes a row, whatever Spark raised
            outcomes.append((topic, "error", None, None, str(error)))
    spark.catalog.dropGlobalTempView(shared)
    return spark.createDataFrame(outcomes, _QUERY_RESULT)


# --- the report ----------------------------------------------------------------


def _json_rows(section: str, name: str, df: DataFrame, part_rows: int | None = None) -> DataFrame:
    """A section as JSON arrays. Sections with a fixed row bound make one part;
    the others are spread over hash parts of about ``part_rows`` rows."""
    record = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    # The id keeps the order of a sorted input through the grouping below.
    rows = df.select(F.monotonically_increasing_id().alias("_i"), record.alias("_r"))
    part: Column = F.lit(0)
    if part_rows:
        total = rows.agg(F.ceil(F.count("*") / F.lit(part_rows)).alias("n")).scalar()
        part = F.pmod(F.xxhash64("_r"), F.greatest(total, F.lit(1).cast("bigint")))
    body = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_r"))), lambda r: r["_r"]), ","), F.lit("]"))
    filled = rows.withColumn("part", part.cast("bigint")).groupBy("part").agg(body.alias("body"))
    # An empty section is one row with a NULL body.
    one = df.sparkSession.range(1).select(F.lit(section).alias("section"), F.lit(name).alias("name"), F.lit(0).alias("_0"))
    return one.join(filled.withColumn("_0", F.lit(0)), "_0", "left").select(
        "section", "name", F.coalesce("part", F.lit(0).cast("bigint")).alias("part"), "body"
    )


def _nearest(df: DataFrame, by: Column, k: int) -> DataFrame:
    """The rows that can be among the first ``k`` by ``by``; NULLs stay, wherever they sort. A narrow pass finds the k-th value, so whole rows are built only up to it."""
    head = df.select(by.alias("_by")).orderBy(F.col("_by").asc_nulls_last()).limit(k)
    return df.where((by <= head.agg(F.max("_by").alias("cut")).scalar()) | by.isNull())


def _json_object(section: str, name: str, df: DataFrame) -> DataFrame:
    body = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return df.select(F.lit(section).alias("section"), F.lit(name).alias("name"), F.lit(0).cast("bigint").alias("part"), body.alias("body"))


def report(df: DataFrame, part_rows: int = 10_000) -> DataFrame:
    """Every section of the claims report as JSON: ``section, name, part, body``.

    Scans are shared: one rollup over the low-cardinality columns and one over
    the months carry all additive sections. Both have few groups, so each task
    sends little, and both are cut off with a reliable checkpoint. ``df`` is read
    about twenty times, so an expensive view should be written as a table first.
    """
    cube = cut_lineage(
        df.groupBy("product_category", "product_name", "claim_status", "destination", "loss_type").agg(
            _count().alias("n"),
            *[F.sum(m).alias(m) for m in MONEY],
            F.count("net_paid").alias("k_net_paid"),
            *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns],
            *[f(c).alias(f"{name}_{c}") for c in DATES for name, f in (("min", F.min), ("max", F.max))],
            F.sum(F.when(F.col("accident_date").isNotNull(), _days("report_date", "accident_date"))).alias("d_report"),
            F.count(_days("report_date", "accident_date")).alias("k_report"),
            F.sum(F.when(F.col("accident_date").isNotNull(), _days("closed_date", "report_date"))).alias("d_close"),
            F.count(F.when(F.col("accident_date").isNotNull(), _days("closed_date", "report_date"))).alias("k_close"),
        )
    )
    months = cut_lineage(
        df.groupBy(
            "claim_status", _month(F.col("report_date")).alias("report_month"), _month(F.coalesce("closed_date", "report_date")).alias("activity_month")
        ).agg(_count().alias("n"), F.sum("net_paid").alias("net_paid"), F.sum("net_incurred").alias("net_incurred"))
    )
    total = F.sum("n").alias

    def ratio(a: str, b: str) -> Column:
        return F.try_divide(F.sum(a).cast("double"), F.sum(b).cast("double"))

    def ranked(key: str, k: int | None) -> DataFrame:
        return _top(cube.groupBy(key).agg(total("n")), [F.desc("n"), F.col(key).asc_nulls_last()], k)

    percents = exact_percentiles(
        df, [], F.coalesce(F.col("net_paid").cast("double"), F.lit(0.0)), {"p50_net_paid": 0.5, "p90_net_paid": 0.9}
    )
    overall = cube.agg(
        total("n_claims"), *[F.sum(m).alias(f"sum_{m}") for m in MONEY], ratio("net_paid", "k_net_paid").alias("avg_net_paid")
    ).select("*", *[percents.select(p).scalar().alias(p) for p in percents.columns])
    loss_percents = exact_percentiles(df, ["loss_type"], F.col("net_paid"), {"p50": 0.5, "p90": 0.9}).withColumnRenamed("loss_type", "_k")
    by_loss = (
        cube.groupBy("loss_type")
        .agg(total("n"), ratio("net_paid", "k_net_paid").alias("avg_net_paid"), F.sum("net_paid").alias("sum_net_paid"))
        .join(loss_percents, F.col("loss_type").eqNullSafe(F.col("_k")), "left")
        .drop("_k")
    )
    adequacy = cube.groupBy("loss_type").agg(
        F.sum("net_incurred").alias("incurred"), F.sum("net_paid").alias("paid"), F.sum("net_reserve").alias("reserve")
    ).withColumn(
        "reserve_to_incurred_ratio",
        F.when(F.col("incurred") > 0, F.col("reserve").cast("double") / F.col("incurred").cast("double")),
    )
    opened = F.sum(F.when(_starts("claim_status", "open"), F.col("n")).otherwise(0)).alias("open_cnt")
    closed = F.sum(F.when(_starts("claim_status", "closed"), F.col("n")).otherwise(0)).alias("closed_cnt")
    columns = [
        F.struct(F.lit(i).alias("ordinal_position"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"), F.lit(f.nullable).alias("is_nullable"))
        for i, f in enumerate(df.schema.fields, 1)
    ]
    claim_columns = ["claim_number", "product_name", "loss_type", "destination"]
    sections = [
        _json_rows("meta", "columns", df.sparkSession.range(1).select(F.inline(F.array(*columns)))),
        _json_object("meta", "exact_rows", cube.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("exact_rows"))),
        _json_rows("samples", "first10", first_n(_nearest(df, F.col("claim_number"), 10), ["claim_number"])),
        _json_rows("samples", "random20", random_n(_nearest(df, F.xxhash64(F.lit(0), "claim_number"), 20), ["claim_number"])),
        _json_object(
            "distincts", "counts",
            distinct_counts(cube, ["product_category", "product_name", "claim_status", "loss_type", "destination"]),
        ),
        _json_rows("distincts", "claim_status_values", distinct_values(cube, "claim_status"), part_rows),
        _json_rows("distincts", "top_loss_types", ranked("loss_type", 20)),
        _json_rows("distincts", "top_destinations", ranked("destination", 20)),
        _json_rows("distincts", "claims_by_status", ranked("claim_status", None), part_rows),
        _json_object("missing_values", "null_counts", cube.agg(*[F.sum(f"null_{c}").alias(f"null_{c}") for c in df.columns])),
        _json_object(
            "missing_values", "null_pct_subset",
            cube.agg(*[(ratio(f"null_{c}", "n") * 100).alias(c) for c in ("claim_status", "closed_date", "destination")]),
        ),
        _json_object("financials", "overall", overall),
        _json_rows("financials", "by_loss_type", by_loss, part_rows),
        _json_object(
            "time", "coverage_period",
            cube.agg(*[f(f"{name}_{c}").alias(f"{name}_{c}") for c in DATES for name, f in (("min", F.min), ("max", F.max))]),
        ),
        _json_rows("time", "monthly_claims", months.groupBy(F.col("report_month").alias("month")).agg(total("n_claims")), part_rows),
        _json_rows(
            "time", "monthly_paid_incurred",
            months.groupBy(F.col("report_month").alias("month")).agg(
                F.sum("net_paid").alias("sum_net_paid"), F.sum("net_incurred").alias("sum_net_incurred")
            ),
            part_rows,
        ),
        _json_rows("durations", "sample", longest_durations(df)),
        _json_rows(
            "durations", "by_loss_type",
            cube.groupBy("loss_type").agg(
                ratio("d_report", "k_report").alias("avg_days_to_report"), ratio("d_close", "k_close").alias("avg_days_to_close")
            ),
            part_rows,
        ),
        _json_rows("data_quality", "negative_amounts", _top(negative_amounts(df), [F.asc("claim_number")], 100)),
        _json_rows("data_quality", "closed_with_reserve", _top(closed_with_reserve(df), [F.asc("claim_number")], 100)),
        _json_rows("data_quality", "report_before_accident", report_before_accident(df), part_rows),
        _json_rows("rankings", "top_claims_net_paid", top_rows(df, "net_paid", [*claim_columns, "net_paid"], ["claim_number"])),
        _json_rows("rankings", "top_destinations_by_net_paid", _top(
            cube.groupBy("destination").agg(F.sum("net_paid").alias("sum_net_paid"), total("n")),
            [F.col("sum_net_paid").desc_nulls_last(), F.col("destination").asc_nulls_last()], 10)),
        _json_rows("distributions", "loss_type_status_matrix", cube.groupBy("loss_type").agg(opened, closed, total("total")), part_rows),
        _json_rows("distributions", "hist_net_paid", histogram(df, "net_paid", 0, 10_000, 10)),
        _json_rows("distributions", "p99_outliers", outliers(df, "net_paid", ["claim_number"])),
        _json_object("ratios", "avg_paid_to_incurred_ratio", mean_ratio(df, "net_paid", "net_incurred", "avg_paid_to_incurred_ratio")),
        _json_rows("ratios", "reserve_adequacy_by_loss_type", adequacy, part_rows),
        _json_rows("duplicates", "duplicate_claim_numbers", duplicate_keys(df, "claim_number"), part_rows),
        _json_rows("duplicates", "exact_duplicates_subset", duplicate_rows(
            df, ["product_category", "product_name", "claim_status", "accident_date", "destination", "loss_type"])),
        _json_rows("slices", "kpis_by_product_name", cube.groupBy("product_name").agg(
            total("n_claims"), F.sum("net_paid").alias("sum_net_paid"), ratio("net_paid", "k_net_paid").alias("avg_net_paid")), part_rows),
        _json_rows("slices", "dest_loss_heat_subset", _top(
            cube.groupBy("destination", "loss_type").agg(total("n")),
            [F.desc("n"), F.col("destination").asc_nulls_last(), F.col("loss_type").asc_nulls_last()], 200)),
        _json_rows("open_closed", "monthly_open_vs_closed", months.groupBy(F.col("activity_month").alias("month")).agg(opened, closed), part_rows),
        _json_rows("open_closed", "triage_open_high_reserve", triage(df, [*claim_columns, "net_reserve"], ["claim_number"])),
    ]
    return reduce(DataFrame.unionByName, sections)
