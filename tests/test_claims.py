import datetime as dt
from decimal import Decimal as D

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimweave.functions import percentiles
from claimweave.operators import claims as ops
from claimweave.plans.tables import CLAIM_COLUMNS, claims_view, table
from claimweave.sources.readers import CLAIMS_SCHEMA


def claim(number, status="Open", accident="2024-01-01", report="2024-01-05", closed=None, loss="medical", paid=None, incurred=None, reserve=None):
    day = lambda s: dt.date.fromisoformat(s) if s else None
    money = lambda v: None if v is None else D(v)
    return (number, "travel", "basic", status, day(accident), day(report), day(closed), "Japan", "c", None, loss,
            money(incurred), money(paid), money(reserve), money(incurred), money(paid), money(reserve))


@pytest.fixture(scope="module")
def claims(spark):
    rows = [
        claim("1", "OPEN", paid="0", incurred="100", reserve="100"),
        claim("2", "closed - paid", closed="2024-02-01", paid="50", incurred="100", reserve="50"),
        claim("3", "Closed", closed="2024-03-01", paid="100", incurred="0", reserve="0"),
        claim("4", "Pending", paid=None, incurred="10", reserve="10"),
        claim("5", "open late", report="2023-12-30", paid="10000", incurred="20000", reserve="10000", loss="baggage"),
        claim("5", "Open", paid="10000", incurred="20000", reserve="10000", loss="baggage"),
        claim("6", "Closed", closed="2024-01-06", paid="-5", incurred="40", reserve="45", loss=None),
    ]
    return spark.createDataFrame(rows, CLAIMS_SCHEMA)


def test_percentiles_treat_null_as_told(claims):
    zero = ops.overall_stats(claims).first()
    skip = ops.overall_stats(claims, null_as=None).first()
    assert zero["p50_net_paid"] == np.percentile([0, 50, 100, 0, 10000, 10000, -5], 50)
    assert skip["p50_net_paid"] == np.percentile([0, 50, 100, 10000, 10000, -5], 50)


def test_status_prefix_and_ratio(claims):
    matrix = {r["loss_type"]: r for r in ops.status_matrix(claims, "loss_type").collect()}
    assert (matrix["medical"]["open_cnt"], matrix["medical"]["closed_cnt"], matrix["medical"]["total"]) == (1, 2, 4)
    # Zero on either side drops out.
    assert ops.mean_ratio(claims, "net_paid", "net_incurred").first()[0] == pytest.approx(np.mean([0.5, 0.5, 0.5, -0.125]))


def test_histogram_ends(claims):
    buckets = {r["bucket"]: r["n"] for r in ops.histogram(claims, "net_paid", 0, 10_000, 10).collect()}
    assert buckets == {0: 1, 1: 3, 11: 2}


def test_checks_and_ties(claims):
    assert [r["claim_number"] for r in ops.negative_amounts(claims).collect()] == ["6"]
    assert {r["claim_number"] for r in ops.closed_with_reserve(claims).collect()} == {"2", "6"}
    assert [r["claim_number"] for r in ops.report_before_accident(claims).collect()] == ["5"]
    assert [(r["claim_number"], r["n"]) for r in ops.duplicate_keys(claims, "claim_number").collect()] == [("5", 2)]
    top = ops.top_rows(claims, "net_paid", ["claim_number", "report_date"], ["claim_number", "report_date"], 2).collect()
    assert [r["report_date"].day for r in top] == [30, 5]
    broken = {(r["claim_number"], tuple(r["violations"])) for r in ops.amount_checks(claims).collect()}
    assert ("3", ("gross_incurred_is_paid_plus_reserve", "net_incurred_is_paid_plus_reserve")) in broken


def test_empty_table(spark, claims):
    empty = claims.limit(0)
    assert ops.overall_stats(empty).first()["n_claims"] == 0
    assert ops.null_pct(empty, ["claim_status"]).first()["pct_null"] is None
    sections = {(r["section"], r["name"]): r["body"] for r in ops.report(empty).collect()}
    assert sections["rankings", "top_claims_net_paid"] is None


def test_report_samples_need_few_whole_rows(spark):
    """Rows that are not among the first are dropped before whole rows are sorted; ties and NULL keys stay."""
    rows = spark.range(1000).select(F.when(F.col("id") % 100 != 7, F.format_string("c%03d", F.col("id").cast("int") % 500)).alias("claim_number"), "id")
    number = F.col("claim_number")
    near = ops._nearest(rows, number, 10)
    assert near.where(number.isNotNull()).count() == 10 and near.count() == 20
    assert [r["claim_number"] for r in ops.first_n(near, ["claim_number"]).collect()] == [r["claim_number"] for r in ops.first_n(rows, ["claim_number"]).collect()]
    assert ops.first_n(ops._nearest(rows.where(number.isNull()), number, 3), ["claim_number", "id"], 3).count() == 3
    by = F.xxhash64(F.lit(0), "claim_number")
    assert [r["claim_number"] for r in ops.random_n(ops._nearest(rows, by, 20), ["claim_number"]).collect()] == [r["claim_number"] for r in ops.random_n(rows, ["claim_number"]).collect()]


def test_profile_distinct(claims):
    exact = {r["column_name"]: r["distinct_values"] for r in ops.profile(claims, distinct="exact").collect()}
    assert exact["claim_number"] == 6 and exact["loss_type"] == 2 and exact["cause_of_loss"] == 0
    assert "distinct_values" in ops.profile(claims, distinct="approx").columns


def test_keyword_is_literal(spark):
    df = spark.createDataFrame([("50% off",), ("500 off",), ("a_b",), ("MEDICAL",)], "t string")
    assert ops.keyword_filter(df, "t", "50%").count() == 1
    assert ops.keyword_filter(df, "t", "_").count() == 1
    assert ops.keyword_filter(df, "t", "medical").count() == 1


@pytest.mark.parametrize("margin,small", [(4 / 100, 100_000), (0.0, 100_000), (-0.05, 16), (4 / 100, 16)])
@pytest.mark.parametrize("groups", [1, 3])
def test_percentiles_from_brackets(spark, monkeypatch, groups, margin, small):
    """A tiny accuracy gives wide brackets; without a margin, or with a negative one, they miss. Small rests are narrowed in rounds."""
    monkeypatch.setattr(percentiles, "ACCURACY", 100)
    rng = np.random.default_rng(3)
    # A hot group, heavy ties and a NULL key.
    keys = rng.choice(["a", "a", "a", "b", None], 6000)
    values = np.where(rng.random(6000) < 0.4, 7.0, rng.normal(0, 100, 6000).round(2))
    df = spark.createDataFrame(list(zip(keys.tolist(), values.tolist())), "k string, v double").repartition(7)
    wanted = {"p1": 0.01, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    if groups == 1:
        row = percentiles.exact_percentiles(df, [], F.col("v"), wanted, margin=margin, small=small).first()
        assert [row[c] for c in wanted] == pytest.approx([np.quantile(values, p) for p in wanted.values()])
    else:
        for row in percentiles.exact_percentiles(df, ["k"], F.col("v"), wanted, margin=margin, small=small).collect():
            group = values[[k == row["k"] for k in keys]]
            assert [row[c] for c in wanted] == pytest.approx([np.quantile(group, p) for p in wanted.values()])


def test_a_missed_bracket_with_many_values(spark, monkeypatch):
    """A million distinct values of which every bracket misses: no task ranks more than a few thousand of them."""
    ranked, real = [], percentiles._ranked

    def watched(inside, keys, names):
        ranked.append(inside.count())
        return real(inside, keys, names)

    monkeypatch.setattr(percentiles, "_ranked", watched)
    df = spark.range(1_000_000, numPartitions=8).select(((F.col("id") * 7919) % 1_000_003).cast("double").alias("v"))
    found = percentiles.exact_percentiles(df, [], F.col("v"), {"p25": 0.25, "p90": 0.9}, margin=-0.001, small=5000).first()
    values = np.sort((np.arange(1_000_000) * 7919) % 1_000_003)
    assert [found["p25"], found["p90"]] == [np.quantile(values, 0.25), np.quantile(values, 0.9)]
    assert len(ranked) == 2 and max(ranked) <= 2 * 5000


def test_narrow_view_has_the_rows_of_the_wide_one(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").count()
    assert claims_view(spark, sf_dir).count() == lines
    for column in CLAIM_COLUMNS:
        assert claims_view(spark, sf_dir, [column]).count() == lines


def test_report_counts_match(spark, sf_dir):
    import json

    claims = claims_view(spark, sf_dir).cache()
    sections = {}
    for row in ops.report(claims, part_rows=500).collect():
        sections.setdefault((row["section"], row["name"]), []).append(json.loads(row["body"]) if row["body"] else None)
    assert len(sections) == 34
    assert sections["meta", "exact_rows"] == [{"exact_rows": claims.count()}]
    early = sections["data_quality", "report_before_accident"]
    assert len(early) > 1 and sum(map(len, early)) == ops.report_before_accident(claims).count()
    by_loss = {r["loss_type"]: r for r in sections["financials", "by_loss_type"][0]}
    for row in ops.stats_by(claims, "loss_type", "net_paid").collect():
        assert by_loss[row["loss_type"]]["p50"] == pytest.approx(row["p50"])
        assert by_loss[row["loss_type"]]["avg_net_paid"] == pytest.approx(row["avg_net_paid"])
    durations = {r["loss_type"]: r for r in sections["durations", "by_loss_type"][0]}
    for row in ops.durations_by(claims, "loss_type").collect():
        assert durations[row["loss_type"]]["avg_days_to_close"] == pytest.approx(row["avg_days_to_close"])
    ranked = [r["net_paid"] for r in sections["rankings", "top_claims_net_paid"][0]]
    assert ranked == sorted(ranked, reverse=True) and len(ranked) == 20


def test_few_groups_ship_their_brackets(spark, monkeypatch):
    """The rows of a group stay where they are: no join shuffles them by the key, and not shipping gives the same."""
    df = spark.range(3000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 1009).cast("double").alias("v"))
    seen, inside = [], percentiles._inside
    monkeypatch.setattr(percentiles, "_inside", lambda *a: seen.append(inside(*a)) or seen[-1])
    wanted = {"p50": 0.5, "p90": 0.9}
    one = percentiles.exact_percentiles(df, ["k"], F.col("v"), wanted).orderBy("k").collect()
    assert "strategy=broadcast" in seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert one == percentiles.exact_percentiles(df, ["k"], F.col("v"), wanted, shipped=1).orderBy("k").collect()
    assert "strategy=broadcast" not in seen[1]._jdf.queryExecution().optimizedPlan().toString()


def test_drawn_rows_are_looked_up_without_shuffling_claims(spark, sf_dir):
    from claimweave.plans.claims_queries import random_n_properties

    found = random_n_properties(spark, sf_dir)
    assert found.first().asDict() == {"drawn": 20, "members": 20, "again": 20}
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
