"""Exact interpolated percentiles that never gather a group in one place.

A sketch brackets each wanted rank, and only the values inside the brackets are kept, each once
with its count. While too many are left for one task, they are bracketed again: quantiles of what
is left cut it into ranges, the counts of the ranges tell which of them hold the rank, and
the others fold into one number. Only a bounded rest is ranked.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from claimweave.session import cut_lineage

ACCURACY = 10_000
# A bracket is so much of a group to both sides of a rank; a sketch errs by a quarter of it.
MARGIN = 4 / ACCURACY
# Distinct values of one bracket that one task ranks, and ranges per round of narrowing.
SMALL = 100_000
RANGES = 64
# Brackets of so many groups are shipped to the rows: else all rows of a group would meet its bracket in one task.
SHIPPED_GROUPS = 10_000


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    percents: dict[str, float],
    extra: Sequence[Column] = (),
    margin: float = MARGIN,
    small: int = SMALL,
    shipped: int = SHIPPED_GROUPS,
) -> DataFrame:
    """Interpolated percentiles of ``value`` per key; NULL values are skipped.

    ``percents`` maps an output column to its fraction; ``extra`` aggregates ride along in the first
    pass. The counts below and inside a bracket tell whether its rank really lies in it; groups
    of which one does not are bracketed anew from all their values. A bracket with more than
    ``small`` distinct values is narrowed in rounds, each leaving about a 64th of them. The
    passes run at once and leave one row per group, which is pinned.
    """
    names = list(keys)
    cuts = [min(max(p + side * margin, 0.0), 1.0) for p in percents.values() for side in (-1, 1)]
    valued = df.withColumn("_x", value.cast("double")).withColumn("_one", F.lit(0))
    first_pass = [F.count("_x").alias("_n"), F.percentile_approx("_x", cuts, ACCURACY).alias("_cut"), *extra]
    grouped = valued.groupBy(*names).agg(*first_pass) if names else valued.agg(*first_pass)
    # Without keys a constant stands in, so both cases are the same equi-join.
    sketch = cut_lineage(grouped.withColumn("_one", F.lit(0)))
    outputs = [c for c in sketch.columns if c not in (*names, "_n", "_cut", "_one")]
    keyed = [*names, "_one"]
    ship = not names or sketch.limit(shipped + 1).count() <= shipped
    data = valued.filter("_x IS NOT NULL").select(*keyed, "_x")
    found = _search(data, keyed, sketch.filter("_n > 0"), percents, False, small, ship)
    result = cut_lineage(_joined(sketch, keyed, found, "left").select(*keyed, "_n", *outputs, *percents))
    missed = result.filter("_n > 0").filter(reduce(lambda a, b: a | b, [F.col(name).isNull() for name in percents]))
    if not missed.isEmpty():
        again = _search(data, keyed, missed.select(*keyed, "_n"), percents, True, small, ship)
        again = again.toDF(*[c if c.startswith("_k_") else f"_again_{c}" for c in again.columns])
        result = _joined(result, keyed, again, "left").withColumns({name: F.coalesce(name, f"_again_{name}") for name in percents})
    return result.select(*names, *outputs, *percents)


def _joined(df: DataFrame, keys: Sequence[str], other: DataFrame, how: str = "inner") -> DataFrame:
    """A join on all keys with their twins ``_k_`` on the other side, NULL equal to NULL."""
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return df.join(other, same, how)


def _twins(keys: Sequence[str]) -> list[Column]:
    return [F.col(k).alias(f"_k_{k}") for k in keys]


def _search(data: DataFrame, keys: Sequence[str], groups: DataFrame, percents: dict[str, float], all_values: bool, small: int, ship: bool) -> DataFrame:
    """The percentiles of ``groups`` (keys, ``_n``, ``_cut``), keys as twins; NULL where a rank is outside its bracket."""
    bounds = []
    for i, p in enumerate(percents.values()):
        # NaN sorts behind all numbers.
        low, high = (F.lit(float("-inf")), F.lit(float("nan"))) if all_values else (F.col("_cut")[2 * i], F.col("_cut")[2 * i + 1])
        bounds += [low.alias(f"_lo{i}"), high.alias(f"_hi{i}"), ((F.col("_n") - 1) * F.lit(p)).alias(f"_rank{i}")]
    wanted = groups.select(*_twins(keys), *bounds)
    if ship:
        wanted = F.broadcast(wanted)
    inside = cut_lineage(_inside(data, keys, wanted, len(percents)))
    # What is left per group and rank, by distinct values. A range may be down to a few of them, so the bound is not below that.
    while (inside.groupBy(*keys, "_i").count().agg(F.max("count")).first()[0] or 0) > max(small, 16):
        inside = cut_lineage(_narrowed(inside, keys, ship))
    return _ranked(inside, keys, list(percents))


def _inside(data: DataFrame, keys: Sequence[str], wanted: DataFrame, n: int) -> DataFrame:
    """Per group and bracket ``_i`` with its ``_rank``: the values inside, each with its count, and as NULL the count of those below."""
    x, numbers = F.col("_x"), range(n)
    held = [(x >= F.col(f"_lo{i}")) & (x <= F.col(f"_hi{i}")) for i in numbers]
    # Rows outside all brackets fold into one NULL row per group and task before the shuffle.
    fixed = [f"_{name}{i}" for i in numbers for name in ("lo", "hi", "rank")]
    folded = (
        _joined(data, keys, wanted)
        .withColumn("_v", F.when(reduce(lambda a, b: a | b, held), x))
        .groupBy(*keys, *fixed, "_v")
        .agg(F.count("*").alias("_all"), *[F.count_if(x < F.col(f"_lo{i}")).alias(f"_below{i}") for i in numbers])
    )
    v = F.col("_v")

    def bracket(i: int) -> Column:
        one = lambda value, count: F.struct(F.lit(i).alias("i"), F.col(f"_rank{i}").alias("rank"), value.alias("v"), count.alias("c"))
        under = v.isNull() | (v < F.col(f"_lo{i}"))
        return F.when(under, one(F.lit(None).cast("double"), F.col(f"_below{i}"))).when(v <= F.col(f"_hi{i}"), one(v, F.col("_all")))

    return (
        folded.select(*keys, F.explode(F.array(*[bracket(i) for i in numbers])).alias("_b"))
        .filter("_b IS NOT NULL AND _b.c > 0")
        .select(*keys, F.col("_b.i").alias("_i"), F.col("_b.rank").alias("_rank"), F.col("_b.v").alias("_v"), F.col("_b.c").alias("_c"))
        .groupBy(*keys, "_i", "_rank", "_v")
        .agg(F.sum("_c").alias("_c"))
    )


def _holding(counted: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows of ``counted`` (``_c`` per ``order`` value) on which the ranks next to ``_rank`` fall, with the count up to each."""
    running = Window.partitionBy(*keys, "_i").orderBy(F.col(order).asc_nulls_first())
    after = F.sum("_c").over(running.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counted.withColumn("_after", after).filter((F.col("_after") > F.floor("_rank")) & (F.col("_after") - F.col("_c") <= F.ceil("_rank")))


def _narrowed(inside: DataFrame, keys: Sequence[str], ship: bool) -> DataFrame:
    """The same with only the values of the ranges that hold the ranks; those under them join the NULL row."""
    ids = [*keys, "_i"]
    fractions = [j / RANGES for j in range(1, RANGES)]
    cuts = inside.groupBy(*ids).agg(F.percentile_approx("_v", fractions, ACCURACY).alias("_cuts"))
    # A value's range: how many cuts it is above; the NULL row is in a range of its own.
    small = F.broadcast if ship else lambda df: df
    placed = _joined(inside, ids, small(cuts.select(*_twins(ids), "_cuts"))).select(
        *ids, "_rank", "_v", "_c", F.when(F.col("_v").isNotNull(), F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).otherwise(-1).alias("_range")
    )
    sums = placed.groupBy(*ids, "_rank", "_range").agg(F.sum("_c").alias("_c"))  # RANGES + 1 rows per group and rank at most
    held = _holding(sums, keys, "_range").groupBy(*ids).agg(F.min("_range").alias("_from"), F.max("_range").alias("_to"))
    met = _joined(placed, ids, small(held.select(*_twins(ids), "_from", "_to"))).where("_range <= _to")
    value = F.when(F.col("_range") >= F.col("_from"), F.col("_v"))
    return met.select(*ids, "_rank", value.alias("_v"), "_c").groupBy(*ids, "_rank", "_v").agg(F.sum("_c").alias("_c"))


def _ranked(inside: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    hits = (
        _holding(inside, keys, "_v")
        .groupBy(*keys, "_i", "_rank")
        .agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.bool_or(F.col("_v").isNull()).alias("_under"), F.max("_after").alias("_upto"))
        # A rank under the bracket falls to the NULL value, one above it is not reached.
        .filter(~F.col("_under") & (F.col("_upto") > F.ceil("_rank")))
        .withColumn("_p", F.col("_lo") + (F.col("_rank") - F.floor("_rank")) * (F.col("_hi") - F.col("_lo")))
    )
    return hits.groupBy(*_twins(keys)).agg(*[F.max(F.when(F.col("_i") == i, F.col("_p"))).alias(name) for i, name in enumerate(names)])
