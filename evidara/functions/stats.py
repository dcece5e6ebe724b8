"""Percentiles and ranking measures as defined, not approximated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def order_statistics(df: DataFrame, value: str, by: list[str], picks: dict[str, Column], ranges: int = 256) -> DataFrame:
    """Values at computed places of the ascending order; picks: name -> zero-based index in terms of column n.

    Exact, and no group is ordered as a whole: rows are counted per distinct value, values are put
    into ranges by approximate quantiles, and only the ranges that hold a wanted place are ordered.
    """
    known = df.where(F.col(value).isNotNull())
    cuts = sorted(set(known.approxQuantile(value, [k / ranges for k in range(1, ranges)], 0.25 / ranges)))
    edges = F.array(*(F.lit(float(c)) for c in cuts)) if cuts else F.array().cast("array<double>")
    counts = known.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c")).withColumn("_range", F.size(F.filter(edges, lambda e: e < F.col(value))))
    keys = by or [F.lit(0)]
    per = counts.groupBy(*by, "_range").agg(F.sum("_c").alias("_n"))
    w = Window.partitionBy(*keys)
    per = per.select(*by, "_range", F.coalesce(F.sum("_n").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), "_n", F.sum("_n").over(w).alias("n"))
    place = {name: F.least(F.col("n") - 1, index) for name, index in picks.items()}
    wanted = F.lit(False)
    for p in place.values():
        wanted = wanted | ((F.col("_before") <= p) & (p < F.col("_before") + F.col("_n")))
    r = per.where(wanted).select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_range").alias("_r"), "_before", "n")
    same = F.col("_range") == F.col("_r")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    near = counts.join(r, same)
    running = F.sum("_c").over(Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = near.select(*by, value, "n", "_before", (F.col("_before") + running).alias("_upto"))
    found = {name: F.min(F.when((F.col("_before") <= p) & (F.col("_upto") > p), F.col(value))) for name, p in place.items()}
    return placed.groupBy(*by).agg(*(c.alias(name) for name, c in found.items()))


def nearest_rank(p: float) -> Column:
    """round((n - 1) p), halves to even."""
    return F.bround((F.col("n") - 1) * F.lit(p)).cast("bigint")


def floor_rank(p: float) -> Column:
    """int(n p)"""
    return F.floor(F.col("n") * F.lit(p)).cast("bigint")


def upper_median() -> Column:
    return F.floor(F.col("n") / 2).cast("bigint")


def mean_reciprocal_rank(rank: Column) -> Column:
    return F.sum(F.when(rank > 0, 1 / rank).otherwise(0.0)) / F.greatest(F.lit(1), F.count(F.lit(1)))


def recall_at(rank: Column, k: int) -> Column:
    return F.count_if((rank >= 1) & (rank <= k)) / F.greatest(F.lit(1), F.count(F.lit(1)))


def retention(before: Column, after: Column, cut_before: int = 80, cut_after: int = 20) -> Column:
    """Of what stood within the first cut, the share that stands within the second."""
    there = before.between(1, cut_before)
    return F.count_if(there & after.between(1, cut_after)) / F.greatest(F.lit(1), F.count_if(there))


def _ideal(n: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1.0)) * F.when(n > 0, 1.0).otherwise(0.0)


def ndcg(relevances: Column, k: int, relevant: Column | None = None) -> Column:
    """NDCG@k of one ranked 0/1 list. Without `relevant` the ideal comes from the list itself, and a list without hits scores 1."""
    gains = F.transform(F.slice(relevances, 1, k), lambda r, i: F.when(r > 0, 1 / F.log2(i + 2.0)).otherwise(0.0))
    dcg = F.aggregate(gains, F.lit(0.0), lambda a, b: a + b)
    total = F.aggregate(relevances, F.lit(0), lambda a, r: a + r.cast("int")) if relevant is None else relevant
    ideal = _ideal(F.least(F.lit(k), total).cast("int"))
    none = F.lit(1.0) if relevant is None else F.lit(0.0)
    return F.when(ideal <= 0, F.when(dcg == 0, none).otherwise(0.0)).otherwise(dcg / ideal)
