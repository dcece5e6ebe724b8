"""Total order over a large table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_row_index(df: DataFrame, order: str, buckets: int = 1024) -> tuple[DataFrame, int]:
    """(df with a zero-based row_index in ascending order, number of rows).

    Rows are put into ranges by approximate quantiles of the order, ranked within a range
    and moved up by the counts of the ranges before. Ranges are numbers, so `order` must be numeric.
    """
    cuts = sorted(set(df.approxQuantile(order, [k / buckets for k in range(1, buckets)], 0.25 / buckets)))
    edges = F.array(*(F.lit(float(c)) for c in cuts)) if cuts else F.array().cast("array<double>")
    ranged = df.withColumn("_range", F.size(F.filter(edges, lambda e: e < F.col(order))))
    counts = {r["_range"]: r["n"] for r in ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per range
    before, total = {}, 0
    for k in sorted(counts):
        before[k] = total
        total += counts[k]
    shift = F.create_map(*(x for k, n in before.items() for x in (F.lit(k), F.lit(n)))) if before else F.create_map(F.lit(0), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return ranged.withColumn("row_index", rank + F.element_at(shift, F.col("_range"))).drop("_range"), total
