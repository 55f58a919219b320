"""Running sums and exact quantiles of groups of any size, over ranges of the order instead of a task a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged


def running(rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, str], totals: dict[str, str] | None = None) -> DataFrame:
    """rows with sums of columns over the group up to each row (name: column), and over all of the group (totals).

    Rows are dealt out by ranges of group and order and written, so that a group spans as many tasks as it fills. A row
    for each range and group tells what comes before it; in a range the sums go on from there. Of rows that tie, any may
    come first, so sums of ties are defined only if the order has none. Null groups are groups.
    """
    totals = totals or {}
    dealt = staged(rows.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()))
    added = sorted({*sums.values(), *totals.values()})
    parts = dealt.groupBy("__part", *by).agg(*(F.sum(c).alias(f"__sum_{c}") for c in added))
    # A few numbers a range, and one more row for each group: what the windows below see.
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(
        F.col("__part").alias("__p"), *(F.col(c).alias(f"__by_{c}") for c in by), *(F.coalesce(F.sum(f"__sum_{c}").over(earlier), F.lit(0)).alias(f"__before_{k}") for k, c in sums.items()),
        *(F.sum(f"__sum_{c}").over(Window.partitionBy(*by)).alias(k) for k, c in totals.items()),
    )
    local = Window.partitionBy("__part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumns({k: F.sum(c).over(local) for k, c in sums.items()})
    on = F.col("__part") == F.col("__p")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    out = summed.join(carried, on)
    return out.select(*rows.columns, *((F.col(k) + F.col(f"__before_{k}")).alias(k) for k in sums), *totals)


def quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by, and the value's quantiles (name: share) between ranks, by groups; a group without values has none and no row.

    Equal values are counted first. No task holds a group's values: a quantile is met where the running count passes its
    rank.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    counted = running(counts, by, [F.col("__v")], {"__to": "__c"}, {"__n": "__c"})
    out = []
    for name, share in shares.items():
        rank = F.lit(float(share)) * (F.col("__n") - 1)
        at = lambda r: F.min(F.when(F.col("__to") > r, F.col("__v")))
        low, high, rank = at(F.floor(rank)), at(F.ceil(rank)), F.lit(float(share)) * (F.max("__n") - 1)
        out.append(F.when(low == high, low).otherwise(low * (F.ceil(rank) - rank) + high * (rank - F.floor(rank))).alias(name))
    return counted.groupBy(*by).agg(*out)
