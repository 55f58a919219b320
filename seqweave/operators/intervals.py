"""Interval operators on (contig, start, end), 0-based and half-open.

Point and range joins never plan as products: an interval goes into every bin of fixed width that it touches, a query
into its own bins, and the equi join on (contig, bin) carries the exact condition. Range-range matches that meet in
several bins are kept only in the bin where the later of the two starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import measured

BIN = 1 << 14


def merged(intervals: DataFrame, by: tuple[str, ...] = ("contig",), width: int = BIN) -> DataFrame:
    """Overlapping and touching intervals as one; empty ones go.

    Merged first among those that start in one bin, then over the contig. What a contig's task sees is disjoint within
    each bin, so its length, and not the number of intervals, bounds it.
    """
    some = intervals.where(F.col("end") > F.col("start")).select(*by, "start", "end")
    local = _islands(some.withColumn("__bin", F.floor(F.col("start") / width)), (*by, "__bin"))
    return _islands(local.select(*by, "start", "end"), by)


def _islands(intervals: DataFrame, by: tuple[str, ...]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = intervals.withColumn("__new", F.when(F.col("start") <= reach, 0).otherwise(1))
    rows = rows.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__island")


def in_order(intervals: DataFrame) -> DataFrame:
    """Numeric contigs by number, then the others by name."""
    number = F.col("contig").try_cast("int")
    numeric = F.col("contig").rlike("^[0-9]+$")
    return intervals.orderBy(~numeric, F.when(numeric, number), "contig", "start")


def bins(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width), F.floor((F.greatest(end, start + 1) - 1) / width))


def joined(queries: DataFrame, intervals: DataFrame, how: str, contained: bool, start: str = "start", end: str = "end", contig: str = "contig", width: int = BIN, few: int | None = None) -> DataFrame:
    """queries joined with the intervals (contig, start, end of other names __s, __e) that contain or overlap them.

    how: left_semi (each query once), left_anti, or inner (a row a match). An empty query counts as one base for
    containment. Intervals need not be merged; with merged ones a query is contained in one at most. few: count the intervals'
    bins, and send them to all tasks only if they are so many at most.
    """
    q_end = F.greatest(F.col(end), F.col(start) + 1) if contained else F.col(end)
    sides = intervals.select(F.col("contig").alias("__c"), F.col("start").alias("__s"), F.col("end").alias("__e")).withColumn("__bin", F.explode(bins(F.col("__s"), F.col("__e"), width)))
    sides = sides if few is None else measured(sides, few)
    if contained:
        # Whatever contains the query covers the bin of its start.
        binned = queries.withColumn("__qbin", F.floor(F.col(start) / width))
        on = (F.col(contig) == F.col("__c")) & (F.col("__qbin") == F.col("__bin")) & (F.col("__s") <= F.col(start)) & (F.col("__e") >= q_end)
        out = binned.join(sides, on, how)
    elif how == "inner":
        binned = queries.withColumn("__qbin", F.explode(bins(F.col(start), F.col(end), width)))
        on = (F.col(contig) == F.col("__c")) & (F.col("__qbin") == F.col("__bin")) & (F.col("__s") < q_end) & (F.col("__e") > F.col(start))
        out = binned.join(sides, on, how).where(F.col("__bin") == F.greatest(F.floor(F.col(start) / width), F.floor(F.col("__s") / width)))
    else:
        raise ValueError("overlap joins are inner; deduplicate on the query's key for a semi join")
    return out.drop("__qbin", "__bin", "__c")


def candidate_regions(keys: DataFrame, flank: int = 50) -> DataFrame:
    """Merged neighbourhoods of the distinct variant keys (chrom, pos, ref)."""
    start = F.greatest(F.lit(0), F.col("pos") - 1 - flank)
    end = F.col("pos") - 1 + F.greatest(F.length("ref"), F.lit(1)) + flank
    return merged(keys.select("chrom", "pos", "ref").distinct().select(F.col("chrom").alias("contig"), start.alias("start"), end.alias("end")))


def coverage_at(reads: DataFrame, points: DataFrame, width: int = BIN) -> DataFrame:
    """points (contig, p) with the number of reads (contig, start, end) that cover them; each point once.

    A sweep: reads are steps up and down, points steps of 0, and the depth at a point is the sum of the steps up to it,
    within its bin, on top of what the bins before add up to. So rows are as many as reads and points, never as their
    matches.
    """
    steps = _steps(reads).withColumn("__point", F.lit(False))
    steps = steps.unionByName(points.select("contig", "p").distinct().select("contig", "p", F.lit(0).cast("long").alias("d"), F.lit(True).alias("__point")))
    steps = steps.groupBy("contig", "p").agg(F.sum("d").alias("d"), F.max("__point").alias("__point")).withColumn("__bin", F.floor(F.col("p") / width))
    bins = steps.groupBy("contig", "__bin").agg(F.sum("d").alias("__d"))
    before = F.coalesce(F.sum("__d").over(Window.partitionBy("contig").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = steps.join(bins.select("contig", "__bin", before.alias("__before")), ["contig", "__bin"])
    within = F.sum("d").over(Window.partitionBy("contig", "__bin").orderBy("p"))
    return rows.select("contig", "p", "__point", (within + F.col("__before")).alias("depth")).where("__point").drop("__point")


def _steps(reads: DataFrame) -> DataFrame:
    """contig, p and d: how much the depth changes at p."""
    ends = F.array(F.struct(F.col("start").alias("p"), F.lit(1).alias("d")), F.struct(F.col("end").alias("p"), F.lit(-1).alias("d")))
    return reads.where(F.col("end") > F.col("start")).select("contig", F.inline(ends)).groupBy("contig", "p").agg(F.sum("d").alias("d"))


def depth_profile(reads: DataFrame, width: int = BIN) -> DataFrame:
    """Runs (contig, start, end, depth) of equal positive coverage, by a sum over interval ends.

    The sum runs within bins; a row a bin carries the depth over from those before it and where the next one starts.
    """
    steps = _steps(reads).withColumn("__bin", F.floor(F.col("p") / width))
    order = Window.partitionBy("contig").orderBy("__bin")
    bins = steps.groupBy("contig", "__bin").agg(F.sum("d").alias("__d"), F.min("p").alias("__p"))
    before = F.coalesce(F.sum("__d").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.select("contig", "__bin", before.alias("__before"), F.lead("__p").over(order).alias("__next"))
    w = Window.partitionBy("contig", "__bin").orderBy("p")
    rows = steps.join(bins, ["contig", "__bin"])
    runs = rows.select("contig", F.col("p").alias("start"), F.coalesce(F.lead("p").over(w), "__next").alias("end"), (F.sum("d").over(w) + F.col("__before")).alias("depth"))
    return runs.where("depth > 0")
