"""Call metrics, thresholds, average precision, bootstrap intervals and checks, as aggregates and windows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranges import running
from .staging import staged

NAN = float("nan")


def confusion(called: Column, false_positives: Column) -> list[Column]:
    """TP, FP, FN, total and rates from aggregates: called counts truth rows, null as not called."""
    tp = F.count_if(F.coalesce(called, F.lit(False)))
    total = F.count(F.lit(1))
    return [
        tp.alias("TP"), false_positives.alias("FP"), (total - tp).alias("FN"), total.alias("truth_total"),
        F.try_divide(tp.cast("double"), total).alias("sensitivity"), F.try_divide(tp.cast("double"), tp + false_positives).alias("precision"),
    ]


def strata_metrics(calls: DataFrame, systems: dict[str, str], truth: str = "is_truth", by: str = "evaluation_stratum", everything: str | None = "ALL") -> DataFrame:
    """For each system (name: boolean call column) and stratum TP, FP, FN, truth_total, sensitivity and precision.

    calls: a row a call site; truth is true for truth rows, false for reference rows. everything: the name of the
    stratum of all rows, None for none. One pass: systems unpivot, strata are grouping sets.
    """
    long = calls.select(by, truth, F.inline(F.array(*(F.struct(F.lit(k).alias("system"), F.coalesce(F.col(c), F.lit(False)).alias("called")) for k, c in systems.items()))))
    tp = F.count_if(F.col("called") & F.col(truth))
    fp = F.count_if(F.col("called") & ~F.col(truth))
    total = F.count_if(F.col(truth))
    sums = [tp.alias("TP"), fp.alias("FP"), (total - tp).alias("FN"), total.alias("truth_total"), F.try_divide(tp.cast("double"), total).alias("sensitivity"), F.try_divide(tp.cast("double"), tp + fp).alias("precision")]
    if everything is None:
        return long.groupBy("system", by).agg(*sums)
    grouped = long.groupingSets([[F.col("system"), F.col(by)], [F.col("system")]], "system", by).agg(F.grouping(by).alias("__all"), *sums)
    return grouped.withColumn(by, F.when(F.col("__all") == 1, everything).otherwise(F.col(by))).drop("__all")


def gain_over_first(metrics: DataFrame, value: str, by: str, order: str, out: str = "gain") -> DataFrame:
    """The value minus that of the group's first row in `order`."""
    first = F.first(value).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return metrics.withColumn(out, F.col(value) - first)


def _by_score(scored: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """A row for each distinct score of a group, with positives and negatives at it or above and all its positives.

    The counts at a score are aggregated first; the sums run over ranges of scores, so a group is never one task's.
    """
    counts = scored.groupBy(*by, F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    return running(counts, by, [F.col("s").desc()], {"cp": "p", "cn": "n"}, {"positives": "p"})


def average_precision(scored: DataFrame, by: list[str], label: str = "label", score: str = "probability") -> DataFrame:
    """Sum over distinct scores of the recall gained times the precision there."""
    steps = _by_score(scored, by, label, score)
    part = F.try_divide(F.col("p").cast("double"), F.col("positives")) * (F.col("cp") / (F.col("cp") + F.col("cn")))
    return steps.withColumn("__part", part).groupBy(*by).agg(F.sum("__part").alias("average_precision"))


def end_to_end_average_precision(scored: DataFrame, truth: DataFrame, key: list[str], by: list[str], label: str = "label", score: str = "probability") -> DataFrame:
    """Average precision with the truth rows that have no candidate as positives of score 0."""
    missing = truth.select(*key).distinct().join(scored.select(*key).distinct(), key, "left_anti")
    missing = missing.select(*key, F.lit(1).alias(label), F.lit(0.0).alias(score))
    both = scored.select(*key, F.col(label).cast("int").alias(label), F.col(score).cast("double").alias(score)).unionByName(missing)
    return average_precision(both, by, label, score)


def precision_at_recall(scored: DataFrame, by: list[str], recall: float, label: str = "label", score: str = "probability") -> DataFrame:
    """The greatest precision at a threshold whose recall is at least the given; with 0, the empty set's 1."""
    steps = _by_score(scored, by, label, score)
    ok = F.try_divide(F.col("cp").cast("double"), F.col("positives")) >= recall
    best = F.max(F.when(F.col("__ok"), F.col("cp") / (F.col("cp") + F.col("cn"))))
    out = steps.withColumn("__ok", ok).groupBy(*by).agg(best.alias("precision"))
    return out.withColumn("precision", F.lit(1.0)) if recall <= 0 else out


def at_threshold(scored: DataFrame, by: list[str], threshold: float, label: str = "label", score: str = "probability") -> DataFrame:
    """Precision and recall at a threshold, 0 where there is nothing to divide by."""
    hit, pos = F.col(score) >= threshold, F.col(label) == 1
    rate = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return scored.groupBy(*by).agg(rate(F.count_if(hit & pos), F.count_if(hit)).alias("precision"), rate(F.count_if(hit & pos), F.count_if(pos)).alias("recall"))


def fp_budget_threshold(scored: DataFrame, by: list[str], budget: int = 0, label: str = "label", score: str = "probability", called: str | None = None, reached: bool = False) -> DataFrame:
    """The threshold that finds most positives with at most `budget` negatives: of equal ones the fewest negatives, then
    the highest. With `called`, only rows not called already count.

    Where no score keeps the budget it lies just above the highest; a group without rows to choose from gets infinity. With
    `reached` both have none (null): only a score that rows have is a threshold then.
    """
    rows = scored if called is None else scored.where(~F.coalesce(F.col(called), F.lit(False)))
    steps = _by_score(rows, by, label, score)
    eligible = F.when(F.col("cn") <= budget, F.struct("cp", (-F.col("cn")).alias("few"), "s"))
    best = steps.groupBy(*by).agg(F.max(eligible)["s"].alias("best"), F.max("s").alias("top"))
    # Just over half a unit in the last place rounds to the next number.
    above = F.col("top") + F.greatest(F.abs("top") * (2.0**-53 * (1 + 2.0**-52)), F.lit(5e-324))
    chosen = best.withColumn("threshold", F.col("best") if reached else F.coalesce("best", above)).drop("best", "top")
    groups = scored.select(*by).distinct()
    if reached:
        return groups.join(chosen, by, "left")
    return groups.join(chosen, by, "left").withColumn("threshold", F.coalesce("threshold", F.lit(math.inf)))


def addon_calls(rows: DataFrame, threshold: Column, called: str = "original_called", score: str = "probability") -> DataFrame:
    """rescued: not called before and at the threshold; final_called: called before or rescued, so none is lost."""
    before = F.coalesce(F.col(called), F.lit(False))
    rescued = ~before & F.coalesce(F.col(score) >= threshold, F.lit(False))
    return rows.withColumns({"rescued": rescued, "final_called": before | rescued})


def bootstrap_draws(loci: int, iterations: int, seed: int) -> np.ndarray:
    """iterations * loci places drawn with replacement, as numpy's default generator draws them."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.integers(0, loci, loci) for _ in range(iterations)]) if loci and iterations else np.zeros((0, loci), np.int64)


def numbered(rows: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """rows with their place from 0 in the order, which no two share. Sorted by ranges; a row a range tells how many stand
    before it."""
    some = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    some = staged(some)
    parts = some.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = some.join(F.broadcast(parts.select("__part", "__first", before.alias("__before"))), "__part")  # a row a partition
    return out.withColumn(name, F.col("__before") + F.col("__at") - F.col("__first")).drop("__part", "__at", "__first", "__before")


def counted_draws(spark: SparkSession, loci: int, iterations: int, seed: int, counted: bool = True) -> DataFrame:
    """iteration, place and times (a row a draw without it unless `counted`): in each iteration as many places as there are, drawn with replacement. Each draw is the
    hash of its own number, so tasks need no list and a task that runs again draws the same."""
    numbers = spark.range(loci * iterations).select(F.floor(F.col("id") / loci).alias("iteration"), (F.col("id") % loci).alias("k"))
    digest = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("iteration").cast("string"), F.col("k").cast("string")))
    place = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % loci
    drawn = numbers.select("iteration", place.alias("place"))
    return drawn if not counted else drawn.groupBy("iteration", "place").agg(F.count(F.lit(1)).alias("times"))


def bootstrap_interval(sums: DataFrame, draws: DataFrame, value: str = "s", weight: str = "n") -> DataFrame:
    """2.5 and 97.5 % quantiles of resampled ratios. sums: place, value and weight of a locus; draws: iteration, place and
    how many times it is drawn, once without that column."""
    times = F.col("times") if "times" in draws.columns else F.lit(1)
    again = draws.join(sums, "place").groupBy("iteration").agg((F.sum(F.col(value) * times).cast("double") / F.sum(F.col(weight) * times)).alias("rate"))
    return again.agg(F.percentile("rate", F.lit(0.025)).alias("low"), F.percentile("rate", F.lit(0.975)).alias("high"))


def one_to_one(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """left join right on the key, which must be unique on both sides."""
    for side, name in ((left, "left"), (right, "right")):
        if not side.groupBy(*key).count().where("count > 1").isEmpty():
            raise ValueError(f"{name} rows share a key of {', '.join(key)}")
    return left.join(right, key, "left")


def quality_counts(rows: DataFrame, by: list[str], counts: dict[str, Column]) -> DataFrame:
    """Conditional counts of each group in long form: by, metric, value. Null groups stay."""
    wide = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in counts.items()))
    return wide.select(*by, F.inline(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).cast("string").alias("value")) for k in ("rows", *counts)))))


def checks(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row: non-empty, rows unique, label names valid, unknown labels excluded, positives present, both classes."""
    twice = rows.groupBy(*key).count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("most"))
    names = F.col("label_name").isin("TP", "REFERENCE", "UNKNOWN")
    out = rows.agg(
        (F.count(F.lit(1)) > 0).alias("dataset_nonempty"), F.coalesce(F.bool_and(F.coalesce(names, F.lit(False))), F.lit(True)).alias("label_names_valid"),
        (F.count_if((F.col("label_name") == "UNKNOWN") & F.col("label").isNotNull()) == 0).alias("unknown_labels_excluded"),
        (F.count_if(F.col("label") == 1) > 0).alias("positive_truth_matches_present"), (F.count_distinct("label") == 2).alias("both_classes_present"),
    )
    return out.crossJoin(twice.select((F.col("most") <= 1).alias("candidate_rows_unique")))  # of one row each


def inconsistent_loci(rows: DataFrame, locus: str = "locus_id", label: str = "label") -> DataFrame:
    """Loci with more than one label."""
    return rows.groupBy(locus).agg(F.count_distinct(label).alias("labels")).where("labels > 1")
