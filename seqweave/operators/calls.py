"""Call tables: the best row of a key, labels from truth sets, and paired control differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweave.functions.alleles import end0, label_columns

from .intervals import joined
from .ranges import quantiles, running
from .staging import staged

KEY = ["chrom", "pos", "ref", "alt"]


def positive_or_minus_one(value: Column) -> Column:
    """A missing or zero score ranks as -1."""
    number = value.try_cast("double")
    return F.when(number.isNull() | (number == 0), -1.0).otherwise(number)


def best_calls(calls: DataFrame, keys: list[str], scores: list[str], order: str, then: tuple[str, ...] = ()) -> DataFrame:
    """For each key the row of the greatest scores in turn; the first in `order` of equal ones, and by `then` where that
    has ties."""
    w = Window.partitionBy(*keys).orderBy(*(positive_or_minus_one(F.col(c)).desc() for c in scores), F.col(order), *(F.col(c) for c in then))
    return calls.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def labelled(candidates: DataFrame, synthetic: DataFrame, giab: DataFrame, benchmark: DataFrame) -> DataFrame:
    """candidates with label, label_name and truth_source. synthetic, giab: truth keys; benchmark: merged intervals."""
    candidates = staged(candidates)
    flag = lambda truth, name: truth.select(*KEY).distinct().withColumn(name, F.lit(True))
    out = candidates.join(flag(synthetic, "__syn"), KEY, "left").join(flag(giab, "__giab"), KEY, "left")
    out = out.withColumns({"__start": F.col("pos") - 1, "__end": end0(F.col("pos"), F.col("ref"))})
    # Merged intervals hold a query in one at most, so this keeps one row a candidate.
    places = joined(out.select("chrom", "__start", "__end").distinct(), benchmark, "left_semi", True, "__start", "__end", "chrom").withColumn("__in", F.lit(True))
    out = out.join(places, ["chrom", "__start", "__end"], "left")
    known = lambda c: F.coalesce(F.col(c), F.lit(False))
    labels = label_columns(known("__syn"), known("__giab"), known("__in"))
    return out.select(*candidates.columns, *labels)


def with_control_deltas(frame: DataFrame, evidence: list[str], locus: str = "locus_id", control: Column | None = None) -> DataFrame:
    """For each evidence column its median over the control rows of the locus, and the difference from that."""
    control = F.col("truth_profile") == "HG002" if control is None else control
    number = lambda c: F.col(c).try_cast("double")
    if not evidence:
        return frame
    entries = F.array(*(F.struct(F.lit(k).alias("__column"), number(c).alias("__value")) for k, c in enumerate(evidence)))
    long = frame.where(control).select(locus, F.inline(entries))
    middle = quantiles(long, [locus, "__column"], "__value", {"__median": 0.5})
    medians = middle.groupBy(locus).agg(*(F.max(F.when(F.col("__column") == k, F.col("__median"))).alias(f"na_median__{c}") for k, c in enumerate(evidence)))
    out = frame.join(medians, locus, "left")
    return out.withColumns({f"paired_delta__{c}": number(c) - F.col(f"na_median__{c}") for c in evidence})


def evidence_columns(frame: DataFrame, prefixes: tuple[str, ...] = ("vcf_", "bam_", "flow_"), without: tuple[str, ...] = ("vcf_FILTER", "vcf_GT", "vcf_TYPE")) -> list[str]:
    """Prefixed columns, but for texts by name, that hold any number: one pass over the table."""
    names = sorted(c for c in frame.columns if c.startswith(prefixes) and c not in without)
    if not names:
        return []
    found = frame.agg(*(F.count(F.col(c).try_cast("double")).alias(c) for c in names)).first()
    return [c for c in names if found[c]]


def evenly(rows: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """Of each group's n rows in order, those numbered round(i * (n - 1) / (most - 1)), halves to even; all of them where
    there are no more than `most`, or most is 0."""
    if most <= 0:
        return rows
    ranked = running(rows.withColumn("__one", F.lit(1)), by, [F.col(c) for c in order], {"__k": "__one"}, {"__n": "__one"})
    last, place = F.col("__n") - 1, F.col("__k") - 1
    # A row is chosen by one of the numbers around its share of the way.
    about = F.floor(place * (most - 1) / F.greatest(last, F.lit(1)))
    picks = lambda i: (i >= 0) & (i < most) & (F.bround((i * last).cast("double") / max(most - 1, 1), 0) == place)
    return ranked.where((F.col("__n") <= most) | picks(about - 1) | picks(about) | picks(about + 1)).select(*rows.columns)
