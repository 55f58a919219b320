"""Reports of the trainers: endpoint metrics, success gates and operating points, as aggregates over long tables.

truth: a row a truth observation and system, with original_called and called. negatives: a row a reference row that a
system calls. Rates without a divisor are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweave.operators import metrics as M

#: The selection's name, and below the gates' limits (a gain of 0.10, 2 false calls more a run, 8 rescued
#: calls, 1 added false call, 2 more a run) and the names of the columns that hold their verdicts.
SELECTION = "POSTHOC_MAX_TP_WITH_FP_BUDGET"
ORIGINAL = "ORIGINAL"
IDENTITY = ["sample", "run", "locus_id"]


def _rates(out: DataFrame) -> DataFrame:
    return out.withColumns({"FN": F.col("truth_total") - F.col("TP"), "sensitivity": F.try_divide(F.col("TP").cast("double"), F.col("truth_total")), "precision": F.try_divide(F.col("TP").cast("double"), F.col("TP") + F.col("FP"))})


def with_original(truth: DataFrame) -> DataFrame:
    """The truth rows of the systems, and each observation once more for the original calls."""
    plain = truth.dropDuplicates(IDENTITY).withColumns({"system": F.lit(ORIGINAL), "called": F.coalesce("original_called", F.lit(False))})
    return truth.withColumn("called", F.coalesce("called", F.lit(False))).unionByName(plain)


def negative_calls(scored: DataFrame, threshold: Column, baseline: DataFrame, by: list[str]) -> DataFrame:
    """A row a false call: system and the columns `by`, the original's from the baseline."""
    own = scored.where((F.col("label") == 0) & (F.col("probability") >= threshold)).select("system", *by)
    return own.unionByName(baseline.select(F.lit(ORIGINAL).alias("system"), *by))


def endpoint_metrics(truth: DataFrame, negatives: DataFrame, by: list[str] | None = None) -> DataFrame:
    """TP, FP, FN, truth_total, sensitivity, precision, rescued and lost calls of each system and group of truth rows."""
    keys = ["system", *(by or [])]
    before = F.coalesce("original_called", F.lit(False))
    found = truth.groupBy(*keys).agg(F.count_if("called").alias("TP"), F.count(F.lit(1)).alias("truth_total"), F.count_if(~before & F.col("called")).alias("rescued_original_fn"), F.count_if(before & ~F.col("called")).alias("lost_original_tp"))
    return _rates(found.join(negatives.groupBy(*keys).agg(F.count(F.lit(1)).alias("FP")), keys, "left").fillna(0, ["FP"]))


def success_gate(metrics: DataFrame, runs: DataFrame, min_gain: float = 0.10, most_fp: float = 2.0) -> DataFrame:
    """metrics of all rows with the sensitivity gained over the original calls, false calls a run, those added, and
    whether both keep the gate. runs: one row, n. A row a system, so what joins is one row."""
    out = metrics.crossJoin(runs.select("n")).withColumn("fp_per_run", F.try_divide(F.col("FP").cast("double"), F.col("n"))).drop("n")
    first = out.where(F.col("system") == ORIGINAL).select(F.col("sensitivity").alias("__s"), F.col("fp_per_run").alias("__f"))
    out = out.crossJoin(first).withColumns({"sensitivity_gain_vs_original": F.col("sensitivity") - F.col("__s"), "additional_fp_per_run_vs_original": F.col("fp_per_run") - F.col("__f")}).drop("__s", "__f")
    return out.withColumn("meets_exploratory_success_gate", F.coalesce((F.col("sensitivity_gain_vs_original") >= min_gain) & (F.col("additional_fp_per_run_vs_original") <= most_fp), F.lit(False)))


def posthoc_budget(scored: DataFrame, truth: DataFrame, baseline: DataFrame, runs: int, extra: int = 2) -> DataFrame:
    """The operating point of each system with most true candidates within the original's false calls and `extra` a run.
    scored: system, identity, label, probability; truth: a row an observation. Chosen after the labels were seen."""
    budget = baseline.count() + extra * runs
    limit = M.fp_budget_threshold(scored, ["system"], budget)
    systems = limit.select("system", "threshold")
    at = scored.join(F.broadcast(systems), "system").where(F.col("probability") >= F.col("threshold"))  # a row a system
    hits = at.select("system", *IDENTITY).withColumn("__hit", F.lit(True))
    wide = truth.select(*IDENTITY, "original_called").crossJoin(F.broadcast(systems)).join(hits, ["system", *IDENTITY], "left").withColumn("called", F.coalesce("__hit", F.lit(False)))
    out = endpoint_metrics(wide, at.where("label = 0").select("system")).join(systems, "system")
    return out.withColumns({"selection": F.lit(SELECTION), "fp_budget_total": F.lit(budget), "fp_per_run": F.try_divide(F.col("FP").cast("double"), F.lit(runs))})


def addon_metrics(truth: DataFrame, added: DataFrame, baseline: DataFrame, by: str = "evaluation_stratum", everything: str | None = "ALL") -> DataFrame:
    """Metrics of calls that keep every original one, by group: false calls are the baseline's and those added. truth: of
    `with_original`, with `by`; added: a row an added false call (system, by); baseline: a row an original one (by)."""
    sets = lambda df, *keys: df if everything is None else df.unionByName(df.withColumn(by, F.lit(everything)))
    own = endpoint_metrics(sets(truth), sets(added).select("system", by), [by]).withColumnRenamed("FP", "additional_FP")
    first = sets(baseline.select(by)).groupBy(by).agg(F.count(F.lit(1)).alias("baseline_FP"))
    out = _rates(own.join(first, by, "left").fillna(0, ["baseline_FP"]).withColumn("FP", F.col("baseline_FP") + F.col("additional_FP")))
    zero = out.where(F.col("system") == ORIGINAL).select(by, F.col("sensitivity").alias("__s"))
    return out.join(zero, by, "left").withColumn("sensitivity_gain_vs_original", F.col("sensitivity") - F.col("__s")).drop("__s")


def addon_gate(metrics: DataFrame, required: int = 8, allowed: int = 1, by: str = "evaluation_stratum", everything: str = "ALL") -> DataFrame:
    """Whether a system rescues enough for the false calls it adds, over all strata."""
    return metrics.withColumn("meets_predefined_gate", (F.col(by) == everything) & (F.col("rescued_original_fn") >= required) & (F.col("additional_FP") <= allowed))


def ordered_systems(metrics: DataFrame, systems: list[str]) -> DataFrame:
    """The rows of the listed systems in the list's order, as a figure shows them; a system without a row is an error."""
    place = F.array_position(F.lit(systems), F.col("system"))
    out = metrics.where(place > 0)
    missing = sorted(set(systems) - {r[0] for r in out.select("system").distinct().collect()})  # as many as are listed
    if missing:
        raise ValueError(f"no metrics of {', '.join(missing)}")
    return out.withColumn("place", place.cast("int")).orderBy("place")
