"""Queries over the trainers' reports and what folds guarantee, on call tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.operators import folds as FO
from seqweave.operators import metrics as M

from . import reports as P
from .derived import relation
from .metric_queries import CTE, calls
from .models import feature_sets

QUERIES: dict = {}
SQL: dict = {}
CALLED = 0.9


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_OBS = f"""{CTE}, o AS (SELECT truth_profile AS sample, run, locus_id, truth_profile, any_value(evaluation_stratum) AS evaluation_stratum, max(label) AS label, bool_or(original_called) AS original_called, max(probability) AS probability FROM c GROUP BY truth_profile, run, locus_id),
t AS (SELECT *, 'M' AS system, probability >= {CALLED} AS called FROM o WHERE label = 1 UNION ALL SELECT *, 'ORIGINAL', original_called FROM o WHERE label = 1),
f AS (SELECT *, 'M' AS system FROM o WHERE label = 0 AND probability >= {CALLED} UNION ALL SELECT *, 'ORIGINAL' FROM o WHERE label = 0 AND original_called)"""
_SUMS = "count(*) FILTER (called) AS tp, count(*) AS truth_total, count(*) FILTER (NOT original_called AND called) AS rescued_original_fn, count(*) FILTER (original_called AND NOT called) AS lost_original_tp"
_RATES = 'tp AS "TP", coalesce(fp, 0) AS "FP", truth_total - tp AS "FN", truth_total, tp / nullif(truth_total, 0) AS sensitivity, tp / nullif(tp + coalesce(fp, 0), 0) AS precision, rescued_original_fn, lost_original_tp'


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calls(spark, sf_dir).withColumn("sample", F.col("truth_profile"))
    return rows.groupBy("truth_profile", *P.IDENTITY).agg(F.any_value("evaluation_stratum").alias("evaluation_stratum"), F.max("label").alias("label"), F.bool_or("original_called").alias("original_called"), F.max("probability").alias("probability")).withColumn("system", F.lit("M"))


def _sides(spark: SparkSession, sf_dir: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    rows = _observed(spark, sf_dir)
    truth = P.with_original(rows.where("label = 1").withColumn("called", F.col("probability") >= CALLED))
    return truth, P.negative_calls(rows, F.lit(CALLED), rows.where("label = 0 AND original_called"), by)


def _by(group: str) -> str:
    return f"""{_OBS}, a AS (SELECT system, {group}, {_SUMS} FROM t GROUP BY system, {group}), b AS (SELECT system, {group}, count(*) AS fp FROM f GROUP BY system, {group})
SELECT a.system, a.{group}, {_RATES} FROM a LEFT JOIN b USING (system, {group})"""


@query(_by("sample"))
def per_sample_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.endpoint_metrics(*_sides(spark, sf_dir, ["sample"]), ["sample"])


@query(_by("run"))
def per_run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.endpoint_metrics(*_sides(spark, sf_dir, ["run"]), ["run"])


_GATED = f"""{_OBS}, a AS (SELECT system, {_SUMS} FROM t GROUP BY system), b AS (SELECT system, count(*) AS fp FROM f GROUP BY system), n AS (SELECT count(DISTINCT run) AS n FROM o WHERE label = 1),
m AS (SELECT system, {_RATES}, coalesce(fp, 0) / n AS fp_per_run FROM a LEFT JOIN b USING (system), n), z AS (SELECT sensitivity AS s, fp_per_run AS f FROM m WHERE system = 'ORIGINAL')"""


@query(f"{_GATED} SELECT m.*, sensitivity - s AS sensitivity_gain_vs_original, fp_per_run - f AS additional_fp_per_run_vs_original, sensitivity - s >= 0.1 AND fp_per_run - f <= 2 AS meets_exploratory_success_gate FROM m, z")
def success_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, false = _sides(spark, sf_dir, [])
    return P.success_gate(P.endpoint_metrics(truth, false), truth.agg(F.count_distinct("run").alias("n")))


@query(f"""{_OBS}, n AS (SELECT count(*) FILTER (label = 0 AND original_called) + 2 * count(DISTINCT run) AS budget, count(DISTINCT run) AS runs FROM o),
sc AS (SELECT probability AS s, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM o GROUP BY probability), cu AS (SELECT s, sum(p) OVER (ORDER BY s DESC) AS cp, sum(n) OVER (ORDER BY s DESC) AS cn FROM sc),
th AS (SELECT s AS threshold FROM cu, n WHERE cn <= budget ORDER BY cp DESC, cn, s DESC LIMIT 1),
a AS (SELECT count(*) FILTER (called) AS tp, count(*) AS truth_total, count(*) FILTER (NOT original_called AND called) AS rescued_original_fn, count(*) FILTER (original_called AND NOT called) AS lost_original_tp FROM (SELECT *, probability >= threshold AS called FROM o, th WHERE label = 1)),
b AS (SELECT count(*) AS fp FROM o, th WHERE label = 0 AND probability >= threshold)
SELECT 'M' AS system, 'POSTHOC_MAX_TP_WITH_FP_BUDGET' AS selection, budget AS fp_budget_total, threshold, {_RATES}, fp / runs AS fp_per_run FROM a, b, n, th""")
def posthoc_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _observed(spark, sf_dir)
    runs = rows.agg(F.count_distinct("run")).first()[0]
    return P.posthoc_budget(rows, rows.where("label = 1"), rows.where("label = 0 AND original_called"), runs)


@query(f"""{_OBS}, u AS (SELECT * REPLACE (original_called OR called AS called) FROM t), ua AS (SELECT * FROM u UNION ALL SELECT * REPLACE ('ALL' AS evaluation_stratum) FROM u),
ad AS (SELECT evaluation_stratum FROM o WHERE label = 0 AND NOT original_called AND probability >= {CALLED}), aa AS (SELECT * FROM ad UNION ALL SELECT 'ALL' FROM ad), ba AS (SELECT evaluation_stratum FROM o WHERE label = 0 AND original_called), bb AS (SELECT * FROM ba UNION ALL SELECT 'ALL' FROM ba),
a AS (SELECT system, evaluation_stratum, {_SUMS} FROM ua GROUP BY system, evaluation_stratum), x AS (SELECT 'M' AS system, evaluation_stratum, count(*) AS n FROM aa GROUP BY evaluation_stratum), y AS (SELECT evaluation_stratum, count(*) AS n FROM bb GROUP BY evaluation_stratum),
m AS (SELECT a.*, coalesce(x.n, 0) AS added, coalesce(y.n, 0) AS base, coalesce(x.n, 0) + coalesce(y.n, 0) AS fp FROM a LEFT JOIN x USING (system, evaluation_stratum) LEFT JOIN y USING (evaluation_stratum)), z AS (SELECT evaluation_stratum, tp / truth_total AS s FROM m WHERE system = 'ORIGINAL')
SELECT system, evaluation_stratum, {_RATES}, base AS "baseline_FP", added AS "additional_FP", tp / nullif(truth_total, 0) - s AS sensitivity_gain_vs_original, evaluation_stratum = 'ALL' AND rescued_original_fn >= 8 AND added <= 1 AS meets_predefined_gate FROM m JOIN z USING (evaluation_stratum)""")
def addon_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _observed(spark, sf_dir)
    truth = rows.where("label = 1").withColumn("called", F.col("original_called") | (F.col("probability") >= CALLED))
    added = rows.where((F.col("label") == 0) & ~F.col("original_called") & (F.col("probability") >= CALLED))
    return P.addon_gate(P.addon_metrics(P.with_original(truth), added, rows.where("label = 0 AND original_called")))


@query(f"""{_GATED} SELECT system, list_position(['M', 'ORIGINAL'], system) AS place, sensitivity FROM m""")
def figure_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.ordered_systems(P.endpoint_metrics(*_sides(spark, sf_dir, [])), ["M", "ORIGINAL"]).select("system", "place", "sensitivity")


# What folds guarantee, whatever is drawn

_LOCI = f"{CTE}, l AS (SELECT locus_id, max(label) AS y, count(*) AS n FROM c GROUP BY locus_id), k AS (SELECT count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM l)"


@query(f"{_LOCI}, s AS (SELECT unnest(range(0, 5)) AS fold) SELECT CAST(fold AS INT) AS fold, (p - fold + 4) // 5 AS positive_loci, (q - fold + 4) // 5 AS negative_loci, 1 AS folds_of_a_locus FROM s, k")
def locus_fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round robin: the first folds of a class hold one locus more; no locus is in two."""
    rows = FO.locus_folds(calls(spark, sf_dir, "run", "locus_id", "ord", "label"))
    loci = rows.groupBy("locus_id").agg(F.max("label").alias("y"), F.min("fold").alias("fold"), F.count_distinct("fold").cast("int").alias("n"))
    return loci.groupBy("fold").agg(F.count_if(F.col("y") == 1).alias("positive_loci"), F.count_if(F.col("y") == 0).alias("negative_loci"), F.max("n").alias("folds_of_a_locus"))


@query(f"""{_LOCI}, e AS (SELECT p, q, least(p - 1, greatest(1, CAST(round_even(p * 0.25, 0) AS BIGINT))) AS a, least(q - 1, greatest(1, CAST(round_even(q * 0.25, 0) AS BIGINT))) AS b FROM k)
SELECT 'test' AS split, a AS positive_loci, b AS negative_loci, 1 AS splits_of_a_locus FROM e UNION ALL SELECT 'train', p - a, q - b, 1 FROM e""")
def locus_split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = FO.locus_split(calls(spark, sf_dir, "run", "locus_id", "ord", "label"))
    loci = rows.groupBy("locus_id").agg(F.max("label").alias("y"), F.min("split").alias("split"), F.count_distinct("split").cast("int").alias("n"))
    return loci.groupBy("split").agg(F.count_if(F.col("y") == 1).alias("positive_loci"), F.count_if(F.col("y") == 0).alias("negative_loci"), F.max("n").alias("splits_of_a_locus"))


@query(f"{_LOCI} SELECT 5 AS folds, (SELECT count(*) FROM l) AS loci, (SELECT sum(n) FROM l) AS rows, 1 AS folds_of_a_locus, true AS even")
def stratified_fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every locus in one fold; the greedy rule keeps the folds of a class within two of the largest loci of each other."""
    rows = FO.stratified_group_folds(calls(spark, sf_dir, "run", "locus_id", "ord", "label"))
    loci = rows.groupBy("locus_id").agg(F.max("label").alias("y"), F.count(F.lit(1)).alias("r"), F.min("fold").alias("fold"), F.count_distinct("fold").cast("int").alias("n"))
    most = loci.agg(F.max("r").alias("most"))
    sums = loci.groupBy("fold").agg(F.count(F.lit(1)).alias("loci"), F.sum("r").alias("rows"), F.sum(F.when(F.col("y") == 1, F.col("r")).otherwise(0)).alias("p"), F.max("n").alias("n"))
    out = sums.agg(F.count(F.lit(1)).cast("int").alias("folds"), F.sum("loci").alias("loci"), F.sum("rows").cast("decimal(38,0)").alias("rows"), F.max("n").alias("folds_of_a_locus"), (F.max("p") - F.min("p")).alias("a"), (F.max(F.col("rows") - F.col("p")) - F.min(F.col("rows") - F.col("p"))).alias("b"))
    return out.crossJoin(most).select("folds", "loci", "rows", "folds_of_a_locus", ((F.col("a") <= 2 * F.col("most")) & (F.col("b") <= 2 * F.col("most"))).alias("even"))  # of one row each


@query(f"{CTE}, d AS (SELECT locus_id, count(DISTINCT label) AS labels FROM c GROUP BY locus_id) SELECT count(*) AS loci, count(*) FILTER (labels > 1) AS mixed, (SELECT count(DISTINCT run) FROM c) AS runs FROM d")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calls(spark, sf_dir, "run", "locus_id", "label")
    mixed = M.inconsistent_loci(rows).agg(F.count(F.lit(1)).alias("mixed"))
    return rows.agg(F.count_distinct("locus_id").alias("loci"), F.count_distinct("run").alias("runs")).crossJoin(mixed)  # of one row each


_SETS = {
    "caller": {"M1_VCF": "vcf_AF vcf_HS vcf_TYPE hp_base indel_type", "M2_VCF_BAM": "vcf_AF vcf_HS vcf_TYPE bam_alt_support bam_coverage hp_base indel_type", "M3_VCF_BAM_FLOW": "vcf_AF vcf_HS vcf_TYPE bam_alt_support bam_coverage flow_reads hp_base indel_type"},
    "rescue": {"R0_DISCOVERY": "bam_alt_support hp_base indel_type", "R1_BAM": "bam_alt_support bam_coverage hp_base indel_type", "R2_BAM_FLOW": "bam_alt_support bam_coverage flow_reads hp_base indel_type"},
    "hotspot": {"A1_VCF_CONTEXT": "vcf_AF vcf_TYPE hp_base indel_type", "A2_VCF_BAM": "vcf_AF vcf_TYPE bam_alt_support bam_coverage hp_base indel_type", "A3_VCF_BAM_FLOW": "vcf_AF vcf_TYPE bam_alt_support bam_coverage flow_reads hp_base indel_type", "A4_PAIRED_NA": "vcf_AF vcf_TYPE bam_alt_support bam_coverage flow_reads hp_base indel_type paired_delta__x"},
}


_HELD = {
    "bam_alt_support": "CAST(l_quantity AS DOUBLE)", "bam_coverage": "CASE WHEN l_linenumber > 1 THEN l_linenumber END", "flow_reads": "l_suppkey % 9", "gc": "l_discount", "hp_base": "substr('ACGT', CAST(l_partkey % 4 AS INT) + 1, 1)", "indel_type": "l_linestatus",
    "paired_delta__x": "CASE WHEN l_tax > 0.03 THEN l_tax END", "sample": "l_linestatus", "vcf_AF": "CASE WHEN l_discount > 0 THEN l_discount END", "vcf_HS": "1", "vcf_TYPE": "CASE WHEN l_returnflag <> 'N' THEN l_returnflag END",
}


@query("WITH f AS (SELECT kind, model, unnest(string_split(cols, ' ')) AS feature FROM (VALUES " + ", ".join(f"('{k}', '{m}', '{c}')" for k, v in _SETS.items() for m, c in v.items()) + ") AS v(kind, model, cols)), h AS (" + " UNION ALL ".join(f"SELECT '{k}' AS feature, count({v}) AS held FROM lineitem" for k, v in _HELD.items()) + ") SELECT kind, model, feature, held FROM f JOIN h USING (feature)")
def model_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a candidate table that each model uses, with the rows that hold a value."""
    rows = relation(spark, sf_dir, _HELD, "lineitem")
    held = rows.agg(*(F.count(c).alias(c) for c in rows.columns)).select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("held")) for c in rows.columns))))
    names = [(kind, model, f) for kind in _SETS for model, features in feature_sets(rows.columns, kind).items() for f in features]
    return spark.createDataFrame(names, "kind string, model string, feature string").join(held, "feature").select("kind", "model", "feature", "held")
