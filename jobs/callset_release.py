"""Release of an add-on callset, run by run.

    python -m jobs.callset_release --calls PATH --output PATH [--config jobs/callset_release.json] [--runs 1,2]

Scored call rows of many runs become a callset that an analyst can hand on: the best row of each run and locus is
kept; each run's threshold is the one that finds most of its labelled control positives with at most
`false_positives` false calls among those controls that the caller left out; rows at the threshold are rescued and no
call of the caller is lost. The output has two Parquet tables, both partitioned by run:

- `calls`: the kept rows with threshold, rescued and final_called;
- `metrics`: of each run, system (ORIGINAL, ADDON) and stratum (and ALL) the confusion counts over labelled rows.

A partition is replaced as a whole (dynamic partition overwrite), so a rerun gives the same tables, and a run that
is delivered again replaces only itself: `--runs` limits the work to such runs, and other partitions stay as they are.
Rows without a run or locus are left out and counted in the log; a null label counts in no metric; a null or zero score
is never rescued before a positive one. `columns` of the config maps the input's columns by SQL expressions, so that any
call table can be read, and only the columns in use are.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.operators import calls as C
from seqweave.operators import metrics as M

log = logging.getLogger("callset_release")
CONFIG = Path(__file__).with_suffix(".json")
SYSTEMS = {"ORIGINAL": "original_called", "ADDON": "final_called"}
_NEEDED = ("run", "locus_id", "ord", "probability", "label", "original_called", "stratum", "control")
#: What decides between rows that share even `ord`, so that reruns keep the same one.
_REST = ("original_called", "label", "stratum", "control")


def config_of(path: str | Path = CONFIG) -> dict:
    config = json.loads(Path(path).read_text())
    missing = sorted(set(_NEEDED) - set(config.get("columns", {})))
    if missing:
        raise ValueError(f"{path}: `columns` lacks {missing}")
    if not isinstance(config.get("false_positives"), int) or config["false_positives"] < 0:
        raise ValueError(f"{path}: `false_positives` is a count of 0 or more")
    return config


def released(rows: DataFrame, budget: int) -> DataFrame:
    """The best row of each run and locus, with its run's threshold and what that makes of it."""
    best = C.best_calls(rows, ["run", "locus_id"], ["probability"], "ord", _REST)
    known = rows.where(F.col("control") & F.col("label").isNotNull())
    limits = M.fp_budget_threshold(C.best_calls(known, ["run", "locus_id"], ["probability"], "ord", _REST), ["run"], budget, called="original_called")
    # A run without controls has no threshold: nothing is rescued there. Few rows, one a run.
    return M.addon_calls(best.join(limits, "run", "left"), F.col("threshold"))


def metrics_of(calls: DataFrame) -> DataFrame:
    """Confusion counts of each run, system and stratum; the stratum ALL has all rows."""
    known = calls.where("label IS NOT NULL")
    long = known.select("run", "stratum", "label", F.inline(F.array(*(F.struct(F.lit(k).alias("system"), F.coalesce(c, F.lit(False)).alias("called")) for k, c in SYSTEMS.items()))))
    tp, fp, total = F.count_if(F.col("called") & (F.col("label") == 1)), F.count_if(F.col("called") & (F.col("label") == 0)), F.count_if(F.col("label") == 1)
    sums = [tp.alias("TP"), fp.alias("FP"), (total - tp).alias("FN"), F.try_divide(tp.cast("double"), total).alias("sensitivity"), F.try_divide(tp.cast("double"), tp + fp).alias("precision")]
    out = long.groupingSets([["run", "system", "stratum"], ["run", "system"]], "run", "system", "stratum").agg(F.grouping("stratum").alias("__all"), *sums)
    return out.withColumn("stratum", F.when(F.col("__all") == 1, "ALL").otherwise(F.col("stratum"))).drop("__all")


def release(spark: SparkSession, calls: str, output: str, config: dict, runs: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Reads the call table at `calls` and writes `output`/calls and `output`/metrics, which it returns as they stand."""
    rows = spark.read.parquet(calls).selectExpr(*(f"{config['columns'][c]} AS `{c}`" for c in _NEEDED))
    if runs is not None:
        rows = rows.where(F.col("run").cast("string").isin(runs))
    whole = F.col("run").isNotNull() & F.col("locus_id").isNotNull()
    seen = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~whole).alias("left_out")).first()
    log.info("read %s: %s rows, %s without run or locus", calls, seen["rows"], seen["left_out"])
    out = released(rows.where(whole), config["false_positives"])

    def saved(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{output}/{name}")
        return spark.read.schema(df.schema).parquet(f"{output}/{name}")

    mine = F.col("run").cast("string").isin(runs) if runs is not None else F.lit(True)
    # A run's rows go to 16 tasks, so that one with most of the rows is not one task's.
    released_rows = saved(out.repartition("run", F.pmod(F.xxhash64("locus_id"), F.lit(16))), "calls")
    kept = released_rows.where(mine).agg(F.count(F.lit(1)).alias("rows"), F.count_if("rescued").alias("rescued")).first()
    log.info("wrote %s/calls: %s rows, %s rescued", output, kept["rows"], kept["rescued"])
    metrics = saved(metrics_of(released_rows.where(mine)), "metrics")
    log.info("wrote %s/metrics: %s rows", output, metrics.where(mine).count())
    return released_rows, metrics


def together(calls: DataFrame, metrics: DataFrame) -> DataFrame:
    """Both tables as one, told apart by `part`."""
    return calls.withColumn("part", F.lit("calls")).unionByName(metrics.withColumn("part", F.lit("metrics")), allowMissingColumns=True)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n", 1)[0])
    parser.add_argument("--calls", required=True, help="path of the call table (Parquet)")
    parser.add_argument("--output", required=True, help="folder of the output")
    parser.add_argument("--config", default=str(CONFIG))
    parser.add_argument("--runs", help="only these runs, by commas")
    args = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = config_of(args.config)
    spark = SparkSession.builder.appName("callset_release").getOrCreate()
    try:
        release(spark, args.calls, args.output, config, args.runs.split(",") if args.runs else None)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
