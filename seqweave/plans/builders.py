"""The three dataset builders: candidates of a caller, blind discovery, and forced hotspots. Each returns DataFrames over
all runs at once, and a check row; nothing is collected but checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.functions import alleles as A
from seqweave.operators import calls as C
from seqweave.operators import evidence as EV
from seqweave.operators import genome as G
from seqweave.operators import metrics as M
from seqweave.operators.intervals import joined
from seqweave.operators.staging import staged
from seqweave.sources import vcf as V

KEY = ["chrom", "pos", "ref", "alt"]
IDENTITY = ["sample", "run", "locus_id"]
#: Runs of several samples may share a name.
BY = ("sample", "run")
SPAN = [*BY, "chrom", "start0", "end0", "hp_base", "hp_ref_len", "hp_alt_len"]


@dataclass
class Inputs:
    """manifest: sample, run, truth_profile. records: of `read_records` over all runs. reads, flow_orders: with sample and run.
    synthetic, giab: truth keys. benchmark, targets: merged intervals. genome: chunks of `size` bases."""

    manifest: DataFrame
    records: DataFrame
    reads: DataFrame
    flow_orders: DataFrame
    synthetic: DataFrame
    giab: DataFrame
    benchmark: DataFrame
    targets: DataFrame
    genome: DataFrame
    size: int = G.CHUNK


def _profiles(frame: DataFrame, inputs: Inputs) -> DataFrame:
    return frame.join(F.broadcast(inputs.manifest.select("sample", "run", "truth_profile")), ["sample", "run"])  # a row a run


def _labelled(frame: DataFrame, inputs: Inputs) -> DataFrame:
    """Labels by the truth sources of each row's profile: the synthetic truth counts for AOHC rows only."""
    synthetic = inputs.synthetic.select(*KEY).withColumn("__syn", F.lit(True))
    out = C.labelled(frame, inputs.synthetic.limit(0), inputs.giab, inputs.benchmark).join(synthetic, KEY, "left")
    both = (F.col("truth_profile") == "AOHC") & F.coalesce("__syn", F.lit(False))
    source = F.when(both & (F.col("truth_source") == A.GIAB), f"{A.SYNTHETIC}+{A.GIAB}").when(both, A.SYNTHETIC).otherwise(F.col("truth_source"))
    return out.withColumns({"label": F.when(both, 1).otherwise(F.col("label")), "label_name": F.when(both, A.TP).otherwise(F.col("label_name")), "truth_source": source}).drop("__syn")


def _with_reads(frame: DataFrame, inputs: Inputs, window: int, most: int | None, flow: bool) -> DataFrame:
    spans = frame.select(*BY, F.col("chrom"), F.greatest(F.lit(0), F.col("hp_start0")).cast("int").alias("start0"), F.greatest(F.col("hp_end0"), F.greatest(F.lit(0), F.col("hp_start0")) + 1).cast("int").alias("end0"), "hp_base", "hp_ref_len", "hp_alt_len", "locus_id")
    found = EV.read_features(spans, inputs.reads, inputs.genome, inputs.flow_orders, [*SPAN, "locus_id"], window, most, flow, inputs.size, BY)
    return frame.join(found.drop(*(c for c in SPAN if c not in BY)), [*BY, "locus_id"], "left")


def caller_dataset(inputs: Inputs, window: int = 5, most_reads: int | None = None, most_candidates: int = 0, flow: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, quality counts, checks) of all of a caller's insertions and deletions in the targets."""
    found = V.candidates(inputs.records, inputs.targets, inputs.genome)
    found = C.evenly(found, ["sample", "run"], KEY, most_candidates).withColumn("chrom", A.canonical_chrom(F.col("chrom")))
    rows = G.with_context(_labelled(_profiles(found, inputs), inputs), inputs.genome, size=inputs.size)
    rows = staged(_with_reads(staged(rows), inputs, window, most_reads, flow).drop("hp_start0", "hp_end0"))
    first = ["sample", "run", *KEY, "locus_id", "label", "label_name", "truth_source"]
    rows = rows.select(*first, *(c for c in rows.columns if c not in first)).orderBy("sample", "run", *KEY)
    counts = {"tp": F.col("label") == 1, "reference": F.col("label") == 0, "unknown": F.col("label").isNull(), "reference_mismatches": ~F.col("reference_match"), "homopolymer_indels": F.col("is_homopolymer_indel"), "candidates_with_flow": F.col("flow_reads") > 0}
    return rows, M.quality_counts(rows, ["sample", "run"], counts), M.checks(rows, IDENTITY)


def hotspot_dataset(inputs: Inputs, min_hp_length: int = 4, min_mapq: int = 20, window: int = 5, most_reads: int = 50, flow: bool = True) -> dict[str, DataFrame]:
    """features: targeted homopolymer rows with read evidence and control differences; truth: rows of the synthetic truth
    in AOHC runs; baseline_fp: called reference rows; checks."""
    found = staged(V.candidates(inputs.records, inputs.targets, inputs.genome, hotspots=True)).withColumn("candidate_source", F.lit("FORCED_HOTSPOT"))
    rows = G.with_context(_labelled(_profiles(found, inputs), inputs), inputs.genome, size=inputs.size)
    targeted = A.targeted_homopolymer(F.col("reference_match"), F.col("is_homopolymer_indel"), F.col("hp_ref_len"), F.col("hp_alt_len"), min_hp_length)
    rows = rows.withColumns({"original_called": A.call_positive(F.col("vcf_FILTER"), F.col("vcf_GT")), "targeted_hp": targeted, "evaluation_stratum": A.stratum(targeted)})
    rows = staged(rows)
    truth = rows.where(F.col("truth_profile") == "AOHC").join(inputs.synthetic.select(*KEY).distinct(), KEY, "left_semi")
    baseline = rows.where("original_called AND label = 0")
    forced = EV.forced_counts(rows.where("targeted_hp").select(*BY, *KEY), inputs.reads, inputs.genome, min_mapq, inputs.size, BY)
    names = {c: f"bam_forced_{c}" for c in ("coverage", "alt_support", "alt_forward_reads", "alt_reverse_reads", "alt_fraction")}
    features = rows.where("targeted_hp").join(forced.withColumnsRenamed(names), [*BY, *KEY], "left")
    features = staged(_with_reads(staged(features), inputs, window, most_reads, flow).drop("hp_start0", "hp_end0"))
    features = C.with_control_deltas(features, C.evidence_columns(features))
    loci = truth.agg(F.count_distinct("locus_id").alias("l"), F.count(F.lit(1)).alias("n"))
    runs = inputs.manifest.agg(F.count_if(F.col("truth_profile") == "AOHC").alias("r"))
    was = found.select(*IDENTITY, A.call_positive(F.col("vcf_FILTER"), F.col("vcf_GT")).alias("__was"))
    kept = features.join(was, IDENTITY, "left").agg(
        F.bool_and(F.coalesce(F.col("original_called") == F.col("__was"), F.lit(False))).alias("original_calls_never_redefined"), F.bool_and((F.col("label_name") == A.UNKNOWN) == F.col("label").isNull()).alias("unknown_rows_unlabelled"),
        F.bool_and((F.col("evaluation_stratum") == "HP") & (F.col("candidate_source") == "FORCED_HOTSPOT")).alias("all_rows_forced_homopolymers"),
    )
    kept = kept.select(*(F.coalesce(c, F.lit(True)).alias(c) for c in kept.columns))
    one = lambda a, b: a.join(b, F.lit(True))  # noqa: E731  of one row each
    checks = one(one(one(M.checks(features, IDENTITY), loci), runs), kept).withColumn("truth_observations_complete", (F.col("l") > 0) & (F.col("n") == F.col("l") * F.col("r"))).drop("l", "n", "r")
    order = ["sample", "run", *KEY]
    features, truth, baseline = features.orderBy(*order), truth.orderBy(*order), baseline.orderBy(*order)
    return {"features": features, "truth": truth, "baseline_fp": baseline.select(*IDENTITY, "truth_profile", *KEY, "label", "evaluation_stratum"), "checks": checks, "qc": M.quality_counts(features, list(BY), {"targeted_hp_positive": F.col("label") == 1, "targeted_hp_reference": F.col("label") == 0, "targeted_hp_unknown": F.col("label").isNull()})}


def rescue_dataset(inputs: Inputs, min_mapq: int = 20, min_support: int = 2, min_alt_fraction: float | None = 0.10, min_hp_length: int = 4, most_length: int = 50, window: int = 5, most_reads: int = 30, flow: bool = True, pileups: DataFrame | None = None) -> dict[str, DataFrame]:
    """features: labelled blind candidates; truth: homopolymer truth loci of each run with forced counts; baseline_fp;
    qc. Candidates come from the reads, or from the records of a pileup caller (pileups: of `read_records`, with sample and
    run), which has no mapping qualities. Discovery never looks at the truth."""
    if pileups is None:
        rows = EV.discovered(inputs.reads, inputs.genome, inputs.targets, min_mapq, min_support, most_length, min_alt_fraction, True, inputs.size, BY)
        counts = EV.discovery_counts(inputs.reads, inputs.genome, inputs.targets, min_mapq, min_support, most_length, min_alt_fraction, min_hp_length, inputs.size, BY)
    else:
        rows = V.pileup_candidates(pileups, inputs.genome, inputs.targets, min_support, min_hp_length, inputs.size)
        rows = rows.select(*BY, *KEY, *(c for c in rows.columns if c.startswith("bam_"))).withColumns({c: F.lit(None).cast("double") for c in ("bam_alt_mapq_mean", "bam_alt_mapq_median")})
        counts = rows.groupBy(*BY).agg(F.lit("retained_candidates").alias("metric"), F.count(F.lit(1)).alias("value"))
    is_target = A.targeted_homopolymer(F.col("reference_match"), F.col("is_homopolymer_indel"), F.col("hp_ref_len"), F.col("hp_alt_len"), min_hp_length)
    rows = rows.withColumns({"locus_id": A.locus_id(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")), "candidate_source": F.lit("BLIND_BAM")})
    rows = G.with_context(_labelled(_profiles(rows, inputs), inputs), inputs.genome, size=inputs.size).where(is_target & F.col("label").isNotNull())
    rows = staged(rows)
    original = staged(V.candidates(inputs.records, inputs.targets, inputs.genome)).withColumns({"chrom": A.canonical_chrom(F.col("chrom")), "called": A.call_positive(F.col("vcf_FILTER"), F.col("vcf_GT"))})
    called = original.select(*IDENTITY, F.col("called").alias("original_called"), F.col("vcf_FILTER").alias("original_filter"), F.col("vcf_GT").alias("original_gt"))
    features = _with_reads(rows, inputs, window, most_reads, flow).join(called, IDENTITY, "left").withColumns({"original_vcf_present": F.col("original_filter").isNotNull(), "original_called": F.coalesce("original_called", F.lit(False))}).drop("hp_start0", "hp_end0")
    sources = inputs.synthetic.select(*KEY).withColumn("s", F.lit(True)).join(inputs.giab.select(*KEY).withColumn("g", F.lit(True)), KEY, "full")
    catalogue = G.with_context(sources.where(F.length("ref") != F.length("alt")), inputs.genome, size=inputs.size).where(is_target)
    spans = catalogue.withColumns({"__a": F.col("pos") - 1, "__b": F.col("pos") - 1 + F.length("ref")})
    catalogue = joined(spans, inputs.targets, "inner", False, "__a", "__b", "chrom").drop("__s", "__e", "__a", "__b").dropDuplicates(KEY)
    syn, giab = F.coalesce("s", F.lit(False)), F.coalesce("g", F.lit(False))
    runs = inputs.manifest.select("sample", "run", "truth_profile")
    # Every run sees its profile's whole catalogue: the equi join is on the profile.
    by_profile = catalogue.withColumn("truth_profile", F.explode(F.array(F.lit("AOHC"), F.lit("HG002")))).where((F.col("truth_profile") == "AOHC") | giab)
    by_profile = by_profile.withColumn("truth_source", A.truth_sources(syn & (F.col("truth_profile") == "AOHC"), giab))
    truth = runs.join(by_profile, "truth_profile").withColumn("locus_id", A.locus_id(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")))
    truth = staged(truth).select("sample", "run", "truth_profile", *KEY, "locus_id", "truth_source").join(called, IDENTITY, "left").withColumn("original_called", F.coalesce("original_called", F.lit(False)))
    forced = EV.forced_counts(truth.select(*BY, *KEY), inputs.reads, inputs.genome, min_mapq, inputs.size, BY)
    truth = truth.join(forced.withColumnsRenamed({c: f"forced_{c}" for c in forced.columns if c not in (*BY, *KEY)}), [*BY, *KEY], "left").withColumn("diagnostic_only", F.lit(True))
    callers = G.with_context(_labelled(_profiles(original.where("called"), inputs), inputs), inputs.genome, size=inputs.size).where(is_target & (F.col("label") == 0))
    features, truth = staged(features), staged(truth)
    labels = {"labeled_blind_candidates": F.lit(True), "positive_blind_candidates": F.col("label") == 1, "negative_blind_candidates": F.col("label") == 0}
    qc = counts.select(*BY, F.concat(F.lit("discovery_"), "metric").alias("metric"), F.col("value").cast("string").alias("value")).unionByName(M.quality_counts(features, list(BY), labels).where("metric <> 'rows'"))
    qc = qc.unionByName(M.quality_counts(truth, list(BY), {"truth_hp_loci": F.lit(True), "truth_originally_called": F.col("original_called")}).where("metric <> 'rows'"))
    told = truth.agg(F.coalesce(F.bool_and("diagnostic_only"), F.lit(True)).alias("truth_is_diagnostic_only"), F.count_distinct(*IDENTITY).alias("seen"), F.count(F.lit(1)).alias("n"))
    due = runs.join(by_profile.groupBy("truth_profile").agg(F.count(F.lit(1)).alias("c")), "truth_profile").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("due"))
    checks = M.checks(features, IDENTITY).join(told, F.lit(True)).join(due, F.lit(True))  # of one row each
    checks = checks.withColumn("truth_loci_complete", (F.col("n") == F.col("due")) & (F.col("seen") == F.col("n"))).drop("n", "seen", "due")
    order = ["sample", "run", *KEY]
    features, truth, callers = features.orderBy(*order), truth.orderBy(*order), callers.orderBy(*order)
    return {"features": features, "truth": truth, "baseline_fp": callers.select(*IDENTITY, "truth_profile", *KEY, "label").withColumn("evaluation_stratum", F.lit("HP")), "checks": checks, "qc": qc}
