"""Column functions over contig names, alleles, genotypes and call annotations. All are plain expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Truth sources and label names.
SYNTHETIC, GIAB = "AOHC_SYNTHETIC", "GIAB_HG002"
CONFIDENT_REFERENCE, OUTSIDE = "GIAB_CONFIDENT_REFERENCE", "OUTSIDE_GIAB_BENCHMARK"
TP, REFERENCE, UNKNOWN = "TP", "REFERENCE", "UNKNOWN"
#: Profile names, their aliases, and the truth sources that each profile uses.
PROFILE_ALIASES = {"AOHC": "AOHC", "HG002": "HG002", "NA24385": "HG002", "GIAB": "HG002"}
PROFILE_SOURCES = {"AOHC": (SYNTHETIC, GIAB), "HG002": (GIAB,)}
#: Annotation fields carried from INFO or FORMAT.
CALL_FIELDS = ("TYPE", "LEN", "AF", "AO", "FAO", "FDP", "FRO", "FSAF", "FSAR", "FSRF", "FSRR", "HRUN", "MLLD", "RBI", "REFB", "VARB", "FWDB", "REVB", "FXX", "STB", "STBP")
#: Flags read from a filter reason, each with the texts that raise it.
REASON_FLAGS = {
    "prediction_shift": ("PREDICTIONSHIFT",),
    "stringency": ("STRINGENCY",),
    "quality_score": ("QUALITYSCORE",),
    "homopolymer": ("HPLEN", "HOMOPOLYMER"),
    "strand_bias": ("STRANDBIAS",),
    "read_quality": ("READQUALITY",),
    "coverage": ("COVERAGE",),
}


def canonical_chrom(name: Column) -> Column:
    """Without white space around and a leading chr; M and MT are MT, x and y upper case, all else as it is."""
    bare = F.regexp_replace(F.regexp_replace(name, r"^\s+|\s+$", ""), "^(?i)chr", "")
    up = F.upper(bare)
    return F.when(up.isin("M", "MT"), "MT").when(up.isin("X", "Y"), up).otherwise(bare)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTNacgtn", "TGCANtgcan"))


def is_sequence_allele(allele: Column) -> Column:
    return F.coalesce(F.upper(allele).rlike("^[ACGTN]+$"), F.lit(False))


def locus_id(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    return F.concat_ws(":", chrom, pos.cast("string"), ref, alt)


def variant_key(chrom: Column, pos: Column, ref: Column, alt: Column) -> list[Column]:
    c, r, a = canonical_chrom(chrom), F.upper(ref), F.upper(alt)
    return [c.alias("chrom"), pos.cast("int").alias("pos"), r.alias("ref"), a.alias("alt"), locus_id(c, pos, r, a).alias("locus_id")]


def end0(pos: Column, ref: Column) -> Column:
    """End of an allele's reference span, 0-based and exclusive."""
    return pos - 1 + F.greatest(F.length(ref), F.lit(1))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), n), lambda k: F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k))
    return F.array_max(same)


def minimal_difference(ref: Column, alt: Column) -> Column:
    """struct(prefix, ref_mid, alt_mid): what is left without the common prefix, then without a common suffix beyond it."""
    p = common_prefix(ref, alt)
    r, a = F.substring(ref, p + 1, F.length(ref)), F.substring(alt, p + 1, F.length(alt))
    s = common_prefix(F.reverse(r), F.reverse(a))
    return F.struct(p.alias("prefix"), F.substring(r, F.lit(1), F.length(r) - s).alias("ref_mid"), F.substring(a, F.lit(1), F.length(a) - s).alias("alt_mid"))


def genotype_positive(gt: Column) -> Column:
    """Any numeric allele above zero."""
    alleles = F.split(F.coalesce(gt, F.lit("")), r"[/|]")
    return F.exists(alleles, lambda t: t.rlike("^[0-9]+$") & (F.coalesce(t.try_cast("long"), F.lit(0)) > 0))


def call_positive(filters: Column, gt: Column) -> Column:
    return F.coalesce((filters == "PASS") & genotype_positive(gt), F.lit(False))


def sanitized_info(info: Column) -> Column:
    """INFO up to its first FUNC=, without the semicolon before that; nothing left is a dot."""
    cut = F.regexp_replace(info, r"(?s);?FUNC=.*$", "")
    return F.when(info.contains("FUNC="), F.when(cut == "", ".").otherwise(cut)).otherwise(info)


def filter_reason(reason: Column) -> list[Column]:
    text = F.upper(F.coalesce(reason, F.lit("")))
    shift = F.regexp_extract(text, r"PREDICTIONSHIFTX([0-9.+\-E]+)>", 1)
    flags = [F.greatest(*(text.contains(t).cast("int") for t in texts)).alias(f"reason_{name}") if len(texts) > 1 else text.contains(texts[0]).cast("int").alias(f"reason_{name}") for name, texts in REASON_FLAGS.items()]
    return [F.when(shift != "", shift.try_cast("double")).alias("reason_prediction_shift_value"), *flags]


def ratio(numerator: Column, denominator: Column) -> Column:
    n, d = numerator.try_cast("double"), denominator.try_cast("double")
    return F.when(d > 0, n / d)


def allele_fractions(ao: Column, dp: Column, fao: Column, fdp: Column) -> list[Column]:
    raw, flow = ratio(ao, dp), ratio(fao, fdp)
    return [raw.alias("vcf_raw_af"), flow.alias("vcf_flow_af"), (raw - flow).alias("vcf_raw_minus_flow_af")]


def plain_value(values: Column) -> Column:
    """None or no value: null; one: itself; more: joined by commas."""
    return F.when(F.size(values) > 0, F.array_join(values, ","))


def allele_value(values: Column, alt_index: Column) -> Column:
    """Of several values the one of the alternative (from 0) if there is one, else all joined by commas."""
    return F.when(F.size(values) > 1, F.coalesce(F.get(values, alt_index), F.array_join(values, ","))).otherwise(F.get(values, F.lit(0)))


def count_value(values: Column, index: Column) -> Column:
    """The count at the index, 0 where there is none."""
    return F.coalesce(F.get(values, index).try_cast("long"), F.lit(0).cast("long"))


def targeted_homopolymer(reference_match: Column, is_hp_indel: Column, ref_len: Column, alt_len: Column, least: int = 4) -> Column:
    return F.coalesce(reference_match & is_hp_indel & (F.greatest(ref_len, alt_len) >= least), F.lit(False))


def stratum(targeted: Column) -> Column:
    return F.when(targeted, "HP").otherwise("NON_HP")


def truth_sources(synthetic: Column, giab: Column) -> Column:
    return F.concat_ws("+", F.when(synthetic, SYNTHETIC), F.when(giab, GIAB))


def label_columns(synthetic: Column, giab: Column, confident: Column) -> list[Column]:
    """label, label_name and truth_source from membership in either truth set and in a confident interval."""
    truth = synthetic | giab
    return [
        F.when(truth, 1).when(confident, 0).cast("int").alias("label"),
        F.when(truth, TP).when(confident, REFERENCE).otherwise(UNKNOWN).alias("label_name"),
        F.when(truth, truth_sources(synthetic, giab)).when(confident, CONFIDENT_REFERENCE).otherwise(OUTSIDE).alias("truth_source"),
    ]
