"""Sequence context from windows of the reference: composition, homopolymer runs and left normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bases on either side for composition, and for runs.
FLANK, RUN_FLANK = 25, 100


def base_count(seq: Column, base: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(base), F.lit("")))


def gc_fraction(seq: Column) -> Column:
    gc, at = base_count(seq, "G") + base_count(seq, "C"), base_count(seq, "A") + base_count(seq, "T")
    return F.try_divide(gc.cast("double"), gc + at)


def entropy(seq: Column) -> Column:
    """Shannon bits over A, C, G and T; null without any."""
    counts = [base_count(seq, b).cast("double") for b in "ACGT"]
    total = counts[0] + counts[1] + counts[2] + counts[3]
    terms = [F.when(c > 0, -(c / total) * F.log2(c / total)).otherwise(0.0) for c in counts]
    return F.when(total > 0, terms[0] + terms[1] + terms[2] + terms[3])


def run_around(left: Column, inside: Column, right: Column, base: Column) -> Column:
    """struct(length, before): the run of base that covers `inside` (which may be empty), and its part before it; 0 and 0
    where a base inside differs."""
    before = _trailing(left, base)
    after = _trailing(F.reverse(right), base)
    uniform = F.length(F.replace(inside, base, F.lit(""))) == 0
    return F.when(uniform, F.struct((before + F.length(inside) + after).alias("length"), before.alias("before"))).otherwise(F.struct(F.lit(0).alias("length"), F.lit(0).alias("before")))


def _trailing(seq: Column, base: Column) -> Column:
    return F.length(seq) - F.length(F.rtrim(seq, base))


def changed_part(diff: Column, ref: Column, alt: Column) -> Column:
    """The inserted or deleted bases; empty where the lengths are equal."""
    return F.when(F.length(alt) > F.length(ref), diff["alt_mid"]).when(F.length(alt) < F.length(ref), diff["ref_mid"]).otherwise(F.lit(""))


def uniform_base(seq: Column) -> Column:
    return F.when((seq != "") & (F.length(F.replace(seq, F.substring(seq, 1, 1), F.lit(""))) == 0), F.substring(seq, 1, 1))


def runs(left: Column, right: Column, ref: Column, diff: Column, base: Column) -> Column:
    """struct(ref, alt) of the runs of base around the changed part on either allele."""
    prefix = diff["prefix"]
    before = F.concat(left, F.substring(ref, F.lit(1), prefix))
    after = F.concat(F.substring(ref, prefix + 1 + F.length(diff["ref_mid"]), F.length(ref)), right)
    return F.struct(run_around(before, diff["ref_mid"], after, base).alias("ref"), run_around(before, diff["alt_mid"], after, base).alias("alt"))


def context_columns(left: Column, here: Column, right: Column, pos: Column, ref: Column, alt: Column, prefix: Column, base: Column, around: Column) -> dict[str, Column]:
    """The context of an allele from the reference before it, at it and after it (up to RUN_FLANK bases on each side).
    prefix, base, around: of the minimal difference, `uniform_base` and `runs`.

    A homopolymer insertion or deletion has a uniform changed part and a run on both alleles; runs are null where the
    reference does not match or the changed part is not uniform.
    """
    local = F.concat(F.substring(F.concat(F.repeat(F.lit(" "), FLANK), left), -FLANK, FLANK), here, F.substring(right, 1, FLANK))
    local = F.trim(local)
    match = here == ref
    known = match & base.isNotNull()
    ref_len, alt_len = F.when(known, around["ref"]["length"]), F.when(known, around["alt"]["length"])
    hp = F.coalesce((ref_len > 0) & (alt_len > 0), F.lit(False))
    start0 = F.when(known, pos - 1 + prefix - around["ref"]["before"]).otherwise(pos - 1)
    return {
        "reference_match": match,
        "indel_type": F.when(F.length(alt) > F.length(ref), "insertion").when(F.length(alt) < F.length(ref), "deletion").otherwise("complex"),
        "indel_length": F.abs(F.length(alt) - F.length(ref)),
        "hp_base": base,
        "hp_ref_len": ref_len,
        "hp_alt_len": alt_len,
        "hp_delta": alt_len - ref_len,
        "is_homopolymer_indel": hp,
        "local_gc": gc_fraction(local),
        "local_entropy": entropy(local),
        "hp_start0": start0,
        "hp_end0": F.when(known, start0 + around["ref"]["length"]).otherwise(pos - 1 + F.greatest(F.length(ref), F.lit(1))),
    }


def without_suffix(ref: Column, alt: Column) -> Column:
    """How many bases to cut off both ends, one kept of either allele."""
    most = F.least(F.length(ref), F.length(alt)) - 1
    fits = lambda k: F.substring(F.reverse(ref), F.lit(1), k) == F.substring(F.reverse(alt), F.lit(1), k)
    return F.array_max(F.filter(F.sequence(F.lit(0), most), fits))


def without_prefix(ref: Column, alt: Column) -> Column:
    """How many bases to cut off both starts, one kept of either allele."""
    most = F.least(F.length(ref), F.length(alt)) - 1
    return F.array_max(F.filter(F.sequence(F.lit(0), most), lambda k: F.substring(ref, F.lit(1), k) == F.substring(alt, F.lit(1), k)))


def rotation(ref: Column, alt: Column) -> Column:
    """struct(unit, simple): the inserted or deleted bases, and whether one allele is the first base of the other."""
    unit = F.when(F.length(alt) > F.length(ref), F.substring(alt, F.lit(2), F.length(alt))).otherwise(F.substring(ref, F.lit(2), F.length(ref)))
    simple = (F.length(ref) != F.length(alt)) & (F.least(F.length(ref), F.length(alt)) == 1) & (F.substring(ref, 1, 1) == F.substring(alt, 1, 1))
    return F.struct(unit.alias("unit"), simple.alias("simple"))


def moves_left(left: Column, ref: Column, unit: Column) -> Column:
    """How far an indel of `unit` after the first base of ref moves left within `left`, the reference before it.

    Moving left by one turns the unit round by one: that needs the anchor to equal its last base. So the number of moves
    is how far the reference up to the anchor, read backwards, follows the unit repeated, backwards.
    """
    back, cycle, n = F.reverse(F.concat(left, F.substring(ref, 1, 1))), F.reverse(unit), F.length(unit)
    repeated = F.repeat(cycle, (F.length(left) / F.greatest(n, F.lit(1)) + 2).cast("int"))
    room = F.length(left)
    # The first place where they differ, by halving the length of the common prefix.
    step = lambda s, w: F.when((s + w <= room) & (F.substring(back, F.lit(1), s + w) == F.substring(repeated, F.lit(1), s + w)), s + w).otherwise(s)
    powers = F.array(*(F.lit(1 << k) for k in range(20, -1, -1)))
    return F.aggregate(powers, F.lit(0), step)


def moves_right(right: Column, unit: Column) -> Column:
    """How many bases of `right`, the reference after an indel's anchor, follow the unit repeated. An insertion moves right so
    far, a deletion by the unit's length less."""
    n, room = F.length(unit), F.length(right)
    repeated = F.repeat(unit, (room / F.greatest(n, F.lit(1)) + 1).cast("int"))
    step = lambda s, w: F.when((s + w <= room) & (F.substring(right, F.lit(1), s + w) == F.substring(repeated, F.lit(1), s + w)), s + w).otherwise(s)
    return F.aggregate(F.array(*(F.lit(1 << k) for k in range(20, -1, -1))), F.lit(0), step)


def moved_left(left: Column, pos: Column, ref: Column, alt: Column, unit: Column, moves: Column) -> Column:
    """struct(pos, ref, alt) of the indel `moves` bases to the left."""
    n = F.length(unit)
    k = moves % F.greatest(n, F.lit(1))
    turned = F.concat(F.substring(unit, n - k + 1, n), F.substring(unit, F.lit(1), n - k))
    start = F.substring(F.concat(left, F.substring(ref, 1, 1)), F.length(left) + 1 - moves, F.lit(1))
    long_ = F.concat(start, turned)
    insertion = F.length(alt) > F.length(ref)
    return F.struct((pos - moves).alias("pos"), F.when(insertion, start).otherwise(long_).alias("ref"), F.when(insertion, long_).otherwise(start).alias("alt"))
