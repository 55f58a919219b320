"""Forced counts walk reads near their keys only, with the counts of a plain walk of all reads."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from seqweave.operators import evidence as EV
from seqweave.operators import genome as G

SIZE = 64
READS = "run string, read_id long, qname string, flag int, mapq int, contig string, ref_start int, ref_end int, cigar array<struct<op:int,len:int>>, seq string"


def sequence(rng, n):
    """Bases with long runs and repeats, where an indel has many places."""
    out = ""
    while len(out) < n:
        out += rng.choice("ACGT") * rng.choice([1, 1, 2, 9]) if rng.random() < 0.8 else "".join(rng.choices("ACGT", k=rng.randint(2, 4))) * rng.randint(3, 12)
    return out[:n]


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(8)
    contigs = {"1": sequence(rng, 900), "2": sequence(rng, 300) + "CA" * 900 + sequence(rng, 200)}
    reads = []
    for k in range(500):
        name = rng.choice(["1", "2"])
        g = contigs[name]
        start, before = rng.randint(0, len(g) - 70), rng.randint(5, 40)
        n = rng.randint(1, 4)
        if rng.random() < 0.5:
            unit = g[start + before : start + before + n]
            ops, seq, end = [(0, before), (1, n), (0, 10)], g[start : start + before] + unit + g[start + before : start + before + 10], start + before + 10
        else:
            ops, seq, end = [(0, before), (2, n), (0, 10)], g[start : start + before] + g[start + before + n : start + before + n + 10], start + before + n + 10
        reads.append((f"r{k % 2}", k, str(k), rng.choice([0, 16, 1024]), rng.choice([5, 30]), name, start, end, ops, seq))
    chunks = [(c, k // SIZE, g[k : k + SIZE]) for c, g in contigs.items() for k in range(0, len(g), SIZE)]
    return contigs, reads, spark.createDataFrame(reads, READS), spark.createDataFrame(chunks, "contig string, chunk long, seq string")


def shown(g, read):
    """The read's event, as far left as it goes."""
    _, _, _, _, _, _, start, _, ((_, before), (op, n), _), seq = read
    pos = start + before
    unit = seq[before : before + n] if op == 1 else g[pos : pos + n]
    while pos > 1 and g[pos - 1] == unit[-1]:
        unit, pos = unit[-1] + unit[:-1], pos - 1
    a = g[pos - 1]
    return (pos, a, a + unit) if op == 1 else (pos, a + unit, a)


def test_counts_match_a_walk_of_all_reads(spark, case):
    contigs, reads, table, chunks = case
    good = [r for r in reads if r[3] != 1024 and r[4] >= 20]
    support = defaultdict(list)
    for r in good:
        support[r[0], r[5], *shown(contigs[r[5]], r)].append(r[3])
    keys = sorted(support)[::5] + [("r0", "1", 50, "A", "AGGGGGG"), ("r0", "lost", 5, "A", "AC")]
    got = {tuple(r)[:5]: r for r in EV.forced_counts(spark.createDataFrame(keys, "run string, chrom string, pos int, ref string, alt string"), table, chunks, size=SIZE).collect()}
    assert set(got) == set(keys)
    for k in keys:
        assert got[k]["alt_support"] == len(support.get(k, [])) and got[k]["alt_reverse_reads"] == sum(f == 16 for f in support.get(k, []))
        assert got[k]["coverage"] == sum(r[0] == k[0] and r[5] == k[1] and r[6] <= k[2] - 1 and r[7] >= k[2] - 1 + len(k[3]) for r in good)


def test_regions_reach_the_end_of_repeats(spark, case):
    """A repeat of 1,800 bases is longer than the first window; regions keep reads from being walked elsewhere."""
    contigs, _, table, chunks = case
    g = contigs["2"]
    at = next(p for p in range(1, 400) if g[p : p + 1800] == "CA" * 900)
    pos, unit = at, "CA"
    while g[pos - 1] == unit[-1]:
        unit, pos = unit[-1] + unit[:-1], pos - 1
    keys = spark.createDataFrame([("2", pos, g[pos - 1], g[pos - 1] + unit)], "chrom string, pos int, ref string, alt string")
    end = pos
    while g[end : end + 1] == unit[(end - pos) % 2]:
        end += 1
    region = G.shown_regions(keys, chunks, SIZE).collect()
    assert [(r["contig"], r["start"], r["end"]) for r in region] == [("2", pos - 2, end + 1)]
    near = {r["read_id"] for r in EV.near_regions(table, G.shown_regions(keys, chunks, SIZE)).collect()}
    assert near == {r["read_id"] for r in table.where((F.col("contig") == "2") & (F.col("ref_start") < end + 1) & (F.col("ref_end") >= pos - 2)).collect()}
    none = spark.createDataFrame([], keys.schema)
    assert EV.near_regions(table, G.shown_regions(none, chunks, SIZE)).isEmpty()
